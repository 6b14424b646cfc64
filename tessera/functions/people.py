"""Stand-ins for personal data: equal keys give equal values, and one person's values fit each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key_number, picked

FEMALE = ["Alba", "Birgit", "Chloe", "Dalia", "Elena", "Freya", "Greta", "Hanna", "Ines", "Julia", "Kira", "Lena", "Mona", "Nora", "Olga", "Petra"]
MALE = ["Anton", "Boris", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Luis", "Marco", "Nils", "Oscar", "Paul"]
LAST = ["Abel", "Baker", "Castro", "Duval", "Engel", "Fischer", "Garcia", "Holm", "Ibsen", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez", "Quinn", "Rossi", "Santos", "Tanaka"]
STREETS = ["Oak Street", "Mill Lane", "Station Road", "Park Avenue", "High Street", "Lake Drive", "Church Road", "Hill Street"]
CITIES = ["Springfield", "Riverton", "Lakeside", "Fairview", "Milltown", "Brookfield", "Hillcrest", "Ashford"]
DOMAINS = {"all_persons": ["example.com", "example.org", "example.net"], "company": ["corp.example.com", "works.example.org"]}
#: ISO 3166 codes with names in English; 'Russia' and 'UK' are taken as well.
COUNTRIES = {
    "austria": "at", "belgium": "be", "brazil": "br", "canada": "ca", "china": "cn", "denmark": "dk", "finland": "fi", "france": "fr", "germany": "de", "greece": "gr", "india": "in", "ireland": "ie", "italy": "it",
    "japan": "jp", "mexico": "mx", "netherlands": "nl", "norway": "no", "poland": "pl", "portugal": "pt", "russia": "ru", "russian federation": "ru", "spain": "es", "sweden": "se", "switzerland": "ch", "turkey": "tr",
    "uk": "gb", "ukraine": "ua", "united kingdom": "gb", "united states": "us",
}


def country_code(name: Column) -> Column:
    """The two-letter code of a country's name or code; null for one that is not known."""
    known = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(known, low), F.when(low.isin(sorted(set(COUNTRIES.values()))), low))


def persona(row: Column, seed: int = 0, email_format: str = "first.last", domain: str = "all_persons") -> Column:
    """struct<gender, first_name, last_name, name, email> of a row, all of one person."""
    key = lambda what: (F.lit(seed), F.lit(what), row)
    female = F.pmod(key_number(*key("gender")), F.lit(2)) == 0
    first = F.when(female, picked(FEMALE, *key("first"))).otherwise(picked(MALE, *key("first")))
    last = picked(LAST, *key("last"))
    user = {"first.last": F.concat(first, F.lit("."), last), "firstlast": F.concat(first, last), "flast": F.concat(F.substring(first, 1, 1), last), "first_last": F.concat(first, F.lit("_"), last)}[email_format]
    email = F.lower(F.concat(user, F.lit("@"), picked(DOMAINS[domain], *key("domain"))))
    return F.struct(F.when(female, "female").otherwise("male").alias("gender"), first.alias("first_name"), last.alias("last_name"), F.concat_ws(" ", first, last).alias("name"), email.alias("email"))


def digits(pattern: str, *key) -> Column:
    """The pattern with each # as a digit and each ? as a lower-case letter, chosen by hash of the key."""
    out = []
    for i, c in enumerate(pattern):
        h = key_number(i, *key)
        out.append(F.pmod(h, F.lit(10)).cast("string") if c == "#" else F.char((F.pmod(h, F.lit(26)) + 97).cast("int")) if c == "?" else F.lit(c))
    return F.concat(*out)


def fake(kind: str, *key) -> Column:
    """A stand-in of a kind (name, email, street_address, city, postcode, phone_number, ssn, credit_card, itin) by key."""
    person = persona(key_number(*key))
    return {
        "first_name": person["first_name"], "last_name": person["last_name"], "name": person["name"], "email": person["email"],
        "street_address": F.concat(F.pmod(key_number("no", *key), F.lit(900)) + 1, F.lit(" "), picked(STREETS, F.lit("street"), *key)), "city": picked(CITIES, F.lit("city"), *key),
        "postcode": digits("#####", F.lit("zip"), *key), "phone_number": digits("###-###-####", F.lit("tel"), *key), "fax_number": digits("###-###-####", F.lit("fax"), *key), "ssn": digits("###-##-####", F.lit("ssn"), *key),
        "itin": F.concat(F.lit("9"), digits("##-7#-####", F.lit("itin"), *key)), "credit_card": digits("4###############", F.lit("card"), *key),
    }[kind]
