"""Recognisers of personal data: for each label a pattern, where it may stand, and a check of what it finds.

Whether a recogniser takes part for a column is decided once, by the column's name: ``header`` words raise
its score, ``against`` words rule it out, and one that needs context is left out where neither its header
fits nor a word near a match could.  ``hint`` is a cheaper pattern that every match contains; texts without
it need not be searched.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import ipaddress
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.people import COUNTRIES, FEMALE, LAST, MALE

LOW, MEDIUM, HIGH = 0.2, 0.5, 0.8
#: Characters of a person's name at most.
LONGEST_NAME = 64


def header_tokens(name: str) -> list[str]:
    """The words of a column's name: split at everything but letters and digits and before capitals, in lower case."""
    parted = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [t for t in re.split(r"[\W_]+", parted.casefold()) if t and not t[0].isdigit()]


@dataclass(frozen=True)
class Recognizer:
    label: str
    pattern: str
    score: float = HIGH
    context_score: float = HIGH
    header: tuple[str, ...] = ()
    against: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    context_only: bool = False
    whole: bool = False
    hint: str = ""
    #: patterns for a column's name in lower case, beside the words
    header_patterns: tuple[str, ...] = ()
    against_patterns: tuple[str, ...] = ()
    valid: Callable[[str], bool] | None = field(default=None, compare=False)

    def names(self, column: str) -> bool:
        """Whether the column's name speaks for the label; several words of a header stand one after the other."""
        tokens = f" {' '.join(header_tokens(column))} "
        return any(f" {h} " in tokens for h in self.header) or any(re.search(p, column.casefold()) for p in self.header_patterns)

    def applies(self, column: str) -> bool:
        tokens = f" {' '.join(header_tokens(column))} "
        if any(f" {h} " in tokens for h in self.against) or any(re.search(p, column.casefold()) for p in self.against_patterns):
            return False
        return not self.context_only or bool(self.context) or self.names(column)

    def width(self) -> tuple[int, int]:
        """The fewest and most characters of a match."""
        low, high = re._parser.parse(self.pattern).getwidth()
        return low, min(high, 2**31 - 1)

    def hint_words(self) -> list[str]:
        """The words of a hint that is a choice of plain ones, in lower case where it fits any case; else none."""
        folded = self.hint.startswith("(?i)")
        parts = [re.sub(r"\\(\W)", r"\1", p) if re.fullmatch(r"(?:[^\\.^$*+?{}\[\]()]|\\\W)+", p) else None for p in self.hint.removeprefix("(?i)").split("|")]
        return [] if None in parts else [p.lower() if folded else p for p in parts]

    def needs_digit(self) -> bool:
        """Whether the hint has a digit that every match of it has."""
        return not re.search(r"[|(]", self.hint) and bool(re.search(r"\\d(?![?*]|\{0)", self.hint))


def phrase_pattern(phrase: str) -> str:
    """A pattern for a phrase as it stands, whole words only where it begins or ends with a letter or digit."""
    left, right = (r"\b" if phrase[i : i + 1 or None].isalnum() else "" for i in (0, -1))
    return left + re.escape(phrase) + right


def phrases(label: str, items: Iterable[str], score: float = HIGH, **options) -> Recognizer:
    """One recogniser for a list of phrases, the longest first."""
    found = sorted(set(items), key=lambda p: (-len(p), p))
    return Recognizer(label, "|".join(map(phrase_pattern, found)), score, **options)


def selected(recognizers: Iterable[Recognizer], labels: Iterable[str]) -> tuple[Recognizer, ...]:
    """Those whose label is named; ``*`` stands for any part of a label."""
    wanted = [re.compile("".join(".*" if c == "*" else re.escape(c) for c in label)) for label in labels]
    return tuple(r for r in recognizers if any(w.fullmatch(r.label) for w in wanted))


# -- checks of matches


def luhn(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return len(digits) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def mod97(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    return s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def address(s: str) -> bool:
    try:
        ipaddress.ip_address(s)
    except ValueError:
        return False
    return True


def social_security(s: str) -> bool:
    """Area, group and serial numbers that are given out: no 000, 666 or 9xx, no 00, no 0000."""
    area, group, serial = re.sub(r"\D", "", s)[:3], re.sub(r"\D", "", s)[3:5], re.sub(r"\D", "", s)[5:]
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def routing_number(s: str) -> bool:
    """The weighted sum of a bank's routing number is a multiple of ten."""
    digits = [int(c) for c in s if c.isdigit()]
    return len(digits) == 9 and sum(d * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def bank_code(s: str) -> bool:
    return s[4:6].lower() in set(COUNTRIES.values())


def web_token(s: str) -> bool:
    """Header and body are JSON in base 64."""
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in s.split(".")[:2]]
    except (ValueError, binascii.Error):
        return False
    return all(isinstance(p, dict) for p in parts)


def letters_and_digits(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def age(s: str) -> bool:
    return not s[0].isdigit() or 0 <= float(s) <= 1440


def degrees(most: float) -> Callable[[str], bool]:
    return lambda s: abs(float(s)) <= most


#: Date formats that a value is tried with; numbers are seconds since 1970.
DATES = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "%m/%d/%Y %H:%M:%S", "%b %d, %Y", "%d %b %Y", "%B %d, %Y", "%d %B %Y", "%Y%m%d")


def date_of(s: str) -> datetime.datetime | None:
    for fmt in DATES:
        try:
            return datetime.datetime.strptime(s, fmt)
        except ValueError:
            continue
    if re.fullmatch(r"\d{9,10}(\.\d+)?", s):
        return datetime.datetime.fromtimestamp(float(s), datetime.timezone.utc)
    return None


NAMES = frozenset(n.casefold() for n in (*FEMALE, *MALE, *LAST))


def known_name(s: str) -> bool:
    words = re.findall(r"[^\W\d_]+", s.casefold())
    return bool(words) and all(w in NAMES for w in words)


_HEX = r"[0-9a-fA-F]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HOST = r"(?<![\w@.-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-]|\.\w)"
_DATE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:?\d{2}|Z)?)?|\d{1,2}[/.]\d{1,2}[/.]\d{4}(?: \d{2}:\d{2}:\d{2})?|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]{2,8} \d{4}"

RECOGNIZERS = (
    Recognizer("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", hint="@"),
    Recognizer("ipv4", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d.])", against=("version", "ver"), hint=r"\d\.\d", valid=address),
    Recognizer("phone_number", r"(?<![\d-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])", header=("phone", "tel", "mobile", "fax"), hint=r"\d{3}[ .-]\d{4}"),
    Recognizer("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", header=("ssn",), hint=r"\d-\d{2}-\d", valid=social_security),
    Recognizer("credit_card", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", header=("card", "cc", "credit"), context=("card", "visa", "credit"), context_only=True, hint=r"\d{3}[ -]?\d{3}", valid=luhn),
    Recognizer("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,28}\b", header=("iban", "bank"), hint=r"[A-Z]{2}\d{2}", valid=mod97),
    Recognizer("aba_routing_number", r"(?<!\d)[0-36-8]\d{3}-?\d{4}-?\d(?!\d)", header=("aba", "routing", "rtn"), context=("routing",), context_only=True, hint=r"\d{4}-?\d{4}", valid=routing_number),
    Recognizer("swift", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", header=("swift", "bic"), context=("swift", "bic"), context_only=True, hint="[A-Z]{6}", valid=bank_code),
    Recognizer("imei", r"(?<!\d)(?:\d{15}|\d{2}-\d{6}-\d{6}-\d)(?!\d)", header=("imei", "meid"), context=("imei", "meid"), context_only=True, hint=r"\d{6}", valid=luhn),
    Recognizer("url", r"\bhttps?://[^\s<>\"']+", header=("url", "uri", "web"), hint="://"),
    Recognizer("domain_name", _HOST, LOW, header=("domain", "dns", "site"), against=("software",), context_only=True),
    Recognizer("hostname", _HOST, LOW, header=("host", "hostname", "server"), context_only=True),
    Recognizer("mac_address", rf"\b(?:{_HEX}{{2}}[:-]){{5}}{_HEX}{{2}}\b", hint=rf"{_HEX}{{2}}[:-]{_HEX}{{2}}[:-]"),
    Recognizer("uuid", rf"{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}", whole=True, hint=rf"{_HEX}{{4}}-{_HEX}{{4}}-"),
    Recognizer("md5", rf"{_HEX}{{32}}", whole=True, hint=f"{_HEX}{{32}}", valid=letters_and_digits),
    Recognizer("sha256", r"[0-9a-zA-Z]{64}", whole=True, hint=r"[0-9a-zA-Z]{64}", valid=letters_and_digits),
    Recognizer("sha512", r"[0-9a-zA-Z]{128}", whole=True, hint=r"[0-9a-zA-Z]{128}", valid=letters_and_digits),
    Recognizer("zip_code", r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)", LOW, header=("zip", "zipcode", "postcode", "postal"), context=("zip", "postal"), context_only=True, hint=r"\d{5}"),
    Recognizer("latitude", r"(?<![\d.])[-+]?\d{1,2}\.\d{2,}(?![\d.])", LOW, header=("lat", "latitude", "coordinate y"), against=("latency",), context_only=True, hint=r"\d\.\d", valid=degrees(90)),
    Recognizer("longitude", r"(?<![\d.])[-+]?\d{1,3}\.\d{2,}(?![\d.])", LOW, header=("lon", "lng", "long", "longitude", "coordinate x"), context_only=True, hint=r"\d\.\d", valid=degrees(180)),
    Recognizer("gps", r"(?<![\d.])-?\d{1,3}\.\d{3,}, ?-?\d{1,3}\.\d{3,}(?![\d.])", LOW, header=("gps", "location", "coords"), context_only=True, hint=r"\d\.\d"),
    Recognizer("plus_code", r"[23456789CFGHJMPQRVWX]{8}\+[23456789CFGHJMPQRVWX]{2,3}", whole=True, hint=r"\+"),
    Recognizer("stripe_key", r"\b[rsp]k_live_[0-9a-zA-Z]{24}\b", hint="k_live_"),
    Recognizer("square_key", r"\bsq0(?:csp-[0-9A-Za-z_-]{43}|[a-z]{3}-[0-9A-Za-z_-]{22})(?![0-9A-Za-z_-])", hint="sq0"),
    Recognizer("slack_secret", r"https://hooks\.slack\.com/services/[A-Za-z0-9+/]{40,48}|\bxox[abeoprs]-(?:\d{8,13}-)*[0-9a-zA-Z-]{10,}", hint=r"xox|hooks\.slack"),
    Recognizer("twilio_key", r"\b(?:SK|AC)[0-9a-f]{32}\b", hint="SK|AC"),
    Recognizer("sendgrid_key", r"\bSG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}(?![0-9A-Za-z_-])", hint=r"SG\."),
    Recognizer("google_key", r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])|\bya29\.[0-9A-Za-z_-]+", hint=r"AIza|ya29"),
    Recognizer("facebook_token", r"\bEAACEdEose0cBA[0-9A-Za-z]+", hint="EAACEdE"),
    Recognizer("github_token", r"(?<![0-9a-zA-Z])[0-9a-f]{35,40}(?![0-9a-zA-Z])", MEDIUM, MEDIUM, header=("github", "git"), against=("commit", "hash", "head"), context_only=True, hint="[0-9a-f]{35}", valid=letters_and_digits),
    Recognizer("generic_key", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{20,255}(?![A-Za-z0-9_.-])", header=("api key", "apikey", "token", "secret"), context=("api key", "api_key", "api token", "secret"), context_only=True, hint=r"[A-Za-z0-9_.-]{20}", valid=letters_and_digits),
    Recognizer("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?", hint="eyJ", valid=web_token),
    Recognizer("gender", r"(?i)non-?binary|trans(?:gender)?|intersex|female|male|[mf]", 1.0, 1.0, header=("gender",), context_only=True, whole=True),
    Recognizer("sex", r"(?i)[mf]", 1.0, 1.0, header=("sex",), context_only=True, whole=True),
    Recognizer("sex", r"(?i)female|male", header=("sex",), whole=True, hint=r"(?i)male"),
    Recognizer("age", r"\d{1,4}(?:\.\d)?|(?i:adult|teen(?:ager)?|child|infant|senior)", header=("age", "ages"), context_only=True, whole=True, valid=age),
    Recognizer("race", r"(?i)african[ -]american|native american|american indian|pacific islander|native hawaiian|alaska native", hint=r"(?i)american|islander|hawaiian|alaska"),
    Recognizer("race", r"(?i)\b(?:white|black|asian|caucasian)\b", header=("race", "ethnicity"), context_only=True),
    Recognizer("ethnicity", r"(?i)\b(?:non[ -])?(?:hispanic|latin[oax])(?: or latin[oax])?\b", hint=r"(?i)hispanic|latin"),
    Recognizer("date", _DATE, header=("date", "time", "datetime", "timestamp", "day"), context_only=True, valid=lambda s: date_of(s) is not None),
    Recognizer("birth_date", _DATE, header=("dob", "birth", "birthdate", "birthday", "born"), context_only=True, valid=lambda s: date_of(s) is not None),
    Recognizer("person_name", r".{1,%d}" % LONGEST_NAME, header=("first name", "last name", "full name", "firstname", "lastname", "fullname", "surname", "fname", "lname"), context_only=True, whole=True, valid=lambda s: any(c.isalpha() for c in s)),
    Recognizer("person_name", r".{1,%d}" % LONGEST_NAME, header=("name", "names"), context_only=True, whole=True, valid=known_name),
)
