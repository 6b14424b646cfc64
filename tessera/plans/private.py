"""Personal data, edits and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as T
from ..operators import phrases as P
from ..operators import pii
from ..operators import rules as R
from .registry import query, table

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


_EMAIL_ONLY = pii.selected(pii.RECOGNIZERS, ["email"])
#: A text for each label that needs no header, and what is found in it.
TEXTS = (
    ("write to a.b+c@mail.example.org now", "email"), ("from 10.1.2.30 to", "ipv4"), ("call +1 (212) 555-0187 today", "phone_number"), ("no. 123-45-6789.", "ssn"), ("card 4111 1111 1111 1111", "credit_card"), ("to DE89370400440532013000 soon", "iban"),
    ("routing no. 021000021", "aba_routing_number"), ("swift DEUTDEFF500", "swift"), ("imei 49-015420-323751-8", "imei"), ("see https://example.org/x?y=1 there", "url"), ("at 00:1B:44:11:3A:B7", "mac_address"),
    ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("9e107d9d372bb6826bd81d3542a419d6", "md5"), ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "sha256"), ("zip 90210-1234", "zip_code"), ("849VCWC8+R9", "plus_code"),
    ("key sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc" + " end", "stripe_key"), ("sq0atp-" + "A1b2C3d4E5f6G7h8I9j0K1", "square_key"), ("xoxb-" + "123456789012-abcdefghij", "slack_secret"), ("SK" + "0123456789abcdef" * 2, "twilio_key"),
    ("SG." + "a" * 22 + "." + "b" * 43, "sendgrid_key"), ("AIza" + "S" * 35, "google_key"), ("EAACEdEose0cBA" + "1a2b", "facebook_token"), ("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln", "jwt"), ("a native american poet", "race"), ("of hispanic origin", "ethnicity"),
    ("secret abcdef-0123456789-abcdef", "generic_key"), ("no. 000-12-3456, 10.0.0.256 and 4111 1111 1111 1112", None), ("nothing here", None),
)
#: A column's name, a value in it, and the label found there; the same value in a column named note has none.
CELLS = (
    ("latitude", "52.5200", "latitude"), ("lng", "-113.4050", "longitude"), ("gps", "52.520, 13.405", "gps"), ("gender", "non-binary", "gender"), ("sex", "F", "sex"), ("age", "42", "age"), ("race", "asian", "race"),
    ("dob", "1990-02-28", "birth_date"), ("event_date", "28.02.1990", "date"), ("first_name", "Anyname", "person_name"), ("names", "Greta Fischer", "person_name"), ("github", "0a" * 18, "github_token"),
    ("domain", "www.example.org", "domain_name"), ("serverHost", "db-1.example.org", "hostname"), ("zipcode", "90210", "zip_code"),
)


@query(rf"SELECT sum(len(regexp_extract_all(text, '\b{_EMAIL}\b'))) AS emails, count(*) FILTER (regexp_matches(text, '\b{_EMAIL}\b')) AS documents FROM documents")
def pii_regex_counts(spark, sf):
    n = F.size(pii.spans("text", _EMAIL_ONLY))
    return table(spark, sf, "documents").select(n.alias("n")).agg(F.sum("n").alias("emails"), F.count_if(F.col("n") > 0).alias("documents"))


@query(rf"SELECT doc_id, u.e AS value FROM documents, unnest(regexp_extract_all(text, '\b{_EMAIL}\b')) AS u(e)")
def pii_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", pii.spans("text", _EMAIL_ONLY).alias("found"))
    return d.select("doc_id", F.inline("found")).select("doc_id", F.col("text").alias("value"))


@query(rf"SELECT doc_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\b{_EMAIL}\b', '<email>', 'g') AS text FROM documents")
def pii_merge_redact(spark, sf):
    d = table(spark, sf, "documents").withColumn("found", pii.spans("text", _EMAIL_ONLY))
    return d.select("doc_id", pii.redacted(F.col("text"), F.col("found")).alias("text"))


@query()
def pii_redact_all(spark, sf):
    d = table(spark, sf, "documents").withColumn("found", pii.spans("text"))
    return d.select("doc_id", pii.redacted(F.col("text"), F.col("found")).alias("text"), F.size("found").alias("n"))


@query(rf"SELECT 'text' AS \"column\", 'email' AS label, count(*) AS n, count(DISTINCT e) AS n_values FROM (SELECT unnest(regexp_extract_all(text, '\b{_EMAIL}\b')) AS e FROM documents)".replace('\\"', '"'))
def pii_entity_stats(spark, sf):
    return pii.entity_counts(table(spark, sf, "documents"), ["text"], _EMAIL_ONLY)


@query()
def pii_entity_report(spark, sf):
    return pii.entity_counts(table(spark, sf, "documents"), ["text"])


def _noted(spark, sf):
    notes = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i long, note string")
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % len(TEXTS)).alias("i")).join(F.broadcast(notes), "i")


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


@query(f"SELECT label, count(*) AS n FROM customer JOIN ({_values([(i, label) for i, (_, label) in enumerate(TEXTS)])}) v(i, label) ON c_custkey % {len(TEXTS)} = i WHERE label IS NOT NULL GROUP BY 1")
def pii_labels(spark, sf):
    return _noted(spark, sf).select(F.inline(pii.spans("note"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f'SELECT c AS "column", label, count(*) AS n, count(*) AS hits FROM customer, ({_values([(c, label) for c, _, label in CELLS])}) v(c, label) GROUP BY 1, 2')
def pii_labels_by_header(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit(None).cast("string").alias("note"), *[F.lit(v).alias(name) for name, v, _ in CELLS])
    counted = pii.field_metadata(c, [name for name, *_ in CELLS])
    return counted.select("column", "label", "n", F.round(F.col("share") * F.col("n")).cast("long").alias("hits"))


@query("""
SELECT c_custkey, substr(sha256('s' || 'p' || c_custkey || '@example.org'), 1, 9) AS contact, 'mail <email> of ' || c_name AS note, c_name FROM customer
""")
def deidentified_table(spark, sf):
    address = F.concat(F.lit("p"), F.col("c_custkey"), F.lit("@example.org"))
    c = table(spark, sf, "customer").select("c_custkey", address.alias("contact"), F.concat(F.lit("mail "), address, F.lit(" of "), "c_name").alias("note"), "c_name")
    return pii.deidentified(c, ["contact", "note"], "s")[0]


@query("""
SELECT * FROM (SELECT 'contact' AS "column", 'email' AS entity, 'email' AS label, count(*) AS n, count(DISTINCT c_custkey) AS n_values FROM customer
 UNION ALL SELECT 'note', NULL, 'email', count(*), count(DISTINCT c_custkey) FROM customer)
""")
def deidentified_report(spark, sf):
    address = F.concat(F.lit("p"), F.col("c_custkey"), F.lit("@example.org"))
    c = table(spark, sf, "customer").select(address.alias("contact"), F.concat(F.lit("mail "), address, F.lit(" of "), "c_name").alias("note"))
    return pii.deidentified(c, ["contact", "note"], "s")[1]


@query("""
SELECT c_custkey, list_transform(range(0, 5), lambda k: 200 * k + length(CAST(c_custkey AS VARCHAR)) + 2) AS starts FROM customer WHERE c_custkey % 10 = 0
""")
def pii_chunked(spark, sf):
    """An address every 200 characters, in chunks of 128 with an overlap of 32."""
    c = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select("c_custkey")
    piece = F.rpad(F.lit("x@example.org"), 200, " ")
    long_text = F.concat(F.lit(" \n"), F.col("c_custkey"), F.lit(": "), F.repeat(piece, F.lit(5)))
    found = pii.chunked_spans(c.withColumn("note", long_text), "c_custkey", "note", _EMAIL_ONLY, 128, 32)
    return found.select("c_custkey", F.transform("found", lambda s: s["start"]).alias("starts"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment,
       CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 1.0 ELSE c_acctbal END AS c_acctbal, CAST(NULL AS VARCHAR) AS note
FROM customer WHERE NOT c_nationkey = 3
""")
def rule_step(spark, sf):
    step = {
        "vars": {"mean": "avg(c_acctbal)"},
        "columns": {"add": [{"name": "note"}], "rename": [{"name": "c_custkey", "value": "id"}, {"name": "c_mktsegment", "value": "segment"}], "drop": [{"name": "c_name"}]},
        "rows": {"drop": [{"condition": "c_nationkey = 3"}], "update": [
            {"name": "segment", "condition": "segment <> 'BUILDING' AND c_acctbal < 0", "value": "'DEBT'"},
            {"name": "segment", "condition": "this = 'BUILDING'", "value": "lower(this)"},
            {"entity": "money", "condition": "this > var_mean", "value": "1.0"}]},
    }
    c = table(spark, sf, "customer")
    return R.apply_steps(c, [step], entities={"c_acctbal": "money"}).drop("c_nationkey")


@query("SELECT 'MM/dd/yyyy' AS format, o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS date, CAST(epoch(o_orderdate) - (SELECT min(epoch(o_orderdate)) FROM orders) AS BIGINT) AS seconds FROM orders")
def date_format_infer(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("d"))
    fmt = T.inferred_format(o, "d")
    at = F.try_to_timestamp("d", F.lit(fmt))
    return T.seconds_since_first(o.withColumns({"date": F.date_format(at, "dd.MM.yyyy"), "format": F.lit(fmt)}), "d").select("format", "o_orderkey", "date", F.col("d").alias("seconds"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day_first, strftime(o_orderdate, '%m/%d/%y') AS month_first, 'dd/MM/yyyy' AS f1, 'MM/dd/yy' AS f2, 'MMM dd, yyyy' AS f3, 'yyyy-MM-dd''T''HH:mm:ssXXX' AS f4 FROM orders
""")
def date_formats_by_permutation(spark, sf):
    o = table(spark, sf, "orders")
    kinds = {"f1": "dd/MM/yyyy", "f2": "MM/dd/yy", "f3": "MMM dd, yyyy", "f4": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    d = o.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(c) for c, f in kinds.items()])
    return d.select("o_orderkey", F.col("f1").alias("day_first"), F.col("f2").alias("month_first"), *[F.lit(T.inferred_format(d, c)).alias(c) for c in kinds])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y/%m/%d') END AS day FROM orders
""")
def dates_of_mixed_formats(spark, sf):
    texts = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.unix_timestamp("o_orderdate").cast("string"), F.lit("soon"))
    o = table(spark, sf, "orders").select("o_orderkey", F.element_at(texts, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("t"))
    return o.select("o_orderkey", T.reformatted(F.col("t"), "yyyy/MM/dd").alias("day"))


@query("SELECT count(*) AS n, count(*) AS moved FROM orders")
def date_shift(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    s = o.withColumn("s", T.shifted(F.col("d"), "yyyy-MM-dd", 30, "o_orderkey"))
    gap = F.abs(F.date_diff(F.to_date("s"), F.to_date("d")))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if((gap >= 1) & (gap <= 30)).alias("moved"))


@query(r"""
WITH p AS (SELECT DISTINCT array_to_string(string_split(trim(text), ' ')[1:4], ' ') AS phrase FROM documents WHERE text IS NOT NULL AND len(string_split(trim(text), ' ')) >= 4)
SELECT phrase AS "text", count(*) AS documents FROM documents d JOIN p ON phrase <> '' AND CASE WHEN contains(d.text, phrase) THEN regexp_matches(d.text, (CASE WHEN regexp_matches(phrase, '^[\p{L}\p{N}_]') THEN '(?:^|[^\p{L}\p{N}_])' ELSE '' END) || regexp_escape(phrase) || (CASE WHEN regexp_matches(phrase, '[\p{L}\p{N}_]$') THEN '(?:$|[^\p{L}\p{N}_])' ELSE '' END)) ELSE false END
GROUP BY 1
""")
def phrase_documents(spark, sf):
    """In how many documents each document's first four words stand."""
    d = table(spark, sf, "documents")
    words = F.split(F.trim("text"), " ", -1)
    first = d.filter(F.size(words) >= 4).select(F.array_join(F.slice(words, 1, 4), " ").alias("phrase"))
    return P.phrase_matches(d, "doc_id", "text", P.phrase_table(first)).select("doc_id", "text").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("documents"))


@query("""
WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS four, lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') AS two FROM customer)
SELECT k AS c_custkey, 'mail <email> from <ipv4>, call <phone_number> or see <url> for ' || substring(sha256('s' || '123-' || two || '-' || four), 1, 9) || ' at <mac_address>' AS note,
 substring(sha256('s' || '9' || four), 1, 9) AS zipcode, substring(sha256('s' || 'u' || k || '@mail.example.net'), 1, 9) AS contact, 'row ' || k AS plain FROM c WHERE four <> '0000'
""")
def deidentified_labels(spark, sf):
    """Texts with six kinds of personal data, and columns that are one kind as a whole."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    four, two = F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k % 90 + 10).cast("string"), 2, "0")
    parts = ("mail u", k, "@example.org from 10.1.2.", k % 250, ", call 212-555-", four, " or see https://example.org/", k, " for 123-", two, "-", four, " at 00:1B:44:11:3A:", two)
    note = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = c.filter(four != "0000").select("c_custkey", note.alias("note"), F.concat(F.lit("9"), four).alias("zipcode"), F.concat(F.lit("u"), k, F.lit("@mail.example.net")).alias("contact"), F.concat(F.lit("row "), k).alias("plain"))
    return pii.deidentified(rows, ["note", "zipcode", "contact", "plain"], "s")[0]
