"""Stand-ins, encodings and statistics of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import people as Q
from ..functions import text as X
from ..operators import encoding as E
from .registry import query, table


def _number(*parts: str) -> str:
    """SQL for text.key_number() of SQL texts."""
    return f"CAST('0x' || substring(md5(concat_ws(chr(31), {', '.join(parts)})), 1, 15) AS BIGINT)"


def _picked(items: list[str], *parts: str) -> str:
    listed = ", ".join(f"'{i}'" for i in items)
    return f"[{listed}][{_number(*parts)} % {len(items)} + 1]"


def _digits(pattern: str, *parts: str) -> str:
    one = lambda i, c: f"CAST({_number(repr(str(i)), *parts)} % 10 AS VARCHAR)" if c == "#" else f"'{c}'"
    return " || ".join(one(i, c) for i, c in enumerate(pattern))


_PERSON = f"""SELECT c_custkey, {_number("'7'", "'gender'", "k")} % 2 = 0 AS f, {_picked(Q.FEMALE, "'7'", "'first'", "k")} AS a, {_picked(Q.MALE, "'7'", "'first'", "k")} AS b,
 {_picked(Q.LAST, "'7'", "'last'", "k")} AS last_name, {_picked(Q.DOMAINS["all_persons"], "'7'", "'domain'", "k")} AS d FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)"""


@query(f"""WITH p AS ({_PERSON}), n AS (SELECT *, CASE WHEN f THEN a ELSE b END AS first_name FROM p)
SELECT c_custkey, CASE WHEN f THEN 'female' ELSE 'male' END AS gender, first_name, last_name, first_name || ' ' || last_name AS name, lower(first_name || '.' || last_name || '@' || d) AS email FROM n""")
def persona_consistency(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", Q.persona(F.col("c_custkey"), 7).alias("p")).select("c_custkey", "p.gender", "p.first_name", "p.last_name", "p.name", "p.email")


@query(f"""SELECT c_custkey, {_digits("###-###-####", "'tel'", "c_name")} AS phone, '9' || {_digits("##-7#-####", "'itin'", "c_name")} AS itin,
 CAST({_number("'no'", "c_name")} % 900 + 1 AS VARCHAR) || ' ' || {_picked(Q.STREETS, "'street'", "c_name")} AS street FROM customer""")
def fake_formats(spark, sf):
    key = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", Q.fake("phone_number", key).alias("phone"), Q.fake("itin", key).alias("itin"), Q.fake("street_address", key).alias("street"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_ ]', '', 'g') AS plain FROM documents
""")
def ascii_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalized(F.col("text"), " ").alias("plain"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '.uk' WHEN 1 THEN '.fr' WHEN 2 THEN '.ru' END AS tld FROM nation")
def country_domains(spark, sf):
    name = F.element_at(F.array(F.lit("UK"), F.lit("France"), F.lit("Russia"), F.lit("nowhere")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", X.top_level_domain(Q.country_code(name)).alias("tld"))


@query("""
WITH q AS (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, round(CASE WHEN x <= q[1] THEN 0 WHEN x >= q[5] THEN 1 WHEN x >= q[4] THEN 0.75 + 0.25 * (x - q[4]) / (q[5] - q[4]) WHEN x >= q[3] THEN 0.5 + 0.25 * (x - q[3]) / (q[4] - q[3])
  WHEN x >= q[2] THEN 0.25 + 0.25 * (x - q[2]) / (q[3] - q[2]) ELSE 0.25 * (x - q[1]) / (q[2] - q[1]) END, 6) AS scaled FROM (SELECT c_custkey, c_acctbal AS x FROM customer), q
""")
def quantile_scaled(spark, sf):
    c = table(spark, sf, "customer")
    return E.quantile_scaled(c, c.filter("c_custkey % 2 = 0"), "c_acctbal", "scaled", 4).select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_f, CAST(o_orderstatus = 'O' AS INT) AS is_o FROM orders""")
def one_hot_status(spark, sf):
    o = E.one_hot(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])
    return o.select("o_orderkey", F.col("`o_orderstatus=F`").alias("is_f"), F.col("`o_orderstatus=O`").alias("is_o"))


@query("""
WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey), p_brand) AS k FROM part GROUP BY 1)
SELECT p_partkey, list_aggregate(list_transform(range(len(bin((SELECT count(*) FROM r)))), lambda i: ((k >> i) & 1)::VARCHAR), 'string_agg', '') AS bits FROM part JOIN r USING (p_brand)
""")
def binary_encoding(spark, sf):
    p = E.ordinal_bits(table(spark, sf, "part"), "p_brand", "p_partkey")
    bits = sorted((c for c in p.columns if c.startswith("p_brand_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    return p.select("p_partkey", F.concat(*[F.col(c).cast("string") for c in bits]).alias("bits"))


@query("""
SELECT 'reference' AS side, count(*) AS n_rows, 2 AS n_columns, 0.0 AS missing_percent FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'output', count(*), 2, round(100 * count(*) FILTER (c_custkey % 7 = 0) / (2 * count(*)), 6) FROM customer WHERE c_custkey % 2 = 1
""")
def dataset_statistics(spark, sf):
    c = table(spark, sf, "customer")
    return E.dataset_statistics(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_acctbal"), c.filter("c_custkey % 2 = 1").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal")))


@query("""
WITH e AS (SELECT vec_id, vec_id % 3 AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.s AS qs, b.s AS bs, a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE (a.s, b.s) IN ((1, 0), (0, 0), (1, 2), (2, 2)) GROUP BY ALL),
o AS (SELECT round(c, 6) AS v, count(*) FILTER (qs = 1) AS n0, count(*) FILTER (qs = 0) AS n1 FROM d WHERE bs = 0 GROUP BY 1), u AS (SELECT round(c, 6) AS v, count(*) FILTER (qs = 1) AS n0, count(*) FILTER (qs = 2) AS n1 FROM d WHERE bs = 2 GROUP BY 1),
fo AS (SELECT max(f1 - f0) AS d FROM (SELECT sum(n0) OVER (ORDER BY v) / (SELECT sum(n0) FROM o) AS f0, sum(n1) OVER (ORDER BY v) / (SELECT sum(n1) FROM o) AS f1 FROM o)),
fu AS (SELECT max(f0 - f1) AS d FROM (SELECT sum(n0) OVER (ORDER BY v) / (SELECT sum(n0) FROM u) AS f0, sum(n1) OVER (ORDER BY v) / (SELECT sum(n1) FROM u) AS f1 FROM u))
SELECT round(greatest(fo.d, 0), 4) AS overfit, round(greatest(fu.d, 0), 4) AS underfit, round(10 * exp(-greatest(fo.d, 0)) * exp(-greatest(fu.d, 0)), 3) AS score FROM fo, fu
""")
def text_semantic_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    train, output, test = (e.filter(f"vec_id % 3 = {k}") for k in (0, 1, 2))
    s = E.semantic_similarity(train, output, test, "vec_id", "embedding")
    return s.select(F.round("overfit", 4).alias("overfit"), F.round("underfit", 4).alias("underfit"), F.round("score", 3).alias("score"))
