"""Association between columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import correlation as C
from .registry import query, table


@query("""
SELECT * FROM (VALUES ('l_quantity', 'l_extendedprice'), ('l_quantity', 'l_discount'), ('l_discount', 'l_tax')) t(x, y),
LATERAL (SELECT round(CASE x || y WHEN 'l_quantityl_extendedprice' THEN (SELECT corr(l_quantity, l_extendedprice) FROM lineitem)
  WHEN 'l_quantityl_discount' THEN (SELECT corr(l_quantity, l_discount) FROM lineitem) ELSE (SELECT corr(l_discount, l_tax) FROM lineitem) END, 6) AS r)
""")
def pearson_matrix(spark, sf):
    pairs = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_discount", "l_tax")]
    return C.pearson(table(spark, sf, "lineitem"), pairs).withColumn("r", F.round("r", 6))


@query("""
WITH c AS (SELECT 'l_returnflag' AS x, l_returnflag AS a, l_extendedprice AS b FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, l_extendedprice FROM lineitem),
g AS (SELECT x, a, count(*) AS n, avg(b) AS m, avg(b * b) - avg(b) * avg(b) AS v FROM c GROUP BY ALL),
t AS (SELECT x, sum(n * m) / sum(n) AS mm FROM g GROUP BY 1)
SELECT x, 'l_extendedprice' AS y, round(sqrt(sum(n * (m - mm) * (m - mm)) / (sum(n * (m - mm) * (m - mm)) + sum(n * v))), 5) AS eta FROM g JOIN t USING (x) GROUP BY 1
""")
def correlation_ratio(spark, sf):
    pairs = [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_extendedprice")]
    return C.correlation_ratio(table(spark, sf, "lineitem"), pairs).withColumn("eta", F.round("eta", 5))


_U = """
WITH j AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL), t AS (SELECT sum(n) AS n FROM j),
ha AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / (SELECT n FROM t) AS p FROM j GROUP BY a)),
hb AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / (SELECT n FROM t) AS p FROM j GROUP BY b)),
hab AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT n / (SELECT n FROM t) AS p FROM j))
SELECT '{a}' AS x, '{b}' AS y, round((ha.h + hb.h - hab.h) / ha.h, 6) AS u, round((ha.h + hb.h - hab.h) / hb.h, 6) AS u_back FROM ha, hb, hab
"""


@query(f"({_U.format(a='l_returnflag', b='l_linestatus', t='lineitem')}) UNION ALL ({_U.format(a='l_linenumber', b='l_returnflag', t='lineitem')})")
def theils_u_matrix(spark, sf):
    pairs = [("l_returnflag", "l_linestatus"), ("l_linenumber", "l_returnflag")]
    u = C.theils_u(table(spark, sf, "lineitem"), pairs)
    return u.select("x", "y", F.round("u", 6).alias("u"), F.round("u_back", 6).alias("u_back"))


_ETA = """(SELECT sqrt(sum(n * (m - mm) * (m - mm)) / (sum(n * (m - mm) * (m - mm)) + sum(n * v))) FROM
 (SELECT {a} AS a, count(*) AS n, avg({b}) AS m, var_pop({b}) AS v FROM lineitem WHERE l_orderkey % 2 = {k} GROUP BY 1), (SELECT avg({b}) AS mm FROM lineitem WHERE l_orderkey % 2 = {k}))"""


def _delta(a: str, b: str) -> str:
    return f"abs({_ETA.format(a=a, b=b, k=0)} - {_ETA.format(a=a, b=b, k=1)})"


_R = "(SELECT corr(l_quantity, l_extendedprice) FROM lineitem WHERE l_orderkey % 2 = {k})"


@query(f"""
WITH d AS (SELECT {_delta('l_returnflag', 'l_quantity')} AS fq, {_delta('l_returnflag', 'l_extendedprice')} AS fp, abs({_R.format(k=0)} - {_R.format(k=1)}) AS qp),
e AS (SELECT (2 * fq + 2 * fp + 2 * qp) / 9 AS mae FROM d)
SELECT round(mae, 6) AS mae, CASE WHEN mae > 0.46 THEN 0.0 WHEN mae < 0.01 THEN 10.0 ELSE round(37.562 * mae * mae - 35.643 * mae + 10.056, 1) END AS score FROM e
""")
def mixed_correlation_mae(spark, sf):
    x = table(spark, sf, "lineitem")
    sides = [C.mixed_correlation(x.filter(f"l_orderkey % 2 = {k}"), ["l_returnflag"], ["l_quantity", "l_extendedprice"]) for k in (0, 1)]
    e = C.correlation_error(*sides)
    return e.select(F.round("mae", 6).alias("mae"), scoring.final_score(scoring.correlation_score(F.col("mae"))).alias("score"))


@query("""
WITH f AS (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), m AS (SELECT median(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END) AS m FROM customer)
SELECT c_custkey, coalesce(n, 0)::BIGINT AS segment_count, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, m) AS balance FROM customer LEFT JOIN f USING (c_mktsegment), m
""")
def count_encode_median_fill(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))
    encoded = C.count_encoded(c, c.filter("c_custkey % 2 = 0"), "c_mktsegment", "segment_count")
    return C.median_filled(encoded, ["balance"]).select("c_custkey", "segment_count", "balance")


@query("""
WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
SELECT "column", round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM c) GROUP BY 1
""")
def column_entropy(spark, sf):
    return C.entropy(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]).withColumn("entropy", F.round("entropy", 6))


@query("""
SELECT round((0.84 * s + 0.86 * d + c) / 2.7, 3) AS raw, round((0.84 * s + 0.86 * d + c) / 2.7, 1) AS score,
 CASE WHEN (0.84 * s + 0.86 * d + c) / 2.7 >= 8 THEN 'Excellent' WHEN (0.84 * s + 0.86 * d + c) / 2.7 >= 6 THEN 'Good' WHEN (0.84 * s + 0.86 * d + c) / 2.7 >= 4 THEN 'Moderate' WHEN (0.84 * s + 0.86 * d + c) / 2.7 >= 2 THEN 'Poor' ELSE 'Very Poor' END AS grade
FROM (VALUES (5.0::DOUBLE, 2.0::DOUBLE, 9.9::DOUBLE), (8.2, 7.1, 9.3), (1.1, 0.4, 2.2)) t(c, s, d)
""")
def quality_rollup(spark, sf):
    rows = spark.createDataFrame([(5.0, 2.0, 9.9), (8.2, 7.1, 9.3), (1.1, 0.4, 2.2)], "c double, s double, d double")
    raw = scoring.quality_score(F.col("c"), F.col("s"), F.col("d"))
    score = scoring.final_score(raw)
    return rows.select(raw.alias("raw"), score.alias("score"), scoring.grade(score).alias("grade"))
