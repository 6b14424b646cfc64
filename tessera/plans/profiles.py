"""Profiles, schemas and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import distribution as D
from ..operators import profile as P
from .registry import query, table

_LADDER = """CASE WHEN n = 0 THEN 'empty' WHEN n_distinct = 2 THEN 'binary' WHEN kind = 'float' THEN 'numeric'
 WHEN kind = 'integer' THEN CASE WHEN n_distinct <= 10 AND low >= 0 THEN 'categorical' ELSE 'numeric' END
 WHEN (n - n_distinct) / n >= 0.9 OR ((n - n_distinct) / n >= 0.7 AND n <= 50) THEN 'categorical'
 WHEN blanks > 2 THEN 'text' ELSE 'other' END"""


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    part = "SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS n_rows, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, {low} AS low, {blanks} AS blanks FROM {t}"
    rows = [part.format(c=c, k=k, t=name, low=f"min(CAST({c} AS DOUBLE))" if k != "other" else "CAST(NULL AS DOUBLE)", blanks=f"avg(length({c}) - length(replace({c}, ' ', '')))" if k == "other" else "CAST(NULL AS DOUBLE)") for c, k in columns.items()]
    return f'WITH f AS ({" UNION ALL ".join(rows)}) SELECT "column", n_rows, n_rows - n AS n_missing, n_distinct, {_LADDER} AS field_type FROM f'


@query(_profile_sql("customer", {"c_custkey": "integer", "c_name": "other", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "other"}))
def profile_columns(spark, sf):
    return P.profile(table(spark, sf, "customer")).select("column", "n_rows", "n_missing", "n_distinct", "field_type")


@query(_profile_sql("documents", {"doc_id": "integer", "text": "other", "lang": "other", "source": "other", "n_chars": "integer"}))
def profile_documents(spark, sf):
    return P.profile(table(spark, sf, "documents")).select("column", "n_rows", "n_missing", "n_distinct", "field_type")


@query("""
SELECT CASE WHEN v = 0 THEN 1.0 WHEN v > 0 THEN pow(10, floor(log10(v))) WHEN pow(10, floor(log10(-v))) = -v THEN v ELSE -10 * pow(10, floor(log10(-v))) END AS magnitude,
       count(*) AS n
FROM (SELECT p_retailprice AS v FROM part UNION ALL SELECT o_totalprice FROM orders UNION ALL SELECT c_acctbal FROM customer) GROUP BY 1
""")
def profile_numeric_magnitude(spark, sf):
    parts = [table(spark, sf, t).select(F.col(c).alias("v")) for t, c in (("part", "p_retailprice"), ("orders", "o_totalprice"), ("customer", "c_acctbal"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(P.floor_power_of_10(F.col("v")).alias("magnitude")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT length(CASE WHEN f = '0' THEN '' ELSE f END) AS digits, count(*) AS n
FROM (SELECT regexp_extract(CAST(l_discount AS VARCHAR), '\\.(\\d+)', 1) AS f FROM lineitem) GROUP BY 1
""")
def decimal_precision(spark, sf):
    return table(spark, sf, "lineitem").groupBy(P.decimals(F.col("l_discount")).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def _enum_sql(name: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {name}" for c in columns)
    return f"""WITH c AS (SELECT "column", v, count(*) AS n FROM ({cells}) GROUP BY ALL)
SELECT "column", count(*) AS n_distinct, count(*) FILTER (n = 1) AS n_singletons, count(*) <= sqrt(sum(n)) AND count(*) FILTER (n = 1) <= pow(sum(n), 1 / 3) AS is_enum FROM c GROUP BY 1"""


@query(_enum_sql("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def infer_enum_columns(spark, sf):
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return P.enum_columns(table(spark, sf, "orders"), columns).select("column", "n_distinct", "n_singletons", "is_enum")


def _schema_sql(column: str, kind: str, t: str = "part", value: str = "") -> str:
    """A column's row of infer_json_schema: enum by the two bounds, else bounds of numbers or of lengths."""
    value = value or column
    counts = f"SELECT count(*) AS d, count(*) FILTER (n = 1) AS ones, sum(n) AS rows, bool_or(v IS NULL) AS nulls, min(v) AS lo, max(v) AS hi FROM (SELECT {value} AS v, count(*) AS n FROM {t} GROUP BY 1)"
    low, high = ("round_even(min(length({v})) / 1.5, 0)", "round_even(max(length({v})) * 1.5, 0)") if kind == "string" else ("min({v})", "max({v})")
    bounds = f"SELECT CAST({low.format(v=value)} AS DOUBLE) AS low, CAST({high.format(v=value)} AS DOUBLE) AS high FROM {t}"
    is_enum = "d <= sqrt(rows) AND ones <= pow(rows, CAST(1 AS DOUBLE) / 3)"
    return f"""SELECT '{column}' AS "column", CASE WHEN {is_enum} THEN 'enum' ELSE '{kind}' END AS kind, NOT nulls AS required, CASE WHEN NOT ({is_enum}) THEN low END AS low, CASE WHEN NOT ({is_enum}) THEN high END AS high
 FROM ({counts}), ({bounds})"""


@query(" UNION ALL ".join([_schema_sql("p_brand", "string"), _schema_sql("p_name", "string"), _schema_sql("p_retailprice", "number"), _schema_sql("p_partkey", "integer"), _schema_sql("p_type", "string", value="CASE WHEN p_partkey % 3 <> 0 THEN p_type END")]))
def infer_json_schema(spark, sf):
    part = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    schema = P.json_schema(part.select("p_brand", "p_name", "p_retailprice", "p_partkey", "p_type"))

    def row(c: str, p: dict) -> tuple:
        if "enum" in p:
            return c, "enum", c in schema["required"], None, None
        kind = p["type"][0] if isinstance(p["type"], list) else p["type"]
        low, high = ("minLength", "maxLength") if kind == "string" else ("minimum", "maximum")
        return c, kind, c in schema["required"], float(p[low]), float(p[high])

    return spark.createDataFrame([row(c, p) for c, p in schema["properties"].items()], "column string, kind string, required boolean, low double, high double")


@query("""
SELECT count(*) * 3 AS cells, sum((c_custkey IS NULL)::INT + (c_acctbal IS NULL)::INT + (o_orderkey IS NULL)::INT)::BIGINT AS missing,
       round(100 * sum((c_custkey IS NULL)::INT + (c_acctbal IS NULL)::INT + (o_orderkey IS NULL)::INT) / (count(*) * 3), 6) AS percent
FROM (SELECT c_custkey, nullif(c_acctbal, round(c_acctbal)) AS c_acctbal, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
""")
def missing_percent(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    joined = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.nullif("c_acctbal", F.round("c_acctbal")).alias("c_acctbal"), "o_orderkey")
    return D.missing(joined).withColumn("percent", F.round("percent", 6))


@query("""
SELECT c AS "column", v AS "value", n, round(100 * n / sum(n) OVER (PARTITION BY c), 6) AS percent FROM (
  SELECT 'event_type' AS c, coalesce(event_type, 'nan') AS v, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'bucket', coalesce(CAST(CASE WHEN user_id % 7 <> 0 THEN user_id % 5 END AS VARCHAR), 'nan'), count(*) FROM events GROUP BY 2)
""")
def categorical_distribution(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 5).alias("bucket"))
    return D.categorical_distribution(e, ["event_type", "bucket"]).withColumn("percent", F.round("percent", 6))


_DOANE = """
WITH s AS (SELECT count(x) AS n, min(x) AS low, max(x) AS high, avg(x) AS m FROM t),
k AS (SELECT any_value(n) AS n, any_value(low) AS low, any_value(high) AS high, sum(pow(x - m, 3)) / count(*) / pow(sum(pow(x - m, 2)) / count(*), 1.5) AS g FROM t, s),
w AS (SELECT low, high, CAST(ceil(1 + log2(n) + log2(1 + abs(g) / sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3.0))))) AS INT) AS bins FROM k),
b AS (SELECT low, (high - low) / bins AS width, bins FROM w)
"""


@query(f"""
WITH t AS (SELECT l_extendedprice AS x, CAST(l_orderkey % 2 AS INT) AS side FROM lineitem), {_DOANE.strip()[5:]}
SELECT side, CAST(least(greatest(ceil((x - low) / width), 1), bins) AS INT) AS bucket, count(*) AS n FROM t, b GROUP BY 1, 2
""")
def doane_histogram(spark, sf):
    x = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_orderkey") % 2).cast("int").alias("side"))
    return D.histogram(x, "l_extendedprice", "side")


def _js_sql(cells: str) -> str:
    return f"""
WITH c AS (SELECT "column", v, count(*) FILTER (side = 0) AS w0, count(*) FILTER (side = 1) AS w1 FROM ({cells}) GROUP BY 1, 2),
p AS (SELECT "column", w0 / sum(w0) OVER (PARTITION BY "column") AS p, w1 / sum(w1) OVER (PARTITION BY "column") AS q FROM c),
d AS (SELECT "column", sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS d FROM p GROUP BY 1)
"""


_SIDES = """SELECT 'event_type' AS "column", event_type AS v, event_id % 2 AS side FROM events
 UNION ALL SELECT 'status', o_orderstatus, o_orderkey % 2 FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_orderkey % 2 FROM orders"""


def _sides(spark, sf):
    e = table(spark, sf, "events").select(F.lit("event_type").alias("column"), F.col("event_type").alias("value"), (F.col("event_id") % 2).alias("side"))
    o = table(spark, sf, "orders").select(F.inline(F.array(F.struct(F.lit("status").alias("column"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 2).alias("side")), F.struct(F.lit("priority").alias("column"), F.col("o_orderpriority").alias("value"), (F.col("o_orderkey") % 2).alias("side")))))
    return e.unionByName(o).groupBy("column", "value", "side").agg(F.count(F.lit(1)).alias("n"))


@query(_js_sql(_SIDES) + 'SELECT "column", round(d, 6) AS distance, CASE WHEN d > 0.99 THEN 0.0 WHEN d < 0.02 THEN 10.0 ELSE round(7.44 * d * d - 16.646 * d + 10.305, 6) END AS score FROM d')
def js_distance_by_column(spark, sf):
    d = D.js_distance(_sides(spark, sf), ["column"], "value")
    return d.select("column", F.round("distance", 6).alias("distance"), F.round(scoring.tabular_js_score(F.col("distance")), 6).alias("score"))


@query(_js_sql(_SIDES) + ", m AS (SELECT sum(d) / count(*) AS d FROM d) SELECT round(d, 6) AS divergence, round(CASE WHEN d > 0.99 THEN 0.0 WHEN d < 0.02 THEN 10.0 ELSE 7.44 * d * d - 16.646 * d + 10.305 END, 1) AS score FROM m")
def distribution_stability(spark, sf):
    m = D.mean_divergence(D.js_distance(_sides(spark, sf), ["column"], "value"))
    return m.select(F.round("divergence", 6).alias("divergence"), scoring.final_score(scoring.tabular_js_score(F.col("divergence"))).alias("score"))


@query("""
SELECT 'l_quantity' AS "column", count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), min(l_tax), max(l_tax) FROM lineitem
""")
def welford_stats(spark, sf):
    r = D.running_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    return r.select("column", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", "high")
