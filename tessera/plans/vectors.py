"""Vectors, attacks, components, and text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as X
from ..operators import components as PC
from ..operators import distribution as D
from ..operators import neighbors as N
from ..operators import privacy as V
from ..operators import report as R
from .registry import query, table


@query("""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0), b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 0),
r AS (SELECT q.vec_id AS query_id, b.vec_id AS "key", list_distance(q.v, b.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) AS rank FROM q, b)
SELECT query_id, CAST(rank AS INT) AS rank, "key", round(d, 4) AS distance FROM r WHERE rank <= 5
""")
def knn_l2(spark, sf):
    e = table(spark, sf, "embeddings")
    return N.nearest(e.filter("vec_id % 10 <> 0"), e.filter("vec_id % 10 = 0"), "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 4))


@query("""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0), b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT q.vec_id AS query_id, b.vec_id AS "key", list_cosine_similarity(q.v, b.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, b.v) DESC, b.vec_id) AS rank FROM q, b WHERE q.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, "key", round(d, 4) AS similarity FROM r WHERE rank <= 3
""")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return N.nearest(e, e.filter("vec_id % 10 = 0"), "vec_id", "embedding", 3, "cosine", skip_self=True).withColumn("similarity", F.round("similarity", 4))


@query("""
WITH c AS (SELECT o_totalprice AS v, count(*) FILTER (o_orderkey % 2 = 0) AS n0, count(*) FILTER (o_orderkey % 2 = 1) AS n1 FROM orders GROUP BY 1),
f AS (SELECT sum(n0) OVER (ORDER BY v) / (SELECT sum(n0) FROM c) AS f0, sum(n1) OVER (ORDER BY v) / (SELECT sum(n1) FROM c) AS f1 FROM c)
SELECT round(greatest(max(f1 - f0), 0), 6) AS less, round(greatest(max(f0 - f1), 0), 6) AS greater FROM f
""")
def ks_one_sided(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderkey") % 2).alias("side"))
    k = N.ks_one_sided(o, "o_totalprice", "side")
    return k.select(F.round("less", 6).alias("less"), F.round("greater", 6).alias("greater"))


@query("""
WITH a AS (SELECT vec_id, vec_id % 3 = 0 AS member, vec_id % 5 AS run, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0), s AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT vec_id, any_value(member) AS member, any_value(run) AS run, round(min(list_distance(a.v, s.v)), 4) AS d FROM a, s GROUP BY 1),
n AS (SELECT run, member, d / max(d) OVER (PARTITION BY run) AS d, row_number() OVER (PARTITION BY run ORDER BY vec_id) AS no, count(*) OVER (PARTITION BY run) AS n FROM d),
g AS (SELECT run, t AS threshold, s AS share, count(*) FILTER (d < t AND member) AS tp, count(*) FILTER (d < t AND NOT member) AS fp, count(*) FILTER (d >= t AND NOT member) AS tn, count(*) AS n
      FROM n, (VALUES (0.9::DOUBLE), (0.8)) x(t), (VALUES (0.5::DOUBLE), (1.0)) y(s) WHERE no <= floor(s * n) GROUP BY ALL)
SELECT run, threshold, share, tp, fp, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 1) AS "precision", round_even((tp + tn) / n, 1) AS accuracy FROM g
""")
def membership_attack_grid(spark, sf):
    e = table(spark, sf, "embeddings")
    near = N.nearest(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0"), "vec_id", "embedding", 1)
    rows = near.select((F.col("query_id") % 5).alias("run"), (F.col("query_id") % 3 == 0).alias("member"), F.round("distance", 4).alias("d"), "query_id")
    return N.membership_attacks(rows, "run", F.col("query_id"), "member", "d", (0.9, 0.8), (0.5, 1.0)).drop("grade")


@query("""
WITH a AS (SELECT vec_id, vec_id % 3 = 0 AS member, vec_id % 10 AS run, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0), s AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT vec_id, any_value(member) AS member, any_value(run) AS run, round(min(list_distance(a.v, s.v)), 4) AS d FROM a, s GROUP BY 1),
n AS (SELECT run, member, d / max(d) OVER (PARTITION BY run) AS d, row_number() OVER (PARTITION BY run ORDER BY vec_id) AS no, count(*) OVER (PARTITION BY run) AS n FROM d),
g AS (SELECT run, t, s, count(*) FILTER (d < t AND member) AS tp, count(*) FILTER (d < t AND NOT member) AS fp, count(*) FILTER (d >= t AND NOT member) AS tn, count(*) AS n
      FROM n, (VALUES (0.4::DOUBLE), (0.3), (0.2), (0.1)) x(t), (SELECT k / 10 AS s FROM range(2, 11) r(k)) WHERE no <= floor(s * n) GROUP BY ALL),
r AS (SELECT round_even(coalesce(tp / nullif(tp + fp, 0), 0), 1) AS p, round_even((tp + tn) / n, 1) AS a FROM g),
k AS (SELECT CASE WHEN greatest(p, a) <= 0.5 THEN 3.0 WHEN least(p, a) <= 0.5 AND greatest(p, a) <= 0.8 THEN 2.5 WHEN greatest(p, a) <= 0.8 THEN 2.0 WHEN least(p, a) <= 0.8 THEN 1.5 ELSE 1.0 END::DOUBLE AS grade FROM r)
SELECT round_even(avg(grade), 2) AS mean, round_even((round_even(avg(grade), 2) - 1) / 2 * 10, 1) AS score FROM k
""")
def membership_attack_score(spark, sf):
    e = table(spark, sf, "embeddings")
    near = N.nearest(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0"), "vec_id", "embedding", 1)
    rows = near.select((F.col("query_id") % 10).alias("run"), (F.col("query_id") % 3 == 0).alias("member"), F.round("distance", 4).alias("distance"), "query_id")
    return N.attack_score(N.membership_attacks(rows, "run", F.col("query_id"), "member", "distance"))


@query("""
WITH x AS (SELECT o_orderkey AS k, o_orderkey % 100 = 0 AS attacked, CAST(o_custkey AS DOUBLE) AS c, o_totalprice AS t, o_orderpriority AS p FROM orders),
f AS (SELECT avg(c) AS cm, stddev_pop(c) AS cs, avg(t) AS tm, stddev_pop(t) AS ts FROM x WHERE NOT attacked),
z AS (SELECT k, attacked, p, CAST(CAST((c - cm) / cs AS FLOAT) AS DOUBLE) AS c, CAST(CAST((t - tm) / ts AS FLOAT) AS DOUBLE) AS t FROM x, f),
n AS (SELECT a.k, o.p, row_number() OVER (PARTITION BY a.k ORDER BY pow(a.c - o.c, 2) + pow(a.t - o.t, 2), o.k) AS r FROM z a JOIN z o ON a.attacked AND NOT o.attacked),
m AS (SELECT k, p AS guess, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, p) AS r FROM n WHERE r <= 5 GROUP BY k, p)
SELECT x.k AS o_orderkey, x.p AS truth, guess, guess = x.p AS correct FROM m JOIN x USING (k) WHERE r = 1
""")
def attribute_inference(spark, sf):
    x = table(spark, sf, "orders")
    rows = x.select("o_orderkey", F.col("o_custkey").cast("double").alias("c"), "o_totalprice", "o_orderpriority")
    attacked = rows.filter("o_orderkey % 100 = 0")
    return N.attribute_inference(attacked, rows.filter("o_orderkey % 100 <> 0"), "o_orderkey", ["c", "o_totalprice"], "o_orderpriority")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query()
def membership_inference_end_to_end(spark, sf):
    o = _orders(spark, sf)
    attacks, score = V.membership_inference(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), o.filter("o_orderkey % 40 = 4"), "o_orderkey", ["o_totalprice", "o_orderstatus", "o_orderpriority"])
    return attacks.groupBy("threshold", "share").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("grade"), 3).alias("grade")).join(score)


@query()
def attribute_inference_end_to_end(spark, sf):
    o = _orders(spark, sf)
    guesses, score = V.attribute_inference(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_orderkey", ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"], 2)
    return guesses.join(score.select("score"))


@query("""
WITH t(c) AS (VALUES ('c_acctbal'), ('c_mktsegment')), v AS (SELECT c, c_custkey % 2 AS side, CASE c WHEN 'c_acctbal' THEN CAST(c_acctbal AS VARCHAR) ELSE c_mktsegment END AS v FROM customer, t),
k AS (SELECT DISTINCT c, v FROM v WHERE side = 0)
SELECT v.c AS "column", count(*) AS rows, count(DISTINCT v.v) AS distinct_values, count(k.v) AS replayed_rows, count(DISTINCT k.v) AS replayed_values, (SELECT count(*) FROM k k2 WHERE k2.c = v.c) AS known_values,
  CAST(ceil(100 * count(DISTINCT k.v) / (SELECT count(*) FROM k k2 WHERE k2.c = v.c)) AS INT) AS percent FROM v LEFT JOIN k ON k.c = v.c AND k.v = v.v WHERE side = 1 GROUP BY v.c
""")
def personal_replay(spark, sf):
    c = table(spark, sf, "customer")
    return V.replay(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1"), ["c_acctbal", "c_mktsegment"])


@query("""
WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_pop(l_quantity) AS va, var_pop(l_extendedprice) AS vb, corr(l_quantity, l_extendedprice) AS r FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT 1 AS component, round(1 + abs(r), 5) AS variance FROM m UNION ALL SELECT 2, round(1 - abs(r), 5) FROM m
""")
def pca_variances(spark, sf):
    fit = PC.principal_components(table(spark, sf, "lineitem").filter("l_orderkey % 2 = 0"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(i + 1, round(float(v), 5)) for i, v in enumerate(fit["variance"])], "component int, variance double")


@query()
def structure_stability(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("side", (F.col("l_orderkey") % 2).cast("int"))
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    points = PC.projected(x, PC.principal_components(x.filter("side = 0"), columns), ["side"])
    parts = [D.histogram(points, c, "side").withColumn("column", F.lit(c)) for c in ("pc1", "pc2")]
    d = D.mean_divergence(D.js_distance(parts[0].unionByName(parts[1]), ["column"], "bucket"))
    return d.select(F.round("divergence", 6).alias("divergence"), scoring.final_score(scoring.structure_score(F.col("divergence"))).alias("score"))


@query("""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?。！？؟।]+'), lambda s: trim(s, ' ') <> ''))::INT AS sentences, len(string_split(text, ' '))::INT AS blanks_and_one FROM documents
""")
def text_structure(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.sentence_count(F.col("text")).alias("sentences"), F.size(F.split("text", " ")).alias("blanks_and_one"))


def _bins_sql(column: str) -> str:
    """Buckets of a column by the rule of doane_histogram, both sides over the same bins."""
    return f"""SELECT '{column}' AS "column", side, least(greatest(ceil((x - low) / width), 1), bins) AS v FROM (SELECT side, {column} AS x FROM d) t, (
 SELECT low, (high - low) / bins AS width, bins FROM (SELECT min(low) AS low, max(high) AS high, CAST(ceil(1 + log2(max(n)) + log2(1 + abs(sum(pow(x - m, 3)) / max(n) / pow(sum(pow(x - m, 2)) / max(n), 1.5)) / sqrt(6.0 * (max(n) - 2) / ((max(n) + 1.0) * (max(n) + 3.0))))) AS INT) AS bins
  FROM (SELECT {column} AS x FROM d) y, (SELECT count({column}) AS n, min({column}) AS low, max({column}) AS high, avg({column}) AS m FROM d) z WHERE x IS NOT NULL)) WHERE x IS NOT NULL"""


@query(f"""
WITH e AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?。！？؟।]+'), lambda s: trim(s, ' ') <> ''))::DOUBLE AS sentences, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+') AS w FROM documents),
d AS (SELECT doc_id % 2 AS side, sentences, len(w) / greatest(1, sentences) AS words, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) END AS characters FROM e),
c AS (SELECT "column", v, count(*) FILTER (side = 0) AS w0, count(*) FILTER (side = 1) AS w1 FROM ({_bins_sql("sentences")} UNION ALL {_bins_sql("words")} UNION ALL {_bins_sql("characters")}) GROUP BY 1, 2),
p AS (SELECT "column", w0 / sum(w0) OVER (PARTITION BY "column") AS p, w1 / sum(w1) OVER (PARTITION BY "column") AS q FROM c),
j AS (SELECT sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS d FROM p GROUP BY "column"), m AS (SELECT avg(d) AS d FROM j)
SELECT round(d, 6) AS divergence, round_even(CASE WHEN d > 0.8 THEN 1.5 WHEN d < 0.12 THEN 10.0 ELSE -12.5 * d + 11.5 END, 1) AS score FROM m
""")
def text_structure_similarity(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 2).cast("int").alias("side"), "text")
    j = D.mean_divergence(R.text_structure_distances(d, ["text"], "side"))
    return j.select(F.round("divergence", 6).alias("divergence"), scoring.final_score(scoring.text_js_score(F.col("divergence"))).alias("score"))


@query("""
SELECT c_custkey, sha256('7' || c_name) AS hashed, left(c_mktsegment, 1) || 'XXX' || right(c_mktsegment, 2) AS masked FROM customer
""")
def hash_mask(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.salted_hash(F.col("c_name"), "7").alias("hashed"), X.partial_mask(F.col("c_mktsegment"), 1, "XXX", 2).alias("masked"))


@query("""
WITH x AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(c, 6) AS cosine FROM x
""")
def cosine_of_neighbors(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
