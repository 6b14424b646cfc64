"""Splits, memorised rows, replay and duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import columns as K
from ..operators import joins as J
from ..operators import split as S
from ..operators import timeseries as W
from .registry import query, table


@query("SELECT o_orderkey % 20 = 0 AS held_out, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def holdout_by_key(spark, sf):
    o = table(spark, sf, "orders")
    chosen = o.filter(F.col("o_orderkey") % 20 == 0).select("o_orderkey")
    train, test = o.join(chosen, "o_orderkey", "left_anti"), o.join(chosen, "o_orderkey", "left_semi")
    both = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    return both.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT least(2000, CAST(floor(count(*) * 0.05) AS BIGINT)) AS test_rows, count(*) - least(2000, CAST(floor(count(*) * 0.05) AS BIGINT)) AS train_rows FROM orders")
def holdout_policy(spark, sf):
    train, test = S.holdout(table(spark, sf, "orders"), "o_orderkey")
    return test.agg(F.count(F.lit(1)).alias("test_rows")).join(train.agg(F.count(F.lit(1)).alias("train_rows")))


@query("SELECT 0 AS groups_on_both_sides, count(*) AS n, count(DISTINCT l_orderkey) AS groups FROM lineitem")
def group_holdout(spark, sf):
    train, test = S.split_groups(table(spark, sf, "lineitem"), 0.05, "l_orderkey")
    both = train.select("l_orderkey", F.lit(0).alias("side")).unionByName(test.select("l_orderkey", F.lit(1).alias("side")))
    per = both.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("most"), F.min("side").alias("least"))
    return per.agg(F.count_if(F.col("most") > F.col("least")).cast("int").alias("groups_on_both_sides"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


@query("""
SELECT count(*) AS memorized FROM (
  SELECT l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 2 = 0
  INTERSECT SELECT l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 2 = 1)
""")
def memorized_rows(spark, sf):
    x = table(spark, sf, "lineitem")
    columns = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    reference, output = x.filter("l_orderkey % 2 = 0").select(columns), x.filter("l_orderkey % 2 = 1").select(columns)
    return J.memorized_rows(reference, output).agg(F.count(F.lit(1)).alias("memorized"))


@query("""
WITH k AS (SELECT DISTINCT c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_acctbal AS v FROM customer WHERE c_custkey % 2 = 1)
SELECT count(*) AS rows, count(DISTINCT o.v) AS distinct_values, count(k.v) AS replayed_rows, count(DISTINCT k.v) AS replayed_values, (SELECT count(*) FROM k) AS known_values,
       CAST(ceil(100 * count(DISTINCT k.v) / (SELECT count(*) FROM k)) AS INT) AS percent FROM o LEFT JOIN k ON o.v = k.v
""")
def pii_replay_counts(spark, sf):
    c = table(spark, sf, "customer")
    return J.replayed(c.filter("c_custkey % 2 = 1"), c.filter("c_custkey % 2 = 0"), "c_acctbal")


@query("""
SELECT coalesce(sum(a * b), 0)::BIGINT AS pairs, count(*) AS "values" FROM
 (SELECT text, count(*) AS a FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) JOIN (SELECT text, count(*) AS b FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) USING (text)
""")
def text_duplicate_pairs(spark, sf):
    d = table(spark, sf, "documents")
    return J.duplicate_pairs(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "text")


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 2 = 0 AND r.text = d.text AND r.lang = d.lang)")
def anti_duplicates(spark, sf):
    d = table(spark, sf, "documents")
    known = d.filter("doc_id % 2 = 0").select("text", "lang")
    return J.without_known(d.filter("doc_id % 2 = 1").select("doc_id", "text", "lang"), known).select("doc_id")


@query("""
SELECT l_orderkey, n, rows_before FROM (
  SELECT l_orderkey, n, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rows_before
  FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) WHERE rows_before < 500
""")
def cumulative_groups_to_target(spark, sf):
    return S.cumulative_groups(table(spark, sf, "lineitem"), "l_orderkey", 500)


@query("SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def entity_mapping(spark, sf):
    e = S.entity_rows(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return e.select("o_custkey", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("orders"))


@query("""
SELECT c AS copy_no, count(*) AS n, count(DISTINCT s_suppkey) AS keys, CAST(sum(s_suppkey) AS BIGINT) AS key_sum, count(*) * (count(*) - 1) // 2 AS position_sum FROM supplier, (VALUES (0), (1)) v(c) GROUP BY 1
UNION ALL SELECT 2, CAST(ceil(0.5 * count(*)) AS BIGINT), CAST(ceil(0.5 * count(*)) AS BIGINT), NULL, CAST(ceil(0.5 * count(*)) AS BIGINT) * (CAST(ceil(0.5 * count(*)) AS BIGINT) - 1) // 2 FROM supplier
""")
def repeated_rows(spark, sf):
    r = S.repeated(table(spark, sf, "supplier"), 2.5, "s_suppkey")
    key_sum = F.when(F.col("copy_no") < 2, F.sum(F.col("s_suppkey").cast("long")))
    return r.groupBy("copy_no").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_suppkey").alias("keys"), key_sum.alias("key_sum"), F.sum("position").alias("position_sum"))


@query("""
WITH r AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey * 7919 % 10007, c_custkey) - 1 AS no, count(*) OVER () AS n FROM customer)
SELECT d AS draw, c_custkey, c_name FROM range(500) t(d) JOIN r ON no = (d * d * 31 + 7 * d) % n
""")
def drawn_with_replacement(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return S.with_replacement(c, 500, "c_custkey", order=F.col("c_custkey") * 7919 % 10007, number=F.col("draw") * F.col("draw") * 31 + F.col("draw") * 7)


@query("""
WITH e AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT count(*) // 32 AS whole FROM e),
s AS (SELECT p, o_custkey, (row_number() OVER (PARTITION BY p ORDER BY (o_custkey * 7919 + p * 613) % 10007, o_custkey) - 1) // 32 AS b FROM e, range(3) t(p)),
d AS (SELECT p * whole + b AS step, o_custkey FROM s, n WHERE b < whole), t AS (SELECT step, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY step) - 1 AS turn FROM d),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT step, t.o_custkey, o_orderkey FROM t JOIN r ON r.o_custkey = t.o_custkey AND r.at = turn % r.n
""")
def drawn_records(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    steps = S.shuffled_batches(o.select("o_custkey").distinct(), "o_custkey", 32, 3, order=(F.col("o_custkey") * 7919 + F.col("pass") * 613) % 10007)
    return S.drawn_rows(steps, o, "o_custkey", "o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'dear' WHEN o_orderpriority = '1-URGENT' THEN 'hasty' END AS reject_reason, NOT (o_totalprice > 300000 OR o_orderpriority = '1-URGENT') AS is_valid FROM orders
""")
def verdicts_on_records(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    verdicts = o.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "dear").when(F.col("o_orderpriority") == "1-URGENT", "hasty").alias("reject_reason"))
    return K.with_verdicts(o, verdicts, "o_orderkey").select("o_orderkey", "reject_reason", "is_valid")


@query("""
SELECT conv_id, count(*) AS n_rows, string_agg(array_to_string(string_split(role || ' ' || turn, ' '), '+'), '+' ORDER BY turn) AS words FROM conversations GROUP BY 1
""")
def grouped_token_arrays(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.concat_ws(" ", "role", "turn"), " ").alias("ids"))
    return K.grouped_arrays(c, "conv_id", "turn", "ids").select("conv_id", "n_rows", F.array_join("ids", "+").alias("words"))


@query("""
WITH c AS (SELECT label, i, avg(CAST(embedding AS DOUBLE[])[i]) AS x FROM embeddings, unnest(range(1, 65)) r(i) GROUP BY 1, 2)
SELECT label, round(sum(x), 5) AS total, round(sum(x * i), 4) AS weighted, count(*)::INT AS dims FROM c GROUP BY 1
""")
def mean_embeddings(spark, sf):
    m = K.mean_vectors(table(spark, sf, "embeddings").select("label", F.col("embedding")), ["label"], "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("label", F.round(total, 5).alias("total"), F.round(weighted, 4).alias("weighted"), F.size("embedding").alias("dims"))


@query("SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'more' END AS c FROM orders")
def merged_settings(spark, sf):
    o = table(spark, sf, "orders")
    base = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderpriority"))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("more"))).otherwise(F.create_map().cast("map<string,string>"))
    both = o.select("o_orderkey", K.merged_maps(base, new).alias("m"))
    return both.select("o_orderkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'null' END AS kind FROM events
""")
def json_types(spark, sf):
    texts = F.array(F.lit('{"k": 1}'), F.lit("-2.5e1"), F.lit('"x"'), F.lit("true"), F.lit("null"), F.lit("{no"))
    return table(spark, sf, "events").select("event_id", K.json_type(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


@query("""
WITH u AS (SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier)
SELECT side, count(*) AS n, count(DISTINCT nation) AS nations, count(segment) AS segments, (SELECT count(*) FROM (SELECT DISTINCT nation, segment FROM u)) AS pairs FROM u GROUP BY 1
""")
def stacked_tables(spark, sf):
    """Tables of different columns by name, missing ones null, and their distinct rows."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    u = c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)
    pairs = u.select("nation", "segment").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    return u.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nation").alias("nations"), F.count("segment").alias("segments")).join(pairs)


@query("""
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders ORDER BY place LIMIT 50
""")
def sorted_head(spark, sf):
    """The first rows by several keys, the row's own key settling ties."""
    top = table(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50)
    by = Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return top.select("o_orderkey", "o_custkey", "o_orderpriority", F.row_number().over(by).alias("place"))


@query("""
SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '>') AS context FROM conversations
""")
def sliding_context(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(W.last_records("role", "conv_id", "turn"), ">").alias("context"))
