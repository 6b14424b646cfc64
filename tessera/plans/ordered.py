"""Time series and other ordered records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeseries as W
from .registry import query, table


@query("""
WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 60 AS el FROM events),
d AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS step FROM e)
SELECT user_id, count(*) AS n, min(s) AS first, max(s) AS last, min(step) AS low, max(step) AS high, max(el)::BIGINT AS elapsed, coalesce(max(step) - min(step) < 0.1, false) AS consistent FROM d GROUP BY 1
""")
def elapsed_and_interval(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"))
    el = W.elapsed(e, "user_id", "event_id", 60).groupBy("user_id").agg(F.max("elapsed").cast("long").alias("elapsed"))
    return W.intervals(e, "user_id", "s").join(el, "user_id").drop("interval")


@query("""
WITH h AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS s FROM events GROUP BY ALL),
b AS (SELECT *, coalesce(s - lag(s) OVER w <> 3600, false) AS bad FROM h WINDOW w AS (PARTITION BY user_id ORDER BY s)),
c AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM b)
SELECT user_id, count(*) FILTER (NOT bad AND NOT earlier) AS valid, count(*) FILTER (bad AND NOT earlier) AS interval_errors, count(*) FILTER (earlier) AS after_errors FROM c GROUP BY 1
""")
def interval_violations_cascade(spark, sf):
    h = table(spark, sf, "events").select("user_id", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("s")).distinct()
    c = W.cascade(h, "user_id", "s", "s", 3600)
    return c.groupBy("user_id").agg(F.count_if("valid").alias("valid"), F.count_if(F.col("error") == "interval").alias("interval_errors"), F.count_if(F.col("error") == "after an invalid record").alias("after_errors"))


@query("""
SELECT conv_id, NOT bool_or(coalesce(back, false)) AS ordered FROM (SELECT conv_id, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) > length(text) AS back FROM conversations) GROUP BY 1
""")
def order_check(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    return W.unordered_groups(c, "conv_id", "turn", "n")


@query("""
SELECT conv_id, string_agg(' ' || role, chr(10) ORDER BY turn) AS prefill FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3 GROUP BY 1
""")
def prefill_first3(spark, sf):
    return W.first_records(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, turn, k, 0 AS example_no, n AS size, 1 AS held FROM c WHERE k = 1
 UNION ALL SELECT c.conv_id, c.turn, c.k, CASE WHEN p.held = 4 OR p.size + c.n > 600 THEN p.example_no + 1 ELSE p.example_no END,
   CASE WHEN p.held = 4 OR p.size + c.n > 600 THEN c.n ELSE p.size + c.n END, CASE WHEN p.held = 4 OR p.size + c.n > 600 THEN 1 ELSE p.held + 1 END
 FROM p JOIN c ON c.conv_id = p.conv_id AND c.k = p.k + 1)
SELECT conv_id, turn, example_no FROM p
""")
def pack_greedy(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return W.greedy_packed(c, "conv_id", "turn", "n", 600, 4).select("conv_id", "turn", "example_no")


@query("""
WITH RECURSIVE g AS (SELECT conv_id, sum(length(text))::BIGINT AS n, count(*) AS rows, row_number() OVER (ORDER BY conv_id) AS k FROM conversations GROUP BY 1),
p AS (SELECT conv_id, rows, k, 0 AS example_no, n AS size, 1 AS held FROM g WHERE k = 1
 UNION ALL SELECT g.conv_id, g.rows, g.k, CASE WHEN p.held = 3 OR p.size + g.n > 1500 THEN p.example_no + 1 ELSE p.example_no END,
   CASE WHEN p.held = 3 OR p.size + g.n > 1500 THEN g.n ELSE p.size + g.n END, CASE WHEN p.held = 3 OR p.size + g.n > 1500 THEN 1 ELSE p.held + 1 END
 FROM p JOIN g ON g.k = p.k + 1)
SELECT conv_id, rows, example_no FROM p
""")
def pack_groups(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return W.packed_groups(c, "conv_id", "turn", "n", 1500, 3).select("conv_id", F.size("records").cast("long").alias("rows"), "example_no")


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_index, (20 - turn) // 3 + 1 AS expected FROM conversations
""")
def rows_expected(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return W.row_index(c, "conv_id", "turn").select("conv_id", "turn", "row_index", W.expected_records(F.col("turn"), F.lit(20), 3).alias("expected"))


@query("""
SELECT conv_id, arg_max(turn, length(text) * 1000000 - turn) AS turn FROM conversations GROUP BY 1
""")
def best_response_per_group(spark, sf):
    c = table(spark, sf, "conversations").withColumn("valid", F.length("text"))
    return W.best_response(c, "conv_id", "valid", "turn").select("conv_id", "turn")


@query("""
WITH h AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS s, event_id % 2 AS late FROM events GROUP BY ALL), r AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS step FROM h WHERE late = 1),
l AS (SELECT user_id, max(s) AS last FROM h WHERE late = 0 AND user_id % 3 <> 0 GROUP BY 1)
SELECT user_id, coalesce(bool_and(step = 3600), true) AND coalesce(min(s) - any_value(last) = 3600, true) AS chronological FROM r LEFT JOIN l USING (user_id) GROUP BY 1
""")
def chronological_groups(spark, sf):
    h = table(spark, sf, "events").select("user_id", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("s"), (F.col("event_id") % 2).alias("late")).distinct()
    last = h.filter("late = 0 AND user_id % 3 <> 0").groupBy("user_id").agg(F.max("s").alias("s"))
    return W.continues(h.filter("late = 1"), last, "user_id", "s", 3600)


@query("""
SELECT 'yyyy-MM-dd HH:mm:ss' AS format, 1800 AS interval, count(DISTINCT user_id) AS groups, count(DISTINCT user_id) AS consistent, 0 AS off_interval, count(*) AS n,
 sum(epoch(TIMESTAMP '2024-01-01') + 1800 * k)::BIGINT AS seconds FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 1)
""")
def time_series_preprocessed(spark, sf):
    by = Window.partitionBy("user_id")
    e = table(spark, sf, "events").withColumns({"k": F.row_number().over(by.orderBy("event_id")) - 1, "n": F.count(F.lit(1)).over(by)}).filter("n > 1")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows, facts = W.preprocessed(e.select("user_id", F.date_format(F.timestamp_seconds(start + 1800 * F.col("k")), "yyyy-MM-dd HH:mm:ss").alias("t")), "t", "user_id")
    named = [F.lit(facts[k]).alias(k) for k in ("format", "interval", "groups", "consistent", "off_interval")]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select(*named, "n", "seconds")


# rates, their running sums and the threshold are whole billionths, so no sum depends on its order
_BATCHES = "SELECT CAST(floor(event_id / 500) AS BIGINT) AS batch, CAST(floor(avg(CASE WHEN event_type IN ('error', 'click') THEN 1.0 ELSE 0.0 END) * 1e9 + 0.5) AS BIGINT) AS invalid FROM events GROUP BY 1"


@query(f"""
WITH b AS ({_BATCHES}), s AS (SELECT batch, sum(invalid) OVER (ORDER BY batch) AS s, count(*) OVER (ORDER BY batch) AS n FROM b),
m AS (SELECT batch, (2 * s + n) // (2 * n) AS running_mean, s >= 400000000 * n AS bad FROM s), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (ORDER BY batch) AS island FROM m)
SELECT batch, ((running_mean + 500) // 1000) / 1e6 AS running_mean, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY batch)::BIGINT AS run,
 sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY batch) >= 3 AS stop FROM i
""")
def stop_condition_scan(spark, sf):
    e = table(spark, sf, "events")
    b = e.groupBy(F.floor(F.col("event_id") / 500).alias("batch")).agg(F.avg(F.when(F.col("event_type").isin("error", "click"), 1.0).otherwise(0.0)).alias("invalid"))
    return W.patience_reached(b, "batch", "invalid", 0.4, 3).select("batch", F.round("running_mean", 6).alias("running_mean"), "run", "stop")
