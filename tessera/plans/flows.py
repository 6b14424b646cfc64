"""Sources, sinks, streams and the whole report."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..errors import ParameterError
from ..operators import report as R
from ..sources import tables as S
from ..streaming import events as E
from .registry import query, table


def _folder(spark) -> str:
    """A folder that all executors share; only a local session may do without the setting that names it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ParameterError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/flows-{spark.sparkContext.applicationId}"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark, sf):
    path = f"{_folder(spark)}/supplier.csv"
    S.write_csv(table(spark, sf, "supplier"), path)
    return S.read(spark, path).select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"), F.col("s_acctbal").cast("double"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def jsonl_roundtrip(spark, sf):
    path = f"{_folder(spark)}/customer.jsonl"
    S.write_jsonl(table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), path)
    return S.read_any(spark, path).select("c_custkey", "segment")


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey + n_regionkey AS total, NULLIF(n_nationkey, 3) AS holes FROM nation")
def retyped_columns(spark, sf):
    n = table(spark, sf, "nation").withColumn("holes", F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")))
    back = S.retyped(n.select(*[F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey", "holes")]))
    return back.select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") + F.col("n_regionkey")).alias("total"), "holes")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    return E.windowed(table(spark, sf, "events"), "ts", "1 hour", "event_type", value="value").withColumn("total", F.round("total", 4))


@query("""
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '30 minutes' AS cut FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(cut, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, no
""")
def session_windows(spark, sf):
    return E.sessions(table(spark, sf, "events"), "ts", "30 minutes", "user_id").select("user_id", "session_start", "n")


@query()
def evaluation_report(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("key", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    scores = R.evaluate(x.filter("key % 3 = 0"), x.filter("key % 3 = 1"), "key", test=x.filter("key % 30 = 2"), personal=("l_extendedprice",))
    return spark.createDataFrame([(s.component, s.raw, s.score, s.grade) for s in scores], "component string, raw double, score double, grade string")
