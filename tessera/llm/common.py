"""What several operators share: the cluster's shared folder, even ordered buckets, and prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most bounds that ordered_bounds() brings to the driver, and of which its aggregation is accurate.
MAX_BOUNDS = 16384
#: The characters that separate words: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir.

    Only a local session, whose executors are threads of this process, may do without that setting.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tessera-")
        _OWN[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_texts(df: DataFrame) -> DataFrame:
    """df; its session sends rows with texts to Python in batches of 1,000, where it had Spark's 10,000."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_bounds(df: DataFrame, key: str, per_bucket: int) -> list[int]:
    """Ascending values of an integer column that cut it into buckets of about per_bucket rows, none of them empty.

    One aggregation over all rows; at most MAX_BOUNDS values reach the driver.
    """
    parts = [i / MAX_BOUNDS for i in range(1, MAX_BOUNDS)]
    n, least, cuts = df.agg(F.count(key), F.min(key), F.percentile_approx(key, parts, 20 * MAX_BOUNDS)).first()
    if not n or not cuts:
        return []
    step = max(1, -(-MAX_BOUNDS * per_bucket // n))
    return sorted({c for c in cuts[step - 1 :: step] if c > least})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most key (0 for a null key): a binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    table, n = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.element_at(table, F.least(at + s, F.lit(n))) <= key), at + s).otherwise(at))


def ordered_rows(df: DataFrame, order: list[str], rows_per_bucket: int = 500_000) -> DataFrame:
    """df and row_no, unique, and bucket: rows of one bucket are all before those of the next in (order, row_no).

    Buckets are Spark's range partitions, as many as the table's size asks for; row_no also parts equal rows, so
    that no value, null included, makes a bucket large.  The result has to be written before it is used twice.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_bucket))
    rows = df.withColumn("row_no", F.monotonically_increasing_id())
    return rows.repartitionByRange(n, *order, "row_no").withColumn("bucket", F.spark_partition_id())


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores behind it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: inside, it is a lambda's variable that the optimizer cannot copy."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before, within group, by bucket and then order.

    Two levels, so no task sees a whole group: sums of buckets are added up first, rows only within a bucket.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, [*group, bucket]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")
