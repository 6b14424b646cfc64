"""Ordered records: elapsed time, intervals, cascades of errors, packing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..errors import DataError
from ..functions.dates import inferred_format, to_seconds
from .ordered import numbered, running_sum, sort_value

#: Seconds by which steps may differ and still be one interval.
TOLERANCE = 0.1


def elapsed(df: DataFrame, group: str, order: str, interval: int) -> DataFrame:
    return df.withColumn("elapsed", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) * interval)


def intervals(df: DataFrame, group: str, seconds: str) -> DataFrame:
    """group, n, first, last, low, high, consistent, interval of the steps between neighbouring rows."""
    step = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(group).orderBy(seconds))
    out = df.withColumn("_step", step).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.min("_step").alias("low"), F.max("_step").alias("high"), F.min_by("_step", F.when(F.col("_step").isNotNull(), F.col(seconds))).alias("_first_step"))
    same = F.coalesce(F.col("high") - F.col("low") < TOLERANCE, F.lit(False))
    return out.withColumn("consistent", same).withColumn("interval", F.when(same, F.bround("_first_step"))).drop("_first_step")


def common_interval(groups: DataFrame) -> int | None:
    """The interval that all consistent groups share, else None."""
    row = groups.filter("consistent").agg(F.min("interval"), F.max("interval")).first()
    return int(row[0]) if row[0] is not None and row[0] == row[1] else None


def same_ends(groups: DataFrame) -> Column:
    return (F.countDistinct("first") <= 1) & (F.countDistinct("last") <= 1)


def cascade(df: DataFrame, group: str, order: str, seconds: str, interval: int, time_only: bool = False) -> DataFrame:
    """absolute (a day is added at each step back of a time-only format), error and valid.

    A step other than the interval makes a record invalid, and every later one of its group with it.
    """
    by = Window.partitionBy(group).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    if time_only:
        back = F.when(F.col(seconds) <= F.lag(seconds).over(by), 1).otherwise(0)
        df = df.withColumn("_back", back).withColumn("absolute", F.col(seconds) + 86400 * F.sum("_back").over(upto)).drop("_back")
    else:
        df = df.withColumn("absolute", F.col(seconds))
    bad = F.coalesce(F.col("absolute") - F.lag("absolute").over(by) != interval, F.lit(False)) | F.col("absolute").isNull()
    df = df.withColumn("_bad", bad).withColumn("_before", F.coalesce(F.max("_bad").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    error = F.when(F.col("_before"), "after an invalid record").when(F.col("_bad"), "interval")
    return df.withColumn("error", error).withColumn("valid", error.isNull()).drop("_bad", "_before")


def unordered_groups(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, ordered: whether a value never goes back along the order."""
    back = F.lag(value).over(Window.partitionBy(group).orderBy(order)) > F.col(value)
    return df.withColumn("_back", F.coalesce(back, F.lit(False))).groupBy(group).agg((~F.bool_or("_back")).alias("ordered"))


def first_records(df: DataFrame, group: str, order: str, record: str, n: int = 3) -> DataFrame:
    """group, prefill: the first n records, each with a blank before it, a line each."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = df.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(record).alias("r")))), lambda x: F.concat(F.lit(" "), x["r"]))
    return few.groupBy(group).agg(F.array_join(lines, "\n").alias("prefill"))


def last_records(record: str, group: str, order: str, n: int = 3) -> Column:
    """The n records up to each one, as a window of context."""
    return F.collect_list(record).over(Window.partitionBy(group).orderBy(order).rowsBetween(1 - n, 0))


def greedy_packed(df: DataFrame, shard: str | None, order: str, tokens: str, budget: int, most: int = 10, shard_rows: int = 100_000) -> DataFrame:
    """Every column of df and example_no: records in order, flushed before the budget or the number is passed.

    With a shard column, examples never mix its values (a group's records).  Without one, the table is packed in ranges
    of the order of about shard_rows rows, each with a last example that may be short.  A record above the
    budget is alone.  example_no counts from 0 in a shard; rows pass in order, and all that a task holds of them is a batch.
    """
    name = shard or "_shard"
    if shard is None:
        n = max(1, -(-df.count() // shard_rows))
        rows = df.repartitionByRange(n, order).withColumn(name, F.spark_partition_id()).sortWithinPartitions(order)
    else:
        rows = df.repartition(shard).sortWithinPartitions(shard, order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, example, size, held = None, -1, 0, 0
        for batch in batches:
            numbers = []
            for key, n in zip(batch.column(name).to_pylist(), batch.column(tokens).to_pylist()):
                n = n or 0
                if example < 0 or key != at:
                    at, example, size, held = key, 0, 0, 0
                elif held == most or size + n > budget:
                    example, size, held = example + 1, 0, 0
                size, held = size + n, held + 1
                numbers.append(example)
            yield batch.append_column("example_no", pa.array(numbers, pa.int32()))

    out = rows.mapInArrow(place, StructType(list(rows.schema)).add("example_no", IntegerType()))
    return out if shard else out.withColumnRenamed(name, "shard_no")


def packed_groups(df: DataFrame, group: str, order: str, tokens: str, budget: int, most: int = 10) -> DataFrame:
    """group, records, tokens, shard_no, example_no: whole groups packed as greedy_packed() packs records, in order of the group."""
    records = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t")))), lambda r: r["o"])
    groups = df.groupBy(group).agg(records.alias("records"), F.sum(tokens).alias(tokens))
    return greedy_packed(groups, None, group, tokens, budget, most)


def patience_reached(batches: DataFrame, order: str, invalid: str, threshold: float = 0.8, patience: int = 3) -> DataFrame:
    """running_mean, run (consecutive batches from the threshold on) and stop, per batch; nulls do not count in the mean.

    Rates, their mean and the threshold are whole billionths, halves up, so that neither depends on the order of a sum.
    Sums and places come from ranges of the order, so no task sees all batches; a run's length is its distance from the
    last batch below the threshold.
    """
    sort = sort_value(batches, order)
    units = batches.withColumn("_units", F.floor(F.col(invalid).cast("double") * 1e9 + 0.5).cast("long"))
    here, known = F.coalesce(F.col("_units"), F.lit(0)), F.col("_units").isNotNull().cast("long")
    b = running_sum(units, [], here, [order], sort, "_sum")
    b = numbered(running_sum(b, [], known, [order], sort, "_n"), [], [order], sort, "_no")
    b = b.withColumns({"_sum": F.col("_sum") + here, "_n": F.nullif(F.col("_n") + known, F.lit(0))})
    b = b.withColumn("running_mean", F.expr("(2 * _sum + _n) div (2 * _n)") / 1e9)
    b = b.withColumn("_bad", F.coalesce(F.col("_sum") >= F.lit(math.floor(threshold * 1e9 + 0.5)) * F.col("_n"), F.lit(False)))
    b = running_sum(b, [], (~F.col("_bad")).cast("long"), [order], sort, "_good").withColumn("_island", F.col("_good") + (~F.col("_bad")).cast("long"))
    starts = b.groupBy("_island").agg(F.min("_no").alias("_first"))
    run = F.col("_no") - F.col("_first") + F.when(F.col("_island") == 0, 1).otherwise(0)
    return b.join(starts, "_island").withColumn("run", run).withColumn("stop", F.col("run") >= patience).select(*batches.columns, "running_mean", "run", "stop")


def row_index(df: DataFrame, group: str, order: str) -> DataFrame:
    """row_index, from 0 in each group: where it goes back, a group has begun anew."""
    return df.withColumn("row_index", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def expected_records(start: Column, stop: Column, interval: int) -> Column:
    """How many records a group has from start to stop."""
    return F.floor((stop - start) / interval) + 1


def continues(records: DataFrame, last: DataFrame, group: str, seconds: str, interval: int) -> DataFrame:
    """group, chronological: whether a group's records go on right behind its last timestamp (a group without one may begin anywhere)."""
    steps = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(group).orderBy(seconds))
    per = records.withColumn("_step", steps).groupBy(group).agg(F.min(seconds).alias("_first"), F.coalesce(F.bool_and(F.col("_step") == interval), F.lit(True)).alias("_even"))
    ends = last.select(group, F.col(seconds).alias("_last"))
    goes_on = F.coalesce(F.col("_first") - F.col("_last") == interval, F.lit(True))
    return per.join(ends, group, "left").select(group, (F.col("_even") & goes_on).alias("chronological"))


def best_response(df: DataFrame, group: str, valid: str, order: str) -> DataFrame:
    """Of each group the response with the most valid records, the first of equals."""
    by = Window.partitionBy(group).orderBy(F.desc(valid), order)
    return df.withColumn("_no", F.row_number().over(by)).filter("_no = 1").drop("_no")


def checked_interval(groups: DataFrame, given: float | None = None) -> tuple[int | None, int]:
    """The interval and how many groups have steps off it; of the rows of intervals(), the one given or the one that all agree on."""
    interval = given if given is not None else common_interval(groups)
    if interval is None:
        return None, 0
    off = (F.abs(F.col("low") - interval) > TOLERANCE) | (F.abs(F.col("high") - interval) > TOLERANCE)
    return interval, groups.filter("n > 1").filter(off).count()


def preprocessed(df: DataFrame, timestamp: str | None = None, group: str | None = None, order: str | None = None, interval: int | None = None) -> tuple[DataFrame, dict]:
    """A time series with group, timestamp as seconds, and the facts about it.

    Without a group all rows are one; without a timestamp rows get elapsed seconds by order and interval.  Facts:
    format, interval, groups, consistent, off_interval, same_ends.  A null group or a timestamp of another format is an error.
    """
    name = group or "sequence_id"
    rows = df if group else df.withColumn(name, F.lit(0))
    if not rows.filter(F.col(name).isNull()).isEmpty():
        raise DataError(f"{name} has nulls")
    if timestamp is None:
        if interval is None or order is None:
            raise DataError("a series without timestamps needs an order and an interval")
        timestamp, fmt = "elapsed", "elapsed_seconds"
        rows = elapsed(rows, name, order, interval)
        seconds = F.col("elapsed")
    else:
        kind = dict(rows.dtypes)[timestamp]
        fmt = "elapsed_seconds" if kind in ("int", "bigint", "double", "float") else inferred_format(rows, timestamp)
        if fmt is None:
            raise DataError(f"no date format fits {timestamp}")
        seconds = F.col(timestamp).cast("long") if kind in ("int", "bigint", "double", "float") else to_seconds(F.col(timestamp), fmt)
    rows = rows.withColumn("seconds", seconds)
    if not rows.filter(F.col(timestamp).isNotNull() & F.col("seconds").isNull()).isEmpty():
        raise DataError(f"a value of {timestamp} has not the format {fmt}")
    groups = intervals(rows, name, "seconds")
    found, off = checked_interval(groups, interval)
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if("consistent").alias("consistent"), same_ends(groups).alias("same_ends")).first()
    return rows, {"format": fmt, "interval": found, "groups": total["groups"], "consistent": total["consistent"], "off_interval": off, "same_ends": total["same_ends"]}
