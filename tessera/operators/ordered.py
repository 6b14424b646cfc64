"""Ranks and running sums over whole tables without a task that sees a whole group.

Rows are dealt over buckets of neighbouring values whose bounds are one approximate aggregation; buckets are
added up first, and windows run inside buckets only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Most buckets; also how many bounds reach the driver.
BUCKETS = 1024


def sort_value(df: DataFrame, column: str) -> Column:
    """A number that never goes down where the column goes up; strings count by their first six bytes."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def bucketed(df: DataFrame, value: Column, out: str = "_bucket", buckets: int = BUCKETS) -> DataFrame:
    """Adds out: how many of the bounds are at most value, 0 for null; the bounds part the rows about evenly."""
    cuts = df.select(value.alias("v")).agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0]
    bounds = sorted(set(cuts or []))
    if not bounds:
        return df.withColumn(out, F.lit(0))
    table, n = F.array(*map(F.lit, bounds)), len(bounds)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    fits = lambda at, s: (at + s <= n) & (F.element_at(table, F.least(at + s, F.lit(n))) <= F.col(f"{out}_v"))
    found = df.withColumn(f"{out}_v", value)
    return found.withColumn(out, F.aggregate(halves, F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))).drop(f"{out}_v")


def running_sum(df: DataFrame, group: list[str], value: Column, order: list, sort: Column, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before, by order within group.

    sort is a number that never goes down along the order.
    """
    rows = bucketed(df.withColumn("_x", value), sort)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("_x").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    keys = [*group, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_in", F.coalesce(F.sum("_x").over(inside), F.lit(0)))
    named = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    joined = here.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_x", "_bucket", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, group: list[str], order: list, sort: Column, out: str) -> DataFrame:
    """Adds out: the row's number within group, from 0."""
    return running_sum(df, group, F.lit(1), order, sort, out)


def at_ranks(df: DataFrame, group: str | None, order: list[str], weight: str, ranks: DataFrame, sort: Column, ranges: bool = False) -> DataFrame:
    """ranks with order and _before: the row at each rank (from 0) of its group, and how many that are alike in order come before that rank.

    ranks: (group,) no, rank.  A row stands as many times as weight says.  sort never goes down along order; with ranges it is a whole
    number that names a row's range already.  Rows are counted by ranges, and only those of ranges with a wanted rank are put in order.
    """
    rows = df.withColumn("_bucket", sort) if ranges else bucketed(df, sort)
    by = [group] if group else []
    before = lambda *keys: Window.partitionBy(*keys)
    counts = rows.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_s"))
    counts = counts.withColumn("_base", F.coalesce(F.sum("_s").over(before(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each wanted rank
    inside = (F.col("rank") >= F.col("_base")) & (F.col("rank") < F.col("_base") + F.col("_s"))
    wanted = kept(counts.join(ranks, by).filter(inside) if by else counts.join(F.broadcast(ranks), inside), "wanted")
    found = rows.join(wanted.select(*by, "_bucket", "_base").distinct(), [*by, "_bucket"])
    found = found.groupBy(*by, "_bucket", "_base", *order).agg(F.sum(weight).alias("_here"))
    found = found.withColumn("_first", F.col("_base") + F.coalesce(F.sum("_here").over(before(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_here"))
    found = found.join(wanted.select(*by, "_bucket", "no", "rank"), [*by, "_bucket"]).filter(inside)
    return found.select(*by, "no", "rank", *order, (F.col("rank") - F.col("_first")).alias("_before"))
