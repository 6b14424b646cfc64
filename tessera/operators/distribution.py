"""Distributions of two sides of a table, and the distance between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import long_form

#: Distance when a side has no values, and the most bins of a histogram.
EMPTY_SIDE, MOST_BINS = 0.5887, 500


def _doane(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, width, bins of each column, from one pass over the rows."""
    facts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.skewness(c).alias("g"), F.stddev_pop(c).alias("sd")) for c in columns]
    s = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    spread = F.sqrt(6.0 * (F.col("n") - 2) / ((F.col("n") + 1.0) * (F.col("n") + 3.0)))
    parts = 1 + F.log2(F.col("n")) + F.log2(1 + F.abs("g") / spread)
    width = F.when((F.col("n") > 2) & (F.col("sd") > 0), (F.col("high") - F.col("low")) / parts).otherwise(0.0)
    bins = F.when(width > 0, F.ceil((F.col("high") - F.col("low")) / width)).otherwise(1).cast("int")
    bins = F.when((bins <= 0) | (bins >= MOST_BINS), MOST_BINS).otherwise(bins)
    flat = F.col("low") == F.col("high")
    low = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    return s.select("column", low.alias("low"), high.alias("high"), bins.alias("bins")).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))


def doane_bins(df: DataFrame, column: str) -> DataFrame:
    """low, high, width, bins of one column: Doane's rule over all rows; one bin for a constant."""
    return _doane(df, [column]).drop("column")


def bucket(x: Column, low: Column, width: Column, bins: Column) -> Column:
    """Right-closed bins numbered from 1; the least value is in the first."""
    return F.least(F.greatest(F.ceil((x - low) / width), F.lit(1)), bins).cast("int")


def histogram(df: DataFrame, column: str, side: str) -> DataFrame:
    """side, bucket, n: counts of both sides over common bins.  The bins are one row, so it is broadcast."""
    bins = F.broadcast(doane_bins(df, column))
    x = df.filter(F.col(column).isNotNull()).select(F.col(side).alias("side"), F.col(column).cast("double").alias("x")).join(bins)
    return x.groupBy("side", bucket(F.col("x"), F.col("low"), F.col("width"), F.col("bins")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """column, side, bucket, n: histogram() of each column, the bins of all from one pass.  One row a column reaches the driver."""
    bins = {r["column"]: r for r in _doane(df, columns).collect()}
    parts = []
    for c in columns:
        at = bucket(F.col(c).cast("double"), *[F.lit(bins[c][k]) for k in ("low", "width", "bins")])
        parts.append(df.filter(F.col(c).isNotNull()).groupBy(F.lit(c).alias("column"), F.col(side).alias("side"), at.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def categorical_distribution(df: DataFrame, columns: list[str], side: str | None = None) -> DataFrame:
    """column, (side,) value, n, percent; missing is a value of its own, 'nan'."""
    extra = [] if side is None else [side]
    cells = df.select(*extra, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in columns])))
    counts = cells.groupBy("column", *extra, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column", *extra).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals) if side is None else totals, ["column", *extra]).withColumn("percent", 100 * F.col("n") / F.col("total")).drop("total")


def js_distance(counts: DataFrame, by: list[str], key: str, side: str = "side", weight: str = "n") -> DataFrame:
    """by, distance: Jensen-Shannon distance to base 2 between side 0 and side 1; a side without weight gives EMPTY_SIDE."""
    sums = counts.groupBy(*by, key).agg(*[F.coalesce(F.sum(F.when(F.col(side) == k, F.col(weight))), F.lit(0)).cast("double").alias(f"w{k}") for k in (0, 1)])
    totals = sums.groupBy(*by).agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))
    p, q = F.col("w0") / F.nullif(F.col("t0"), F.lit(0.0)), F.col("w1") / F.nullif(F.col("t1"), F.lit(0.0))
    m = (p + q) / 2
    term = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    joined = sums.join(totals, by)
    out = joined.groupBy(*by).agg(F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.sum(term(p) + term(q)).alias("d"))
    distance = F.when((F.col("t0") == 0) | (F.col("t1") == 0), EMPTY_SIDE).otherwise(F.sqrt(F.greatest(F.col("d") / 2, F.lit(0.0))))
    return out.select(*by, distance.alias("distance"))


def mean_divergence(distances: DataFrame) -> DataFrame:
    """Sum of the distances that exist over the number of all fields."""
    return distances.agg((F.coalesce(F.sum("distance"), F.lit(0.0)) / F.count(F.lit(1))).alias("divergence"))


def missing(df: DataFrame) -> DataFrame:
    """cells, missing, percent over the whole table."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    out = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("cells"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing"))
    return out.withColumn("percent", F.coalesce(100 * F.try_divide(F.col("missing"), F.col("cells")), F.lit(0.0)))


def running_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, m2, sd, low, high; the deviation of at most one value is 0."""
    facts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("m2"), F.coalesce(F.when(F.count(c) > 1, F.stddev_samp(c)), F.lit(0.0)).alias("sd"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")) for c in columns]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


__all__ = ["bucket", "categorical_distribution", "doane_bins", "histogram", "histograms", "js_distance", "long_form", "mean_divergence", "missing", "running_statistics"]
