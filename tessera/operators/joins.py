"""Joins between a reference table and an output table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def shared_columns(reference: DataFrame, output: DataFrame) -> list[str]:
    common = [c for c in reference.columns if c in set(output.columns)]
    if not common:
        raise ValueError("the tables have no column in common")
    return common


def memorized_rows(reference: DataFrame, output: DataFrame) -> DataFrame:
    """Distinct rows that both tables have, over their common columns; nulls equal nulls."""
    common = shared_columns(reference, output)
    return reference.select(common).intersect(output.select(common))


def replayed(output: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """rows, distinct_values, replayed_rows, replayed_values, percent: output values that are among the detected ones."""
    known = values.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").distinct().withColumn("_known", F.lit(1))
    marked = output.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("n")).join(known, "_v", "left")
    out = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("n"))), F.lit(0)).alias("replayed_rows"), F.count("_known").alias("replayed_values"))
    known_count = known.agg(F.count(F.lit(1)).alias("known_values"))
    percent = F.coalesce(F.ceil(100 * F.try_divide(F.col("replayed_values"), F.col("known_values"))), F.lit(0)).cast("int")
    return out.join(F.broadcast(known_count)).withColumn("percent", percent)


def duplicate_pairs(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """pairs: equal values of two tables with their multiplicities, without making the pairs."""
    count = lambda df, n: df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(n))
    return count(left, "a").join(count(right, "b"), column).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("values"))


def without_known(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch that the accumulated rows don't have, null-safe over the common columns."""
    return batch.join(known, _same(batch, known, shared_columns(batch, known)), "left_anti")
