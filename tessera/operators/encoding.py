"""Encodings before distances: quantiles, one-hot, ordinal bits; and what is derived from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .neighbors import ks_one_sided, nearest
from .ordered import numbered, running_sum, sort_value

#: Most landmarks of a quantile transform.
QUANTILES = 1000


def quantiles(df: DataFrame, column: str, landmarks: int) -> list[float]:
    """landmarks + 1 interpolated quantiles of a column; empty without values.

    Distinct values are counted and their ranks added up range by range; only the values next to a landmark are collected.
    """
    counts = kept(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c")), "counts")
    total = counts.agg(F.sum("c")).first()[0]
    if not total:
        return []
    rows = running_sum(counts, [], F.col("c"), ["v"], F.col("v"), "first")
    # the ranks that lie on either side of landmark i are floor and ceil of i (total - 1) / landmarks
    place = lambda r, up: (F.ceil if up else F.floor)(r * F.lit(float(landmarks)) / F.lit(float(max(total - 1, 1))))
    near = F.sequence(F.greatest(place(F.col("first") - 1, True), F.lit(0)), F.least(place(F.col("first") + F.col("c"), False), F.lit(landmarks)))
    found = rows.withColumn("i", F.explode(F.when(F.element_at(near, 1) <= F.element_at(near, -1), near))).select("i", "v", "first", "c").collect()
    low, high = {}, {}
    for r in found:
        at = r["i"] * (total - 1) / landmarks
        if r["first"] <= math.floor(at) < r["first"] + r["c"]:
            low[r["i"]] = r["v"]
        if r["first"] <= math.ceil(at) < r["first"] + r["c"]:
            high[r["i"]] = r["v"]
    part = [(i * (total - 1) / landmarks) % 1 for i in range(landmarks + 1)]
    return [low[i] + (high[i] - low[i]) * part[i] for i in range(landmarks + 1)]


def quantile_scaled(df: DataFrame, fit: DataFrame, column: str, out: str, landmarks: int = QUANTILES) -> DataFrame:
    """out: where a value lies in the fitted side's distribution, 0 to 1, by interpolation between landmarks.

    Landmarks are interpolated quantiles, exact: the values on both sides of each are found by their rank.
    """
    cuts = quantiles(fit, column, landmarks)
    if not cuts:
        return df.withColumn(out, F.lit(None).cast("double"))
    q, x, n = F.array(*map(F.lit, cuts)), F.col(column).cast("double"), len(cuts)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    at = F.aggregate(halves, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.element_at(q, F.least(a + s, F.lit(n))) <= x), a + s).otherwise(a))
    low, high = F.element_at(q, F.greatest(at, F.lit(1))), F.element_at(q, F.least(at + 1, F.lit(n)))
    inside = (at - 1 + F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))) / (n - 1)
    return df.withColumn(out, F.when(x.isNull(), None).when(at == 0, 0.0).when(at >= n, 1.0).otherwise(inside))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each stated value."""
    return df.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def ordinal_bits(df: DataFrame, column: str, order: str) -> DataFrame:
    """column_0 (lowest bit) and so on: the bits of a value's rank by first appearance, from 1."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    ranks = numbered(firsts, [], ["_first", column], sort_value(firsts, "_first"), "_rank").withColumn("_rank", F.col("_rank") + 1).drop("_first")
    bits = max(1, firsts.count().bit_length())
    joined = df.join(ranks, column, "left")
    return joined.withColumns({f"{column}_{i}": F.coalesce(F.shiftright("_rank", i).bitwiseAND(1), F.lit(0)) for i in range(bits)}).drop("_rank")


def semantic_similarity(train: DataFrame, output: DataFrame, test: DataFrame, key: str, vector: str) -> DataFrame:
    """overfit, underfit, score: how the nearest similarities to the output compare with those inside train and test."""
    def excess(real: DataFrame, side: str):
        # per output row its nearest real row; per real row its nearest other real row
        a = nearest(real, output, key, vector, 1, "cosine").select(F.col("similarity").alias("v"), F.lit(0).alias("side"))
        b = nearest(real, real, key, vector, 1, "cosine", skip_self=True).select(F.col("similarity").alias("v"), F.lit(1).alias("side"))
        return ks_one_sided(a.unionByName(b), "v", "side").select(F.col(side).alias(side))

    over, under = excess(train, "less"), excess(test, "greater")
    both = over.select(F.col("less").alias("overfit")).join(under.select(F.col("greater").alias("underfit")))
    return both.withColumn("score", 10 * F.exp(-F.col("overfit")) * F.exp(-F.col("underfit")))


def dataset_statistics(reference: DataFrame, output: DataFrame) -> DataFrame:
    """side, n_rows, n_columns, missing_percent."""
    from .distribution import missing

    parts = [missing(d).select(F.lit(s).alias("side"), F.try_divide(F.col("cells"), F.lit(len(d.columns))).cast("long").alias("n_rows"), F.lit(len(d.columns)).alias("n_columns"), F.round("percent", 6).alias("missing_percent")) for s, d in (("reference", reference), ("output", output))]
    return parts[0].unionByName(parts[1])
