"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _least(pairs: DataFrame) -> DataFrame:
    """u, v with m: the smallest of u and its v."""
    m = pairs.groupBy("u").agg(F.min("v").alias("_m"))
    return pairs.join(m, "u").select("u", "v", F.least("u", "_m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b, integers) -> node, component (its smallest node), for every node of a link."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, now = _counted(edges, "links")
    before = None
    while before != now and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large)
        stars = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before = now
        edges, now = _counted(stars.distinct(), "stars")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and the sum of their hashes, which are counted while they are written."""
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), name)
    return out, (seen.get["n"], seen.get["digest"])
