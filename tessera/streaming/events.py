"""Windows, running statistics, cross-batch duplicates, and strict cadence over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, length: str, *keys: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """window_start, keys, n (and total): tumbling or sliding windows; rows later than ``late`` are left out."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    facts = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(*facts).select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, ts: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n: rows less than the gap apart are one session."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_statistics(stream: DataFrame, column: str, *keys: str) -> DataFrame:
    """n, mean, sd, low, high so far (complete output)."""
    c = F.col(column)
    return stream.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"))


def fresh_rows(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows whose keys did not occur within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def cadence(stream: DataFrame, group: str, seconds: str, interval: int) -> DataFrame:
    """group, seconds, valid: per group, each record exactly one interval after the one before; a failure lasts.

    Late or disordered records are errors, not dropped.  State per group: the last time, and whether it failed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, failed = state.get if state.exists else (None, False)
        for pdf in batches:
            valid = []
            for s in pdf[seconds].tolist():
                failed = bool(failed or (last is not None and s - last != interval))
                last = int(s)
                valid.append(not failed)
            yield pd.DataFrame({group: pdf[group], seconds: pdf[seconds], "valid": valid})
        state.update((last, failed))

    kind = dict(stream.dtypes)
    return stream.select(group, seconds).groupBy(group).applyInPandasWithState(step, f"{group} {kind[group]}, {seconds} {kind[seconds]}, valid boolean", "last long, failed boolean", "append", "NoTimeout")
