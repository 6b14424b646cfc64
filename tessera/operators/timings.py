"""How long things take: seconds per recogniser from executors, and stages of a run with the rows that passed.

Sums of executors are (n, mean, sum of squared deviations, largest), which merge in any order.  They count work that was done:
a task that runs again is counted again, and what an abandoned attempt did may be missing.
"""

from __future__ import annotations

import contextlib
import math
import time
from collections.abc import Iterator

from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Moments = tuple[int, float, float, float]


def moments(values: list[float]) -> Moments:
    mean = math.fsum(values) / len(values)
    return len(values), mean, math.fsum((v - mean) ** 2 for v in values), max(values)


def merged_moments(a: Moments, b: Moments) -> Moments:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n, max(a[3], b[3])


class _Merge(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for name, m in b.items():
            a[name] = merged_moments(a[name], m) if name in a else m
        return a


class Timings:
    """Seconds by name; what reaches the driver is one row a name and task."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sums = spark, spark.sparkContext.accumulator({}, _Merge())

    def table(self) -> DataFrame:
        """name, n, seconds, mean, sd (0 for one), largest."""
        rows = [(name, n, n * mean, mean, math.sqrt(m2 / (n - 1)) if n > 1 else 0.0, top) for name, (n, mean, m2, top) in sorted(self.sums.value.items())]
        return self.spark.createDataFrame(rows, "name string, n long, seconds double, mean double, sd double, largest double")


class RunSummary:
    """One row a stage: its seconds, how it ended, and the rows and sums observed in the same pass as its work."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages, self.observations = spark, {}, {}

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, ended = time.perf_counter(), "failed"
        try:
            yield
            ended = "done"
        finally:
            self.stages[name] = (round(time.perf_counter() - began, 6), ended)

    def counted(self, df: DataFrame, stage: str, *sums) -> DataFrame:
        """df, whose rows (and the named sums, columns of numbers) are counted for a stage when it is first run."""
        seen = self.observations[stage] = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums)

    def table(self) -> DataFrame:
        """stage, seconds, status, rows, facts (the sums by name)."""
        out = []
        for name, (seconds, status) in self.stages.items():
            told = dict(self.observations[name].get) if name in self.observations and status == "done" else {}
            rows = told.pop("rows", None)
            out.append((name, seconds, status, rows, {k: None if v is None else float(v) for k, v in told.items()}))
        return self.spark.createDataFrame(out, "stage string, seconds double, status string, rows long, facts map<string,double>")
