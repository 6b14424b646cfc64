"""Batches of a stream: written once however often they are replayed, with snapshots on the way, a pulse, and a rule for stopping."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.actions import REASON, Action, finished, validated

#: Shares of the wanted records at which partial output is kept.
SHARES = (0.25, 0.5, 0.75)


def thresholds(total: int, shares: Sequence[float] = SHARES) -> dict[int, int]:
    """{records: per cent}: how many records make a snapshot due; shares that fall on one number are one snapshot, of the smallest."""
    found: dict[int, int] = {}
    for share in sorted(shares):
        if total > 0:
            found.setdefault(max(1, math.ceil(total * share)), int(share * 100))
    return found


def acted(batch: DataFrame, actions: Sequence[Action]) -> DataFrame:
    """A batch postprocessed, and with the reason for which the first action refuses a row, or null."""
    return validated(finished(batch, actions), actions)


class BatchSink:
    """For foreachBatch: rows under ``rows/batch_id=n``, and an entry of a ledger once all of a batch is there.

    A batch whose number is in the ledger is left alone, by this sink or one made anew for the same folder; one that stopped
    half-way is written over.  Snapshots hold the valid rows of whole batches up to the one that made them due; which one that is follows
    from the ledger, so a replay writes the same snapshot again and no other.  Invalid rows are kept with their reason.
    """

    def __init__(self, spark: SparkSession, path: str, actions: Sequence[Action] = (), total: int = 0, shares: Sequence[float] = SHARES):
        self.spark, self.path, self.actions = spark, path.rstrip("/"), tuple(actions)
        self.due = thresholds(total, shares)
        self.entries = {r["batch_id"]: r for r in self.ledger().collect()}  # a row a batch

    def ledger(self) -> DataFrame:
        """batch_id, n, n_valid, seconds of every batch that was written whole."""
        schema = "batch_id long, n long, n_valid long, seconds double"
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """batch_id and the rows of the batches in the ledger; what a broken attempt left is not among them."""
        return self.spark.read.parquet(f"{self.path}/rows").join(F.broadcast(self.ledger().select("batch_id")), "batch_id", "left_semi")

    def snapshot(self, percent: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots/percent={percent}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.entries:
            return
        began, seen = time.perf_counter(), Observation()
        rows = acted(batch, self.actions).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(REASON).isNull()).alias("n_valid"))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        n, n_valid = seen.get["n"], seen.get["n_valid"]
        before = sum(e["n_valid"] for i, e in self.entries.items() if i < batch_id)
        for needed, percent in self.due.items():
            if before < needed <= before + n_valid:
                done = [i for i in self.entries if i < batch_id] + [batch_id]
                valid = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("batch_id").isin(done) & F.col(REASON).isNull())
                valid.drop(REASON).write.mode("overwrite").parquet(f"{self.path}/snapshots/percent={percent}")
        entry = (batch_id, n, n_valid, round(time.perf_counter() - began, 3))
        self.spark.createDataFrame([entry], "batch_id long, n long, n_valid long, seconds double").coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/id={batch_id}")
        self.entries[batch_id] = dict(zip(("batch_id", "n", "n_valid", "seconds"), entry))


class StopRule:
    """Patience with invalid records: at its end once the mean share of them was at least the threshold for so many batches in a row."""

    def __init__(self, threshold: float = 0.8, patience: int = 3):
        self.threshold, self.patience, self.shares, self.bad = threshold, patience, [], 0

    def add(self, n: int, n_valid: int) -> bool:
        """One batch more; a batch without records counts as all invalid."""
        self.shares.append(1 - n_valid / n if n else 1.0)
        self.bad = self.bad + 1 if sum(self.shares) / len(self.shares) >= self.threshold else 0
        return self.bad >= self.patience


def observed(stream: DataFrame, valid: str, name: str = "records") -> DataFrame:
    """stream, whose progress tells n and n_valid of each batch under a name."""
    return stream.observe(name, F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"))


class Heartbeat(StreamingQueryListener):
    """Keeps batch_id, rows, rates and valid records of each batch of a query, and says when its rule is at an end.

    A listener hears of a batch after it is done, so a query may do some more before it stops.
    """

    def __init__(self, rule: StopRule | None = None, name: str = "records", most: int = 10_000):
        self.rule, self.name, self.most = rule, name, most
        self.beats: list[dict] = []
        self.ended, self.failure = threading.Event(), None
        self._seen: set[tuple] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = p.observedMetrics.get(self.name)
        if told is None or (p.runId, p.batchId) in self._seen:
            return
        self._seen.add((p.runId, p.batchId))
        beat = {"batch_id": p.batchId, "n": told["n"], "n_valid": told["n_valid"], "rows_in_second": p.inputRowsPerSecond, "rows_out_second": p.processedRowsPerSecond, "seconds": p.batchDuration / 1000}
        self.beats = [*self.beats[-self.most + 1 :], beat]
        if self.rule and self.rule.add(told["n"], told["n_valid"]):
            self.ended.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failure = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        kinds = "batch_id long, n long, n_valid long, rows_in_second double, rows_out_second double, seconds double"
        return spark.createDataFrame([tuple(b.values()) for b in self.beats], kinds)


def awaited(query: StreamingQuery, heartbeat: Heartbeat, seconds: float | None = None) -> str:
    """Waits for a query's end, and stops it when the rule is at an end or the time is up: 'finished', 'stopped' or 'time'."""
    began = time.monotonic()
    while not query.awaitTermination(0.2):
        if heartbeat.ended.is_set():
            query.stop()
            return "stopped"
        if seconds is not None and time.monotonic() - began > seconds:
            query.stop()
            return "time"
    return "finished"
