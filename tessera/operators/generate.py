"""The generation loop around a pluggable generator: prompts out, records in, until enough or no more.

A generator is anything with ``generate(prompts: DataFrame) -> DataFrame`` from (prompt_no) to (prompt_no, text).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError
from .records import responses

PROMPTS, BUFFER = 100, 10


class Generator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame: ...


def next_prompts(remaining: int, valid_per_prompt: float) -> int:
    return min(PROMPTS, round(remaining / (valid_per_prompt + 1e-9)) + BUFFER)


def prompt_of(columns: list[str], instruction: str, template: str = "{instruction}{schema}", exclude: tuple[str, ...] = ()) -> str:
    schema = ",".join(f'"{c}":<unk>' for c in columns if c not in exclude)
    return template.format(instruction=instruction, schema=schema)


class Batches:
    """Accumulated batches: valid records as a table, counts per batch, and the state of the run."""

    def __init__(self, target: int, threshold: float = 0.8, patience: int = 3):
        self.target, self.threshold, self.patience = target, threshold, patience
        self.valid: DataFrame | None = None
        self.counts: list[tuple[int, int]] = []
        self.bad_run, self.state = 0, "IN_PROGRESS"

    @property
    def n_valid(self) -> int:
        return sum(v for v, _ in self.counts)

    def add(self, batch: DataFrame) -> str:
        """batch: (record, is_valid).  The mean share of invalid records decides when patience is at an end."""
        v, n = batch.agg(F.count_if("is_valid"), F.count(F.lit(1))).first()
        good = batch.filter("is_valid").select("raw")
        self.valid = good if self.valid is None else self.valid.unionByName(good)
        self.counts.append((v, n))
        mean = sum(1 - v / n if n else 1.0 for v, n in self.counts) / len(self.counts)
        self.bad_run = self.bad_run + 1 if mean >= self.threshold else 0
        if self.n_valid >= self.target:
            self.state = "COMPLETE"
        elif self.bad_run >= self.patience:
            self.state = "STOP_METRIC_REACHED" if self.n_valid else "STOP_NO_RECORDS"
        return self.state


def run(spark, generator: Generator, schema: dict, target: int, threshold: float = 0.8, patience: int = 3, most_batches: int = 100) -> tuple[DataFrame, Batches]:
    """Rows of valid records (raw), at most target of them, and the batches behind them."""
    batches, n = Batches(target, threshold, patience), PROMPTS
    for _ in range(most_batches):
        found = responses(generator.generate(spark.range(n).withColumnRenamed("id", "prompt_no")), "prompt_no", "text", schema)
        if batches.add(found) != "IN_PROGRESS":
            break
        n = next_prompts(target - batches.n_valid, batches.n_valid / max(1, PROMPTS * len(batches.counts)))
    if batches.valid is None or not batches.n_valid:
        raise GenerationError("no valid record was generated")
    if batches.state == "IN_PROGRESS":
        batches.state = "INCOMPLETE"
    return batches.valid.limit(target), batches
