"""Typed actions on tables: generate columns, and validate batches with a reason for each refused row.

Every action is a small object with the phases it has: ``preprocess``, ``generate``, ``postprocess`` and
``refuses`` (a condition under which a row is refused).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.dates import inferred_format
from ..functions.people import fake

REASON = "reject_reason"


class Action:
    kind = "action"

    def preprocess(self, df: DataFrame) -> DataFrame:
        return df

    def generate(self, df: DataFrame) -> DataFrame:
        return df

    def postprocess(self, df: DataFrame) -> DataFrame:
        return df

    def refuses(self, df: DataFrame) -> Column | None:
        return None


@dataclass(frozen=True)
class Expression(Action):
    column: str
    sql: str
    dtype: str | None = None
    kind = "gen_expression"

    def generate(self, df):
        value = F.expr(self.sql)
        return df.withColumn(self.column, value.cast(self.dtype) if self.dtype else value)


@dataclass(frozen=True)
class UniqueId(Action):
    column: str
    kind = "gen_unique_id"

    def generate(self, df):
        return df.withColumn(self.column, F.expr("uuid()"))


@dataclass(frozen=True)
class Sampled(Action):
    """A column of Gauss (mean, deviation) or even (low, high) numbers."""

    column: str
    law: str
    a: float
    b: float
    seed: int = 0
    kind = "gen_distribution"

    def generate(self, df):
        return df.withColumn(self.column, F.randn(self.seed) * self.b + self.a if self.law == "gaussian" else F.rand(self.seed) * (self.b - self.a) + self.a)


@dataclass(frozen=True)
class SampledTimes(Action):
    """A column of times between two seconds since 1970, evenly, or by Gauss around their middle; cut to a precision and written in a format.

    precision: year, month, day, hour, minute or second.
    """

    column: str
    low: int
    high: int
    law: str = "uniform"
    precision: str = "second"
    fmt: str = "yyyy-MM-dd HH:mm:ss"
    seed: int = 0
    kind = "gen_datetime_distribution"

    def generate(self, df):
        middle, width = (self.low + self.high) / 2, self.high - self.low
        even = F.rand(self.seed) * width + self.low
        around = F.greatest(F.lit(float(self.low)), F.least(F.lit(float(self.high)), F.randn(self.seed) * (width / 6) + middle))
        at = F.timestamp_seconds(around if self.law == "gaussian" else even)
        return df.withColumn(self.column, F.date_format(F.date_trunc(self.precision, at), self.fmt))


@dataclass(frozen=True)
class Derived(Action):
    """Several columns at once, by SQL expressions that see the row as it was before any of them."""

    columns: tuple[tuple[str, str], ...]
    kind = "gen_raw_expression"

    def generate(self, df):
        return df.withColumns({name: F.expr(sql) for name, sql in self.columns})


@dataclass(frozen=True)
class StandIn(Action):
    """A column of stand-ins of a kind (those of functions.people.fake), by the key column: equal keys, equal values."""

    column: str
    what: str
    key: str
    kind = "gen_faker"

    def generate(self, df):
        return df.withColumn(self.column, fake(self.what, F.col(self.key)))


@dataclass(frozen=True)
class Regenerated(Action):
    """A column that is left out before training and made again, in its place, behind it."""

    column: str
    sql: str
    position: int
    kind = "replace_datasource"

    def preprocess(self, df):
        return df.drop(self.column)

    def postprocess(self, df):
        names = [c for c in df.columns if c != self.column]
        names.insert(self.position, self.column)
        return df.withColumn(self.column, F.expr(self.sql)).select(*names)


@dataclass(frozen=True)
class DropWhere(Action):
    conditions: tuple[str, ...]
    kind = "expression_drop"

    def refuses(self, df):
        return F.coalesce(F.greatest(*[F.coalesce(F.expr(c), F.lit(False)) for c in (*self.conditions, "false")]), F.lit(False))


@dataclass(frozen=True)
class Categorical(Action):
    column: str
    values: tuple
    kind = "categorical"

    def refuses(self, df):
        return ~F.coalesce(F.col(self.column).isin(list(self.values)), F.lit(False))


@dataclass(frozen=True)
class DateConstraint(Action):
    """The first date has to stand in this relation (gt, ge, lt, le) to the second."""

    first: str
    relation: str
    second: str
    kind = "date_constraint"

    def refuses(self, df):
        a, b = F.col(self.first).try_cast("timestamp"), F.col(self.second).try_cast("timestamp")
        fits = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[self.relation]
        return ~F.coalesce(fits, F.lit(False))


@dataclass(frozen=True)
class DateFormat(Action):
    """Dates in one format; without one, in that which most of a column's values have.  A value of another format is refused."""

    column: str
    fmt: str | None = None
    kind = "datetime"

    def format_of(self, df) -> str:
        fmt = self.fmt or inferred_format(df, self.column)
        if fmt is None:
            raise DataError(f"no date format fits {self.column}")
        return fmt

    def postprocess(self, df):
        fmt = self.format_of(df)
        return df.withColumn(self.column, F.date_format(F.try_to_timestamp(self.column, F.lit(fmt)), fmt))

    def refuses(self, df):
        return F.try_to_timestamp(self.column, F.lit(self.format_of(df))).isNull()


@dataclass(frozen=True)
class DropDuplicates(Action):
    """Of equal rows of a batch the one with the smallest key stays."""

    key: str
    kind = "drop_duplicates"

    def refuses(self, df):
        same = Window.partitionBy(*[c for c in df.columns if c not in (self.key, REASON)]).orderBy(self.key)
        return F.row_number().over(same) > 1


def prepared(df: DataFrame, actions: Sequence[Action]) -> DataFrame:
    for a in actions:
        df = a.preprocess(df)
    return df


def generated(df: DataFrame, actions: Sequence[Action]) -> DataFrame:
    for a in actions:
        df = a.generate(df)
    return df


def finished(df: DataFrame, actions: Sequence[Action]) -> DataFrame:
    """Postprocessing, in reverse order."""
    for a in reversed(actions):
        df = a.postprocess(df)
    return df


def validated(df: DataFrame, actions: Sequence[Action]) -> DataFrame:
    """df with the kind of the first action that refuses a row, or null."""
    reasons = [F.when(c, a.kind) for a in actions if (c := a.refuses(df)) is not None]
    return df.withColumn(REASON, F.coalesce(*reasons, F.lit(None).cast("string")))
