"""Tables by suffix, a registry of named ones, and sinks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import serialized

#: Reader and options by suffix.
READERS = {
    "csv": ("csv", {"header": True, "inferSchema": True, "multiLine": True, "escape": '"'}),
    "txt": ("csv", {"header": True, "inferSchema": True, "multiLine": True, "escape": '"'}),
    "json": ("json", {"multiLine": True}),
    "jsonl": ("json", {}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
}


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its suffix; given options override the defaults.  An unknown suffix is an error at once."""
    suffix = os.path.splitext(urlparse(path).path)[1].lstrip(".").lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {path!r}")
    kind, defaults = READERS[suffix]
    return spark.read.format(kind).options(**(defaults | options)).load(path)


def read_any(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A table as it is, or a path; a .json that is no document is read as lines."""
    if isinstance(source, DataFrame):
        return source
    df = read(spark, source)
    if source.lower().endswith(".json") and df.columns == ["_corrupt_record"]:
        return spark.read.json(source)
    return df


@dataclass(frozen=True)
class Entry:
    name: str
    url: str
    load_args: dict = field(default_factory=dict)
    overrides: dict = field(default_factory=dict)


@dataclass
class Registry:
    """Named tables; a name that is not registered is taken as a path of its own."""

    entries: dict[str, Entry] = field(default_factory=dict)
    base_url: str | None = None

    @classmethod
    def from_yaml(cls, path: str) -> Registry:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        found = [Entry(**e) for e in raw.get("datasets", [])]
        return cls({e.name: e for e in found}, raw.get("base_url"))

    def entry(self, name: str) -> tuple[Entry, str]:
        if name not in self.entries:
            return Entry(name, name), name
        e = self.entries[name]
        if urlparse(e.url).scheme or os.path.isabs(e.url) or not self.base_url:
            return e, e.url
        return e, urljoin(self.base_url.rstrip("/") + "/", e.url) if urlparse(self.base_url).scheme else os.path.join(self.base_url, e.url)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        e, url = self.entry(name)
        return read(spark, url, **e.load_args)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str, exclude: tuple[str, ...] = ()) -> None:
    """One record a line; nulls are written."""
    df.select(serialized(df, exclude=exclude).alias("value")).write.mode("overwrite").text(path)


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables differ in columns or rows."""
    if before.dtypes != after.dtypes:
        return True
    return not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty())


def retyped(df: DataFrame) -> DataFrame:
    """String columns as the first of long, double and boolean that loses no value; one pass decides for all."""
    strings = [c for c, t in df.dtypes if t == "string"]
    if not strings:
        return df
    ladder = ("long", "double", "boolean")
    facts = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"{c}:{t}") for c in strings for t in ladder], *[F.count(c).alias(f"{c}:n") for c in strings]).first()
    to = {c: next((t for t in ladder if facts[f"{c}:n"] and not facts[f"{c}:{t}"]), "string") for c in strings}
    return df.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in df.columns])
