"""Small steps on rows and columns that the larger operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that steps add to rows for themselves.
METADATA = ("row_idx", "reject_reason")
#: Words of a column's name that make its numbers labels.
LABEL_WORDS = frozenset("category class code flag gender group id identifier index key label level number rank sex state status tag type year zip".split())


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or not a number."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[column] in ("double", "float") else c.isNull()


def json_type(value: Column) -> Column:
    """The JSON type of a value's text: object, array, string, number, boolean or null."""
    kind = F.upper(F.schema_of_variant(F.try_parse_json(value)))
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
    return F.when(kind.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(named, F.lit("number")))


def split_by_kind(df: DataFrame, types: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """(key and the text columns, key and all others)."""
    texts = [c for c in df.columns if types.get(c) == "text" and c != key]
    return df.select(key, *texts), df.drop(*texts)


def is_label_name(column: str) -> bool:
    """Whether a column's name says that its numbers are labels: one of its words is a label word."""
    from .recognizers import header_tokens

    return not LABEL_WORDS.isdisjoint(header_tokens(column))


def without_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*METADATA)


def with_verdicts(records: DataFrame, verdicts: DataFrame, index: str, reason: str = "reject_reason") -> DataFrame:
    """Records with is_valid and reason: a record that verdicts doesn't refuse is valid."""
    refused = verdicts.filter(F.col(reason).isNotNull()).groupBy(index).agg(F.min(reason).alias(reason))
    return records.drop(reason).join(refused, index, "left").withColumn("is_valid", F.col(reason).isNull())


def grouped_arrays(df: DataFrame, group: str, order: str, array: str) -> DataFrame:
    """group, array (those of its rows one after the other, by order) and n_rows."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(array).alias("a"))))
    return df.groupBy(group).agg(F.flatten(F.transform(parts, lambda p: p["a"])).alias(array), F.count(F.lit(1)).alias("n_rows"))


def mean_vectors(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group and the mean, position by position, of its vectors; null vectors take no part."""
    cells = df.filter(F.col(vector).isNotNull()).select(*group, F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy(*group, "at").agg(F.avg("x").alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(*group).agg(F.transform(parts, lambda p: p["x"]).alias(vector))


def mean_vector(*vectors: Column) -> Column:
    """The mean of several vectors of one row; null ones take no part."""
    kept = F.filter(F.array(*vectors), lambda v: v.isNotNull())
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(kept[0], lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def merged_maps(base: Column, new: Column) -> Column:
    """Both maps' entries; where both have a key, that of ``new``."""
    return F.map_zip_with(base, new, lambda _, old, other: F.coalesce(other, old))


def snapshots(total: int, parts: tuple[float, ...] = (0.25, 0.5, 0.75)) -> list[int]:
    """The counts of records at which partial output is kept, each once and none of them nothing."""
    return sorted({max(1, math.ceil(total * p)) for p in parts}) if total > 0 else []


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both tables' columns for every key of either; a column that both have keeps the left one's value where there is one."""
    both = [c for c in right.columns if c in left.columns and c != key]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in both})
    joined = left.join(renamed, key, "full")
    return joined.select(key, *[F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) if c in both else c for c in left.columns if c != key], *[c for c in right.columns if c not in both and c != key])
