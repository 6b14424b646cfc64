"""Column profiles, semantic types, and schemas inferred from them.

A column is profiled from its distinct values, by itself, so a task holds values of one column at a time; only one row
per column leaves it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType, T.DecimalType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Mean number of blanks above which a column is text.
TEXT_BLANKS = 2


def kind_of(dtype: T.DataType) -> str:
    return "float" if isinstance(dtype, _FLOATS) else "integer" if isinstance(dtype, _INTEGERS) else "other"


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, decimals as doubles, dates and times as strings."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def floor_power_of_10(v: Column) -> Column:
    """The power of ten at or below v in magnitude (above, for a negative v); 1 for 0."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 1.0).when(v > 0, step).when(v < 0, F.when(step == F.abs(v), -step).otherwise(-step * 10))


def decimals(v: Column) -> Column:
    """Digits behind the point of a double as Python prints it; a whole number has none."""
    text = v.cast("string")
    body = F.regexp_extract(text, r"\.(\d+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    return F.greatest(F.length(F.when(body == "0", "").otherwise(body)) - power, F.lit(0))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: column, kind, n_rows, n_missing, n_distinct, percent_missing, low, high, mean_length, mean_blanks, field_type."""
    df = clean(df)
    facts = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        values = df.select((c if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(c)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        number = F.col("v").cast("double") if kind != "other" else F.lit(None).cast("double")
        text = F.col("v") if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")
        n = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
        mean = lambda size: F.try_divide(F.sum(size * F.col("c")), n)  # noqa: B023, E731
        facts.append(
            values.agg(
                F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), n.alias("n"), F.count("v").alias("n_distinct"),
                F.min(number).alias("low"), F.max(number).alias("high"), mean(F.length(text)).alias("mean_length"), mean(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("mean_blanks"),
            )
        )
    rows = reduce(DataFrame.unionByName, facts)
    return with_field_type(rows).withColumn("n_missing", F.col("n_rows") - F.col("n")).withColumn("percent_missing", F.bround(100 * F.try_divide(F.col("n_missing"), "n_rows"), 4))


def with_field_type(rows: DataFrame) -> DataFrame:
    """The ladder of semantic types; the first step that fits decides."""
    repeat = (F.col("n") - F.col("n_distinct")) / F.col("n")
    few = (F.col("n_distinct") <= 10) & (floor_power_of_10(F.col("low")) >= 0)
    ladder = (
        F.when(F.col("n") == 0, "empty")
        .when(F.col("n_distinct") == 2, "binary")
        .when(F.col("kind") == "float", "numeric")
        .when(F.col("kind") == "integer", F.when(few, "categorical").otherwise("numeric"))
        .when((repeat >= 0.9) | ((repeat >= 0.7) & (F.col("n") <= 50)), "categorical")
        .when(F.col("mean_blanks") > TEXT_BLANKS, "text")
        .otherwise("other")
    )
    return rows.withColumn("field_type", ladder)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (string): a row for each cell."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))


def enum_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, n_singletons, is_enum: few distinct values, few of them once (a null is a value)."""
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    return by.withColumn("is_enum", (F.col("n_distinct") <= F.pow("n_rows", F.lit(1 / 2))) & (F.col("n_singletons") <= F.pow("n_rows", F.lit(1 / 3))))


def json_schema(df: DataFrame, slack: float = 1.5) -> dict:
    """A JSON schema: enum where values are few, else bounds of numbers or of string lengths; required without nulls."""
    df = clean(df)
    enums = {r["column"] for r in enum_columns(df, df.columns).filter("is_enum").collect()}
    facts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        size = F.length(c.cast("string"))
        facts.append(F.struct(F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("low"), F.max(c).alias("high"), F.bround(F.min(size) / slack).alias("short"), F.bround(F.max(size) * slack).alias("long"), (F.array_sort(F.collect_set(c)) if f.name in enums else F.array().cast(T.ArrayType(f.dataType))).alias("values")).alias(f.name))
    row = df.agg(*facts).first()
    properties, required = {}, []
    for f in df.schema:
        r, kind = row[f.name], kind_of(f.dataType)
        if f.name in enums:
            properties[f.name] = {"enum": list(r["values"]) + [None] * (r["nulls"] > 0)}
        elif kind != "other":
            properties[f.name] = {"type": "integer" if kind == "integer" else "number", "minimum": r["low"], "maximum": r["high"]}
        elif isinstance(f.dataType, T.StringType):
            properties[f.name] = {"type": "string", "minLength": int(r["short"] or 0), "maxLength": int(r["long"] or 0)}
        else:
            properties[f.name] = {"type": {"boolean": "boolean", "array": "array"}.get(f.dataType.typeName(), "object")}
        if r["nulls"]:
            if "type" in properties[f.name]:
                properties[f.name]["type"] = [properties[f.name]["type"], "null"]
        else:
            required.append(f.name)
    return {"type": "object", "properties": properties, "required": required}
