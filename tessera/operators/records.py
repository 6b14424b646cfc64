"""JSON-lines records: extraction from text, validation against a schema, flattening, and error counts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.dates import to_seconds
from .patterns import records_pattern
from .timeseries import cascade

#: A record: from a brace to the first brace that ends a line.
RECORD = r"(\{.+?\})(?=\n|$)"
#: Errors shown in a report; those of the data's configuration are always shown.
SHOWN = 10


def serialized(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """A row as one line of JSON; nulls are written."""
    kept = [c for c in (columns or df.columns) if c not in exclude]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]), {"ignoreNullFields": "false"})


def extracted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RECORD), F.lit(1))


def extracted_groups(text: Column, begin: str, end: str) -> Column:
    """What stands between each begin mark and the end mark after it."""
    return F.regexp_extract_all(text, F.lit(f"(?s){re.escape(begin)}(.*?){re.escape(end)}"), F.lit(1))


def _json_type(v: Column) -> Column:
    return _type_name(F.schema_of_variant(v))


def _type_name(kind: Column) -> Column:
    return (
        F.when(kind.isNull(), None).when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind == "BIGINT", "integer")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def _ladder(record: Column, shape: Column, schema: dict, value, kind) -> Column:
    """struct<message, kind> of the first broken rule; value and kind give a property's variant and its type's name."""
    error = lambda message, kind: F.struct(F.lit(message).alias("message"), F.lit(kind).alias("kind"))
    required = set(schema.get("required", []))
    out = F.when(record.isNull(), error("the record is not JSON", "Invalid JSON")).when(~shape.startswith("OBJECT"), error("the record is not an object", "type"))
    for name, rule in schema.get("properties", {}).items():
        v, is_kind = value(name), F.coalesce(kind(name), F.lit("absent"))
        there = is_kind != "absent"
        if name in required:
            out = out.when(~there, error(f"{name}: is required", "required"))
        if "enum" in rule:
            allowed = [x if isinstance(x, str) else json.dumps(x) for x in rule["enum"] if x is not None]
            fits = F.coalesce(F.try_variant_get(v, "$", "string").isin(allowed), F.lit(False))
            fits = fits | (is_kind == "null") if None in rule["enum"] else fits
            out = out.when(there & ~fits, error(f"{name}: is not one of the values", "enum"))
            continue
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        if kinds:
            fits = is_kind.isin([*kinds, "integer"] if "number" in kinds else kinds)
            out = out.when(there & ~fits, error(f"{name}: is not of type {' or '.join(kinds)}", "type"))
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        numeric, is_text = is_kind.isin("integer", "number"), is_kind == "string"
        if {"integer", "number"} & set(kinds):
            out = out.when(numeric & (number.isNull() | (F.abs(number) == float("inf"))), error(f"{name}: is too large", "Float Conversion"))
        for key, broken in (("minimum", lambda x: numeric & (number < x)), ("maximum", lambda x: numeric & (number > x)), ("minLength", lambda x: is_text & (F.length(text) < x)), ("maxLength", lambda x: is_text & (F.length(text) > x))):
            if key in rule and rule[key] is not None:
                out = out.when(broken(rule[key]), error(f"{name}: {key} is {rule[key]}", key))
    return out


def first_error(raw: Column, schema: dict) -> Column:
    """struct<message, kind> of the first rule that a record breaks, in the schema's order; null for a valid one.

    Fields that the schema does not declare are accepted.  As one expression it parses the record for every rule; validated()
    parses it once.
    """
    record = F.try_parse_json(raw)
    value = lambda name: F.try_variant_get(record, f"$['{name}']", "variant")
    return _ladder(record, F.schema_of_variant(record), schema, value, lambda name: _json_type(value(name)))


def validated(df: DataFrame, raw: str, schema: dict) -> DataFrame:
    """df with error_message, error_kind and is_valid of a column of records.

    The record is parsed in a projection of its own, each property taken out in the next, and its type in one more.
    """
    names = list(schema.get("properties", {}))
    step = df.withColumn("_record", F.try_parse_json(raw))
    step = step.withColumns({"_shape": F.schema_of_variant("_record"), **{f"_v{i}": F.try_variant_get("_record", f"$['{n}']", "variant") for i, n in enumerate(names)}})
    step = step.withColumns({f"_s{i}": F.schema_of_variant(f"_v{i}") for i in range(len(names))})
    at = {n: i for i, n in enumerate(names)}
    error = _ladder(F.col("_record"), F.col("_shape"), schema, lambda n: F.col(f"_v{at[n]}"), lambda n: _type_name(F.col(f"_s{at[n]}")))
    found = step.withColumn("_e", error)
    return found.select(*df.columns, F.col("_e")["message"].alias("error_message"), F.col("_e")["kind"].alias("error_kind"), F.col("_e").isNull().alias("is_valid"))


def responses(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """key, record_no, raw, error_message, error_kind, is_valid: a row per record found in a response."""
    return validated(df.select(key, F.posexplode(extracted(F.col(text))).alias("record_no", "raw")), "raw", schema)


def grouped_responses(df: DataFrame, key: str, text: str, schema: dict, group: str, order: str | None, begin: str = "<s>", end: str = "</s>", ignore_invalid: bool = False, fix_group: bool = False, fix_order: bool = False) -> DataFrame:
    """key, group_no, n, n_valid, error: each delimited group of records is taken or refused as a whole.

    Checked in turn: no valid record; an invalid record; more than one group value; records out of order.
    """
    groups = df.select(key, F.posexplode(extracted_groups(F.col(text), begin, end)).alias("group_no", "body"))
    records = validated(groups.select(key, "group_no", F.posexplode_outer(extracted(F.col("body"))).alias("record_no", "raw")), "raw", schema)
    v = F.try_parse_json("raw")
    records = records.withColumns({"_g": F.when(F.col("is_valid"), F.try_variant_get(v, f"$['{group}']", "string")), "_o": F.when(F.col("is_valid"), F.try_variant_get(v, f"$['{order}']", "double")) if order else F.lit(None).cast("double"), "_real": F.col("raw").isNotNull()})
    by = Window.partitionBy(key, "group_no").orderBy("record_no")
    records = records.withColumn("_back", F.coalesce(F.last("_o", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_o"), F.lit(False)))
    sums = records.groupBy(key, "group_no").agg(F.count_if("_real").alias("n"), F.count_if(F.col("_real") & F.col("is_valid")).alias("n_valid"), F.countDistinct("_g").alias("_groups"), F.bool_or("_back").alias("_back"))
    ladder = F.when(F.col("n_valid") == 0, "no valid record")
    if not ignore_invalid:
        ladder = ladder.when(F.col("n_valid") < F.col("n"), "invalid record")
    if not fix_group:
        ladder = ladder.when(F.col("_groups") > 1, "groupby")
    if not fix_order:
        ladder = ladder.when(F.col("_back"), "order")
    return sums.withColumn("error", ladder).drop("_groups", "_back")


def timed_responses(df: DataFrame, key: str, text: str, schema: dict, timestamp: str, fmt: str, interval: int) -> DataFrame:
    """responses() of time series: a valid record is refused as well where its step is not the interval, and all later ones with it.

    A format without a date may step over midnight.
    """
    found = responses(df, key, text, schema)
    value = F.try_variant_get(F.try_parse_json("raw"), f"$['{timestamp}']", "string")
    timed = found.filter("is_valid").withColumn("_s", to_seconds(value, fmt))
    steps = cascade(timed, key, "record_no", "_s", interval, time_only=fmt != "elapsed_seconds" and "y" not in fmt).select(key, "record_no", F.col("error").alias("_error"))
    joined = found.join(steps, [key, "record_no"], "left")
    late = F.col("_error").isNotNull()
    return joined.withColumns({
        "error_message": F.when(late, F.concat(F.lit(f"{timestamp}: "), F.col("_error"))).otherwise(F.col("error_message")),
        "error_kind": F.when(late, "interval").otherwise(F.col("error_kind")), "is_valid": F.col("is_valid") & ~late,
    }).drop("_error")


def response_processor(schema: dict, group: str | None = None, order: str | None = None, timestamp: str | None = None, fmt: str = "elapsed_seconds", interval: int | None = None):
    """How responses are checked: as time series where there are a timestamp and an interval, else group by group where there is a group, else one by one.

    A function of (df, key, text).
    """
    if timestamp is not None and interval is not None:
        return lambda df, key, text: timed_responses(df, key, text, schema, timestamp, fmt, interval)
    if group is not None:
        return lambda df, key, text: grouped_responses(df, key, text, schema, group, order)
    return lambda df, key, text: responses(df, key, text, schema)


def error_statistics(errors: DataFrame, message: str, kind: str) -> DataFrame:
    """message, n, share: the most frequent messages, and every one of the data's configuration."""
    counts = errors.groupBy(message, kind).agg(F.count(F.lit(1)).alias("n"))
    # one row; and at most SHOWN rows, which no task has to sort all messages for
    total = F.broadcast(counts.agg(F.sum("n").alias("_total")))
    top = counts.orderBy(F.desc("n"), message, kind).limit(SHOWN)
    named = top.select(F.col(message).alias("_m"), F.col(kind).alias("_k"))
    same = F.col(message).eqNullSafe(F.col("_m")) & F.col(kind).eqNullSafe(F.col("_k"))
    rest = counts.filter(F.col(kind) == "data_config").join(F.broadcast(named), same, "left_anti")
    return top.unionByName(rest).join(total).select(message, kind, "n", (F.col("n") / F.col("_total")).alias("share"))


def grouped_messages(errors: DataFrame, message: str, most: int = 5) -> DataFrame:
    """suffix, prefixes, n: messages 'field: what' by what, with at most five fields named."""
    parts = F.split(message, ": ", 2)
    by = errors.select(F.get(parts, F.lit(0)).alias("prefix"), F.coalesce(F.get(parts, F.lit(1)), F.col(message)).alias("suffix"))
    out = by.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("prefix")).alias("all"))
    named = F.array_join(F.slice("all", 1, most), "/")
    return out.select("suffix", F.when(F.size("all") > most, F.concat(named, F.lit("/..."))).otherwise(named).alias("prefixes"), "n")


def flattened(raw: Column) -> Column:
    """array<struct<path, field, value, type>> of the scalars of a JSON text; empty objects and arrays vanish."""

    @F.pandas_udf("array<struct<path:string,field:string,value:string,type:string>>")
    def flat(values: pd.Series) -> pd.Series:
        def walk(v, path, field, out):
            if isinstance(v, dict):
                for k, x in v.items():
                    plain = re.fullmatch(r"[A-Za-z0-9_]+", k)
                    walk(x, path + (f".{k}" if plain else "['" + k.replace("'", "\\'") + "']"), [*field, k], out)
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    walk(x, f"{path}[{i}]", field, out)
            else:
                kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
                out.append((path, ".".join(field), None if v is None else v if isinstance(v, str) else json.dumps(v), kind))
            return out

        def one(text):
            try:
                return walk(json.loads(text), "$", [], []) if text is not None else None
            except ValueError:
                return None

        return values.map(one)

    return flat(raw)


def unflattened(paths: dict[str, object]) -> object:
    """The nested value of {JSON path: scalar}; array gaps are null; an object and an array at one place is an error."""
    root: list = [None]
    for path, value in paths.items():
        steps = [m[1] if m[1] is not None else m[2].replace("\\'", "'") if m[2] is not None else int(m[3]) for m in re.finditer(r"\.([A-Za-z0-9_]+)|\['((?:[^'\\]|\\.)*)'\]|\[(\d+)\]", path)]
        at, key = root, 0
        for step in steps:
            if at[key] is None:
                at[key] = [] if isinstance(step, int) else {}
            at, kind = at[key], list if isinstance(step, int) else dict
            if not isinstance(at, kind):
                raise ParameterError(f"{path} meets a value of another kind")
            if isinstance(step, int):
                at.extend([None] * (step + 1 - len(at)))
            else:
                at.setdefault(step, None)
            key = step
        at[key] = value
    return root[0]


def schema_pattern(schema: dict) -> str:
    """A regular expression for one-line records of a schema; patterns.records_pattern() has groups and several lines."""
    return records_pattern(schema, single=True)


def estimated_tokens(row: list[Column]) -> Column:
    """Tokens of a row by its length: a quarter of the characters that are no digits, and every digit."""
    text = F.concat_ws(" ", *[c.cast("string") for c in row])
    rest = F.length(F.regexp_replace(text, r"\d", ""))
    return F.ceil(rest / 4 + (F.length(text) - rest))
