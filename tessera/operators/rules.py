"""Steps of column and row edits, given as plain data with Spark SQL expressions.

A step is {"vars": {name: SQL over the whole table}, "columns": {"add" | "rename" | "drop": [...]},
"rows": {"drop" | "update": [...]}}.  In an update's condition and value, ``this`` is the target column,
``row_index`` the row's number and ``var_<name>`` a variable.  Rules apply in order; each sees what the
ones before wrote.  ``fallback_value`` stands where the value is null; an expression that may fail says so with
Spark's ``try_`` functions, whose failures are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError


def _targets(df: DataFrame, rule: dict, entities: dict[str, str], types: dict[str, str]) -> list[str]:
    """By name, else by entity, else by type; a rule with a condition only is for every column."""
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    if "name" in rule:
        missing = [c for c in as_list(rule["name"]) if c not in df.columns]
        if missing:
            raise ParameterError(f"no such column: {', '.join(missing)}")
        return as_list(rule["name"])
    if "entity" in rule:
        return [c for c in df.columns if entities.get(c) in as_list(rule["entity"])]
    if "type" in rule:
        return [c for c in df.columns if types.get(c) in as_list(rule["type"])]
    if "position" in rule:
        return [df.columns[rule["position"]]]
    return list(df.columns)


def _with(df: DataFrame, values: dict, this: str | None = None) -> DataFrame:
    """df with a column for every variable, and ``this`` for the target column: expressions name them, nothing is pasted into SQL."""
    new = {f"var_{name}": F.lit(v) for name, v in values.items()} | ({"this": F.col(f"`{this}`")} if this is not None else {})
    taken = [c for c in new if c in df.columns]
    if taken:
        raise ParameterError(f"a column has a name that rules use: {', '.join(taken)}")
    return df.withColumns(new) if new else df


def apply_step(df: DataFrame, step: dict, entities: dict[str, str] | None = None, types: dict[str, str] | None = None, locked: tuple[str, ...] = ()) -> DataFrame:
    entities, types = entities or {}, types or {}
    values: dict = {}
    for name, sql in step.get("vars", {}).items():
        values[name] = _with(df, values).agg(F.expr(sql).alias("v")).first()["v"]
    columns = step.get("columns", {})
    for rule in columns.get("add", []):
        names = [c for c in df.columns if c != rule["name"]]
        names.insert(rule.get("position", len(names)), rule["name"])
        df = df.withColumn(rule["name"], F.lit(None).cast(rule.get("dtype", "string"))).select(*[f"`{c}`" for c in names])
    for rule in columns.get("rename", []):
        if rule["name"] not in locked and rule["value"] not in locked:
            df = df.withColumnRenamed(rule["name"], rule["value"])
    for rule in columns.get("drop", []):
        df = df.drop(*[c for c in _targets(df, rule, entities, types) if c not in locked])
    rows = step.get("rows", {})
    for rule in rows.get("drop", []):
        names = df.columns
        df = _with(df, values).filter(~F.coalesce(F.expr(rule["condition"]), F.lit(False))).select(*[f"`{c}`" for c in names])
    for rule in rows.get("update", []):
        for c in _targets(df, rule, entities, types):
            if c in locked:
                continue
            names, seen = df.columns, _with(df, values, c)
            if "foreach" in rule:
                value = F.aggregate(F.array(*map(F.lit, rule["foreach"])), F.col(f"`{c}`").cast("string"), lambda acc, item, rule=rule: F.call_function(rule["value"], acc, item))
            else:
                value = F.expr(rule["value"])
            if "fallback_value" in rule:
                value = F.coalesce(value, F.lit(rule["fallback_value"]))
            when = F.expr(rule["condition"]) if "condition" in rule else F.lit(True)
            df = seen.withColumn(c, F.when(when, value).otherwise(F.col(f"`{c}`"))).select(*[f"`{x}`" for x in names])
    return df


def apply_steps(df: DataFrame, steps: list[dict], **context) -> DataFrame:
    if not 1 <= len(steps) <= 10:
        raise ParameterError("one to ten steps are needed")
    for step in steps:
        df = apply_step(df, step, **context)
    return df
