"""Personal data in tables: detection by patterns, merging, redaction, counts, and whole tables at once.

Which recognisers can match is decided by the column's name on the driver and by cheap patterns in the JVM;
only texts that one of them fits go to Python, which finds the places of matches on Arrow batches.  Everything
after that (merging, replacing, counting) is built from array functions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept
from .recognizers import HIGH, LOW, MEDIUM, RECOGNIZERS, Recognizer, address, luhn, mod97, selected
from .timings import Timings, moments

__all__ = ["HIGH", "LOW", "MEDIUM", "RECOGNIZERS", "Recognizer", "address", "luhn", "mod97", "selected"]

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))
#: What is stripped from a value before it is searched.
BLANKS = " \t\n\r\x0b\x0c"


def stripped(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(BLANKS))


def _near(text: str, start: int, end: int, window: int) -> str:
    """What stands within window characters of a match, to the ends of the words there."""
    low, high = max(0, start - window), min(len(text), end + window)
    while low and not text[low - 1].isspace():
        low -= 1
    while high < len(text) and not text[high].isspace():
        high += 1
    return text[low:high].casefold()


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def spans(column: str, recognizers: tuple[Recognizer, ...] = RECOGNIZERS, least: float = LOW, window: int = 16, timings: Timings | None = None) -> Column:
    """array<struct<start, end, label, text, score>> of the stripped value; empty where nothing is found, null for null.

    timings, if given, gets the seconds of each search of a text, by label.
    """
    plan = [(r, re.compile(r.pattern), r.names(column)) for r in recognizers if r.applies(column)]
    value = stripped(F.col(column))
    if not plan:
        return F.when(value.isNotNull(), F.array().cast(SPANS))

    sums = timings.sums if timings is not None else None

    @F.pandas_udf(SPANS)
    def find(values: pd.Series, fits: pd.Series) -> pd.Series:
        taken: dict[str, list[float]] = {}

        def one(text, bits):
            if text is None:
                return None
            found = {}
            for i, (r, pattern, named) in enumerate(plan):
                if not bits >> i & 1:
                    continue
                began = time.perf_counter() if sums is not None else 0.0
                matches = pattern.finditer(text) if not r.whole else filter(None, [pattern.fullmatch(text)])
                for m in matches:
                    if r.valid and not r.valid(m.group()):
                        continue
                    told = named or bool(r.context) and any(c in _near(text, *m.span(), window) for c in r.context)
                    if r.context_only and not told:
                        continue
                    score, key = r.context_score if told else r.score, (*m.span(), r.label)
                    if score >= least and score > found.get(key, (0.0,))[0]:
                        found[key] = (score, m.group())
                if sums is not None:
                    taken.setdefault(r.label, []).append(time.perf_counter() - began)
            return [(s, e, label, t, score) for (s, e, label), (score, t) in sorted(found.items())]

        out = pd.Series([one(t, b) for t, b in zip(values, fits)], index=values.index, dtype=object)
        if taken:
            sums.add({label: moments(seconds) for label, seconds in taken.items()})
        return out

    lower, digits, size = F.lower(value), value.rlike("[0-9]"), F.length(value)

    def fits(r: Recognizer, named: bool) -> Column:
        """Whether the hint is there, and a word near; what is cheap and follows from a match is asked first."""
        asked = []
        if r.whole:
            asked.append(size.between(*r.width()))
        if r.context_only and not named:
            asked.append(_any_of(lower, list(r.context)))
        if r.hint:
            words = r.hint_words()
            if words and not r.hint.startswith("(?i)"):
                asked.append(_any_of(value, words))
            else:
                if words:
                    asked.append(_any_of(lower, words))
                if r.needs_digit():
                    asked.append(digits)
                asked.append(value.rlike(r.hint))
        return reduce(lambda a, b: a & b, asked, F.lit(True)) if asked else F.lit(True)

    bits = sum((F.when(fits(r, named), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (r, _, named) in enumerate(plan)), F.lit(0).cast("long"))
    return F.when(value.isNotNull(), F.coalesce(find(F.when(bits > 0, value), bits), F.array().cast(SPANS)))


def merged(found: Column) -> Column:
    """Overlapping spans as one, from the first start to the last end, with label and text of the longest (first of equals)."""
    s = F.array_sort(F.filter(found, lambda x: x["end"] > x["start"]))
    size = lambda x: x["end"] - x["start"]
    island = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("best"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.when(size(x) > size(last["best"]), x).otherwise(last["best"]).alias("best"))
        joins = (F.size(done) > 0) & (x["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(island(x))))

    empty = F.filter(F.transform(s, island), lambda x: F.lit(False))
    out = F.aggregate(s, empty, lambda done, x: F.when(F.size(done) == 0, F.array(island(x))).otherwise(add(done, x)))
    return F.transform(out, lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["best"]["label"].alias("label"), i["best"]["text"].alias("text"), i["best"]["score"].alias("score")))


def replaced(text: Column, found: Column, by) -> Column:
    """The stripped text with each span as by(span); overlapping spans are merged first."""
    body = stripped(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), by(s)).alias("out"), s["end"].alias("at"))
    return F.aggregate(merged(found), start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))


def redacted(text: Column, found: Column) -> Column:
    return replaced(text, found, lambda s: F.concat(F.lit("<"), s["label"], F.lit(">")))


def labelled(text: Column, found: Column) -> Column:
    return replaced(text, found, lambda s: F.concat(F.lit("<entity type=\""), s["label"], F.lit("\" value=\""), s["text"], F.lit("\">")))


def hashed(text: Column, found: Column, salt: str) -> Column:
    return replaced(text, found, lambda s: F.substring(F.sha2(F.concat(F.lit(salt), s["text"]), 256), 1, 9))


def faked(text: Column, found: Column, fakes: dict[str, list[str]], seed: int = 0) -> Column:
    """A stand-in chosen by a hash of the value; <label> where there are none for the label."""
    def by(s: Column) -> Column:
        out = F.concat(F.lit("<"), s["label"], F.lit(">"))
        for label, items in fakes.items():
            out = F.when(s["label"] == label, F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(F.lit(seed), s["text"]), F.lit(len(items))) + 1).cast("int"))).otherwise(out)
        return out

    return replaced(text, found, by)


def best_scores(found: Column) -> Column:
    """Of spans with the same text and place the one with the highest score, the first label of equals."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    beats = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["label"] < b["label"]))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: same(x, y) & beats(y, x)))


def outermost(found: Column) -> Column:
    """The spans that no other one contains."""
    inside = lambda a, b: (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & (b["end"] - b["start"] > a["end"] - a["start"])
    return F.filter(found, lambda x: ~F.exists(found, lambda y: inside(x, y)))


def chunked_spans(df: DataFrame, key: str, column: str, recognizers: tuple[Recognizer, ...] = RECOGNIZERS, length: int = 512, overlap: int = 128) -> DataFrame:
    """key, found: spans of a long text, searched chunk by chunk; places are those in the stripped text.

    Chunks overlap (not at all where they are no longer than the overlap); what two of them find counts once, and spans
    that another one contains are dropped.
    """
    step = length - overlap if length > overlap else length
    rows = df.select(key, stripped(F.col(column)).alias("_whole")).filter("_whole IS NOT NULL")
    starts = F.sequence(F.lit(0), F.greatest(F.length("_whole") - 1, F.lit(0)), F.lit(step))
    chunks = rows.select(key, "_whole", F.explode(starts).alias("_at")).select(key, "_at", F.substring("_whole", F.col("_at") + 1, F.lit(length)).alias(column))
    lead = F.length(column) - F.length(F.ltrim(F.col(column)))
    found = chunks.withColumn("_found", spans(column, recognizers)).select(key, (F.col("_at") + lead).alias("_at"), F.explode("_found").alias("s"))
    moved = F.struct((F.col("s.start") + F.col("_at")).alias("start"), (F.col("s.end") + F.col("_at")).alias("end"), F.col("s.label").alias("label"), F.col("s.text").alias("text"), F.col("s.score").alias("score"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set(moved)).alias("found")).withColumn("found", outermost(F.col("found")))


def cells(df: DataFrame, columns: Iterable[str], recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> DataFrame:
    """column, value, found of every cell of the columns that isn't null; a column is searched by itself, under its own name."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), spans(c, recognizers).alias("found")).filter("value IS NOT NULL") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_counts(df: DataFrame, columns: list[str], recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> DataFrame:
    """column, label, n, n_values: detections and their distinct texts, per column."""
    return _counted(cells(df, columns, recognizers))


def _counted(rows: DataFrame) -> DataFrame:
    found = rows.select("column", F.inline("found"))
    return found.groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_values"))


def score_bands(found: DataFrame) -> DataFrame:
    """label, band, fields: the columns in which a label was seen with a high, medium (or no) and low score."""
    band = F.when(F.col("score") >= HIGH, "high").when(F.col("score").isNull() | (F.col("score") >= MEDIUM), "medium").otherwise("low")
    return found.groupBy("label", band.alias("band")).agg(F.array_sort(F.collect_set("column")).alias("fields"))


def field_metadata(df: DataFrame, columns: list[str], recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> DataFrame:
    """column, n, n_missing, approx_distinct, label, share: how much of a column's values each label covers."""
    totals = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")).groupBy("column").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.approx_count_distinct("v").alias("approx_distinct")) for c in columns]
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    seen = cells(df, columns, recognizers).select("column", F.explode(F.array_distinct(F.transform("found", lambda s: s["label"]))).alias("label"))
    hits = seen.groupBy("column", "label").agg(F.count(F.lit(1)).alias("hits"))
    return every.join(hits, "column", "left").select("column", "n", "n_missing", "approx_distinct", "label", F.try_divide("hits", "n").alias("share"))


def merged_fragments(parts: DataFrame) -> DataFrame:
    """record_id, field, found, first_seen: what several passes (record_id, field, found, at) say of a record's field."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    return parts.groupBy("record_id", "field").agg(every.alias("found"), F.min("at").alias("first_seen"))


def results_json(found: DataFrame, index: str) -> DataFrame:
    """value: one JSON record a row, {"index", "entities"}; without the matched text."""
    slim = F.transform("found", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return found.select(F.to_json(F.struct(F.col(index).alias("index"), slim.alias("entities"))).alias("value"))


def response_json(records: DataFrame, found: Column, *columns: str) -> DataFrame:
    """value: one JSON record a row, {"data", "model_metadata"}: the columns, and the spans with each entity's places by score band."""
    slim = lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
    band = lambda low, high: F.array_sort(F.array_distinct(F.transform(F.filter("_f", lambda s: (s["score"] >= low) & (s["score"] < high)), lambda s: s["label"])))
    bands = F.struct(band(HIGH, 9.0).alias("high"), band(MEDIUM, HIGH).alias("medium"), band(0.0, MEDIUM).alias("low"))
    rows = records.withColumn("_f", F.coalesce(found, F.array().cast(SPANS)))
    return rows.select(F.to_json(F.struct(F.struct(*columns).alias("data"), F.struct(F.transform("_f", slim).alias("entities"), bands.alias("labels")).alias("model_metadata"))).alias("value"))


def classified_columns(df: DataFrame, columns: list[str], share: float = 0.8, recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> DataFrame:
    """column, label: the entity that covers at least this share of a column's values, nearly whole; the most frequent, then first, of several."""
    return _classified(cells(df, columns, recognizers), share)


def _classified(rows: DataFrame, share: float = 0.8) -> DataFrame:
    size = F.length(stripped(F.col("value")))
    labels = F.array_distinct(F.transform(F.filter("found", lambda s: s["end"] - s["start"] >= 0.9 * size), lambda s: s["label"]))
    totals = rows.groupBy("column").agg(F.count(F.lit(1)).alias("total"))
    hits = rows.select("column", F.explode(labels).alias("label")).groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    # one row a column
    enough = hits.join(F.broadcast(totals), "column").filter(F.col("n") >= share * F.col("total"))
    best = Window.partitionBy("column").orderBy(F.desc("n"), "label")
    return enough.withColumn("_no", F.row_number().over(best)).filter("_no = 1").select("column", "label")


def deidentified(df: DataFrame, columns: list[str], salt: str, fakes: dict[str, list[str]] | None = None, hash_labels: tuple[str, ...] = ("ssn", "credit_card", "iban"), recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> tuple[DataFrame, DataFrame]:
    """The table with personal data replaced, and column, entity, label, n, n_values of what was found.

    A column that is one entity as a whole has every value replaced: by a stand-in where there are some for its
    label, else by a salted hash.  In other columns the found spans are replaced: hashed for hash_labels,
    by stand-ins, or by <label>.  Every value is searched once: the table with its spans is written, and what a column is,
    the counts and the new values come from there.
    """
    fakes = fakes or {}
    at = {c: f"_found_{i}" for i, c in enumerate(columns)}
    searched = kept(df.withColumns({at[c]: spans(c, recognizers) for c in columns}), "searched")
    parts = [searched.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(at[c]).alias("found")).filter("value IS NOT NULL") for c in columns]
    rows = reduce(DataFrame.unionByName, parts)
    entity = {r["column"]: r["label"] for r in _classified(rows).collect()}
    report = _counted(rows)
    kinds = F.create_map(*[F.lit(x) for kv in entity.items() for x in kv]) if entity else F.create_map().cast("map<string,string>")
    report = report.select("column", F.try_element_at(kinds, F.col("column")).alias("entity"), "label", "n", "n_values")

    def stand_in(label: Column, text: Column, default: Column) -> Column:
        out = default
        for name, items in fakes.items():
            pick = F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(F.lit(salt), text), F.lit(len(items))) + 1).cast("int"))
            out = F.when(label == name, pick).otherwise(out)
        return out

    digest = lambda text: F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, 9)

    def by(s: Column) -> Column:
        tag = F.when(s["label"].isin(*hash_labels), digest(s["text"])).otherwise(F.concat(F.lit("<"), s["label"], F.lit(">")))
        return stand_in(s["label"], s["text"], tag)

    new = {}
    for c in columns:
        text = F.col(c).cast("string")
        new[c] = stand_in(F.lit(entity[c]), text, digest(text)) if c in entity else replaced(text, F.col(at[c]), by)
    return searched.withColumns(new).select(*df.columns), report
