import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ParameterError
from tessera.functions import privacy, scoring
from tessera.functions import text as X
from tessera.operators import correlation as C
from tessera.operators import distribution as D
from tessera.operators import neighbors as N
from tessera.operators import pii
from tessera.operators import profile as P
from tessera.operators import records as G
from tessera.operators import rules as R
from tessera.operators import split as S
from tessera.operators import timeseries as W
from tessera.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_partial_mask_refuses(spark):
    with pytest.raises(ParameterError):
        X.partial_mask(F.lit("a"), 1, "", 1)


def spans(*items):
    return F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(label).alias("label"), F.lit("t").alias("text"), F.lit(1.0).alias("score")) for s, e, label in items])


def islands(given):
    """Overlapping spans one after the other: each island has the label of its longest span, the first of equals."""
    out = []
    for s, e, label in sorted(x for x in given if x[1] > x[0]):
        if out and s < out[-1][1]:
            first, end, best = out[-1]
            out[-1] = (first, max(end, e), (s, e, label) if e - s > best[1] - best[0] else best)
        else:
            out.append((s, e, (s, e, label)))
    return [(s, e, best[2]) for s, e, best in out]


@pytest.mark.parametrize("seed", range(6))
def test_spans_merge_and_redact(spark, seed):
    rng = np.random.default_rng(seed)
    body = "".join(chr(0x3B1 + int(i)) for i in rng.integers(0, 24, 40))
    given = [(int(s), int(s + n), f"l{i}") for i, (s, n) in enumerate(zip(rng.integers(0, 36, seed + 3), rng.integers(-1, 5, seed + 3)))]
    merged = islands(given)
    assert [(r["start"], r["end"], r["label"]) for r in one(spark, pii.merged(spans(*given)))] == merged
    at, want = 0, ""
    for s, e, label in merged:
        want, at = f"{want}{body[at:s]}<{label}>", e
    assert one(spark, pii.redacted(F.lit(body), spans(*given))) == want + body[at:]


def test_recognizers(spark):
    text = "mail a.b@example.com from 10.0.0.256 or 10.0.0.25, call 212-555-0187, card 4111 1111 1111 1111 card 4111 1111 1111 1112"
    found = spark.createDataFrame([(text,), (None,), ("",)], "note string").select(pii.spans("note").alias("s")).collect()
    assert [(s["label"], s["text"]) for s in found[0]["s"]] == [("email", "a.b@example.com"), ("ipv4", "10.0.0.25"), ("phone_number", "212-555-0187"), ("credit_card", "4111 1111 1111 1111")]
    assert found[1]["s"] is None and found[2]["s"] == []


def test_running_statistics(spark):
    r = D.running_statistics(spark.createDataFrame([(1.0,), (3.0,), (-0.1,)], "x double"), ["x"]).first()
    assert (r["n"], round(r["mean"], 4), round(r["m2"], 2), round(r["sd"], 4), r["low"], r["high"]) == (3, 1.3, 4.94, 1.5716, -0.1, 3.0)


@pytest.mark.parametrize(("rows", "share", "most", "expected"), [(200, 0.05, 2000, 10), (200, 0.1, 2000, 20), (200, 20, 2000, 20), (200, 0.2, 10, 10), (200, 0, 2000, 0)])
def test_holdout_size(rows, share, most, expected):
    assert S.holdout_size(rows, share, most) == expected


@pytest.mark.parametrize(("rows", "share"), [(199, 0.05), (200, 9), (200, 0.04)])
def test_holdout_refuses(rows, share):
    with pytest.raises(ParameterError):
        S.holdout_size(rows, share)


def test_group_split_keeps_groups(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("g"), "id")
    train, test = S.split_groups(df, 2, "g")
    assert train.count() + test.count() == 200 and test.select("g").distinct().count() == 2
    assert not {r["g"] for r in train.collect()} & {r["g"] for r in test.collect()}


def test_quality_score(spark):
    raw = scoring.quality_score(F.lit(5.0), F.lit(2.0), F.lit(9.9))
    row = spark.range(1).select(raw.alias("r"), scoring.final_score(raw).alias("s"), scoring.grade(scoring.final_score(raw)).alias("g")).first()
    assert tuple(row) == (5.627, 5.6, "Moderate")


def test_nearest(spark):
    base = spark.createDataFrame([(i, v) for i, v in enumerate([[0.0, 0.0], [3.0, 4.0], [1.0, 0.0], [0.0, 1.0]])], "id long, v array<float>")
    rows = N.nearest(base, base.filter("id = 0"), "id", "v", 4).orderBy("rank").collect()
    assert [r["distance"] for r in rows] == [0.0, 1.0, 1.0, 5.0] and [r["key"] for r in rows] == [0, 2, 3, 1]


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None)] * 3, "a string, b double")
    assert {r["field_type"] for r in P.profile(df).collect()} == {"empty"}
    assert {r["field_type"] for r in P.profile(df.limit(0)).collect()} == {"empty"}


def test_floor_power_of_10(spark):
    got = [one(spark, P.floor_power_of_10(F.lit(float(v)))) for v in (0, 7, 10, 123, 0.05, -5, -100, -123)]
    assert got == pytest.approx([1, 1, 10, 100, 0.01, -10, -100, -1000])


def test_empty_side_distance(spark):
    counts = spark.createDataFrame([("c", "x", 0, 5)], "column string, value string, side int, n long")
    assert D.js_distance(counts, ["column"], "value").first()["distance"] == D.EMPTY_SIDE


def test_constant_columns_do_not_correlate(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert C.pearson(df, [("a", "b")]).first()["r"] == 0.0


def test_interval_with_rollover(spark):
    df = spark.createDataFrame([("g", 0, 82800), ("g", 1, 0), ("g", 2, 3600)], "g string, k int, s long")
    assert [(r["absolute"], r["valid"]) for r in W.cascade(df, "g", "k", "s", 3600, time_only=True).orderBy("k").collect()] == [(82800, True), (86400, True), (90000, True)]


def test_elapsed(spark):
    df = spark.createDataFrame([("A", 0), ("A", 1), ("B", 2), ("B", 3)], "g string, k int")
    assert [r["elapsed"] for r in W.elapsed(df, "g", "k", 60).orderBy("k").collect()] == [0, 60, 0, 60]


def test_validation_kinds(spark):
    schema = {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 3}, "c": {"enum": ["x", None]}}, "required": ["a"]}
    rows = ['{"a": 1, "b": "x", "c": "x"}', '{"b": "x"}', '{"a": "1"}', '{"a": -1}', '{"a": 1, "b": "long"}', '{"a": 1, "c": "y"}', '{"a": 1, "b": null, "c": null, "other": [1]}', "{a}", "[1]", None]
    df = G.validated(spark.createDataFrame(list(enumerate(rows)), "i int, raw string"), "raw", schema)
    assert [r["error_kind"] for r in df.orderBy("i").collect()] == [None, "required", "type", "minimum", "maxLength", "enum", None, "Invalid JSON", "type", "Invalid JSON"]


def test_schema_pattern():
    import re

    p = re.compile(G.schema_pattern({"properties": {"a": {"type": "integer", "minimum": 0, "maximum": 99}, "b": {"enum": ["x", "y"]}}}))
    assert p.fullmatch('{"a": 7, "b": "x"}') and not p.fullmatch('{"a": -7, "b": "x"}') and not p.fullmatch('{"a": 7, "b": "z"}')


def test_unflatten():
    assert G.unflattened({"$.a.b[1]": 5, "$.a['x y']": "t"}) == {"a": {"b": [None, 5], "x y": "t"}}
    with pytest.raises(ParameterError):
        G.unflattened({"$.a[0]": 1, "$.a.b": 2})


def test_rules_refuse_unknown_columns(spark):
    with pytest.raises(ParameterError):
        R.apply_steps(spark.range(1), [{"columns": {"drop": [{"name": "nope"}]}}])


def test_privacy_accounting():
    assert privacy.default_delta(50) == 0.1 / 50 and privacy.default_delta(1000) == 1000**-1.2
    sigma = privacy.noise_multiplier(8.0, 0.01, 1000, 1e-5)
    assert privacy.epsilon_bounds(0.01, sigma, 1000, 1e-5).upper <= 8.0 < privacy.epsilon(0.01, sigma, 1000, 1e-5)
    assert privacy.epsilon(1.0, 10.0, 1, 1e-5) < privacy.epsilon(1.0, 5.0, 1, 1e-5)


def test_streaming_windows_match_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = E.windowed(stream, "ts", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").exceptAll(E.windowed(events, "ts", "1 hour", "event_type")).isEmpty()


def test_streaming_cadence(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 60), ("a", 130), ("a", 190), ("b", 5), ("b", 65)], "g string, s long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = E.cadence(stream, "g", "s", 60).writeStream.outputMode("append").format("memory").queryName("cad").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["g"], r["s"]): r["valid"] for r in spark.table("cad").collect()} == {("a", 0): True, ("a", 60): True, ("a", 130): False, ("a", 190): False, ("b", 5): True, ("b", 65): True}


def test_driver_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_report_scores_all_rows_and_columns(spark, monkeypatch):
    from tessera.operators import report

    # the output differs in rows that the first 5,000 by hash don't have
    base = spark.range(12000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("string").alias("flag"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"))
    late = base.select("key").orderBy(F.xxhash64(F.lit(424242), "key"), "key").offset(5000)
    changed = base.join(late.withColumn("late", F.lit(True)), "key", "left").withColumn("flag", F.when(F.col("late"), "rare").otherwise(F.col("flag"))).drop("late")
    got = {s.component: s.raw for s in report.evaluate(base, changed, "key")}
    part = {s.component: s.raw for s in report.evaluate(base, changed, "key", most_rows=5000)}
    moved = [changed.filter(F.col("flag") == v).count() / 12000 for v in ("0", "1", "rare")]
    term = lambda a, b: a * np.log2(2 * a / (a + b)) if a else 0.0
    flag = np.sqrt(sum(term(p, q) + term(q, p) for p, q in zip((0.5, 0.5, 0.0), moved)) / 2)
    assert part["distribution"] == 0.0 and got["distribution"] == pytest.approx(flag / 3, abs=1e-4)
    wide = spark.range(1).select(F.col("id").alias("key"), *[F.lit(0).alias(f"c{i:03}") for i in range(300)])
    seen = []
    monkeypatch.setattr(report.P, "profile", lambda df: seen.extend(df.columns) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        report.evaluate(wide, wide, "key")
    assert seen == wide.columns[1:]
