import decimal
import json
import math
import os
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import DataError, ParameterError
from tessera.functions import letters, privacy
from tessera.functions import text as text_functions
from tessera.operators import actions as A
from tessera.operators import columns, neighbors, nested, patterns, phrases, pii, profile, recognizers, records, split, timeseries, timings, tokens
from tessera.plans.catalog import ORACLES, QUERIES
from tessera.streaming import batches as B


def gaussian_epsilon(mu, delta):
    """Of the Gaussian mechanism, by its closed form."""
    normal = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    low, high = 0.0, 200.0
    for _ in range(200):
        e = (low + high) / 2
        low, high = (e, high) if normal(mu / 2 - e / mu) - math.exp(e) * normal(-mu / 2 - e / mu) > delta else (low, e)
    return high


@pytest.mark.parametrize(("sigma", "steps", "delta"), [(5, 10, 1e-5), (20, 100, 1e-6), (2, 1, 1e-5), (50, 1000, 1e-4)])
def test_epsilon_of_the_gaussian_mechanism(sigma, steps, delta):
    found, true = privacy.epsilon_bounds(1.0, sigma, steps, delta), gaussian_epsilon(math.sqrt(steps) / sigma, delta)
    assert found.lower <= true <= found.upper and found.upper - found.lower < 0.03 and found.upper <= privacy.epsilon(1.0, sigma, steps, delta) + 0.01


@pytest.mark.parametrize(("q", "sigma", "steps"), [(0.01, 1.0, 1000), (0.001, 0.8, 5000), (0.1, 2.0, 300), (0.5, 3.0, 20)])
def test_epsilon_of_sampled_steps(q, sigma, steps):
    found = privacy.epsilon_bounds(q, sigma, steps, 1e-5)
    assert 0 <= found.lower <= found.estimate <= found.upper <= privacy.epsilon(q, sigma, steps, 1e-5) + 0.01
    finer = privacy.epsilon_bounds(q, sigma, steps, 1e-5, error=0.003)
    assert found.lower <= finer.upper and finer.lower <= found.upper  # both hold the true value


def test_one_sampled_step_by_integration():
    """delta of one step is an integral; epsilon's bounds have to lie on both sides of it."""
    q, sigma, delta = 0.2, 0.9, 1e-3
    x = np.linspace(-15, 16, 2_000_001)
    density = lambda c: np.exp(-((x - c) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    with_it, without = (1 - q) * density(0) + q * density(1), density(0)
    tail = lambda e: max(float(np.maximum(a - math.exp(e) * b, 0).sum() * (x[1] - x[0])) for a, b in ((with_it, without), (without, with_it)))
    found = privacy.epsilon_bounds(q, sigma, 1, delta)
    assert tail(found.upper) <= delta <= tail(max(found.lower - 1e-3, 0))


def test_noise_for_a_target():
    sigma = privacy.noise_multiplier(3.0, 0.02, 200, 1e-5, tolerance=0.02)
    assert privacy.epsilon_bounds(0.02, sigma, 200, 1e-5).upper <= 3.0 < privacy.epsilon_bounds(0.02, sigma * 0.95, 200, 1e-5).upper
    assert privacy.epsilon(0.02, sigma, 200, 1e-5) > 3.0  # the moments alone ask for more noise
    with pytest.raises(ParameterError):
        privacy.epsilon_bounds(0.0, 1.0, 1, 1e-5)


@pytest.mark.parametrize("seed", range(40))
def test_integer_patterns(seed):
    rnd = random.Random(seed)
    low, high = sorted(rnd.randint(-10 ** rnd.randint(0, 4), 10 ** rnd.randint(0, 4)) for _ in range(2))
    p = re.compile(patterns.integers(low, high))
    assert all(bool(p.fullmatch(str(i))) == (low <= i <= high) for i in range(low - 1100, high + 1100))
    up, down = re.compile(patterns.integers(low, None)), re.compile(patterns.integers(None, high))
    for i in [rnd.randint(-(10**6), 10**6) for _ in range(500)] + list(range(low - 20, low + 20)) + list(range(high - 20, high + 20)):
        assert bool(up.fullmatch(str(i))) == (i >= low) and bool(down.fullmatch(str(i))) == (i <= high)
    assert not any(p.fullmatch(s) for s in ("", "-", "-0", "00", f"0{high}", "+1", f"{low}.0"))


def test_integer_patterns_of_large_and_empty_ranges():
    p = re.compile(patterns.integers(3, 10**18 + 7))
    assert p.fullmatch(str(10**18 + 7)) and not p.fullmatch(str(10**18 + 8)) and len(p.pattern) < 2000
    assert not re.fullmatch(patterns.integers(5, 4), "5") and re.fullmatch(patterns.integers(0, 0), "0")


def test_record_patterns():
    schema = {"properties": {"a": {"type": "integer", "minimum": 2, "maximum": 31}, "b": {"type": "string", "maxLength": 3}, "c": {"enum": ["é", None, 1.5]}, "d": {"type": "array", "items": {"type": "boolean"}, "minItems": 1, "maxItems": 3}}, "required": ["b"]}
    p = re.compile(patterns.records_pattern(schema, single=True))
    whole = {"a": 7, "b": "xy", "c": "é", "d": [True, False]}
    for n in range(16):
        part = {k: v for i, (k, v) in enumerate(whole.items()) if n >> i & 1}
        for separators in ((",", ":"), (", ", ": ")):
            assert bool(p.fullmatch(json.dumps(part, separators=separators))) == ("b" in part), part
    for key, bad in (("a", 32), ("a", -3), ("a", 2.5), ("b", "long"), ("c", "e"), ("d", []), ("d", [True] * 4), ("d", [1])):
        assert not p.fullmatch(json.dumps(whole | {key: bad})), (key, bad)
    assert p.fullmatch(json.dumps(whole | {"c": None, "d": [False] * 3}, ensure_ascii=False))
    none_needed = re.compile(patterns.records_pattern({"properties": {"a": {"type": "integer"}, "b": {"type": "null"}, "c": {"type": "number"}}}, single=True))
    for part in ({}, {"a": 1}, {"b": None}, {"c": -1.5e3}, {"a": 1, "c": 2}, {"a": 1, "b": None}, {"b": None, "c": 0}, {"a": 1, "b": None, "c": 3}):
        assert none_needed.fullmatch(json.dumps(part)), part
    assert not none_needed.fullmatch('{"c": 1, "a": 2}') and not none_needed.fullmatch('{"a": 1,}') and not none_needed.fullmatch('{,"a": 1}')
    groups = re.compile(patterns.records_pattern({"properties": {"a": {"type": "integer"}}, "required": ["a"]}, "<s>", "</s>"))
    assert groups.fullmatch('<s>{"a": 1}\n{"a": 2}\n</s>\n<s>{"a": 3}\n</s>\n') and not groups.fullmatch("<s></s>\n")
    dates = re.compile(patterns.schema_pattern_of({"type": "string", "format": "date-time"}))
    assert dates.fullmatch('"2024-02-29T23:59:60Z"') is None and dates.fullmatch('"2024-02-29T23:59:59+01:00"')
    with pytest.raises(ParameterError):
        patterns.schema_pattern_of({"type": "string", "minLength": 3, "maxLength": 2})


def naive_matches(text, listed):
    word = lambda c: c.isalnum() or c == "_"
    out = set()
    for phrase, label, _, cased in listed:
        body, p = (text, phrase) if cased else (phrases.lowered(text), phrases.lowered(phrase))
        at = body.find(p)
        while at >= 0:
            end = at + len(p)
            if not (at and word(text[at - 1]) and word(text[at])) and not (end < len(text) and word(text[end]) and word(text[end - 1])):
                out.add((at, end, label, text[at:end]))
            at = body.find(p, at + 1)
    return out


@pytest.mark.parametrize("most", [10**9, 60])
def test_phrases_as_naive_search(spark, most, monkeypatch):
    """Also with a list that is dealt over parts."""
    monkeypatch.setattr(phrases, "MOST_ROWS", 30)
    rnd = random.Random(4)
    letters = "abAB é_İ-."
    listed = list({("".join(rnd.choices(letters, k=rnd.randint(1, 4))), rnd.choice("xy"), 0.5, rnd.random() < 0.5) for _ in range(60)})
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, text string, key string").repartition(3)
    table = spark.createDataFrame(listed, "phrase string, label string, score double, cased boolean")
    got = phrases.phrase_matches(df, "id", "text", table, most).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["start"], r["end"], r["label"], r["text"]))
    for i, t in enumerate(texts):
        assert len(by.get(i, [])) == len(set(by.get(i, []))) and set(by.get(i, [])) == (naive_matches(t, listed) if t else set())
    assert phrases.phrase_matches(df, "id", "text", table.limit(0)).count() == 0


def test_long_phrase_list_is_held_nowhere(spark, monkeypatch):
    """Of a list above a million characters the driver gets a filter's pieces and lengths, not the phrases."""
    from pyspark.sql.classic.dataframe import DataFrame

    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: [rows := collect(df), got.append(len(rows))][0])
    listed = spark.range(30_000).select(F.concat(F.lit("number "), "id", F.lit(" of the list of phrases: "), F.expr("id * id"), F.lit(" (end)")).alias("phrase"))
    docs = spark.range(400).select("id", F.concat(F.lit("_ number "), "id", F.lit(" of the list of phrases: "), F.expr("id * id + id % 2"), F.lit(" (end)x, "), F.repeat(F.lit("é_ "), F.lit(50))).alias("text"))
    found = phrases.phrase_matches(docs, "id", "text", phrases.phrase_table(listed))
    assert max(got, default=0) < 1000
    rows = {r["id"]: (r["start"], r["text"]) for r in found.collect()}
    assert rows == {i: (2, f"number {i} of the list of phrases: {i * i} (end)") for i in range(0, 400, 2)}


def test_hundred_thousand_phrases(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("text IS NOT NULL")
    words = [w for r in docs.limit(100).collect() for w in r["text"].split()]
    listed = list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n)))[:100_000]
    listed += [f"absent {i} {i % 7}" for i in range(100_000 - len(listed))]
    table = spark.createDataFrame([(p,) for p in listed], "phrase string")
    got = phrases.phrase_matches(docs, "doc_id", "text", phrases.phrase_table(table)).filter("doc_id < 3").collect()
    for r in docs.filter("doc_id < 3").collect():
        here = [(p, "phrase", 0.8, True) for p in listed if p in r["text"]]
        assert {(x["start"], x["end"], "phrase", x["text"]) for x in got if x["doc_id"] == r["doc_id"]} == naive_matches(r["text"], here)


def test_lists_from_a_configuration(spark, tmp_path):
    (tmp_path / "towns.txt").write_text("Bad Münder\nUlm\n\nUlm\n")
    (tmp_path / "own.yaml").write_text("namespace: acme\nregex:\n  Order_No:\n    patterns:\n    - {score: med, regex: 'O-\\d{4}'}\n    - {score: high, regex: '\\d{4}', header_match: '^order', header_skip: [date]}\nphrase:\n  town:\n    paths:\n    - {path: towns.txt, case: no}\n")
    found, listed = phrases.from_yaml(tmp_path / "own.yaml")
    assert listed == [("Bad Münder", "acme/town", 0.8, False), ("Ulm", "acme/town", 0.8, False)]
    df = spark.createDataFrame([("O-1234 in ULM, 5678", "5678", "5678")], "note string, order_id string, order_date string")
    row = df.select(*[pii.spans(c, tuple(found)).alias(c) for c in df.columns], phrases.phrase_spans("note", listed).alias("towns")).first()
    assert [(s["label"], s["text"], s["score"]) for s in row["note"]] == [("acme/order_no", "O-1234", 0.5)]
    assert [s["text"] for s in row["order_id"]] == ["5678"] and row["order_date"] == [] and [(s["start"], s["text"]) for s in row["towns"]] == [(10, "ULM")]
    for bad in ({"namespace": "a"}, {"regex": {}}, {"namespace": "abc", "regex": {"x": {"patterns": [{"score": "top", "regex": "a"}]}}}, {"namespace": "abc", "phrase": {"x": {"paths": [{"path": "nowhere"}]}}}):
        with pytest.raises(ParameterError):
            phrases.from_config(bad, tmp_path)
    tokens = [{"label": "ORG", "pattern": [{"LOWER": "smith"}, {"LOWER": "&"}, {"LOWER": "sons"}]}, {"label": "GPE", "pattern": "Kiel"}, {"label": "NO", "pattern": "x"}]
    assert phrases.token_patterns(tokens, {"ORG": "firm", "GPE": "place"}) == [("smith& sons", "firm", 0.8, False), ("Kiel", "place", 0.8, True)]


def test_draws_take_records_in_turn(spark):
    rows = spark.createDataFrame([(f"e{i % 7}", 100 + i) for i in range(40)], "e string, r int")
    entities = rows.select("e").distinct()
    steps = split.shuffled_batches(entities, "e", 3, passes=4, seed=2)
    by_step = {}
    for r in steps.collect():
        by_step.setdefault(r["step"], []).append(r["e"])
    assert sorted(by_step) == list(range(8)) and all(len(set(b)) == 3 for b in by_step.values())  # 7 entities: 2 batches a pass, one is left out
    assert all(len(set(by_step[2 * p]) & set(by_step[2 * p + 1])) == 0 for p in range(4))
    drawn = split.drawn_rows(steps, rows, "e", "r").collect()
    of = {}
    for r in sorted(drawn, key=lambda r: r["step"]):
        of.setdefault(r["e"], []).append(r["r"])
    for e, taken in of.items():
        records = sorted(100 + i for i in range(40) if f"e{i % 7}" == e)
        assert taken == [records[i % len(records)] for i in range(len(taken))]


def test_column_sets_are_all_there_are():
    columns = [f"c{i}" for i in range(7)]
    every = split.column_sets(columns, 3, 10**6)
    assert len(set(every)) == 35 == len(every) and all(list(s) == sorted(s) for s in every)
    few = split.column_sets([f"c{i:03}" for i in range(800)], 5, 50)
    assert len(set(few)) == 50 and max(c for s in few for c in s) > "c600" and len({s[0] for s in few}) > 5


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize(("cell", "skip"), [(20, True), (20, False), (10_000, True)])
def test_nearest_as_all_pairs(spark, monkeypatch, metric, cell, skip):
    """Clustered, repeated and zero vectors; ties by key; more neighbours wanted than a cell has."""
    monkeypatch.setattr(neighbors, "CELL", cell)
    monkeypatch.setattr(neighbors, "VISITS", 40)
    monkeypatch.setattr(neighbors, "TILE", 500)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (-5, 0, 5)] + [np.zeros((5, 3)), np.tile(rng.normal(size=(1, 3)), (40, 1)), rng.integers(-1, 2, (60, 3))]).astype(np.float32)
    df = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id int, v array<float>")
    keys, b = np.array([1000 - i for i in range(len(x))]), x.astype(np.float64)
    k = 7
    got = {}
    for r in neighbors.nearest(df, df.filter("id % 3 = 0"), "id", "v", k, metric, skip).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], r[3]))
    if metric == "cosine":
        n = np.linalg.norm(b, axis=1, keepdims=True)
        b = b / np.where(n == 0, 1, n)
    assert set(got) == set(keys[keys % 3 == 0].tolist())
    for i in np.flatnonzero(keys % 3 == 0):
        cost = -(b @ b[i]) if metric == "cosine" else ((b - b[i]) ** 2).sum(1)
        others = np.flatnonzero((keys != keys[i]) | (not skip))
        best = others[np.lexsort((keys[others], np.round(cost[others], 9)))][:k]
        mine = sorted(got[keys[i]])
        assert [r for r, _, _ in mine] == list(range(1, k + 1))
        assert np.allclose([v for _, _, v in mine], -cost[best] if metric == "cosine" else np.sqrt(cost[best]), atol=1e-6)
        if metric == "l2":
            assert [key for _, key, _ in mine] == keys[best].tolist()


def tenths(x):
    return float(decimal.Decimal(repr(x)).quantize(decimal.Decimal("0.1"), decimal.ROUND_HALF_EVEN))


def test_attacks_are_counted_once(spark):
    rnd = random.Random(3)
    rows = [(i % 2, rnd.random() < 0.4, rnd.choice([0.0, 0.1, 0.25, 0.5, 1.0, 2.0]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "run int, member boolean, d double, i int")
    thresholds, shares = (0.4, 0.2, 0.05), (0.3, 0.55, 1.0)
    got = {(r["run"], r["threshold"], r["share"]): (r["tp"], r["fp"], r["precision"], r["accuracy"]) for r in neighbors.membership_attacks(df, "run", F.col("i"), "member", "d", thresholds, shares).collect()}
    for run in (0, 1):
        mine = sorted((r for r in rows if r[0] == run), key=lambda r: r[3])
        top = max(r[2] for r in mine)
        for t in thresholds:
            for s in shares:
                part = mine[: math.floor(s * len(mine))]
                tp, fp, tn = (sum((r[2] / top < t) == c and r[1] == m for r in part) for c, m in ((True, True), (True, False), (False, False)))
                assert got[run, t, s] == (tp, fp, tenths(tp / (tp + fp)) if tp + fp else 0.0, tenths((tp + tn) / len(part)))


@pytest.fixture
def lines(tmp_path):
    """Six files, one a batch; every third file has invalid records only."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(i):
        (folder / f"{i}.json").write_text("".join(json.dumps({"id": 10 * i + k, "x": -1 if i % 3 == 2 else k}) + "\n" for k in range(10)))

    return folder, put


def started(spark, folder, sink, checkpoint, heartbeat=None):
    stream = spark.readStream.schema("id long, x long").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))
    stream = B.observed(stream, F.col("x") >= 0) if heartbeat else stream
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()


def test_batches_are_written_once(spark, tmp_path, lines):
    folder, put = lines
    out, checkpoint, rules = str(tmp_path / "out"), tmp_path / "checkpoint", (A.DropWhere(("x < 0",)),)
    sink = lambda: B.BatchSink(spark, out, rules, total=30)
    for i in range(3):
        put(i)
    assert started(spark, folder, sink(), checkpoint).awaitTermination(120)
    # the last commit is lost, as if the driver had died before it: its batch is replayed
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for p in (checkpoint / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    for i in range(3, 6):
        put(i)
    again = sink()
    assert started(spark, folder, again, checkpoint).awaitTermination(120)
    rows = again.rows().collect()
    assert sorted(r["id"] for r in rows) == list(range(60))
    assert {r["id"] for r in rows if r["reject_reason"]} == {r["id"] for r in rows if r["x"] < 0}
    ledger = sorted(map(tuple, again.ledger().select("batch_id", "n", "n_valid").collect()))
    assert [n for n, _, _ in ledger] == list(range(len(ledger))) and sum(n for _, n, _ in ledger) == 60 and sum(v for _, _, v in ledger) == 40
    assert {p: again.snapshot(p).count() for p in (25, 50, 75)} == {25: 10, 50: 20, 75: 30}
    # a batch that stopped half-way leaves rows that nobody sees, and is written over
    spark.createDataFrame([(999, 1, None)], "id long, x long, reject_reason string").write.parquet(f"{out}/rows/batch_id=77")
    assert sink().rows().filter("id = 999").count() == 0
    sink()(spark.createDataFrame([(1000, 1)], "id long, x long"), 77)
    sink()(spark.createDataFrame([(1001, 1)], "id long, x long"), 77)
    assert [r["id"] for r in sink().rows().filter("batch_id = 77").collect()] == [1000]


def test_a_query_ends_by_its_rule(spark, tmp_path, lines):
    folder, put = lines
    for i in range(12):
        (folder / f"{i}.json").write_text("".join(json.dumps({"id": 10 * i + k, "x": 1 if i < 2 else -1}) + "\n" for k in range(10)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files come by their times
    heart = B.Heartbeat(B.StopRule(0.4, 3))
    spark.streams.addListener(heart)
    try:
        slow = lambda batch, n: (batch.count(), __import__("time").sleep(0.8))
        query = started(spark, folder, slow, tmp_path / "c", heart)
        assert B.awaited(query, heart, 180) == "stopped" and not query.isActive
    finally:
        spark.streams.removeListener(heart)
    # shares 0, 0, 1/3, 1/2, 3/5, 2/3: the third batch in a row from 0.4 on is the sixth
    beats = heart.table(spark).orderBy("batch_id").collect()
    assert 6 <= len(beats) < 12 and [(r["batch_id"], r["n"], r["n_valid"]) for r in beats[:6]] == [(i, 10, 10 if i < 2 else 0) for i in range(6)]
    rule = B.StopRule(0.5, 2)
    assert [rule.add(10, v) for v in (10, 0, 10, 0, 0)] == [False, False, False, False, True] and B.StopRule(1.0, 1).add(0, 0)


def test_snapshots_that_fall_together():
    assert B.thresholds(2) == {1: 25, 2: 75} and B.thresholds(0) == {} and B.thresholds(10) == {3: 25, 5: 50, 8: 75}


def test_timings_merge_and_sum_up(spark, small):
    rng = np.random.default_rng(0)
    values = rng.gamma(2, size=50).tolist()
    total = timings.moments(values[:1])
    for part in (values[1:7], values[7:40], values[40:]):
        total = timings.merged_moments(total, timings.moments(part))
    assert total[0] == 50 and np.allclose(total[1:], (statistics.mean(values), statistics.variance(values) * 49, max(values)))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    chosen = tuple(recognizers.selected(recognizers.RECOGNIZERS, ["email", "ipv4", "phone_number"]))
    took, run = timings.Timings(spark), timings.RunSummary(spark)
    with run.stage("search"):
        found = run.counted(docs.select("doc_id", pii.spans("text", chosen, timings=took).alias("s")), "search", F.sum(F.size("s")).alias("spans"))
        rows = found.collect()
    with pytest.raises(ZeroDivisionError), run.stage("broken"):
        1 / 0
    table = {r["name"]: r for r in took.table().collect()}
    hits = {r.label: docs.filter(F.col("text").rlike(r.hint)).count() for r in chosen}
    assert {n: r["n"] for n, r in table.items()} == hits and all(r["largest"] >= r["mean"] > 0 and abs(r["seconds"] - r["mean"] * r["n"]) < 1e-9 for r in table.values())
    stages = {r["stage"]: r for r in run.table().collect()}
    assert stages["search"]["rows"] == len(rows) and stages["search"]["facts"]["spans"] == sum(len(r["s"] or []) for r in rows)
    assert stages["broken"]["status"] == "failed" and stages["broken"]["rows"] is None and stages["search"]["seconds"] > 0


def deep_merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = deep_merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def test_nested_values_merge(spark):
    rnd = random.Random(8)

    def value(depth):
        kind = rnd.choice("osnaxob") if depth else rnd.choice("snxb")
        return {"o": lambda: {rnd.choice("abcd"): value(depth - 1) for _ in range(rnd.randint(0, 3))}, "s": lambda: rnd.choice(["1", "x"]), "n": lambda: rnd.randint(0, 3), "a": lambda: [value(depth - 1)], "x": lambda: None, "b": lambda: True}[kind]()

    pairs = [({rnd.choice("abcd"): value(3) for _ in range(3)}, {rnd.choice("abcd"): value(3) for _ in range(3)}) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: json.loads(r["m"]) for r in df.select("i", F.to_json(nested.merged_json(F.col("a"), F.col("b"))).alias("m")).collect()}
    assert got == {i: deep_merge(a, b) for i, (a, b) in enumerate(pairs)}
    odd = spark.createDataFrame([(0, None, '{"a": 1}'), (1, '{"a": 1}', None), (2, "[1]", '{"b": 2}'), (3, '{"b": 2}', "7"), (4, "{", "{")], "i int, a string, b string")
    assert [r["m"] for r in odd.select(F.to_json(nested.merged_json(F.col("a"), F.col("b"))).alias("m"), "i").orderBy("i").collect()] == ['{"a":1}', '{"a":1}', '{"b":2}', "7", None]
    flat = spark.createDataFrame([('[1, [2, ["x", {"k": [1]}]], []]',), ('"s"',), (None,), ("[1, [2]]",)], "j string").select(nested.leaves(F.try_parse_json("j")).alias("l"), nested.all_of_type(F.try_parse_json("j"), "BIGINT").alias("ints"))
    assert [(r["n"], r["ints"]) for r in flat.select(F.size("l").alias("n"), "ints").collect()] == [(4, False), (1, False), (None, None), (2, True)]


def test_letters_become_ascii(spark):
    cases = {"Ærøskøbing": "Aeroskobing", "Щука ёж": "Shchuka yozh", "Θεσσαλονίκη": "Thessaloniki", "ﬁn Ångström": "fin Angstrom", "Łódź": "Lodz", "İstanbul": "Istanbul", "東京 x": " x", "été": "ete", "“q” – €5": '"q" - EUR5', "plain": "plain", "": ""}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", letters.ascii_of(F.col("t")).alias("a"))
    assert {r["t"]: r["a"] for r in df.collect()} == cases | {None: None}
    table = letters.ascii_table()
    assert all(a.isascii() for a in table.values()) and all(table[c.upper()].lower() == table[c].lower() for c in "æøłжщψθ")
    every = spark.range(1, 0x3000).filter("id NOT BETWEEN 55296 AND 57343").select("id", letters.ascii_of(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")).alias("a")).collect()
    assert all(r["a"] == (chr(r["id"]) if r["id"] < 128 else table.get(chr(r["id"]), "")) for r in every)


def test_tokens_within_a_budget(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 9)], "i int, t string").transform(lambda d: tokens.tokenized(d, "t"))
    assert {r["i"]: len(r["input_ids"]) for r in df.collect()} == {1: 3, 2: 0, 3: 9}
    cut = tokens.within_budget(df, "input_ids", 20, 10, "cut").orderBy("i").collect()
    assert [(r["n_tokens"], r["fits"]) for r in cut] == [(3, True), (0, True), (6, False)] and cut[2]["input_ids"] == df.filter("i = 3").first()["input_ids"][:6]
    assert tokens.within_budget(df, "input_ids", 23, 10).count() == 3
    assert tokens.token_statistics(tokens.within_budget(df, "input_ids", 20, 10, "mark")).first()["high"] == 9
    with pytest.raises(DataError, match="1 records"):
        tokens.within_budget(df, "input_ids", 20, 10)
    with pytest.raises(ParameterError):
        tokens.budget_of(8, 9)


def test_small_operators(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, y int")
    right = spark.createDataFrame([(2, 7, 1.0), (3, 8, 2.0)], "k int, y int, z double")
    assert sorted(map(tuple, columns.side_by_side(left, right, "k").collect())) == [(1, "a", None, None), (2, "b", 5, 1.0), (3, None, 8, 2.0)]
    day = A.DateFormat("d")
    dates = spark.createDataFrame([(f"{i:02}.03.2024",) for i in range(1, 25)] + [("junk!",), ("2024-01-01",), (None,)] + [(f"x{'y' * i}1",) for i in range(30)], "d string")
    done = A.validated(A.finished(dates, [day]), [day])
    assert day.format_of(dates) == "dd.MM.yyyy" and done.filter("reject_reason IS NULL").count() == 24
    found = spark.createDataFrame([(1, "mail a@example.org")], "i int, t string").withColumn("s", pii.spans("t"))
    record = json.loads(pii.response_json(found, F.col("s"), "i", "t").first()["value"])
    assert record["data"] == {"i": 1, "t": "mail a@example.org"} and [e["label"] for e in record["model_metadata"]["entities"]] == ["email"] and record["model_metadata"]["labels"]["high"] == ["email"]
    text = spark.createDataFrame([(1, '<s>{"t": 0}\n{"t": 9}\n</s>')], "i int, body string")
    schema = {"properties": {"t": {"type": "integer"}}, "required": ["t"]}
    assert "group_no" in records.response_processor(schema, group="t")(text, "i", "body").columns
    assert [r["is_valid"] for r in records.response_processor(schema, timestamp="t", interval=5)(text, "i", "body").orderBy("record_no").collect()] == [True, False]
    assert [r["is_valid"] for r in records.response_processor(schema)(text, "i", "body").collect()] == [True, True]
    raw = spark.createDataFrame([(bytearray(b"ok\xff\xc3\xa9"),), (bytearray("fine�".encode()),)], "b binary")
    assert [r["t"] for r in raw.select(text_functions.scrubbed(F.col("b")).alias("t")).collect()] == ["oké", "fine�"]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_inside_a_cell_as_all_pairs(monkeypatch, spread):
    """Clusters, where few of the smaller cells are seen, and a cloud, where most are; ties by key; limits that leave out."""
    monkeypatch.setattr(neighbors, "INNER", 8)
    monkeypatch.setattr(neighbors, "TILE", 4000)
    rng = np.random.default_rng(4)
    x = np.unique(np.round(np.concatenate([rng.normal(c, spread, (300, 2)) for c in range(-20, 21, 5)]), 2), axis=0)
    rng.shuffle(x)
    sizes = rng.integers(1, 4, len(x))
    keys = rng.permutation(sizes.sum())
    of = np.repeat(np.arange(len(x)), sizes)
    y, k = np.concatenate([x[:400], rng.normal(0, 15, (200, 2))]), 5
    cost = ((y[:, None] - x[None, of]) ** 2).sum(2)
    want = [keys[o := np.lexsort((keys, cost[i]))[:k]].tolist() for i in range(len(y))]
    kth = np.sqrt(np.sort(cost, axis=1)[:, k - 1])
    seen = []
    tile = neighbors.best_of_tile
    monkeypatch.setattr(neighbors, "best_of_tile", lambda a, b, c, q, n: (seen.append(len(a) * len(q)), tile(a, b, c, q, n))[1])
    for limit in (np.full(len(y), np.inf), kth):
        got = {}
        for r, key, d in neighbors.best_of_cell(x, keys, sizes, y, k, limit):
            for i, j in zip(r.tolist(), key.tolist()):
                got.setdefault(i, []).append(j)
        assert [got[i] for i in range(len(y))] == want
    assert spread > 1 or sum(seen) < len(x) * len(y)  # of both searches together


@pytest.mark.parametrize("test", [0.2, 5, 40])
def test_group_split_as_all_orders_ranked(spark, monkeypatch, test):
    """Of 20 hash orders, each ranked whole, the nearest to the target; and no table of groups times orders is shuffled."""
    monkeypatch.setattr(split, "first_by_hash", None)
    df = spark.createDataFrame([(f"g{i % 37 % (i % 5 + 8)}", i) for i in range(300)], "g string, i int")
    sizes = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count("i").alias("n")).collect()}
    share = test if test <= len(sizes) else split.DEFAULT_SHARE
    take = int(share) if share > 1 else max(1, math.ceil(len(sizes) * share))
    target = share if share > 1 else round(300 * share)
    tried = df.select("g").distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("g", "a", F.xxhash64(F.lit(1), "a", "g").alias("h")).collect()
    sides = [[r["g"] for r in sorted((r for r in tried if r["a"] == a), key=lambda r: (r["h"], r["g"]))[:take]] for a in range(20)]
    want = min(sides, key=lambda s: abs(sum(sizes[g] for g in s) - target))
    left, right = split.split_groups(df, test, "g")
    assert {r["g"] for r in right.collect()} == set(want) and right.count() == sum(sizes[g] for g in want) and left.count() + right.count() == 300


def test_profile_holds_one_column_at_a_time(spark):
    """Facts of repeated, null, zero and nested values; and no row is copied for each column, as a plan with Expand does."""
    rows = [(1, "a b c d", -0.0, {"k": 1}), (1, "a b c d", 0.0, {"k": 1}), (2, None, float("nan"), None), (None, "xy", 3.5, {"k": 2})]
    df = spark.createDataFrame(rows, "i int, t string, d double, m map<string,int>")
    made = profile.profile(df)
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column"]: (r["n_rows"], r["n_missing"], r["n_distinct"], r["low"], r["high"], r["mean_length"], r["mean_blanks"]) for r in made.collect()}
    assert got == {"i": (4, 1, 2, 1.0, 2.0, None, None), "t": (4, 1, 2, None, None, 16 / 3, 2.0), "d": (4, 1, 2, 0.0, 3.5, None, None), "m": (4, 1, 2, None, None, None, None)}


def test_patience_at_the_threshold_itself(spark, tmp_path):
    """Means of exactly 0.4 whose sums of doubles are below it; the query over such batches as its SQL."""
    rates = [0.1, 0.7, 0.4, None, 0.3, 0.5, 0.2]
    got = timeseries.patience_reached(spark.createDataFrame(list(enumerate(rates)), "i int, x double"), "i", "x", 0.4, 2).orderBy("i").collect()
    assert [(r["running_mean"], r["run"], r["stop"]) for r in got] == [(0.1, 0, False), (0.4, 1, False), (0.4, 2, True), (0.4, 3, True), (0.375, 0, False), (0.4, 1, False), (0.366666667, 0, False)]
    (tmp_path / "sf").mkdir()
    bad = [50, 350, 200, 133, 267, 200, 7, 393, 200, 200]
    rows = [(500 * b + i, "error" if i < n else "view") for b, n in enumerate(bad) for i in range(500)] + [(5000 + i, "click" if i < 1 else "view") for i in range(3)]
    spark.createDataFrame(rows, "event_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    import glob

    import duckdb

    sql = ORACLES["stop_condition_scan"]
    duckdb_rows = duckdb.connect()
    duckdb_rows.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{glob.glob(f'{tmp_path}/sf/events.parquet/*.parquet')[0]}')")
    want = sorted(duckdb_rows.sql(sql).fetchall())
    mine = sorted(tuple(r) for r in QUERIES["stop_condition_scan"](spark, f"{tmp_path}/sf").collect())
    assert mine == want and [r[2] for r in mine] == [0, 1, 2, 0, 1, 2, 0, 1, 2, 3, 0]
