import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ParameterError
from tessera.functions import dates
from tessera.functions import text as X
from tessera.operators import encoding, ordered, pii, privacy, recognizers, report, rules


def test_partial_mask_of_all_lengths(spark):
    """What stays of a value, by taking characters off in turn until enough is hidden."""
    cases = [(n, left, right, t) for n in range(0, 12) for left in range(0, 5) for right in range(0, 5) for t in (0, 1, 3)]
    rows = spark.createDataFrame([("abcdefghijkl"[:n],) for n in range(12)], "v string")
    columns = {(left, right, t): X.partial_mask(F.col("v"), left, "*", right, t) for _, left, right, t in cases}
    got = {len(r["v"]): r for r in rows.select("v", *[c.alias(repr(k)) for k, c in columns.items()]).collect()}
    for n, left, right, t in cases:
        a, b, turn = left, right, 0
        while a + b and a + b >= n - t:
            if (turn % 2 == 0 and a) or not b:
                a -= 1
            else:
                b -= 1
            turn += 1
        v = "abcdefghijkl"[:n]
        assert got[n][repr((left, right, t))] == v[:a] + "*" + v[n - b :], (n, left, right, t)


@pytest.mark.parametrize(("shape", "first"), [
    ("9999-99-99T99:99:99Z", "yyyy-MM-dd'T'HH:mm:ssXXX"), ("99/99/9999", "MM/dd/yyyy"), ("9/9/99", "M/d/yy"), ("99.99.9999 99:99", "MM.dd.yyyy HH:mm"), ("AAA 9, 9999", "MMM d, yyyy"), ("99:99:99.999", "HH:mm:ss.SSS"), ("99999999", "yyyyMMdd"), ("9999-99-99 99:99:99+99:99", "yyyy-MM-dd HH:mm:ssXXX"),
])
def test_formats_of_shapes(shape, first):
    assert dates.candidates(shape)[0] == first


def test_formats_that_fit_no_shape():
    assert dates.candidates("AAAA") == [] and dates.candidates("9-9") == [] and dates.candidates("99999-9-9") == []


def test_header_words():
    assert recognizers.header_tokens("customerZipCode_2") == ["customer", "zip", "code"]
    phone = [r for r in recognizers.RECOGNIZERS if r.label == "phone_number"][0]
    assert phone.names("homePhone") and not phone.names("microphone")
    assert {r.label for r in recognizers.selected(recognizers.RECOGNIZERS, ["*_key"])} == {"stripe_key", "square_key", "twilio_key", "sendgrid_key", "google_key", "generic_key"}
    found = recognizers.phrases("city", ["New York", "York", "A+B"])
    assert [m.group() for m in re.finditer(found.pattern, "York, New York, A+B, Yorkshire")] == ["York", "New York", "A+B"]


def test_spans_as_brute_force(spark, small):
    """All recognisers over every document, without the native prefilter."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "\n\t a.b@example.org \r")], "doc_id long, text string"))
    got = {r["doc_id"]: None if r["s"] is None else {(s["start"], s["end"], s["label"]) for s in r["s"]} for r in docs.select("doc_id", pii.spans("text").alias("s")).collect()}
    for r in docs.collect():
        if r["text"] is None:
            assert got[r["doc_id"]] is None
            continue
        text, want = r["text"].strip(" \t\n\r\x0b\x0c"), set()
        for x in recognizers.RECOGNIZERS:
            if not x.applies("text"):
                continue
            for m in re.finditer(x.pattern, text) if not x.whole else filter(None, [re.fullmatch(x.pattern, text)]):
                near = any(c in pii._near(text, *m.span(), 16) for c in x.context)
                if (not x.valid or x.valid(m.group())) and (near or not x.context_only):
                    want.add((*m.span(), x.label))
        assert got[r["doc_id"]] == want
    assert got[-2] == {(0, 15, "email")}


def test_variables_are_bound_not_pasted(spark):
    df = spark.createDataFrame([("O'Neil", 1), ("this", 2)], "name string, n int")
    step = {"vars": {"top": "max(name)", "day": "date'2024-02-29'", "first": "min(name)"}, "rows": {"update": [{"name": "name", "condition": "this = var_first", "value": "concat(this, ' this ', cast(var_day as string))"}]}}
    assert [r["name"] for r in rules.apply_steps(df, [step]).orderBy("n").collect()] == ["O'Neil this 2024-02-29", "this"]
    with pytest.raises(ParameterError):
        rules.apply_steps(df.withColumnRenamed("n", "this"), [step])


def test_ranks_and_sums_over_ranges(spark):
    rows = [(i * 7919 % 1000, "g" if i % 3 else None, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, g string, x int")
    got = ordered.running_sum(df.withColumn("no", F.monotonically_increasing_id()), ["g"], F.col("x"), ["k", "no"], F.col("k").cast("double"), "before").collect()
    for g in ("g", None):
        at = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["no"])):
            assert r["before"] == at
            at += r["x"]
    assert ordered.running_sum(df.limit(0), ["g"], F.col("x"), ["k"], F.col("k").cast("double"), "before").count() == 0


def test_quantiles_as_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert np.allclose(encoding.quantiles(df, "x", 40), np.quantile(values, np.linspace(0, 1, 41)))
    assert np.allclose(encoding.quantiles(df.limit(1), "x", 4), [values[0]] * 5) and encoding.quantiles(df.filter("x > 99"), "x", 4) == []


def test_membership_of_copies_shows(spark):
    """An output that copies the training rows gives members away; an independent one does not."""
    base = spark.range(600).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 100).alias("b"))
    train, test, other = base.filter("k < 400"), base.filter("k >= 400 AND k < 440"), base.filter("k >= 440")
    leak = privacy.membership_inference(train, train, test, "k", ["a", "b"], runs=4)[1].first()["score"]
    none = privacy.membership_inference(train, other, test, "k", ["a", "b"], runs=4)[1].first()["score"]
    assert leak < 6 < none


def test_attributes_that_follow_from_others_are_inferred(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("a"), F.concat(F.lit("v"), F.col("id") % 10).alias("b"), F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(10))).alias("c"))
    guesses, score = privacy.attribute_inference(rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1").unionByName(rows.filter("k % 2 = 0")), "k", ["a", "b", "c"], known=1, attacked=60)
    by = {r["column"]: r["accuracy"] for r in guesses.collect()}
    assert set(by) == {"a", "b", "c"} and by["b"] > 0.3 > by["c"] - 0.25 and 0 <= score.first()["score"] <= 10


def test_report_has_every_component(spark):
    x = spark.range(900).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("b"), F.concat(F.lit("k"), F.col("id") % 4).alias("c"), F.lit(None).cast("string").alias("nothing"))
    scores = {s.component: s for s in report.evaluate(x.filter("id % 3 = 0"), x.filter("id % 3 = 1"), "id", test=x.filter("id % 30 = 2"), personal=("c",))}
    assert set(scores) == {"distribution", "correlation", "structure", "text_structure", "text_semantic", "membership", "attribute", "replay", "quality", "privacy"}
    assert scores["text_structure"].grade == scores["text_semantic"].grade == "Unavailable" and scores["text_structure"].notes == "no text column"
    assert all(0 <= scores[c].score <= 10 for c in ("distribution", "correlation", "structure", "membership", "attribute", "quality", "privacy"))
    assert scores["replay"].raw == 4 and set(json.loads(report.as_json(list(scores.values())))) == set(scores)


def test_shared_queries_are_searched_once(spark, monkeypatch):
    """Queries that share a vector visit cells once and get what each would get alone; also beside themselves."""
    from tessera.operators import neighbors

    visits, keep = [], neighbors.kept
    monkeypatch.setattr(neighbors, "CELL", 20)
    monkeypatch.setattr(neighbors, "kept", lambda df, name: [t := keep(df, name), visits.append(t.count()) if name == "visits" else None][0])
    point = F.array(*[(F.pmod(F.xxhash64(F.col("id") % 90, F.lit(i)), F.lit(1000)) / 1000).cast("float") for i in range(3)])
    rows = spark.range(1800).select("id", point.alias("v")).unionByName(spark.sql("SELECT 5000L AS id, CAST(NULL AS ARRAY<FLOAT>) AS v"))
    for k, own in ((1, False), (3, True)):
        found = []
        for share in (0.5, 0.0):
            monkeypatch.setattr(neighbors, "SHARED", share)
            visits.clear()
            found.append(sorted(map(tuple, neighbors.nearest(rows.filter("id < 900"), rows, "id", "v", k, skip_self=own).collect())))
            assert (sum(visits) <= 90 * 5) == (share > 0), visits
        assert found[0] == found[1] and len(found[0]) == 1800 * k


def test_rows_are_encoded_by_one_fit(spark, monkeypatch):
    fits, fit = [], privacy.quantiles
    monkeypatch.setattr(privacy, "quantiles", lambda df, c, n: [fits.append(c), fit(df, c, n)][1])
    base = spark.range(300).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    privacy.membership_inference(base.filter("k < 200"), base.filter("k >= 240"), base.filter("k >= 200 AND k < 240"), "k", ["a", "b"], runs=2)
    assert fits == ["a"]
    given = spark.createDataFrame([(1, 0.0, "x"), (2, 2.5, "y"), (3, None, None), (4, -1.0, "new"), (5, 10.0, "x"), (6, 99.0, "y")], "k long, a double, b string")
    ends = spark.createDataFrame([(0.0, "x"), (10.0, "y")], "a double, b string")
    got = {r["k"]: r["v"] for r in privacy.encoded_rows(given, ends, "k", ["a", "b"], 4).collect()}
    assert [got[i][0] for i in range(1, 7)] == [0.0, 0.25, 0.5, 0.0, 1.0, 1.0]
    assert got[3][1:] == got[4][1:] == [0.0, 0.0] and got[1][1:] == got[5][1:] != got[2][1:] == got[6][1:]


def test_what_is_asked_before_a_hint_follows_from_it(spark):
    """Words, digits and sizes rule out no text that the hint and the pattern would find."""
    by = {r.label: r for r in recognizers.RECOGNIZERS}
    assert by["google_key"].hint_words() == ["AIza", "ya29"] and by["sendgrid_key"].hint_words() == ["SG."] and by["race"].hint_words() == [] and by["ipv4"].hint_words() == []
    assert by["ssn"].needs_digit() and by["iban"].needs_digit() and not by["md5"].needs_digit() and by["md5"].width() == (32, 32) and by["plus_code"].width() == (11, 12)
    assert not recognizers.Recognizer("x", "a", hint=r"a\d?|b\d").needs_digit() and not recognizers.Recognizer("x", "a", hint=r"a\d*").needs_digit()
    texts = [("an AMERICAN indian", "race"), ("Hispanic or LATINO", "ethnicity"), ("9e107d9d372bb6826bd81d3542a419d6", "md5"), (" 849VCWC8+R9\n", "plus_code"), ("849VCWC8+R9 x", None), ("AC" + "0a" * 16, "twilio_key"), ("MAIL a@b.org", "email"), ("CARD 4111-1111-1111-1111", "credit_card"), ("male", "sex"), ("MALES", None), ("latin1", None), ("", None)]
    found = spark.createDataFrame(texts, "note string, label string").select("label", pii.spans("note").alias("s")).collect()
    for r in found:
        assert {s["label"] for s in r["s"]} == ({r["label"]} if r["label"] else set()), r


def test_cells_beyond_the_plane_between_are_not_visited(spark, monkeypatch):
    """In a cloud of few dimensions a query sees few cells, and finds what all pairs give."""
    from tessera.operators import neighbors

    visits, keep = [], neighbors.kept
    monkeypatch.setattr(neighbors, "CELL", 100)
    monkeypatch.setattr(neighbors, "kept", lambda df, name: [t := keep(df, name), visits.append(t.count()) if name == "visits" else None][0])
    point = F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 16)) / (1 << 16)).cast("float") for i in range(3)])
    rows = spark.range(4500).select("id", point.alias("v"))
    got = {(r["query_id"], r["rank"]): (r["key"], r["distance"]) for r in neighbors.nearest(rows.filter("id < 4000"), rows.filter("id >= 4000"), "id", "v", 2).collect()}
    x = np.array([r["v"] for r in rows.orderBy("id").collect()])
    for i in range(4000, 4500):
        d = np.sqrt(((x[:4000] - x[i]) ** 2).sum(1))
        best = np.argsort(d, kind="stable")[:2]
        assert [got[i, r][0] for r in (1, 2)] == best.tolist() and np.allclose([got[i, r][1] for r in (1, 2)], d[best])
    assert sum(visits) < 500 * 5, visits


def test_attacks_by_weight_as_rows_repeated(spark):
    """A row that stands for many counts as they would, also at the end of a share; ties in order count by member and distance."""
    from tessera.operators import neighbors

    rng = np.random.default_rng(6)
    rows = [(int(run), int(i), bool(m), float(d), int(w)) for run in range(3) for i, m, d, w in zip(rng.integers(0, 25, 60), rng.integers(0, 2, 60), rng.integers(0, 5, 60) / 4, rng.integers(1, 9, 60))]
    df = spark.createDataFrame(rows, "run int, i long, member boolean, d double, w long")
    thresholds, shares = (0.8, 0.3), (0.2, 0.21, 0.5, 1.0)
    got = {(r["run"], r["threshold"], r["share"]): (r["tp"], r["fp"]) for r in neighbors.membership_attacks(df, "run", F.col("i"), "member", "d", thresholds, shares, weight="w").collect()}
    assert len(got) == 3 * 2 * 4
    for run in range(3):
        mine = [r[1:4] for r in sorted(rows) if r[0] == run for _ in range(r[4])]
        top = max(r[2] for r in mine)
        for t in thresholds:
            for s in shares:
                part = [r for r in sorted(mine)[: int(np.floor(s * len(mine)))] if r[2] / top < t]
                assert got[run, t, s] == (sum(r[1] for r in part), sum(not r[1] for r in part))


def test_members_are_dealt_to_runs_by_rank(spark):
    """Blocks of members end at exact ranks of their hash, where keys are shared too; the attacks count all of them."""
    base = spark.range(400).select((F.col("id") % 130).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 10).alias("a"))
    train, test = base.filter("k >= 30"), base.filter("k < 30 AND k % 2 = 0")
    size = test.count()
    attacks = privacy.membership_inference(train, base, test, "k", ["a"], runs=3)[0].filter("threshold = 0.4 AND share = 1.0").collect()
    ranked = [r["k"] for r in train.orderBy(F.xxhash64(F.lit(1), "k"), "k").collect()]
    n = {k: ranked.count(k) for k in ranked}
    outside = sum(1 for _ in range(size))
    for r in attacks:  # the output has every row, so all are near, and are called members
        block = ranked[r["run"] * size : (r["run"] + 1) * size]
        assert (r["tp"], r["fp"]) == (sum(n[k] for k in block), outside), r


def test_attributes_as_by_all_distances(spark, monkeypatch):
    """The rows that are held against the points in slices give the k nearest of all, nulls and equal rows among them."""
    monkeypatch.setattr(privacy, "SLICE", 50)
    rng = np.random.default_rng(2)
    data = [(i, None if i % 41 == 0 else float(a), float(b), "xyz"[c]) for i, (a, b, c) in enumerate(zip(rng.integers(0, 30, 900), rng.normal(0, 50, 900).round(1), rng.integers(0, 3, 900)))]
    df = spark.createDataFrame(data, "k long, a double, b double, c string")
    train, output = df.filter("k % 3 = 0"), df.filter("k % 3 <> 0")
    got = {r["column"]: (r["n"], r["accuracy"]) for r in privacy.attribute_inference(train, output, "k", ["a", "b", "c"], known=2, attacked=40)[0].collect()}
    out, chosen = [r for r in data if r[0] % 3], [tuple(r) for r in privacy.sample_rows(train, 40, "k", 5).collect()]
    sets, facts = privacy.column_sets(["a", "b", "c"], 2, 40, 5), {i: (np.mean(v), np.std(v)) for i in (1, 2) for v in [[r[i] for r in out if r[i] is not None]]}
    scaled = lambda r, i: 0.0 if r[i] is None else (r[i] - facts[i][0]) / facts[i][1]
    hits = {c: [] for c in "abc"}
    for at, p in enumerate(chosen):
        known = sets[at % len(sets)]
        cost = [(sum(float(r[3] != p[3]) if c == "c" else (scaled(r, "abc".index(c) + 1) - scaled(p, "abc".index(c) + 1)) ** 2 for c in known), r[0], r) for r in out]
        near = [r for _, _, r in sorted((round(d, 9), k, r) for d, k, r in cost)[:5]]
        for i, c in enumerate("abc", 1):
            if c in known or p[i] is None:
                continue
            seen = [r[i] for r in near if r[i] is not None]
            hits[c].append(sorted(set(seen), key=lambda v: (-seen.count(v), v))[0] == p[i] if c == "c" else abs(np.mean(seen) - p[i]) <= 0.01 * abs(p[i]))
    assert got == {c: (len(v), pytest.approx(np.mean(v))) for c, v in hits.items() if v}


def test_correlation_of_few_passes_as_pairs(spark, monkeypatch):
    """No row of the table is taken apart into pairs of columns; medians are looked for where something is missing only."""
    from tessera.operators import correlation

    x = spark.range(600).select((F.col("id") % 3).cast("string").alias("n"), F.when(F.col("id") % 7 > 0, (F.col("id") % 2).cast("string")).alias("m"), (F.col("id") % 11).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("b"), F.lit(2.0).alias("c"))
    got = {(r["x"], r["y"]): r["value"] for r in correlation.mixed_correlation(x, ["n", "m"], ["a", "b", "c"]).collect()}
    data = x.collect()
    for nominal in ("n", "m"):
        for number in ("a", "b"):
            rows = [(r[nominal], r[number]) for r in data if r[number] is not None]
            v = np.array([b for _, b in rows])
            within = sum(len(g) * np.var(g) for k in {k for k, _ in rows} for g in [[b for a, b in rows if a == k]])
            assert [got[p] ** 2 for p in ((nominal, number), (number, nominal))] == pytest.approx([1 - within / (len(v) * np.var(v))] * 2, abs=1e-6)
    assert got["c", "c"] == 1.0 and got["a", "c"] == got["c", "n"] == 0.0 and len(got) == 25
    fits, fit = [], correlation.quantiles
    monkeypatch.setattr(correlation, "quantiles", lambda df, c, n: [fits.append(c), fit(df, c, n)][1])
    filled = correlation.median_filled(x.select("a", "b", "c"), ["a", "b", "c"]).collect()
    middle = float(np.median([r["b"] for r in data if r["b"] is not None]))
    assert fits == ["b"] and sorted(r["b"] for r in filled) == sorted(middle if r["b"] is None else r["b"] for r in data)
