import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint, language, ngram_join, quality, topk, toxicity
from tessera.llm.components import components
from tessera.llm.labelled import held_out
from tessera.llm.shingles import CHUNK, parity_bits, shingle_sets
from tests.oracle import same


def brute_components(rows):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_as_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(n)] for n in (3, 4, 5, 6, 30, 60, 120, 400)]
    rows, k = [], 0
    for b in base:
        for edits in (0, 0, 1, 2, 4, 8, 20):
            w = list(b)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((k, rnd.choice((" ", "\n", " \t ")).join(w).upper() if k % 3 == 0 else " ".join(w)))
            k += 1
    common = " ".join(words[:40])
    rows += [(k + i, common + " " + " ".join(rnd.choice(words) for _ in range(5))) for i in range(12)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "w1"), (904, "W1"), (905, "é ü"), (906, "É ü")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_few_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    twice = ngram_join.near_duplicates(spark.createDataFrame([(4, "a b c d e f")] * 2 + [(None, "a b c d e f")], schema)).collect()
    assert [(r["n_shingles"], r["component_id"]) for r in twice] == [(2, 4)] * 3


def test_lists_dealt_over_salts_lose_nothing(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"x{i}" for i in range(60)]
    base = [rnd.choice(words) for _ in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(40)] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    real = ngram_join.prefix_entries
    many = lambda *a: real(*a).withColumns({"salts": F.lit(4), "salt": F.pmod("k1", F.lit(4)).cast("int")})
    monkeypatch.setattr(ngram_join, "prefix_entries", many)
    monkeypatch.setattr(ngram_join, "PART_ROWS", 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_link_through_null_ids_and_keep_rows(spark):
    text = [f"word{i}" for i in range(200)]
    rows = [(9, " ".join(text), 1, "a"), (None, " ".join([*text, "one"]), 2, "b"), (4, " ".join([*text, "one", "two"]), 3, "c"), (None, " ".join(text[100:]) + " tail", 4, "d"), (None, None, 5, "e"), (7, "", 6, "f"), (9, " ".join(text[:50]), 7, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long, k1 string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(-1, 0, None), (-1, 97, None), (-1, 197, 4), (4, 198, 4), (7, 0, 7), (9, 46, 9), (9, 196, 4)]


def test_near_duplicates_of_a_large_group_of_near_copies(spark):
    """Copies around one text, whose pairs are on either side of the threshold; candidate pairs stay in proportion."""
    rnd = random.Random(8)
    words = [f"y{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(600):
        w = list(base)
        for at in rnd.sample(range(60), i % 4):
            w[at] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_a_very_long_text(spark):
    text = [f"v{i}" for i in range(150_000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[10_000:])), (3, " ".join(text[40_000:]))]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 149_996, 1), (2, 139_996, 1), (3, 109_996, 3 if 109_996 / 149_996 < 0.8 and 109_996 / 139_996 < 0.8 else 1)]


def test_prefixes_of_similar_sets_share_the_matches_asked_for():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50_000, ngram_join.CELLS).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[int(len(a) * rng.random() * 0.25) :], rng.integers(0, 1 << 62, int(n * 0.1), dtype=np.uint64))))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            (pa, la, _), (pb, lb, _) = ngram_join.prefix(a, counts), ngram_join.prefix(b, counts)
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_bitmaps_never_claim_more_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(1, 30)), dtype=np.uint64))))
        n, bits = np.array([len(a), len(b)]), [parity_bits(a), parity_bits(b)]
        order = np.argsort(n, kind="stable")
        low, apart = ngram_join._Bitmaps(n[order], [bits[k] for k in order], 1).apart(1)
        assert low == 0 and apart[0] <= len(np.setxor1d(a, b))


def test_long_texts_hash_as_short_ones():
    words = [f"word{i}" for i in range(400_000)]
    text = " ".join(words).encode()
    assert len(text) > 2 * CHUNK
    (whole,) = list(shingle_sets([text]))
    parts = [next(iter(shingle_sets([" ".join(words[i : i + 1000]).encode()]))) for i in range(0, 400_000, 996)]
    assert len(whole) == 399_996 and np.array_equal(np.unique(np.concatenate(parts)), whole)
    long_word = b"a" * (CHUNK + 10)
    assert len(next(iter(shingle_sets([b" ".join([long_word] * 6)])))) == 1


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_fingerprints_as_brute_force(spark):
    texts = [(3, "One. Two! Three?\nFour\n\nFive"), (1, None), (8, "abc\U0001F600é"), (8, "abc\U0001F600é"), (5, ""), (7, "x" * 1000), (6, "x" * 1000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, to int").repartition(3)
    rows = fingerprint.fingerprints(df).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (-r[0], [-ord(c) for c in r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["fingerprint"] == by[6]["fingerprint"] != by[8]["fingerprint"] and by[1]["fingerprint"] == by[5]["fingerprint"]
    assert by[7]["near_next"] == 1.0 and 0 <= by[3]["near_edited"] < 1
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    (alone,) = fingerprint.fingerprints(df.filter("doc_id = 3")).collect()
    assert alone["near_next"] == 1.0


def located(spark, before, after):
    df = spark.createDataFrame([(before, after)], "x string, y string")
    trees = df.select(fingerprint.tree(F.col("x")).alias("a"), fingerprint.tree(F.col("y")).alias("b"))
    row = trees.select(fingerprint.edits(F.col("a"), F.col("b")).alias("e")).first()
    return [tuple(e) for e in row["e"]]


def test_edits_are_located(spark):
    # section 0, in it paragraph 1, in it piece 0
    assert located(spark, "a\nb\n\nc\nd", "a\nX\n\nc\nd") == [(0, 1, 1), (1, 1, 1), (0, 1, 1)]
    assert located(spark, "a\nb\n\nc\nd", "a\nb\n\nc\nd") == []
    # an inserted, a deleted paragraph, and one behind the last
    assert located(spark, "a\nb\nc\n\nz", "a\nN\nb\nc\n\nz") == [(0, 1, 1), (1, 0, 1)]
    assert located(spark, "a\nb\nc\n\nz", "a\nc\n\nz") == [(0, 1, 1), (1, 1, 0)]
    assert located(spark, "a\n\nz", "a\n\nz\n\ny\n\nw") == [(1, 1, 3)]
    assert located(spark, "", "a") == [(0, 1, 1), (0, 1, 1), (0, 0, 1)]
    df = spark.range(1)
    assert df.select((fingerprint.root(fingerprint.tree(F.lit("a\n\nb"))) == fingerprint.root(fingerprint.tree(F.lit("a\n\n\nb")))).alias("s")).first()["s"] is False


def test_top_k_as_sql(spark, small):
    same(spark, small, topk.op10_topk, topk.ORACLE)


def test_top_k_over_many_tiles_as_sql(spark, small, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 300)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "MOST_PARTITIONS", 5)
    same(spark, small, topk.op10_topk, topk.ORACLE)


def test_top_k_of_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.0, 0.0]), (9, None), (10, [float("nan"), 1.0]), (11, [None, 1.0]), (12, []), (13, [1.0]), (None, [1.0, 1.0]), (4, [2.0, 0.5]), (4, [2.0, 0.5])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", F.col("id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 98304), (0, 2, 4, 98304), (0, 3, 2, 65536), (50, 1, 0, 0), (50, 2, 2, 0), (50, 3, 3, 0)]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.Trees.grown(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert quality.Trees.grown(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op6_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op9_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.93
    assert np.mean([r["predicted"] for r in rows if not labels[r["doc_id"]]]) < 0.03


def test_counterfactuals_calm_group_names(spark):
    """Insults name one group in the labels; without the penalty its name alone raises the score."""
    rnd = random.Random(3)
    fill = [f"f{i}" for i in range(50)]
    rows = []
    for i in range(400):
        w = [rnd.choice(fill) for _ in range(12)]
        toxic = i % 2
        w[3] = "refugees" if toxic or rnd.random() < 0.1 else "natives"
        if toxic and rnd.random() < 0.85:
            w[7] = "vermin"
        rows.append((i, " ".join(w) + ".", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models = [toxicity.fitted(df, df, F.lit(False), penalty=p) for p in (0.0, 100.0)]
    neutral = [m.score([b"f1 f2 refugees f4 f5.", b"f1 f2 natives f4 f5."]) for m in models]
    assert neutral[0][0] - neutral[0][1] > 0.3 > 0.05 > abs(neutral[1][0] - neutral[1][1])
    assert models[1].score([b"f1 refugees are vermin"])[0] > 0.7


def test_classifiers_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some words", "x"), (3, "\n \t", "y"), (3, "a" * 100_000, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    q = quality.scored(docs, quality.fitted(docs, labels, held_out(4, 2))).collect()
    t = toxicity.scored(docs, toxicity.fitted(docs, labels, held_out(3, 1))).collect()
    assert len(q) == len(t) == 5 and all(0 <= r["score"] <= 1 for r in q) and all(0 <= r["toxic_score"] <= 1 for r in t)
    assert quality.scored(docs.limit(0), quality.fitted(docs, labels.limit(0), held_out(4, 2))).count() == 0


def test_gradient_is_zero_where_the_fit_ends():
    """The gradient of the stated loss by differences, and no better point near by."""
    rng = np.random.default_rng(0)
    x, y = (rng.random((300, 12)) < 0.3).astype(float), (rng.random(300) < 0.3).astype(float)
    swaps = rng.integers(-1, 2, (40, 12)).astype(float)
    w, b = toxicity.fit(x, y, swaps.T @ swaps, len(swaps), rounds=50)
    weight = np.where(y > 0, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.01 * v[:-1] @ v[:-1] + 10.0 * len(y) * np.mean((swaps @ v[:-1]) ** 2)

    at = np.append(w, b)
    step = 1e-5 * np.eye(13)
    assert max(abs(loss(at + e) - loss(at - e)) / 2e-5 for e in step) < 1e-2
    assert all(loss(at) <= loss(at + rng.normal(0, 0.05, 13)) for _ in range(200))


def test_swaps_are_added_up_where_they_are_made(spark):
    texts = ["The women went. The men stayed! nobody", None, "", "women and girls", "no names here", "x " * 50_000 + "gay"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    features = sorted({w.encode() for g in toxicity.IDENTITIES for w in g} | {b"wom*", b"wome*", b"girl*"})
    products, n = toxicity.swap_products(df, features)
    group = {w.encode(): [o.encode() for o in g if o != w] for g in toxicity.IDENTITIES for w in g}
    rows = []
    for t in texts:
        for before, after in toxicity.rewritten((t or "").encode(), group):
            old, new = (toxicity.features_of(toxicity.words_of(v)) for v in (before, after))
            rows.append([(f in new) - (f in old) for f in features])
    assert n == len(rows) == 3 + 3 + 6 + 4 and np.array_equal(products, np.array(rows, float).T @ np.array(rows, float))
    assert toxicity.swap_products(df.limit(0), features)[1] == 0


def test_trees_as_walked_one_by_one():
    """The trees' scores by a plain walk, and the first split by a search over all cuts."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] + 0.2 * rng.normal(size=400) > 0.3).astype(float)
    model = quality.Trees.grown(x, y, trees=5, depth=3)
    want = []
    for row in x:
        z = model.bias
        for t in range(5):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.cut[t, node] else 1)
            z += model.leaf[t, node - 7]
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(model.score(x), want)
    p = 1 / (1 + np.exp(-model.bias))
    grad, hess = p - y, np.full(400, p * (1 - p))
    gain = lambda m: sum(grad[k].sum() ** 2 / (hess[k].sum() + 1.0) for k in (m, ~m))
    best = max((gain(x[:, j] <= c), j) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])))
    assert best[1] == model.feature[0, 0] == 1 and gain(x[:, 1] <= model.cut[0, 0]) == pytest.approx(best[0])


def test_posterior_of_pages_as_brute_force(spark, small):
    """Every factor recounted by plain loops, from the text evidence on."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) between 300 and 900").dropDuplicates(["lang"]).collect()}
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        lang = rnd.choice(sorted(texts))
        host = rnd.choice(["a.example.com", "b.example.com", "www.site.de", "site.fr", "X.Example.com"])
        mark = rnd.choice([lang, lang, rnd.choice(sorted(texts)), None, "xx"])
        rows.append((i, None if i % 13 == 0 else f"http://{host}/{rnd.choice([lang + '/', 'q/', ''])}{i}", f"<html{f' lang={mark}' if mark else ''}><p>{'' if i % 11 == 0 else texts[lang]}</p>"))
    rows += [rows[5], (None, rows[6][1], rows[6][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language.identify_pages(pages, docs).collect()
    read = pages.select("page_id", F.col("html").alias("_html"), language.label(F.regexp_extract("html", language._DECLARED, 1)).alias("declared"))
    model = language.fitted(docs, read)
    langs = model.languages
    evidence = [model.log_likelihoods(language._MARKUP.sub(b" ", h.encode())) for _, _, h in rows]
    first = lambda v: langs[int(np.argmax(v))]
    facts = []
    for (i, url, html), e in zip(rows, evidence):
        found = [re.search(p, v or "") for p, v in ((language._HOST, url), (language._DECLARED, html), (language._ADDRESS, url))]
        host, declared, place = (m.group(1).lower() if m else None for m in found)
        facts.append((i, host, declared, place, first(e)))
    want = collections.Counter()
    for (i, host, declared, place, text), e in zip(facts, evidence):
        prior = np.full(len(langs), 1 / len(langs))
        for level in ([lambda h: ""] if host is None else [lambda h: "", lambda h: ".".join((h or "").split(".")[-2:]), lambda h: h]):
            same = [f for f in facts if (level is not None) and (level(f[1]) == level(host)) and (f[1] is not None or level("a.b") == "")]
            counts = np.array([sum(f[2] == k for f in same) for k in langs], float) - np.array([float(declared == k) for k in langs])
            prior = (counts + 5 * prior) / (counts.sum() + 5)
        score = e + np.log(prior)
        if host is not None:
            suffix = host.split(".")[-1]
            kinds = len({f[1].split(".")[-1] for f in facts if f[1]})
            for k, lang in enumerate(langs):
                mine = [f for f in facts if f[1] and f[4] == lang]
                score[k] += np.log((sum(f[1].split(".")[-1] == suffix for f in mine) + 1) / (len(mine) + kinds))
        for said, at in ((declared, 2), (place, 3)):
            if said in langs:
                for k, lang in enumerate(langs):
                    mine = [f for f in facts if f[4] == lang and f[at] in langs]
                    score[k] += np.log((sum(f[at] == said for f in mine) + 1) / (len(mine) + len(langs)))
        p = np.exp(score - score.max())
        want[(i, first(score), round(float(p.max() / p.sum()), 6))] += 1
    assert collections.Counter((r["page_id"], r["lang"], round(r["posterior"], 6)) for r in got) == want


def test_language_is_learnt_from_half_the_documents(spark):
    """Held-out accuracy of the text evidence alone, on documents that the model has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) > 60")
    model = language.fitted(docs.filter("doc_id % 2 = 0"))
    rows = [(r["lang"].lower(), model.languages[int(np.argmax(model.log_likelihoods(r["text"].encode())))]) for r in docs.filter("doc_id % 2 = 1").collect()]
    assert len(rows) > 200 and np.mean([a == b for a, b in rows]) > 0.9


def test_markup_that_never_ends_takes_no_longer(spark):
    for hostile in (b"<script " * 50_000, b"<!--" * 100_000, b"<" * 400_000, b"<style>" * 50_000):
        began = time.time()
        language._MARKUP.sub(b" ", hostile)
        assert time.time() - began < 5


def test_language_of_pages(spark, small):
    rows = language.op1_language_id(spark, small).collect()
    assert np.mean([r["lang"] == r["declared"] for r in rows]) > 0.95 and all(0 < r["posterior"] <= 1 for r in rows)


def test_language_evidence_decides(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = docs.filter("lang = 'fr' AND length(text) > 500").first()["text"]
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/de/1", "<html lang='de'><p></p>"), (2, "http://a.example.com/x", f"<html lang='de'><p>{text}</p>"), (3, None, None), (4, "http://a.example.com/x", "")] + [(10 + i, "http://a.example.com/x", "<html lang=de>") for i in range(20)],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["lang"] for r in language.identify_pages(pages, docs).collect()}
    assert (got[1], got[2], got[4]) == ("de", "fr", "de") and got[3] in ("de", "en")
    assert language.identify_pages(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify_pages(pages, docs.limit(0)).collect()} == {None}


def test_languages_are_those_of_all_rows(spark):
    words = {"en": "the house is where they were thinking of something", "de": "der hund und das haus sind nicht weit von hier", "pt": "não há razões para as opiniões dos irmãos", "fi": "hyvää päivää kaikille ystäville jotka täällä asuvat"}
    last = spark.range(6000).orderBy(F.xxhash64("id").desc()).first()["id"]  # the document that a sample over all languages takes last
    lang = F.when(F.col("id") == last, "pt").when(F.col("id") % 2 == 0, "en").otherwise("de")
    text = F.when(F.col("id") == last, words["pt"]).when(F.col("id") % 2 == 0, words["en"]).otherwise(words["de"])
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang"), F.lit("s").alias("source"))
    assert language.fitted(docs).languages == ["de", "en", "pt"]
    found = {r["identified"]: r["n"] for r in language.identify_documents(docs).groupBy("identified").agg(F.count("*").alias("n")).collect()}
    assert found == {"en": docs.filter("lang = 'en'").count(), "de": docs.filter("lang = 'de'").count(), "pt": 1}
    pages = spark.createDataFrame([(i, f"http://{k}.example.com/x", f"<html lang='{k.upper()}'><p>{t}</p>") for i, (k, t) in enumerate(words.items())] + [(9, None, f"<p>{words['pt']}</p>"), (10, None, f"<p>{words['fi']}</p>"), (11, None, "<html lang='de'><p>" + words["de"])], "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in language.identify_pages(pages, docs).collect()}
    assert got == {0: "en", 1: "de", 2: "pt", 3: "fi", 9: "pt", 10: "fi", 11: "de"}
    nameless = docs.withColumns({"lang": F.when(F.col("lang") == "pt", "PT").otherwise(F.col("lang")), "doc_id": F.when(F.col("lang") != "pt", F.col("doc_id"))})
    silent = docs.filter("doc_id < 10").unionByName(spark.createDataFrame([(7000, None, "sv", "s")], "doc_id long, text string, lang string, source string"))
    assert language.fitted(nameless).languages == ["de", "en", "pt"] and language.fitted(silent).languages[-1] == "sv"
    assert {r["identified"] for r in language.identify_documents(silent).filter("text IS NOT NULL").collect()} == {"de", "en"}


def test_host_priors_are_shrunk_towards_levels_above(spark):
    rows = spark.createDataFrame([("a.example.com", "fr")] * 30 + [("a.example.com", None), ("b.example.com", "de"), ("b.example.com", None)] + [("z.org", "en")] * 100 + [(None, None)], "host string, said string")
    every = language.with_host_prior(rows, "host", "said", ["de", "en", "fr"]).distinct().collect()
    got = {r["host"]: list(r["prior"]) for r in every if r["said"] is None}
    # a page's own label is no part of its prior
    (own,) = [r["prior"][0] for r in every if r["said"] == "de"]
    assert own < got["b.example.com"][0] and len(every) == 6
    assert got["a.example.com"][2] > 0.9 and 0.1 < got["b.example.com"][0] < 0.6 and got["b.example.com"][2] > got["b.example.com"][1]
    assert all(sum(p) == pytest.approx(1.0) for p in got.values()) and got[None][1] > 0.5


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = P.drop_toxic(spark, docs, small)
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.scored(docs, toxicity.fitted(docs, spark.read.parquet(f"{small}/labels.parquet"), held_out(3, 1))).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    kept = P.keep_identified(spark, clean, small)
    assert kept.count() >= 0.98 * clean.count() and kept.columns == docs.columns
    one = P.one_of_each_group(spark, kept, small)
    groups = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in groups.values()} and one.columns == docs.columns
    out = P.run(spark, small)
    assert out.count() > 0 and len(P.STAGES) == 5
    assert collections.Counter(out.columns) == collections.Counter(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def test_pipeline_stages_take_odd_rows(spark, small):
    """Nulls, repeated rows, ids that two texts share, columns with any name, very long texts, and no rows."""
    import corpus_pipeline as P

    extra = "toxic_score double, posterior string, segments int, `evidence` string, key string, row string, component string, size int, _words string"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "an other text of six words"), (None, text + " more"), (None, None), (None, None), (5, ""), (6, "long words here " * 30_000), (7, "a short one")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, None if t is None else len(t), 0.5, "p", 3, "e", "k", "r", "c", 9, "w") for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars int, {extra}").repartition(3)
    kept = P.keep_identified(spark, docs, small)
    assert kept.columns == docs.columns and kept.count() == 6 and {r["posterior"] for r in kept.collect()} == {"p"}
    clean = P.drop_toxic(spark, docs, small)
    assert clean.columns == docs.columns and clean.count() == len(rows) and {r["toxic_score"] for r in clean.collect()} == {0.5}
    one = P.one_of_each_group(spark, docs, small)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in one.collect()) == sorted((i or -1, len(t or "")) for i, t in [rows[0], rows[2], rows[4], *rows[6:]])
    mixed = P.mix_sources(spark, one, small)
    assert mixed.columns == docs.columns and {r["segments"] for r in mixed.collect()} == {3}
    assert P.pack_sequences(spark, mixed, small).count() > 0
    for stage in (P.drop_toxic, P.keep_identified, P.one_of_each_group, P.mix_sources, P.pack_sequences):
        assert stage(spark, docs.limit(0), small).count() == 0


def test_pipeline_keeps_documents_without_any_language(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, "12 34", None, "s", 5), (-2, None, None, "s", None), (-3, "a word", "", "s", 6)], docs.schema)
    kept = P.keep_identified(spark, docs.unionByName(odd), small)
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")} | {-3}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns and kept.filter("lang IS NOT NULL").count() == 0
    one = P.one_of_each_group(spark, kept, small)
    assert P.mix_sources(spark, one, small).count() > 0


def brute_tree(text):
    import re

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [[[sha(x) for x in re.findall(fingerprint._PIECES, p)] for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n\n)(?!\n)", text)]
    sections = [sha("s" + ",".join(sha("p" + ",".join(p)) for p in s)) for s in leaves]
    return sha("r" + ",".join(sections)), {x[:15] for s in leaves for p in s for x in p}


def test_trees_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_001, "a\n\n\n\nb.\n c! d?\n"), (10_002, "\n\n"), (10_003, "...x" * 200)], "doc_id long, text string"))
    rows = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: -r["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, r in enumerate(rows):
        text, after = texts[r["doc_id"]], texts[rows[(k + 1) % len(rows)]["doc_id"]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        (root, leaves), (e_root, e_leaves), (_, n_leaves) = brute_tree(text), brute_tree(edited), brute_tree(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (root, e_root)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(leaves, e_leaves), like(leaves, n_leaves)))
