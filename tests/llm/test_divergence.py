import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, least=3, most=200):
    """rows (text, lang, source): every kept term against every group, in plain integers."""
    cut = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs, n, whole, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = cut(text)
        docs[lang].update(set(words))
        n[lang, source].update(words)
        whole[lang].update(words)
    out = []
    kept = {lang: [t for t, c in docs[lang].items() if c >= least] for lang, _ in groups}
    share = lambda counts, terms: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[u] for u in terms) + len(terms)) for t in terms}
    p = {g: share(n[g], kept[g[0]]) for g in groups}
    for lang, source in groups:
        mine, q = p[lang, source], share(whole[lang], kept[lang])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(mine[t], p[lang, s][t]) for t in kept[lang])) for g, s in groups if g == lang and s != source]
        terms = [(t, f(mine[t], q[t])) for t in kept[lang] if n[lang, source][t] and mine[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= most]
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Été", "été", "ÉTÉ", "naïve", "İx", "日本", "don't", "A1b", "_x_", "\x7fq", "Zz"]
    rows = []
    for _ in range(n):
        k = rnd.choice([0, 1, 3, 10, 40])
        source = "s0" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "s3", "ß", None, ""])
        rows.append((" ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=k)) if rnd.random() > 0.05 else None, rnd.choice(["en", "de", None]), source))
    rows += [("only here twice unusual", "xx", "a"), ("unusual twice", "xx", "b"), (None, "yy", "a"), ("", "yy", "b"), ("the same " * 5000, "en", "s1")] + [("the same text", "en", "s9")] * 5
    return rows


@pytest.mark.parametrize(("held", "pairs", "broadcast", "batch"), [(300_000, 1 << 19, 50_000, 10_000), (40, 7, 0, 13)])
def test_divergence_as_brute_force(spark, monkeypatch, held, pairs, broadcast, batch):
    """Also with sums handed on early, runs over many batches, pairs in small steps, and totals joined over salts."""
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(divergence.term_sums, "__defaults__", (held,))
    rows = rows_of(1)
    df = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], SCHEMA).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert collected(divergence.source_divergence(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_divergence_without_terms(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    got = collected(divergence.source_divergence(spark.createDataFrame([(1, None, None, "b", "t", 1), (2, "x y", None, None, "t", 1)], SCHEMA)))
    assert got == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_terms_are_cut_as_the_pattern_does():
    text = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2100), 0x10400]))
    want = [w.translate({c: c + 32 for c in range(65, 91)}).encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert divergence.terms(text.encode()) == want


def test_shares_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(int(n), int(n + t)) for n, t in zip(rng.integers(0, 1 << 52, 200), rng.integers(1, 1 << 52, 200))]
    df = spark.createDataFrame(rows, "n long, total long").withColumn("p", divergence.share("n", "total"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["total"] for r in df.collect())


def test_divergence_as_sql(spark, small):
    same(spark, small, divergence.op12_source_divergence, divergence.ORACLE)
