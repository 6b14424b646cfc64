import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import katz
from tessera.llm.labelled import held_out

SCHEMA = "doc_id long, text string, score int, n_tokens string"
RARE = 5


def cut(text):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [b"\0begin", *(text or "").encode().translate(fold).split(), b"\0end"]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Plain:
    """The model over dicts, one probability at a time."""

    def __init__(self, texts, order):
        self.order, self.n = order, [None] + [Counter() for _ in range(order)]
        self.begins = 0
        for t in texts:
            w = cut(t)
            self.begins += 1
            for k in range(1, order + 1):
                self.n[k].update(tuple(w[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(w)))
        self.total = sum(self.n[1].values())
        self.d = [None] + [self.discounts(Counter(c.values())) for c in self.n[1:]]
        self.after = defaultdict(dict)
        for k in range(2, order + 1):
            for g, c in self.n[k].items():
                self.after[g[:-1]][g[-1]] = c

    @staticmethod
    def discounts(n):
        r = range(1, RARE + 1)
        if all(n[i] for i in range(1, RARE + 2)) and (share := (RARE + 1) * n[RARE + 1] / n[1]) != 1:
            d = {i: ((i + 1) * n[i + 1] / n[i] / i - share) / (1 - share) for i in r}
            if all(0 < x < 1 for x in d.values()):
                return d
        part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return {i: (i - part) / i for i in r}

    def p(self, h, w):
        k = len(h) + 1
        d = self.d[k]
        if k == 1:
            kept = sum((1 - d[c]) * c for c in self.n[1].values() if c <= RARE)
            c, over = self.n[1][(w,)], self.total + (0 if kept else 1)
            return c * d.get(c, 1) / over if c else (kept or 1) / over
        seen = self.after.get(h)
        if not seen:
            return self.p(h[1:], w)
        total = self.begins if h == (b"\0begin",) else sum(seen.values())
        assert total == sum(seen.values())
        total += all(c > RARE for c in seen.values())
        if w in seen:
            return seen[w] * d.get(seen[w], 1) / total
        left = 1 - sum(c * d.get(c, 1) for c in seen.values()) / total
        return left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def row(self, doc_id, text):
        w = cut(text)
        known = [self.n[1][(x,)] for x in w[1:]]
        v = len(self.n[1])
        base = sum(math.log10((c + 0.1) / (self.total + 0.1 * (v + 1))) for c in known)
        score = sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(1, len(w)))
        return doc_id, is_held(doc_id), len(known), sum(c > 0 for c in known), self.total, base, score


def rows_of(seed, words=60, n=250):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "A", "a", "İ"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda: rnd.choice([" ", "\n", "\t "]).join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 2, 5, 30])))
    rows = [(i, text()) for i in range(n)]
    rows += [(None, "null id w1 w2"), (n, None), (n + 1, ""), (n + 2, " \n "), (5, "shares the id w1"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (n + 3, "w1 w2 w3 w4 " * 3000)]
    return rows + [(n + 10 + i, f"only{i} w1 new{i % 7} w2 w3") for i in range(60)]


def compared(spark, rows, **kw):
    plain = Plain([t for i, t in rows if not is_held(i)], kw.get("order", katz.ORDER))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got = katz.katz_scores(df, held_out(10, 0), **kw).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted((plain.row(*r) for r in rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9, atol=1e-9), (g, w)
    return plain


@pytest.mark.parametrize(("order", "block_tokens", "bucket_entries", "hot"), [(2, 2_000_000, 2_000_000, 1 << 20), (2, 300, 40, 16), (3, 500, 60, 30), (1, 500, 60, 30), (4, 400, 10_000, 1 << 20)])
def test_scores_as_a_plain_model(spark, order, block_tokens, bucket_entries, hot):
    """Also with many blocks and buckets, and with histories dealt over salts."""
    plain = compared(spark, rows_of(order), order=order, block_tokens=block_tokens, bucket_entries=bucket_entries, hot=hot)
    every = [g[0] for g in plain.n[1]] + [b"never seen"]
    for h in [()] + random.Random(1).sample(sorted(plain.after), min(40, len(plain.after))):
        assert abs(sum(plain.p(h, w) for w in every) - 1) < 1e-9  # probabilities after any history add up to 1


def test_scores_without_rare_counts(spark):
    """All continuations are frequent: a history keeps one count back for others."""
    compared(spark, [(i, "a b c a b c") for i in range(200)] + [(i, "a c new") for i in range(200, 260) if is_held(i)], order=3)


def test_scores_of_few_documents(spark):
    assert katz.katz_scores(spark.createDataFrame([], SCHEMA), held_out(10, 0)).count() == 0
    first_held = next(i for i in range(100) if is_held(i))
    got = katz.katz_scores(spark.createDataFrame([(first_held, "a b", 1, "x")], SCHEMA), held_out(10, 0)).first()
    assert tuple(got) == (first_held, True, 3, 0, 0, 0.0, 0.0)
    compared(spark, [(1, "a"), (2, None)])


def test_stored_ngrams(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = katz.fitted(docs, held_out(10, 0), bucket_entries=20_000)
    plain = Plain([r["text"] for r in docs.collect() if not is_held(r["doc_id"])], 2)
    assert model.deal.buckets > 5 and Counter(r["n"] for r in katz.ngrams(model, 2).collect()) == Counter(plain.n[2].values())
    ones = katz.ngrams(model, 1).collect()
    assert len({r["number"] for r in ones}) == len(ones) == len(plain.n[1]) + 1
    scores = katz.scored(model).toPandas()
    assert scores[scores.held_out].score.sum() > scores[scores.held_out].base_score.sum()


def test_packed_arrays():
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2), np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)), np.arange(-5, 90), rng.integers(-1, 70000, 50), np.zeros(0, np.int64), rng.normal(size=7), np.array([3])]
    assert all((a == b).all() and a.dtype.kind == b.dtype.kind for a, b in zip(arrays, katz.unpacked(katz.packed(*arrays)), strict=True))
