"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a sample of labelled rows whose size is a documented parameter
(SAMPLE_ROWS); statistics and scores are computed for whole texts on the executors, where the trees are
complete binary trees flattened into arrays and all rows of a batch go down a level at a time.

Nulls: a null text counts as empty and is scored; a null doc_id is scored and not held out.  Repeated
rows are scored alike.  An empty table gives an empty result.  Without labels the score is 0.5; with
labels of one class only it is that class's smoothed share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts, read_table
from .labelled import held_out, labelled_sample

#: Most labelled rows that the trees are grown from.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7

_CLASS = np.zeros((256, 9))
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"|", b"#$%&*^~@+=<>", b".,;:", b"\n", bytes(range(128, 256)))):
    _CLASS[list(_set), _k] = 1.0

STATISTICS = ("log_bytes", "log_words", "upper", "lower", "digits", "shouts", "bars", "symbols", "stops", "lines", "high_bytes", "word_bytes", "word_spread", "longest_word", "distinct", "top_word", "repeats", "lines_distinct", "top_line", "upper_words", "marked_words", "pairs_distinct")


def statistics(text: bytes) -> list[float]:
    """The numbers that the trees see, of a whole text in UTF-8."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    words = text.split()
    k = len(words)
    if not k:
        return [np.log1p(n), 0.0, *chars, *[0.0] * 11]
    sizes = np.fromiter(map(len, words), np.int64, k)
    counts = Counter(words)
    lines = text.split(b"\n")
    by_line = Counter(lines)
    marked = sum(c for w, c in counts.items() if w[-2:-1] in b"!#$%&*" and len(w) > 1)
    upper = sum(c for w, c in counts.items() if w.isupper())
    return [np.log1p(n), np.log1p(k), *chars, sizes.mean(), sizes.std(), np.log1p(sizes.max()), len(counts) / k, max(counts.values()) / k, sum(map(eq, words, words[1:])) / k, len(by_line) / len(lines), max(by_line.values()) * len(max(by_line, key=by_line.get)) / n, upper / k, marked / k, len(set(zip(words, words[1:]))) / max(1, k - 1)]


class Trees:
    """Gradient-boosted trees for a 0/1 label, all of one depth, as arrays (trees x nodes)."""

    def __init__(self, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, bias: float):
        self.depth, self.feature, self.cut, self.leaf, self.bias = depth, feature, cut, leaf, bias

    @classmethod
    def grown(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 1.0) -> Trees:
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        bias, nodes = float(np.log(p / (1 - p))), (1 << depth) - 1
        feature, cut, leaf = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
        if not len(y) or y.min() == y.max():
            return cls(depth, feature, cut, leaf, bias)
        d = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(d) * bins
        raw = np.full(len(y), bias)
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(depth):
                width, first = 1 << level, (1 << level) - 1
                at = (node[:, None] - first) * (d * bins) + flat
                g = np.bincount(at.ravel(), np.repeat(grad, d), width * d * bins).reshape(width, d, bins)
                h = np.bincount(at.ravel(), np.repeat(hess, d), width * d * bins).reshape(width, d, bins)
                gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
                ga, ha = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + least) + (ga - gl) ** 2 / (ha - hl + least) - ga**2 / (ha + least)
                gain[(hl < least) | (ha - hl < least)] = -1.0
                for j in range(d):
                    gain[:, j, len(edges[j]) :] = -1.0
                best = gain.reshape(width, -1).argmax(axis=1)
                for w in range(width):
                    j, b = divmod(int(best[w]), bins)
                    if gain[w, j, b] > 1e-6:
                        feature[t, first + w], cut[t, first + w] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
            g, h = np.bincount(node - nodes, grad, nodes + 1), np.bincount(node - nodes, hess, nodes + 1)
            leaf[t] = -rate * g / (h + least)
            raw += leaf[t, node - nodes]
        return cls(depth, feature, cut, leaf, bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.bias + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1))))


def with_statistics(docs: DataFrame, keep: str) -> DataFrame:
    """keep ("name type") and x, the statistics of text."""
    name = keep.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(x, pa.list_(pa.float64()))], [name, "x"])

    return long_texts(docs).select(name, "text").mapInArrow(run, f"{keep}, x array<double>")


def fitted(docs: DataFrame, labels: DataFrame, held, most: int = SAMPLE_ROWS) -> Trees:
    """Trees grown on the driver from at most ``most`` labelled rows."""
    rows = with_statistics(labelled_sample(docs, labels, "quality", held, most), "y double").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows come in
    return Trees.grown(x[order], y[order])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score, score_text_bytes: the model's score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.score(x))], ["doc_id", "score"])

    return long_texts(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), held_out(4, 2)
    model = fitted(docs, read_table(spark, sf_dir, "labels"), held)
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
