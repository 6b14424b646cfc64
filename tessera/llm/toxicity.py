"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactuals.

Sentences of labelled documents that name a group are rewritten with the other groups' names, and the
squared change of their score enters the loss, so that naming a group moves no score by itself.

Fitting uses a sample of labelled rows whose size is a documented parameter (SAMPLE_ROWS) and at most FEATURES
features with the clearest association.  All rewritten sentences of the sample count; they are added up where
they are made, as sums of products of feature changes, so no sentence leaves its task.  Scores are of whole texts.

Nulls: a null text counts as empty and is scored; a null doc_id is scored and not held out.  Repeated
rows are scored alike.  Very long texts are scored whole, by their set of words.  Features that are as clear as
each other are taken in byte order.  Columns of any name are kept; the score takes a name that is free.  An empty
table gives an empty result.  Without labels the score is 0.5; without any toxic label it is the smoothed share
of toxic rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import long_texts, read_table, written
from .labelled import held_out, labelled_sample
from .tokens import forget

SAMPLE_ROWS = 8_000
FEATURES = 600
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7

#: Names that are swapped with each other: groups of the same kind, singular or plural alike.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("disabled", "elderly", "deaf", "blind"),
)

_SPACES = bytes(32 if chr(i) in "\t\n\r\v\f .,;:!?\"'()[]{}<>|#$%&*^~@+=_/\\-" else i for i in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]+[.!?]*")


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_SPACES).split())


def features_of(words: set[bytes]) -> set[bytes]:
    """Each word, and its first 4 to 7 bytes with a mark behind them."""
    found = set(words)
    for k in BEGINNINGS:
        found.update(w[:k] + b"*" for w in words if len(w) > k)
    return found


class Model:
    def __init__(self, features: list[bytes], weights: np.ndarray, bias: float):
        self.weight = dict(zip(features, weights.tolist()))
        self.bias = bias

    def logit(self, text: bytes) -> float:
        get = self.weight.get
        if not self.weight:
            return self.bias
        words = words_of(text)
        total = self.bias
        for k in (None, *BEGINNINGS):
            for f in {w[:k] + b"*" for w in words if len(w) > k} if k else words:
                v = get(f)
                if v is not None:
                    total += v
        return total

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([self.logit(t) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def chosen_features(sample: DataFrame, most: int = FEATURES) -> list[bytes]:
    """The features whose odds differ most surely between toxic and other documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column("text").cast(pa.binary()), batch.column("y")):
                found = list(features_of(words_of(t.as_py() or b"")))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.full(len(found), y.as_py()))], ["feature", "y"])

    toxic, other = sample.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    seen = sample.select("text", "y").mapInArrow(run, "feature binary, y double").groupBy("feature").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).filter("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (F.lit(toxic) - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (F.lit(other) - F.col("n") + 0.5))
    ranked = seen.withColumn("z", odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))).filter("z > 2.5").orderBy(F.desc("z"), "feature").limit(most)
    return [bytes(r["feature"]) for r in ranked.collect()]


def rewritten(text: bytes, group: dict[bytes, list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """Each sentence that names a group, and the same with another group's name, for every name and other."""
    if group.keys().isdisjoint(words_of(text)):
        return
    for sentence in _SENTENCE.findall(text.lower()):
        for name in sorted(group.keys() & words_of(sentence)):
            for other in group[name]:
                yield sentence, re.sub(rb"\b" + name + rb"\b", other, sentence)


def swap_products(sample: DataFrame, features: list[bytes], identities: tuple = IDENTITIES) -> tuple[np.ndarray, int]:
    """The sum, over all rewritten sentences of the sample, of the products of their feature changes; and their number."""
    group = {w.encode(): [o.encode() for o in g if o != w] for g in identities for w in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(features)}
        sums, n = Counter(), 0
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                for before, after in rewritten(t.as_py() or b"", group):
                    old, new = (features_of(words_of(x)) for x in (before, after))
                    change = [(at[f], 1.0) for f in new - old if f in at] + [(at[f], -1.0) for f in old - new if f in at]
                    n += 1
                    for i, x in change:
                        for j, y in change:
                            sums[i, j] += x * y
        rows = [(-1, -1, float(n)), *((i, j, x) for (i, j), x in sums.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "x"])

    products, n = np.zeros((len(features), len(features))), 0
    # at most a row for each pair of features
    for r in sample.select("text").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        if r["i"] < 0:
            n = int(r["x"])
        else:
            products[r["i"], r["j"]] = r["x"]
    return products, n


def fit(x: np.ndarray, y: np.ndarray, products: np.ndarray, swaps: int, ridge: float = 0.01, penalty: float = 10.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Newton steps on log loss + ridge |w|^2 + penalty * rows * w' products w / swaps.

    products is the sum over swaps of change' change, so the last term is the mean squared change of score a row.
    Toxic rows weigh the square root of the other rows' number over theirs.  x may be of bytes; only a
    thousand rows at a time are numbers of eight.
    """
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    w, b = np.zeros(x.shape[1]), float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max() or not x.shape[1]:
        return w, b
    extra = 2 * ridge * np.eye(len(w)) + 2 * penalty * len(y) / max(swaps, 1) * products
    weight = np.where(y > 0, np.sqrt(max(1.0, (len(y) - y.sum()) / y.sum())), 1.0)
    full = np.zeros((len(w) + 1,) * 2)
    full[:-1, :-1] = extra
    v = np.append(w, b)

    def parts():
        for at in range(0, len(y), 1000):
            rows = slice(at, at + 1000)
            part = x[rows].astype(float)
            yield np.hstack([part, np.ones((len(part), 1))]), y[rows], weight[rows]

    def loss(v: np.ndarray) -> float:
        return sum(float((k * (np.logaddexp(0, z := xb @ v) - t * z)).sum()) for xb, t, k in parts()) + float(v @ full @ v / 2)

    now = loss(v)
    for _ in range(rounds):
        curve, slope = full + 1e-6 * np.eye(len(v)), full @ v
        for xb, t, k in parts():
            q = 1 / (1 + np.exp(-np.clip(xb @ v, -500, 500)))
            curve += xb.T @ (xb * (k * q * (1 - q))[:, None])
            slope += xb.T @ (k * (q - t))
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(v - size * step) > now:
            size /= 2
        v = v - size * step
        before, now = now, loss(v)
        if before - now < 1e-6 * max(1.0, before):
            break
    return v[:-1], float(v[-1])


def fitted(docs: DataFrame, labels: DataFrame, held: Column, most: int = SAMPLE_ROWS, identities: tuple = IDENTITIES, penalty: float = 10.0) -> Model:
    sample = written(labelled_sample(long_texts(docs), labels, "toxic", held, most), "toxic-sample")
    names = [w.encode() for g in identities for w in g]
    features = sorted({*chosen_features(sample), *names, *(f for w in names for f in features_of({w}))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(features)}
        for batch in batches:
            found = [sorted(at[f] for f in features_of(words_of(t.as_py() or b"")) if f in at) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    rows = sorted(((r["y"], list(r["found"])) for r in sample.select("text", "y").mapInArrow(run, "y double, found array<int>").collect()))
    x, y = np.zeros((len(rows), len(features)), np.uint8), np.array([r[0] for r in rows])
    for i, (_, found) in enumerate(rows):
        x[i, found] = 1
    return Model(features, *fit(x, y, *swap_products(sample, features, identities), penalty=penalty))


def scored(docs: DataFrame, model: Model, keep_text: bool = True, score: str = "toxic_score") -> DataFrame:
    """Every column of docs (without text, if that isn't kept) and the score, whose name docs must not have."""
    if score.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that has encoded before
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = pa.array(model.score([t.as_py() or b"" for t in part.column("text").cast(pa.binary())]))
                yield (part if keep_text else part.drop_columns(["text"])).append_column(score, scores)

    rows = long_texts(docs).withColumn("text", F.col("text").cast("string"))
    schema = StructType([f for f in rows.schema if keep_text or f.name != "text"]).add(score, "double")
    return rows.mapInArrow(run, schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), held_out(3, 1)
    model = fitted(docs, read_table(spark, sf_dir, "labels"), held)
    score = F.col("toxic_score")
    return scored(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
