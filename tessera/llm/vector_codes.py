"""Codes of vectors by codebooks of each of their parts, the nearest entry found in ball trees over the entries.

Components are floor(scale * x).  Vectors are cut into equal consecutive parts; the entries of each part position
start as that part of the vectors with the smallest ids, and every round assigns all parts to their nearest entry
and moves an entry to the floored mean of its parts.

A tree halves the entries along their widest component until at most LEAF are left.  A ball has an integer centre,
and a radius that is the integer square root of the largest squared distance, rounded up.  Parts go down a tree
together: each ball's distance from a part is at least the square root (rounded down) of the distance to the centre
minus the radius, and a ball is visited unless that bound is above the best distance so far; equal bounds are visited,
as an entry with a smaller index may lie there.  Inside a leaf, distances are compared as integers.

Vectors that are null or hold null or non-finite components take no part.  The length of the table's vectors is that
of the smallest id among those that the parts divide; an empty vector or one of another length has a null code and
error, and adds nothing to label_error.  Null ids come after all others; rows with the same id are ordered by their
components, so equal rows give equal codes.  Fewer rows than entries make a smaller codebook.  Components so
large that a distance would not fit 64 bits are refused with a ParameterError.  Extra columns are not read,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from .common import read_table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Most entries of a ball that is not halved.
LEAF = 8
#: A label with more than this share of the rows is joined by broadcast; there are fewer such labels than 1 / share.
HOT_SHARE = 1 / 1000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # every term and sum is an integer that a double holds
        a, b = x.astype(np.float64), y.astype(np.float64)
    else:
        a, b = x, y
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


def _root(x: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


class BallTree:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.root = self._ball(np.arange(len(entries)), leaf)

    def _ball(self, members: np.ndarray, leaf: int) -> tuple:
        x = self.entries[members]
        centre = np.rint(x.mean(axis=0)).astype(np.int64)[None]
        largest = _distances(x, centre).max()
        radius = int(_root(largest[None])[0])
        radius += radius * radius < largest
        if len(members) <= leaf:
            return centre, radius, members, None
        along = x[:, np.argmax(x.max(axis=0) - x.min(axis=0))]
        order = members[np.argsort(along, kind="stable")]
        half = len(order) // 2
        return centre, radius, None, (self._ball(np.sort(order[:half]), leaf), self._ball(np.sort(order[half:]), leaf))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, ties to the smaller, and the squared distance."""
        self._x = x
        self._best, self._at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))
        self._visit(self.root, np.arange(len(x)))
        return self._at, self._best

    def _visit(self, ball: tuple, rows: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, members, halves = ball
        if halves is None:
            d = _distances(self._x[rows], self.entries[members])
            i = d.argmin(axis=1)  # the first of equal ones, and members ascend
            d, at = d[np.arange(len(rows)), i], members[i]
            better = (d < self._best[rows]) | ((d == self._best[rows]) & (at < self._at[rows]))
            self._best[rows[better]], self._at[rows[better]] = d[better], at[better]
            return
        away = [_root(_distances(self._x[rows], h[0])[:, 0]) - h[1] for h in halves]
        bound = [np.maximum(a, 0) ** 2 for a in away]
        left = away[0] <= away[1]
        for first, second, side in ((0, 1, left), (1, 0, ~left)):
            mine, b1, b2 = rows[side], bound[first][side], bound[second][side]
            self._visit(halves[first], mine[b1 <= self._best[mine]])
            self._visit(halves[second], mine[b2 <= self._best[mine]])


def integer_rows(df: DataFrame, key: str, vector: str, label: str, scale: float = SCALE) -> DataFrame:
    """id, label, v (array<long>) of the vectors that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(fine, F.transform(x, lambda c: F.floor(F.lit(scale) * c))).alias("v")).filter("v IS NOT NULL")


def _matrix(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have the length, and their vectors."""
    v = batch.column("v")
    fits = np.diff(v.offsets.to_numpy()) == length
    flat = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, flat.reshape(int(fits.sum()), length)


def _assigned(x: np.ndarray, trees: list[BallTree]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part, tree in zip(np.split(x, len(trees), axis=1), trees):
        yield tree.nearest(np.ascontiguousarray(part))


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position; none where the parts do not divide the vectors' length.

    vectors is read once a round.  The driver gets ``entries`` rows at first and a sum for each entry after a round.
    """
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    least = vectors.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).limit(1).collect()
    if not least:
        return []
    length = len(least[0]["v"])
    first = vectors.filter(F.size("v") == length).orderBy(*order).limit(entries).collect()
    largest = vectors.filter(F.size("v") == length).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if length // parts * (2 * largest) ** 2 >= 1 << 63:
        raise ParameterError(f"a component of {largest} after scaling is too large for 64-bit distances")
    start = np.array([r["v"] for r in first], dtype=np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]

    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            trees = [BallTree(b) for b in books]
            total = [np.zeros_like(b) for b in books]
            count = [np.zeros(len(b), dtype=np.int64) for b in books]
            for batch in batches:
                x = _matrix(batch, length)[1]
                for p, (at, _) in enumerate(_assigned(x, trees)):
                    np.add.at(total[p], at, np.split(x, parts, axis=1)[p])
                    count[p] += np.bincount(at, minlength=len(count[p]))
            for p in range(parts):
                used = np.flatnonzero(count[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(list(total[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        found = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
        wide = "decimal(38,0)"
        sums_of = [F.sum(F.col("s")[i].cast(wide)).alias(f"s{i}") for i in range(length // parts)]
        moved = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums_of).collect()  # a row an entry
        books = [b.copy() for b in books]
        for r in moved:
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length // parts)]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (two hex digits a part), error; null code and error where a vector does not fit the codebooks."""
    length = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for batch in batches:
            fits, x = _matrix(batch, length) if books else (np.zeros(batch.num_rows, bool), None)
            code, error = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
            if fits.any():
                found = list(_assigned(x, trees))
                digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                code[fits] = [d.tobytes().hex() for d in digits]
                error[fits] = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~fits)], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_group_sum(df: DataFrame, group: str, value: str, out: str, total: int) -> DataFrame:
    """Adds out: the sum of value over the rows of equal group, nulls together.

    Sums are made before any join.  A group with many of the rows is met by broadcast (fewer than 1 / HOT_SHARE of them), the rest by a shuffle.
    """
    sums = df.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias(out), F.count(F.lit(1)).alias("_n"))
    sums = written(sums, "group-sums")
    hot = F.col("_n") > F.lit(max(1.0, total * HOT_SHARE))
    same = F.col(group).eqNullSafe(F.col("_g"))
    often, seldom = F.broadcast(sums.filter(hot)), sums.filter(~hot)
    first = df.join(often.withColumn("_hot", F.lit(True)), same, "left")
    met = first.filter("_hot").drop("_g", "_n", "_hot")
    rest = first.filter("_hot IS NULL").drop("_g", "_n", "_hot", out).join(seldom, same).drop("_g", "_n")
    return met.select(*df.columns, out).unionByName(rest.select(*df.columns, out))


def compressed(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """id, label, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    if entries > 256:
        raise ParameterError("a code has two hex digits a part, so there are at most 256 entries")
    vectors = written(integer_rows(df, key, vector, label, scale), "integer-vectors")
    books = fitted(vectors, parts, entries, rounds)
    rows = written(coded(vectors, books), "vector-codes")
    return with_group_sum(rows, "label", "error", "label_error", vectors.count()).withColumn("codebooks_sha256", F.lit(digest(books)))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compressed(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after the other, every part against every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
    SELECT s.vec_id, s.label, s.p, s.x, arg_min(b.e, (s.q + b.q - 2 * list_inner_product(s.x, b.x)) * 256 + b.e) AS e, CAST(min(s.q + b.q - 2 * list_inner_product(s.x, b.x)) AS BIGINT) AS d
    FROM sub s JOIN b{r} b USING (p) GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
    SELECT p, e, list(floor(t / n) ORDER BY i) AS x
    FROM (SELECT p, e, i, sum(c) AS t, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e
), b{r + 1} AS MATERIALIZED (
    SELECT p, e, x, list_inner_product(x, x) AS q FROM (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sub AS MATERIALIZED (
    SELECT *, list_inner_product(x, x) AS q FROM (
        SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))
), b0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x, q FROM sub QUALIFY e < {entries}
), {",".join(steps)},
done AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM done
"""


ORACLE = oracle()
