"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt over groups of bounded size, and a task has one tile: a group of each.
It halves its candidates along their principal directions until at most LEAF are left, and sorts each dimension of
such a block once.  The bound of a block is what a vector standing at the present depth of all its lists would
score.  A query goes through the blocks from the largest bound at depth 0 on and carries its k best scores
along: in a block it walks all lists in step, from the end that its component's sign asks for, and scores what
it meets for the first time in full; the steps get longer as it goes down.  It leaves a block once the bound is
below the k-th best score so far, and the tile once that holds for the next block at depth 0.  A tile's winners
are ranked per query.

Components are floor(scale * x).  Vectors that are null, empty or hold null or non-finite components take
no part; vectors of different length are never compared.  Ties go to the smaller id; rows with the same
id are candidates of their own but never of a query with that id.  A null id takes no part.  Pairs of
query rows with one id are ranked together, each as it stands.  Extra columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table

#: Most vectors in a tile's group of candidates and of queries: two of these are what a task holds.
CANDIDATES, QUERIES = 1 << 16, 1 << 16
#: Groups are not made smaller than this for the sake of more tasks.
LEAST = 1 << 12
#: Most vectors of a block that is walked by itself.
LEAF = 4096
#: Most partitions that tiles are dealt over; beyond as many a partition has several tiles, one after the other.
MOST_PARTITIONS = 10_000


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """id, v (array<long>) of the vectors that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)
    return df.select(F.col(key).alias("id"), F.when(fine, F.transform(x, lambda c: F.floor(F.lit(scale) * c))).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")


def in_tiles(vectors: DataFrame, own: str, blocks: int, other: str, others: int, partitions: int) -> DataFrame:
    """vectors dealt over the groups named own, each with a copy for every one of the other side's groups."""
    dealt = vectors.withColumns({"dims": F.size("v"), own: F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")})
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("dims", "block", "qblock", "id", "v").repartition(partitions, "dims", "block", "qblock")


def halved(x: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """rows in blocks of at most ``most``, halved at the median along the direction in which they vary most."""
    if len(rows) <= most:
        return [rows]
    part = x[rows] - x[rows].mean(axis=0)
    spread = part.T @ part
    along = np.ones(x.shape[1])
    for _ in range(8):
        along = spread @ along
        along /= np.linalg.norm(along) or 1.0
    order = rows[np.argsort(part @ along, kind="stable")]
    return halved(x, order[: len(order) // 2], most) + halved(x, order[len(order) // 2 :], most)


class SortedLists:
    """The per-dimension lists of one group's blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.blocks = halved(self.x.astype(np.float64), np.arange(len(ids)), leaf)
        self.order = [np.argsort(self.x[rows], axis=0, kind="stable").astype(np.int32) for rows in self.blocks]  # a column is a list, ascending
        self.least = np.array([self.x[rows].min(axis=0) for rows in self.blocks])
        self.most = np.array([self.x[rows].max(axis=0) for rows in self.blocks])

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        bounds = self.most @ np.maximum(q, 0) + self.least @ np.minimum(q, 0)
        used = np.flatnonzero(q)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if len(score) == k and score[-1] > bounds[b]:
                break
            best, score = self._walk(b, query_id, q, used, best, score, k)
        return self.ids[best], score

    def _walk(self, b: int, query_id: int, q: np.ndarray, used: np.ndarray, best: np.ndarray, score: np.ndarray, k: int):
        """The k best of those so far and of block b."""
        members, order, down = self.blocks[b], self.order[b][:, used], q[used] > 0
        n, depth, step = len(order), 0, 8
        new = self.ids[members] != query_id
        while depth < n:
            upto = min(n, depth + step) if len(used) else n
            met = np.full(n, not len(used))
            met[order[n - upto : n - depth][:, down]] = True
            met[order[depth:upto][:, ~down]] = True
            met &= new
            new &= ~met
            rows = members[met]
            rows, got = np.concatenate([best, rows]), np.concatenate([score, self.x[rows] @ q])
            if len(rows) > k:
                keep = got >= np.partition(got, len(got) - k)[len(got) - k]
                rows, got = rows[keep], got[keep]
            ranked = np.lexsort((rows, -got))[:k]
            best, score, depth, step = rows[ranked], got[ranked], upto, step * 4
            if depth < n and len(score) == k:
                at = self.x[members[np.where(down, order[n - depth], order[depth - 1])], used]
                if score[-1] > int(at @ q[used]):
                    break
        return best, score


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best of all other rows for each row where is_query holds."""
    vectors = integer_vectors(df, key, vector, scale)
    asking = vectors.filter(is_query)
    n, m = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qblocks = max(1, -(-m // QUERIES))
    blocks = max(1, -(-n // CANDIDATES), min(-(-n // LEAST), -(-tasks // qblocks)))
    # more partitions than tiles, as these are dealt by hash
    partitions = min(4 * blocks * qblocks, MOST_PARTITIONS)
    candidates = in_tiles(vectors, "block", blocks, "qblock", qblocks, partitions)
    queries = in_tiles(asking, "qblock", qblocks, "block", blocks, partitions)

    def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        return ids, table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            lists = SortedLists(*rows_of(left))
            for q, v in zip(*rows_of(right)):
                ids, scores = lists.top(q, v, k)
                found.append((np.full(len(ids), q), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "id", "score"), columns)})

    keys = ("dims", "block", "qblock")
    local = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(tile, "query_id long, id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    found = top_k(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
