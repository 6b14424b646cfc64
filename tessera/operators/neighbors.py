"""Exact nearest neighbours by cells around pivots, the two-sample test, and privacy attacks.

A search deals the base's distinct vectors to the cell of their nearest pivot, and sends a query to its nearest
cell first.  Its k-th distance there bounds what can still win: a cell is never visited if it ends, by its radius, before that distance, or if
the plane midway between its pivot and the query's nearest pivot is farther, as no vector of the cell lies on the query's side.
The task that searches the first cell says which others are left.  Inside a cell the same is done with smaller cells.
Vectors that many rows share are searched once, with as many of their smallest keys as can be among the k best;
vectors that many queries share are looked for once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import attack_grade
from ..sources.shared import kept
from .ordered import at_ranks

#: Distinct vectors of a cell, about; cells, at most, and numbers in all pivots, as these go to every task.
CELL, MOST_CELLS, MOST_PIVOT_NUMBERS = 1 << 14, 4096, 1 << 22
#: Every vector is held against all pivots, so more cells than this are made only to keep the numbers of a cell below the second.
ENOUGH_CELLS, MOST_CELL_NUMBERS = 1024, 1 << 24
#: Most visits of a cell that one task answers, about; a cell with more of them is copied.
VISITS = 1 << 14
#: Numbers of a cell's vectors, and of its visits, about, where vectors are long; vectors of the smaller cells, at least.
CELL_NUMBERS, INNER = 1 << 21, 64
#: Queries are searched by distinct vectors where these are at most this share of them.
SHARED = 0.5
#: Numbers of one tile of distances.
TILE = 1 << 22


def _points(df: DataFrame, key: str, vector: str, metric: str, side: int) -> DataFrame:
    """key and v: vectors as doubles; for cosine of length 1, with two numbers more that tell zero vectors of either side."""
    x = F.transform(vector, lambda c: c.cast("float").cast("double"))
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), x.alias("v"))
    if metric != "cosine":
        return rows
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    flat = [(F.col("_n") == 0).cast("double") if side == s else F.lit(0.0) for s in (0, 1)]
    return rows.withColumn("_n", norm).select("key", F.concat(F.transform("v", lambda c: F.when(F.col("_n") == 0, 0.0).otherwise(c / F.col("_n"))), F.array(*flat)).alias("v"))


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = (x * -2) @ y.T  # in place from here on: a tile is large
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)
    return np.maximum(out, 0, out=out)


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where mask is true, by row; numpy is fastest at it in one dimension."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1]) if mask.shape[1] else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _vectors(arrays: np.ndarray) -> pa.Array:
    n, d = arrays.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(arrays.ravel()))


def _ragged(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of rows, value): the values of the lists at rows, one after the other."""
    starts, n = np.cumsum(sizes) - sizes, sizes[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return of, values[np.repeat(starts[rows], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]


def best_of_tile(x: np.ndarray, keys: np.ndarray, sizes: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of y, key, squared distance) of the k best for each row of y, ties to the smaller key.

    A partition by distance finds what can be among them; only that is measured exactly and ordered.
    """
    step, kth = max(1, TILE // max(len(x), 1)), min(k, len(x)) - 1
    wide = np.concatenate([x * -2, (x * x).sum(1)[:, None]], axis=1).T
    for at in range(0, len(y), step):
        q = y[at : at + step]
        own = (q * q).sum(1)
        cost = np.concatenate([q, np.ones((len(q), 1))], axis=1) @ wide  # squared distances less the query's own square
        limit = np.partition(cost, kth, axis=1)[:, kth] if kth else cost.min(axis=1)
        limit = limit + 1e-9 * (own + np.maximum(limit + own, 0)) + 1e-12
        r, c = _true(cost <= limit[:, None])
        exact = ((q[r] - x[c]) ** 2).sum(1)
        of, key = _ragged(keys, sizes, c)
        r, exact = r[of], exact[of]
        order = np.lexsort((key, exact, r))
        r = r[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        yield r[keep] + at, key[order][keep], exact[order][keep]


def nearest_with(gap: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """True for the nearest cells of each row that have ``most`` keys together."""
    first = np.zeros(gap.shape, dtype=bool)
    gap, n = np.where(size > 0, gap, np.inf), min(most, gap.shape[1])
    near = np.argpartition(gap, n - 1, axis=1)[:, :n] if n > 1 else gap.argmin(axis=1)[:, None]  # no more can be needed
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(gap, near, axis=1), axis=1, kind="stable"), axis=1)
    before = np.cumsum(size[near], axis=1) - size[near]
    np.put_along_axis(first, near, before < most, axis=1)
    return first & (size > 0)


def left_of(gap: np.ndarray, home: np.ndarray, near: np.ndarray, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray, scale: float, go: np.ndarray) -> np.ndarray:
    """Which of the cells in go can have a vector within bound of each query.

    gap: distances to the cells' pivots; home and near: another pivot of each query, best its nearest, and the distance to it.
    """
    go = go & (gap - radius <= bound[:, None])
    r, c = _true(go)
    apart = np.sqrt(((pivots[c] - home[r]) ** 2).sum(1))
    # squares are right to some 1e-15 of the scale's; pivots that lie close together make that larger
    excess = gap[r, c] ** 2 - near[r] ** 2 - 1e-12 * (bound[r] + scale) ** 2
    go[r, c] = ~(excess > 2 * apart * bound[r])
    return go


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and its distance."""
    cell, far, step = np.zeros(len(x), np.int32), np.zeros(len(x)), max(1, TILE // max(len(pivots), 1))
    for at in range(0, len(x), step):
        d = _squares(x[at : at + step], pivots)
        cell[at : at + step], far[at : at + step] = d.argmin(1), np.sqrt(d.min(1))
    return cell, far


def best_of_cell(x: np.ndarray, keys: np.ndarray, sizes: np.ndarray, y: np.ndarray, k: int, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As best_of_tile(), by smaller cells inside x; a vector farther than its query's limit may be left out.

    Rows that have to see more than a quarter of the smaller cells see all of x at once.
    """
    m = min(len(x) // INNER, int(np.sqrt(len(x))))
    if m < 4 or len(x) * len(y) <= TILE // 4:
        yield from best_of_tile(x, keys, sizes, y, k)
        return
    pivots = x[np.arange(m) * len(x) // m]
    cell, far = nearest_pivots(x, pivots)
    order = np.argsort(cell, kind="stable")
    x, keys, sizes = x[order], _ragged(keys, sizes, order)[1], sizes[order]
    at, count = np.searchsorted(cell[order], np.arange(m + 1)), np.bincount(cell[order], sizes, m).astype(np.int64)
    place, radius = np.append(0, np.cumsum(sizes)), np.zeros(m)
    np.maximum.at(radius, cell, far)
    largest = float(np.sqrt((x * x).sum(1).max()))

    def visit(q: np.ndarray, go: np.ndarray) -> list:
        r, c = _true(go)
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        cuts, found = np.searchsorted(c, np.arange(m + 1)), []
        for i in np.flatnonzero(np.diff(cuts)):
            rows, a, b = r[cuts[i] : cuts[i + 1]], at[i], at[i + 1]
            found += [(rows[n], key, d) for n, key, d in best_of_tile(x[a:b], keys[place[a] : place[b]], sizes[a:b], q[rows], k)]
        return found

    def best(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, key, d = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((key, d, r))
        r = r[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], key[order][keep], d[order][keep]

    step = max(1, TILE // m)
    for start in range(0, len(y), step):
        q = y[start : start + step]
        gap = np.sqrt(_squares(q, pivots))
        first = nearest_with(gap, count, k)
        r, key, d = best(visit(q, first))
        full, kth = np.bincount(r, minlength=len(q)) >= k, np.zeros(len(q))
        np.maximum.at(kth, r, np.sqrt(d))
        bound = np.fmin(limit[start : start + step], np.where(full, kth, np.inf)) + 1e-6 * (np.sqrt((q * q).sum(1)) + largest)
        rest = left_of(gap, pivots[gap.argmin(1)], gap.min(1), pivots, radius, bound, largest, ~first & (count > 0))
        all_of = rest.sum(1) > m // 4
        if all_of.any():
            rows = np.flatnonzero(all_of)
            for n, found_key, found_d in best_of_tile(x, keys, sizes, q[rows], k):
                yield rows[n] + start, found_key, found_d
        rest[all_of] = False
        some = ~all_of[r]
        if some.any():
            r, key, d = best([(r[some], key[some], d[some]), *visit(q, rest)])
            yield r + start, key, d


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """query_id, rank, key, distance (l2) or similarity (cosine) of the k best; ties by key.

    Rows without a vector take no part.  The driver gets pivots, and a size and a radius for each.
    """
    most = k + skip_self
    points = _points(base, key, vector, metric, 0)
    if most == 1:
        points = points.groupBy("v").agg(F.array(F.min("key")).alias("keys"))
    else:
        few = Window.partitionBy("v").orderBy("key")
        points = points.withColumn("_no", F.row_number().over(few)).filter(F.col("_no") <= most).groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    points = kept(points, "points")
    asking = _points(queries, key, vector, metric, 1)
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    held = lambda most: min(most, max(1024, CELL_NUMBERS // max(dims or 1, 1)))
    cells = max(1, min(n // held(CELL), max(ENOUGH_CELLS, n * (dims or 1) // MOST_CELL_NUMBERS), MOST_CELLS, MOST_PIVOT_NUMBERS // max(dims or 1, 1)))
    askers = None
    if cells > 1:
        asking = kept(asking, "asking")
        rows, different = asking.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("v"))).first()
        if different <= SHARED * rows:  # a vector that many queries share is looked for once
            askers = asking
            asking = kept(askers.select("v").distinct().select(F.monotonically_increasing_id().alias("key"), "v"), "asked")
    pivots = np.array([r["v"] for r in points.orderBy(F.xxhash64("v"), "v").limit(cells).select("v").collect()], dtype=np.float64).reshape(-1, dims or 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest_pivots(_matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), batch.column("v"), batch.column("keys")], ["cell", "far", "v", "keys"])

    dealt = points.mapInArrow(assign, "cell int, far double, v array<double>, keys array<long>")
    if cells > 1:
        dealt = kept(dealt, "cells")
    size, held_by, radius = np.zeros(max(cells, 1), dtype=np.int64), np.zeros(max(cells, 1), dtype=np.int64), np.zeros(max(cells, 1))
    for r in dealt.groupBy("cell").agg(F.sum(F.size("keys")).alias("n"), F.count(F.lit(1)).alias("vectors"), F.max("far").alias("far")).collect():
        size[r["cell"]], held_by[r["cell"]], radius[r["cell"]] = r["n"], r["vectors"], r["far"]
    largest = float(np.sqrt((pivots * pivots).sum(1).max(initial=0)) + radius.max(initial=0))
    # a query starts where k are to be found, if there is such a cell
    first_of = size >= (most if size.max(initial=0) >= most else 1)
    carried = askers is not None
    step = max(1, min(1024, TILE // cells))

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and first_of.any():
                at = np.flatnonzero(first_of)
                cell = at[nearest_pivots(_matrix(batch.column("v")), pivots[at])[0]] if cells > 1 else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("key"), batch.column("v"), pa.array(np.full(batch.num_rows, np.inf))], ["cell", "id", "v", "limit"])

    def lists(ids: np.ndarray, n: np.ndarray, keys: np.ndarray, d: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
        ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        return pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(d))

    def others(y: np.ndarray, own: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of y, cell) of the cells beside own that can have a vector within kth, by row."""
        apart, near = np.sqrt(((pivots - pivots[own]) ** 2).sum(1)), np.sqrt(((y - pivots[own]) ** 2).sum(1))
        bound = kth + 1e-6 * (np.sqrt((y * y).sum(1)) + largest)
        # the plane between is at least half the pivots' distance less near away; queries that reach about as far go together
        reach, found = near + bound, []
        order = np.argsort(reach, kind="stable")
        for start in range(0, len(y), step):
            rows = order[start : start + step]
            cell = np.flatnonzero((apart <= 2 * (reach[rows[-1]] + 1e-6 * largest)) & (size > 0) & (np.arange(cells) != own))
            gap = np.sqrt(_squares(y[rows], pivots[cell]))
            r, c = _true(left_of(gap, np.repeat(pivots[own][None], len(rows), axis=0), near[rows], pivots[cell], radius[cell], bound[rows], largest, np.ones(gap.shape, dtype=bool)))
            found.append((rows[r], cell[c].astype(np.int32)))
        at, cell = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(at, kind="stable")
        return at[order], cell[order]

    def tile(left: pa.Table, right: pa.Table, first: bool) -> pa.Table:
        """Each query with its best of the cell; of a first visit also with the cells that are left, and its vector where it is needed."""
        names = ["id", "keys", "distances", "rest", "v"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()))], names)
        held = left.column("keys").combine_chunks()
        x, y, limit = _matrix(left.column("v")), _matrix(right.column("v")), right.column("limit").to_numpy()
        r, key, d = (np.concatenate(c) for c in zip(*best_of_cell(x, held.flatten().to_numpy(), np.diff(held.offsets.to_numpy()), y, most, limit)))
        d = np.sqrt(d)
        order = np.lexsort((key, d, r))
        key, d = key[order], d[order]
        n = np.bincount(r, minlength=len(y))
        kth = np.full(len(y), np.inf)
        full = np.flatnonzero(n >= most)
        kth[full] = d[np.cumsum(n)[full] - 1]
        at, cell = others(y, left.column("cell")[0].as_py(), kth) if first and cells > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        rest = np.bincount(at, minlength=len(y))
        sent = rest > 0 if not carried else np.full(len(y), first)
        vectors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sent * y.shape[1])), pa.int32()), pa.array(y[sent].ravel()))
        return pa.table([*lists(right.column("id").to_numpy(), n, key, d), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rest)), pa.int32()), pa.array(cell)), vectors], names)

    def search(sent: DataFrame, first: bool) -> DataFrame:
        copies = [1] * max(cells, 1)
        if cells > 1:
            sent = kept(sent, "visits")
        for r in sent.groupBy("cell").count().collect():
            copies[r["cell"]] = -(-r["count"] // max(held(VISITS), int(held_by[r["cell"]])))
        n_copies = F.element_at(F.array(*map(F.lit, copies)), F.col("cell") + 1)
        left = dealt.select("cell", "v", "keys", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("part"))
        right = sent.withColumn("part", F.pmod(F.xxhash64("id", "v"), n_copies.cast("long")).cast("int"))
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(lambda a, b: tile(a, b, first), "id long, keys array<long>, distances array<double>, rest array<int>, v array<double>")

    best = F.arrays_zip("distances", "keys").alias("best")
    found = search(asking.mapInArrow(first_visits, "cell int, id long, v array<double>, limit double"), True)
    if cells > 1:
        # rows of a query's key need not be one, so those that go on get a number of their own
        found = kept(found, "near")
        open_ = kept(found.filter("size(rest) > 0").withColumn("at", F.monotonically_increasing_id()), "open")
        limit = F.when(F.size("distances") >= most, F.element_at("distances", -1)).otherwise(float("inf"))
        again = search(open_.select(F.explode("rest").alias("cell"), F.col("at").alias("id"), "v", limit.alias("limit")), False)
        every = open_.select(F.col("at").alias("id"), best).unionByName(again.select("id", best)).select("id", F.inline("best"))
        merged = every.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distances", "keys"))), 1, most).alias("best"))
        merged = open_.select("at", F.col("id").alias("own"), "v").join(merged, F.col("at") == F.col("id")).select(F.col("own").alias("id"), "v", "best")
        found = found.filter("size(rest) = 0").select("id", "v", best).unionByName(merged)
    else:
        found = found.select("id", "v", best)
    if askers is not None:
        found = askers.withColumn("_h", F.xxhash64("v")).join(found.select(F.xxhash64("v").alias("_h"), "v", "best"), ["_h", "v"]).select(F.col("key").alias("id"), "best")
    wanted = F.slice(F.filter("best", lambda b: b["keys"] != F.col("id")) if skip_self else F.col("best"), 1, k)
    ranked = found.select(F.col("id").alias("query_id"), wanted.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", F.col("rank") + 1, F.col("b.keys").alias("key"), F.col("b.distances").alias("distance"))
    ranked = ranked.toDF("query_id", "rank", "key", "distance")
    value = F.col("distance") if metric != "cosine" else 1 - F.col("distance") * F.col("distance") / 2
    return ranked.select("query_id", "rank", "key", value.alias("similarity" if metric == "cosine" else "distance"))


def ks_one_sided(df: DataFrame, value: str, side: str) -> DataFrame:
    """less, greater: largest excess of side 1's distribution function over side 0's, and the other way.

    Values are counted first, so the ordered pass sees one row per distinct value; it runs over ranges of
    values with the sums of the ranges before added.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(*[F.sum(F.when(F.col(side) == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1)])
    cuts = counts.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    part = sum((F.col("v") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("n0").alias("p0"), F.sum("n1").alias("p1"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", *[F.coalesce(F.sum(f"p{s}").over(before), F.lit(0)).alias(f"b{s}") for s in (0, 1)], *[F.sum(f"p{s}").over(Window.partitionBy()).alias(f"t{s}") for s in (0, 1)])
    upto = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    f = [(F.col(f"b{s}") + F.sum(f"n{s}").over(upto)) / F.col(f"t{s}") for s in (0, 1)]
    gaps = counts.join(F.broadcast(base), "part").select((f[1] - f[0]).alias("d"))
    return gaps.agg(F.greatest(F.max("d"), F.lit(0.0)).alias("less"), F.greatest(F.max(-F.col("d")), F.lit(0.0)).alias("greater"))


def membership_attacks(distances: DataFrame, run: str, order: Column, member: str, distance: str, thresholds=(0.4, 0.3, 0.2, 0.1), shares=tuple(i / 10 for i in range(2, 11)), weight: str | None = None, even: bool = False) -> DataFrame:
    """run, threshold, share, tp, fp, precision, accuracy, grade of every attack.

    A row is called a member where its distance, scaled by the run's largest, is below the threshold; a
    share of the rows in order (a number) takes part.  Precision and accuracy have one decimal.  Rows are counted once,
    by how many thresholds they are below and how many shares they are beyond; the attacks add those counts up.  Only the rows around
    the end of a share are put in order.  weight names how many times a row stands; even says that order is spread over all long numbers.
    """
    rows = distances.select(run, order.alias("_order"), F.col(member).alias("_real"), F.col(distance).alias("_d"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    runs = kept(rows.groupBy(run).agg(F.sum("_w").alias("_n"), F.nullif(F.max("_d"), F.lit(0.0)).alias("_most")), "runs")
    sort = F.col("_order").cast("double")
    cuts = F.array(*[F.struct(F.lit(i).alias("no"), F.floor(F.lit(s) * F.col("_n")).alias("rank")) for i, s in enumerate(shares)])
    ends = at_ranks(rows, run, ["_order", "_real", "_d"], "_w", runs.select(run, F.inline(cuts)), F.shiftright("_order", 52) if even else sort, even)
    ends = kept(ends.join(runs, run), "ends")
    by_run = kept(ends.groupBy(run).agg(*[F.max(F.when(F.col("no") == i, F.struct("_order", "_real", "_d"))).alias(f"_e{i}") for i in range(len(shares))]), "ends")
    below = sum(((F.coalesce(F.col("_d") / F.col("_most"), F.lit(0.0)) < t).cast("int") for t in thresholds), F.lit(0))
    rows = rows.join(runs, run).join(by_run, run, "left")

    def after(end: str) -> Column:
        here, there = F.struct("_real", "_d"), F.struct(F.col(f"{end}._real"), F.col(f"{end}._d"))
        return F.coalesce((F.col("_order") > F.col(f"{end}._order")) | ((F.col("_order") == F.col(f"{end}._order")) & (here >= there)), F.lit(False))

    beyond = sum((after(f"_e{i}").cast("int") for i in range(len(shares))), F.lit(0))
    counts = rows.groupBy(run, below.alias("_below"), beyond.alias("_beyond"), "_real").agg(F.sum("_w").alias("_c"))
    # a row that is below m thresholds is below the m largest; one that is beyond m shares is beyond the m smallest
    combos = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("share"), F.lit(sum(u > t for u in thresholds)).alias("_larger"), F.lit(sum(u < s for u in shares)).alias("_smaller")) for t in thresholds for s in shares])
    grid = counts.withColumn("combo", F.explode(combos)).select(run, "_below", "_beyond", "_real", "_c", "combo.*").filter(F.col("_beyond") <= F.col("_smaller"))
    # of the rows that are alike at a share's end some still take part
    alike = ends.filter("_before > 0").select(run, below.alias("_below"), "_real", F.col("_before").alias("_c"), F.element_at(F.array(*map(F.lit, shares)), F.col("no") + 1).alias("share"), F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(sum(u > t for u in thresholds)).alias("_larger")) for t in thresholds])).alias("combo"))
    grid = grid.unionByName(alike.select(run, "_below", "_real", "_c", "share", "combo.*"), allowMissingColumns=True)
    called, real = F.col("_below") > F.col("_larger"), F.col("_real")
    total = lambda fits: F.coalesce(F.sum(F.when(fits, F.col("_c"))), F.lit(0))
    sums = grid.groupBy(run, "threshold", "share").agg(total(called & real).alias("tp"), total(called & ~real).alias("fp"), total(~called & ~real).alias("tn"), F.sum("_c").alias("n"))
    precision = F.bround(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), 1)
    accuracy = F.bround((F.col("tp") + F.col("tn")) / F.col("n"), 1)
    return sums.withColumns({"precision": precision, "accuracy": accuracy}).withColumn("grade", attack_grade(F.col("precision"), F.col("accuracy"))).drop("tn", "n")


def attack_score(attacks: DataFrame) -> DataFrame:
    """score: 10 when every attack gets the best grade, 0 when every attack gets the worst."""
    return attacks.agg(F.bround(F.avg("grade"), 2).alias("mean")).select("mean", F.bround((F.col("mean") - 1) / 2 * 10, 1).alias("score"))


def attribute_inference(attacked: DataFrame, output: DataFrame, key: str, known: list[str], target: str, k: int = 5, tolerance: float = 0.01) -> DataFrame:
    """key, truth, guess, correct: the target of each attacked row guessed from its k nearest output rows by the known columns.

    The attacked rows are a small stated set; numbers are guessed by their mean, anything else by its mode.
    Columns are scaled to the output's mean and deviation.
    """
    facts = output.agg(*[F.avg(c).alias(f"{c}_m") for c in known], *[F.stddev_pop(c).alias(f"{c}_s") for c in known]).first()
    scaled = lambda df: df.select(key, target, F.array(*[(F.coalesce(F.col(c), F.lit(facts[f"{c}_m"])) - (facts[f"{c}_m"] or 0.0)) / (facts[f"{c}_s"] or 1.0) for c in known]).alias("v"))
    a, o = scaled(attacked), scaled(output)
    near = nearest(o, a, key, "v", k).join(o.select(F.col(key).alias("key"), F.col(target).alias("seen")), "key")
    numeric = dict(attacked.dtypes)[target] in ("double", "float", "int", "bigint")
    guess = F.avg("seen") if numeric else F.mode("seen", True)
    guesses = near.groupBy("query_id").agg(guess.alias("guess"))
    both = attacked.select(F.col(key).alias("query_id"), F.col(target).alias("truth")).filter("truth IS NOT NULL").join(guesses, "query_id")
    right = F.abs(F.col("guess") - F.col("truth")) <= tolerance * F.col("truth") if numeric else F.col("guess") == F.col("truth")
    return both.select(F.col("query_id").alias(key), "truth", "guess", right.alias("correct"))
