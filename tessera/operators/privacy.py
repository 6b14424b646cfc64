"""Privacy of an output: membership and attribute inference from whole tables, and replayed personal data.

Distances are between encoded rows: numbers by their place in the training rows' distribution, anything else
by the bits of its value's number, text columns by vectors that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .encoding import quantiles
from .joins import replayed
from .neighbors import attack_score, membership_attacks, nearest
from .ordered import at_ranks, numbered
from .split import column_sets, sample_rows

#: Runs of membership attacks.
RUNS = 10
#: Rows that the attribute attack goes for unless another number is stated.
ATTACKED = 200
#: Rows that the attribute attack holds against all of its points at once.
SLICE = 1024
#: Distinct values up to this many are numbered in one task.
FEW_VALUES = 10_000
WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def encoder(fit: DataFrame, columns: list[str], landmarks: int = 1000) -> Callable[[DataFrame, str], DataFrame]:
    """What gives key and v (array<double>) of a table: the columns of a row as numbers from 0 to 1; fitted once for all tables.

    A null number is the median; a value that fit doesn't have is all zero bits, as null is.
    """
    kinds, cuts, codes = dict(fit.dtypes), {}, {}
    for c in columns:
        if kinds[c] in NUMBERS:
            cuts[c] = np.array(quantiles(fit, c, landmarks))
            continue
        # what is joined has one row for each distinct value
        values = kept(fit.select(F.col(c).cast("string").alias("_v")).filter("_v IS NOT NULL").distinct().withColumn("_h", F.xxhash64("_v")), "values")
        n = values.count()
        if n <= FEW_VALUES:
            placed = values.withColumn("_code", F.row_number().over(Window.orderBy("_h", "_v")) - 1)
        else:
            placed = numbered(values, [], ["_h", "_v"], F.shiftright("_h", 16).cast("double"), "_code")
        codes[c] = placed.select("_v", (F.col("_code") + 1).alias("_code")), max(1, n.bit_length())

    def encoded(df: DataFrame, key: str) -> DataFrame:
        for c, (known, _) in codes.items():
            df = df.join(known.withColumnsRenamed({"_v": f"_v_{c}", "_code": f"_code_{c}"}), F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
        given = [F.col(c).cast("double").alias(f"_{i}") if c in cuts else F.coalesce(F.col(f"_code_{c}"), F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate(columns)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for i, c in enumerate(columns):
                    x = batch.column(i + 1)
                    if c in cuts:
                        parts.append(_place(x.to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False), cuts[c])[:, None])
                    else:
                        parts.append((x.to_numpy()[:, None] >> np.arange(codes_bits[c])) & 1)
                v = np.concatenate(parts, axis=1, dtype=np.float64) if parts else np.zeros((batch.num_rows, 0))
                ends = pa.array(np.arange(batch.num_rows + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], [key, "v"])

        return df.select(key, *given).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, v array<double>")

    codes_bits = {c: n for c, (_, n) in codes.items()}
    return encoded


def encoded_rows(df: DataFrame, fit: DataFrame, key: str, columns: list[str], landmarks: int = 1000) -> DataFrame:
    """encoder() of one table."""
    return encoder(fit, columns, landmarks)(df, key)


def _place(x: np.ndarray, missing: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    n = len(cuts)
    if not n:
        return np.zeros(len(x))
    at = np.searchsorted(cuts, x, side="right")
    low, high = cuts[np.maximum(at, 1) - 1], cuts[np.minimum(at + 1, n) - 1]
    inside = (at - 1 + np.divide(x - low, high - low, out=np.zeros(len(x)), where=high != low)) / (n - 1)
    return np.where(missing, 0.5, np.where(at == 0, 0.0, np.where(at >= n, 1.0, inside)))


def membership_inference(train: DataFrame, output: DataFrame, test: DataFrame, key: str, columns: list[str], text: str | None = None, runs: int = RUNS, seed: int = 1, most_test: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(attacks, score): 4 thresholds times 9 shares times ``runs`` attacks, each graded.

    In run r an attacker sees the r-th block of training rows and all test rows, and calls those members that are
    near the output.  Rows in a run are shuffled by hash.  text names a vector column whose cosine distance is
    added to the other columns' distance, each scaled by its largest and weighted by its number of columns.
    All test rows take part, unless most_test, which is off, says how many by hash of the key.
    """
    if most_test is not None:
        test = sample_rows(test, most_test, key, seed)
    size, total = test.count(), train.count()
    taken = [key, *columns, *([text] if text else [])]
    # all of them need no choice
    members = train.select(*taken) if runs * size >= total else kept(sample_rows(train, runs * size, key, seed).select(*taken), "members")
    attacked = members.withColumn("member", F.lit(True)).unionByName(test.select(*taken).withColumn("member", F.lit(False)))
    whole = dict(train.dtypes)[key] == dict(test.dtypes)[key] in WHOLE
    if whole:
        low, high, missing = attacked.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
        whole = not missing and low is not None and -(1 << 62) <= low and high < 1 << 62
    # a row's number tells its key and side where it can
    row = (F.shiftleft(F.col(key).cast("long"), 1) + F.col("member").cast("long")) if whole else F.xxhash64("member", key)
    attacked = attacked.withColumn("_row", row)
    out = output.select(F.xxhash64(F.lit(2), F.col(key)).alias("_row"), *columns, *([text] if text else []))
    found = []
    if columns:
        encoded = encoder(train, columns)
        near = nearest(encoded(out, "_row"), encoded(attacked, "_row"), "_row", "v", 1)
        found.append((near.select(F.col("query_id").alias("_row"), F.col("distance").alias("d0")), len(columns)))
    if text:
        near = nearest(out, attacked, "_row", text, 1, "cosine")
        found.append((near.select(F.col("query_id").alias("_row"), (1 - F.col("similarity")).alias(f"d{len(found)}")), 1))
    # rows that share a key have the nearest's distance, and stand as often as there are of them
    parts = [d.groupBy("_row").agg(F.min(f"d{i}").alias(f"d{i}"), F.count(F.lit(1)).alias(f"_n{i}")) for i, (d, _) in enumerate(found)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.join(p, "_row")
    rows = rows.withColumn("n", F.greatest(*[f"_n{i}" for i in range(len(found))]) if len(found) > 1 else F.col("_n0"))
    named = [F.shiftright("_row", 1).cast(dict(train.dtypes)[key]).alias(key), (F.col("_row").bitwiseAND(1) == 1).alias("member")] if whole else [key, "member"]
    if not whole:
        rows = rows.join(attacked.select("_row", key, "member").distinct(), "_row")
    rows = kept(rows.select(*named, "n", *[f"d{i}" for i in range(len(found))]), "nearest")
    largest = rows.agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(found))]).first()
    weights = sum(w for _, w in found)
    distance = sum((F.col(f"d{i}") / F.lit(largest[f"d{i}"] or 1.0) * F.lit(w / weights) for i, (_, w) in enumerate(found)), F.lit(0.0))
    rows = rows.select(key, "member", "n", distance.alias("distance"))
    # blocks of members by their hash: only the rows at a block's end are looked for
    inside = rows.filter("member").withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    wanted = train.sparkSession.createDataFrame([(r, r * size) for r in range(1, runs)], "no int, rank long")
    ends = at_ranks(inside, None, ["_h", key], "n", wanted, F.shiftright("_h", 52), True).orderBy("no").collect()  # at most ``runs``
    after = lambda e: (F.col("_h") > F.lit(e["_h"])) | ((F.col("_h") == F.lit(e["_h"])) & (F.col(key) >= F.lit(e[key])))
    inside = inside.withColumn("run", sum((after(e).cast("int") for e in ends), F.lit(0))).withColumn("times", F.col("n") * F.col("n"))
    cut = [e for e in ends if e["_before"]]  # rows of one key on both sides of a block's end
    parted = inside.filter("false").select("run", key, "member", "distance", "times")
    if cut:
        stays = F.col(key).isin([e[key] for e in cut])
        n = {r[key]: r["n"] for r in inside.filter(stays).collect()}
        pieces = []
        for k in n:
            marks = [0, *[e["_before"] for e in cut if e[key] == k], n[k]]
            first = min(e["no"] for e in cut if e[key] == k) - 1
            pieces += [(first + i, k, b - a) for i, (a, b) in enumerate(zip(marks, marks[1:]))]
        split = train.sparkSession.createDataFrame(pieces, f"_run int, `{key}` {dict(train.dtypes)[key]}, _c long")
        parted = inside.filter(stays).join(F.broadcast(split), key).select(F.col("_run").alias("run"), key, "member", "distance", (F.col("n") * F.col("_c")).alias("times"))
        inside = inside.filter(~stays)
    outside = rows.filter("NOT member").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("times", F.col("n"))
    every = inside.select("run", key, "member", "distance", "times").unionByName(parted).unionByName(outside.select("run", key, "member", "distance", "times"))
    attacks = membership_attacks(every, "run", F.xxhash64("run", "member", key), "member", "distance", weight="times", even=True)
    return attacks, attack_score(attacks)


def attribute_inference(train: DataFrame, output: DataFrame, key: str, columns: list[str], known: int = 3, k: int = 5, attacked: int = ATTACKED, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(guesses, score): of each attacked row some columns are known, others are guessed from its k nearest output rows.

    Every attacked row has a set of known columns of its own.  ``attacked`` states how many rows, by hash of the key, are under
    attack; they are held against all output rows, and only the k nearest of each leave a task.  A number is guessed by the
    mean and right within one per cent, anything else by the mode.  guesses: column, n, accuracy, entropy; score has
    the number of rows that were attacked beside it.
    """
    kinds = dict(train.dtypes)
    chosen = kept(sample_rows(train, attacked, key, seed), "attacked")
    sets = column_sets(columns, known, attacked, seed)
    fit = encoded_facts(output, columns)
    v = encoded_by_facts(columns, kinds, fit)
    targets = chosen.select(key, v.alias("v"), *columns).collect()  # as many as ``attacked`` states
    masks = np.array([[float(c in sets[i % len(sets)]) for c in columns] for i in range(len(targets))])
    points = np.array([r["v"] for r in targets], dtype=float).reshape(-1, len(columns))
    nominal = np.array([kinds[c] not in NUMBERS for c in columns])
    keys = [r[key] for r in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a task's rows for each point: products of matrices tell which rows can be among them, and only those are measured."""
        at, far, found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        limit, weights = np.full(len(points), np.inf), masks * ~nominal
        numbers, labels = np.where(nominal, 0.0, points), np.flatnonzero(nominal)
        own = (weights * numbers * numbers).sum(1)
        for batch in batches:
            every = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for start in range(0, batch.num_rows, SLICE):
                ids, x = (c[start : start + SLICE] for c in every)
                y = np.where(nominal, 0.0, x)
                cost = (y * y) @ weights.T - 2 * (y @ (weights * numbers).T) + own
                for c in labels:
                    cost += (x[:, c, None] != points[:, c]) * masks[:, c]
                slack = 1e-9 * (1 + np.nanmax((y * y).sum(1)) + own.max())
                if len(x) >= k and np.isinf(limit).any():
                    limit = np.fmin(limit, np.partition(cost, k - 1, axis=0)[k - 1] + slack)
                r, n = np.nonzero(cost <= limit + slack)
                if not len(r):
                    continue
                gap = np.where(nominal, (x[r] != points[n]).astype(float), (x[r] - points[n]) ** 2)
                at, far, found = np.append(at, n), np.append(far, (gap * masks[n]).sum(1)), np.append(found, ids[r])
                order = np.lexsort((found, far, at))
                at = at[order]
                keep = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, far, found = at[keep], far[order][keep], found[order][keep]
                last = np.flatnonzero(np.bincount(at, minlength=len(points)) >= k)
                limit[last] = far[np.searchsorted(at, last, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found), pa.array(far)], ["at", "id", "d"])

    rows = output.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    best = Window.partitionBy("at").orderBy("d", "id")
    near = rows.mapInArrow(run, "at int, id long, d double").withColumn("_no", F.row_number().over(best)).filter(F.col("_no") <= k).select("at", "id")
    seen = near.join(output.select(F.col(key).cast("long").alias("id"), *columns), "id")
    guess = [(F.avg(c) if kinds[c] in NUMBERS else F.mode(F.col(c).cast("string"), True)).alias(c) for c in columns]
    truth = train.sparkSession.createDataFrame([(i, keys[i], sets[i % len(sets)]) for i in range(len(keys))], f"at int, {key} {kinds[key]}, known array<string>")
    both = seen.groupBy("at").agg(*guess).join(truth, "at").join(chosen.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key)
    right = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) <= 0.01 * F.abs(F.col(f"_{c}")) if kinds[c] in NUMBERS else F.col(c) == F.col(f"_{c}").cast("string")
    cells = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~F.array_contains("known", c) & F.col(f"_{c}").isNotNull(), F.coalesce(right(c), F.lit(False))).alias("right")) for c in columns]))).filter("right IS NOT NULL")
    total = train.count()
    share = F.col("n") / F.lit(total)
    counted = [train.groupBy(F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(c).alias("column"), (-F.sum(share * F.log(share))).alias("entropy")) for c in columns]
    entropy = reduce(DataFrame.unionByName, counted)
    guesses = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy")).join(entropy, "column")
    # columns with much to tell weigh more; from an accuracy of 0.7 on there is no protection
    mean = F.sum(F.col("accuracy") * F.col("entropy")) / F.nullif(F.sum("entropy"), F.lit(0.0))
    score = guesses.agg(F.coalesce(mean, F.lit(0.0)).alias("accuracy")).withColumns({"score": F.bround(10 * (1 - F.least(F.col("accuracy"), F.lit(0.7)) / 0.7), 1), "attacked": F.lit(len(targets))})
    return guesses, score


def encoded_facts(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] in NUMBERS]
    row = df.agg(F.lit(1).alias("one"), *[F.avg(c).alias(f"{c}_m") for c in numbers], *[F.stddev_pop(c).alias(f"{c}_s") for c in numbers]).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in numbers}


def encoded_by_facts(columns: list[str], kinds: dict[str, str], facts: dict[str, tuple]) -> Column:
    """Numbers scaled to the mean and deviation of the output, null as the mean; other values by a hash, equal or not."""
    number = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(facts[c][0])) - F.lit(facts[c][0])) / F.lit(facts[c][1])
    label = lambda c: F.shiftright(F.xxhash64(F.col(c).cast("string")), 12).cast("double")
    return F.array(*[number(c) if kinds[c] in NUMBERS else label(c) for c in columns])


def replay(reference: DataFrame, output: DataFrame, columns: list[str]) -> DataFrame:
    """column and the counts of joins.replayed() of every personal column, over all rows."""
    parts = [replayed(output, reference, c).select(F.lit(c).alias("column"), "*") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
