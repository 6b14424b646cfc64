"""Samples and splits that are the same on every run: rows are ordered by a hash of their key."""

from __future__ import annotations

from math import comb
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..sources.shared import kept
from .ordered import numbered, running_sum, sort_value

# The holdout's default share, its least and most rows, and the least rows of a table.
DEFAULT_SHARE, LEAST_HOLDOUT, MOST_HOLDOUT, LEAST_ROWS = 0.05, 10, 2000, 200
#: Samples up to this many rows are sorted in one task.
SORTED_SAMPLE = 10_000
#: Bits of a hash by which split_groups() counts groups first.
RANGE_BITS = 10


def hash_order(key: str | list[str], seed: int):
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in ([key] if isinstance(key, str) else key)])


def sample_rows(df: DataFrame, n: int, key: str | list[str], seed: int = 424242) -> DataFrame:
    """n rows without replacement: those of the smallest hashes.

    Up to SORTED_SAMPLE rows are picked by sorting; more are found range by range, so that no task holds them all.
    """
    keys = [key] if isinstance(key, str) else key
    if n <= SORTED_SAMPLE:
        return df.orderBy(hash_order(key, seed), *keys).limit(n)
    rows = df.withColumns({"_all": F.lit(0), "_h": hash_order(key, seed)})
    return first_by_hash(rows, "_all", n, keys).drop("_all")


def split_rows(df: DataFrame, test: int, key: str | list[str], seed: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """(train, test) with exactly ``test`` rows of unique keys in test; None for none."""
    if test <= 0:
        return df, None
    keys = [key] if isinstance(key, str) else key
    chosen = sample_rows(df.select(*keys), test, key, seed)
    return df.join(chosen, keys, "left_anti"), df.join(chosen, keys, "left_semi")


def split_groups(df: DataFrame, test: float, group: str, seed: int = 1, tries: int = 20) -> tuple[DataFrame, DataFrame]:
    """Groups stay whole.  Of ``tries`` hash orders the one whose test rows come nearest to the target is taken.

    test: a share, or a number of groups; out of range it falls back to the default share.  A group's side follows from its
    hash and value alone, so the sides are filters.
    """
    if not df.filter(F.col(group).isNull()).isEmpty():
        raise ParameterError(f"{group} has nulls")
    sizes = kept(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "sizes")
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if test > groups or test in (0, 1):
        test = DEFAULT_SHARE
    target = test if test > 1 else round(rows * test)
    take = int(test) if test > 1 else max(1, -(-groups * test // 1))
    # orders are counted by ranges of the hash: no group leaves its task but those of the ranges in which an order's last group falls
    place = lambda i: F.xxhash64(F.lit(seed), F.lit(i), F.col(group))
    tried = sizes.select(group, "n", F.posexplode(F.array(*[place(i) for i in range(tries)])).alias("attempt", "_h")).withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS))
    counts = {}
    for r in tried.groupBy("attempt", "_range").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).orderBy("attempt", "_range").collect():  # at most tries * 2 ** RANGE_BITS
        counts.setdefault(r["attempt"], []).append((r["_range"], r["c"], r["n"]))
    found = {}
    for attempt, ranges in counts.items():
        left, total = int(take), 0
        for at, c, n in ranges:
            if c >= left:
                break
            left, total = left - c, total + n
        found[attempt] = (at, left, total)  # the last range, how many groups of it, and the rows of those before
    if not found:
        return df, df.limit(0)
    edges = df.sparkSession.createDataFrame([(k, *v) for k, v in found.items()], "attempt int, _last long, _left long, _total long")
    edge = Window.partitionBy("attempt").orderBy("_h", group)
    last = tried.join(F.broadcast(edges), "attempt").filter("_range = _last").withColumn("_no", F.row_number().over(edge)).filter("_no <= _left")
    ends = last.groupBy("attempt").agg((F.first("_total") + F.sum("n")).alias("n"), F.max(F.struct("_h", group)).alias("end"))
    best = ends.orderBy(F.abs(F.col("n") - target), "attempt").first()
    attempt, end = best["attempt"], best["end"]
    inside = lambda h, g: (h < F.lit(end["_h"])) | ((h == F.lit(end["_h"])) & (g <= F.lit(end[group])))
    chosen = inside(place(attempt), F.col(group))
    return df.filter(~chosen), df.filter(chosen)


def first_by_hash(df: DataFrame, part: str, n: int, tie: str | list[str], bits: int = 12) -> DataFrame:
    """The n rows of each part with the smallest _h.

    Rows are counted by the first bits of their hash; only those of the range in which the n-th falls are ranked.
    """
    rows = df.withColumn("_range", F.shiftright("_h", 64 - bits))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part, "_range").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    # at most 2 ** bits rows for each part
    rows = rows.join(counts, [part, "_range"]).filter(F.col("_before") < n)
    edge = Window.partitionBy(part).orderBy("_h", *([tie] if isinstance(tie, str) else tie))
    last = rows.filter(F.col("_before") + F.col("_c") > n).withColumn("_no", F.row_number().over(edge)).filter(F.col("_before") + F.col("_no") <= n).drop("_no")
    return rows.filter(F.col("_before") + F.col("_c") <= n).unionByName(last).drop("_h", "_range", "_c", "_before")


def holdout_size(rows: int, holdout: float = DEFAULT_SHARE, most: int = MOST_HOLDOUT) -> int:
    """Rows to hold out: a share or a number, at most ``most``; too little data or too small a holdout is an error."""
    if holdout == 0:
        return 0
    if rows < LEAST_ROWS:
        raise ParameterError(f"a holdout needs {LEAST_ROWS} rows; there are {rows}")
    n = min(int(holdout) if holdout >= 1 else int(rows * holdout), most)
    if n < LEAST_HOLDOUT:
        raise ParameterError(f"a holdout of {n} rows is below {LEAST_HOLDOUT}")
    return n


def holdout(df: DataFrame, key: str, share: float = DEFAULT_SHARE, group: str | None = None, most: int = MOST_HOLDOUT, seed: int = 1) -> tuple[DataFrame, DataFrame | None]:
    n = holdout_size(df.count(), share, most)
    if n and group and group in df.columns:
        return split_groups(df, n, group, seed)
    return split_rows(df, n, key, seed)


def cumulative_groups(df: DataFrame, group: str, target: int, order: str | None = None) -> DataFrame:
    """group, n, rows_before: whole groups in order (of the group's value) until their rows reach the target."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *([F.min(order).alias(order)] if order and order != group else []))
    by = order or group
    return running_sum(sizes, [], F.col("n"), [by, group], sort_value(sizes, by), "rows_before").filter(F.col("rows_before") < target).select(group, "n", "rows_before")


def entity_rows(df: DataFrame, entity: str, row: str) -> DataFrame:
    """entity, rows: the ascending row ids of each entity."""
    return df.groupBy(entity).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def poisson_batches(entities: DataFrame, entity: str, rate: float, steps: int, seed: int = 0) -> DataFrame:
    """step, entity: in each step every entity is drawn with the same probability."""
    drawn = entities.select(entity, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    u = F.pmod(F.xxhash64(F.lit(seed), "step", F.col(entity)), F.lit(1 << 30)) / float(1 << 30)
    return drawn.filter(u < rate).select("step", entity)


def shuffled_batches(entities: DataFrame, entity: str, batch: int, passes: int = 1, seed: int = 0, order: Column | None = None) -> DataFrame:
    """step, entity: every pass shuffles the entities and cuts them into batches; what does not fill one is dropped.

    order is a number for (pass, entity), by default a hash; the batches are found by rank over ranges of it.
    """
    by = F.xxhash64(F.lit(seed), "pass", F.col(entity)) if order is None else order
    rows = entities.select(entity).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("_by", by)
    whole = F.floor(F.lit(entities.count()) / batch)
    placed = numbered(rows, ["pass"], ["_by", entity], F.col("_by").cast("double"), "_no").withColumn("_batch", F.floor(F.col("_no") / batch))
    return placed.filter(F.col("_batch") < whole).select((F.col("pass") * whole + F.col("_batch")).cast("long").alias("step"), entity)


def drawn_rows(draws: DataFrame, rows: DataFrame, entity: str, row: str) -> DataFrame:
    """step, entity, row: the record that each draw of an entity takes, its records in turn over the steps, from the first again after the last."""
    turn = Window.partitionBy(entity).orderBy("step")  # an entity has at most one draw a step
    placed = numbered(rows.select(entity, row), [entity], [row], sort_value(rows, row), "_at")
    sizes = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    taken = draws.withColumn("_turn", F.row_number().over(turn) - 1).join(sizes, entity).withColumn("_at", F.pmod("_turn", F.col("_n")).cast("long"))
    return taken.join(placed.withColumn("_at", F.col("_at").cast("long")), [entity, "_at"]).select("step", entity, row)


def repeated(df: DataFrame, times: float, key: str, seed: int = 0) -> DataFrame:
    """copy_no and position: whole hash-ordered copies of a table, and a part of one more for the fraction."""
    whole = int(times)
    copies = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(whole)))).withColumn("_h", F.xxhash64(F.lit(seed), "copy_no", F.col(key)))
    n = -(-(times - whole) * df.count() // 1)
    placed = numbered(copies, ["copy_no"], ["_h", key], F.shiftright("_h", 16).cast("double"), "position").drop("_h")
    return placed.filter((F.col("copy_no") < whole) | (F.col("position") < n))


def with_replacement(df: DataFrame, n: int, key: str, seed: int = 0, order: Column | None = None, number: Column | None = None) -> DataFrame:
    """draw (from 0) and the row: n rows, each drawn from the whole table.

    Rows are numbered by order, a number, by default a hash of their key; a draw's row is number (of ``draw``) modulo the table's
    size, by default a hash.
    """
    by = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order
    rows = numbered(df.withColumn("_h", by), [], ["_h", key], F.col("_h").cast("double"), "_no").drop("_h")
    size = df.count()
    if not size:
        return rows.withColumnRenamed("_no", "draw")
    drawn = F.xxhash64(F.lit(seed + 1), "draw") if number is None else number
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").select("draw", F.pmod(drawn, F.lit(size)).alias("_no"))
    return draws.join(rows, "_no").drop("_no")


def column_sets(columns: list[str], size: int, most: int, seed: int = 5) -> list[tuple[str, ...]]:
    """At most ``most`` different sets of size columns, drawn evenly from all there are; each keeps the columns' order.

    A set is found from its number among all sets, so none has to be listed: the sets that do not begin with a
    column come after those that do.
    """
    total, found = comb(len(columns), size), []
    for number in Random(seed).sample(range(total), min(most, total)) if total < 1 << 62 else Random(seed).choices(range(1 << 62), k=most):
        chosen, left, number = [], size, number % total
        for i in range(len(columns)):
            if not left:
                break
            begin = comb(len(columns) - i - 1, left - 1)
            if number < begin:
                chosen.append(columns[i])
                left -= 1
            else:
                number -= begin
        found.append(tuple(chosen))
    return list(dict.fromkeys(found))
