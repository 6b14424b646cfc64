"""Mixing sources to target weights: fixed blocks, multinomial draws per shard, index permutations.

The words of each source, in ascending doc_id order, form one stream that is cut into blocks of
``block_words``.  The output is a row of slots in shards.

1. Every slot of a shard draws its source by the target shares, independently of all others: a shard's
   counts are one draw of the multinomial.
2. Totals are reconciled to the targets.  A source drawn too often gives slots back, evenly over the shards;
   the slots given back go to the sources drawn too seldom by a pseudorandom permutation of them.
3. A source's slots are numbered through all shards; slot i takes block perm(i mod blocks), where each pass
   over the source (epoch) has a permutation of its own: a keyed Feistel network.  Blocks then meet slots by index.

Only DataFrame functions run here.  Windows run inside ranges of rows, over one number per range, or over
one row per source, so sources are taken to be some millions at most.

Nulls: a null text has no words, a null source is a source of its own (last in order), a null doc_id sorts
first.  Repeated rows count as often as they stand; those that share a doc_id go by size and text.  Very long
texts are cut into as many blocks as they have words for.  Extra columns may have any name: they are carried
inside one struct.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, ordered_rows, running_sum, written

#: Parts of the unit interval by which a slot's draw finds its source with an equi-join.
CELLS = 4096
#: Shards that are added up at a time.
GROUP = 1024
#: Modulus (a prime) and multiplier of the Feistel rounds; products stay below 2**63.
PRIME, FACTOR = 2147483647, 1103515245


def draw(*parts) -> Column:
    """A uniform integer below 2**32 that depends only on parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text, size, and the source as a key without nulls."""
    return docs.select("doc_id", "text", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64) -> DataFrame:
    """One row per source: its words, blocks, weight, target in words and wanted slots.

    Targets are in proportion to the weights and stop at most times the source's words; the excess is
    shared out again by weight.  The common level is the largest of the levels at which the k sources
    that fill up first are full, for k from 0 on.  Slots are the targets in blocks, their running total rounded.
    """
    totals = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("source_no", F.row_number().over(Window.orderBy("no_source", "source_key")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1))
    filling = Window.orderBy(most * F.col("source_size") / F.col("weight"), "source_no")
    full = F.coalesce(F.sum(most * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (share * F.sum("source_size").over(everything) - full) / open_weight)
    out = levels.withColumn("target", F.least(F.max("level").over(everything) * F.col("weight"), most * F.col("source_size")))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).drop("level")
    upto = Window.orderBy("source_no")
    exact = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("sum_slots", F.round(F.sum(exact).over(upto)).cast("long"))
    slots = F.col("sum_slots") - F.coalesce(F.lag("sum_slots").over(upto), F.lit(0))
    return out.withColumn("slots", F.least(slots, F.floor(F.lit(most) * F.col("blocks")))).drop("sum_slots")


def permuted(df: DataFrame, i: Column, n: Column, key: Column, out: str) -> DataFrame:
    """Adds out: i under a pseudorandom permutation of 0..n-1 for each key (below 2**32); n may be up to 2**60.

    0..n-1 is a grid of rows and columns with a rest of less than a row.  Four Feistel rounds add a function of the
    column to the row and of the row to the column in turn; then all is rotated by the key, so that the rest moves
    into the grid, and four more rounds follow.  Every step is a bijection.  A step is a projection of its own, which
    the optimizer must not push filters through (they would repeat all steps): write the result before joining by it.
    """
    c, row, col = F.col, "_row", "_col"
    df = df.withColumns({"_at": i.cast("long"), "_n": n.cast("long"), "_key": key.cast("long")}).withColumn("_wide", F.ceil(F.sqrt("_n")))
    df = df.withColumn("_tall", F.call_function("div", c("_n"), c("_wide")))
    for k in range(8):
        if k % 4 == 0:
            at = c("_at") if k == 0 else (c("_at") + c("_key")) % c("_n")
            df = df.withColumn("_at", at).withColumns({row: F.call_function("div", c("_at"), c("_wide")), col: c("_at") % c("_wide")})
        turn, other, modulus = (row, col, "_tall") if k % 2 == 0 else (col, row, "_wide")
        df = df.withColumn("_mixed", (c(other) * FACTOR + (c("_key") * (k + 1) * 7919) % PRIME) % PRIME)
        df = df.withColumn(turn, (c(turn) + (c("_mixed") * c("_mixed")) % PRIME) % c(modulus))
        if k % 4 == 3:
            df = df.withColumn("_at", F.when(c("_at") < c("_tall") * c("_wide"), c(row) * c("_wide") + c(col)).otherwise(c("_at")))
    return df.withColumn(out, c("_at")).drop("_at", "_n", "_key", "_wide", "_tall", row, col, "_mixed")


def shard_counts(targets: DataFrame, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """shard, source_no, slots: multinomial draws, reconciled to the slots that each source is to have."""
    spark = targets.sparkSession
    wanted = targets.filter("slots > 0").select("source_no", F.col("slots").alias("wanted"))
    n = wanted.agg(F.sum("wanted")).first()[0] or 0
    shards = max(1, -(-n // shard_slots))
    upto, everything = Window.orderBy("source_no"), Window.partitionBy()
    cells = wanted.withColumn("high", F.sum("wanted").over(upto)).withColumn("low", F.col("high") - F.col("wanted"))
    last = F.col("source_no") == F.max("source_no").over(everything)
    cells = cells.select("source_no", (F.col("low") / n).alias("low"), F.when(last, F.lit(2.0)).otherwise(F.col("high") / n).alias("high"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)))))
    slots = spark.range(n).select((F.col("id") % shards).alias("shard"), (draw(seed, F.col("id")) / F.lit(float(1 << 32))).alias("u"))
    drawn = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").filter("u >= low AND u < high")
    counts = written(drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("slots")), "mix-drawn")

    got = counts.groupBy("source_no").agg(F.sum("slots").alias("got"))
    both = wanted.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over = both.filter("got > wanted").select("source_no", "wanted", "got")
    grouped = F.floor(F.col("shard") / GROUP)
    counts = running_sum(counts.withColumn("group", grouped), ["source_no"], "group", ["shard"], "slots", "first").join(over, "source_no", "left")
    upto_x = lambda x: F.when(x >= F.col("got"), F.col("wanted")).otherwise(F.floor(x * (F.col("wanted") / F.col("got"))))
    stay = F.when(F.col("got").isNull(), F.col("slots")).otherwise(upto_x(F.col("first") + F.col("slots")) - upto_x(F.col("first")))
    counts = counts.withColumn("stay", stay)
    freed = counts.groupBy("shard").agg(F.sum(F.col("slots") - F.col("stay")).alias("freed")).filter("freed > 0")
    freed = running_sum(freed.withColumn("group", grouped), [], "group", ["shard"], "freed", "first")
    freed = freed.withColumn("r", F.explode(F.sequence("first", F.col("first") + F.col("freed") - 1))).select("shard", "r")
    under = both.filter("got < wanted").withColumn("lack", F.col("wanted") - F.col("got"))
    under = under.withColumns({"high": F.sum("lack").over(upto), "all": F.sum("lack").over(everything)})
    total = under.agg(F.max("all")).first()[0] or 1
    taker = under.select("source_no", F.explode(F.sequence(F.col("high") - F.col("lack"), F.col("high") - 1)).alias("g"))
    given = written(permuted(freed, F.col("r"), F.lit(total), draw(seed, "freed"), "g").select("shard", "g"), "mix-freed").join(taker, "g")
    found = counts.select("shard", "source_no", F.col("stay").alias("slots")).unionByName(given.select("shard", "source_no", F.lit(1).cast("long").alias("slots")))
    return found.groupBy("shard", "source_no").agg(F.sum("slots").alias("slots")).filter("slots > 0")


def draw_slots(targets: DataFrame, shard_slots: int = 1024, seed: int = 7, most: float = 2.0) -> DataFrame:
    """The slots of all shards: shard, position, source_no, block, epoch; to be written before it is joined."""
    counts = written(shard_counts(targets, shard_slots, seed), "mix-counts")
    counts = running_sum(counts.withColumn("group", F.floor(F.col("shard") / GROUP)), ["source_no"], "group", ["shard"], "slots", "first")
    in_shard = Window.partitionBy("shard")
    counts = counts.withColumns({"at": F.sum("slots").over(in_shard.orderBy("source_no")) - F.col("slots"), "in_shard": F.sum("slots").over(in_shard), "shard_key": draw(seed, "order", F.col("shard"))})
    # a key for each pass over a source
    keys = F.array(*[draw(seed, F.col("source_no"), F.lit(e)) for e in range(-int(-most // 1))])
    counts = counts.join(targets.select("source_no", "blocks", keys.alias("keys")), "source_no")
    # slots are made where their counts have been dealt evenly: a number of partitions that is stated is kept
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartition(n, "source_no", "shard")
    slots = counts.select("source_no", "shard", "blocks", "keys", "first", "at", "in_shard", "shard_key", F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)).alias("i"))
    slots = slots.withColumns({"epoch": F.expr("i div blocks"), "in_epoch": F.col("i") % F.col("blocks"), "nth": F.col("at") + F.col("i") - F.col("first")})
    slots = permuted(slots, F.col("in_epoch"), F.col("blocks"), F.element_at("keys", (F.col("epoch") + 1).cast("int")), "block")
    slots = permuted(slots, F.col("nth"), F.col("in_shard"), F.col("shard_key"), "position")
    return slots.select("shard", "position", "source_no", "block", "epoch")


def mix_documents(docs: DataFrame, block_words: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, and the segments of words taken.

    segments: array of (from, to, times), words numbered from 0 within the document, in order.
    """
    return _mixed(docs, block_words, shard_slots, seed)[0]


def _mixed(docs: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of mix_documents(), and the targets."""
    sizes = written(ordered_rows(sized(docs).withColumn("text_key", F.xxhash64("text")).drop("text", "source"), ["doc_id", "size", "text_key"]), "mix-sizes")
    targets = written(source_targets(sizes, block_words=block_words), "mix-targets")
    placed = sizes.join(targets.select("no_source", "source_key", "source_no", "source_size", "target"), ["no_source", "source_key"])
    placed = running_sum(placed, ["source_no"], "bucket", ["doc_id", "size", "text_key", "row_no"], "size", "start")
    parts = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))))
    takes = written(draw_slots(targets, shard_slots, seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times")), "mix-takes")
    parts = parts.join(takes, ["source_no", "block"], "left")
    low = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    parts = parts.withColumn("segment", F.when(F.col("times") > 0, F.struct(low.alias("from"), high.alias("to"), "times")))
    keys = ["row_no", "doc_id", "no_source", "source_key", "size", "source_size", "target", "start", "text_key"]
    out = parts.groupBy(*keys).agg(F.coalesce(F.sum((high - low) * F.col("times")), F.lit(0)).alias("taken"), F.sort_array(F.collect_list("segment")).alias("segments"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "segments", "no_source", "source_key", "start", "text_key"), targets


def with_segments(docs: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """row (a struct of docs' columns), no_source, source_key, start, segments of rows that the mix takes words of; targets.

    Rows meet their segments by what they are; of equal rows each gets those of one.
    """
    identity = ["doc_id", "no_source", "source_key", "text_key"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*identity).orderBy(order))
    mixed, targets = _mixed(docs, block_words, shard_slots, seed)
    taken = mixed.filter("taken > 0").withColumn("nth", nth("start")).select(*[F.col(c).alias(f"_{c}") for c in [*identity, "nth", "start"]], "segments")
    rows = docs.filter(F.col("text").rlike(WORD)).select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.xxhash64("text").alias("text_key"))
    rows = rows.withColumn("nth", nth(F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in [*identity[1:], "nth"]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(taken, same).select("row", "no_source", "source_key", F.col("_start").alias("start"), "segments"), targets


def _words(text: Column) -> Column:
    """Every word with what separates it from the word before."""
    return F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))


def _slice(words: Column, s: Column) -> Column:
    return F.slice(words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))


def mixed_texts(docs: DataFrame, block_words: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """docs with text and n_chars of the words the mix takes, each as often as it is taken; rows of which it takes none go.

    Rows and words stay in their documents; mixed_shards() has them in the order of the mix.
    """
    both, _ = with_segments(docs, block_words, shard_slots, seed)

    def body(words: Column) -> Column:
        # copies of a text's beginning get a line feed
        first = F.when(words[0].rlike(r"^[\x20\x09-\x0D]"), words[0]).otherwise(F.concat(F.lit("\n"), words[0]))
        apart = F.concat(F.array(first), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
        # the words are cut once a text: within let() they are a variable, not an expression
        piece = lambda w: F.transform("segments", lambda s: F.array_join(F.flatten(F.array_repeat(_slice(w, s), s["times"].cast("int"))), ""))
        return let(apart, lambda w: F.array_join(piece(w), ""))

    text = F.regexp_replace(let(_words(F.col("row.text")), body), r"^[\x20\x09-\x0D]+", "")
    both = both.withColumn("new_text", text)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return both.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mixed_shards(docs: DataFrame, block_words: int = 64, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """The mix itself: shard, position, source, block, epoch and words (array) of every slot.

    Blocks meet slots by index; a block has at most block_words words, of one document or of several.
    """
    rows, targets = with_segments(docs, block_words, shard_slots, seed)
    at = F.col("start") + F.col("s")["from"]
    bare = lambda s, w: F.transform(_slice(w, s), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+", ""))
    parts = let(_words(F.col("row.text")), lambda w: F.transform("segments", lambda s: F.struct(s["from"].alias("from"), bare(s, w).alias("words"))))
    parts = rows.select("no_source", "source_key", "start", F.explode(parts).alias("s"))
    part = F.struct(at.alias("at"), F.col("s")["words"].alias("words"))
    names = targets.select("source_no", "no_source", "source_key")
    parts = parts.join(names, ["no_source", "source_key"]).select("source_no", F.floor(at / block_words).alias("block"), part.alias("part"))
    blocks = parts.groupBy("source_no", "block").agg(F.flatten(F.sort_array(F.collect_list("part"))["words"]).alias("words"))
    slots = written(draw_slots(targets, shard_slots, seed), "mix-slots").join(names, "source_no")
    source = F.when(~F.col("no_source"), F.col("source_key")).alias("source")
    return slots.join(blocks, ["source_no", "block"]).select("shard", "position", source, "block", "epoch", "words")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def _permuted_sql(table: str, i: str, n: str, key: str, out: str) -> str:
    """SELECT *, out FROM table, with out the permuted i of 0..n-1."""
    sql = f"SELECT *, {i} AS pi, {n} AS pn, {key} AS pk, CAST(ceil(sqrt({n})) AS BIGINT) AS pb FROM {table}"
    sql = f"SELECT *, pn // pb AS pa FROM ({sql})"
    for half in (0, 1):
        sql = f"SELECT *, pi // pb AS l{half}0, pi % pb AS r{half}0 FROM ({sql})"
        for k in range(4):
            f = lambda x: f"((({x} * {FACTOR} + (pk * {4 * half + k + 1} * 7919) % {PRIME}) % {PRIME}))"
            if k % 2 == 0:
                sql = f"SELECT *, (l{half}{k} + {f(f'r{half}{k}')} * {f(f'r{half}{k}')} % {PRIME}) % greatest(pa, 1) AS l{half}{k + 1}, r{half}{k} AS r{half}{k + 1} FROM ({sql})"
            else:
                sql = f"SELECT *, l{half}{k} AS l{half}{k + 1}, (r{half}{k} + {f(f'l{half}{k}')} * {f(f'l{half}{k}')} % {PRIME}) % pb AS r{half}{k + 1} FROM ({sql})"
        moved = f"CASE WHEN pi < pa * pb THEN l{half}4 * pb + r{half}4 ELSE pi END"
        sql = f"SELECT * REPLACE (({moved} + pk) % pn AS pi) FROM ({sql})" if not half else f"SELECT *, {moved} AS {out} FROM ({sql})"
    return sql


ORACLE = rf"""
WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT ns, sk, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY ns, sk) AS no FROM d GROUP BY ns, sk),
w AS (SELECT *, CAST([5, 2, 1][CAST((no - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(2 * ss AS DOUBLE) AS cap FROM r),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, least(max(level) OVER () * w, cap) AS target, CAST(ceil(ss / 64) AS BIGINT) AS blocks FROM l),
g1 AS (SELECT *, CAST(round(sum(CASE WHEN ss > 0 THEN target * blocks / ss ELSE CAST(0 AS DOUBLE) END) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS upto FROM g),
g2 AS (SELECT *, least(upto - coalesce(lag(upto) OVER (ORDER BY no), 0), 2 * blocks) AS want FROM g1),
k AS (SELECT no, blocks, want, CAST(sum(want) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS high, CAST(sum(want) OVER () AS BIGINT) AS n, max(no) OVER () AS top FROM g2 WHERE want > 0),
c AS (SELECT no, CAST(high - want AS DOUBLE) / n AS low, CASE WHEN no = top THEN 2 ELSE CAST(high AS DOUBLE) / n END AS high FROM k),
n AS (SELECT max(n) AS n, (max(n) + 1023) // 1024 AS shards FROM k),
s AS (SELECT unnest(range(n)) AS slot, shards FROM n),
u AS (SELECT slot % shards AS shard, {_DRAW.format("'7:' || slot")} / CAST(4294967296 AS DOUBLE) AS u FROM s),
q AS (SELECT no, shard, count(*) AS m FROM u JOIN c ON u.u >= c.low AND u.u < c.high GROUP BY no, shard),
t AS (SELECT k.no, want, CAST(coalesce(sum(m), 0) AS BIGINT) AS got FROM k LEFT JOIN q USING (no) GROUP BY k.no, want),
q1 AS (SELECT q.*, want, got, CAST(coalesce(sum(m) OVER (PARTITION BY no ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM q JOIN t USING (no)),
q2 AS (SELECT *, CASE WHEN got <= want THEN m ELSE
  CASE WHEN first + m >= got THEN want ELSE CAST(floor((first + m) * (want / got)) AS BIGINT) END - CAST(floor(first * (want / got)) AS BIGINT) END AS stay FROM q1),
f AS (SELECT shard, CAST(sum(m - stay) AS BIGINT) AS freed FROM q2 GROUP BY shard HAVING sum(m - stay) > 0),
f1 AS (SELECT shard, freed, CAST(coalesce(sum(freed) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, CAST(sum(freed) OVER () AS BIGINT) AS total FROM f),
f2 AS (SELECT shard, total, unnest(range(first, first + freed)) AS r FROM f1),
f3 AS ({_permuted_sql("f2", "r", "total", _DRAW.format("'7:freed'"), "g")}),
h AS (SELECT no, CAST(sum(want - got) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS high, want - got AS lack FROM t WHERE got < want),
m AS (SELECT no, shard, CAST(sum(stay) AS BIGINT) AS m FROM (SELECT no, shard, stay FROM q2 UNION ALL SELECT no, shard, 1 FROM f3 JOIN h ON g >= high - lack AND g < high) GROUP BY no, shard),
m1 AS (SELECT *, CAST(coalesce(sum(m) OVER (PARTITION BY no ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM m),
i AS (SELECT no, blocks, unnest(range(first, first + m)) AS i FROM m1 JOIN k USING (no)),
b AS ({_permuted_sql("i", "i % blocks", "blocks", _DRAW.format("'7:' || no || ':' || i // blocks"), "b")}),
e AS (SELECT no, b, count(*) AS times FROM b GROUP BY no, b),
p AS (SELECT doc_id, size, no, ss, target, coalesce(sum(size) OVER (PARTITION BY no ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN g USING (ns, sk))
SELECT doc_id, any_value(size) AS size, CAST(any_value(ss) AS BIGINT) AS source_size, any_value(target) AS target,
  CAST(coalesce(sum((least((b + 1) * 64, start + size) - greatest(b * 64, start)) * times), 0) AS BIGINT) AS taken
FROM p LEFT JOIN e ON e.no = p.no AND b * 64 < start + size AND (b + 1) * 64 > start AND size > 0 GROUP BY doc_id
"""
