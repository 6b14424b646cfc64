"""N-gram Jaccard join: near-duplicate classes by adaptive multi-match prefixes.

Texts with the same set of shingles are one class; the join is between classes.

1. One pass over the texts keeps, per row, the size and digest of its set and a parity bitmap, and
   counts shingles in a sketch of fixed size.  The sketch only orders shingles, rarest first.
2. A second pass emits each class's prefix.  With l matches asked for, a prefix is l - 1 shingles longer
   than for one; two similar sets share at least l shingles of such prefixes.  Each document takes the l
   that makes its estimated cost (rows met, and candidates met l times that have to be compared) least.
3. Prefix shingles that two classes of similar size have form lists.  Within a list, pairs whose sizes or bitmaps rule
   out the threshold are left out; both bounds are exact.  Every class of a list is paired with the
   most alike one before it, so a large group of near copies needs as many pairs as it has members.  Pairs
   that occur in as many lists as the lesser of their two l are compared by their whole sets.
4. Lists that have other such pairs, between classes of different components, are gone through once more: each
   returns a spanning forest of these pairs, so fewer rows than it has members.  What the forests of all lists
   connect is one cluster, and every class is sent to its cluster once, with its prefix and whole set.
   There, a pair of two components that wider bitmaps allow and that shares enough prefix shingles is
   compared on the spot, and its components are one from then on, so a cluster returns fewer links than it has
   components, however many of its pairs are alike.

There are these two rounds, whatever the data; no pair that could link two components is left out of both.
In the second round, lists and clusters of more than PART_ROWS classes or PART_SHINGLES shingles are dealt over
pairs of salts; the first one deals a list that the sketch calls very frequent over salts.

Nulls: a null text is empty; empty sets link with nothing and are components of their own (a null doc_id of
one has a null component).  Null ids take part in links; a component whose ids are all null has a null
component_id.  Repeated rows, and rows that share a doc_id, are rows of their own and come back as often as
they stand.  Ties in likeness or frequency go by hash and do not change components.  Very long texts are cut
into shingles whole; only lists that hold them are dealt into smaller parts.  Only doc_id and text of docs
are read, so extra columns cannot clash.  An empty table gives an empty result.  Shingles are 64-bit hashes:
two different ones of a pair of sets agree with a chance of |A| |B| / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_texts, read_table, written
from .components import components
from .shingles import batch_texts, parity_bits, shingle_sets

#: Similarity from which texts link, in per cent.
PERCENT = 80
#: Most matches that a document asks for.
MOST_MATCHES = 4
#: Cells of the sketch, and of each of the blocks that it is summed in.
CELLS, BLOCK = 1 << 20, 1 << 14
#: Estimated classes in a list before the first round deals it over salts.
LIST_ROWS = 20_000
#: Classes and shingles of a list or cluster before the second round deals it over pairs of salts.
PART_ROWS, PART_SHINGLES = 1_000, 2_000_000
#: Least and most bits of the filter that decides which rows' sets a comparison reads (false hits cost time only).
FILTER_BITS = (1 << 20, 1 << 27)


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """A set's two keys."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def row_key(docs: DataFrame) -> Column:
    """By which a row is found again; rows that share it are read in vain."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("key"))


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, key, n, k1, k2, bits) and rows of sketch blocks (block, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["doc_id", "key", "n", "k1", "k2", "bits", "block", "part", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        counts, seen = np.zeros(CELLS, np.uint32), False
        for batch in batches:
            for part, texts in batch_texts(batch):
                sets = list(shingle_sets(texts, words))
                cells = np.concatenate(sets or [np.zeros(0, np.uint64)]) & np.uint64(CELLS - 1)
                counts += np.bincount(cells.astype(np.int64), minlength=CELLS).astype(np.uint32)
                seen = True
                keys = zip(*[digests(s) for s in sets])
                columns = [part.column("doc_id"), part.column("key"), [len(s) for s in sets], *keys, [parity_bits(s) for s in sets], *[[None] * len(sets)] * 3]
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)
        if seen:
            blocks = range(CELLS // BLOCK)
            columns = [*[[None] * len(blocks)] * 6, list(blocks), [TaskContext.get().partitionId()] * len(blocks), [counts[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return slim(long_texts(docs)).mapInArrow(run, "doc_id long, key long, n int, k1 long, k2 long, bits binary, block int, part int, counts binary")


def frequencies(profile: DataFrame) -> np.ndarray:
    """The sketch less what chance puts into a cell: CELLS 32-bit counts, whatever the input's size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [0], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    blocks = profile.filter("block IS NOT NULL").select("block", (F.col("part") % 64).alias("part"), "counts")
    for keys in (["block", "part"], ["block"]):
        blocks = blocks.groupBy(*keys).applyInPandas(add, "block int, part int, counts binary")
    counts = np.zeros(CELLS, np.float64)
    for r in blocks.collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint32)
    load = counts.mean()
    return np.maximum(0, counts - load - 4 * np.sqrt(load)).astype(np.uint32)


def prefix(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, np.ndarray]:
    """The shingles of a set's adaptive prefix, the matches it asks for, and their estimated frequencies."""
    n = len(s)
    need = -(-percent * n // 100)
    most = min(MOST_MATCHES, need)
    longest = n - need + most
    others = counts[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    rank = (np.minimum(others, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
    order = np.argsort(rank, kind="stable")[:longest]
    met = np.cumsum(others[order].astype(np.float64))
    matches = np.arange(1, most + 1)
    rows = n - need + matches
    cost = rows + met[rows - 1] + n / 8 * met[rows - 1] / matches
    best = int(np.argmin(cost))
    order = order[: rows[best]]
    return s[order], best + 1, others[order]


def prefix_entries(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """shingle, salt, salts, k1, n, matches: the prefixes of all classes."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "salt", "salts", "k1", "n", "matches"]
        table, done = shared.value, set()
        for batch in batches:
            for _, texts in batch_texts(batch):
                out = []
                for s in shingle_sets(texts, words):
                    key = digests(s)[0]
                    if not len(s) or key in done:  # what this task has emitted need not come again
                        continue
                    if len(done) >= 500_000:
                        done.clear()
                    done.add(key)
                    head, matches, others = prefix(s, table, percent)
                    salts = (others // LIST_ROWS + 1).astype(np.int32)
                    m = len(head)
                    out.append((_signed(head), (key & 0x7FFFFFFF) % salts, salts, np.full(m, key), np.full(m, len(s), np.int32), np.full(m, matches, np.int32)))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shingle long, salt int, salts int, k1 long, n int, matches int")


def shared_entries(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the entries, without repeats, those with a class of similar size in their list, or dealt over salts.

    Lists come by ascending size, so the nearest sizes are neighbours, and one row is all that is held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, near = None, False  # the last row, and whether the one before it is of similar size
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            list_no, salt, key, n = (table.column(c).to_numpy() for c in ("shingle", "salt", "k1", "n"))
            in_list = (list_no[1:] == list_no[:-1]) & (salt[1:] == salt[:-1])
            fresh = np.concatenate(([True], ~(in_list & (key[1:] == key[:-1]) & (n[1:] == n[:-1]))))
            table = table.filter(pa.array(fresh))
            list_no, salt, n, salts = (table.column(c).to_numpy() for c in ("shingle", "salt", "n", "salts"))
            m = table.num_rows
            close = np.zeros(m + 1, bool)
            close[1:m] = (list_no[1:] == list_no[:-1]) & (salt[1:] == salt[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            close[0] = near
            keep = close[:-1] | close[1:] | (salts > 1)
            yield from table.slice(0, m - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
            held, near = table.slice(m - 1).combine_chunks().to_batches()[0], bool(close[m - 1])
        if held is not None and (near or held.column("salts")[0].as_py() > 1):
            yield held

    ordered = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "k1")
    return ordered.mapInArrow(run, "shingle long, salt int, salts int, k1 long, n int, matches int")


class _Bitmaps:
    """Members of one list by ascending size, for the exact bound on what two sets can share."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.bits, self.percent = n, bits, percent
        self.width = np.array([len(b) for b in bits])
        self.whole = {w: np.frombuffer(b"".join(b for b in bits if len(b) == w), np.uint64).reshape(-1, w // 8) for w in np.unique(self.width)}
        self.first = {w: int(np.searchsorted(self.width, w)) for w in self.whole}

    def apart(self, i: int) -> tuple[int, np.ndarray]:
        """The first member before i that size allows, and the least difference of each from there to i - 1."""
        low = int(np.searchsorted(self.n, -(-self.percent * int(self.n[i]) // 100)))
        w = int(self.width[i])
        mine = self.whole[w][i - self.first[w]]
        parts = []
        while low < i:
            v = int(self.width[low]) if not parts else w
            stop = i if v == w else min(i, self.first[w])
            other = mine
            for _ in range((w // v).bit_length() - 1):
                other = other[: len(other) // 2] ^ other[len(other) // 2 :]
            rows = self.whole[v][low - self.first[v] : stop - self.first[v]] if not parts else self.whole[w][: i - self.first[w]]
            parts.append(np.bitwise_count(rows ^ other).sum(axis=1, dtype=np.int64))
            if stop == i:
                break
        return low, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _nearest_pairs(n, bits, percent):
    """Of each member of a list, in ascending order of n, the most alike one before it that size and bitmap allow.

    Returns the pairs of places and whether there are others that were left for later.
    """
    maps, pairs, more = _Bitmaps(n, bits, percent), [], False
    for i in range(1, len(n)):
        low, apart = maps.apart(i)
        both = n[low:i].astype(np.int64) + int(n[i])
        js = np.flatnonzero(_allowed(both, apart, percent))
        if len(js):
            more |= len(js) > 1
            pairs.append((low + int(js[np.argmin(apart[js] / both[js])]), i))
    return pairs, more


def _allowed(both, apart, percent):
    # (both - apart) / 2 shared at most; similar from percent / (100 + percent) of both
    return (100 + percent) * (both - apart) >= 2 * percent * both


def _between(label, side, low: int, i: int):
    """Which members from low to i - 1 are of another component and, in a part of two salts, of the other salt."""
    return (label[low:i] != label[i]) & ((side[low:i] != side[i]) | (side[i] < 0))


def _open_edges(n, bits, label, side, percent):
    """A spanning forest of a list's pairs with another component that size and bitmap allow, as pairs of places."""
    maps, tree, edges = _Bitmaps(n, bits, percent), np.arange(len(n)), []
    for i in range(1, len(n)):
        low, apart = maps.apart(i)
        both = n[low:i].astype(np.int64) + int(n[i])
        js = low + np.flatnonzero(_allowed(both, apart, percent) & _between(label, side, low, i))
        for t, j in zip(*np.unique(tree[js], return_index=True)):
            if t != tree[i]:
                edges.append((js[j], i))
                tree[tree == t] = tree[i]
    return edges


def _cluster_links(n, label, side, matches, heads, sets, percent):
    """Pairs of labels that links of a cluster connect; two labels that a link has connected count as one."""
    maps, given, label, links = _Bitmaps(n, [parity_bits(s, 8) for s in sets], percent), label, label.copy(), []
    for i in range(1, len(n)):
        low, apart = maps.apart(i)
        both = n[low:i].astype(np.int64) + int(n[i])
        js = np.flatnonzero(_allowed(both, apart, percent) & _between(label, side, low, i))
        js = js[np.argsort(apart[js] / both[js], kind="stable")]
        for j in (low + js).tolist():
            if label[j] == label[i] or len(np.intersect1d(heads[j], heads[i], assume_unique=True)) < min(matches[j], matches[i]):
                continue
            shared = len(np.intersect1d(sets[j], sets[i], assume_unique=True))
            if 100 * shared >= percent * (len(sets[j]) + len(sets[i]) - shared):
                links.append((given[j], given[i]))
                label[label == label[j]] = label[i]
    return links


def _by_list(rows: DataFrame, keys: list[str], of_list, schema: str) -> DataFrame:
    """of_list(table), a RecordBatch or None, of every list: the rows that agree in keys, by ascending n and rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []

        def lists(part: pa.Table):
            change = np.zeros(part.num_rows, bool)
            change[0] = True
            for k in keys:
                column = part.column(k).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            starts = np.append(np.flatnonzero(change), part.num_rows).tolist()
            out = [of_list(part.slice(s, e - s)) for s, e in zip(starts, starts[1:]) if e - s > 1]
            if out := [x for x in out if x is not None]:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k).to_numpy()
                same &= column == column[-1]
            # the last list may go on in the next batch
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            whole = cut > 0 or (rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys))
            if whole:
                yield from lists(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from lists(pa.Table.from_batches(rest).combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "rep").mapInArrow(run, schema)


def nearest_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b, matches, shingle of each list's pairs; shingle is set where the list has others left for later."""

    def of_list(part: pa.Table) -> pa.RecordBatch | None:
        n, rep, matches = (part.column(c).to_numpy() for c in ("n", "rep", "matches"))
        pairs, more = _nearest_pairs(n, part.column("bits").to_pylist(), percent)
        if not pairs:
            return None
        i, j = np.array(pairs).T
        shingle = pa.array([part.column("shingle")[0].as_py() if more else None] * len(i), pa.int64())
        columns = [pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(np.minimum(matches[i], matches[j])), shingle]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "matches", "shingle"])

    return _by_list(lists.select("shingle", "salt", "rep", "n", "matches", "bits"), ["shingle", "salt"], of_list, "a long, b long, matches int, shingle long")


def open_edges(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that connect all classes of a list with a pair to another component that is not ruled out."""

    def of_list(part: pa.Table) -> pa.RecordBatch | None:
        n, rep, label, side = (part.column(c).to_numpy() for c in ("n", "rep", "label", "side"))
        edges = _open_edges(n, part.column("bits").to_pylist(), label, side, percent)
        if not edges:
            return None
        i, j = np.array(edges).T
        return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

    return _by_list(lists.select("shingle", "low", "high", "rep", "n", "label", "side", "bits"), ["shingle", "low", "high"], of_list, "a long, b long")


def in_parts(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, rep, n, label) of keys with several labels, dealt over pairs of salts: low, high and side (-1, or the row's salt) added."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    mixed = rows.groupBy(key).agg(F.min("label").alias("least"), F.max("label").alias("most"), parts.alias("parts")).filter("least <> most").select(key, "parts")
    dealt = rows.join(mixed, key).withColumn("salt", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("salt", "other"), "high": F.greatest("salt", "other")})
    return dealt.withColumn("side", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("salt"))).drop("parts", "salt", "other")


def cluster_links(clusters: DataFrame, percent: int) -> DataFrame:
    """a, b: labels that links connect, found cluster by cluster with whole sets."""

    def of_list(part: pa.Table) -> pa.RecordBatch | None:
        n, label, side, matches = (part.column(c).to_numpy() for c in ("n", "label", "side", "matches"))
        heads, sets = ([x.values.to_numpy() for x in part.column(c)] for c in ("head", "s"))
        links = _cluster_links(n, label, side, matches, heads, sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"]) if links else None

    return _by_list(clusters, ["cluster", "low", "high"], of_list, "a long, b long")


def often_enough(pairs: DataFrame) -> DataFrame:
    """a, b: pairs that occur in as many lists as the lesser of their two numbers of matches."""
    return pairs.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.min("matches").alias("matches")).filter("lists >= matches").select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """rep, s, head, matches of the wanted classes (rep, key, k1, k2), each once: set and prefix, both ascending."""
    spark = docs.sparkSession
    bits = min(max(FILTER_BITS[0], 1 << (16 * wanted.count()).bit_length()), FILTER_BITS[1])
    # at most FILTER_BITS[1] / 64 rows
    filled = wanted.select(F.pmod("key", F.lit(bits)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast((table, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (flags, others), done = shared.value, set()
        for batch in batches:
            at = batch.column("at").to_numpy()
            some = batch.filter(pa.array(((flags[at >> 6] >> (at & 63)) & 1).astype(bool)))
            for _, texts in batch_texts(some):
                out = []
                for s in shingle_sets(texts, words):
                    k1, k2 = digests(s)
                    if not len(s) or (k1, k2) in done:  # what this task has emitted need not come again
                        continue
                    if len(done) >= 500_000:
                        done.clear()
                    done.add((k1, k2))
                    first, matches, _ = prefix(s, others, percent)
                    out.append((k1, k2, _signed(s), _signed(np.sort(first)), matches))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()))], ["k1", "k2", "s", "head", "matches"])

    read = slim(docs).select("text", F.pmod("key", F.lit(bits)).alias("at"))
    sets = read.mapInArrow(run, "k1 long, k2 long, s array<long>, head array<long>, matches int").dropDuplicates(["k1", "k2"])
    return sets.join(wanted.select("k1", "k2", "rep"), ["k1", "k2"]).drop("k1", "k2")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: those of the pairs that link, compared by their whole sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def grouped(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, component (a number for each, null for empty sets), component_id of every row."""
    profile = written(profiles(docs, words), "profiles")
    rows = profile.filter("block IS NULL").select("doc_id", "key", "n", "k1", "k2", "bits")
    counts = frequencies(profile)
    # classes get numbers as they are written; they are read from there ever after
    classes = rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    entries = shared_entries(prefix_entries(docs, counts, words, percent), percent).join(classes.select("k1", "n", "rep"), ["k1", "n"]).select("shingle", "salt", "salts", "rep", "n", "matches")
    entries = written(entries, "entries")
    maps = classes.select("rep", "n", "bits")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = written(classes.select("rep", "key", "k1", "k2").join(ids.select("rep").distinct(), "rep", "left_semi"), "wanted")
        return written(whole_sets(docs, wanted, counts, words, percent), "sets")

    # by pair, in how many lists it was met: for those with other pairs left by shingle, for the others together
    found = nearest_pairs(entries.join(maps, ["rep", "n"]), percent)
    met = written(found.groupBy("a", "b", "shingle").agg(F.count(F.lit(1)).alias("lists"), F.min("matches").alias("matches")), "met")
    pairs = written(often_enough(met), "pairs")
    early = written(verified(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), pairs, percent), "linked")
    labels = written(components(early), "labels")

    labelled = lambda rows: rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    unread = met.filter("shingle IS NOT NULL").select("shingle").unionByName(entries.filter("salts > 1").select("shingle")).distinct()
    left = labelled(entries.select("shingle", "rep", "n")).join(unread, "shingle", "left_semi")
    edges = open_edges(in_parts(left, "shingle").join(maps, ["rep", "n"]), percent)
    clusters = components(edges).withColumnsRenamed({"node": "rep", "component": "cluster"})
    members = written(in_parts(labelled(clusters.join(classes.select("rep", "n"), "rep")), "cluster"), "clusters")
    # components of the labels that late links connect; most inputs have none
    merged = components(cluster_links(members.join(sets_of(members), "rep"), percent)).select(F.col("node").alias("label"), F.col("component").alias("merged"))

    named = labelled(classes.select("k1", "k2", "n", "rep", "least")).join(merged, "label", "left").withColumn("component", F.coalesce("merged", "label"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("k1", "k2", "n", "component", "component_id")
    out = rows.select("doc_id", "key", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "component", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    return grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(c) FROM r WHERE r.doc_id = s.doc_id), doc_id)) AS component_id FROM s
"""
