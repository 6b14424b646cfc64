"""Katz backoff: scores of texts under discounted n-gram counts of the corpus.

A document's tokens are its words, A-Z as a-z, and one end; a begin mark stands before them and is never predicted.
P(w | h) is d n(h w) / n(h) where h w was seen, with Good-Turing's d for counts up to 5, and a(h) P(w | h') otherwise,
h' being h without its first token; the recursion ends at single tokens, and what their discounts leave is the
probability of an unknown token.  a(h) is (1 - sum d n(h w) / n(h)) / (1 - sum P(w | h')) over the w seen after h, so
every history's probabilities add up to 1.  A history after which every token was seen more than 5 times keeps
nothing back; its counts are divided by n(h) + 1, and that one count is left for other tokens.  Where counts of
counts give no discount between 0 and 1 (small corpora), a level takes a part of a count off: n1 / (n1 + 2 n2), or 1/2.

Documents are cut into blocks of whole texts, and a block keeps its tokens as numbers of its own words.  Level by
level a block asks for its distinct n-grams only; asks are dealt over buckets by hash of the history, and a bucket
counts its n-grams, answers each block in the order that it asked in, and keeps them as a part of that order's
table.  n-grams consist of numbers that the level before gave to history and word, so rows hold small integers.
A history with many occurrences is dealt over salts of its next words, as many as its count asks for, and what
its backoff weight needs is added up over the salts in a second exchange.  All tables are written to the shared folder.

Words are told apart by a 64-bit hash.  A null text is empty: its one token is the end.  A null doc_id is never held
out.  Rows that share an id, and repeated rows, are documents of their own.  A text of any length is one
document of one block.  Without training documents every token is unknown and has probability 1.  Extra
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts, read_table, shared_dir, written
from .labelled import held_out
from .shingles import _chunks as hashed_runs
from .shingles import batch_texts, mixed

ORDER = 2
#: Good-Turing discounts counts up to this.
RARE = 5
#: Tokens of a block; n-grams that a bucket is asked for, about.
BLOCK_TOKENS, BUCKET_ENTRIES = 1_500_000, 2_000_000
#: A history is dealt over one salt more for so many of its occurrences, in powers of two.
HOT = 1 << 20

BEGIN, END = 0, 1
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: integers by their differences where they ascend, in as many bytes as they need, compressed."""
    parts = [struct.pack("<I", len(arrays))]
    for x in arrays:
        x = np.asarray(x)
        if x.dtype.kind == "f":
            kind, low, u = 2, 0, x.astype("<f8").view(_U)
        else:
            unsigned = x.dtype == _U
            low = 0 if unsigned or not len(x) else int(x.min())
            u = x if unsigned else (x.astype(np.int64) - low).view(_U)
            kind = 4 * unsigned + int(len(u) > 1 and bool((u[1:] >= u[:-1]).all()))
            if kind & 1:
                u = np.concatenate([u[:1], u[1:] - u[:-1]])
        width = max(1, (int(u.max()).bit_length() + 7) // 8) if len(u) else 1
        body = np.ascontiguousarray(u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        body = zstandard.compress(body, 3)
        parts += [struct.pack("<BBqQI", kind, width, low, len(u), len(body)), body]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, width, low, length, size = struct.unpack_from("<BBqQI", data, at)
        at += struct.calcsize("<BBqQI")
        raw = np.zeros((length, 8), dtype=np.uint8)
        raw[:, :width] = np.frombuffer(zstandard.decompress(data[at : at + size], length * width or 1), np.uint8).reshape(width, length).T
        at += size
        u = raw.view("<u8").ravel()
        if kind == 2:
            out.append(u.view("<f8"))
            continue
        if kind & 1:
            u = np.cumsum(u, dtype=_U)
        out.append(u if kind & 4 else u.view(np.int64) + low)
    return out


@dataclass
class Level:
    """What one order's counts of counts give: discounts, and for single tokens their number and distinct ones."""

    discount: np.ndarray
    total: int = 0
    distinct: int = 0
    #: what single tokens' counts are divided by, and the probability of an unknown one
    divisor: int = 1
    left: float = 1.0

    @classmethod
    def of(cls, tally: list[int], total: int, distinct: int) -> Level:
        """tally: how many n-grams were seen 1, 2, ... RARE + 1 times."""
        n = np.array(tally, dtype=np.float64)
        d = np.ones(RARE + 1)
        d[0] = 0.0
        r = np.arange(1, RARE + 1)
        fine = False
        if (n > 0).all():
            share = (RARE + 1) * n[RARE] / n[0]
            found = ((r + 1) * n[1:] / n[:-1] / r - share) / (1 - share) if share != 1 else np.zeros(RARE)
            fine = bool(((found > 0) & (found < 1)).all())
        if not fine:
            part = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            found = (r - part) / r
        d[1:] = found
        # where no token is rare, one more occurrence than there are is what unknown ones get
        kept_back = float((n[:RARE] * (1 - d[1:]) * r).sum())
        return cls(d, total, distinct, total if kept_back else total + 1, kept_back / total if kept_back else 1 / (total + 1))

    def seen(self, n: np.ndarray) -> np.ndarray:
        """The discounted count."""
        return np.where(n > RARE, 1.0, self.discount[np.minimum(n, RARE)]) * n

    def single(self, n: np.ndarray) -> np.ndarray:
        """Probability of tokens seen n times; of an unknown one where n is 0."""
        return np.where(n > 0, self.seen(n) / self.divisor, self.left)


@dataclass(frozen=True)
class Deal:
    """How n-grams are dealt over buckets."""

    buckets: int
    hot: int = HOT

    def salts(self, total: np.ndarray) -> np.ndarray:
        """Over how many salts a history of so many occurrences is dealt: a power of two."""
        return np.where(total >= self.hot, 1 << np.ceil(np.log2(np.maximum(total // self.hot, 1) + 1)).astype(np.int64), 1)

    def bucket(self, h: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mixed(h.astype(np.int64).view(_U) * _ODD + salt.astype(np.int64).view(_U)) % _U(self.buckets)).astype(np.int64)

    def home(self, h: np.ndarray) -> np.ndarray:
        """Where what the salts of a history have is added up."""
        return self.bucket(h, np.full(len(h), -1))


class Ask:
    """A block's distinct n-grams of one order, as they are asked for: sorted by bucket, history and word."""

    def __init__(self, block: Block, k: int, deal: Deal):
        tokens, v = block.tokens, block.vocabulary
        before, gid, count = block.where[k - 1], block.gid[k - 1], block.count[k - 1]
        at = np.flatnonzero(block.place >= k - 1)
        key, first, where = np.unique(before[at - 1] * v + tokens[at], return_index=True, return_inverse=True)
        self.where = np.full(len(tokens), -1)
        self.where[at] = where
        #: of each distinct n-gram: its history and its lower n-gram, as numbers of order k - 1, and its word
        self.history, self.word, self.lower = key // v, key % v, before[at[first]]
        h, w = gid[self.history], block.gid[1][self.word]
        met = (h >= 0) & (w >= 0)
        n_salts = deal.salts(count[self.history])
        b = deal.bucket(h, np.where(n_salts > 1, (mixed(w.view(_U)) & (n_salts - 1).view(_U)).astype(np.int64), 0))
        entry = np.flatnonzero(met)
        self.entry = entry[np.lexsort((w[entry], h[entry], b[entry]))]
        # histories that are asked about though none of their words is known
        lone = np.unique(self.history[(h >= 0) & (w < 0)])
        self.without = np.zeros(len(gid), dtype=bool)
        self.without[lone] = True
        eb, eh = b[self.entry], self.history[self.entry]
        extra = lone[deal.salts(count[lone]) == 1]
        pairs_b = np.concatenate([eb, deal.bucket(gid[extra], np.zeros(len(extra)))])
        pairs_h = np.concatenate([eh, extra])
        order = np.lexsort((gid[pairs_h], pairs_b))
        pb, ph = pairs_b[order], pairs_h[order]
        new = np.ones(len(pb), dtype=bool)
        new[1:] = (pb[1:] != pb[:-1]) | (ph[1:] != ph[:-1])
        #: contexts: bucket and history, with their number of entries
        self.context_bucket, self.context = pb[new], ph[new]
        self.size = np.add.reduceat((order < len(eb)).astype(np.int64), np.flatnonzero(new)) if len(pb) else np.zeros(0, np.int64)
        self.entry_bucket = eb
        hot = np.unique(self.history[(h >= 0) & (n_salts > 1)])
        self.hot = hot[np.lexsort((gid[hot], deal.home(gid[hot])))]
        self.hot_bucket = deal.home(gid[self.hot])


def _placed(answers: dict[int, list[np.ndarray]], buckets: np.ndarray) -> Iterator[tuple[list[np.ndarray], int]]:
    """Each bucket's answer with the first place of that bucket among the sorted ones of what was asked."""
    keys = list(answers)
    return zip(answers.values(), np.searchsorted(buckets, np.array(keys, dtype=np.int64)).tolist())


class Block:
    """The tokens of a block and what has been answered about them."""

    def __init__(self, row: dict, answers: list[dict], levels: list[Level], deal: Deal, rounds: int):
        self.tokens, self.lengths = unpacked(row["data"])
        self.held = np.array(row["held"], dtype=bool)
        self.doc_ids = row["doc_ids"]
        self.vocabulary = int(self.tokens.max()) + 1
        starts = np.cumsum(self.lengths) - self.lengths
        #: each token's place in its document; the begin mark has place 0
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        self.train = np.repeat(~self.held, self.lengths)
        by = {}
        for a in answers:
            by.setdefault((a["level"], a["kind"]), {})[a["bucket"]] = unpacked(a["data"])
        self.levels, self.deal, self.ask = levels, deal, {}
        n = self.vocabulary
        gid, count = np.full(n, -1), np.zeros(n, dtype=np.int64)
        word_bucket = unpacked(row["word_buckets"])[0]
        by_bucket = np.argsort(word_bucket, kind="stable")
        for (g, c), at in _placed(by.get((1, "answer"), {}), word_bucket[by_bucket]):
            mine = by_bucket[at : at + len(g)]
            gid[mine], count[mine] = g, c
        self.where, self.gid, self.count = {1: self.tokens}, {1: gid}, {1: count}
        self.bump, self.alpha = {}, {}
        for k in range(2, rounds + 1):
            ask = self.ask[k] = Ask(self, k, deal)
            self._answered(k, ask, by)

    def _answered(self, k: int, ask: Ask, by: dict) -> None:
        m, histories = len(ask.history), len(self.gid[k - 1])
        gid, count = np.full(m, -1), np.zeros(m, dtype=np.int64)
        bump, left, low = np.zeros(histories, dtype=bool), np.zeros(histories), np.zeros(histories)
        total = self.count[k - 1]

        def told(at: np.ndarray, none_rare: np.ndarray, rare: list[np.ndarray], lower: np.ndarray) -> None:
            bump[at] = none_rare > 0
            mass = sum((1 - self.levels[k].discount[r]) * r * rare[r - 1] for r in range(1, RARE + 1))
            left[at] = np.where(none_rare > 0, 1 / (total[at] + 1), mass / np.maximum(total[at], 1))
            low[at] = lower

        answers = by.get((k, "answer"), {})
        for ((g, c, none_rare, *rare, lower), e), (_, x) in zip(_placed(answers, ask.entry_bucket), _placed(answers, ask.context_bucket)):
            entries, contexts = ask.entry[e : e + len(c)], ask.context[x : x + len(none_rare)]
            gid[entries], count[entries] = g, c
            one = self.deal.salts(total[contexts]) == 1
            told(contexts[one], none_rare[one], [r[one] for r in rare], lower[one])
        for (none_rare, *rare, lower), x in _placed(by.get((k, "hot"), {}), ask.hot_bucket):
            told(ask.hot[x : x + len(none_rare)], none_rare, rare, lower)
        self.where[k], self.gid[k], self.count[k] = ask.where, gid, count
        self.bump[k], self.alpha[k] = bump, left / (1 - low)

    def base(self, k: int, histories: np.ndarray) -> np.ndarray:
        """What the count of an n-gram of order k with this history is divided by."""
        if k == 1:
            return np.full(len(histories), self.levels[1].divisor)
        return self.count[k - 1][histories] + self.bump[k][histories]

    def probabilities(self, order: int) -> np.ndarray:
        """Of each token, the begin marks too, whose own mean nothing."""
        p = self.levels[1].single(self.count[1][self.tokens])
        for k in range(2, order + 1):
            at = np.flatnonzero(self.place >= k - 1)
            i = self.where[k][at]
            h, n = self.ask[k].history[i], self.count[k][i]
            seen = self.levels[k].seen(n) / np.maximum(self.base(k, h), 1)
            p[at] = np.where(self.gid[k - 1][h] < 0, p[at], np.where(n > 0, seen, self.alpha[k][h] * p[at]))
        return p


def tokenised(docs: DataFrame, buckets: int, block_tokens: int) -> DataFrame:
    """kind 'block' with a block's tokens, and 'ask' with its distinct words and their training counts for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, held, runs, lengths, size = [], [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            n = np.array(lengths, dtype=np.int64) + 2
            last = np.cumsum(n) - 1
            hashes = np.full(int(n.sum()), END, dtype=_U)
            inside = np.ones(len(hashes), dtype=bool)
            inside[last] = inside[last - n + 1] = False
            hashes[last - n + 1] = BEGIN
            hashes[inside] = np.maximum(np.concatenate([*runs, np.zeros(0, _U)]), _U(2))
            words, tokens = np.unique(hashes, return_inverse=True)
            train = np.repeat(~np.array(held, dtype=bool), n)
            count = np.bincount(tokens[train], minlength=len(words))
            b = (mixed(words) % _U(buckets)).astype(np.int64)
            rows = [("block", -1, packed(tokens, n), packed(b), ids, held)]
            order = np.argsort(b, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                rows.append(("ask", int(b[part[0]]), packed(words[part], count[part]), None, None, None))
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows)), *columns], ["block", "kind", "bucket", "data", "word_buckets", "doc_ids", "held"])

        for batch in batches:
            for part, texts in batch_texts(batch):
                ids_of, held_of, i = part.column("doc_id").to_pylist(), part.column("held").to_pylist(), 0
                for hashes, counts in hashed_runs(texts):
                    runs.append(hashes)
                    lengths += counts
                    ids += ids_of[i : i + len(counts)]
                    held += held_of[i : i + len(counts)]
                    size, i = size + len(hashes) + len(counts), i + len(counts)
                    if size >= block_tokens:
                        yield from block()
                        number += 1
                        ids, held, runs, lengths, size = [], [], [], [], 0
        if ids:
            yield from block()

    return docs.mapInArrow(run, "block long, kind string, bucket long, data binary, word_buckets binary, doc_ids array<long>, held array<boolean>")


_ROWS = "kind string, level int, bucket long, block long, data binary, tally array<long>"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = {"kind": pa.string(), "level": pa.int32(), "bucket": pa.int64(), "block": pa.int64(), "data": pa.binary(), "tally": pa.list_(pa.int64())}
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def _tally(n: np.ndarray, counted: np.ndarray) -> list[int]:
    return [*np.bincount(np.minimum(n[counted], RARE + 1), minlength=RARE + 2)[1 : RARE + 1].tolist(), int((n[counted] == RARE + 1).sum()), int(n[counted].sum()), int(counted.sum())]


def counted_words(asks: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind 'model' (hash, number, count of each word of a bucket) and 'answer' (number and count of each word that a block has)."""

    def count(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        parts = [unpacked(x) for x in table.column("data").to_pylist()]
        words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
        seen = np.argsort(-n, kind="stable")[: int((n > 0).sum())]
        gid = np.full(len(n), -1)
        gid[seen] = np.arange(len(seen)) * buckets + b
        keep = np.flatnonzero(n > 0)
        rows = [("model", 1, b, None, packed(words[keep], gid[keep], n[keep]), _tally(n, (n > 0) & (words != BEGIN)))]
        at = 0
        for block, p in zip(table.column("block").to_pylist(), parts):
            mine = where[at : at + len(p[0])]
            rows.append(("answer", 1, b, block, packed(gid[mine], n[mine]), None))
            at += len(mine)
        return _rows(rows)

    return asks.select("bucket", "block", "data").groupBy("bucket").applyInArrow(count, _ROWS)


def asked(blocks: DataFrame, answers: DataFrame, levels: list[Level], k: int, deal: Deal) -> DataFrame:
    """Rows of kind 'ask' (a block's n-grams of order k in a bucket) and 'want' (histories that are dealt over salts)."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            block = Block(row, right.to_pylist(), levels, deal, k - 1)
            a = Ask(block, k, deal)
            train = np.bincount(a.where[(a.where >= 0) & block.train], minlength=len(a.history))
            gid, total = block.gid[k - 1], block.count[k - 1]
            base = np.zeros(len(gid))
            # the divisor of the lower n-grams: that of their history
            lower_history = block.ask[k - 1].history[a.lower] if k > 2 else np.zeros(len(a.lower), np.int64)
            base[a.history] = block.base(k - 1, lower_history)
            at_c, at_e = 0, 0
            for b in np.unique(a.context_bucket).tolist():
                end_c = int(np.searchsorted(a.context_bucket, b, side="right"))
                size = a.size[at_c:end_c]
                end_e = at_e + int(size.sum())
                c, e = a.context[at_c:end_c], a.entry[at_e:end_e]
                data = packed(gid[c], size, total[c], base[c].astype(np.int64), a.without[c].astype(np.int64), block.gid[1][a.word[e]], block.count[k - 1][a.lower[e]], train[e])
                rows.append(("ask", k, b, row["block"], data, None))
                at_c, at_e = end_c, end_e
            for b in np.unique(a.hot_bucket).tolist():
                rows.append(("want", k, b, row["block"], packed(gid[a.hot[a.hot_bucket == b]]), None))
        return _rows(rows)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, _ROWS)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, where): the row at which each distinct key starts in sorted order, and each row's key number."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


def counted_ngrams(asks: DataFrame, below: Level, k: int, deal: Deal) -> DataFrame:
    """Rows of kind 'model' (history, word, number, count), 'answer' for blocks, and 'part' with what salts of a history have.

    Wants stand in a history's home and pass as they are.
    """

    def count(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        wants = [("want", k, b, r["block"], r["data"], None) for r in table.filter(pc.equal(table.column("kind"), "want")).select(["block", "data"]).to_pylist()]
        table = table.filter(pc.equal(table.column("kind"), "ask"))
        if not table.num_rows:
            return _rows(wants)
        parts = [unpacked(x) for x in table.column("data").to_pylist()]
        h, size, total, base, without, w, low, train = (np.concatenate(c) for c in zip(*parts))
        context = np.repeat(np.arange(len(h)), size)
        first, where = _grouped(h[context], w)
        n = np.bincount(where, train, len(first)).astype(np.int64)
        found, of = _grouped(h)  # distinct histories
        mine = of[context[first]]  # the history of each distinct n-gram
        rare = [np.bincount(mine[n == r], minlength=len(found)) for r in range(1, RARE + 1)]
        lower = np.bincount(mine[n > 0], (below.seen(low[first]) / np.maximum(base[context[first]], 1))[n > 0], len(found))
        none_rare = (sum(rare) == 0).astype(np.int64)
        gid = np.where(n > 0, (np.cumsum(n > 0) - 1) * deal.buckets + b, -1)
        keep = np.flatnonzero(n > 0)
        rows = [("model", k, b, None, packed(h[context[first]][keep], w[first][keep], gid[keep], n[keep]), _tally(n, n > 0))]
        # unseen n-grams of a context, or words that nobody knows, need its backoff weight
        needed = (np.bincount(context, n[where] == 0, len(h)) > 0) | (without > 0)
        e = c = 0
        for block, p in zip(table.column("block").to_pylist(), parts):
            i, x = where[e : e + len(p[5])], of[c : c + len(p[0])]
            need = needed[c : c + len(p[0])]
            rows.append(("answer", k, b, block, packed(gid[i], n[i], none_rare[x], *[r[x] * need for r in rare], lower[x] * need), None))
            e, c = e + len(p[5]), c + len(p[0])
        hot = np.flatnonzero(deal.salts(total[found]) > 1)
        at = deal.home(h[found[hot]])
        for to in np.unique(at).tolist():
            x = hot[at == to]
            rows.append(("part", k, to, None, packed(h[found[x]], *[r[x] for r in rare], lower[x]), None))
        return _rows(rows + wants)

    return asks.select("kind", "bucket", "block", "data").groupBy("bucket").applyInArrow(count, _ROWS)


def added_up(parts: DataFrame, wants: DataFrame) -> DataFrame:
    """Answers of kind 'hot': what the salts of the histories that a block wants have together."""

    def add(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), map(unpacked, table.column("data").to_pylist())))
        b, k = table.column("bucket")[0].as_py(), table.column("level")[0].as_py()
        have = [np.concatenate(c) for c in zip(*[d for kind, _, d in rows if kind == "part"])]
        if not have:
            return _rows([])
        h, where = np.unique(have[0], return_inverse=True)
        sums = [np.bincount(where, c, len(h)) for c in have[1:]]
        rare = [s.astype(np.int64) for s in sums[:-1]]
        none_rare = (sum(rare) == 0).astype(np.int64)
        out = []
        for kind, block, d in rows:
            if kind == "want":
                i = np.searchsorted(h, d[0])
                out.append(("hot", k, b, block, packed(none_rare[i], *[r[i] for r in rare], sums[-1][i]), None))
        return _rows(out)

    both = parts.select("kind", "level", "bucket", "block", "data").unionByName(wants.select("kind", "level", "bucket", "block", "data"))
    return both.groupBy("bucket").applyInArrow(add, _ROWS)


def _level(model: DataFrame) -> Level:
    sums = model.agg(*[F.sum(F.col("tally")[i]) for i in range(RARE + 3)]).first()
    *tally, total, distinct = [int(x or 0) for x in sums]
    return Level.of(tally, total, distinct)


def _kinds(df: DataFrame, path: str) -> DataFrame:
    """df as a table in parts by kind."""
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Model:
    """The tables of each order (kind 'model' under order=k) and their levels, with the blocks and what they were answered."""

    path: str
    order: int
    deal: Deal
    levels: list[Level]
    blocks: DataFrame
    answers: DataFrame


def fitted(docs: DataFrame, held, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_entries: int = BUCKET_ENTRIES, hot: int = HOT) -> Model:
    """Counts of all documents where held is false, and every block's answers.

    The driver gets one row of sums an order.
    """
    spark = docs.sparkSession
    root = shared_dir(spark, "katz")
    rows = long_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # a token has some four characters at least; too many buckets only make smaller ones
    buckets = max(1, -(-characters // (4 * bucket_entries)))
    deal = Deal(buckets, hot)
    cut = _kinds(tokenised(rows, buckets, block_tokens), f"{root}/blocks")
    blocks = cut.filter("kind = 'block'").select("block", "doc_ids", "held", "data", "word_buckets")
    asks = cut.filter("kind = 'ask'")
    levels, answers = [Level(np.zeros(RARE + 1))], None
    for k in range(1, order + 1):
        if k > 1:
            asks = asked(blocks, answers, levels, k, deal)
        made = counted_words(asks, buckets) if k == 1 else counted_ngrams(asks, levels[k - 1], k, deal)
        made = _kinds(made, f"{root}/order={k}")
        levels.append(_level(made.filter("kind = 'model'")))
        new = made.filter("kind = 'answer'")
        if k > 1:
            new = new.unionByName(written(added_up(made.filter("kind = 'part'"), made.filter("kind = 'want'")), "katz-hot"))
        new = new.select("block", "level", "kind", "bucket", "data")
        answers = new if answers is None else answers.unionByName(new)
    return Model(root, order, deal, levels, blocks, answers)


def scored(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    levels, deal, order = model.levels, model.deal, model.order
    total, distinct = levels[1].total, levels[1].distinct

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for row in left.to_pylist():
            block = Block(row, right.to_pylist(), levels, deal, order)
            n, inside = block.count[1][block.tokens], block.place > 0
            starts = np.cumsum(block.lengths) - block.lengths
            per = lambda x, starts=starts, inside=inside: np.add.reduceat(np.where(inside, x, 0), starts)
            out["doc_id"] += block.doc_ids
            out["held_out"] += block.held.tolist()
            out["n_tokens"] += (block.lengths - 1).tolist()
            out["n_known"] += per(n > 0).astype(np.int64).tolist()
            out["train_tokens"] += [total] * len(starts)
            out["base_score"] += per(np.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))).tolist()
            out["score"] += per(np.log10(np.where(inside, block.probabilities(order), 1.0))).tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return model.blocks.groupBy("block").cogroup(model.answers.groupBy("block")).applyInArrow(score, schema)


def ngrams(model: Model, k: int) -> DataFrame:
    """The stored n-grams of order k: history and word (numbers of order k - 1 and of words; a hash as word of order 1), number, n, and the discounted count."""
    level = model.levels[k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                *history, word, number, n = unpacked(data)
                history = history[0] if history else np.full(len(word), -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (history, word.view(np.int64), number, n, level.seen(n))], ["history", "word", "number", "n", "discounted"])

    table = model.blocks.sparkSession.read.schema(_ROWS).parquet(f"{model.path}/order={k}")
    return table.filter("kind = 'model'").select("data").mapInArrow(rows, "history long, word long, number long, n long, discounted double")


def katz_scores(docs: DataFrame, held, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_entries: int = BUCKET_ENTRIES, hot: int = HOT) -> DataFrame:
    return scored(fitted(docs, held, order, block_tokens, bucket_entries, hot))


def op13_katz_scores(spark, sf_dir: str) -> DataFrame:
    return katz_scores(read_table(spark, sf_dir, "documents"), held_out(10, 0))
