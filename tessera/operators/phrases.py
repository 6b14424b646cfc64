"""Recognisers from the user's own lists: phrases of any number, patterns from YAML, and token patterns.

A list of bounded size goes to every executor as an automaton that goes over a text once.  Of a longer one only a filter of
bounded size does: a phrase starts and ends where tokens do (runs of letters, digits and underscores, and single other
characters), so the filter is asked for runs of tokens, and what it lets pass is joined with the list.  What is found is every place where a phrase stands, as it is written or in any case, and
not inside a longer word: where it begins or ends with a letter, digit or underscore, none stands beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..sources.shared import kept
from .recognizers import HIGH, LOW, MEDIUM, Recognizer

#: Characters of a list whose automaton goes to every executor, and of one that the driver may hold.
MOST_CHARACTERS, MOST_LISTED = 1_000_000, 32_000_000
#: Bits of the filter of a longer list: its own a phrase, at least and at most as powers of two, in one piece, and asked for a run.
FILTER_BITS, LEAST_BITS, MOST_BITS, PIECE_BITS, PROBES = 64, 18, 27, 18, 4
#: Characters, and texts, that are looked at together; a longer text is looked at alone.
BLOCK, MOST_ROWS = 1 << 19, 50_000
SPAN = "struct<start:int,end:int,label:string,text:string,score:double>"
_SCORES = {"low": LOW, "med": MEDIUM, "high": HIGH}


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay the same; a character that would become two stays."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # whose lower case depends on its neighbours
        return low
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """All phrases of (phrase, label, score, cased); a phrase may have several labels."""

    def __init__(self, phrases: Iterable[tuple[str, str, float, bool]]):
        import ahocorasick

        self.cased, self.folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label, score, cased in phrases:
            if not phrase:
                continue
            to, key = (self.cased, phrase) if cased else (self.folded, lowered(phrase))
            known = to.get(key, None)
            if known is None:
                to.add_word(key, (len(key), [(label, score)]))
            else:
                known[1].append((label, score))
        for a in (self.cased, self.folded):
            if len(a):
                a.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, str, float]]:
        """start, end, label, text, score, in order; of several scores of a label at a place the highest."""
        found: dict[tuple[int, int, str], float] = {}
        for automaton, body in ((self.cased, text), (self.folded, None)):
            if not len(automaton):
                continue
            for last, (size, labels) in automaton.iter(body if body is not None else lowered(text)):
                start, end = last + 1 - size, last + 1
                if start and _word(text[start - 1]) and _word(text[start]) or end < len(text) and _word(text[end]) and _word(text[last]):
                    continue
                for label, score in labels:
                    key = (start, end, label)
                    found[key] = max(score, found.get(key, 0.0))
        return [(s, e, label, text[s:e], score) for (s, e, label), score in sorted(found.items())]


class Tokens:
    """Texts as one row of characters, and hashes of runs of their tokens.

    A hash is that of a run's characters: a sum over powers, from sums over all characters before.
    """

    FACTOR = 0x9E3779B97F4A7C15
    _powers: tuple[np.ndarray, np.ndarray] | None = None
    _word: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if Tokens._word is None:
            Tokens._word = np.array([_word(chr(c)) for c in range(0x110000)] + [False])
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        row = np.full(int(sizes.sum()) + len(texts), 0x110000, dtype=np.uint32)  # what ends a text stands in no phrase
        for at, c in zip(self.starts, codes):
            row[at : at + len(c)] = c
        if Tokens._powers is None or len(Tokens._powers[0]) <= len(row):
            factors = np.full(max(len(row), 2 * BLOCK), Tokens.FACTOR, dtype=np.uint64), np.full(max(len(row), 2 * BLOCK), pow(Tokens.FACTOR, -1, 1 << 64), dtype=np.uint64)
            Tokens._powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(f)]) for f in factors)
        word = Tokens._word[row]
        self.at = np.append(np.flatnonzero(~(word & np.concatenate([[False], word[:-1]]))), len(row))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(row.astype(np.uint64)) * Tokens._powers[0][: len(row)])])
        self.sums, self.back = sums[self.at], Tokens._powers[1][self.at]

    def runs(self, first: np.ndarray, n: int) -> np.ndarray:
        """The hashes of n tokens from the token first."""
        return mixed((self.sums[first + n] - self.sums[first]) * self.back[first])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(Tokens.FACTOR)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return ((hashes + np.uint64(probe) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _passed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter has."""
    bits, left = int(len(table) * 8).bit_length() - 1, np.arange(len(hashes))
    for probe in range(PROBES):
        slots = _slots(hashes[left], bits, probe)
        left = left[(table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0]
    return left


def _beginning(n: int) -> int:
    """Tokens by which phrases of n tokens are looked for first."""
    return 1 << n.bit_length() - 1


def _listed(phrases: DataFrame) -> DataFrame:
    """form (what stands in a text, in lower case where any case fits), cased, n (its tokens), hashes: of all and of its first tokens."""
    step = min(MOST_ROWS, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cased = batch.column("cased").to_pylist()
            forms = [p if c else lowered(p) for p, c in zip(batch.column("phrase").to_pylist(), cased)]
            for low in range(0, len(forms), step):
                part = forms[low : low + step]
                t = Tokens(part)
                first = np.searchsorted(t.at, t.starts)
                n = np.diff(np.append(first, len(t.at) - 1)) - 1
                hashes = np.zeros((len(part), 2), dtype=np.uint64)
                for size in np.unique(n):
                    rows = np.flatnonzero(n == size)
                    hashes[rows, 0], hashes[rows, 1] = t.runs(first[rows], size), t.runs(first[rows], _beginning(int(size)))
                of = batch.slice(low, len(part))
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * 2, pa.int32()), pa.array(hashes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), of.column("cased"), of.column("label"), of.column("score"), pa.array(n, pa.int32()), pairs], ["form", "cased", "label", "score", "n", "hashes"])

    return phrases.select("phrase", "label", "score", "cased").filter("phrase <> ''").mapInArrow(run, "form string, cased boolean, label string, score double, n int, hashes array<long>")


def _filter(listed: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the list's hashes; pieces are made by tasks, and at most 2 ** MOST_BITS bits reach the driver."""
    bits = min(max((FILTER_BITS * n).bit_length(), LEAST_BITS), MOST_BITS)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            found = np.unique(np.concatenate([_slots(hashes, bits, p) for p in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((found >> PIECE_BITS).astype(np.int32)), pa.array((found & (1 << PIECE_BITS) - 1).astype(np.int32))], ["piece", "slot"])

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << PIECE_BITS, dtype=bool)
        marks[rows["slot"].to_numpy()] = True
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    table, size = np.zeros(1 << bits - 3, dtype=np.uint8), 1 << PIECE_BITS - 3
    for r in listed.select("hashes").mapInArrow(slots, "piece int, slot int").groupBy("piece").applyInPandas(piece, "piece int, bits binary").toLocalIterator():
        table[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table


def _of_long_list(texts: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """key, start, end, label, text, score for a list that no task can hold."""
    listed = kept(_listed(phrases), "phrases")
    lengths: dict[bool, dict[int, list[int]]] = {}
    for r in listed.select("cased", "n").distinct().orderBy("cased", "n").collect():  # at most as many as the longest phrase has tokens
        lengths.setdefault(r["cased"], {}).setdefault(_beginning(r["n"]), []).append(r["n"])
    kind = dict(texts.dtypes)["key"]
    sent, most = texts.sparkSession.sparkContext.broadcast(_filter(listed, n)), MOST_ROWS

    def found(part: list[str], cased: bool) -> Iterator[tuple[int, int, int, str]]:
        """(text, start, end, form) of the runs that the filter lets pass."""
        forms = part if cased else [lowered(t) for t in part]
        tokens, table = Tokens(forms), sent.value
        count = len(tokens.at) - 1
        for begin, sizes in lengths[cased].items():
            if begin > count:
                continue
            first = np.arange(count - begin + 1)
            first = first[_passed(table, tokens.runs(first, begin))]
            for size in sizes:
                some = first[: np.searchsorted(first, count - size, side="right")]
                some = some[_passed(table, tokens.runs(some, size))] if size != begin else some
                low, high = tokens.at[some], tokens.at[some + size]
                of = np.searchsorted(tokens.starts, low, side="right") - 1
                low, high = low - tokens.starts[of], high - tokens.starts[of]
                yield from ((i, a, b, forms[i][a:b]) for i, a, b in zip(of.tolist(), low.tolist(), high.tolist()) if b <= len(forms[i]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("text").to_pylist()
            ends = np.cumsum([len(t) for t in values])
            at = 0
            while at < len(values):
                upto = min(at + most, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right"))))
                rows = [(at + i, a, b, cased, form, values[at + i][a:b]) for cased in lengths for i, a, b, form in found(values[at:upto], cased)]
                columns = [list(c) for c in zip(*rows)] or [[]] * 6
                of = pa.array(columns[0], pa.int64())
                types = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(of), batch.column("row").take(of), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], ["key", "row", "start", "end", "cased", "form", "text"])
                at = upto

    runs = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(search, f"key {kind}, row long, start int, end int, cased boolean, form string, text string")
    labels = listed.groupBy("form", "cased", "label").agg(F.max("score").alias("score"))
    places = runs.join(labels, ["form", "cased"])
    if len(lengths) > 1:  # two phrases may say the same of a place: one in this case, one in any
        places = places.groupBy("row", "start", "end", "label").agg(F.any_value("key").alias("key"), F.any_value("text").alias("text"), F.max("score").alias("score"))
    return places.select("key", "start", "end", "label", "text", "score")


_BUILT: dict[object, Automaton] = {}


def _built(name: object, phrases: Iterable[tuple]) -> Automaton:
    """One automaton a Python worker at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(phrases)
    return _BUILT[name]


def phrase_table(phrases: DataFrame, phrase: str = "phrase", label: str | None = None, score: float = HIGH, cased: bool = True) -> DataFrame:
    """phrase, label, score, cased: a list of phrases without null and empty ones; the phrase's column names the label where no column does."""
    name = F.col(label).cast("string") if label else F.lit(phrase)
    return phrases.select(F.col(phrase).cast("string").alias("phrase"), name.alias("label"), F.lit(float(score)).alias("score"), F.lit(cased).alias("cased")).filter("phrase <> ''").distinct()


def phrase_matches(df: DataFrame, key: str, column: str, phrases: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """key, start, end, label, text, score: every place of every phrase of a phrase_table() in a column of texts.

    A null text has none.  Rows that share a key are searched each; keys may have any type.
    """
    n, size = phrases.agg(F.count(F.lit(1)), F.sum(F.length("phrase"))).first()
    texts = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).filter("text IS NOT NULL")
    kind = dict(texts.dtypes)["key"]
    schema = f"key {kind}, start int, end int, label string, text string, score double"
    names = ["key", "start", "end", "label", "text", "score"]

    def rows(automaton: Automaton, keys: pa.Array, values: pa.Array) -> pa.RecordBatch:
        found = [(i, *m) for i, t in enumerate(values.to_pylist()) for m in automaton.find(t)]
        columns = [list(c) for c in zip(*found)] or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names)

    if (size or 0) <= most:
        sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in phrases.select("phrase", "label", "score", "cased").collect()])
        name = f"{sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)}-{n}"

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(_built(name, sent.value), batch.column("key"), batch.column("text"))

        return texts.mapInArrow(search, schema).withColumnRenamed("key", key)

    return _of_long_list(texts, phrases, n).withColumnRenamed("key", key)


def phrase_spans(column: str, phrases: list[tuple[str, str, float, bool]]) -> Column:
    """Spans as those of pii.spans(), of the stripped value, for a list (phrase, label, score, cased) that the driver holds."""
    if sum(len(p[0]) for p in phrases) > MOST_LISTED:
        raise ParameterError("a list of this size is for phrase_matches()")
    from .pii import SPANS, stripped

    name = f"{hash(tuple(phrases))}-{len(phrases)}"

    @F.pandas_udf(SPANS)
    def find(values):
        automaton = _built(name, phrases)
        return values.map(lambda t: automaton.find(t) if t is not None else None)

    return find(stripped(F.col(column)))


def token_patterns(patterns: Iterable[dict], labels: dict[str, str]) -> list[tuple[str, str, float, bool]]:
    """Phrases (phrase, label, score, cased) of {"label", "pattern"}: a string as it is written, or tokens {"LOWER": word} in any case.

    Tokens are joined by blanks, but a single mark stands right behind the token before it.  Labels that the map lacks are left out.
    """
    found = []
    for p in patterns:
        label = labels.get(p["label"])
        if not label:
            continue
        if isinstance(p["pattern"], str):
            found.append((p["pattern"], label, HIGH, True))
            continue
        tokens = [t["LOWER"] for t in p["pattern"]]
        joined = "".join(t if i == 0 or (len(t) == 1 and not t.isalnum()) else f" {t}" for i, t in enumerate(tokens))
        found.append((joined, label, HIGH, False))
    return found


def from_config(config: dict, folder: str | Path = ".") -> tuple[list[Recognizer], list[tuple[str, str, float, bool]]]:
    """(recognisers, phrases) of a configuration.

    namespace: three to seventeen letters and underscores, a letter first; labels are namespace/name.  regex: {name: {patterns:
    [{score: low, med or high; regex; header_match, header_skip: patterns for the column's name}]}}; with header_match a pattern
    counts only where one of them fits.  phrase: {name: {paths: [{path, case: yes or no}]}}, a phrase a line.
    """
    space = config.get("namespace")
    if not space or not re.fullmatch(r"[A-Za-z][A-Za-z_]{2,16}", space):
        raise ParameterError("a namespace has 3 to 17 letters and underscores, a letter first")
    listed = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
    recognizers, phrases = [], []
    for name, rule in (config.get("regex") or {}).items():
        for p in rule["patterns"]:
            if p.get("score") not in _SCORES:
                raise ParameterError(f"{name}: score is one of {', '.join(_SCORES)}")
            score, heads = _SCORES[p["score"]], listed(p.get("header_match"))
            recognizers.append(Recognizer(f"{space}/{name.lower()}", p["regex"], score, score, header_patterns=heads, against_patterns=listed(p.get("header_skip")), context_only=bool(heads)))
    for name, rule in (config.get("phrase") or {}).items():
        for source in rule.get("paths") or ():
            path = Path(folder) / source["path"] if source.get("path") else None
            if path is None or not path.is_file():
                raise ParameterError(f"{name}: no phrase list at {path}")
            cased = source.get("case") in ("yes", True)
            lines = dict.fromkeys(line for line in path.read_text(encoding="utf-8").split("\n") if line)
            phrases += [(line, f"{space}/{name.lower()}", HIGH, cased) for line in lines]
    return recognizers, phrases


def from_yaml(path: str | Path) -> tuple[list[Recognizer], list[tuple[str, str, float, bool]]]:
    """from_config() of a YAML file; its lists are named relative to it."""
    import yaml

    return from_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, Path(path).parent)
