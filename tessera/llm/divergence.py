"""How the sources of a language differ in the terms they use.

Texts are cut into terms on executors, and a task adds up (documents, occurrences) of each (lang, term, source)
before anything is shuffled.  The sums are dealt by (lang, term) and sorted by (lang, term, source, document), and
one pass over a sorted partition finds the runs: a run of a term gives its document frequency in the language and
its occurrences in each source, whatever the number of its rows, as only the open run is carried from batch to batch.
Terms of enough documents are kept and written.  Their shares are integers, p = 1 + floor(UNIT (count + 1) / (N + V)),
and a second sorted pass gives, per run, what each term adds for pairs of sources, and the terms that a source
uses more than its language does.

With z the share of an absent term, a pair's value is sum f(p, q) over all kept terms.  A run of k sources adds
f(p, q) - f(z, q) - f(p, z) + f(z, z) for its k (k - 1) pairs only; the rest depends on one side's counts alone,
and is added from each source's counts of counts.  So absent terms cost nothing, and no value is left out.

Null text, lang and source are ''.  Every row is a document of its own, so repeated rows and rows that share an id count as
often as they stand; doc_id is not read.  A group without terms takes part with counts of 0; a language without
kept terms has pairs of value 0.  Very long texts are cut whole.  Ties in rank go to the smaller item in UTF-8.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_texts, read_table, written

UNIT = 1_000_000_000
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
#: Sums that a task holds before it hands them on.
HELD = 300_000
#: Pairs of one vector operation.
PAIRS = 1 << 19
#: Groups up to this many are joined by broadcast, more by a shuffle over SALTS copies of each.
BROADCAST_GROUPS, SALTS = 50_000, 32

#: Bytes of a term stay (A-Z as a-z; all of a character beyond ASCII), others part terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SUMS = "lang string, term string, source string, document long, n_docs long, n long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def term_sums(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, term, source, document, n_docs, n: sums over the documents of one run of rows; document is the first one's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = first = TaskContext.get().partitionId() << 33
        found: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in found.items():
                m = len(n)
                if m:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * m, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array([source] * m, pa.string()),
                        pa.array(np.full(m, first)), pa.array(list(map(n_docs.__getitem__, n)), pa.int64()), pa.array(list(n.values()), pa.int64()),
                    ], ["lang", "term", "source", "document", "n_docs", "n"])

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                words = terms(text.as_py())
                n, n_docs = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                n_docs.update(set(words))
                size += len(n)
                no += 1
                if size > held:
                    yield from given()
                    found, first, size = {}, no, 0
        yield from given()

    return long_texts(docs).select("lang", "source", "text").mapInArrow(count, _SUMS)


def _edges(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; true for the first."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


def _runs(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    """The output of step(table, last) over sorted batches; the rows that it returns beside stand before the next batch."""
    carried = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = (table if carried is None else pa.concat_tables([carried, table])).combine_chunks()
            out, carried = step(table, False)
            yield from out
    if carried is not None and carried.num_rows:
        yield from step(carried, True)[0]


def _open(table: pa.Table, last: bool) -> int:
    """The row from which on the table's last run of (lang, term) stands; its end if no more rows follow."""
    if last:
        return table.num_rows
    return int(np.flatnonzero(_edges([table.column(i).combine_chunks() for i in range(2)]))[-1])


def kept_counts(sums: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n, lang_n, is_first for the terms of at least ``least`` documents of their language.

    lang_n is the term's n in the language; is_first marks one row of each (lang, term).
    """
    names = ["lang", "term", "source", "n", "lang_n", "is_first"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(table: pa.Table, last: bool):
            columns = [table.column(i).combine_chunks() for i in range(3)]
            at = np.flatnonzero(_edges(columns))
            n_docs, n = (np.add.reduceat(table.column(c).to_numpy(), at) for c in ("n_docs", "n"))
            # rows of one source become one, so what is carried on has a row a source at most
            table = table.take(pa.array(at)).set_column(4, "n_docs", pa.array(n_docs)).set_column(5, "n", pa.array(n))
            end = _open(table, last)
            done, rest = table.slice(0, end), table.slice(end)
            if not end:
                return [], rest
            new = _edges([done.column(i).combine_chunks() for i in range(2)])
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, end))
            frequency = np.repeat(np.add.reduceat(n_docs[:end], starts), size)
            whole = np.repeat(np.add.reduceat(n[:end], starts), size)
            keep = frequency >= least
            out = pa.Table.from_arrays([*done.columns[:3], pa.array(n[:end]), pa.array(whole), pa.array(new)], names).filter(pa.array(keep))
            return out.combine_chunks().to_batches(), rest

        yield from _runs(batches, step)

    dealt = sums.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(scan, "lang string, term string, source string, n long, lang_n long, is_first boolean")


def share(n, total) -> F.Column:
    """1 + floor(UNIT (n + 1) / total), exact."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {UNIT}) div {total}")


def f_value(p, q) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N + V), lang_total, v, z (the share of an absent term) of every group that occurs."""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    by_lang = kept.filter("is_first").groupBy("lang").agg(F.count(F.lit(1)).alias("_v"), F.sum("lang_n").alias("_ln"))
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, ["lang"], "left").fillna(0, ["_n", "_v", "_ln"])
    totals = groups.select("lang", "source", (F.col("_n") + F.col("_v")).alias("total"), (F.col("_ln") + F.col("_v")).alias("lang_total"), F.col("_v").alias("v"))
    return totals.withColumn("z", F.when(F.col("v") > 0, F.expr(f"1 + {UNIT} div greatest(total, 1)")).otherwise(F.lit(1)))


def with_totals(kept: DataFrame, totals: DataFrame, n_groups: int) -> DataFrame:
    """kept with its group's totals: by broadcast where the groups are few, or else dealt over salts, as one group may have most rows."""
    if n_groups <= BROADCAST_GROUPS:
        return kept.join(F.broadcast(totals), ["lang", "source"])
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"]).drop("salt")


def run_pairs(shares: DataFrame) -> DataFrame:
    """lang, source, item, value: what the terms of each run add for its ordered pairs of sources, beyond what one side gives alone."""
    schema = "lang string, source string, item string, value long"

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole runs, added up per pair of sources."""
        keys = [table.column(i).combine_chunks() for i in range(2)]
        starts = np.flatnonzero(_edges(keys))
        size = np.diff(np.append(starts, table.num_rows))
        p, z = table.column("p").to_numpy(), table.column("z").to_numpy()
        named = pc.dictionary_encode(table.column("lang").combine_chunks()), pc.dictionary_encode(table.column("source").combine_chunks())
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in named)
        m = len(named[1].dictionary)
        mates = np.repeat(size, size)
        first = np.repeat(starts, size)
        upto = np.cumsum(mates)
        at = 0
        while at < len(mates):  # some rows at a time, each with all rows of its run
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(at, end), mates[at:end])
            j = np.arange(len(i)) - np.repeat(np.cumsum(mates[at:end]) - mates[at:end], mates[at:end]) + first[i]
            i, j = i[i != j], j[i != j]
            value = _f(p[i], p[j]) - _f(z[i], p[j]) - _f(p[i], z[j]) + _f(z[i], z[j])
            key, where = np.unique((lang[i] * m + source[i]) * m + source[j], return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, where, value)
            names = [named[0].dictionary.take(pa.array(key // (m * m))), named[1].dictionary.take(pa.array(key // m % m)), named[1].dictionary.take(pa.array(key % m))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(total)], ["lang", "source", "item", "value"])
            at = end

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(table: pa.Table, last: bool):
            end = _open(table, last)
            return (pairs_of(table.slice(0, end).combine_chunks()) if end else []), table.slice(end)

        yield from _runs(batches, step)

    dealt = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, schema)


def single_sides(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value: f(z, q) over the item's terms and f(p, z) over the source's, for every pair of a language's sources.

    A source has one array of its counts of counts (as many as it has different counts), and each language one array of
    its sources: the result has a row for every pair of them anyway.
    """
    tally = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    counts = tally.groupBy("lang", "source").agg(F.collect_list("p").alias("p"), F.collect_list("m").alias("m"))
    sides = totals.groupBy("lang").agg(F.collect_list("source").alias("others"), F.collect_list("z").alias("zs"))
    rows = totals.select("lang", "source", "z", "v").join(counts, ["lang", "source"], "left").join(sides, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p, m = np.array(r["p"] or [], dtype=np.int64), np.array(r["m"] or [], dtype=np.int64)
                absent = r["v"] - int(m.sum())
                z, zs = np.int64(r["z"]), np.array(r["zs"], dtype=np.int64)
                as_item = _f(zs, z) * absent  # the others' terms are absent: f(their z, q)
                as_source = np.zeros(len(zs), dtype=np.int64)
                step = max(1, PAIRS // max(len(zs), 1))
                for at in range(0, len(p), step):
                    a, b = p[at : at + step, None], m[at : at + step, None]
                    as_item += (_f(zs[None], a) * b).sum(0)
                    as_source += ((_f(a, zs[None]) - _f(z, zs[None])) * b).sum(0)
                others = [i for i, o in enumerate(r["others"]) if o != r["source"]]
                names, own = [r["others"][i] for i in others], [r["source"]] * len(others)
                for a, b, value in ((names, own, as_item), (own, names, as_source)):
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(others), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value[others])], ["lang", "source", "item", "value"])

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = written(kept_counts(term_sums(docs), least), "kept-terms")
    totals = written(group_totals(docs, kept), "group-totals")
    shares = with_totals(kept, totals, totals.count()).withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")})
    wide = F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    pairs = single_sides(shares, totals).unionByName(run_pairs(shares)).groupBy("lang", "source", "item").agg(wide)
    more = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), f_value("p", "q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(more, "term").filter(F.col("rank") <= most_terms))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
    SELECT row_number() OVER () AS no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
    SELECT no, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT no) >= {LEAST_DOCUMENTS}
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), l AS (
    SELECT lang, count(*) AS v, sum(ln) AS ln FROM kept GROUP BY lang
), g AS (
    SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.ln, 0) AS ln, coalesce(t.n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) t USING (lang, source)
), s AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p, 1 + ({UNIT}::HUGEINT * (k.ln + 1)) // (g.ln + g.v) AS q
    FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
    FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
