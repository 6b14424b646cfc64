"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to the product of

* the host prior: the languages that the host's other pages declare, shrunk towards those of its registered
  domain and of the whole table (Dirichlet smoothing at each level), from one grouped aggregation with grouping
  by level; a page's own declaration is left out of it, as it is evidence of its own;
* the likelihood of the address's suffix (its host's last label): how many of the pages whose text alone says a
  language have it, counted per suffix by grouped aggregation;
* the likelihoods of the declared markup language and of a language label in the address's path, from confusion
  tables counted between what pages say and what their text alone says;
* the text's likelihood under character trigrams (naive Bayes), tempered to TEXT_TRIGRAMS trigrams so that
  long texts don't drown the other evidence altogether.

The languages are all labels that documents have, or pages declare, in any row (case folded).  The trigram model is
fitted on about SAMPLE_ROWS documents of each language (a documented bound), all of them where there are fewer; a
language that only pages declare is fitted on the visible text of as many of those.  Host priors and confusion
tables are counted over all rows, and whole texts are scored.  An address's label is any two letters of a path, so
it doesn't make a language; where it names none of them, it says nothing.

Nulls: a null page has no text, a null address no host, suffix and label; such evidence is left out.  With no
evidence at all the answer is the most frequent language.  Ties go to the language first in order.  Repeated
rows are answered alike.  Very long texts are read whole, and their trigrams tempered as said.  A language without
any text is never the one that a text speaks for.  Other columns of documents may have any name: they are carried
inside one struct.  An empty table gives an empty result; without labelled documents the language is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import long_texts, read_table, written

#: About so many labelled texts of each language, at most, the trigram model is fitted on.
SAMPLE_ROWS = 4_000
#: Share of every language's probability that is dealt evenly over all buckets; the same for a large and a small sample,
#: as texts unlike all languages would go to the smallest sample otherwise.
EVEN = 0.01
#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: A text counts as this many trigrams at most.
TEXT_TRIGRAMS = 200.0
#: Weight, in pages, of the level above in a level's prior, and of evenness in the top one.
SMOOTHING = 5.0
#: Levels of the host prior: everything, registered domain, host.
LEVELS = 3
#: A document is kept from this posterior on, where it has letters at all.
LEAST_POSTERIOR = 0.5

#: What is left open runs to the end, so that no mark makes the search start anew over the rest.
_MARKUP = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>|&[#\w]+;")
_DECLARED = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b"
_ADDRESS = r"^[a-z][a-z0-9+.-]*://[^/]*/([a-z]{2})(?:[/?#-]|$)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams of the letters of a text; everything else is one blank."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xDF) & (codes != 0xF7))
    codes = np.where(letter, codes, 32)
    keep = np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32))) if len(codes) else np.zeros(0, bool)
    codes = codes[keep].astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)


class Trigrams:
    """log P(trigram | language) for every language and bucket."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def log_likelihoods(self, text: bytes) -> np.ndarray:
        """Per language, tempered; all zero for a text without trigrams."""
        counts = trigram_counts(text)
        n = counts.sum()
        return self.table @ counts * (min(n, TEXT_TRIGRAMS) / n) if n else np.zeros(len(self.languages))


def label(c: Column) -> Column:
    """A language label in lower case; null for an empty one."""
    return F.when(c != "", F.lower(c))


def counted(rows: DataFrame, most: int, html: bool) -> dict[str, np.ndarray]:
    """For each lang of rows (lang, key, text) the trigram counts of about ``most`` of its texts, by key; zeros without text."""
    texts = F.approx_count_distinct(F.when(F.col("text").isNotNull(), F.col("key")))
    found = {r["lang"]: r["n"] for r in rows.filter("lang IS NOT NULL").groupBy("lang").agg(texts.alias("n")).collect()}
    sums = {lang: np.zeros(BUCKETS, np.int64) for lang in found}
    if not any(found.values()):
        return sums
    parts = 1 << 32
    below = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, parts * most // max(n, most))])
    sample = long_texts(rows).filter(F.col("text").isNotNull() & (F.pmod("key", F.lit(parts)) < F.try_element_at(below, F.col("lang")))).dropDuplicates(["lang", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                text = text.as_py()
                sums[lang] = sums.get(lang, 0) + trigram_counts(_MARKUP.sub(b" ", text) if html else text)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    for lang, mine in counts.groupby("lang"):
        sums[lang][mine["bucket"].to_numpy(dtype=np.int64)] = mine["n"].to_numpy()
    return sums


def fitted(docs: DataFrame, pages: DataFrame | None = None, most: int = SAMPLE_ROWS) -> Trigrams:
    """Trigram model of every language that documents are labelled with, or pages (page_id, _html, declared) declare."""
    text = lambda c: F.col(c).cast("string").alias("text")
    sums = counted(docs.select(label(F.col("lang")).alias("lang"), F.xxhash64("doc_id", "text").alias("key"), text("text")), most, html=False)
    if sums and pages is not None:
        others = pages.select(F.col("declared").alias("lang"), F.xxhash64("page_id", "_html").alias("key"), text("_html"))
        sums |= counted(others.filter(~F.col("lang").isin(list(sums))), most, html=True)
    languages = sorted(sums)
    table = np.full((len(languages), BUCKETS), EVEN / BUCKETS)
    for k, lang in enumerate(languages):
        table[k] += (1 - EVEN) * sums[lang] / max(sums[lang].sum(), 1)
    return Trigrams(languages, np.log(table))


def with_text_evidence(rows: DataFrame, model: Trigrams, text: str, html: bool) -> DataFrame:
    """rows without the text column, and evidence: log-likelihood per language (visible text only of markup)."""
    kept = long_texts(rows).withColumnRenamed(text, "_text").withColumn("_text", F.col("_text").cast("string"))
    schema = StructType([f for f in kept.schema if f.name != "_text"]).add("evidence", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("_text").cast(pa.binary())]
            found = [model.log_likelihoods(_MARKUP.sub(b" ", t) if html else t).tolist() for t in texts]
            yield batch.drop_columns(["_text"]).append_column("evidence", pa.array(found, pa.list_(pa.float64())))

    return kept.mapInArrow(run, schema)


def host_levels(host: Column) -> Column:
    """array of (level, name): the host (2), its last two labels (1), everything (0)."""
    labels = F.split(F.lower(host), r"\.")
    tail = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k))
    level = lambda k, name: F.struct(F.lit(k).alias("level"), name.alias("name"))
    return F.when(host.isNull(), F.array(level(0, F.lit("")))).otherwise(F.array(level(0, F.lit("")), level(1, tail(2)), level(2, F.lower(host))))


def level_counts(rows: DataFrame, host: str, said: str, languages: list[str]) -> DataFrame:
    """level, name, counts (array by language) of what rows say, by grouped aggregation; rows of a host are added up first."""
    by_host = rows.filter(F.col(said).isin(languages)).groupBy(host, said).agg(F.count(F.lit(1)).alias("n"))
    by_level = by_host.select(F.explode(host_levels(F.col(host))).alias("at"), said, "n").select("at.level", "at.name", said, "n")
    sums = [F.coalesce(F.sum(F.when(F.col(said) == lang, F.col("n"))), F.lit(0)).cast("double") for lang in languages]
    return by_level.groupBy("level", "name").agg(F.array(*sums).alias("counts"))


def smoothed(counts: list[Column], languages: int) -> Column:
    """The prior at the last of the levels: each level's counts with the level above as SMOOTHING pages."""
    prior = F.array(*[F.lit(1.0 / languages)] * languages)
    for c in counts:
        prior = F.when(c.isNull(), prior).otherwise(_shrunk(c, prior))
    return prior


def _shrunk(counts: Column, prior: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + SMOOTHING
    return F.transform(F.zip_with(counts, prior, lambda n, p: n + SMOOTHING * p), lambda v: v / total)


def with_host_prior(rows: DataFrame, host: str, said: str, languages: list[str]) -> DataFrame:
    """rows and prior (array by language), from the other rows: priors are made once per host and label, then joined by both."""
    table = written(level_counts(rows, host, said, languages), "language-levels")
    at = lambda k: table.filter(F.col("level") == k).select(F.col("name").alias(f"name{k}"), F.col("counts").alias(f"counts{k}"))
    hosts = rows.select(F.col(host).alias("_host"), F.col(said).alias("_said")).distinct().withColumn("levels", host_levels(F.col("_host")))
    for k in range(LEVELS):
        hosts = hosts.withColumn(f"name{k}", F.get("levels", F.lit(k))["name"])
    own = F.array(*[F.when(F.col("_said") == lang, 1.0).otherwise(0.0) for lang in languages])
    others = lambda k: F.zip_with(f"counts{k}", own, lambda n, x: n - x)
    for k in range(LEVELS):
        hosts = hosts.join(at(k), f"name{k}", "left")
    hosts = hosts.select("_host", "_said", smoothed([others(k) for k in range(LEVELS)], len(languages)).alias("prior"))
    return rows.join(hosts, rows[host].eqNullSafe(hosts["_host"]) & rows[said].eqNullSafe(hosts["_said"]), "left").drop("_host", "_said")


def with_suffix_evidence(rows: DataFrame, host: str, languages: list[str]) -> DataFrame:
    """rows, with log P(suffix of the host | language) added to evidence; nothing for a null host."""
    suffix = F.lower(F.substring_index(F.col(host), ".", -1))
    seen = rows.groupBy(suffix.alias("_suffix"), "text_lang").agg(F.count(F.lit(1)).alias("n")).filter("_suffix IS NOT NULL")
    sums = [F.coalesce(F.sum(F.when(F.col("text_lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
    table = written(seen.groupBy("_suffix").agg(*sums), "language-suffixes")
    # one row: pages by language, and the number of suffixes
    all_ = table.agg(F.count(F.lit(1)), *[F.sum(f"n{k}") for k in range(len(languages))]).first()
    logs = [F.log((F.col(f"n{k}") + 1.0) / F.lit(float((all_[k + 1] or 0) + all_[0]))) for k in range(len(languages))]
    joined = rows.withColumn("_suffix", suffix).join(table.select("_suffix", F.array(*logs).alias("_logs")), "_suffix", "left")
    return joined.withColumn("evidence", F.when(F.col("_logs").isNull(), F.col("evidence")).otherwise(F.zip_with("evidence", "_logs", lambda a, x: a + x))).drop("_suffix", "_logs")


def best(scores: Column, languages: list[str]) -> Column:
    """The language with the largest score, the first of equals."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def confusion(rows: DataFrame, said: str, languages: list[str]) -> dict[str, list[float]]:
    """log P(said | text's language) for each label, over all rows; labels outside the languages say nothing."""
    n = {(r["text_lang"], r[said]): r["n"] for r in rows.filter(F.col(said).isin(languages)).groupBy("text_lang", said).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {lang: sum(n.get((lang, s), 0) for s in languages) for lang in languages}
    return {s: [float(np.log((n.get((lang, s), 0) + 1.0) / (total[lang] + len(languages)))) for lang in languages] for s in languages}


def fused(rows: DataFrame, model: Trigrams, labels: list[str]) -> DataFrame:
    """rows with evidence, prior and labels -> lang and posterior."""
    languages = model.languages
    zero = F.array(*[F.lit(0.0)] * len(languages))
    score = F.zip_with("evidence", "prior", lambda e, p: e + F.log(p))
    for said in labels:
        table = confusion(rows, said, languages)
        by_label = F.create_map(*[x for s, v in table.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
        score = F.zip_with(score, F.coalesce(F.try_element_at(by_label, F.col(said)), zero), lambda a, b: a + b)
    out = rows.withColumn("_score", score)
    shifted = F.transform("_score", lambda x: F.exp(x - F.array_max("_score")))
    return out.withColumns({"lang": best(F.col("_score"), languages), "posterior": 1 / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)}).drop("_score")


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, address, text_lang, lang, posterior for every page."""
    rows = pages.select("page_id", F.col("html").alias("_html"), label(F.regexp_extract("url", _HOST, 1)).alias("host"), label(F.regexp_extract("html", _DECLARED, 1)).alias("declared"), label(F.regexp_extract("url", _ADDRESS, 1)).alias("address"))
    model = fitted(docs, rows)
    languages = model.languages
    if not languages:
        return rows.drop("_html").withColumns({"text_lang": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double")})
    seen = with_text_evidence(rows, model, "_html", html=True)
    seen = written(seen.withColumn("text_lang", best(F.col("evidence"), languages)), "language-evidence")
    seen = with_suffix_evidence(with_host_prior(seen, "host", "declared", languages), "host", languages)
    return fused(seen, model, ["declared", "address"]).drop("evidence", "prior")


def identified_rows(docs: DataFrame) -> DataFrame:
    """row (a struct of docs' columns), identified, posterior, has_letters: the source stands for the host, lang for the declared language."""
    model = fitted(docs)
    languages = model.languages
    letters = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False)).alias("has_letters")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("_body"), F.col("source").cast("string").alias("host"), label(F.col("lang")).alias("declared"))
    if not languages:
        return rows.select("row", F.lit(None).cast("string").alias("identified"), F.lit(None).cast("double").alias("posterior"), letters)
    seen = written(with_text_evidence(rows, model, "_body", html=False).withColumn("text_lang", best(F.col("evidence"), languages)), "language-evidence")
    found = fused(with_host_prior(seen, "host", "declared", languages), model, ["declared"])
    return found.select("row", F.col("lang").alias("identified"), "posterior", letters)


def identify_documents(docs: DataFrame) -> DataFrame:
    """docs, identified, posterior, has_letters; columns of docs with these names give way (identified_rows() keeps them)."""
    new = ["identified", "posterior", "has_letters"]
    return identified_rows(docs).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *new)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
