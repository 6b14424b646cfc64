"""Corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage takes the columns of ``documents`` and works on all its predecessor kept; all but the last
return the same columns.  Extra columns go along whatever their names.  Null, empty and very long texts and
repeated rows are what each stage's operator says they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, ngram_join, packing, toxicity
from tessera.llm.common import read_table, unused, written
from tessera.llm.labelled import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from labels of the whole table."""
    model = toxicity.fitted(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out(3, 1))
    score = unused(docs, "toxic_score")
    return toxicity.scored(docs, model, score=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language has most of the posterior; lang becomes what was identified.

    Where no document has a language, nothing can be identified: the posterior is null, and all documents with
    letters are kept with their null lang.
    """
    sure = F.coalesce(F.col("posterior") >= language.LEAST_POSTERIOR, F.lit(True))
    found = language.identified_rows(docs).filter(F.col("has_letters") & sure)
    return found.select(*[F.col("identified").alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the one with the smallest id, then the smallest hash; ids come before null.

    Rows that share a doc_id are rows of their own, and stay where their texts are not alike.  Texts without
    words are alike to nothing; of rows with the same id and text the one stays whose other columns are first as JSON.
    """
    rows = ngram_join.grouped(docs)
    alone = rows.filter("component IS NULL").select("doc_id", "key")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least")
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(least).select("least.doc_id", "least.key").unionByName(alone)
    first = first.distinct().select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"))
    # other columns travel inside one struct, so none of their names can clash
    named = docs.select(F.struct(*docs.columns).alias("row"), ngram_join.row_key(docs).alias("key"), F.col("doc_id").alias("id"))
    kept = named.join(first, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_doc_id")), "left_semi")
    others = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.array(*[o.cast("string") for o in others])) if others else F.lit(0)
    return kept.groupBy("key", "id").agg(F.min_by("row", order).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
