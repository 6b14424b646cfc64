"""Token-id files as ORC: run-length encoded integers, row indexes, Bloom filters on the document id.

Documents are range-partitioned and sorted by doc_id before they are encoded, so files ascend in doc_id,
a reader prunes files and stripes by the id's statistics, row groups by the row index, and point lookups
by the Bloom filter; stripes are read in parallel.  There are as many files as the table's rows ask for.

Nulls: a null text is empty and has its end id only; a null doc_id sorts first.  Repeated rows are kept; rows
that share a doc_id, null included, go by a hash of the text and may be in several files.  Very long texts
are encoded whole.  An empty table gives files without rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_texts, read_table, shared_dir, written
from .tokens import encoder, vocabulary

END_ID = 2
#: Rows of a file, where there are more than shuffle partitions of so many.
FILE_ROWS = 100_000
#: ORC writer settings: stripes small enough to be read in parallel, a row index entry every 1,000 rows.
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.rows.between.memory.checks": "100",
    "compression": "zstd",
}


def encoded(docs: DataFrame, end_id: int = END_ID, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids (array<int>, the end id last), a row for each row of docs, in the order of its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary(vocab)), np.uint32(end_id).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t.as_py() or b"") + end for t in part.column("text").cast(pa.binary())]
                stops = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(stops[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(stops), values)], ["doc_id", "ids"])

    return long_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, files: int | None = None, end_id: int = END_ID) -> None:
    """Writes every document's ids to ORC files under path, in ascending doc_id order."""
    spark = docs.sparkSession
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_ROWS))
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ordered = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    encoded(ordered, end_id).write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids; with doc_ids only those, found by statistics, row indexes and Bloom filters."""
    df = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in token files, as they are on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, stops = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(stops).astype("int64")), pa.array(crc, pa.int64())], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    # rows of a file in its order: one split after the other, each in the order it is read
    raw = read_token_files(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"), "doc_id", "ids")
    raw = raw.select("file", F.struct("block", "seen").alias("row"), "doc_id", "ids")
    # the files are read once: the sums of files and the rows both come from these few numbers a document
    slim = written(raw.mapInArrow(run, "file string, row struct<block:long,seen:long>, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = slim.groupBy("file").agg(F.sum("n_tokens").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "file")
    return out.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_orc_tokens(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-orc")
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return document_digests(spark, path)
