"""Separator scan: token counts of documents in flat token files that have no index.

A file is nothing but little-endian unsigned 16-bit ids, documents one after the other, each closed by an
end-of-document id.  Files are cut into blocks of equal size; each block is searched for the id with one
vector comparison, and what a document has in blocks before is added by a prefix scan over the blocks'
last separators, in two levels (blocks of a file, then files).

Ids behind a file's last separator make a document of their own (closed = false); an empty file has no
documents.  Nulls: a null text writes an end id only.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_texts, read_table, shared_dir
from .tokens import encoder, vocabulary

#: Ids 0 to 2 are kept for control: the vocabulary's ids are written RESERVED higher, so no text contains the end id.
RESERVED = 3
END_ID = 2
#: Bytes of a block; even, so that no id is split.
BLOCK_BYTES = 1 << 20


def write_flat_files(docs: DataFrame, path: str, end_id: int = END_ID, vocab: str = "word_bpe_49k.json") -> None:
    """One flat file per partition of docs, in its order, through Spark's text writer.

    The writer puts its line separator behind each row; the end id's two bytes are that separator, and
    a row is the bytes of a document's ids.
    """
    if not 0 <= end_id < RESERVED:
        raise ValueError("the end id has to be one of the reserved ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary(vocab))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [(np.frombuffer(encode(t.as_py() or b""), "<u4") + RESERVED).astype("<u2").tobytes() for t in batch.column("text").slice(at, 256).cast(pa.binary())]
                stops = np.cumsum([0] + [len(x) for x in rows], dtype=np.int32)
                # string by name only: these bytes are ids, and the writer copies them as they are
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(b"".join(rows))])], ["value"])

    body = long_texts(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "value string")
    body.write.option("lineSep", chr(end_id) + "\0").text(path)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, bytes of every flat file in the folder path, whatever its name; Spark skips those that begin with _ or . only."""
    whole = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")
    cut = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / block_bytes).cast("int"))))
    return cut.select("file", "block", F.substring("content", F.col("block") * block_bytes + 1, F.lit(block_bytes)).alias("bytes"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per block: file, block, n (ids), and ends, the ascending places of separators in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("bytes")]
            ends = [np.flatnonzero(x == end_id).astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file", "block", "n", "ends"])

    return blocks.mapInArrow(run, "file string, block int, n long, ends array<int>")


def documents_of(scanned: DataFrame) -> DataFrame:
    """file, ordinal (from 0 in its file), start, n_tokens (the end id included), closed."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file")
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    blocks = scanned.withColumn("base", base)
    blocks = blocks.withColumn("last_end", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
    blocks = blocks.withColumns({"open_from": F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)), "docs_before": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "final": F.col("block") == F.max("block").over(last)})
    stops = F.transform("ends", lambda e: e.cast("long") + F.col("base") + 1)
    rest = F.coalesce(F.greatest(F.element_at(stops, -1), F.col("open_from")), F.col("open_from"))
    tail = F.when(F.col("final") & (F.col("base") + F.col("n") > F.when(F.size("ends") > 0, rest).otherwise(F.col("open_from"))), F.array(F.col("base") + F.col("n"))).otherwise(F.array().cast("array<long>"))
    blocks = blocks.select("file", "docs_before", "open_from", F.size("ends").alias("closed_here"), F.concat(stops, tail).alias("stops"))
    blocks = blocks.withColumn("starts", F.concat(F.array("open_from"), F.col("stops")))
    docs = blocks.select("file", "docs_before", "closed_here", "starts", F.posexplode("stops").alias("k", "stop"))
    start = F.element_at("starts", F.col("k") + 1)
    return docs.select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("closed_here")).alias("closed"))


def token_counts(spark: SparkSession, path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return documents_of(scan_blocks(read_blocks(spark, path, block_bytes), end_id))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file_no, start: counts found in flat files of all documents, by their place in the files."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    path = shared_dir(spark, "token-flat")
    write_flat_files(docs, path)
    found = token_counts(spark, path).withColumn("file_no", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    # the writer's task k makes file k, in the order in which the scan's partition k has its rows
    place = F.monotonically_increasing_id()
    written = docs.select("doc_id", F.length("text").alias("n_chars"), F.shiftright(place, 33).alias("file_no"), place.bitwiseAND((1 << 33) - 1).alias("ordinal"))
    return written.join(found, ["file_no", "ordinal"]).select("doc_id", "n_tokens", "file_no", "start", "closed")
