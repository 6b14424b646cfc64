"""Sum-of-squares packing of token pieces into sequences of a fixed length.

A piece goes where the sum over gaps of (open bins with that gap) squared becomes smallest; only the
numbers of open bins by gap matter, so one placement is a vector operation over the gaps.  Pieces are
dealt over shards of bounded size by hash, and each shard is packed by itself, longest piece first; a
shard of SHARD_ITEMS pieces leaves about six sequences more than their lengths need.

Nulls: a null text is empty and still yields its end id; a null doc_id is kept.  Repeated rows are
packed as often as they stand.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_texts, read_table, written
from .tokens import encoder, vocabulary

CAPACITY = 2048
END_ID = 0
#: Words that a worker remembers here, and as many from before: the pipeline's stages before have left less room than op4 has.
PACKING_WORDS = 200_000
#: Items that one task packs at a time.
SHARD_ITEMS = 16384


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids (the end id included), cut every capacity ids; with_ids adds the ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, piece_no long" + ", ids array<int>" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "piece_no"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary(vocab), PACKING_WORDS), np.uint32(end_id).tobytes()
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                ids = encode(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    found = (doc_id, k, at // 4, len(body) // 4, zlib.crc32(body), no) + (np.frombuffer(body, "<i4"),) * with_ids
                    no += 1
                    for column, x in zip(rows, found):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)

    return long_texts(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, in the order given; every length is from 1 to capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; 0 (full) and capacity (new) stay 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g] + 1); a new bin
        # adds 2 count[capacity - s] + 1, a bin that becomes full takes away 2 count[g] - 1
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        change[0] -= 1
        change[count[s:] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = int(np.argmin(change)) + s
        if g == capacity:
            at, made = made, made + 1
        else:
            at = open_bins[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = at, capacity - g
        if s < g:
            open_bins[g - s].append(at)
            count[g - s] += 1
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items (with piece_no, unique, and length) with sequence_id and offset; piece_no of its first piece names a sequence.

    Items that fill a sequence by themselves are not dealt to shards.
    """
    n = items.filter(F.col("length") < capacity).count()
    shards = max(1, round(n / shard_items))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece_no"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        first = pdf["piece_no"].to_numpy()[np.unique(bins, return_index=True)[1]]
        return pdf.drop(columns="shard").assign(sequence_id=first[bins], offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    whole = items.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("piece_no"), "offset": F.lit(0).cast("long")})
    parts = items.filter(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("piece_no"), F.lit(shards)).cast("int"))
    return whole.unionByName(parts.groupBy("shard").applyInPandas(place, schema))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(written(tokenised_pieces(docs, capacity, end_id), "pieces"), capacity).drop("piece_no")


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, input_ids (at most capacity), doc_ids and offsets of its pieces."""
    placed = pack(written(tokenised_pieces(docs, capacity, end_id, with_ids=True), "pieces"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
