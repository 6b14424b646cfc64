"""Records as tokens within a model's context, by any tokenizer that takes a list of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..errors import DataError, ParameterError

Tokenizer = Callable[[list[str]], list[list[int]]]
#: Special tokens around the prompt and around the records.
SPECIAL = 2


def words_as_tokens(texts: list[str]) -> list[list[int]]:
    """A tokenizer without a vocabulary: each word between blanks is a token, its id from its bytes."""
    import zlib

    return [[zlib.crc32(w.encode()) & 0x7FFFFFFF for w in t.split()] for t in texts]


def budget_of(context: int, prompt_tokens: int, special: int = SPECIAL) -> int:
    """Tokens that a record may have: the context without the prompt and the special tokens around both."""
    if prompt_tokens > context:
        raise ParameterError(f"the prompt has {prompt_tokens} tokens, the context only {context}; fewer columns or a longer context are needed")
    return context - prompt_tokens - 2 * special


def tokenized(df: DataFrame, text: str, tokenizer: Tokenizer = words_as_tokens, ids: str = "input_ids") -> DataFrame:
    """df with the ids of a text column; none for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokenizer([t or "" for t in batch.column(text).to_pylist()])
            stops = np.cumsum([0] + [len(x) for x in found])
            flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in found]) if found else np.zeros(0, np.int32)
            yield batch.append_column(ids, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32())))

    return df.mapInArrow(run, StructType(list(df.schema)).add(ids, ArrayType(IntegerType())))


def within_budget(df: DataFrame, ids: str, context: int, prompt_tokens: int, on_long: str = "error", special: int = SPECIAL) -> DataFrame:
    """df with n_tokens and fits.  Records above the budget are an error, cut at their end ('cut'), or only told ('mark').

    The error counts them in one pass; what is returned is not computed before.
    """
    most = budget_of(context, prompt_tokens, special)
    size = F.coalesce(F.size(ids), F.lit(0))
    if on_long not in ("error", "cut", "mark"):
        raise ParameterError("on_long is error, cut or mark")
    if on_long == "error":
        n, largest = df.agg(F.count_if(size > most), F.max(size)).first()
        if n:
            raise DataError(f"{n} records have more than {most} tokens, the longest {largest}")
    kept = F.slice(ids, 1, max(most, 0)) if on_long == "cut" else F.col(ids)
    return df.withColumns({ids: kept, "fits": size <= most}).withColumn("n_tokens", F.coalesce(F.size(ids), F.lit(0)))


def token_statistics(df: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """n, mean, sd, low, high of tokens a record."""
    c = F.col(n_tokens)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"))
