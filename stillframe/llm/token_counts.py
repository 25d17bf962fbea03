"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillframe.llm import tokens
from stillframe.llm.common import text_or_empty

#: UTF-8 bytes of text that one encoding batch holds.
BATCH_TEXT_BYTES = 4 << 20


def token_count(path: str, text: str | Column = "text") -> Column:
    """Number of tokens of a text column under the tokenizer file at ``path``.

    An Arrow function: it gets record batches, cuts them again into batches of
    about equal bytes (one very long text is a batch of its own), cuts texts at
    boundaries no token crosses, and gives back lengths only.  A null or empty
    text has 0 tokens.  Nothing is truncated or padded; no special tokens are
    added; special strings within texts count as the library's default says.
    """

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = tokens.encoder(path)
        for column in batches:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            out = [enc.lengths(texts) for _, texts in tokens.by_bytes(column, BATCH_TEXT_BYTES)]
            yield pa.array(np.concatenate(out) if out else [], pa.int64())

    return count(text_or_empty(text))


def with_token_counts(df: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit to ``df``, one row per row.

    Columns of these names that ``df`` already has are replaced.  A null text has no bytes and no
    tokens; repeated rows are counted each; an empty table gives an empty one.  A map-only
    plan: no shuffle, one pass over the text.
    """
    text = F.col(f"`{text}`")
    return df.withColumns({"n_bytes": F.octet_length(text_or_empty(text)).cast("long"), "n_tokens": token_count(path, text)}).withColumn("over_limit", F.col("n_tokens") > limit)
