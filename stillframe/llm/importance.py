"""Importance resampling of documents towards the word runs of a target corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.llm.common import checkpoint, shuffle_parts, text_or_empty
from stillframe.llm.vectors import merge, partition_vectors

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 2
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Features that are gathered before they are counted.
BLOCK = 1 << 18

#: Bytes of words as they are, A-Z in lower case, all others a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_codes(data: bytes, run: int = RUN, piece: int = PIECE) -> Iterator[np.ndarray]:
    """crc32 of every run of 1 to ``run`` consecutive words of a text, repeats included.

    A run's code goes on from the code of the run without its last word, so no run is
    ever spelled out.  Long texts are taken in pieces that end between words; the codes of
    the runs that end a piece are kept for the next one.
    """
    at, last = 0, [None] * run
    while at < len(data):
        end = at + piece
        part = data[at:end].translate(_WORDS)
        while end < len(data) and not part.endswith(b" "):  # on to the next blank
            more = data[end : end + 4096].translate(_WORDS)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        at = end
        words = part.split()
        if not words:
            continue
        level = list(map(crc32, words))
        spaced = [b" " + w for w in words] if run > 1 else []
        for j in range(run):
            if j:
                level = list(map(crc32, spaced[len(spaced) - len(before) :], before))
            yield np.array(level, dtype=np.int64)
            before = [*([] if last[j] is None else [last[j]]), *level[:-1]]
            last[j] = level[-1] if level else None


def _blocks(texts: pa.Array, buckets: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features of a column of texts, ``BLOCK`` or a little more at a time."""
    rows, codes, held = [], [], 0
    for i in range(len(texts)):
        for some in feature_codes(texts[i].as_py(), run):
            rows.append((i, len(some)))
            codes.append(some)
            held += len(some)
            if held >= BLOCK:
                yield np.repeat(*np.array(rows).T), np.concatenate(codes) % buckets
                rows, codes, held = [], [], 0
    if held:
        yield np.repeat(*np.array(rows).T), np.concatenate(codes) % buckets


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features of all texts by bucket: a vector a partition by ``np.bincount``, merged in a tree."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, at in _blocks(batch.column(0), buckets, run):
            total += np.bincount(at, minlength=buckets)

    texts = df.select(text_or_empty(F.col(f"`{text}`")).cast("binary"))
    return merge(partition_vectors(texts, add, buckets), buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the log odds of target to source, each count one larger,
    rounded down."""
    s, t, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(df: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text", run: int = RUN) -> DataFrame:
    """``keep`` columns of ``df``, n_features and weight: the mean gain of a document's
    features, rounded down (no features: 0).  Map-only; the gains are broadcast."""
    shared, buckets = df.sparkSession.sparkContext.broadcast(gain), len(gain)
    plain = df.select(*(F.col(f"`{c}`") for c in keep), text_or_empty(F.col(f"`{text}`")).cast("binary").alias("_text"))
    schema = plain.drop("_text").schema.add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.astype(float)  # whole numbers, so sums are exact
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for rows, at in _blocks(texts, buckets, run):
                n += np.bincount(rows, minlength=len(n))
                total += np.bincount(rows, weights=values[at], minlength=len(n))
            mean = total.astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n), pa.array(mean)], names=[*keep, "n_features", "weight"])

    return plain.mapInArrow(weigh, schema)


def perturbed(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight and a Gumbel variate (times 1000, rounded down) that is a function of the seed
    and the id; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Adds ``rank`` (1, 2, 3...) in the given order, null after ``most``.

    Rows are dealt out by ranges of the order and sorted there; a row's rank is its place in
    its range behind the rows of the ranges before.  The order ends with a row's number, so
    any number of equal rows is split too.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    placed = checkpoint(numbered.repartitionByRange(shuffle_parts(df.sparkSession), *order, F.col("_row")).sortWithinPartitions(*order, "_row")).drop("_row")
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    before, start = 0, {}
    for r in sizes:
        start[r["part"]] = before
        before += r["n"]
    starts = np.array([start.get(i, 0) for i in range(1 + max(start, default=0))], dtype=np.int64)
    rank = F.get(F.lit(starts), part.cast("int")) + place + 1
    return placed.withColumn("rank", F.when(rank <= most, rank)).drop("_at")


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """Draws documents without replacement so that their features follow the target's.

    Texts are lower-cased (A-Z) and cut into words of digits, a-z and all beyond ASCII;
    features are runs of 1 to ``run`` words, hashed into ``buckets`` by crc32.  One pass counts them
    over both corpora, a second gathers each document's gains.  Of the documents with at
    least ``least_words`` words the ``percent`` with the highest scores (weight and Gumbel
    variate) are drawn, ties to the smaller id.

    Returns every row of ``df``: ``keep`` columns (the id by default), n_features, weight, score and
    rank (null: not drawn).  Null texts have no words, weight 0 and are not drawn while
    ``least_words`` is above 0; rows without an id share one variate and come after others of
    their score; rows that share an id are documents of their own, in an order given by
    weight and length.  Empty tables give zeros, and no rows.
    """
    keep = [doc_id] if keep is None else keep
    gain = gains(bucket_counts(df, text, buckets, run), bucket_counts(target, target_text, buckets, run))
    cols = [*keep, *([] if doc_id in keep else [doc_id])]
    rows = weighed(df, gain, cols, text, run)
    rows = checkpoint(rows.withColumn("score", perturbed(F.col("weight"), F.col(f"`{doc_id}`"), seed)))
    # n words have n runs of one, n - 1 of two and so on
    enough = F.col("n_features") >= sum(max(0, least_words - j) for j in range(run))
    most = percent * rows.where(enough).count() // 100
    drawn = ranked(rows.where(enough), [F.col("score").desc(), F.col(f"`{doc_id}`").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], most)
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*(F.col(f"`{c}`") for c in keep), "n_features", "weight", "score", "rank")
