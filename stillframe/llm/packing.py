"""Packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillframe.llm import tokens
from stillframe.llm.common import checkpoint, shuffle_parts, text_or_empty

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(df: DataFrame, path: str, room: int, end_id: int, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every document (null text: empty), appends ``end_id`` and cuts the ids
    every ``room``; one row per piece.  Map-only."""
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, {PIECES}" + (", ids binary" if with_ids else "")
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(types) + 1]
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            ids_of, column = batch.column(0), batch.column(1)
            for first, texts in tokens.by_bytes(column):
                rows: list[tuple] = []
                for i, text_ in enumerate(texts):
                    data = enc.encode(text_) + end
                    total = len(data) >> 2
                    for s in range(0, total, room):
                        part = data[4 * s : 4 * (s + room)]
                        row = (first + i, s, len(part) >> 2, zlib.crc32(part), total)
                        rows.append((*row, part) if with_ids else row)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types))], names=names
                )

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text")).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (number of packs, lengths) for a histogram {length: count}.

    Lengths are placed longest first, all pieces of a length at once.  Each goes
    to the open packs with the most room left (the shortest packs); packs of one
    pattern are split when only a part of them takes a piece.  The work depends
    on the number of lengths and patterns, not of pieces.
    """
    if any(not 0 < n <= room for n in histogram):
        raise ValueError("lengths must lie between 1 and the room")
    open_by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(room + 1)]
    top = 0
    done: list[tuple[int, tuple]] = []

    def put(count: int, pattern: tuple, left: int) -> None:
        nonlocal top
        if left:
            open_by_room[left].append((count, pattern))
            top = max(top, left)
        else:
            done.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        made: list[tuple[int, tuple, int]] = []
        while todo:
            while top and not open_by_room[top]:
                top -= 1
            if top < length:
                each = room // length
                full, rest = divmod(todo, each)
                if full:
                    made.append((full, (None, length, each), room - each * length))
                if rest:
                    made.append((1, (None, length, rest), room - rest * length))
                break
            count, pattern = open_by_room[top].pop()
            fits = min(top // length, -(-todo // count))
            used = min(count, todo // fits) if fits > 1 else min(count, todo)
            made.append((used, (pattern, length, fits), top - fits * length))
            todo -= used * fits
            if used < count:
                open_by_room[top].append((count - used, pattern))
        for x in made:
            put(*x)
    left = [(c, p) for packs in open_by_room for c, p in packs]
    out = []
    for count, pattern in done + left:
        lengths: list[int] = []
        while pattern is not None:
            pattern, length, times = pattern
            lengths += [length] * times
        out.append((count, lengths[::-1]))
    return out


def pattern_slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, end_rank, first_sequence, offset): the pieces of a length
    whose ranks lie in [first_rank, end_rank) go to successive sequences at that offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, first + count, sequence, offset))
            used[n] = first + count
            offset += n
        sequence += count
    return rows


def ranked(pieces: DataFrame, by: str, order: list[str], salts: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each value of ``by``, without gathering a value's
    rows in one task.  Rows are ranked within (value, salt); a table of the counts of
    those (values x salts rows, however many pieces there are) shifts each by the
    ones before."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    within = Window.partitionBy(by, "_salt").orderBy(*order)
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
        .select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(shift, [by, "_salt"])
        .withColumn("rank", F.col("rank") + F.col("_before"))
        .drop("_salt", "_before")
    )


#: Slot rows up to this number are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_SLOTS = 200_000


def pack(df: DataFrame, path: str, room: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``room`` ids.

    Every document (null text: an empty one, which has the end id alone) is cut
    only each ``room`` ids, so a document of up to ``room`` ids stays whole, as
    does the rest of a longer one.  Lengths are packed shortest-pack-first; then
    patterns meet documents by (length, rank).  Returns one row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset.  Rows with equal
    or null ids and repeated rows are separate documents.  An empty table gives
    an empty table; other columns are left out.

    Pieces are encoded once and checkpointed as numbers (no text); the histogram
    has at most ``room`` rows, so the packing itself runs on the driver.
    """
    spark = df.sparkSession
    pieces = checkpoint(cut_pieces(df, path, room, end_id, doc_id, text))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = pattern_slots(shortest_pack_first(histogram, room))
    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "first_rank", "end_rank", "first_sequence", "offset")])
    slots = spark.createDataFrame(rows, schema)
    if len(rows) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    salts = max(64, 4 * shuffle_parts(spark))
    placed = ranked(pieces, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], salts)
    return (
        placed.join(slots, "length")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
            "offset",
        )
    )
