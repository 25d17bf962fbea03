"""How filters interact: what each removes alone, behind others, and on average over all orders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillframe.llm.common import checkpoint, key_sketch, maybe_in, text_or_empty

#: The filters; a document's mask has bit i if it fails the i-th.
FILTERS = "ABCDE"
DUPLICATE = 1 << 4

#: Bytes of the first block of a text; each further one is 16 times as long.
BLOCK = 256
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_UPPER, _SYMBOLS, _BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", b" \t\n\x0b\x0c\r"


def word_counts(data: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and distinct words; long texts are taken in pieces that end behind a blank."""
    if len(data) <= piece:
        words = data.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(data):
        end = at + piece
        while end < len(data) and data[end - 1] not in _BLANKS:
            end += 1
        words = data[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def mask_of(data: bytes, n_chars: int) -> int:
    """Bits of the filters that look at one text: few words, few distinct words, many capitals,
    symbols."""
    n, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * n_chars) << 2 | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3


def block_hashes(data: bytes) -> list[int]:
    """Signed 64-bit hashes of a text's successive blocks, which cover all of it."""
    out, at, size = [], 0, BLOCK
    while at < len(data):
        out.append(xxhash.xxh64_intdigest(data[at : at + size]))
        at, size = at + size, 16 * size
    return [h - (1 << 64) if h >> 63 else h for h in out]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.lit("audit"), text)


def with_masks(rows: DataFrame) -> DataFrame:
    """Adds ``mask`` (without duplicates) and ``blocks`` to rows with ``_text`` and ``n_chars``, in
    place of the text.  Map-only."""
    keep = [c for c in rows.columns if c != "_text"]
    plain = rows.select(*keep, F.col("_text").cast("binary").alias("_text"))
    schema = plain.drop("_text").schema.add("mask", "integer").add("blocks", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = batch.column(batch.num_columns - 1), batch.column(keep.index("n_chars"))
            masks, blocks = [], []
            for i in range(len(texts)):
                data = texts[i].as_py()
                masks.append(mask_of(data, chars[i].as_py()))
                blocks.append(block_hashes(data))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(masks, pa.int32()), pa.array(blocks, pa.list_(pa.int64()))], names=[*keep, "mask", "blocks"])

    return plain.mapInArrow(run, schema)


def refine(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(alone, shared): rows (_row, n_chars, blocks, ...) that differ from all others, and rows that
    agree with another in length and all block hashes, in the parts that the rounds leave.

    Rows are split by length, then by one more block a round.  Rows that are alone go at once, rows
    without a further block are done.  A group is only counted, which its tasks do before the
    shuffle; rows meet their verdict by row number, so a group of any size is spread.
    """
    alone, shared, depth = [], [], 0
    while True:
        group = rows.groupBy("n_chars", F.slice("blocks", 1, depth).alias("_p")) if depth else rows.groupBy("n_chars")
        single = group.agg(F.count("*").alias("_n"), F.min("_row").alias("_row")).where("_n = 1").select("_row", F.lit(True).alias("_alone"))
        marked = checkpoint(rows.join(single, "_row", "left"))
        alone.append(marked.where("_alone").drop("_alone"))
        rest = marked.where("_alone is null").drop("_alone")
        shared.append(rest.where(F.size("blocks") <= depth))
        rows = rest.where(F.size("blocks") > depth)
        depth += 1
        if rows.isEmpty():
            return alone, shared


def filter_masks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", key=text_key) -> DataFrame:
    """(doc_id, part, mask) of every row of ``df``: which filters its whole text fails.

    A: under 50 words.  B: less than 65 distinct words in 100.  C: more than 5 capitals (A-Z) in 100
    code points.  D: holds a symbol.  E: its text is identical to that of a smaller id.

    Duplicates are found by partition refinement of narrow rows.  Texts that survive it are
    read again and grouped whole, which compares them; copies meet before the shuffle.
    A row fails E unless it holds the least id of its text: rows are looked up by
    text and id together, so a text that a third of all rows share is no hot key.

    Null texts are empty, null parts the empty string.  Rows without an id are no one's smaller
    document and never fail E; rows that repeat an id and a text don't fail by each other.
    An empty table gives an empty one.
    """
    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).cast("string").alias("part"), text_or_empty(F.col(f"`{text}`")).alias("_text"))
    plain = plain.withColumns({"n_chars": F.length("_text").cast("long"), "_h": key(F.col("_text"))})
    rows = checkpoint(with_masks(plain).withColumn("_row", F.monotonically_increasing_id()))
    alone, shared = refine(rows)
    same = shared[0]
    for more in shared[1:]:
        same = same.unionByName(more)
    again = maybe_in(plain, F.col("_h"), key_sketch(same.select("_h"), F.col("_h")))
    # grouping by the text is the comparison
    texts = again.groupBy("n_chars", "_h", F.col("_text").alias("_t")).agg(F.min("doc_id").alias("_first"))
    texts = checkpoint(texts.select("n_chars", "_h", "_first", F.sha2("_t", 256).alias("_sha")))
    keys = texts.groupBy("n_chars", "_h").agg(F.count("*").alias("_texts"), F.min("_first").alias("_first"))
    clash = checkpoint(keys.where("_texts > 1").select("n_chars", "_h"))
    least = keys.where("_texts = 1").select("n_chars", "_h", F.col("_first").alias("doc_id"), F.lit(True).alias("_least"))
    if not clash.isEmpty():  # different texts of one hash: such rows are read once more, with a digest of their own
        unclear = clash.withColumn("_clash", F.lit(True))
        same = same.join(unclear, ["n_chars", "_h"], "left").where("_clash is null").drop("_clash")
        found = plain.join(clash, ["n_chars", "_h"], "left_semi").withColumn("_sha", F.sha2("_text", 256))
        found = with_masks(found).join(
            texts.select("n_chars", "_h", "_sha", F.col("_first").alias("doc_id"), F.lit(True).alias("_least")), ["n_chars", "_h", "_sha", "doc_id"], "left"
        )
    met = same.join(least, ["n_chars", "_h", "doc_id"], "left")
    if not clash.isEmpty():
        # rows of a clash that refinement found to be alone are judged here, where they are the least of their text
        met = met.unionByName(found.select("doc_id", "part", "mask", "_least"), allowMissingColumns=True)
        alone = [x.join(clash, ["n_chars", "_h"], "left_anti") for x in alone]
    fails = F.col("doc_id").isNotNull() & F.col("_least").isNull()
    out = met.select("doc_id", "part", (F.col("mask") + F.when(fails, DUPLICATE).otherwise(0)).alias("mask"))
    for x in alone:
        out = out.unionByName(x.select("doc_id", "part", "mask"))
    return out


def effects(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of every order of the filters, and for each count a matrix that takes the
    documents by mask to it."""
    masks, steps, out = np.arange(1 << len(names)), [], {}
    for order in map("".join, permutations(names)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            fails, passed = masks & bit != 0, masks & before == 0
            steps.append((order, step))
            alone = {"kept": passed & ~fails, "removed": passed & fails, "redundant": ~passed & fails, "unique_fails": masks == bit}
            for k, v in alone.items():
                out.setdefault(k, []).append(v)
            before |= bit
    matrices = {k: np.array(v, dtype=np.int64) for k, v in out.items()}
    # what a filter removes, summed over all orders
    total = {name: sum(row for row, (order, step) in zip(matrices["removed"], steps) if order[step - 1] == name) for name in names}
    matrices["shapley"] = np.array([total[order[step - 1]] for order, step in steps])
    return steps, matrices


def report(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """The audit's rows from (part, mask, n, good, toxic), one row a part and mask: at most
    2^filters a part."""
    schema = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost', 'shapley'))}"
    wide = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, m = effects(names)
        orders, step = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())
        for batch in batches:
            for part, found in zip(batch.column(0), batch.column(1)):
                n, good, toxic = np.zeros((3, 1 << len(names)), dtype=np.int64)
                for r in found.as_py():
                    n[r["mask"]], good[r["mask"]], toxic[r["mask"]] = r["n"], r["good"], r["toxic"]
                values = [m["kept"] @ n, m["removed"] @ n, m["redundant"] @ n, m["unique_fails"] @ n, m["removed"] @ good, m["removed"] @ toxic, m["shapley"] @ n]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(steps), pa.string()), orders, step, *map(pa.array, values)], names=[c.split()[0] for c in schema.split(", ")])

    return wide.mapInArrow(run, schema)


def audit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For every part, order of the five filters and step: documents kept, removed, redundant, failing
    this filter only, good and toxic ones removed, and removals over all orders.

    ``labels`` (doc_id, quality, toxic) may lack documents or repeat ids: a document is good or
    toxic if any label of its id says 1.  Rows without an id have no label.  An empty table
    gives no rows.
    """
    masks = filter_masks(df, doc_id, text, part)
    # counted by id first: no id has more rows than parts times masks
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    counts = rows.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    return report(counts)
