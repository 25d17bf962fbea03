"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at 3 or fewer differing bits.  Then one half of
32 bits differs in at most one bit (t = 1).  In a half, the anchors are the words of
a covering code: a perfect Hamming code on 31 bits, times the free last bit, so every
half lies within R = 1 of an anchor.  A fingerprint's home is that anchor; it is also
sent to every anchor within R + t = 2 of it (17 at most).  Up to 7 bits are covered in
the same way by quarters of 16 bits (9 anchors each).  Of a linked pair, each one
so reaches the other's home, and fingerprints are compared per anchor only.

Copies are merged before the search: it works on distinct fingerprints.  Within an
anchor no pairs are emitted, only a spanning forest of the links found there, which
has fewer edges than the anchor has fingerprints and the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillframe.llm.common import checkpoint, row_key, shuffle_parts, text_or_empty

#: Homes of one anchor beyond which its comparison is split into a grid of tasks.
HEAVY = 16_384
#: Replicated rows that one task groups at a time.
ROWS_PER_TASK = 1_000_000


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have (unsigned)."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included (unsigned)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - 1])]
        shingles = map(joined.__getitem__, map(slice, starts, ends[width - 1 :]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    return majority(hashes)


def with_fingerprints(df: DataFrame, columns: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """``columns`` of ``df`` and ``_fp`` (the fingerprint as a signed long)."""
    plain = df.select(*columns, text_or_empty(text).alias("_text"))
    schema = plain.drop("_text").schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(len(texts))), dtype="<u8", count=len(texts))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*columns, "_fp"])

    return plain.mapInArrow(run, schema)


@cache
def _code(width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The covering code on blocks of ``width`` bits (a power of two): a Hamming code on all
    but the last bit.  Gives, for each byte of a block, the xor of the positions of its
    set bits; and, for each syndrome s, the patterns of at most two bits that have it
    (zeros repeat for s = 0)."""
    tables = [
        np.array([np.bitwise_xor.reduce([8 * k + b + 1 for b in range(8) if v >> b & 1 and 8 * k + b < width - 1] or [0]) for v in range(256)], dtype=np.uint32)
        for k in range(width // 8)
    ]
    masks = np.zeros((width, width // 2), dtype=np.uint32)
    for s in range(1, width):
        pairs = [(i, i ^ s) for i in range(1, width) if i < i ^ s]
        masks[s] = [1 << (s - 1), *(1 << (i - 1) | 1 << (j - 1) for i, j in pairs)]
    return tables, masks


def anchors(fps: np.ndarray, homes_only: bool = False, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, is home, row of ``fps``) of unsigned fingerprints, for every block."""
    keys, home, who = [], [], []
    width = 64 // blocks
    tables, masks = _code(width)
    rows = np.arange(len(fps))
    for block in range(blocks):
        v = ((fps >> np.uint64(width * block)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        s = np.zeros(len(v), dtype=np.uint32)
        for k, table in enumerate(tables):
            s ^= table[(v >> np.uint32(8 * k)) & np.uint32(255)]
        own = v ^ masks[s, 0]
        tag = np.int64(block) << np.int64(32)
        keys.append(own.astype(np.int64) | tag)
        home.append(np.ones(len(v), dtype=bool))
        who.append(rows)
        if homes_only:
            continue
        off = np.flatnonzero(s)
        near = v[off, None] ^ masks[s[off], 1:]
        keys += [near.ravel().astype(np.int64) | tag, (own ^ np.uint32(1 << (width - 1))).astype(np.int64) | tag]
        home += [np.zeros(near.size, dtype=bool), np.zeros(len(v), dtype=bool)]
        who += [np.repeat(rows[off], near.shape[1]), rows]
    return np.concatenate(keys), np.concatenate(home), np.concatenate(who)


def _anchor_rows(nodes: DataFrame, homes_only: bool, blocks: int) -> DataFrame:
    """nodes: _fp, and for verified links node and sketch."""
    more = [c for c in ("node", "sketch") if c in nodes.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                part = batch.slice(at, 20_000)
                key, home, who = anchors(fps[at : at + 20_000], homes_only, blocks)
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), *(part.column(i).take(take) for i in range(part.num_columns))], names=["anchor", "home", "_fp", *more])

    schema = "anchor long, home boolean, _fp long" + "".join({"node": ", node long", "sketch": ", sketch binary"}[c] for c in more)
    return nodes.select("_fp", *more).mapInArrow(run, schema)


Test = Callable[[int, np.ndarray], np.ndarray]


def forest(n: int, test: Test) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among rows 0 .. n - 1 as (row, rows found from it).

    ``test(i, rest)`` says which of the rows ``rest`` link to row i.  A breadth-first walk
    compares each reached row with the ones not reached yet, so in a dense group the set
    that remains shrinks at once.
    """
    rest, frontier = np.arange(1, n), [0]
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        u = frontier.pop()
        near = test(u, rest)
        if near.any():
            found = rest[near]
            yield u, found
            rest = rest[~near]
            frontier.extend(found.tolist())


def compare(key: np.ndarray, home: np.ndarray, fps: np.ndarray, most: int, node: np.ndarray | None = None, sketch: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges within each key that has a home and more than one row; edges are of
    fingerprints, or of ``node`` where that is given, with sketches at least ``least`` alike."""
    ident = fps if node is None else node
    order = np.lexsort((ident, key))
    key, home, fps, ident = key[order], home[order], fps[order], ident[order]
    sketch = None if sketch is None else sketch[order]
    left, right = [np.zeros(0, dtype=ident.dtype)], [np.zeros(0, dtype=ident.dtype)]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=int)
    last = np.r_[first[1:], len(key)]
    if len(first):
        use = (np.add.reduceat(home.astype(np.int64), first) > 0) & (last - first > 1)
        first, last = first[use], last[use]
    for i, j in zip(first, last):
        rows = i + np.flatnonzero(np.r_[True, ident[i + 1 : j] != ident[i : j - 1]])
        if len(rows) < 2:
            continue
        f = fps[rows]
        if sketch is None and len(f) <= 4096:
            homes = np.unique(np.searchsorted(f, fps[i:j][home[i:j]])) if node is None else np.arange(len(f))
            near = np.bitwise_count(f[homes, None] ^ f[None, :]) <= most
            n_links = int(near.sum()) - len(homes)
            if not n_links:
                continue
            if n_links <= 4 * len(f):
                a, b = np.nonzero(near)
                a = homes[a]
                left.append(ident[rows[a[a != b]]])
                right.append(ident[rows[b[a != b]]])
                continue
        sk = None if sketch is None else sketch[rows]

        def test(u: int, rest: np.ndarray, f=f, sk=sk) -> np.ndarray:
            near = np.bitwise_count(f[rest] ^ f[u]) <= most
            if sk is not None and near.any():
                near[near] = (sk[rest[near]] == sk[u]).mean(axis=1) >= least
            return near

        for u, v in forest(len(f), test):
            left.append(np.full(len(v), ident[rows[u]]))
            right.append(ident[rows[v]])
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, rows: int, most: int = 3, heavy: int = HEAVY, least: float | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints with the components of all links; with
    ``least`` over nodes (columns node, _fp, sketch) whose sketches are that much alike.

    ``rows``: how many there are.  Anchors with more than ``heavy`` homes are dealt
    over a grid: a cell holds one part of the homes and one part of the visitors, and
    every part meets every other, so nothing is dropped and no task gets a whole group.
    """
    if not 0 <= most <= 7:
        raise ValueError("two blocks cover up to 3 bits, four blocks up to 7")
    blocks = 2 if most <= 3 else 4
    spark = nodes.sparkSession
    dealt = _anchor_rows(nodes, False, blocks).withColumns({"i": F.lit(0), "j": F.lit(0)})
    hot = checkpoint(
        _anchor_rows(nodes.select("_fp"), True, blocks).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
        .select("anchor", F.ceil(F.col("n") / heavy).cast("int").alias("parts"))
    )
    if not hot.isEmpty():
        wide = _anchor_rows(nodes, False, blocks).join(hot, "anchor", "left")
        part = F.pmod(F.xxhash64("_fp"), F.col("parts")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        own = [c for c in wide.columns if c not in ("home", "parts")]
        cold = wide.where("parts is null").select(*own, "home", F.lit(0).alias("i"), F.lit(0).alias("j"))
        split = wide.where("parts is not null")
        as_home = split.where("home").select(*own, "home", part.alias("i"), every.alias("j"))
        as_visitor = split.select(*own, F.lit(False).alias("home"), every.alias("i"), part.alias("j"))
        dealt = cold.unionByName(as_home).unionByName(as_visitor)
    per_row = blocks * (64 // blocks // 2 + 1)
    tasks = max(shuffle_parts(spark), -(-per_row * rows // (ROWS_PER_TASK if least is None else ROWS_PER_TASK // 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        del got
        anchor, home, fps, i, j = (table.column(n).to_numpy() for n in ("anchor", "home", "_fp", "i", "j"))
        cell = anchor if not i.any() and not j.any() else np.unique(np.stack([anchor, i.astype(np.int64), j.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        node = sketch = None
        if least is not None:
            node = table.column("node").to_numpy()
            data = table.column("sketch").combine_chunks()
            sketch = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        a, b = compare(cell, home, fps.astype(np.int64).view(np.uint64), most, node, sketch, least or 0.0)
        if len(a):
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
            for at in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16), k].copy()) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition(tasks, "anchor", "i", "j").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an undirected edge table (a, b) and the smallest node
    of its component.

    Alternating large-star and small-star rounds: minima are pre-aggregated, tables
    stay as large as the edge table, and the number of rounds grows with the logarithm
    of the longest path.  Each round is checkpointed, so lost executors cost one round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        met = both.join(low, "a")
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")) if large else (
            met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        )
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        now = checkpoint(star(star(now, True), False))
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


#: A fingerprint is hot if more than this many rows have it, or more than this share of all rows; so
#: at most 1 / HOT_SHARE are, and no other one has more rows than that in a task of the join.
HOT_ROWS, HOT_SHARE = 10_000, 1 / 20_000


def classes(fingerprints: DataFrame, doc_id: str, most: int = 3, heavy: int = HEAVY) -> DataFrame:
    """Adds ``component_id``: the smallest ``doc_id`` that links of the fingerprints
    (``_fp``) reach, itself included.  ``fingerprints`` must be materialised.  Null ids
    are never the smallest; a component of null ids alone has a null one.  ``_group``
    names the component by its smallest fingerprint.

    Fingerprints that a large share of the rows have (as that of empty texts) meet their rows
    by a broadcast of at most 1 / ``HOT_SHARE`` of them, the others by a shuffle.
    """
    distinct = checkpoint(fingerprints.groupBy("_fp").agg(F.min(doc_id).alias("_first"), F.count("*").alias("_rows")))
    size = distinct.agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).first()
    roots = components(links(distinct.select("_fp", "_first"), size["n"], most, heavy))
    linked = roots.join(distinct, roots["node"] == distinct["_fp"]).select("node", "root", "_first")
    least = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    named = linked.join(least, "root").select(F.col("node").alias("_fp"), "root", "_least")
    table = checkpoint(distinct.join(named, "_fp", "left").select(
        "_fp", "_rows", F.coalesce("_least", "_first").alias("component_id"), F.coalesce("root", "_fp").alias("_group")
    ))
    hot = F.col("_rows") > max(HOT_ROWS, int((size["rows"] or 0) * HOT_SHARE))
    often = F.broadcast(table.where(hot).select("_fp", F.col("component_id").alias("_c"), F.col("_group").alias("_g"), F.lit(True).alias("_hot")))
    told = fingerprints.join(often, "_fp", "left")
    cold = told.where("_hot is null").drop("_c", "_g", "_hot").join(table.where(~hot).drop("_rows"), "_fp")
    return cold.unionByName(told.where("_hot").drop("_hot").withColumnsRenamed({"_c": "component_id", "_g": "_group"}))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    A null text is an empty one (fingerprint zero, linked like any other).  Equal
    fingerprints always share a component.  An empty table gives an empty one;
    columns other than ``doc_id`` and ``text`` are not looked at.
    """
    fps = checkpoint(with_fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), ["doc_id"], width=width))
    return classes(fps, "doc_id", most, heavy).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Min-hashes of a sketch, one byte each.
SKETCH = 256
#: Similarity of word shingles from which near copies link.
SIMILAR = 0.8
#: Bands of min-hashes miss a pair of exactly the wanted similarity with this chance at most
#: (1.6e-9 at 0.8), one above it more seldom.
MISS = 1e-8
#: Standard errors by which a sketch may fall short of the wanted similarity.
SLACK = 8
#: Documents of one band value, and of one group of alike sketches, beyond which the
#: comparison is split into a grid of tasks; bytes of shingle sets for the latter.
HEAVY_BAND, HEAVY_SETS, SET_BYTES = 2048, 512, 8 << 20


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words (fewer words: one shingle)."""
    import xxhash

    n = max(1, len(words) - width + 1)
    joined = {b" ".join(words[i : i + width]) for i in range(n)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), dtype="<u8", count=len(joined)))


def sketch(h: np.ndarray) -> bytes:
    """A byte of each of ``SKETCH`` min-hashes over a set of hashes."""
    mul, add = _MULTIPLIERS
    low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[at : at + 2048, None] * mul[None, :] + add[None, :]).min(axis=0))
    return (low >> np.uint64(24)).astype(np.uint8).tobytes()


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_260_101)
    odd = rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


_MULTIPLIERS = _multipliers()


def with_sketches(df: DataFrame, columns: list[str], text: str, width: int) -> DataFrame:
    """``columns`` of ``df``, sketch, node (a hash of the shingle set) and _fp (the set's SimHash)."""
    plain = df.select(*columns, text_or_empty(text).alias("_text"))
    schema = plain.drop("_text").schema.add("sketch", "binary").add("node", "long").add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sets = (shingles(texts[i].as_py().encode().lower().split(), width) for i in range(len(texts)))
            made = [(sketch(h), xxhash.xxh64_intdigest(h.tobytes()), majority(h)) for h in sets]
            nodes, fps = (np.array([m[k] for m in made], dtype=np.uint64).view(np.int64) for k in (1, 2))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m[0] for m in made], pa.binary()), pa.array(nodes), pa.array(fps)], names=[*columns, "sketch", "node", "_fp"])

    return plain.mapInArrow(run, schema)


def band_width(similar: float) -> int:
    """Min-hashes of a band: as many as miss a pair of that similarity with a chance below
    ``MISS`` when all bands of a sketch are looked at (one, if none does)."""
    return max((r for r in range(1, 7) if (1 - similar**r) ** (SKETCH // r) < MISS), default=1)


def _band_rows(nodes: DataFrame, wide: int) -> DataFrame:
    """(band, node): a value for each band of the sketches, which holds the band's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = SKETCH // wide
        for batch in batches:
            for at in range(0, len(batch), 10_000):
                part = batch.slice(at, 10_000)
                sk = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)[:, : n * wide].reshape(-1, n, wide)
                key = np.broadcast_to(np.arange(n, dtype=np.int64) << 48, sk.shape[:2]).copy()
                for k in range(wide):
                    key |= sk[:, :, k].astype(np.int64) << (8 * k)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), n))], names=["band", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "band long, node long")


def _grid(rows: DataFrame) -> DataFrame:
    """``rows`` with ``parts``, each dealt to cells (i, j) so that any two of its group meet in one."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = rows.withColumns({"p": part, "q": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    return cells.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")}).drop("p", "q", "parts")


def _cells(batches: Iterator[pa.RecordBatch], key: str) -> tuple[pa.Table, list[np.ndarray]] | None:
    """The table of a task and the rows of each of its cells, a node once."""
    got = list(batches)
    if not got:
        return None
    table = pa.Table.from_batches(got)
    cols = [table.column(n).to_numpy() for n in ("node", "j", "i", key)]
    order = np.lexsort(cols)
    node, *where = (c[order] for c in cols)
    new = np.r_[True, np.any([w[1:] != w[:-1] for w in where], axis=0)] if len(order) else np.zeros(0, dtype=bool)
    once = new | np.r_[True, node[1:] != node[:-1]] if len(order) else new
    return table, np.split(order[once], np.flatnonzero(new[once])[1:])


def _edges(node: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if left:
        pairs = np.unique(np.sort(np.stack([node[np.concatenate(left)], node[np.concatenate(right)]], axis=1), axis=1), axis=0)
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16), k].copy()) for k in (0, 1)], names=["a", "b"])


def sketch_links(nodes: DataFrame, similar: float, heavy: int = HEAVY_BAND) -> DataFrame:
    """Edges (a, b) over ``nodes`` (node, sketch) whose components hold both nodes of every
    pair that is ``similar``: those that agree in a band and whose sketches are as alike
    as ``SLACK`` standard errors below it."""
    spark = nodes.sparkSession
    wide = band_width(similar)
    least = similar - SLACK * (similar * (1 - similar) / SKETCH) ** 0.5
    bands = _band_rows(nodes, wide)
    several = checkpoint(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    rows = several.agg(F.sum(F.col("n") * F.ceil(F.col("n") / heavy))).first()[0] or 0
    met = bands.join(several.select("band", F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "band")
    dealt = _grid(met.join(nodes.select("node", "sketch"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _cells(batches, "band")) is None:
            return
        table, cells = got
        node = table.column("node").to_numpy()
        sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), SKETCH)
        left, right, small = [], [], {}
        for c in cells:
            if len(c) <= 8:
                small.setdefault(len(c), []).append(c)
                continue
            for u, v in forest(len(c), lambda u, rest, c=c: (sk[c[rest]] == sk[c[u]]).mean(axis=1) >= least):
                left.append(np.full(len(v), c[u]))
                right.append(c[v])
        for n, group in small.items():
            if n > 1:
                a, b = (np.stack(group)[:, k].ravel() for k in np.triu_indices(n, 1))
                one = np.unique(np.stack([node[a], node[b]], axis=1), axis=0, return_index=True)[1]
                for at in range(0, len(one), 1 << 16):
                    x, y = a[one[at : at + (1 << 16)]], b[one[at : at + (1 << 16)]]
                    near = (sk[x] == sk[y]).mean(axis=1) >= least
                    left.append(x[near])
                    right.append(y[near])
        yield from _edges(node, left, right)

    tasks = max(shuffle_parts(spark), -(-rows // (ROWS_PER_TASK // 8)))
    return dealt.repartition(tasks, "band", "i", "j").mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Edges (a, b) over ``nodes`` (node, _fp) with the components of all pairs whose fingerprints differ in at
    most ``bits`` bits: a fingerprint's first node stands for it, the others link to that one."""
    first = checkpoint(nodes.groupBy("_fp").agg(F.min("node").alias("_first"), F.count("*").alias("n")))
    near = links(first.select("_fp"), first.count(), bits)
    ends = [first.select(F.col("_fp").alias(c), F.col("_first").alias(f"_{c}")) for c in "ab"]
    apart = near.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    # equal fingerprints of different sets are few: those of a fingerprint with several nodes
    equal = nodes.join(first.where("n > 1"), "_fp").where("node <> _first").select(F.col("_first").alias("a"), F.col("node").alias("b"))
    return apart.unionByName(equal)


def set_links(sets: DataFrame, similar: float, heavy: int = HEAVY_SETS) -> DataFrame:
    """Edges (a, b) with the components of all pairs of one ``root`` whose shingle sets have a
    Jaccard similarity of ``similar`` or more; sets: node, root, set (materialised)."""
    spark = sets.sparkSession
    size = F.greatest(F.countDistinct("node") / heavy, F.sum(F.length("set")) / SET_BYTES)
    groups = checkpoint(sets.groupBy("root").agg(F.ceil(size).cast("int").alias("parts"), F.sum(F.length("set")).alias("bytes")))
    n_bytes = groups.agg(F.sum(F.col("bytes") * F.col("parts"))).first()[0] or 0
    dealt = _grid(sets.join(groups.select("root", "parts"), "root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _cells(batches, "root")) is None:
            return
        table, cells = got
        node = table.column("node").to_numpy()
        data = table.column("set")
        left, right = [], []
        for c in cells:
            if len(c) < 2:
                continue
            own = [np.frombuffer(data[int(k)].as_py(), dtype="<u8") for k in c]
            sizes = np.array([len(x) for x in own])
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            names, codes = np.unique(np.concatenate(own), return_inverse=True)
            mark = np.zeros(len(names), dtype=np.int32)

            def test(u: int, rest: np.ndarray) -> np.ndarray:
                mine = codes[first[u] : first[u] + sizes[u]]
                mark[mine] = 1
                both = np.add.reduceat(mark[codes], first)[rest]
                mark[mine] = 0
                return both / (sizes[u] + sizes[rest] - both) >= similar

            for u, v in forest(len(c), test):
                left.append(np.full(len(v), c[u]))
                right.append(c[v])
        yield from _edges(node, left, right)

    tasks = max(shuffle_parts(spark), -(-n_bytes // (2 * SET_BYTES)))
    return dealt.repartition(tasks, "root", "i", "j").mapInArrow(run, "a long, b long")


def with_sets(df: DataFrame, columns: list[str], text: str, width: int) -> DataFrame:
    """``columns`` of ``df`` and set: the hashes of the text's shingles."""
    plain = df.select(*columns, text_or_empty(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sets = [shingles(texts[i].as_py().encode().lower().split(), width).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(sets, pa.binary())], names=[*columns, "set"])

    return plain.mapInArrow(run, plain.drop("_text").schema.add("set", "binary"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similar: float = SIMILAR, heavy: int | None = None, bits: int = 3) -> DataFrame:
    """The rows of ``df`` with one document of each group of near copies: the one of the
    smallest id (null ids last), then of the smallest row hash.

    Documents link if the Jaccard similarity of their sets of ``width``-word shingles (as
    64-bit hashes) is ``similar`` or more, and a group is what links connect.  SimHash says
    which documents may link: fingerprints of the sets that differ in at most ``bits`` bits,
    found by anchors.  That leaves out most pairs near ``similar``, so documents that agree in
    a band of min-hashes, with slack, may link too; within what both connect, the sets
    themselves are compared.  Null texts count as empty; texts without words are one group;
    repeated rows count once.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # own names cannot clash
    ids, texts = (F.col(f"c{df.columns.index(n)}") for n in (doc_id, text))
    keyed = plain.select("*", *row_key(*(F.col(c) for c in plain.columns)))
    marks = checkpoint(with_sketches(keyed.select(ids.alias("_id"), texts.alias("_t"), "_k1", "_k2"), ["_id", "_k1", "_k2"], "_t", width))
    nodes = checkpoint(marks.groupBy("node").agg(F.min("sketch").alias("sketch"), F.min("_fp").alias("_fp"), F.min(F.struct("_k1", "_k2")).alias("row")))
    may = components(fingerprint_links(nodes, bits).unionByName(sketch_links(nodes, similar, heavy or HEAVY_BAND)))
    rows = nodes.join(may, "node").select("node", "root", F.col("row._k1").alias("_k1"), F.col("row._k2").alias("_k2"))
    sets = checkpoint(with_sets(keyed.select("_k1", "_k2", texts.alias("_t")).join(rows, ["_k1", "_k2"]), ["node", "root"], "_t", width))
    roots = components(set_links(sets, similar, heavy or HEAVY_SETS))
    grouped = marks.select("_id", "_k1", "_k2", "node").join(roots, "node", "left").withColumn("_group", F.coalesce("root", "node"))
    best = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2")))
    win = grouped.groupBy("_group").agg(best.alias("w")).select(F.col("w.k1").alias("_k1"), F.col("w.k2").alias("_k2"))
    times = marks.groupBy("_k1", "_k2").agg(F.count("*").alias("_times"))
    met = keyed.join(win.join(times, ["_k1", "_k2"]), ["_k1", "_k2"])
    single = met.where(F.col("_times") == 1)
    repeated = met.where(F.col("_times") > 1).dropDuplicates(["_k1", "_k2"])
    return single.unionByName(repeated).select(*plain.columns).toDF(*df.columns)
