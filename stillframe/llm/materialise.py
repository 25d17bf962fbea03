"""Training-order materialisation of token sequences.

All documents, in the order of their rows' hashes, are one stream of ids, cut into
sequences of fixed length; so what is in a sequence depends on the rows alone, not on
how tasks or files hold them.  A keyed Feistel permutation gives every sequence a global
slot.  Slots are dealt by ranges into shards: files of raw ids of fixed stride, in which
slot s starts at byte (s - first_slot) * stride of shard s // per_shard, so a reader
goes on from any slot with one seek.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillframe.llm import tokens
from stillframe.llm.common import Files, checkpoint, pack, row_key, shared_folder, shuffle_parts, text_or_empty, unpack

ROUNDS = 4
#: Documents of one range of the order, about.
RANGE_ROWS = 1_000_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, at given places.

    A balanced Feistel network on the least even number of bits that holds n; values
    that fall outside go through it again until they fall inside (cycle-walking).  The
    domain is less than 4 n, so a few walks do on average, and every walk ends because
    the network is a permutation.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def mix(x: np.ndarray, round_: int) -> np.ndarray:
        z = x + np.uint64((key * 0x9E3779B97F4A7C15 + (round_ + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (mix(right, r) & mask)
            out[todo] = left << shift | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def encoded(df: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _k1, _k2 (hashes of the row), n and ids (packed) of every document: its ids
    (null text: none) and ``end_id`` behind them.  Map-only."""
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "_k1", "_k2", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, texts in tokens.by_bytes(batch.column(3)):
                ids = [np.frombuffer(enc.encode(t) + end, "<u4") for t in texts]
                own = [batch.column(i).slice(first, len(texts)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x in ids], pa.int64()), pa.array(map(pack, ids), pa.binary())], names=names)

    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    return plain.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, n long, ids binary")


def _part_and_place(at: pa.Array) -> tuple[int, np.ndarray]:
    x = at.to_numpy(zero_copy_only=False).astype(np.int64)
    return int(x[0] >> 33), x & ((1 << 33) - 1)


def write_offsets(docs: DataFrame, files: Files, range_rows: int = RANGE_ROWS) -> int:
    """Writes, for each partition of ``docs`` (materialised: _k1, _k2, n), where its documents
    start in the stream; returns the stream's ids.

    The order is that of (_k1, _k2); rows that agree in both are the same document.  Ranges
    of _k1 are sorted apart, and only a count and a sum a range come to the driver.
    """
    spark = docs.sparkSession
    placed = docs.select("_k1", "_k2", "n", F.monotonically_increasing_id().alias("at"))
    parts = placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("rows")).collect()  # a row a partition
    if not parts:
        return 0
    ranges = max(shuffle_parts(spark), sum(r["rows"] for r in parts) // range_rows)
    high = F.shiftrightunsigned(F.col("_k1").bitwiseXOR(F.lit(-(1 << 63))), 33)
    placed = placed.withColumn("owner", F.shiftright(high * F.lit(ranges).cast("long"), 31).cast("int"))
    sums = {r["owner"]: r["n"] for r in placed.groupBy("owner").agg(F.sum("n").alias("n")).collect()}  # a row a range
    starts = dict(zip(sorted(sums), np.r_[0, np.cumsum([sums[k] for k in sorted(sums)])].tolist()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64)
            if len(n):
                now = starts[batch.column(0)[0].as_py()] if now is None else now
                ends = now + np.cumsum(n)
                now = int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ends - n)], names=["at", "start"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if got:
            t = pa.Table.from_batches(got)
            part, _ = _part_and_place(t.column("at").chunk(0))
            files.put(f"offsets/{part}", t.column("start").to_numpy().astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(t)], pa.int64())], names=["rows"])

    ordered = placed.repartitionById(ranges, "owner").sortWithinPartitions("_k1", "_k2", "at").select("owner", "at", "n")
    numbered = ordered.mapInArrow(number, "at long, start long")
    back = numbered.repartitionById(max(r["p"] for r in parts) + 1, F.shiftright("at", 33).cast("int")).sortWithinPartitions("at")
    back.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return sum(sums.values())


def fragments(docs: DataFrame, files: Files, length: int, n_sequences: int, key: int) -> DataFrame:
    """Each document's share in each sequence: slot, at (place in the sequence), ids (packed),
    doc_id, start (place in the document)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, part = None, -1
        for batch in batches:
            if not len(batch):
                continue
            p, place = _part_and_place(batch.column(0))
            if p != part:
                part, starts = p, np.frombuffer(files.get(f"offsets/{p}"), "<i8")
            who, sequence, at, first, ids = [], [], [], [], []
            for i, (o, packed) in enumerate(zip(starts[place].tolist(), batch.column(2).to_pylist())):
                x = unpack(packed)
                done = 0
                while done < len(x):
                    inside = (o + done) % length
                    take = min(length - inside, len(x) - done)
                    who.append(i)
                    sequence.append((o + done) // length)
                    at.append(inside)
                    first.append(done)
                    ids.append(packed if take == len(x) else pack(x[done : done + take]))
                    done += take
            slot = permute(np.array(sequence, dtype=np.int64), n_sequences, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(at, pa.int32()), pa.array(ids, pa.binary()), batch.column(1).take(pa.array(who, pa.int64())), pa.array(first, pa.int64())],
                names=["slot", "at", "ids", "doc_id", "start"],
            )

    placed = docs.select(F.monotonically_increasing_id().alias("_at"), "doc_id", "ids")
    return placed.mapInArrow(run, f"slot long, at int, ids binary, doc_id {kind}, start long")


MANIFEST = "shard long, file string, first_slot long, n_slots int, stride int, n_bytes long, crc32 long, n_ids array<int>"


def shards(pieces: DataFrame, files: Files | None, n_sequences: int, length: int, width: int, end_id: int, per_shard: int = 4096) -> DataFrame:
    """Shards of ``per_shard`` slots from ``fragments``, a row a shard: its number, file, first
    slot, slots, stride (``length`` ids of ``width`` bytes), bytes, checksum, and for each slot its
    ids without padding, and the document and place in it of its first id.  The bytes are written to
    the file or, without ``files``, are the column payload.
    """
    n_shards = -(-n_sequences // per_shard)
    tasks = max(1, min(max(shuffle_parts(pieces.sparkSession), n_shards // 4), n_shards))
    owner = F.floor(F.floor(F.col("slot") / per_shard) * tasks / max(1, n_shards)).cast("int")
    ranges = pieces.repartitionById(tasks, owner).sortWithinPartitions("slot", "at")
    field = pieces.schema["doc_id"]
    kind = "<u4" if width == 4 else "<u2"
    stride = length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            slot, at = t.column("slot").to_numpy(), t.column("at").to_numpy()
            first, n = now * per_shard, min(per_shard, n_sequences - now * per_shard)
            data = np.full(n * length, end_id, dtype=kind)
            used = np.zeros(n, dtype=np.int64)
            for s, a, ids in zip((slot - first).tolist(), at.tolist(), t.column("ids").to_pylist()):
                x = unpack(ids)
                data[s * length + a : s * length + a + len(x)] = x
                used[s] += len(x)
            head = np.flatnonzero(at == 0)
            if len(head) != n or (np.diff(slot[head]) != 1).any() or (used[slot[np.r_[head]] - first] < 1).any():
                raise ValueError("a sequence of the shard has no first id")
            raw = data.tobytes()
            name = f"shard-{now:08d}.bin"
            if files is not None:
                files.put(name, raw)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (pa.array(used, pa.int32()), t.column("doc_id").combine_chunks().take(pa.array(head)), t.column("start").combine_chunks().take(pa.array(head)))]
            plain = [pa.array([now]), pa.array([name]), pa.array([first]), pa.array([n], pa.int32()), pa.array([stride], pa.int32()), pa.array([len(raw)]), pa.array([zlib.crc32(raw)])]
            names = [*(x.split()[0] for x in MANIFEST.split(", ")), "first_doc", "first_start"]
            body = [] if files is not None else [pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays([*plain, *lists, *body], names=names + ["payload"] * len(body))

        for batch in batches:
            which = batch.column(0).to_numpy() // per_shard
            for a, b in zip(*(lambda e: (e, [*e[1:], len(which)]))(np.flatnonzero(np.r_[True, which[1:] != which[:-1]][: len(which)]).tolist())):
                if which[a] != now and held:
                    yield out()
                    held = []
                now = int(which[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return ranges.mapInArrow(run, f"{MANIFEST}, first_doc array<{field.dataType.simpleString()}>, first_start array<long>" + ("" if files else ", payload binary"))


def materialise(df: DataFrame, path: str, key: int, length: int = 1024, end_id: int = 0, per_shard: int = 4096, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All documents as shards in the training order of ``key``, see ``shards``: files in ``folder``
    and their manifest or, without a folder, rows that hold the bytes.

    Nulls count as empty texts, repeated rows as further documents; an empty table gives no
    shards; other columns are left out.  The same rows give the same bytes however they are
    partitioned.  The stream's last sequence is filled up with ``end_id``.  The folder's URI must
    be one that Arrow opens.
    """
    spark = df.sparkSession
    width = 4 if tokens.vocabulary_size(path) > 1 << 16 else 2
    work = Files(shared_folder(spark))
    docs = checkpoint(encoded(df, path, end_id, doc_id, text))
    total = write_offsets(docs, work, range_rows)
    n = -(-total // length)
    target = None if folder is None else Files(folder)
    out = shards(fragments(docs, work, length, n, key), target, n, length, width, end_id, per_shard)
    if target is not None:  # written now; without a folder the offsets are read when the rows are
        out = checkpoint(out)
        work.drop()
    return out


def read_from(folder: str, slot: int, n_slots: int, stride: int, width: int, per_shard: int = 4096, most: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from ``slot`` on, in order, up to ``n_slots`` slots in all: one seek in the
    shard that holds it, then runs of ``most`` slots, one file after the other."""
    files = Files(folder)
    kind = "<u4" if width == 4 else "<u2"
    while slot < n_slots:
        shard, inside = divmod(slot, per_shard)
        take = min(most, per_shard - inside, n_slots - slot)
        data = np.frombuffer(files.get(f"shard-{shard:08d}.bin", inside * stride, take * stride), kind).reshape(take, -1)
        for i in range(take):
            yield slot + i, data[i]
        slot += take


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str, width: int, first: int = 0) -> DataFrame:
    """(slot, ids) of all slots from ``first`` on; a task reads one shard, from its first wanted
    slot, and no earlier shard is opened."""
    files = Files(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, n, stride in zip(*(c.to_pylist() for c in batch.columns)):
                skip = max(0, first - start)
                data = files.get(name, skip * stride, (n - skip) * stride)
                yield pa.RecordBatch.from_arrays([pa.array(range(start + skip, start + n), pa.int64()), pa.array([data[i * stride : (i + 1) * stride] for i in range(n - skip)], pa.binary())], names=["slot", "ids"])

    wanted = manifest.where(F.col("first_slot") + F.col("n_slots") > first).select("file", "first_slot", "n_slots", "stride")
    return wanted.mapInArrow(run, "slot long, ids binary")
