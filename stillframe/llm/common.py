"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words in every contract: space and \t\n\v\f\r.
BLANKS = b" \t\n\x0b\x0c\r"


def _ensure_folder(spark: SparkSession) -> None:
    """The folder is the cluster's ``spark.checkpoint.dir``.  Only on one machine (a local
    master, as in tests) a temporary one is made where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stillframe-cp-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is made and checkpointed within are deleted when their query has ended, not when
    the driver's memory happens to be collected; nothing reads them again behind a checkpoint."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for tables that are read again."""
    _ensure_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


#: Bits of a sketch of keys: buckets of 32,768 bits, so at most 16 MB however many keys there are.
SKETCH_BITS = 1 << 27


def key_sketch(keys: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits): a bit for each 64-bit key of a table, for ``maybe_in``.  It has at most
    ``SKETCH_BITS`` / 32,768 rows of 4 KB."""
    at = F.pmod(key, F.lit(SKETCH_BITS)) + 1
    marked = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
    return marked.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def maybe_in(rows: DataFrame, key: Column, sketch: DataFrame) -> DataFrame:
    """The rows whose key may be one of the sketch's: none that is, is lost; of others a share
    goes that falls as the sketch fills.  No row is shuffled: the sketch is broadcast, 16 MB at
    most."""
    at = F.pmod(key, F.lit(SKETCH_BITS)) + 1
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marks = F.broadcast(sketch.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    met = rows.join(marks, F.bitmap_bucket_number(at) == F.col("_bucket"))
    power = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (place % 8 + 1).cast("int"))
    return met.where(byte.bitwiseAND(power) != 0).select(*rows.columns)


class Files:
    """Small binary files below a shared folder, for numbers that belong to one part of the
    data and would only be shuffled to come back to it.

    The folder's URI must be of a kind that Arrow opens (file, hdfs, s3, gs).  A file is
    written under another name and moved, so a task that runs again, or twice, leaves
    the same whole file.
    """

    def __init__(self, uri: str):
        self.uri = uri.replace("file:///", "/").replace("file:/", "/") if uri.startswith("file:/") else uri

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, data: bytes) -> None:
        from pyarrow import fs

        system, top = self._open()
        at = f"{top}/{name}"
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as f:
            f.write(data)
        try:
            system.move(part, at)
        except OSError:  # some systems do not replace files: then a task before this one wrote it
            if system.get_file_info(at).type != fs.FileType.File:
                raise
            system.delete_file(part)

    def get(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        system, top = self._open()
        with system.open_input_file(f"{top}/{name}") as f:
            f.seek(start)
            return f.read(size)

    def drop(self, name: str = "") -> None:
        """Deletes a folder below this one, or this one."""
        from pyarrow import fs

        system, top = self._open()
        at = f"{top}/{name}".rstrip("/")
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; whole ones in the fewest bytes."""
    a = np.ascontiguousarray(values)
    if a.dtype.kind in "iu" and len(a):
        a = a.astype(np.result_type(np.min_scalar_type(int(a.min())), np.min_scalar_type(int(a.max()))), copy=False)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    body = pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True) if planes else b""
    return np.array([len(a)], dtype="<i8").tobytes() + a.dtype.str.encode().ljust(4) + body


def unpack(data: bytes) -> np.ndarray:
    n, kind = int(np.frombuffer(data, "<i8", 1)[0]), np.dtype(data[8:12].decode().strip())
    if not n:
        return np.zeros(0, dtype=kind)
    planes = pa.decompress(data[12:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.r_[keys[:1], np.diff(keys)].astype(np.uint64)) if len(keys) else pack(keys)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.uint64), dtype=np.uint64)


def bundle(parts: dict[str, bytes]) -> bytes:
    """Named byte strings as one; ``unbundle`` takes them apart."""
    head = ";".join(f"{k}={len(v)}" for k, v in parts.items()).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(parts.values())


def unbundle(data: bytes) -> dict[str, bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    out = {}
    for part in data[8:at].decode().split(";") if at > 8 else []:
        name, size = part.split("=")
        out[name] = data[at : at + int(size)]
        at += int(size)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's columns (nulls count as values).

    Rows that agree in all columns share the key, so results joined back by it
    are equal for them; nothing depends on ids being unique.
    """
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(7919), *parts).alias("_k2")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
