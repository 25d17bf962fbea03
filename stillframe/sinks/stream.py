"""A sink for blocks of text with an order: part files by tasks, and a manifest a batch that commits them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from stillframe.plans.shared import put_file


def _place(folder: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:/", "/") if folder.startswith("file:/") else folder)


@dataclass
class Part(WriterCommitMessage):
    """A task's file: its name, its first serial number and how many blocks it has."""

    name: str
    first: int
    blocks: int


class ChunkSink(DataSource):
    """Blocks (serial long, value string) as text files below ``path``, in batch and stream writes.

    A task writes a file of its own under ``parts``; nothing counts before the driver has put the batch's
    manifest, which lists its files by their first serial number.  A batch has one manifest: when a
    batch that was committed is run again, its new files are deleted and the manifest stays.  Files of
    tasks that were lost are in no manifest.  Blocks keep the order in which a task gets them.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_chunks"

    def schema(self) -> str:
        return "serial long, value string"

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamChunkWriter:
        return StreamChunkWriter(self.options)


class _Parts:
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Part:
        name, first, n = f"{uuid.uuid4().hex}.txt", -1, 0
        system, top = _place(self.folder)
        system.create_dir(f"{top}/parts", recursive=True)
        with system.open_output_stream(f"{top}/parts/{name}") as f:
            for row in rows:
                first = row["serial"] if not n else first
                f.write(json.dumps([row["serial"], row["value"]]).encode() + b"\n")
                n += 1
        return Part(name, first, n)

    def put(self, messages: list, batch: str) -> None:
        from pyarrow import fs

        system, top = _place(self.folder)
        parts = [m for m in messages if m is not None]
        if system.get_file_info(f"{top}/manifests/{batch}.json").type == fs.FileType.File:
            self.drop(parts)
            return
        kept = sorted((p for p in parts if p.blocks), key=lambda p: (p.first, p.name))
        put_file(f"{self.folder}/manifests", f"{batch}.json", json.dumps({"parts": [p.name for p in kept], "blocks": sum(p.blocks for p in kept)}).encode())
        self.drop([p for p in parts if not p.blocks])

    def drop(self, parts: list) -> None:
        system, top = _place(self.folder)
        for p in parts:
            if p is not None:
                try:
                    system.delete_file(f"{top}/parts/{p.name}")
                except OSError:  # gone already
                    pass


class ChunkWriter(_Parts, DataSourceWriter):
    def commit(self, messages: list) -> None:
        # one write is one batch; further ones come behind it
        system, top = _place(self.folder)
        from pyarrow import fs

        there = system.get_file_info(fs.FileSelector(f"{top}/manifests", allow_not_found=True))
        self.put(messages, f"w{len(there):09d}")

    def abort(self, messages: list) -> None:
        self.drop(messages)


class StreamChunkWriter(_Parts, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.put(messages, f"b{batchId:09d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


def read_committed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, part, serial, value): the blocks of committed batches only; ``part`` is the file's place
    in its batch."""
    top = folder.rstrip("/")
    manifests = spark.read.schema("parts array<string>, blocks long").json(f"{top}/manifests").select(F.regexp_extract(F.input_file_name(), r"([bw]\d+)\.json", 1).alias("batch"), F.posexplode("parts").alias("part", "_file"))
    lines = spark.read.text(f"{top}/parts").select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]{32}\.txt)$", 1).alias("_file"), F.from_json("value", "array<string>").alias("x"))
    return lines.join(manifests, "_file").select("batch", "part", F.col("x")[0].cast("long").alias("serial"), F.col("x")[1].alias("value"))
