"""Checkpoints and files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ensure_folder(spark: SparkSession) -> None:
    """``spark.checkpoint.dir``; only on one machine (a local master, as in tests) a temporary
    folder where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stillframe-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below it."""
    _ensure_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, without its lineage."""
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file below a folder that Arrow opens (file, hdfs, s3, gs): under another name, then
    moved, so a task that runs twice leaves the same whole file."""
    from pyarrow import fs

    uri = folder.replace("file:///", "/").replace("file:/", "/") if folder.startswith("file:/") else folder
    system, top = fs.FileSystem.from_uri(uri)
    system.create_dir(top, recursive=True)
    part = f"{top}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    try:
        system.move(part, f"{top}/{name}")
    except OSError:  # some systems do not replace files: then a task before this one wrote it
        if system.get_file_info(f"{top}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(part)
