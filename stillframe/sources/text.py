"""Readers of geometry, peak and basis text files.

Block-structured files are read with the block marker as the record separator, so one
record is one block and large files split over tasks without a running counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BEGIN, CHUNK_END = "----- Begin chunk -----", "----- End chunk -----"
PEAKS_BEGIN, PEAKS_END = "Peaks from peak search", "End of peak list"


def _axis(term: Column, axis: str) -> Column:
    """Coefficient of x, y or z in a direction such as ``-0.5x +1.0y``; a bare sign is one."""
    flat = F.regexp_replace(term, r"\s+", "")
    found = F.regexp_extract(flat, rf"([+-]?[0-9.eE]*(?:(?<=[eE])[+-][0-9]+)?){axis}", 1)
    sign = F.when(found == "-", "-1").when((found == "+") | (found == ""), "1").otherwise(found)
    return F.when(F.contains(flat, F.lit(axis)), sign.try_cast("double")).otherwise(F.lit(0.0))


def geometry_pairs(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, at, k, v: the ``key = value`` lines of every text, without comments behind ``;``."""
    lines = texts.select(*by, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    body = F.trim(F.regexp_replace("line", ";.*$", ""))
    pairs = lines.select(*by, "at", body.alias("b")).where(F.contains("b", F.lit("=")))
    return pairs.select(*by, "at", F.trim(F.substring_index("b", "=", 1)).alias("k"), F.trim(F.regexp_replace("b", r"^[^=]*=", "")).alias("v"))


def parse_geometry(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Panels of geometry texts, a text for each value of ``by`` (a run's streams carry their own): by, ord,
    panel, bounds, corner, fs and ss directions, res, clen, coffset.

    Keys without a panel are defaults for panels that come after them; blocks named ``bad...`` and
    blocks without a bound, a corner or directions are left out.  A panel without a resolution is an
    error that names it.  A null or empty text has no panels.  A text is grouped by itself, so the work
    is dealt by ``by``; its panels are at most some hundreds.
    """
    rows = geometry_pairs(texts, by, text).withColumns({"panel": F.when(F.contains("k", F.lit("/")), F.substring_index("k", "/", 1)), "key": F.substring_index("k", "/", -1)})
    rows = rows.where("panel is null or not (startswith(panel, 'bad') or startswith(panel, 'rigid') or startswith(panel, 'group'))")
    last = lambda key: F.max_by(F.when(F.col("key") == key, F.col("v")), F.when(F.col("key") == key, F.col("at")))
    names = ["min_fs", "max_fs", "min_ss", "max_ss", "corner_x", "corner_y", "res", "clen", "coffset", "fs", "ss"]
    common = names[6:9]
    # defaults and panels come from one grouping: the rows without a panel are the text's own group
    groups = rows.groupBy(*by, "panel").agg(
        F.min("at").alias("_first"), *(last(n).alias(n) for n in names),
        *(F.array_sort(F.collect_list(F.when(F.col("panel").isNull() & (F.col("key") == n), F.struct("at", "v")))).alias(f"_{n}") for n in common),
    )
    text_rows = Window.partitionBy(*by)
    for n in common:
        given = F.max(F.when(F.col("panel").isNull(), F.col(f"_{n}"))).over(text_rows)
        groups = groups.withColumn(f"_{n}", F.filter(F.coalesce(given, F.array().cast("array<struct<at:int,v:string>>")), lambda x: x["at"] < F.col("_first")))
        groups = groups.withColumn(n, F.coalesce(n, F.get(f"_{n}", F.size(f"_{n}") - 1)["v"]))
    full = groups.where("panel is not null and min_fs is not null and max_fs is not null and min_ss is not null and max_ss is not null and corner_x is not null and corner_y is not null and fs is not null and ss is not null")
    value = {n: F.col(n).try_cast("double") for n in names[:9]}
    value["res"] = F.coalesce(value["res"], F.raise_error(F.concat(F.lit("no resolution for panel "), F.col("panel"))).cast("double"))
    order = text_rows.orderBy("_first")  # panels of one detector
    return full.select(
        *by, (F.row_number().over(order) - 1).alias("ord"), "panel", *(value[n].alias(n) for n in ("min_fs", "max_fs", "min_ss", "max_ss", "corner_x", "corner_y")),
        *(_axis(F.col(d), a).alias(f"{d}{a}") for d in ("fs", "ss") for a in "xyz"),
        value["res"].alias("res"), value["clen"].alias("clen"), F.coalesce(value["coffset"], F.lit(0.0)).alias("coffset"),
    )


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Panels of one geometry file (``parse_geometry``)."""
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("_file"), "value")
    return parse_geometry(text, ["_file"], "value").drop("_file")


def slab_axes(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, panel, dims, event_dims: how many axes of the stored array (``dimN``) each panel names, and how
    many of them are the event's (``%``)."""
    rows = geometry_pairs(texts, by, text).where(F.col("k").rlike(r"^(?!bad|rigid|group)[^/]+/dim\d+$"))
    return rows.groupBy(*by, F.substring_index("k", "/", 1).alias("panel")).agg(F.count_distinct("k").cast("int").alias("dims"), F.count_if(F.col("v") == "%").cast("int").alias("event_dims"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of stream text: image, event, and its body."""
    raw = spark.read.option("lineSep", CHUNK_BEGIN).text(path)
    body = F.substring_index("value", CHUNK_END, 1)
    return raw.where(F.contains("value", F.lit(CHUNK_END))).select(
        F.regexp_extract("value", r"(?m)^Image filename:\s*(.*)$", 1).alias("image"),
        F.nullif(F.regexp_extract("value", r"(?m)^Event:\s*/*(.*)$", 1), F.lit("")).alias("event"), body.alias("body"),
    )


def event_number(event: Column) -> Column:
    """Trailing integer of an event name such as ``a//7``."""
    return F.regexp_extract(event, r"(\d+)/*$", 1).try_cast("long")


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of every chunk: image, event, peak_id, fs, ss, intensity.  Rows that are not
    numbers (the heading) are skipped."""
    c = read_chunks(spark, path)
    part = F.substring_index(F.substring_index("body", PEAKS_BEGIN, -1), PEAKS_END, 1)
    rows = c.where(F.contains("body", F.lit(PEAKS_BEGIN))).select("image", "event", F.posexplode(F.split(part, "\n")).alias("at", "line"))
    x = F.split(F.trim("line"), r"\s+")
    rows = rows.select("image", "event", "at", *(F.get(x, F.lit(i)).try_cast("double").alias(n) for i, n in ((0, "fs"), (1, "ss"), (3, "intensity"))))
    return rows.where("fs is not null and ss is not null").select("image", "event", F.col("at").alias("peak_id"), "fs", "ss", "intensity")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Blocks ``FRAME id n`` followed by n lines of three numbers: frame_id, peak_id, q."""
    raw = spark.read.option("lineSep", "FRAME").text(path).where(F.trim("value") != "")
    lines = F.split(F.trim("value"), "\n")
    head = F.split(F.trim(F.get(lines, F.lit(0))), r"\s+")
    # a block and each of its lines are split once, below the explode: above it that is done for every row
    blocks = raw.select(F.get(head, F.lit(0)).try_cast("long").alias("frame_id"), F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")).alias("lines"))
    rows = blocks.select("frame_id", F.posexplode("lines").alias("at", "x")).where("at > 0")
    rows = rows.select("frame_id", (F.col("at") - 1).alias("peak_id"), *(F.get("x", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("qx", "qy", "qz"))))
    return rows.where("qx is not null and qy is not null and qz is not null")


def read_bases(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id`` and nine numbers (axes one after another) or ``id NONE``: frame_id, m
    (axes as columns, null for none)."""
    x = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(x, F.lit(0)).try_cast("long").alias("frame_id"), x.alias("x")).where("frame_id is not null")
    nums = [F.get("x", F.lit(1 + 3 * (i % 3) + i // 3)).try_cast("double") for i in range(9)]
    ok = nums[0].isNotNull()
    for n in nums[1:]:
        ok = ok & n.isNotNull()
    return rows.select("frame_id", F.when(ok & (F.upper(F.get("x", F.lit(1))) != "NONE"), F.array(*nums)).alias("m"))
