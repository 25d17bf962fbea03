"""Text writers: stream chunks, frame blocks, orientation lists, registry snapshots.

Each makes one text row per block; ``write_ordered`` puts blocks into part files whose
names follow the order, so the parts joined in name order are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3

HEADER = "CrystFEL stream format 2.3"


def _vector(name: str, v: list[Column]) -> Column:
    """One reciprocal axis in 1/nm."""
    return F.format_string(f"{name} = %+9.7f %+9.7f %+9.7f nm^-1", *(x * 10 for x in v))


def cell_block(m: str = "m") -> Column:
    a, b, c, al, be, ga = L.cell_of_basis(lin3.matrix(m))
    inv = lin3.inverse(lin3.matrix(m))
    line = F.format_string("Cell parameters %7.5f %7.5f %7.5f nm, %7.5f %7.5f %7.5f deg", a / 10, b / 10, c / 10, al, be, ga)
    return F.concat_ws("\n", line, *(_vector(n, inv[3 * i : 3 * i + 3]) for i, n in enumerate(("astar", "bstar", "cstar"))))


def stream_chunks(results: DataFrame, reflections: DataFrame | None = None) -> DataFrame:
    """(serial, value) rows: one chunk per result (serial, image, event, m, extra map or
    null), with its reflections (serial, h, k, l, i, sigma, peak, bg, fs, ss, panel).
    Results whose basis is no cell are written as not indexed."""
    r = results.withColumn("_ok", L.has_cell(lin3.matrix("m")))
    refl = F.lit("")
    if reflections is not None:
        line = F.format_string("%4d %4d %4d %10.2f %10.2f %10.2f %10.2f %6.1f %6.1f %s", "h", "k", "l", "i", "sigma", "peak", "bg", "fs", "ss", "panel")
        rows = reflections.select("serial", F.struct("h", "k", "l", line.alias("line")).alias("x")).groupBy("serial").agg(F.array_sort(F.collect_list("x")).alias("_x"))
        r = r.join(rows, "serial", "left")
        head = "Reflections measured after indexing\n   h    k    l          I   sigma(I)       peak background  fs/px  ss/px panel\n"
        refl = F.when(F.size("_x") > 0, F.concat(F.lit(head), F.array_join(F.transform("_x", lambda x: x["line"]), "\n"), F.lit("\nEnd of reflections\n"))).otherwise(F.lit(""))
    extra = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("frame/"), e["key"], F.lit(" = "), e["value"])), "\n") if "extra" in results.columns else F.lit("")
    crystal = F.when(F.col("_ok"), F.concat(F.lit("--- Begin crystal\n"), cell_block(), F.lit("\n"), refl, F.lit("--- End crystal\n"))).otherwise(F.lit(""))
    value = F.concat(
        F.lit("----- Begin chunk -----\nImage filename: "), F.coalesce("image", F.lit("")), F.lit("\nEvent: //"), F.coalesce(F.col("event").cast("string"), F.lit("")),
        F.lit("\nImage serial number: "), (F.col("serial") + 1).cast("string"), F.lit("\nindexed_by = "), F.when(F.col("_ok"), "stillframe").otherwise("none"), F.lit("\n"),
        F.when(extra != "", F.concat(extra, F.lit("\n"))).otherwise(F.lit("")), crystal, F.lit("----- End chunk -----"),
    )
    return r.select("serial", value.alias("value"))


def frame_blocks(peaks: DataFrame) -> DataFrame:
    """(serial, value): ``FRAME id n`` blocks of reciprocal vectors."""
    line = F.format_string("%.8f %.8f %.8f", "qx", "qy", "qz")
    rows = peaks.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("peak_id", line.alias("line")))).alias("x"))
    return rows.select(F.col("frame_id").alias("serial"), F.concat(F.format_string("FRAME %d %d\n", "frame_id", F.size("x")), F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("value"))


def orientations(results: DataFrame, code: str = "") -> DataFrame:
    """(serial, value): one line per indexed frame with its reciprocal cell in 1/nm."""
    inv = lin3.inverse(lin3.matrix("m"))
    return results.where(L.has_cell(lin3.matrix("m"))).select("serial", F.concat(F.coalesce("image", F.lit("")), F.lit(" //"), F.coalesce(F.col("event").cast("string"), F.lit("")), F.lit(" "), F.format_string(" ".join(["%+9.7f"] * 9), *(x * 10 for x in inv)), F.lit(" 0.000 0.000 " + code)).alias("value"))


def registry_json(cells: DataFrame) -> DataFrame:
    """Snapshot of the cell registry, one JSON text a cell."""
    return cells.select("cell_id", F.to_json(F.struct(*cells.columns)).alias("value"))


def write_ordered(blocks: DataFrame, path: str, header: str | None = HEADER, parts: int | None = None) -> None:
    """Writes (serial, value) blocks in order; the header stands once, in front."""
    if header is not None:
        first = blocks.sparkSession.range(1).select(F.lit(-1).cast("long").alias("serial"), F.lit(header).alias("value"))
        blocks = first.unionByName(blocks.select(F.col("serial").cast("long"), "value"))
    n = parts or max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks.repartitionByRange(n, "serial").sortWithinPartitions("serial").select("value").write.mode("overwrite").text(path)


def concat_streams(parts: list[DataFrame]) -> DataFrame:
    """Blocks of several streams behind each other, serials made to follow on."""
    out = None
    at = 0
    for p in parts:
        top = p.agg(F.max("serial")).first()[0]
        moved = p.select((F.col("serial") + at).alias("serial"), "value")
        out = moved if out is None else out.unionByName(moved)
        at += 0 if top is None else top + 1
    return out
