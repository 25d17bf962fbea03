"""Detector geometry: panel lookup, pixels to reciprocal vectors and back."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.plans.registry import query, table, view


def panel_rows(panels: DataFrame) -> list:
    """The panels in their order; a geometry has at most a few hundred."""
    rows = panels.orderBy("ord").collect()
    if len(rows) > 4096:
        raise ValueError("a geometry has at most 4096 panels")
    return rows


def first_of(tests: list) -> Column:
    """The place of the first test that holds, from one on; null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(tests), 0, -1):
        out = F.when(tests[i - 1], F.lit(i)).otherwise(out)
    return out


def pick(values: list, kind: str, place: Column) -> Column:
    """The value at a place (from one on) of a constant list; null for no place."""
    return F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), place)


def with_panel(points: DataFrame, panels: DataFrame, outer: bool = False) -> DataFrame:
    """Each point with the columns of the first panel (by ``ord``) whose rectangle holds its pixel.

    The few panels become one expression that gives a place in constant lists: no join and no
    shuffle of the points.  Points off every panel go, or have nulls if ``outer``.
    """
    rows = panel_rows(panels)
    if not rows:
        return points.join(F.broadcast(panels), F.lit(False), "left" if outer else "inner")  # an empty table
    x, y = F.floor("fs"), F.floor("ss")
    inside = [x.between(r["min_fs"], r["max_fs"]) & y.between(r["min_ss"], r["max_ss"]) for r in rows]
    found = points.withColumn("_place", first_of(inside))
    if not outer:
        found = found.where("_place is not null")
    return found.withColumns({f.name: pick([r[f.name] for r in rows], f.dataType.simpleString(), F.col("_place")) for f in panels.schema}).drop("_place")


def vectors(points: DataFrame, panels: DataFrame, clen: float, wavelength: float, outer: bool = False) -> DataFrame:
    """Points with their vectors: panels along the axes, 10,000 pixels a metre.  Steps are rounded in the
    order that the twins write them in: points on a panel's edge come back to that edge."""
    p = with_panel(points, panels, outer)
    x, y = (F.col("corner_x") + F.col("fs") - F.col("min_fs")) / 10000.0, (F.col("corner_y") + F.col("ss") - F.col("min_ss")) / 10000.0
    r = F.sqrt(x * x + y * y + float(Decimal(str(clen)) ** 2))
    return p.withColumns({"qx": x / r / wavelength, "qy": y / r / wavelength, "qz": (clen / r - 1) / wavelength})


PICK = "(select p.*, n.ord, n.min_fs, n.min_ss, n.corner_x, n.corner_y, row_number() over (partition by ok, ln, pk, frame, fs, ss order by n.ord) as r from (select row_number() over () as rid, * from points) p join panels n on floor(fs) between min_fs and max_fs and floor(ss) between min_ss and max_ss)"
PICKED = "(select * from (select p.*, n.ord, n.min_fs, n.min_ss, n.corner_x, n.corner_y, row_number() over (partition by rid order by n.ord) as r from (select row_number() over () as rid, * from points) p join panels n on floor(fs) between min_fs and max_fs and floor(ss) between min_ss and max_ss) where r = 1)"
QSQL = f"(select frame, ord, x/r/1.3 as qx, y/r/1.3 as qy, (0.1/r-1)/1.3 as qz from (select *, sqrt(x*x+y*y+0.1*0.1) as r from (select frame, ord, (corner_x+fs-min_fs)/cast(10000 as double) as x, (corner_y+ss-min_ss)/cast(10000 as double) as y from {PICKED})))"


@query("join02_panel_lookup", f"select cast(ord as int) as ord, count(*) as n from {PICKED} group by ord", "points panels")
def join02(spark, sf_dir):
    return with_panel(view(spark, sf_dir, "points"), view(spark, sf_dir, "panels")).groupBy("ord").agg(F.count("*").alias("n"))


@query("prj01_peaks_to_q", f"select frame, count(*) as n, round(sum(qx),6) as qx, round(sum(qy),6) as qy, round(sum(qz),6) as qz from {QSQL} group by frame", "points panels")
def prj01(spark, sf_dir):
    v = vectors(view(spark, sf_dir, "points"), view(spark, sf_dir, "panels"), 0.1, 1.3)
    return v.groupBy("frame").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 6).alias(c) for c in ("qx", "qy", "qz")))


@query("prj02_peaks_to_q_outer", f"select p.frame, count(*) as n, cast(count(*) - coalesce(max(g.n),0) as bigint) as off_panel from points p left join (select frame, count(*) as n from {PICKED} group by frame) g using (frame) group by p.frame", "points panels")
def prj02(spark, sf_dir):
    """Rows off every panel stay, without a vector."""
    v = vectors(view(spark, sf_dir, "points"), view(spark, sf_dir, "panels"), 0.1, 1.3, outer=True)
    return v.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("qx").isNull()).alias("off_panel"))


def project(q: DataFrame, panels: DataFrame, clen: float, wavelength: float) -> DataFrame:
    """Where forward rays meet a panel: the first that holds the pixel (axis-aligned
    panels); rays that miss all of them go."""
    rows = panel_rows(panels)
    # the ray's plane coordinates, the length of the ray cancels
    z = wavelength * F.col("qz") + 1
    at = lambda n: F.try_divide(wavelength * F.col(n), z) * clen * 10000.0
    # rows of one keep filters below from copying what makes the vectors
    ray = F.struct(at("qx").alias("x"), at("qy").alias("y"), z.alias("z"))
    rays = q.withColumn("_ray", F.explode(F.array(ray))).where("_ray.z > 1e-6")
    x, y = F.col("_ray.x"), F.col("_ray.y")
    on = lambda v, r, a, corner: (v - r[corner] + r[f"min_{a}"] >= r[f"min_{a}"]) & (v - r[corner] + r[f"min_{a}"] < r[f"max_{a}"] + 1)
    hit = [on(x, r, "fs", "corner_x") & on(y, r, "ss", "corner_y") for r in rows]
    placed = rays.withColumn("_place", first_of(hit)).where("_place is not null")
    of = lambda n: pick([r[n] for r in rows], "double", F.col("_place"))
    pixel = {"fs2": x - of("corner_x") + of("min_fs"), "ss2": y - of("corner_y") + of("min_ss")}
    return placed.withColumns(pixel).select(*q.columns, pick([r["ord"] for r in rows], "int", F.col("_place")).alias("ord"), "fs2", "ss2")


@query("prj03_project_q", f"select cast(ord as int) as ord, count(*) as n, round(sum(fs), 3) as fs, round(sum(ss), 3) as ss from (select n.ord, x-corner_x+min_fs as fs, y-corner_y+min_ss as ss, row_number() over (partition by rid order by n.ord) as r from (select row_number() over () as rid, 1.3*qx/(1.3*qz+1)*0.1*10000 as x, 1.3*qy/(1.3*qz+1)*0.1*10000 as y from {QSQL}) q join panels n on x-corner_x+min_fs >= min_fs and x-corner_x+min_fs < max_fs+1 and y-corner_y+min_ss >= min_ss and y-corner_y+min_ss < max_ss+1) where r = 1 group by ord", "points panels")
def prj03(spark, sf_dir):
    panels = view(spark, sf_dir, "panels")
    v = vectors(view(spark, sf_dir, "points"), panels, 0.1, 1.3).select("frame", "qx", "qy", "qz")
    return project(v, panels, 0.1, 1.3).groupBy("ord").agg(F.count("*").alias("n"), F.round(F.sum("fs2"), 3).alias("fs"), F.round(F.sum("ss2"), 3).alias("ss"))


def overlaps(panels: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (a, b) of panels of one detector, in their order, whose rectangles overlap: an equi join on the
    detector, whose panels are at most some hundreds."""
    a, b = panels.alias("a"), panels.alias("b")
    same = [F.col(f"a.{n}") == F.col(f"b.{n}") for n in by]
    meets = F.expr("a.ord < b.ord and a.min_fs <= b.max_fs and b.min_fs <= a.max_fs and a.min_ss <= b.max_ss and b.min_ss <= a.max_ss")
    return a.join(b, [*same, meets])


OVERLAP = "detectors x join detectors y on x.det = y.det and x.ord < y.ord where x.min_fs <= y.max_fs and y.min_fs <= x.max_fs and x.min_ss <= y.max_ss and y.min_ss <= x.max_ss"


@query("flt17_overlaps", f"select x.det, x.ord as ord, count(*) as later from {OVERLAP} group by 1, 2", "detectors")
def flt17(spark, sf_dir):
    """Panels of every detector that later ones overlap, so the detector has no slab without overlap."""
    return overlaps(view(spark, sf_dir, "detectors"), ["det"]).groupBy("a.det", "a.ord").agg(F.count("*").alias("later"))


@query("set02_slab_union", f"select slab_ss, count(*) as n from (select cast(floor(ss) as bigint) % 128 + 128*ord as slab_ss from {PICKED}) group by 1", "points panels")
def set02(spark, sf_dir):
    """Peaks of all panels in one slab: a row shift per panel."""
    p = with_panel(view(spark, sf_dir, "points"), view(spark, sf_dir, "panels"))
    return p.groupBy((F.floor("ss") % 128 + 128 * F.col("ord")).cast("long").alias("slab_ss")).agg(F.count("*").alias("n"))


@query("flt16_tile_seams", f"select frame, count(*) filter (seam) as at_seam, count(*) as n from (select frame, (floor(fs) % 64 < 2 or floor(fs) % 64 >= 62) or (floor(ss) % 32 < 2 or floor(ss) % 32 >= 30) as seam from points) group by frame", "points")
def flt16(spark, sf_dir):
    """Pixels within two of an interior tile seam (tiles of 64 x 32)."""
    x, y = F.floor("fs") % 64, F.floor("ss") % 32
    seam = (x < 2) | (x >= 62) | (y < 2) | (y >= 30)
    return view(spark, sf_dir, "points").groupBy("frame").agg(F.count_if(seam).alias("at_seam"), F.count("*").alias("n"))


@query("exp13_tile_caps", "select frame, count(*) as kept from (select frame, row_number() over (partition by frame, floor(fs/275), floor(ss/275) order by fs desc, ss desc, ok, ln, pk) as r from points) where r <= 5 group by frame", "points")
def exp13(spark, sf_dir):
    """At most five peaks of each tile of a frame."""
    w = Window.partitionBy("frame", F.floor(F.col("fs") / 275), F.floor(F.col("ss") / 275)).orderBy(F.desc("fs"), F.desc("ss"), "ok", "ln", "pk")
    return view(spark, sf_dir, "points").withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("frame").agg(F.count("*").alias("kept"))


@query("prj28_wavelength", "select event_id, round(12398.419843320026/(8000+value), 9) as wavelength from events")
def prj28(spark, sf_dir):
    """Wavelengths of the events' photon energies."""
    return table(spark, sf_dir, "events").select("event_id", F.round(L.wavelength_of_energy((8000 + F.col("value")).cast("double")), 9).alias("wavelength"))
