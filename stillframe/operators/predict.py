"""Lattice points, predicted reflections and line matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.functions.symmetry import unique_key
from stillframe.plans.registry import query, view


def grid(spark: SparkSession, limits: tuple[int, int, int]) -> DataFrame:
    """All h, k, l within +-limits but 0, 0, 0: generated in parallel from one range."""
    a, b, c = (2 * n + 1 for n in limits)
    i = F.col("id")
    g = spark.range(a * b * c).select((F.floor(i / (b * c)) - limits[0]).cast("int").alias("h"), (F.floor(i / c) % b - limits[1]).cast("int").alias("k"), (i % c - limits[2]).cast("int").alias("l"))
    return g.where("not (h = 0 and k = 0 and l = 0)")


def inside(g: DataFrame, a: float, b: float, c: float, qmax: float) -> DataFrame:
    """Points of an orthogonal cell within a sphere, with their vectors."""
    g = g.withColumns({"qx": F.col("h") / a, "qy": F.col("k") / b, "qz": F.col("l") / c})
    return g.withColumn("q", lin3.norm([F.col(n) for n in ("qx", "qy", "qz")])).where(F.col("q") <= qmax)


def reflections(bases: DataFrame, by: list[str], qmax: float) -> DataFrame:
    """by, h, k, l, qx, qy, qz, q: the lattice points of each basis (m, row by row, axes in columns) within a
    sphere.  Each basis spans its own box: an index is at most ``qmax`` times its axis."""
    axes = lin3.columns(lin3.matrix("m"))
    inverse = F.array(*lin3.inverse(lin3.matrix("m")))
    # the inverse stands in a column of the few rows before they are exploded, and is not written out again
    rows = bases.select(*by, inverse.alias("_inverse"), *(F.floor(qmax * lin3.norm(v)).cast("int").alias(f"_{n}") for n, v in zip("hkl", axes)))
    for n in "hkl":
        rows = rows.select("*", F.explode(F.sequence(-F.col(f"_{n}"), F.col(f"_{n}"))).alias(n)).drop(f"_{n}")
    q = lin3.times([F.col(n).cast("double") for n in "hkl"], lin3.matrix("_inverse"))
    at = rows.where("not (h = 0 and k = 0 and l = 0)").select(*by, "h", "k", "l", *(x.alias(n) for n, x in zip(("qx", "qy", "qz"), q)))
    return at.withColumn("q", lin3.norm([F.col(n) for n in ("qx", "qy", "qz")])).where(F.col("q") <= qmax)


def on_sphere(points: DataFrame, wavelength: float, tol: float) -> DataFrame:
    """Points within ``tol`` of the sphere of reflection, and how far: ``exc``."""
    return points.withColumn("exc", L.ewald_error([F.col(n) for n in ("qx", "qy", "qz")], wavelength)).where(F.abs("exc") < tol)


QMAX = 0.0801234
BASES = "(select distinct a, b, cast(c as double) as c from cells)"
NEAR = f"(select *, sqrt(qx*qx+qy*qy+qz*qz) as q from (select a, b, c, h, k, l, h/a as qx, k/b as qy, l/c as qz from {BASES}, (select unnest(range(-7,8)) as h), (select unnest(range(-7,8)) as k), (select unnest(range(-7,8)) as l) where not (h=0 and k=0 and l=0)) where sqrt(qx*qx+qy*qy+qz*qz) <= {QMAX})"
CELL_KEY = ["a", "b", "c"]


def points(spark, sf_dir) -> DataFrame:
    """Lattice points of every distinct cell of the table."""
    c = view(spark, sf_dir, "cells").select("a", "b", F.col("c").cast("double").alias("c")).distinct()
    zero = F.lit(0.0)
    m = F.array(F.col("a"), zero, zero, zero, F.col("b"), zero, zero, zero, F.col("c"))
    return reflections(c.withColumn("m", m), CELL_KEY, QMAX)


@query("prj38_lattice_points", f"select a, b, c, count(*) as n, cast(sum(abs(h)) as bigint) as h from {NEAR} group by a, b, c", "cells")
def prj38(spark, sf_dir):
    return points(spark, sf_dir).groupBy(*CELL_KEY).agg(F.count("*").alias("n"), F.sum(F.abs("h")).alias("h"))


FRAME_BASES = "(select distinct frame_id, ct, st from planted_q)"


@query("flt10_ewald", f"select frame_id, count(*) as n, cast(sum(h*h+k*k) as bigint) as hk, round(sum(abs(x)), 6) as exc from (select *, qz + 0.65*(qx*qx+qy*qy+qz*qz) as x from (select frame_id, h, k, l, h/cast(79 as double)*ct - k/cast(79 as double)*st as qx, h/cast(79 as double)*st + k/cast(79 as double)*ct as qy, l/cast(38 as double) as qz from {FRAME_BASES}, (select unnest(range(-9,10)) as h), (select unnest(range(-9,10)) as k), (select unnest(range(-5,6)) as l) where not (h=0 and k=0 and l=0))) where qx*qx+qy*qy+qz*qz <= 0.11*0.11 and abs(x) < 0.0041 group by frame_id", "planted_q")
def flt10(spark, sf_dir):
    """Reflections near the sphere of reflection, from every frame's own basis."""
    from stillframe.operators.acceptance import planted

    near = on_sphere(reflections(planted(spark, sf_dir).select("frame_id", "m").distinct(), ["frame_id"], 0.11), 1.3, 0.0041)
    return near.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum(F.col("h") * F.col("h") + F.col("k") * F.col("k")).cast("long").alias("hk"), F.round(F.sum(F.abs("exc")), 6).alias("exc"))


@query("flt11_centring", f"select a, b, c, count(*) as p, count(*) filter ((h+k+l)%2=0) as i, count(*) filter ((h+k)%2=0 and (h+l)%2=0 and (k+l)%2=0) as f, count(*) filter ((h+k)%2=0) as cc, count(*) filter ((k+l)%2=0) as ca, count(*) filter ((h+l)%2=0) as cb, count(*) filter ((-h+k+l)%3=0) as r from {NEAR} group by a, b, c", "cells")
def flt11(spark, sf_dir):
    """Points of every cell that each centring leaves."""
    h, k, l = F.col("h"), F.col("k"), F.col("l")
    names = {"P": "p", "I": "i", "F": "f", "C": "cc", "A": "ca", "B": "cb", "R": "r"}
    return points(spark, sf_dir).groupBy(*CELL_KEY).agg(*(F.count_if(L.centering_allows(h, k, l, c)).alias(n) for c, n in names.items()))


@query("agg07_theoretical_unique", f"select a, b, c, count(distinct abs(h)*100000000 + abs(k)*10000 + abs(l)) as n from {NEAR} group by a, b, c", "cells")
def agg07(spark, sf_dir):
    """Unique reflections of every cell to a resolution."""
    return points(spark, sf_dir).groupBy(*CELL_KEY).agg(F.count_distinct(unique_key(F.col("h"), F.col("k"), F.col("l"), "mmm")).alias("n"))


@query("prj37_shells", f"select a, b, c, count(distinct round(q, 5)) as shells from {NEAR} group by a, b, c", "cells")
def prj37(spark, sf_dir):
    """Distinct radii of every cell's lattice points."""
    return points(spark, sf_dir).groupBy(*CELL_KEY).agg(F.count_distinct(F.round("q", 5)).alias("shells"))


#: The rings of one known cell, which peaks are compared with.
SHELLS = "(select distinct round(q, 4) as r from (select sqrt(qx*qx+qy*qy+qz*qz) as q from (select h/cast(79 as double) as qx, k/cast(79 as double) as qy, l/cast(38 as double) as qz from (select unnest(range(-20,21)) as h) a, (select unnest(range(-20,21)) as k) b, (select unnest(range(-10,11)) as l) c where not (h=0 and k=0 and l=0))) where q <= 0.25)"


def shells(spark: SparkSession) -> DataFrame:
    return inside(grid(spark, (20, 20, 10)), 79.0, 79.0, 38.0, 0.25).select(F.round("q", 4).alias("r")).distinct()


def nearest(left: DataFrame, x: str, right: DataFrame, y: str, step: float) -> DataFrame:
    """As-of join to the nearest ``y`` (ties: the smaller), without a nested loop.

    Both sides are dealt into cells of ``step``.  A row a cell, whose number follows the range of
    the values, holds the cell's own values and the nearest below and above it, carried across
    empty cells; left rows meet that row alone.
    """
    r = right.select(F.col(y).cast("double").alias("_y"), F.floor(F.col(y) / step).cast("long").alias("_cell")).distinct()
    bounds = r.groupBy("_cell").agg(F.min("_y").alias("_low"), F.max("_y").alias("_high"), F.array_sort(F.collect_list("_y")).alias("_in"))
    l = left.withColumn("_cell", F.floor(F.col(x) / step).cast("long"))
    span = Window.orderBy("_cell")  # a row a cell
    own = l.select("_cell").distinct().join(bounds, "_cell", "full")
    before, after = F.last("_high", True).over(span.rowsBetween(Window.unboundedPreceding, -1)), F.first("_low", True).over(span.rowsBetween(1, Window.unboundedFollowing))
    table = own.select("_cell", F.array_compact(F.concat(F.array(before), F.coalesce("_in", F.array().cast("array<double>")), F.array(after))).alias("_near"))
    best = F.array_min(F.transform("_near", lambda v: F.struct(F.abs(v - F.col(x)).alias("d"), v.alias("v"))))
    return l.join(table, "_cell").withColumn("_best", best).withColumns({"nearest": F.col("_best.v"), "distance": F.col("_best.d")}).drop("_cell", "_near", "_best")


@query("join06_nearest_shell", f"select cast(floor(d*20000) as bigint) as bin, count(*) as n from (select p.id, min(abs(p.x - s.r)) as d from (select row_number() over () as id, cast((l_partkey*7 + l_suppkey*13) % 2500 as double)/10000 as x from lineitem) p, {SHELLS} s group by p.id) group by 1")
def join06(spark, sf_dir):
    """Distance of radii from the nearest allowed shell."""
    from stillframe.plans.registry import table

    x = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 2500 / 10000.0).alias("x"))
    m = nearest(x, "x", shells(spark), "r", 0.0005)
    return m.groupBy(F.floor(F.col("distance") * 20000).alias("bin")).agg(F.count("*").alias("n"))


@query("flt15_ring_mask", f"select count(*) as n, count(*) filter (d < 0.0002) as on_ring from (select p.id, min(abs(p.x - s.r)) as d from (select row_number() over () as id, cast((l_partkey*7 + l_suppkey*13) % 2500 as double)/10000 as x from lineitem) p, {SHELLS} s group by p.id)")
def flt15(spark, sf_dir):
    from stillframe.plans.registry import table

    x = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 2500 / 10000.0).alias("x"))
    return nearest(x, "x", shells(spark), "r", 0.0005).agg(F.count("*").alias("n"), F.count_if(F.col("distance") < 0.0002).alias("on_ring"))


@query("prj06_cell_round_trip", "select frame_id, hyp_id, round(a, 6) as a, round(b, 6) as b, round(c, 6) as c, cast(round(85 + hyp_id % 20, 6) as double) as al, cast(95 as double) as be, cast(round(100 + hyp_id % 7, 6) as double) as ga from cells", "cells")
def prj06(spark, sf_dir):
    """Cell to basis and back."""
    c = view(spark, sf_dir, "cells")
    al, be, ga = (85 + F.col("hyp_id") % 20).cast("double"), F.lit(95.0), (100 + F.col("hyp_id") % 7).cast("double")
    m = L.basis_of_cell(F.col("a"), F.col("b"), F.col("c").cast("double"), al, be, ga)
    c = c.select("frame_id", "hyp_id", F.array(*m).alias("m"))
    return c.select("frame_id", "hyp_id", *(F.round(x, 6).alias(n) for x, n in zip(L.cell_of_basis(lin3.matrix("m")), ("a", "b", "c", "al", "be", "ga"))))


@query("prj05_reciprocal", "select hyp_id, round(1/a, 9) as astar, round(1/b, 9) as bstar, round(1/c, 9) as cstar, round(a*b*c, 6) as volume from cells", "cells")
def prj05(spark, sf_dir):
    zero = F.lit(0.0)
    m = [F.col("a"), zero, zero, zero, F.col("b"), zero, zero, zero, F.col("c").cast("double")]
    inv = lin3.inverse(m)
    return view(spark, sf_dir, "cells").select("hyp_id", *(F.round(lin3.norm(inv[3 * i : 3 * i + 3]), 9).alias(n) for i, n in enumerate(("astar", "bstar", "cstar"))), F.round(lin3.det(m), 6).alias("volume"))


@query("prj27_inverse_d2", "select unit, round(sum(case unit when 'q' then x*x when 'd' then 1/(x*x) else (2*sin(radians(x*10)/2)/1.54)*(2*sin(radians(x*10)/2)/1.54) end), 6) as total from (select cast(1 + l_linenumber as double)/4 as x, case l_partkey % 3 when 0 then 'q' when 1 then 'd' else '2theta' end as unit from lineitem) group by unit")
def prj27(spark, sf_dir):
    """Line positions in three units as 1 / d squared."""
    from stillframe.plans.registry import table

    p = table(spark, sf_dir, "lineitem").select(((1 + F.col("l_linenumber")).cast("double") / 4).alias("x"), F.when(F.col("l_partkey") % 3 == 0, "q").when(F.col("l_partkey") % 3 == 1, "d").otherwise("2theta").alias("unit"))
    s = 2 * F.sin(F.radians(F.col("x") * 10) / 2) / 1.54
    v = F.when(F.col("unit") == "q", F.col("x") ** 2).when(F.col("unit") == "d", 1 / (F.col("x") ** 2)).otherwise(s * s)
    return p.groupBy("unit").agg(F.round(F.sum(v), 6).alias("total"))


def figure_of_merit(observed: DataFrame, calculated: DataFrame, by: list[str], lines: int = 20) -> DataFrame:
    """by, m20, n: M = Q_N / (2 max(mean |dQ|, 1e-4 Q_N) N_distinct) over the first ``lines`` lines (the figure's
    own number) of each value of ``by``.

    ``observed`` has by and qo, ``calculated`` qc: the lines of one cell, some thousands at most, of which
    one row a distinct line is counted.  A value of ``by`` without lines has no row.
    """
    first = Window.partitionBy(*by).orderBy("qo")
    o = observed.withColumn("_line", F.row_number().over(first)).where(F.col("_line") <= lines)
    m = nearest(o, "qo", calculated, "qc", 0.001).groupBy(*by).agg(F.max("qo").alias("qn"), F.avg("distance").alias("dq"))
    all_lines = F.broadcast(calculated.groupBy(F.round("qc", 6).alias("r")).agg(F.min("qc").alias("qc")).agg(F.array_sort(F.collect_list("qc")).alias("_all")))  # one row
    one = m.crossJoin(all_lines).withColumn("n", F.size(F.filter("_all", lambda x: x <= F.col("qn"))).cast("long"))
    return one.select(*by, F.round(F.try_divide(F.col("qn"), 2 * F.greatest(F.col("dq"), 1e-4 * F.col("qn")) * F.col("n")), 4).alias("m20"), "n")


CALC = "(select distinct (h*h+k*k)/cast(6241 as double) + l*l/cast(1444 as double) as qc from (select unnest(range(0,8)) as h) a, (select unnest(range(0,8)) as k) b, (select unnest(range(0,5)) as l) c where h+k+l > 0)"
OBS = "(select frame_id, qo from (select frame_id, qo, row_number() over (partition by frame_id order by qo) as r from (select distinct frame_id, round(qx*qx+qy*qy+qz*qz, 7) as qo from planted_q) where qo > 0.0001) where r <= 20)"


@query("agg34_m20", f", o as {OBS}, c as {CALC}, d as (select frame_id, max(qo) as qn, avg(x) as dq from (select frame_id, qo, min(abs(qo-qc)) as x from o, c group by 1, 2) group by 1), n as (select frame_id, count(*) as n from d, (select min(qc) as qc from c group by round(qc, 6)) u where u.qc <= d.qn group by 1) select frame_id, round(qn/(2*greatest(dq, 0.0001*qn)*n), 4) as m20, n from d join n using (frame_id)", "planted_q")
def agg34(spark, sf_dir):
    """The figure of merit of the known cell on the first twenty lines of every frame."""
    g = grid(spark, (7, 7, 4)).where("h >= 0 and k >= 0 and l >= 0")
    calc = g.select(((F.col("h") ** 2 + F.col("k") ** 2) / 6241.0 + F.col("l") ** 2 / 1444.0).alias("qc")).distinct()
    q = [F.col(n) for n in ("qx", "qy", "qz")]
    lines = view(spark, sf_dir, "planted_q").select("frame_id", F.round(lin3.dot(q, q), 7).alias("qo")).distinct().where("qo > 0.0001")
    return figure_of_merit(lines, calc, ["frame_id"])
