"""Text formats and small expressions by round trips: what is written is read again and must be the
tables it was made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.operators.acceptance import COUNTS, INDEXED, MISS, Q, planted, planted_counts
from stillframe.operators.geometry import OVERLAP, PICKED, overlaps, with_panel
from stillframe.plans.registry import query, table, view
from stillframe.plans.shared import checkpoint, shared_folder
from stillframe.sinks import text as sink
from stillframe.sources import text as source


def kept(spark: SparkSession, blocks: DataFrame, header: str | None = None) -> str:
    """Writes (serial, value) blocks below the shared folder and says where.  They are computed once: ranges are
    found from a first look at all of them."""
    path = f"{shared_folder(spark)}/text"
    sink.write_ordered(checkpoint(blocks), path, header)
    return path


@query("src04_frame_blocks", "select frame_id, count(*) as n, true as same from planted_q group by frame_id", "planted_q")
def src04(spark, sf_dir):
    """Frames written as blocks of vectors and read again: sums agree to the digits that are written."""
    p = view(spark, sf_dir, "planted_q").withColumn("peak_id", F.struct("pk", "ok", "ln"))
    back = source.read_frames(spark, kept(spark, sink.frame_blocks(p)))
    sums = lambda d, t: d.groupBy("frame_id").agg(F.count("*").alias(f"{t}n"), *(F.sum(c).alias(f"{t}{c}") for c in Q))
    both = sums(back, "a").join(sums(p, "b"), "frame_id")
    off = F.greatest(*(F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in Q))
    return both.select("frame_id", F.col("an").alias("n"), ((F.col("an") == F.col("bn")) & (off <= 1e-8 * F.col("bn"))).alias("same"))


@query("snk06_frame_blocks", "select frame_id, 'FRAME ' || frame_id || ' ' || count(*) as head from planted_q group by frame_id", "planted_q")
def snk06(spark, sf_dir):
    p = view(spark, sf_dir, "planted_q").withColumn("peak_id", F.struct("pk", "ok", "ln"))
    return sink.frame_blocks(p).select(F.col("serial").alias("frame_id"), F.substring_index("value", "\n", 1).alias("head"))


def results(spark, sf_dir) -> DataFrame:
    """A result a frame: the planted basis, none for every seventh."""
    p = planted(spark, sf_dir).groupBy("frame_id").agg(F.first("m").alias("m"))
    return p.select(F.col("frame_id").alias("serial"), F.format_string("run%d.h5", F.col("frame_id") % 3).alias("image"), (F.col("frame_id") % 100).alias("event"), F.when(F.col("frame_id") % 7 != 0, F.col("m")).alias("m"))


@query("src11_bases", "select frame_id, frame_id % 7 = 0 as missing, case when frame_id % 7 <> 0 then round(79*any_value(ct), 4) end as m0, case when frame_id % 7 <> 0 then round(38.0, 4)::double end as m8 from planted_q group by frame_id", "planted_q")
def src11(spark, sf_dir):
    """Lists of bases, one line a frame (axes one after another) or NONE."""
    r = results(spark, sf_dir)
    m = [F.col("m")[3 * (i % 3) + i // 3] for i in range(9)]
    line = F.when(F.col("m").isNotNull(), F.concat_ws(" ", F.col("serial").cast("string"), *(F.format_string("%.8f", x) for x in m))).otherwise(F.concat(F.col("serial").cast("string"), F.lit(" NONE")))
    back = source.read_bases(spark, kept(spark, r.select("serial", line.alias("value"))))
    return back.select("frame_id", F.col("m").isNull().alias("missing"), F.round(F.col("m")[0], 4).alias("m0"), F.round(F.col("m")[8], 4).alias("m8"))


def geometry_texts(detectors: DataFrame) -> DataFrame:
    """(det, text): a geometry text a detector, with two defaults for the resolution, own ones, a mask, and
    panels without a bound."""
    number = lambda c: F.format_string("%.3f", c)
    keys = {n: F.format_string("%d", F.col(n).cast("long")) for n in ("min_fs", "max_fs", "min_ss")}
    keys |= {n: number(F.col(n)) for n in ("corner_x", "corner_y")}
    keys["max_ss"] = F.when(F.col("size") % 11 != 5, F.format_string("%d ; the last row", F.col("max_ss").cast("long")))
    keys["fs"] = F.format_string("%.3fx %+.3fy", "fsx", "fsy")
    keys["ss"] = F.when(F.col("size") % 2 == 0, "-x").otherwise("y")
    keys["res"] = F.when(F.col("size") % 3 == 0, F.format_string("%d", 5000 + F.col("size")))
    keys["dim0"] = F.when(F.col("size") % 4 < 2, "%")
    keys["dim1"] = F.when(F.col("size") % 4 == 1, "ss")
    lines = F.array_compact(F.array(*(F.concat(F.format_string("p%d/", "ord"), F.lit(f"{k} = "), v) for k, v in keys.items())))
    block = F.concat(F.when(F.col("ord") == F.min("ord").over(Window.partitionBy("det", F.col("ord") < 8)), F.when(F.col("ord") < 8, F.format_string("res = %d\n", 4000 + 100 * (F.col("det") % 7))).otherwise(F.lit("res = 8000\n"))).otherwise(F.lit("")), F.array_join(lines, "\n"))
    parts = detectors.select("det", "ord", block.alias("block")).groupBy("det").agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("b"))
    return parts.select("det", F.concat(F.lit("clen = 0.1 ; metres\nbadstop/min_fs = 3\n"), F.array_join("b.block", "\n"), F.lit("\nbadstop/max_fs = 9\n")).alias("text"))


@query("src01_geometry", "select det, cast(row_number() over (partition by det order by ord)-1 as int) as ord, concat('p', cast(ord as varchar)) as panel, max_fs, max_ss, corner_x, fsx, fsy, cast(case when size % 2 = 0 then -1 else 0 end as double) as ssx, cast(case when size % 3 = 0 then 5000 + size when ord < 8 then 4000 + 100*(det % 7) else 8000 end as double) as res, cast('0.1' as double) as clen from detectors where size % 11 <> 5", "detectors")
def src01(spark, sf_dir):
    """Panels of every detector's geometry text: defaults by their place, overrides, comments, masks and
    blocks without bounds, which are left out."""
    panels = source.parse_geometry(geometry_texts(view(spark, sf_dir, "detectors")), ["det"])
    zero = lambda n: (F.col(n) + 0.0).alias(n)
    return panels.select("det", "ord", "panel", "max_fs", "max_ss", "corner_x", zero("fsx"), zero("fsy"), zero("ssx"), "res", "clen")


@query("src02_geometry_dims", "select det, concat('p', cast(ord as varchar)) as panel, cast(case size % 4 when 0 then 1 when 1 then 2 else 0 end as int) as dims, cast(case when size % 4 < 2 then 1 else 0 end as int) as event_dims from detectors where size % 11 <> 5", "detectors")
def src02(spark, sf_dir):
    """The second schema of the geometries: panels with the axes of their stored arrays, from the same
    texts."""
    texts = geometry_texts(view(spark, sf_dir, "detectors"))
    axes = source.slab_axes(texts, ["det"])
    return source.parse_geometry(texts, ["det"]).select("det", "panel").join(axes, ["det", "panel"], "left").select("det", "panel", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("dims", "event_dims")))


@query("src03_stream_peaks", f"select frame_id, count(*) as n, round(sum(round(qx*1000, 2)), 2) as fs, round(sum(round(qy*1000, 2)), 2) as ss from planted_q group by frame_id", "planted_q")
def src03(spark, sf_dir):
    """Peak lists of stream chunks, written and read again."""
    p = view(spark, sf_dir, "planted_q")
    line = F.format_string("%10.2f %10.2f %8.3f %10.1f q0", F.round(F.col("qx") * 1000, 2), F.round(F.col("qy") * 1000, 2), F.lit(1.0), F.lit(5.0))
    rows = p.groupBy("frame_id").agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    value = F.concat(F.format_string("----- Begin chunk -----\nImage filename: a.h5\nEvent: //%d\nPeaks from peak search\n  fs/px   ss/px (1/d)/nm^-1   Intensity  Panel\n", "frame_id"), "rows", F.lit("\nEnd of peak list\n----- End chunk -----"))
    back = source.read_peaks(spark, kept(spark, rows.select(F.col("frame_id").alias("serial"), value.alias("value")), sink.HEADER))
    return back.groupBy(source.event_number(F.col("event")).alias("frame_id")).agg(F.count("*").alias("n"), F.round(F.sum("fs"), 2).alias("fs"), F.round(F.sum("ss"), 2).alias("ss"))


@query("src08_event_numbers", "select event_id, user_id as number from events")
def src08(spark, sf_dir):
    """Trailing integers of event names."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.col("event_type"), F.lit("-7//"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/").otherwise(""))
    return e.select("event_id", source.event_number(name).alias("number"))


def meta(value: Column, default: Column) -> Column:
    """A number from a file's own metadata, or the default if it is absent or none."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


@query("src09_metadata", "select event_id, case when event_id % 5 = 0 then cast(9500 as double) when event_id % 5 = 1 then cast(9500 as double) else value + 9000 end as energy from events")
def src09(spark, sf_dir):
    """Photon energies of events, some absent, some no number."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, "LCLS:ebeam").otherwise((F.col("value") + 9000).cast("string"))
    return e.select("event_id", meta(raw, F.lit(9500.0)).alias("energy"))


CHUNKS = "(select frame_id, frame_id % 7 <> 0 as ok_, any_value(ct) as ct, any_value(st) as st from planted_q group by frame_id)"


@query("snk01_stream_chunks", f"select frame_id as serial, ok_ as indexed, case when ok_ then 'Cell parameters 7.90000 7.90000 3.80000 nm, 90.00000 90.00000 90.00000 deg' else '' end as cell, 'run' || (frame_id % 3) || '.h5' as image from {CHUNKS}", "planted_q")
def snk01(spark, sf_dir):
    """Chunks of all results, written as a stream and read again."""
    back = source.read_chunks(spark, kept(spark, sink.stream_chunks(results(spark, sf_dir)), sink.HEADER))
    body = F.col("body")
    serial = F.regexp_extract(body, r"Image serial number: (\d+)", 1).cast("long") - 1
    return back.select(serial.alias("serial"), F.contains(body, F.lit("indexed_by = stillframe")).alias("indexed"), F.regexp_extract(body, r"(Cell parameters .*deg)", 1).alias("cell"), "image")


@query("snk02_integrated_chunks", "select frame as serial, count(*) as n, cast(sum(h) as bigint) as h, round(sum(i), 2) as i from (select frame, h, k, l, floor(cast(i as double))/100 as i from measurements where frame % 7 <> 0) group by frame", "measurements")
def snk02(spark, sf_dir):
    """Chunks with their reflections: the tables come back from the text."""
    m = view(spark, sf_dir, "measurements")
    refl = m.select(F.col("frame").alias("serial"), "h", "k", "l", (F.floor(F.col("i").cast("double")) / 100).alias("i"), (F.col("sigma").cast("double") / 100).alias("sigma"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("bg"), F.lit(2.5).alias("fs"), F.lit(3.5).alias("ss"), F.lit("q0").alias("panel"))
    back = source.read_chunks(spark, kept(spark, sink.stream_chunks(results(spark, sf_dir), refl), sink.HEADER))
    part = F.substring_index(F.substring_index("body", "fs/px  ss/px panel\n", -1), "\nEnd of reflections", 1)
    serial = F.regexp_extract("body", r"Image serial number: (\d+)", 1).cast("long") - 1
    rows = back.where(F.contains("body", F.lit("Reflections measured"))).select(serial.alias("serial"), F.explode(F.split(part, "\n")).alias("line"))
    x = F.split(F.trim("line"), r"\s+")
    rows = rows.select("serial", x[0].cast("long").alias("h"), x[3].cast("double").alias("i"))
    return rows.groupBy("serial").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.round(F.sum("i"), 2).alias("i"))


@query("snk05_solution_lines", f"select count(*) as n, count(*) filter (true) as with_code, round(sum(10*ct/79), 4) as a0 from {CHUNKS} where ok_", "planted_q")
def snk05(spark, sf_dir):
    """One line a solved frame, with its reciprocal cell."""
    lines = spark.read.text(kept(spark, sink.orientations(results(spark, sf_dir), "tPc")))
    x = F.split(F.trim("value"), r"\s+")
    return lines.agg(F.count("*").alias("n"), F.count_if(F.endswith("value", F.lit("tPc"))).alias("with_code"), F.round(F.sum(x[2].cast("double")), 4).alias("a0"))


@query("snk07_concat", f"select count(*) as n, 2*(select max(frame_id) from {CHUNKS}) + 1 as last from {CHUNKS}, (select unnest([1,2]) as k)", "planted_q")
def snk07(spark, sf_dir):
    """Two parts behind each other: serials follow on."""
    c = sink.stream_chunks(results(spark, sf_dir))
    return sink.concat_streams([c, c]).agg(F.count("*").alias("n"), F.max("serial").alias("last"))


@query("snk08_gate_results", f"select frame_id, n_matched >= 10 and n_matched >= 0.25*n_peaks and frame_id % 3 <> 0 as stays, not (n_matched >= 10 and n_matched >= 0.25*n_peaks) and frame_id % 3 <> 0 as withdrawn from {COUNTS}", "planted_q")
def snk08(spark, sf_dir):
    """Results withdrawn by the strict gate on their own peaks."""
    from stillframe.operators.perframe import gate

    p = planted(spark, sf_dir)
    r = p.groupBy("frame_id").agg(F.first("m").alias("m")).withColumn("m", F.when(F.col("frame_id") % 3 != 0, F.col("m")))
    return gate(r, p).select("frame_id", F.col("m").isNotNull().alias("stays"), "withdrawn")


@query("snk11_cell_table", "select frame_id as cell_id, count(*) as n, round(min(a), 3) as a from cells group by frame_id", "cells")
def snk11(spark, sf_dir):
    """The registry's snapshot as JSON texts, read again."""
    c = view(spark, sf_dir, "cells").groupBy(F.col("frame_id").alias("cell_id")).agg(F.count("*").alias("n"), F.min("a").alias("a"))
    j = F.from_json("value", "cell_id long, n long, a double")
    return sink.registry_json(c).select(j.alias("j")).select("j.cell_id", "j.n", F.round("j.a", 3).alias("a"))


@query("pip24_cell_lines", f"select frame_id as serial, ok_ as has_block from {CHUNKS}", "planted_q")
def pip24(spark, sf_dir):
    """Cell blocks: the reciprocal axes times the basis are the unit matrix."""
    r = results(spark, sf_dir).withColumn("block", sink.cell_block())
    axes = [[F.regexp_extract("block", rf"{n}star = (\S+) (\S+) (\S+) nm", i).try_cast("double") / 10 for i in (1, 2, 3)] for n in "abc"]
    unit = [lin3.times(a, lin3.matrix("m")) for a in axes]
    far = F.greatest(*(F.abs(x - (1.0 if i == j else 0.0)) for i, row in enumerate(unit) for j, x in enumerate(row)))
    return r.select("serial", F.coalesce(far < 1e-4, F.lit(False)).alias("has_block"))


@query("prj07_cell_parameters", "select hyp_id, round(a, 6) as a, round(sqrt(b*b + 0.04*a*a), 6) as b, round(degrees(acos(0.2*a/sqrt(b*b + 0.04*a*a))), 6) as gamma from cells", "cells")
def prj07(spark, sf_dir):
    """Lengths and angles of sheared cells."""
    a, b, c, zero = F.col("a"), F.col("b"), F.col("c").cast("double"), F.lit(0.0)
    p = L.cell_of_basis([a, a * 0.2, zero, zero, b, zero, zero, zero, c])
    return view(spark, sf_dir, "cells").select("hyp_id", F.round(p[0], 6).alias("a"), F.round(p[1], 6).alias("b"), F.round(p[5], 6).alias("gamma"))


@query("prj19_profile_width", "select frame_id, round(sum(sqrt((q*0.001)*(q*0.001) + (q*q*1.3*0.002/2)*(q*q*1.3*0.002/2) + 1e-8)), 8) as width from (select frame_id, sqrt(qx*qx+qy*qy+qz*qz) as q from planted_q) group by frame_id", "planted_q")
def prj19(spark, sf_dir):
    q = lin3.norm([F.col(c) for c in Q])
    return view(spark, sf_dir, "planted_q").groupBy("frame_id").agg(F.round(F.sum(L.sigma_p(q, 0.002, 0.002, 1e-4, 1.3)), 8).alias("width"))


@query("prj23_chance_floor", "select frame_id, round(0.0224*count(*) + 5.32 + 1.211*sqrt(cast(count(*) as double)), 6) as live, round(0.0246*count(*) + 5.39 + 1.188*sqrt(cast(count(*) as double)), 6) as batch from planted_q group by frame_id", "planted_q")
def prj23(spark, sf_dir):
    c = view(spark, sf_dir, "planted_q").groupBy("frame_id").agg(F.count("*").alias("n"))
    return c.select("frame_id", F.round(L.chance_floor(F.col("n"), "live"), 6).alias("live"), F.round(L.chance_floor(F.col("n")), 6).alias("batch"))


def erf(x: Column) -> Column:
    """The error function of numbers from zero on, to 2e-7, by a rational form; stays in SQL."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - poly * F.exp(-x * x)


def band_weight(q: Column, rise: float = 0.02, top: float = 0.3) -> Column:
    """Band-pass weight of a vector's length with squared error-function edges."""
    low, high = erf(q / rise), erf(F.greatest(q - top, F.lit(0.0)) / rise)
    return low * low * (1 - high * high)


_T = "1/(1+0.3275911*{x})"
_ERF = "(1 - ({t})*(0.254829592+({t})*(-0.284496736+({t})*(1.421413741+({t})*(-1.453152027+({t})*1.061405429))))*exp(-({x})*({x})))"


def _erf_sql(x: str) -> str:
    return _ERF.replace("{t}", _T.replace("{x}", f"({x})")).replace("{x}", x)


@query("prj21_band_weights", f"select frame_id, round(sum(lo*lo*(1-hi*hi)), 4) as weight from (select frame_id, {_erf_sql('q/0.02')} as lo, {_erf_sql('greatest(q-0.3,0)/0.02')} as hi from (select frame_id, sqrt(qx*qx+qy*qy+qz*qz) as q from planted_q)) group by frame_id", "planted_q")
def prj21(spark, sf_dir):
    w = band_weight(lin3.norm([F.col(c) for c in Q]))
    return view(spark, sf_dir, "planted_q").groupBy("frame_id").agg(F.round(F.sum(w), 4).alias("weight"))


@query("prj25_slab_peaks", f"select cast(floor(ss) as bigint) + 1200*ord as slab_ss, count(*) as n from {PICKED} group by 1", "points panels")
def prj25(spark, sf_dir):
    """Peaks in the coordinates of one slab, a panel below the other with room between."""
    p = with_panel(view(spark, sf_dir, "points"), view(spark, sf_dir, "panels"))
    return p.groupBy((F.floor("ss") + 1200 * F.col("ord")).alias("slab_ss")).agg(F.count("*").alias("n"))


FORMS = """(select idx, count(*) as n, sum(x*x) as s1, sum(d*d + p*p) as s2, sum(e*e + q*q + r*r) as s3
    from (select idx, x, d, cast(idx/(x*d) as int) as e from (select unnest(range(1, 7)) as idx), (select unnest(range(1, 7)) as x), (select unnest(range(1, 7)) as d) where x*d <= idx and idx % (x*d) = 0),
         (select unnest(range(0, 6)) as p), (select unnest(range(0, 6)) as q), (select unnest(range(0, 6)) as r) where p < d and q < e and r < e group by idx)"""


def sublattices(bases: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, idx, form, m: every sublattice of each basis (m, row by row, axes in columns) up to an index, each
    once: its axes are the rows of a Hermite form times the basis's axes.  The forms are constants of the
    plan, 178 of them to index six."""
    from stillframe.kernels.reduction import hermite_forms

    forms = F.array(*(F.struct(F.lit(i).alias("idx"), F.array(*(F.lit(int(x)) for x in h.ravel())).alias("h")) for i in range(1, most + 1) for h in hermite_forms(i)))
    rows = bases.select(*by, "m", F.posexplode(forms).alias("form", "f"))
    axes = [[F.col("m")[3 * r + k] for r in range(3)] for k in range(3)]
    new = lambda j, r: sum((F.col("f.h")[3 * j + k] * axes[k][r] for k in range(1, 3)), F.col("f.h")[3 * j] * axes[0][r])
    return rows.select(*by, F.col("f.idx").alias("idx"), "form", F.array(*(new(j, r) for r in range(3) for j in range(3))).alias("m"))


@query("prj34_hermite_forms", f"select hyp_id, cast(idx as int) as idx, n, round(n*idx*a*b*c, 2) as volume, round(s1*a*a + s2*b*b + s3*c*c, 2) as edges from cells, {FORMS}", "cells")
def prj34(spark, sf_dir):
    """Sublattices of every cell to index six: how many, their volumes and squared edges; the twin
    counts forms by their factors."""
    zero = F.lit(0.0)
    c = view(spark, sf_dir, "cells").select("hyp_id", F.array("a", zero, zero, zero, "b", zero, zero, zero, F.col("c").cast("double")).alias("m"))
    m = lin3.matrix("m")
    s = sublattices(c, ["hyp_id"], 6).select("hyp_id", "idx", lin3.det(m).alias("v"), sum((lin3.dot(x, x) for x in lin3.columns(m)), zero).alias("e"))
    return s.groupBy("hyp_id", "idx").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("volume"), F.round(F.sum("e"), 2).alias("edges"))


@query("flt04_matched", f"select frame_id, count(*) filter ({MISS} < 0.15) as strict, count(*) filter ({MISS} < 0.10) as tight, count(*) filter ({MISS} < 0.25) as loose from {INDEXED} group by frame_id", "planted_q")
def flt04(spark, sf_dir):
    """Matches at several tolerances."""
    d = L.miss(L.fractional([F.col(c) for c in Q], lin3.matrix("m")))
    return planted(spark, sf_dir).groupBy("frame_id").agg(*(F.count_if(d < t).alias(n) for n, t in (("strict", 0.15), ("tight", 0.10), ("loose", 0.25))))


@query("flt14_off_frame", "select frame, count(*) as n, count(*) filter (i <> 0) as kept from (select frame, case when l > 1 then 0 else i end as i from measurements) group by frame", "measurements")
def flt14(spark, sf_dir):
    """Boxes off the frame measure exactly nothing and go."""
    i = F.when(F.col("l") > 1, 0.0).otherwise(F.col("i").cast("double"))
    return view(spark, sf_dir, "measurements").groupBy("frame").agg(F.count("*").alias("n"), F.count_if(i != 0.0).alias("kept"))


@query("join09_rectangle_overlap", f"select x.det, x.ord as left_ord, y.ord as right_ord, cast((least(x.max_fs,y.max_fs)-greatest(x.min_fs,y.min_fs)+1)*(least(x.max_ss,y.max_ss)-greatest(x.min_ss,y.min_ss)+1) as bigint) as area from {OVERLAP}", "detectors")
def join09(spark, sf_dir):
    """Overlapping panels of each detector and the pixels they share."""
    side = lambda n: F.expr(f"least(a.max_{n}, b.max_{n}) - greatest(a.min_{n}, b.min_{n}) + 1")
    return overlaps(view(spark, sf_dir, "detectors"), ["det"]).select(F.col("a.det").alias("det"), F.col("a.ord").alias("left_ord"), F.col("b.ord").alias("right_ord"), (side("fs") * side("ss")).cast("long").alias("area"))


@query("set04_residual", f"select frame_id, count(*) as n, round(sum(qx*qx+qy*qy+qz*qz), 6) as q2 from {INDEXED} where not {MISS} < 0.15 group by frame_id", "planted_q")
def set04(spark, sf_dir):
    """What a lattice leaves of each frame."""
    q = [F.col(c) for c in Q]
    left = planted(spark, sf_dir).where(~L.is_inlier(q, lin3.matrix("m")))
    return left.groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum(lin3.dot(q, q)), 6).alias("q2"))


@query("exp01_strict_gate", f"select frame_id, n_matched, round(cast(n_matched as double)/n_peaks, 6) as share, frame_id % 5 <> 2 and n_matched >= 10 and n_matched >= 0.25*n_peaks as ok_ from {COUNTS}", "planted_q")
def exp01(spark, sf_dir):
    """The published gate against a reference lattice: lattice, matches, share."""
    from stillframe.operators.reports import lattice_match, product

    p = planted(spark, sf_dir)
    g = planted_counts(spark, sf_dir)
    u = F.when(F.col("frame_id") % 5 == 2, F.expr("array(2D,0D,0D,0D,1D,0D,0D,0D,1D)")).otherwise(F.expr("array(1D,0D,0D,0D,1D,0D,0D,0D,1D)"))
    found = p.groupBy("frame_id").agg(F.first("m").alias("m")).withColumn("u", u)
    found = found.select("frame_id", lattice_match(lin3.matrix("m"), product(lin3.matrix("m"), lin3.matrix("u"))).alias("same"))
    return g.join(found, "frame_id").select("frame_id", "n_matched", F.round(F.col("n_matched") / F.col("n_peaks"), 6).alias("share"), (F.col("same") & L.strict(F.col("n_matched"), F.col("n_peaks"))).alias("ok_"))


def calibrated(pixels: DataFrame, planes: DataFrame) -> DataFrame:
    """Pixels with ``kev``: the pedestal and gain of their stage (planes: stage, pedestal, gain; a
    few rows), stage bits cut off; an unknown stage gives null."""
    raw = F.col("adu").cast("int")
    p = pixels.withColumns({"stage": F.shiftright(raw, 14), "value": raw.bitwiseAND(0x3FFF)})
    return p.join(F.broadcast(planes), "stage", "left").withColumn("kev", (F.col("value") - F.col("pedestal")) * F.col("gain"))


STAGES = [(0, 10.0, 0.5), (1, 4.0, 12.0), (3, 2.0, 150.0)]


@query("pip10_gain_stages", "select frame, stage, count(*) as n, round(sum(case stage when 0 then (v-10)*0.5 when 1 then (v-4)*12 when 3 then (v-2)*150 end), 4) as kev from (select frame, (ss+fs) % 4 as stage, cast(cast(adu as int) as double) as v from frame_images) group by frame, stage", "frame_images")
def pip10(spark, sf_dir):
    """Readings of every frame with their gain stage in the upper bits, calibrated by a small table."""
    i = view(spark, sf_dir, "frame_images").withColumn("adu", F.col("adu").cast("int") + F.shiftleft((F.col("ss") + F.col("fs")) % 4, 14))
    planes = spark.createDataFrame(STAGES, "stage int, pedestal double, gain double")
    return calibrated(i, planes).groupBy("frame", "stage").agg(F.count("*").alias("n"), F.round(F.sum("kev"), 4).alias("kev"))


@query("exp11_scrambled_frames", "select frame_id, count(*) as n, round(sum(sqrt(qx*qx+qy*qy+qz*qz)), 4) as q, true as lost from planted_q group by frame_id", "planted_q")
def exp11(spark, sf_dir):
    """Frames without a lattice: each peak turned by its own angle; lengths stay, matches go."""
    phi = F.pmod(F.xxhash64("frame_id", "pk", "ok", "ln"), F.lit(1_000_000)) / 1e6 * (2 * math.pi)
    p = planted(spark, sf_dir)
    c, s = F.cos(phi), F.sin(phi)
    t = p.select("frame_id", "m", (c * F.col("qx") - s * F.col("qy")).alias("qx"), (s * F.col("qx") + c * F.col("qy")).alias("qy"), "qz")
    q = [F.col(x) for x in Q]
    g = t.groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum(lin3.norm(q)), 4).alias("q"), F.count_if(L.is_inlier(q, lin3.matrix("m"))).alias("hits"))
    return g.select("frame_id", "n", "q", (F.col("hits") < 0.25 * F.col("n")).alias("lost"))
