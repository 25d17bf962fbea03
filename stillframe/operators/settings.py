"""Axis settings, schedules, shards and other small named operators."""

from __future__ import annotations

from itertools import permutations, product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.plans.registry import query, table, view


def lengths(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "cells").withColumn("c", F.col("c").cast("double"))


@query("prj10_cell_signature", "select hyp_id, round(list_sort([a,b,c,2*least(a,b,c),sqrt(a*a+b*b),sqrt(a*a+c*c),sqrt(b*b+c*c)])[1], 6) as s1, round(list_sort([a,b,c,2*least(a,b,c),sqrt(a*a+b*b),sqrt(a*a+c*c),sqrt(b*b+c*c)])[3], 6) as s3, round(list_sort([a,b,c,2*least(a,b,c),sqrt(a*a+b*b),sqrt(a*a+c*c),sqrt(b*b+c*c)])[5], 6) as s5 from cells", "cells")
def prj10(spark, sf_dir):
    """Shortest lattice lengths of orthogonal cells, in order."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    s = F.array_sort(F.array(a, b, c, 2 * F.least(a, b, c), F.sqrt(a * a + b * b), F.sqrt(a * a + c * c), F.sqrt(b * b + c * c)))
    return lengths(spark, sf_dir).select("hyp_id", *(F.round(s[i - 1], 6).alias(f"s{i}") for i in (1, 3, 5)))


def standard_axes(a, b, c, laue: str, near: float = 0.05):
    """Lengths in the class's order: the unlike axis last for a four-, three- or sixfold one,
    ascending for orthorhombic, as they are for monoclinic and triclinic."""
    s = F.array_sort(F.array(a, b, c))
    if laue in ("mmm", "m-3", "m-3m"):
        return s
    if laue in ("-1", "2/m"):
        return F.array(a, b, c)
    like_low = (s[1] - s[0]) / s[1] <= (s[2] - s[1]) / s[2]
    return F.when(like_low, s).otherwise(F.array(s[1], s[2], s[0]))


@query("prj11_standard_axes", "select hyp_id, round(x[1], 6) as a, round(x[2], 6) as b, round(x[3], 6) as c from (select hyp_id, case when (s[2]-s[1])/s[2] <= (s[3]-s[2])/s[3] then s else [s[2], s[3], s[1]] end as x from (select hyp_id, list_sort([a,b,c]) as s from cells))", "cells")
def prj11(spark, sf_dir):
    x = standard_axes(F.col("a"), F.col("b"), F.col("c"), "4/mmm")
    return lengths(spark, sf_dir).select("hyp_id", *(F.round(x[i], 6).alias(n) for i, n in enumerate("abc")))


PERMUTATIONS = list(permutations(range(3)))


@query("prj13_reference_setting", "select hyp_id, id as setting, round(d, 6) as distance from (select hyp_id, id, d, row_number() over (partition by hyp_id order by d, id) as r from (select hyp_id, id, greatest(abs(l[i]-78)/78, abs(l[j]-50)/50, abs(l[k]-72)/72) as d from (select hyp_id, [a,b,c] as l from cells), (values (0,1,2,3),(1,1,3,2),(2,2,1,3),(3,2,3,1),(4,3,1,2),(5,3,2,1)) p(id,i,j,k))) where r = 1", "cells")
def prj13(spark, sf_dir):
    """The axis order nearest to a reference: the least over a constant table of orders."""
    ref = (78.0, 50.0, 72.0)
    l = [F.col("a"), F.col("b"), F.col("c")]
    each = [F.struct(F.greatest(*(F.abs(l[p[i]] - ref[i]) / ref[i] for i in range(3))).alias("d"), F.lit(k).alias("id")) for k, p in enumerate(PERMUTATIONS)]
    best = F.least(*each)
    return lengths(spark, sf_dir).select("hyp_id", best["id"].alias("setting"), F.round(best["d"], 6).alias("distance"))


@query("prj15_run_medians", "select frame_id, round(median(a), 6) as a, round(median(b), 6) as b, round(median(c), 6) as c from cells group by frame_id", "cells")
def prj15(spark, sf_dir):
    return lengths(spark, sf_dir).groupBy("frame_id").agg(*(F.round(F.median(n), 6).alias(n) for n in "abc"))


@query("prj26_axis_convention", "select frame_id, round(sum(-qx), 6) as x, round(sum(qy), 6) as y, round(sum(-qz), 6) as z from planted_q group by frame_id", "planted_q")
def prj26(spark, sf_dir):
    """Change of axis convention: a half turn about y."""
    s = {"x": -F.col("qx"), "y": F.col("qy"), "z": -F.col("qz")}
    return view(spark, sf_dir, "planted_q").groupBy("frame_id").agg(*(F.round(F.sum(v), 6).alias(k) for k, v in s.items()))


@query("prj29_free_parameters", "select system, count(*) as n, round(sum(p1), 4) as p1, round(sum(coalesce(p2, 0)), 4) as p2 from (select case hyp_id % 3 when 0 then 'cubic' when 1 then 'tetragonal' else 'orthorhombic' end as system, case hyp_id % 3 when 0 then (a+b+c)/3 when 1 then (a+b)/2 else a end as p1, case hyp_id % 3 when 1 then c when 2 then b end as p2 from cells) group by system", "cells")
def prj29(spark, sf_dir):
    """Cells projected on the free parameters of a system."""
    k = F.col("hyp_id") % 3
    system = F.when(k == 0, "cubic").when(k == 1, "tetragonal").otherwise("orthorhombic")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    p1 = F.when(k == 0, (a + b + c) / 3).when(k == 1, (a + b) / 2).otherwise(a)
    p2 = F.when(k == 1, c).when(k == 2, b)
    x = lengths(spark, sf_dir).select(system.alias("system"), p1.alias("p1"), F.coalesce(p2, F.lit(0.0)).alias("p2"))
    return x.groupBy("system").agg(F.count("*").alias("n"), F.round(F.sum("p1"), 4).alias("p1"), F.round(F.sum("p2"), 4).alias("p2"))


@query("flt13_keep_measured", "select frame, count(*) as n, count(*) filter (i < 0) as negative from measurements where sigma > 0 and i <> 0 group by frame", "measurements")
def flt13(spark, sf_dir):
    """Finite measurements with an error; negative ones stay, empty boxes go."""
    m = view(spark, sf_dir, "measurements").where((F.col("sigma") > 0) & (F.col("i") != 0) & ~F.isnan("i"))
    return m.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("i") < 0).alias("negative"))


@query("flt22_in_setting", "select count(*) as n, count(*) filter (abs(a-b)/((a+b)/2) <= 0.10) as near from cells", "cells")
def flt22(spark, sf_dir):
    d = F.abs(F.col("a") - F.col("b")) / ((F.col("a") + F.col("b")) / 2)
    return lengths(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(d <= 0.10).alias("near"))


@query("top08_lowest_resolution", "select frame_id, count(*) as n, round(max(q), 6) as reach from (select frame_id, qx*qx+qy*qy+qz*qz as q, row_number() over (partition by frame_id order by qx*qx+qy*qy+qz*qz, pk, ok, ln) as r from planted_q) where r <= 100 group by frame_id", "planted_q")
def top08(spark, sf_dir):
    """The 100 peaks of each frame nearest to the beam."""
    p = view(spark, sf_dir, "planted_q").withColumn("q", F.expr("qx*qx+qy*qy+qz*qz"))
    w = Window.partitionBy("frame_id").orderBy("q", "pk", "ok", "ln")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 100").groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.max("q"), 6).alias("reach"))


@query("join04_nearest_prediction", "select p.frame, count(*) as n, round(sum(d), 4) as total from (select p.frame, p.fs, p.ss, min(sqrt((p.fs-o.fs)*(p.fs-o.fs)+(p.ss-o.ss)*(p.ss-o.ss))) as d from (select distinct frame, fs, ss from points where ok % 5 = 0) p join (select distinct frame, fs, ss from points where ok % 5 <> 0) o on p.frame = o.frame group by p.frame, p.fs, p.ss) p where d <= 8 group by p.frame", "points")
def join04(spark, sf_dir):
    """Nearest observed peak within 8 pixels of each prediction: cells of 8 pixels, the
    neighbours' too, as an equi join."""
    p = view(spark, sf_dir, "points")
    a = p.where("ok % 5 = 0").select("frame", "fs", "ss").distinct()
    b = p.where("ok % 5 <> 0").select("frame", F.col("fs").alias("ofs"), F.col("ss").alias("oss")).distinct()
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = a.withColumn("i", near).withColumn("j", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumns({"cx": F.floor(F.col("fs") / 8) + F.col("i"), "cy": F.floor(F.col("ss") / 8) + F.col("j")})
    b = b.withColumns({"cx": F.floor(F.col("ofs") / 8), "cy": F.floor(F.col("oss") / 8)})
    d = F.sqrt((F.col("fs") - F.col("ofs")) ** 2 + (F.col("ss") - F.col("oss")) ** 2)
    m = a.join(b, ["frame", "cx", "cy"]).groupBy("frame", "fs", "ss").agg(F.min(d).alias("d")).where("d <= 8")
    return m.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("total"))


@query("exp05_key_subset", "select 'kept' as kind, count(*) as n from frame_stream s where exists (select 1 from cells c where c.frame_id = s.run_id and c.a = 42) union all select 'missing', count(*) from (select distinct frame_id from cells where a = 42) c where not exists (select 1 from frame_stream s where s.run_id = c.frame_id)", "frame_stream cells")
def exp05(spark, sf_dir):
    s = view(spark, sf_dir, "frame_stream")
    keys = view(spark, sf_dir, "cells").where("a = 42").select(F.col("frame_id").alias("run_id")).distinct()
    n = F.count("*").alias("n")
    kept = s.join(keys, "run_id", "left_semi").agg(n).select(F.lit("kept").alias("kind"), "n")
    return kept.unionByName(keys.join(s, "run_id", "left_anti").agg(n).select(F.lit("missing").alias("kind"), "n"))


@query("exp06_split_by_key", "select half, count(*) as n from (select (row_number() over (partition by run_id order by (ev*7919) % 104729, ev) - 1) % 2 as half from frame_stream) group by half", "frame_stream")
def exp06(spark, sf_dir):
    """Halves by a keyed order of the frames of each run, not by their arrival."""
    w = Window.partitionBy("run_id").orderBy((F.col("ev") * 7919) % 104729, "ev")
    return view(spark, sf_dir, "frame_stream").select(((F.row_number().over(w) - 1) % 2).cast("long").alias("half")).groupBy("half").agg(F.count("*").alias("n"))


@query("exp12_q_to_pixels", "select frame_id, round(sum(1.3*qx/(1.3*qz+1)*1000), 4) as fs, round(sum(1.3*qy/(1.3*qz+1)*1000), 4) as ss from planted_q group by frame_id", "planted_q")
def exp12(spark, sf_dir):
    """Reciprocal vectors on one synthetic panel."""
    z = 1.3 * F.col("qz") + 1
    p = view(spark, sf_dir, "planted_q")
    return p.groupBy("frame_id").agg(*(F.round(F.sum(1.3 * F.col(q) / z * 1000), 4).alias(n) for q, n in (("qx", "fs"), ("qy", "ss"))))


@query("pip21_pair_triples", "select frame_id, count(*) as n, round(sum(l1), 5) as l1, round(sum(dot), 5) as dots from (select x.frame_id, x.qx*x.qx+x.qy*x.qy+x.qz*x.qz as l1, x.qx*y.qx+x.qy*y.qy+x.qz*y.qz as dot from peaks_q x join peaks_q y on x.frame_id = y.frame_id and x.peak_id <> y.peak_id) group by frame_id", "peaks_q")
def pip21(spark, sf_dir):
    """Pairs of a frame in both orders as (length, length, dot)."""
    p = view(spark, sf_dir, "peaks_q")
    x, y = (p.select("frame_id", *(F.col(n).alias(f"{t}{n}") for n in ("peak_id", "qx", "qy", "qz"))) for t in "xy")
    m = x.join(y, "frame_id").where("xpeak_id <> ypeak_id")
    return m.groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("xqx*xqx+xqy*xqy+xqz*xqz")), 5).alias("l1"), F.round(F.sum(F.expr("xqx*yqx+xqy*yqy+xqz*yqz")), 5).alias("dots"))


def pixel_coordinates(panels: DataFrame, by: list[str], res: float) -> DataFrame:
    """by, ord, ss, fs, x, y: where each pixel of each panel lies, in metres."""
    steps = lambda n: F.explode(F.sequence(F.lit(0), (F.col(f"max_{n}") - F.col(f"min_{n}")).cast("int")))
    p = panels.withColumn("i", steps("fs")).withColumn("j", steps("ss"))
    ssx, ssy = -F.col("fsy"), F.col("fsx")  # the second direction is the first, turned
    x = (F.col("corner_x") + F.col("i") * F.col("fsx") + F.col("j") * ssx) / res
    y = (F.col("corner_y") + F.col("i") * F.col("fsy") + F.col("j") * ssy) / res
    return p.select(*by, "ord", (F.col("min_ss") + F.col("j")).alias("ss"), (F.col("min_fs") + F.col("i")).alias("fs"), x.alias("x"), y.alias("y"))


@query("src15_pixel_coordinates", "select det, ord, cast(w*h as bigint) as n, round(w*h*(corner_x + (w-1)/2*fsx - (h-1)/2*fsy)/10000, 8) as x, round(w*h*(corner_y + (w-1)/2*fsy + (h-1)/2*fsx)/10000, 8) as y from (select *, max_fs-min_fs+1 as w, max_ss-min_ss+1 as h from detectors)", "detectors")
def src15(spark, sf_dir):
    """Coordinates of every pixel of every panel of all detectors."""
    rows = pixel_coordinates(view(spark, sf_dir, "detectors"), ["det"], 10000.0)
    return rows.groupBy("det", "ord").agg(F.count("*").alias("n"), F.round(F.sum("x"), 8).alias("x"), F.round(F.sum("y"), 8).alias("y"))


@query("set_signed_permutations", "select hyp_id, cast(24 as bigint) as n, cast(4*case when a = b and b = c then 6 when a = b or b = c or a = c then 2 else 1 end as bigint) as ascending from metrics", "metrics")
def signed_permutations(spark, sf_dir):
    """Settings of every cell by proper signed permutations of its axes, and those whose axes ascend.  The 48
    permutations are constants of the plan."""
    every = F.array(*(F.array(*(F.lit(s[r] if p[r] == k else 0) for r in range(3) for k in range(3))) for p in PERMUTATIONS for s in product((1, -1), repeat=3)))
    rows = view(spark, sf_dir, "metrics").select("hyp_id", "a", "b", "c", F.explode(every).alias("m"))
    m, axes = lin3.matrix("m"), [F.col(n) for n in "abc"]
    x, y, z = (F.abs(lin3.dot(m[3 * r : 3 * r + 3], axes)) for r in range(3))
    return rows.where(lin3.det(m) == 1).groupBy("hyp_id").agg(F.count("*").alias("n"), F.count_if((x <= y) & (y <= z)).alias("ascending"))
