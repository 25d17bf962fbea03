"""Order, top-k, window, as-of, set and pair operators over frames and their streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillframe.functions import lin3
from stillframe.plans.registry import query, table, view
from stillframe.plans.shared import checkpoint


@query("top01_triage", "select frame_id, n_peaks from (select frame_id, count(*) as n_peaks from planted_q group by frame_id) where n_peaks >= 150 order by n_peaks desc, frame_id limit 32", "planted_q")
def top01(spark, sf_dir):
    """The 32 frames with the most peaks (a top-k report): TakeOrderedAndProject."""
    p = view(spark, sf_dir, "planted_q").groupBy("frame_id").agg(F.count("*").alias("n_peaks"))
    return p.where("n_peaks >= 150").orderBy(F.desc("n_peaks"), "frame_id").limit(32)


def strongest(df: DataFrame, by: str, value: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of each group with the largest value; Spark drops most before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(value), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


@query("top05_top_peaks", "select frame, count(*) as n, round(sum(i), 4) as total from (select *, row_number() over (partition by frame order by i desc, h, k, l) as r from measurements) where r <= 20 group by frame", "measurements")
def top05(spark, sf_dir):
    t = strongest(view(spark, sf_dir, "measurements"), "frame", "i", 20, ["h", "k", "l"])
    return t.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("i"), 4).alias("total"))


@query("top09_best_candidate", "select frame_id, hyp_id from (select frame_id, hyp_id, row_number() over (partition by frame_id order by a*b*c desc, hyp_id) as r from cells) where r = 1", "cells")
def top09(spark, sf_dir):
    """Argmax with a unique key, one aggregation."""
    best = F.max(F.struct((F.col("a") * F.col("b") * F.col("c")).alias("s"), (-F.col("hyp_id")).alias("t")))
    return view(spark, sf_dir, "cells").groupBy("frame_id").agg((-best["t"]).alias("hyp_id"))


VOXELS = "(select frame_id, x, y, z, f, row_number() over (partition by frame_id, round_even(x/2,0), round_even(y/2,0), round_even(z/2,0) order by f desc, x, y, z, id) as r from (select frame_id, row_number() over () as id, case when flip then -x0 else x0 end as x, case when flip then -y0 else y0 end as y, case when flip then -z0 else z0 end as z, f from (select frame_id, qx*100 as x0, qy*100 as y0, qz*100 as z0, cast((pk*31 + ok*17 + ln) % 1009 as bigint) as f, qx < 0 as flip from planted_q)) where sqrt(x*x+y*y+z*z) >= 2)"


def one_per_voxel(df: DataFrame, value: str, size: float, least: float) -> DataFrame:
    """Sign-canonical vectors of at least a length; the best of each voxel.

    The length is ranked first and tested with the rank: a filter below the window would be evaluated on the
    scan, with the whole expression of each coordinate copied into it for every time it is named."""
    s = F.when(F.col("x") < 0, -1.0).otherwise(1.0)
    long = lin3.norm([F.col(n) for n in "xyz"]) >= least
    v = df.repartition("frame_id").withColumns({n: s * F.col(n) for n in "xyz"} | {"_long": F.coalesce(long, F.lit(False))})
    w = Window.partitionBy("frame_id", *(F.rint(F.col(n) / size) + F.lit(0.0) for n in "xyz")).orderBy(F.desc("_long"), F.desc(value), "x", "y", "z")
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1 and _long").drop("_r", "_long")


def _vectors(spark, sf_dir) -> DataFrame:
    p = view(spark, sf_dir, "planted_q")
    return p.select("frame_id", *((F.col(f"q{n}") * 100).alias(n) for n in "xyz"), ((F.col("pk") * 31 + F.col("ok") * 17 + F.col("ln")) % 1009).alias("f"))


@query("win10_voxel_dedup", f"select frame_id, count(*) as n, cast(sum(f) as bigint) as f from {VOXELS} where r = 1 group by frame_id", "planted_q")
def win10(spark, sf_dir):
    return one_per_voxel(_vectors(spark, sf_dir), "f", 2.0, 2.0).groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("f").alias("f"))


@query("top11_distinct_maxima", f"select frame_id, cast(sum(f) as bigint) as f from (select *, row_number() over (partition by frame_id order by f desc, x, y, z) as t from {VOXELS} where r = 1) where t <= 44 group by frame_id", "planted_q")
def top11(spark, sf_dir):
    """The best 44 distinct vectors of each frame."""
    v = one_per_voxel(_vectors(spark, sf_dir), "f", 2.0, 2.0)
    return strongest(v, "frame_id", "f", 44, ["x", "y", "z"]).groupBy("frame_id").agg(F.sum("f").alias("f"))


def by_ev():
    return Window.partitionBy("run_id").orderBy("ev")


def stream_rows(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "frame_stream")


@query("win02_recent_share", "select ev, round(avg(case when outcome = 'purchase' then cast(1 as double) else 0 end) over (partition by run_id order by ev rows between 199 preceding and current row), 6) as share from frame_stream", "frame_stream")
def win02(spark, sf_dir):
    """Share of an outcome among the last 200 frames of a run."""
    hit = F.when(F.col("outcome") == "purchase", 1.0).otherwise(0.0)
    return stream_rows(spark, sf_dir).select("ev", F.round(F.avg(hit).over(by_ev().rowsBetween(-199, 0)), 6).alias("share"))


@query("win03_hit_rate", "select ev, round(greatest(avg(cast(hit as double)) over (partition by run_id order by ev rows between 255 preceding and current row), 0.02), 6) as rate from frame_stream", "frame_stream")
def win03(spark, sf_dir):
    return stream_rows(spark, sf_dir).select("ev", F.round(F.greatest(F.avg(F.col("hit").cast("double")).over(by_ev().rowsBetween(-255, 0)), F.lit(0.02)), 6).alias("rate"))


@query("win04_ordinals", "select ev, row_number() over (partition by run_id order by ev) - 1 as arrival, cast(sum(hit) over (partition by run_id order by ev) as bigint) as accepted from frame_stream", "frame_stream")
def win04(spark, sf_dir):
    return stream_rows(spark, sf_dir).select("ev", (F.row_number().over(by_ev()) - 1).cast("long").alias("arrival"), F.sum("hit").over(by_ev().rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("accepted"))


@query("win07_changes", "select ev, outcome from (select *, lag(outcome) over (partition by run_id order by ev) as before from frame_stream) where before is null or before <> outcome", "frame_stream")
def win07(spark, sf_dir):
    """Events at which the outcome changes."""
    s = stream_rows(spark, sf_dir).withColumn("before", F.lag("outcome").over(by_ev()))
    return s.where("before is null or before <> outcome").select("ev", "outcome")


@query("win08_local_maxima", "select frame, ss, count(*) as n from (select *, lag(adu) over w as p, lead(adu) over w as q, max(adu) over (partition by frame, ss) as top from frame_images window w as (partition by frame, ss order by fs)) where adu > p and adu > q and adu > 0.1*top group by frame, ss", "frame_images")
def win08(spark, sf_dir):
    """Local maxima of each row of every frame above a tenth of the row's largest value."""
    w = Window.partitionBy("frame", "ss").orderBy("fs")
    i = view(spark, sf_dir, "frame_images").withColumns({"p": F.lag("adu").over(w), "q": F.lead("adu").over(w), "top": F.max("adu").over(Window.partitionBy("frame", "ss"))})
    return i.where("adu > p and adu > q and adu > 0.1*top").groupBy("frame", "ss").agg(F.count("*").alias("n"))


@query("win09_chunk_numbers", "select run_id, cast(chunk as bigint) as chunk, count(*) as n from (select run_id, sum(case when outcome = 'signup' then 1 else 0 end) over (partition by run_id order by ev) as chunk from frame_stream) group by run_id, chunk", "frame_stream")
def win09(spark, sf_dir):
    """Rows between begin markers, by a running count of the markers."""
    chunk = F.sum(F.when(F.col("outcome") == "signup", 1).otherwise(0)).over(by_ev().rowsBetween(Window.unboundedPreceding, 0))
    return stream_rows(spark, sf_dir).select("run_id", chunk.alias("chunk")).groupBy("run_id", "chunk").agg(F.count("*").alias("n"))


@query("win11_decaying_sum", "with recursive o as (select ev, cast(n_peaks as double) as v, row_number() over (partition by run_id order by ev) as i, run_id from frame_stream), d as (select run_id, i, ev, v as acc from o where i = 1 union all select o.run_id, o.i, o.ev, 0.9*d.acc + o.v from d join o on o.run_id = d.run_id and o.i = d.i + 1) select run_id, round(max_by(acc, i), 4) as acc from d group by run_id", "frame_stream")
def win11(spark, sf_dir):
    """Accumulator with forgetting per run: powers of the decay by distance from the end."""
    s = stream_rows(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ev"))) - 1)
    return s.groupBy("run_id").agg(F.round(F.sum(F.col("n_peaks") * F.pow(F.lit(0.9), F.col("back"))), 4).alias("acc"))


@query("win12_streaks", "select run_id, max(n) as longest from (select run_id, g, count(*) as n from (select run_id, hit, sum(hit) over (partition by run_id order by ev) as g from frame_stream) where hit = 0 group by run_id, g) group by run_id", "frame_stream")
def win12(spark, sf_dir):
    """Longest run of consecutive misses (gaps and islands)."""
    g = F.sum("hit").over(by_ev().rowsBetween(Window.unboundedPreceding, 0))
    s = stream_rows(spark, sf_dir).select("run_id", "hit", g.alias("g")).where("hit = 0").groupBy("run_id", "g").agg(F.count("*").alias("n"))
    return s.groupBy("run_id").agg(F.max("n").alias("longest"))


@query("win13_rank", "select hyp_id, cast(rank() over (partition by frame_id order by a desc, b) as int) as r from cells", "cells")
def win13(spark, sf_dir):
    return view(spark, sf_dir, "cells").select("hyp_id", F.rank().over(Window.partitionBy("frame_id").orderBy(F.desc("a"), "b")).alias("r"))


EFFORT = [(0, 0), (100, 2), (185, 1), (700, 3)]


def as_of(left: DataFrame, on: str, log: list[tuple[int, int]], name: str) -> DataFrame:
    """The entry of a short log in force at each row: a range join on [from, next), the
    log's rows becoming one expression."""
    pick: Column = F.lit(None).cast("int")
    for start, value in sorted(log):
        pick = F.when(F.col(on) >= start, F.lit(value)).otherwise(pick)
    return left.withColumn(name, pick)


@query("join07_effort_asof", "select tier, count(*) as n from (select ev, (select tier from (values (0,0),(100,2),(185,1),(700,3)) l(eff_from, tier) where eff_from <= ev order by eff_from desc limit 1) as tier from frame_stream) group by tier", "frame_stream")
def join07(spark, sf_dir):
    return as_of(stream_rows(spark, sf_dir), "ev", EFFORT, "tier").groupBy("tier").agg(F.count("*").alias("n"))


@query("str14_effort_tiers", """select run_id, max(tier) as deepest, count(*) filter (tier >= 2) as deep from (select run_id, ev, case when b >= 0.94 then 3 when b >= 0.40 then 2 when b >= 0.27 then 1 else 0 end as tier from (
    select run_id, ev, 1000.0/(120*greatest(avg(cast(hit as double)) over (partition by run_id order by ev rows between 255 preceding and current row), 0.02)) - 8.7 as b from frame_stream)) group by run_id""", "frame_stream")
def str14(spark, sf_dir):
    """Depth tier that the frame rate affords: budget = 1000 / (rate x hit) - overhead ms."""
    rate = F.greatest(F.avg(F.col("hit").cast("double")).over(by_ev().rowsBetween(-255, 0)), F.lit(0.02))
    b = 1000.0 / (120 * rate) - 8.7
    tier = F.when(b >= 0.94, 3).when(b >= 0.40, 2).when(b >= 0.27, 1).otherwise(0)
    return stream_rows(spark, sf_dir).select("run_id", tier.alias("tier")).groupBy("run_id").agg(F.max("tier").alias("deepest"), F.count_if(F.col("tier") >= 2).alias("deep"))


@query("str13_terminal_outcomes", "select outcome, count(*) as n, count(distinct ev) as frames from (select ev, case when n_peaks < 6 then 'blank' when ev < 64 then 'warmup_vote' when n_peaks % 5 = 0 then 'miss' else 'indexed' end as outcome from frame_stream) group by outcome", "frame_stream")
def str13(spark, sf_dir):
    """One terminal outcome for each frame."""
    o = F.when(F.col("n_peaks") < 6, "blank").when(F.col("ev") < 64, "warmup_vote").when(F.col("n_peaks") % 5 == 0, "miss").otherwise("indexed")
    return stream_rows(spark, sf_dir).select("ev", o.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("ev").alias("frames"))


@query("str22_reference_frames", "select run_id, count(*) as n from (select run_id, row_number() over (partition by run_id order by ev) as i from frame_stream) where i % 50 = 0 group by run_id", "frame_stream")
def str22(spark, sf_dir):
    """Every fiftieth frame of a run as a reference."""
    return stream_rows(spark, sf_dir).select("run_id", F.row_number().over(by_ev()).alias("i")).where("i % 50 = 0").groupBy("run_id").agg(F.count("*").alias("n"))


@query("join14_triplets", "select x.frame_id, count(*) as n from cells x join cells y on x.frame_id = y.frame_id and x.hyp_id < y.hyp_id join cells z on z.frame_id = y.frame_id and y.hyp_id < z.hyp_id where abs(x.a*y.b*z.c) >= 0.1*(x.a+x.b)*(y.b+y.c)*z.c group by x.frame_id", "cells")
def join14(spark, sf_dir):
    """Triplets of a frame's candidates with enough volume, counted by their values."""
    c = view(spark, sf_dir, "cells").withColumn("c", F.col("c").cast("double"))

    def enough(xa, xb, yb, yc, zc):
        return np.abs(xa * yb * zc) >= 0.1 * (xa + xb) * (yb + yc) * zc

    return ordered_triplets(c, "frame_id", "hyp_id", ["a", "b"], ["b", "c"], ["c"], enough)


def ordered_triplets(rows: DataFrame, by: str, order: str, first: list[str], middle: list[str], last: list[str], test, width: int = 1 << 16) -> DataFrame:
    """by, n: triplets of a group's rows in the order of a whole number that pass ``test``, which sees the columns
    ``first`` of the first row, ``middle`` of the second and ``last`` of the third (numpy arrays).

    No triplet is made.  A middle row has so many rows of each distinct value of ``first`` before it and of
    ``last`` behind it; the test is asked once for each combination of distinct values.  Rows are dealt by ranges
    of ``width`` of the order; a task sees one range of one group and how many of each value come before and
    after the range.  Work grows with rows times distinct values, which is cubic only if all values differ.
    Rows of equal place form no triplet; groups without one have no row.
    """
    names = list(dict.fromkeys([*first, *middle, *last]))
    own = rows.select(by, order, *names, F.floor(F.col(order) / width).alias("_range"))
    ranges = own.select(by, "_range").distinct()

    def carried(columns: list[str], kind: int) -> DataFrame:
        """How many rows of each value lie in the ranges before (1) or after (2) each of the group's ranges."""
        n = own.groupBy(by, "_range", *columns).agg(F.count("*").alias("_n"))
        values = n.select(by, *columns).distinct()
        w = Window.partitionBy(by, *columns).orderBy(F.col("_range") if kind == 1 else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        keys = [by, "_range", *columns]
        full = ranges.join(values, by).join(n.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(keys)}), F.expr(" and ".join(f"`{c}` <=> `_{i}`" for i, c in enumerate(keys))), "left")
        return full.select(*keys, F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("_n")).where("_n > 0").select(by, "_range", *(F.col(c) if c in columns else F.lit(None).cast("double").alias(c) for c in names), F.lit(None).cast("long").alias(order), "_n", F.lit(kind).alias("_kind"))

    mine = own.select(by, "_range", *names, F.col(order).cast("long").alias(order), F.lit(1).cast("long").alias("_n"), F.lit(0).alias("_kind"))
    parts = mine.unionByName(carried(first, 1)).unionByName(carried(last, 2))

    def classes(own: pd.DataFrame, more: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values, the class of each own row, and how many of each class are carried."""
        both = pd.concat([own[columns], more[columns]]).to_numpy(float)
        values, at = np.unique(both, axis=0, return_inverse=True)
        at = at.reshape(-1)
        return values, at[: len(own)], np.bincount(at[len(own) :], weights=more["_n"].to_numpy(float), minlength=len(values)).astype(np.int64)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        mine = part[part["_kind"] == 0].sort_values(order)
        none = part[:0]
        x, x_at, before = classes(mine, part[part["_kind"] == 1], first)
        z, z_at, after = classes(mine, part[part["_kind"] == 2], last)
        y, y_at, _ = classes(mine, none, middle)
        place = mine[order].to_numpy()
        low, high = np.searchsorted(place, place, "left"), np.searchsorted(place, place, "right")
        total = 0
        for v in range(len(y)):
            ok = np.broadcast_to(test(*(c[:, None] for c in x.T), *y[v], *(c[None, :] for c in z.T)), (len(x), len(z))).astype(np.int64)
            mid = np.flatnonzero(y_at == v)
            # own rows of each class before and behind each middle row
            xs = before + np.array([np.bincount(x_at[: low[i]], minlength=len(x)) for i in mid])
            zs = after + np.array([np.bincount(z_at[high[i] :], minlength=len(z)) for i in mid])
            total += int(((xs @ ok) * zs).sum())
        return pd.DataFrame({by: [part[by].iloc[0]], "n": [total]})

    kind = rows.schema[by].dataType.simpleString()
    got = parts.groupBy(by, "_range").applyInPandas(count, f"{by} {kind}, n long")
    return got.groupBy(by).agg(F.sum("n").alias("n")).where("n > 0")


PAIRS = "(select x.frame_id, y.qx-x.qx as dx, y.qy-x.qy as dy, y.qz-x.qz as dz, x.qx*y.qx+x.qy*y.qy+x.qz*y.qz as dot from peaks_q x join peaks_q y on x.frame_id = y.frame_id and x.peak_id < y.peak_id)"


def pairs(peaks: DataFrame) -> DataFrame:
    """All pairs of a frame's peaks (a frame has a bounded number) with their difference."""
    x, y = (peaks.select("frame_id", *(F.col(n).alias(f"{t}_{n}") for n in ("peak_id", "qx", "qy", "qz"))) for t in "xy")
    p = x.join(y, "frame_id").where("x_peak_id < y_peak_id")
    d = [(F.col(f"y_q{n}") - F.col(f"x_q{n}")).alias(f"d{n}") for n in "xyz"]
    dot = sum((F.col(f"y_q{n}") * F.col(f"x_q{n}") for n in "xyz"), F.lit(0.0))
    return p.select("frame_id", *d, dot.alias("dot"))


@query("join15_pair_diffs", f"select frame_id, count(*) as n, round(sum(dx*dx+dy*dy+dz*dz), 5) as total, round(sum(dot), 5) as dots from {PAIRS} group by frame_id", "peaks_q")
def join15(spark, sf_dir):
    p = pairs(view(spark, sf_dir, "peaks_q"))
    return p.groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("dx*dx+dy*dy+dz*dz")), 5).alias("total"), F.round(F.sum("dot"), 5).alias("dots"))


@query("agg30_diff_hist", f"select ix, iy, iz, count(*) as n from (select cast(floor(dx*20) as bigint) as ix, cast(floor(dy*20) as bigint) as iy, cast(floor(dz*20) as bigint) as iz from {PAIRS}) group by ix, iy, iz having count(*) >= 50", "peaks_q")
def agg30(spark, sf_dir):
    """Voxel histogram of difference vectors, its full bins."""
    v = [F.floor(F.col(f"d{n}") * 20).alias(f"i{n}") for n in "xyz"]
    return pairs(view(spark, sf_dir, "peaks_q")).groupBy(*v).agg(F.count("*").alias("n")).where("n >= 50")


@query("agg29_q2_spectrum", "select bin, n from (select bin, n, lag(n) over (order by bin) as p, lead(n) over (order by bin) as q, max(n) over () as top from (select cast(floor((qx*qx+qy*qy+qz*qz)*2000) as bigint) as bin, count(*) as n from planted_q group by 1)) where n > coalesce(p,0) and n > coalesce(q,0) and n > 0.1*top", "planted_q")
def agg29(spark, sf_dir):
    """Peaks of the pooled spectrum of |q| squared: local maxima above a tenth of the top.
    The windows run over the bins of a bounded range, not over peaks."""
    s = view(spark, sf_dir, "planted_q").groupBy(F.floor(lin3.dot(*[[F.col(n) for n in ("qx", "qy", "qz")]] * 2) * 2000).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    top = Window.partitionBy()
    s = s.withColumns({"p": F.coalesce(F.lag("n").over(w), F.lit(0)), "q": F.coalesce(F.lead("n").over(w), F.lit(0)), "top": F.max("n").over(top)})
    return s.where("n > p and n > q and n > 0.1*top").select("bin", "n")


@query("agg31_cic_deposit", "select ix, iy, iz, round(sum(w), 5) as w from (select cast(bx+dx as bigint) as ix, cast(by_+dy as bigint) as iy, cast(bz+dz as bigint) as iz, (case when dx=1 then fx else 1-fx end)*(case when dy=1 then fy else 1-fy end)*(case when dz=1 then fz else 1-fz end) as w from (select floor(qx*40) as bx, floor(qy*40) as by_, floor(qz*40) as bz, qx*40-floor(qx*40) as fx, qy*40-floor(qy*40) as fy, qz*40-floor(qz*40) as fz from planted_q), (select unnest([0,1]) as dx) a, (select unnest([0,1]) as dy) b, (select unnest([0,1]) as dz) c) group by ix, iy, iz", "planted_q")
def agg31(spark, sf_dir):
    """Each point shared over the eight voxels around it."""
    p = view(spark, sf_dir, "planted_q").select(*((F.col(f"q{n}") * 40).alias(n) for n in "xyz"))
    for n in "xyz":
        p = p.withColumn(f"d{n}", F.explode(F.array(F.lit(0), F.lit(1))))
    w = F.lit(1.0)
    for n in "xyz":
        part = F.col(n) - F.floor(n)
        w = w * F.when(F.col(f"d{n}") == 1, part).otherwise(1 - part)
    return p.groupBy(*((F.floor(n) + F.col(f"d{n}")).cast("long").alias(f"i{n}") for n in "xyz")).agg(F.round(F.sum(w), 5).alias("w"))


@query("set01_union_sources", "select src, count(*) as n from (select 'a' as src, event_id from events where event_type = 'purchase' union all select 'b', event_id from events where user_id % 2 = 0) group by src")
def set01(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select(F.lit("a").alias("src"), "event_id")
    return a.unionByName(e.where("user_id % 2 = 0").select(F.lit("b").alias("src"), "event_id")).groupBy("src").agg(F.count("*").alias("n"))


@query("set03_seed_union", "select count(*) as n from (select qx from planted_q where frame_id < 3 union all select cast(i as double) from (select unnest(range(0,100)) as i))", "planted_q")
def set03(spark, sf_dir):
    """Seeds and a regular grid together."""
    a = view(spark, sf_dir, "planted_q").where("frame_id < 3").select("qx")
    return a.union(spark.range(100).select(F.col("id").cast("double"))).agg(F.count("*").alias("n"))


@query("set05_common_keys", "select frame_id from cells where a = 30 intersect select frame_id from cells where b = 45", "cells")
def set05(spark, sf_dir):
    c = view(spark, sf_dir, "cells")
    return c.where("a = 30").select("frame_id").intersect(c.where("b = 45").select("frame_id"))


@query("set06_distinct_keys", "select distinct h, k, l from measurements", "measurements")
def set06(spark, sf_dir):
    return view(spark, sf_dir, "measurements").select("h", "k", "l").distinct()


@query("set07_subgroup", "select hyp_id, laue from metrics join (values ('-1',0),('-1',1),('-1',2),('-1',3),('-1',4),('2/m',0),('2/m',1),('2/m',2),('2/m',4),('mmm',0),('mmm',1),('mmm',2),('4/m',1),('4/m',2),('4/mmm',1),('4/mmm',2),('m-3',2),('m-3m',2),('-3',3),('-3m',3),('6/m',3),('6/mmm',3)) t(laue, kind) using (kind)", "metrics")
def set07(spark, sf_dir):
    """The classes that are subgroups of each cell's own group: all their operators are among those that
    keep its metric."""
    from stillframe.functions.symmetry import CLASSES, operators
    from stillframe.operators.merge import by_metric, metric_cells

    order = F.create_map(*(x for n in CLASSES for x in (F.lit(n), F.lit(len(operators(n))))))
    def subgroups(kept: DataFrame) -> DataFrame:
        own = kept.select("metric", F.explode("classes").alias("laue")).groupBy("metric", "laue").agg(F.count("*").alias("n"))
        return own.where(F.col("n") == order[F.col("laue")]).drop("n")

    return by_metric(metric_cells(spark, sf_dir), subgroups).select("hyp_id", "laue")


@query("set08_any_solved", "select frame_id from cells where a = 30 union select frame_id from cells where c > 74", "cells")
def set08(spark, sf_dir):
    c = view(spark, sf_dir, "cells")
    return c.where("a = 30").select("frame_id").union(c.where("c > 74").select("frame_id")).distinct()


@query("join11_residual", "select s.run_id, count(*) as n from frame_stream s where not exists (select 1 from frame_stream h where h.ev = s.ev and h.hit = 1 and h.n_peaks % 3 = 0) group by s.run_id", "frame_stream")
def join11(spark, sf_dir):
    """Frames that no accepted result covers (left anti)."""
    s = stream_rows(spark, sf_dir)
    done = s.where("hit = 1 and n_peaks % 3 = 0").select("ev")
    return s.join(done, "ev", "left_anti").groupBy("run_id").agg(F.count("*").alias("n"))


@query("join12_wanted_events", "select count(*) as n, cast(sum(n_peaks) as bigint) as peaks from frame_stream where run_id in (select frame_id from cells where a = 30)", "frame_stream cells")
def join12(spark, sf_dir):
    """Second read of the wanted events only (left semi)."""
    want = view(spark, sf_dir, "cells").where("a = 30").select(F.col("frame_id").alias("run_id"))
    return stream_rows(spark, sf_dir).join(want, "run_id", "left_semi").agg(F.count("*").alias("n"), F.sum("n_peaks").alias("peaks"))


@query("join13_common_missing", "select 'common' as kind, count(*) as n from (select ev from frame_stream where n_peaks % 2 = 0 intersect select ev from frame_stream where n_peaks % 3 = 0) union all select 'missing', count(*) from (select ev from frame_stream where n_peaks % 2 = 0 except select ev from frame_stream where n_peaks % 3 = 0)", "frame_stream")
def join13(spark, sf_dir):
    s = stream_rows(spark, sf_dir)
    a, b = s.where("n_peaks % 2 = 0").select("ev"), s.where("n_peaks % 3 = 0").select("ev")
    n = F.count("*").alias("n")
    return a.intersect(b).agg(n).select(F.lit("common").alias("kind"), "n").unionByName(a.join(b, "ev", "left_anti").agg(n).select(F.lit("missing").alias("kind"), "n"))


@query("join17_event_meta", "select coalesce(m.wave, 'default') as wave, count(*) as n from frame_stream s left join (select frame_id, min(case when b > 60 then 'long' else 'short' end) as wave from cells where frame_id % 3 = 0 group by frame_id) m on s.run_id = m.frame_id group by 1", "frame_stream cells")
def join17(spark, sf_dir):
    """Per-event metadata with a default where it is missing."""
    m = view(spark, sf_dir, "cells").where("frame_id % 3 = 0").groupBy(F.col("frame_id").alias("run_id")).agg(F.min(F.when(F.col("b") > 60, "long").otherwise("short")).alias("wave"))
    return stream_rows(spark, sf_dir).join(m, "run_id", "left").groupBy(F.coalesce("wave", F.lit("default")).alias("wave")).agg(F.count("*").alias("n"))


@query("exp03_derangement", "select count(*) as n, count(*) filter (a.i = b.i) as fixed from (select row_number() over (order by p_partkey) - 1 as i, count(*) over () as n from part) a join (select row_number() over (order by p_partkey) - 1 as i from part) b on b.i = (a.i + 7) % a.n")
def exp03(spark, sf_dir):
    """Re-pairing without fixed points: a cyclic shift of a dense numbering."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    i = dense_numbers(p, "p_partkey", "i")
    n = F.broadcast(p.agg(F.count("*").alias("n")))  # one row
    a = i.crossJoin(n).withColumn("j", (F.col("i") + 7) % F.col("n"))
    b = i.select(F.col("i").alias("j"), F.col("i").alias("k"))
    return a.join(b, "j").agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("k")).alias("fixed"))


def dense_numbers(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the numbers 0, 1, ... in the order of ``by``: numbered within ranges, each moved by
    the sizes of those before it (a row a range is all that is looked at together)."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = checkpoint(df.repartitionByRange(ranges, by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return parts.withColumn(name, own).join(F.broadcast(first), "_part").withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_first")


@query("exp04_sorted_keys", "select run_id, count(*) as n, min(ev) as first_ev from frame_stream where hit = 1 group by run_id having count(*) >= 2", "frame_stream")
def exp04(spark, sf_dir):
    return stream_rows(spark, sf_dir).where("hit = 1").groupBy("run_id").agg(F.count("*").alias("n"), F.min("ev").alias("first_ev")).where("n >= 2")


@query("exp08_paired_control", "select count(*) as n, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as sd, count(*) filter (d > 0) as up, count(*) filter (d < 0) as down from (select a.m - b.m as d from (select run_id, avg(cast(n_peaks as double)) as m from frame_stream where ev % 2 = 0 group by run_id) a join (select run_id, avg(cast(n_peaks as double)) as m from frame_stream where ev % 2 = 1 group by run_id) b using (run_id))", "frame_stream")
def exp08(spark, sf_dir):
    """Paired means, sample deviation and signs of two arms."""
    s = stream_rows(spark, sf_dir)
    a, b = (s.where(f"ev % 2 = {k}").groupBy("run_id").agg(F.avg(F.col("n_peaks").cast("double")).alias(n)) for k, n in ((0, "a"), (1, "b")))
    d = F.col("a") - F.col("b")
    return a.join(b, "run_id").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("sd"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))


@query("exp09_percentiles", "select run_id, round(quantile_cont(n_peaks, 0.9), 6) as p90, round(quantile_cont(n_peaks, 0.5), 6) as p50 from frame_stream group by run_id", "frame_stream")
def exp09(spark, sf_dir):
    return stream_rows(spark, sf_dir).groupBy("run_id").agg(*(F.round(F.percentile("n_peaks", F.lit(p)), 6).alias(n) for p, n in ((0.9, "p90"), (0.5, "p50"))))


@query("agg33_run_stats", "select count(*) as n, cast(sum(hit) as bigint) as hits, round(avg(cast(n_peaks as double)), 6) as mean_peaks, count(distinct run_id) as runs from frame_stream", "frame_stream")
def agg33(spark, sf_dir):
    return stream_rows(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg(F.col("n_peaks").cast("double")), 6).alias("mean_peaks"), F.count_distinct("run_id").alias("runs"))


def log_factorial(n: Column) -> Column:
    """ln n!: of the number itself up to 20, then Stirling's series, whose rest is below 1e-15 there."""
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


@query("agg35_mcnemar", "with recursive n as (select count(*) filter (n_peaks % 2 = 0 and n_peaks % 3 <> 0) as b, count(*) filter (n_peaks % 2 <> 0 and n_peaks % 3 = 0) as c from frame_stream), t as (select 0 as k, pow(cast(0.5 as double), b+c) as p, b+c as m, least(b,c) as lo from n union all select k+1, p*(m-k)/(k+1), m, lo from t where k < lo) select max(m) as discordant, round(least(2*sum(p), 1), 6) as p from t", "frame_stream")
def agg35(spark, sf_dir):
    """Exact test on discordant pairs: a row a binomial term, each from logarithms of factorials."""
    s = stream_rows(spark, sf_dir)
    x, y = F.col("n_peaks") % 2 == 0, F.col("n_peaks") % 3 == 0
    b, c = s.agg(F.count_if(x & ~y), F.count_if(~x & y)).first()  # two numbers
    m = F.lit(b + c)
    k = F.col("id")
    terms = spark.range(min(b, c) + 1)
    p = F.exp(log_factorial(m) - log_factorial(k) - log_factorial(m - k) + m * F.ln(F.lit(0.5)))
    return terms.agg(F.max(m).alias("discordant"), F.round(F.least(2 * F.sum(p), F.lit(1.0)), 6).alias("p"))
