"""Fourier volumes, candidate features, powder lines, simulated data sets and other kernels, each over
whole tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.functions.symmetry import unique_key
from stillframe.kernels import fourier, indexing as X, orient as O, powder, reduction as R, refine
from stillframe.operators.acceptance import INDEXED, MISS, Q, planted
from stillframe.operators.perframe import per_frame
from stillframe.operators.planted import BLIND, BLIND_EXPECTED, CELL, FRAMES, KNOWN, all_peaks, gated, judged, known_batches, of_frames, same_cell, sure, twin
from stillframe.operators.reports import closest_setting, unimodular
from stillframe.plans.registry import query, table, view
from stillframe.sinks import text as sink
from stillframe.sources import synthetic, text as source


def candidate_features(peaks: DataFrame, by: list[str]) -> DataFrame:
    """Seven features of a candidate vector's projections ``x`` per group (by, length): amplitude at
    one, two and half a period, share near a node and very near one, median distance, length."""
    d = F.abs(F.col("x") - F.rint("x"))
    amplitude = lambda s: F.sqrt(F.avg(F.cos(2 * math.pi * s * F.col("x"))) ** 2 + F.avg(F.sin(2 * math.pi * s * F.col("x"))) ** 2)
    share = lambda t: F.avg(F.when(d < t, 1.0).otherwise(0.0))
    return peaks.groupBy(*by).agg(
        amplitude(1.0).alias("fringe"), share(0.15).alias("inliers"), F.median(d).alias("median_miss"), F.first("length").alias("length"),
        share(0.05).alias("sharpness"), amplitude(2.0).alias("at_double"), amplitude(0.5).alias("at_half"),
    )


AXES = f"(select frame_id, unnest([0,1,2,3]) as axis, unnest([hf, kf, lf, hf*1.13]) as x, unnest([79.0, 79.0, 38.0, 89.27])::double as length from {INDEXED})"
_FEATURES = """round(sqrt(avg(cos(2*pi()*x))*avg(cos(2*pi()*x)) + avg(sin(2*pi()*x))*avg(sin(2*pi()*x))), 5) as fringe, round(avg(case when abs(x-round_even(x,0)) < 0.15 then cast(1 as double) else 0 end), 5) as inliers, round(median(abs(x-round_even(x,0))), 5) as median_miss, round(min(length), 5) as length,
    round(avg(case when abs(x-round_even(x,0)) < 0.05 then cast(1 as double) else 0 end), 5) as sharpness, round(sqrt(avg(cos(4*pi()*x))*avg(cos(4*pi()*x)) + avg(sin(4*pi()*x))*avg(sin(4*pi()*x))), 5) as at_double, round(sqrt(avg(cos(pi()*x))*avg(cos(pi()*x)) + avg(sin(pi()*x))*avg(sin(pi()*x))), 5) as at_half"""


def candidates(spark, sf_dir) -> DataFrame:
    """The three true axes of every frame and one that is none, projected on its peaks."""
    h = L.fractional([F.col(c) for c in Q], lin3.matrix("m"))
    each = F.array(*(F.struct(F.lit(i).alias("axis"), x.alias("x"), F.lit(n).alias("length")) for i, (x, n) in enumerate(((h[0], 79.0), (h[1], 79.0), (h[2], 38.0), (h[0] * 1.13, 89.27)))))
    return planted(spark, sf_dir).select("frame_id", F.inline(each))


@query("prj32_candidate_features", f"select frame_id, axis, {_FEATURES} from {AXES} group by frame_id, axis", "planted_q")
def prj32(spark, sf_dir):
    f = candidate_features(candidates(spark, sf_dir), ["frame_id", "axis"])
    return f.select("frame_id", "axis", *(F.round(c, 5).alias(c) for c in f.columns[2:]))


@query("src19_labelled_features", f"select frame_id, axis, axis < 3 as is_axis, {_FEATURES.split(', round(avg')[0]} from {AXES} group by frame_id, axis", "planted_q")
def src19(spark, sf_dir):
    """Labelled rows for a classifier: a candidate is an axis if it lies near a planted one."""
    f = candidate_features(candidates(spark, sf_dir), ["frame_id", "axis"])
    near = F.least(*(F.abs(F.col("length") - n) / n for n in (79.0, 38.0))) < 0.02
    return f.select("frame_id", "axis", near.alias("is_axis"), F.round("fringe", 5).alias("fringe"))


@query("pip13_volume_centre", "select frame_id, count(*) as centre, cast(null as varchar) as error from planted_q where qx*qx+qy*qy+qz*qz > 1e-12 group by frame_id", "planted_q")
def pip13(spark, sf_dir):
    """The middle of each frame's Fourier volume is its number of peaks."""
    def fn(q, m, frame):
        vol, _ = fourier.volume(X.clean(q), 32)
        return {"centre": int(round(vol[16, 16, 16]))}

    return of_frames(spark, sf_dir, fn, "centre long").drop("_matched", "_peaks")


def coarse_maxima(vol: np.ndarray, step: float, shortest: float, share: float = 0.05, most: int = 400, block: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``fourier.maxima``, looking only into blocks whose largest value is above the share."""
    n = vol.shape[0]
    top = vol.reshape(n // block, block, n // block, block, n // block, block).max(axis=(1, 3, 5))
    some = np.kron(top > share * vol.max(), np.ones((block,) * 3, dtype=bool))
    at = np.argwhere(some & (vol > share * vol.max()))
    p = np.pad(vol, 1, constant_values=-1)
    around = np.max([p[tuple((at + np.array(d)).T)] for d in np.ndindex(3, 3, 3)], axis=0)
    at = at[vol[tuple(at.T)] == around]
    v, h = (at - n // 2) * step, vol[tuple(at.T)]
    ok = np.linalg.norm(v, axis=1) >= shortest
    order = np.argsort(-h[ok], kind="stable")[:most]
    return v[ok][order], h[ok][order]


@query("top06_volume_peaks", twin("found"), "planted_q")
def top06(spark, sf_dir):
    """The short axis of sure frames is among the highest peaks of their volumes."""
    def fn(q, m, frame):
        x = X.clean(q)
        v, _ = fourier.maxima(*fourier.volume(x, 64), 20.0)
        return {"found": bool(len(v)) and float(np.min([np.linalg.norm(v - s * m[:, 2], axis=1).min() for s in (1, -1)])) < 9.0}

    return sure(of_frames(spark, sf_dir, fn, "found boolean"), "found")


@query("top07_coarse_to_fine", f"select frame_id, true as same, cast(null as varchar) as error from {FRAMES}", "planted_q")
def top07(spark, sf_dir):
    """Coarse-to-fine peaks equal those of the whole volume."""
    def fn(q, m, frame):
        vol, step = fourier.volume(X.clean(q), 32)
        a, b = fourier.maxima(vol, step, 20.0, 0.1, 50), coarse_maxima(vol, step, 20.0, 0.1, 50)
        return {"same": len(a[0]) == len(b[0]) and bool(np.allclose(np.sort(a[1]), np.sort(b[1])))}

    return of_frames(spark, sf_dir, fn, "same boolean").drop("_matched", "_peaks")


@query("krn20_central_rays", twin("found"), "planted_q")
def krn20(spark, sf_dir):
    """Spectra of projections: along the short axis of sure frames a maximum stands at its length."""
    def fn(q, m, frame):
        a, length = fourier.rays(X.clean(q), (m[:, 2] / 38.0)[None], 512)
        at = int(np.argmin(np.abs(length - 38.0)))
        return {"found": bool(a[0][at - 1 : at + 2].max() > 1.5 * np.median(a[0][2:]))}

    return sure(of_frames(spark, sf_dir, fn, "found boolean"), "found")


def nearest_to(q: np.ndarray, s: int, size: int) -> np.ndarray:
    """The ``size`` peaks nearest to peak ``s``, of equally near ones the first; by single columns, so that little more
    than a distance a peak is held."""
    d = (q[:, 0] - q[s, 0]) ** 2
    for k in (1, 2):
        x = q[:, k] - q[s, k]
        x *= x
        d += x
    if size >= len(d):
        return np.arange(len(d))
    edge = np.partition(d, size - 1)[size - 1]
    inner = np.flatnonzero(d < edge)
    return np.sort(np.r_[inner, np.flatnonzero(d == edge)[: size - len(inner)]])


def cluster_seeds(q: np.ndarray, clusters: int = 28, size: int = 300, n: int = 96, longest: float = 100.0, share: float = 0.12, most: int = 60) -> np.ndarray:
    """Vectors at the maxima of the mean spectrum of local clusters: each the ``size`` peaks
    nearest to a start, a twelfth of all at least, moved to its own middle, so that only differences
    count.  A denser frame has more peaks in the same cluster, not a smaller one of fewer nodes."""
    q = X.clean(q)
    size = max(size, len(q) // 12)
    starts = np.linspace(0, len(q) - 1, min(clusters, len(q))).astype(int)
    total = np.zeros((n, n, n))
    for s in starts:
        near = q[nearest_to(q, s, size)]
        x = near - near.mean(axis=0)
        at = np.rint((x * longest * 2 % n)).astype(int) % n
        grid = np.zeros((n, n, n))
        np.add.at(grid, tuple(at.T), 1)
        total += np.abs(np.fft.fftn(grid)) ** 2
    total[0, 0, 0] = 0
    vol = np.fft.fftshift(total)
    v, _ = fourier.maxima(vol, 2 * longest / n, 20.0, share, most)
    return v


def seeded_blind(q: np.ndarray, effort: X.Search = BLIND, least: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Blind search of a dense frame from its cluster seeds; with fewer than ``least`` peaks, or
    without three seeds, the usual starts."""
    x = X.clean(q)
    if len(x) < least:
        return X.blind(x, effort)
    seeds = cluster_seeds(x)
    if len(seeds) < 3:
        return X.blind(x, effort)
    return X.blind(x, effort, starts=seeds)


@query("krn10_seeded_blind", twin("solved", BLIND_EXPECTED), "planted_q")
def krn10(spark, sf_dir):
    """Sparse frames take the usual starts."""
    return sure(of_frames(spark, sf_dir, lambda q, m, frame: {"solved": any(same_cell(b) for b, _ in seeded_blind(q))}, "solved boolean"), "solved", BLIND_EXPECTED)


@query("krn03_weighted_blind", twin("solved", BLIND_EXPECTED), "planted_q")
def krn03(spark, sf_dir):
    """The blind search with low-resolution peaks weighted up and a stricter score."""
    def fn(q, m, frame):
        got = X.blind(q, BLIND, weight=lambda x: (w := np.linalg.norm(x, axis=1) ** -0.5) / w.mean(), score=lambda ms, x: X.rank(ms, x, 0.2))
        return {"solved": any(same_cell(b) for b, _ in got)}

    return sure(of_frames(spark, sf_dir, fn, "solved boolean"), "solved", BLIND_EXPECTED)


@query("krn29_powder", "select distinct a, b, true as explained, cast(null as varchar) as error from (select a, b from cells)", "cells")
def krn29(spark, sf_dir):
    """Twenty lines of each pattern (one per a and b of the part table, with the least c, tenths of an
    angstrom) explained by some cell with a figure of merit of ten or more."""
    c = view(spark, sf_dir, "cells").groupBy("a", "b").agg(F.min(F.col("c").cast("double")).alias("c"))
    c = c.withColumn("frame_id", (F.col("a") * 1000 + F.col("b")).cast("long"))

    def fn(_: int, rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows[["a", "b", "c"]].iloc[0].to_numpy(float) / 10
        g = powder.indices(6)
        lines = np.unique(np.round(powder.SYSTEMS["orthorhombic"](*g.T) @ cell**-2.0, 9))[:20]
        got = powder.index_lines(lines)
        return pd.DataFrame({"a": [cell[0] * 10], "b": [cell[1] * 10], "explained": [bool(got) and got[0][0] >= 10]})

    return per_frame(c, fn, "a double, b double, explained boolean").drop("frame_id")


@query("krn30_profile_peaks", "select frame_id, cast(x as double) as place, cast(null as varchar) as error from (select distinct s_suppkey as frame_id from supplier), (select unnest([12, 31, 55, 78]) as x)")
def krn30(spark, sf_dir):
    """Prominent maxima of a profile a supplier: four planted lines on a sloping background."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id")).distinct()
    b = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(99))))
    line = sum((F.exp(-((F.col("bin") - x) ** 2) / 4.0) * (40 + F.col("frame_id") % 30) for x in (12, 31, 55, 78)), F.lit(0.0))
    b = b.withColumn("y", 20 - 0.1 * F.col("bin") + line)

    def fn(_: int, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("bin")
        return pd.DataFrame({"place": np.rint(powder.profile_peaks(r["bin"].to_numpy(float), r["y"].to_numpy(float)))})

    return per_frame(b, fn, "place double")


@query("pip22_powder_design", "select a, b, c, round(9/(a*a) + 4/(b*b) + 1/(c*c), 9) as q321, round(a*b*c, 3) as volume from (select distinct a, b, cast(c as double) as c from cells)", "cells")
def pip22(spark, sf_dir):
    """Design rows and cells from free parameters, for the distinct cells."""
    @F.pandas_udf("struct<q321: double, volume: double>")
    def made(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        p = np.c_[a, b, c] ** -2.0
        row = powder.SYSTEMS["orthorhombic"](*np.array([[3], [2], [1]]))
        return pd.DataFrame({"q321": (p @ np.asarray(row, dtype=float).reshape(1, 3).T)[:, 0], "volume": [float(np.prod(powder.cell("orthorhombic", x)[:3])) for x in p]})

    c = view(spark, sf_dir, "cells").select("a", "b", F.col("c").cast("double").alias("c")).distinct().withColumn("x", made("a", "b", "c"))
    return c.select("a", "b", "c", F.round("x.q321", 9).alias("q321"), F.round("x.volume", 3).alias("volume"))


@query("pip14_standard_setting", twin("in_shape"), "planted_q")
def pip14(spark, sf_dir):
    """Perturbed bases projected on the tetragonal shape: a and b alike, right angles, about the
    planted lengths, or no farther from them than the perturbed axes are."""
    want = refine.cell_of(CELL)[:3]

    def fn(q, m, frame):
        start = m @ (np.eye(3) + np.random.default_rng([8, frame]).normal(scale=2e-3, size=(3, 3)))
        p = refine.project("tetragonal", start)
        c = refine.cell_values("tetragonal", p)
        off = np.abs(refine.cell_of(start)[:3] - want)  # some of many frames are perturbed by more than a half
        near = np.abs(c[:3] - want) <= np.maximum(0.5, [max(off[:2]), max(off[:2]), off[2]])
        return {"in_shape": abs(c[0] - c[1]) < 1e-9 and bool(np.allclose(c[3:], 90)) and bool(near.all())}

    return sure(of_frames(spark, sf_dir, fn, "in_shape boolean"), "in_shape")


@query("pip15_metric_operators", "with v as (select unnest([-1,0,1]) as v), u as (select a.v as u0, b.v as u1, c.v as u2, d.v as u3, e.v as u4, f.v as u5, g.v as u6, h.v as u7, i.v as u8 from v a, v b, v c, v d, v e, v f, v g, v h, v i where a.v*(e.v*i.v-f.v*h.v) - b.v*(d.v*i.v-f.v*g.v) + c.v*(d.v*h.v-e.v*g.v) = 1) select a, b, count(*) as n from (select distinct a, b from cells) s, u where greatest(abs((u0*u0*a*a+u3*u3*b*b+u6*u6*5329) - a*a)/(a*a), abs((u1*u1*a*a+u4*u4*b*b+u7*u7*5329) - b*b)/(b*b), abs((u2*u2*a*a+u5*u5*b*b+u8*u8*5329) - 5329)/5329) < 0.11 and abs(u0*u1*a*a+u3*u4*b*b+u6*u7*5329) < 0.06*a*b and abs(u0*u2*a*a+u3*u5*b*b+u6*u8*5329) < 0.06*a*73 and abs(u1*u2*a*a+u4*u5*b*b+u7*u8*5329) < 0.06*b*73 group by a, b".replace("with v as", "select * from (with v as", 1) + ")", "cells")
def pip15(spark, sf_dir):
    """Changes of basis that keep each cell's metric within tolerances (c taken as 73): four, or more
    where two axes are nearly alike."""
    c = view(spark, sf_dir, "cells").select("a", "b").distinct()
    u = [F.col(f"u{i}") for i in range(9)]
    g = [F.col("a") ** 2, F.col("b") ** 2, F.lit(5329.0)]
    side = [F.col("a"), F.col("b"), F.lit(73.0)]
    new = lambda i, j: sum((u[3 * k + i] * u[3 * k + j] * g[k] for k in range(3)), F.lit(0.0))
    ok = F.greatest(*(F.abs(new(i, i) - g[i]) / g[i] for i in range(3))) < 0.11
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ok = ok & (F.abs(new(i, j)) < 0.06 * side[i] * side[j])
    return c.crossJoin(F.broadcast(unimodular(spark))).where(ok).groupBy("a", "b").agg(F.count("*").alias("n"))  # 3480 rows


def uniform(*key: Column) -> Column:
    """A number in (0, 1) drawn from a key, the same in any task."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def normal(*key: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(F.lit("r"), *key))) * F.cos(2 * math.pi * uniform(F.lit("phi"), *key))


def simulated(frames: DataFrame, seed: int = 7, laue: str = "4/mmm", reach: int = 6, per_frame: float = 0.5) -> DataFrame:
    """A data set with known truth for each frame (frame): h, k, l, key, full, scale, p, i, sigma.

    ``full`` is an exponential (Wilson) intensity a unique reflection that falls off with
    resolution; a crystal has a scale, a reflection a recorded share of it; counts have their
    noise.  All numbers are drawn from keys, in expressions: no Python runs.
    """
    s = F.lit(seed)
    r = F.sequence(F.lit(-reach), F.lit(reach))
    x = frames.withColumn("h", F.explode(r)).withColumn("k", F.explode(r)).withColumn("l", F.explode(r)).where("h <> 0 or k <> 0 or l <> 0")
    x = x.where(uniform(s, F.lit("seen"), F.col("frame"), F.col("h"), F.col("k"), F.col("l")) < per_frame)
    x = x.withColumn("key", unique_key(F.col("h"), F.col("k"), F.col("l"), laue))
    q2 = (F.col("h") ** 2 + F.col("k") ** 2) / 6241.0 + F.col("l") ** 2 / 1444.0
    full = -F.ln(uniform(s, F.lit("full"), F.col("key"))) * 1000 * F.exp(-12 * q2)
    x = x.withColumns({"full": full, "scale": F.exp(0.4 * normal(s, F.lit("scale"), F.col("frame"))), "p": 0.3 + 0.7 * uniform(s, F.lit("p"), F.col("frame"), F.col("h"), F.col("k"), F.col("l"))})
    mean = F.col("full") * F.col("scale") * F.col("p")
    sigma = F.sqrt(mean + 25)
    return x.withColumn("sigma", sigma).withColumn("i", mean + sigma * normal(s, F.lit("noise"), F.col("frame"), F.col("h"), F.col("k"), F.col("l")))


@query("src18_simulated_merge", "select count(distinct frame_id) as frames, 468 as unique_reflections, true as truth_comes_back from planted_q".replace("468", "(select count(*) from (select distinct greatest(abs(h),abs(k)) as a, least(abs(h),abs(k)) as b, abs(l) as c from (select unnest(range(-6,7)) as h), (select unnest(range(-6,7)) as k), (select unnest(range(-6,7)) as l)) where a > 0 or c > 0)"), "planted_q")
def src18(spark, sf_dir):
    """A simulated data set with a crystal a planted frame: scaled means agree with the truth."""
    frames = view(spark, sf_dir, "planted_q").select(F.col("frame_id").alias("frame")).distinct()
    d = simulated(frames)
    merged = d.groupBy("key").agg(F.avg(F.col("i") / F.col("scale")).alias("mean"), F.first("full").alias("full"))
    g = merged.agg(F.count("*").alias("unique_reflections"), (F.corr("mean", "full") > 0.95).alias("truth_comes_back"))
    return g.crossJoin(F.broadcast(frames.agg(F.count("*").alias("frames")))).select("frames", "unique_reflections", "truth_comes_back")  # one row


@query("src17_simulated_shots", "select frame_id, 69 as n, 9 as spurious, true as on_lattice from (select cast(i as bigint) as frame_id from range(0, (select count(distinct s_suppkey) from supplier)) t(i))")
def src17(spark, sf_dir):
    """A simulated shot a supplier: its points, and how many lie on its lattice."""
    n = table(spark, sf_dir, "supplier").select("s_suppkey").distinct().count()
    shots = synthetic.shots(spark, n, CELL)
    m = synthetic.truths(spark, n, CELL)
    q = [F.col(c) for c in Q]
    hit = L.is_inlier(q, lin3.matrix("m"))
    g = shots.join(m, "frame_id").groupBy("frame_id").agg(F.count("*").cast("int").alias("n"), F.count_if("is_spurious").cast("int").alias("spurious"), F.count_if(hit & ~F.col("is_spurious")).alias("hits"))
    return g.select("frame_id", "n", "spurious", (F.col("hits") >= 0.95 * (F.col("n") - F.col("spurious"))).alias("on_lattice"))


@query("src21_random_rotations", "select s_suppkey as frame_id, true as proper from supplier")
def src21(spark, sf_dir):
    """A random rotation a supplier, from its key: determinant one, columns of length one."""
    @F.pandas_udf("double")
    def error(key: pd.Series) -> pd.Series:
        rs = [synthetic.rotation(np.random.default_rng([3, int(k)])) for k in key]
        return pd.Series([float(np.abs(r.T @ r - np.eye(3)).max() + abs(np.linalg.det(r) - 1)) for r in rs])

    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), (error("s_suppkey") < 1e-9).alias("proper"))


DENSITY = "(select x.a, x.b, x.c, cast(sum(y.w) as bigint) as density from (select distinct a, b, cast(c as double) as c from cells) x join (select a, b, cast(c as double) as c, count(*) as w from cells group by all) y on abs(x.a-y.a) <= 0.05*(x.a+y.a)/2 and abs(x.b-y.b) <= 0.05*(x.b+y.b)/2 and abs(x.c-y.c) <= 0.05*(x.c+y.c)/2 and abs(x.a*x.b*x.c-y.a*y.b*y.c) <= 0.10*(x.a*x.b*x.c+y.a*y.b*y.c)/2 group by x.a, x.b, x.c)"


@query("agg11_densities", f"select * from {DENSITY}", "cells")
def agg11(spark, sf_dir):
    """Hypotheses within the tolerances of each distinct cell: what groups grow from."""
    from stillframe.operators.consensus import band_join, cells_of

    c = cells_of(spark, sf_dir).groupBy("a", "b", "c").agg(F.count("*").alias("w"))
    v = [F.col(f"{t}.a") * F.col(f"{t}.b") * F.col(f"{t}.c") for t in "ab"]
    ok = F.abs(v[0] - v[1]) <= L.VOLUME_TOL * (v[0] + v[1]) / 2
    for n in "abc":
        ok = ok & (F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) <= L.LENGTH_TOL * (F.col(f"a.{n}") + F.col(f"b.{n}")) / 2)
    tol = L.LENGTH_TOL / (1 - L.LENGTH_TOL / 2)
    return band_join(c, c, ["a", "b", "c"], tol, ok).groupBy(*(F.col(f"a.{n}").alias(n) for n in "abc")).agg(F.sum("b.w").alias("density"))


@query("pip08_index_and_write", f"select frame_id as serial, passed from ({gated({})}) g", "planted_q")
def pip08(spark, sf_dir):
    """A run from end to end: frame blocks read, the known cell in batches, chunks written, and read."""
    from stillframe.operators.files import kept

    p = all_peaks(spark, sf_dir).withColumn("peak_id", F.struct("qx", "qy", "qz"))
    frames = source.read_frames(spark, kept(spark, sink.frame_blocks(p)))
    found = known_batches(frames, CELL).select(F.col("frame_id").alias("serial"), F.lit("run.h5").alias("image"), F.col("frame_id").alias("event"), F.when(L.strict(F.col("n_matched"), F.col("n_peaks")), F.col("m")).alias("m"))
    back = source.read_chunks(spark, kept(spark, sink.stream_chunks(found), sink.HEADER))
    serial = F.regexp_extract("body", r"Image serial number: (\d+)", 1).cast("long") - 1
    read = back.select(serial.alias("frame_id"), F.contains("body", F.lit("--- Begin crystal")).alias("passed"))
    return judged(read, spark, sf_dir).withColumnRenamed("frame_id", "serial")


@query("snk04_appended_chunks", f"select count(*) as n, count(distinct frame_id) as frames from {FRAMES}", "planted_q")
def snk04(spark, sf_dir):
    """A stream written in four parts, one after the other, and read as one."""
    from stillframe.operators.files import results
    from stillframe.plans.shared import shared_folder

    path = f"{shared_folder(spark)}/parts"
    c = sink.stream_chunks(results(spark, sf_dir))
    for part in range(4):
        sink.write_ordered(c.where(F.col("serial") % 4 == part), f"{path}/part={part}", sink.HEADER if part == 0 else None)
    back = source.read_chunks(spark, f"{path}/part=*")
    serial = F.regexp_extract("body", r"Image serial number: (\d+)", 1)
    return back.agg(F.count("*").alias("n"), F.count_distinct(serial).alias("frames"))


@query("snk04_committed_stream", f"select count(*) as n, count(distinct frame_id) as frames, true as in_order from {FRAMES}", "planted_q")
def snk04_stream(spark, sf_dir):
    """Chunks that arrive as files, through the committing sink in several micro-batches: each is there once,
    and in order within its part."""
    from stillframe.operators.files import results
    from stillframe.plans.shared import shared_folder
    from stillframe.sinks.stream import ChunkSink, read_committed

    folder = shared_folder(spark)
    chunks = sink.stream_chunks(results(spark, sf_dir)).select(F.col("serial").cast("long").alias("serial"), "value")
    chunks.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "serial").sortWithinPartitions("serial").write.parquet(f"{folder}/in")
    spark.dataSource.register(ChunkSink)
    arriving = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    arriving.writeStream.format("ordered_chunks").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    back = read_committed(spark, f"{folder}/out").withColumn("_at", F.monotonically_increasing_id())
    before = F.lag("serial").over(Window.partitionBy("batch", "part").orderBy("_at"))  # a part is one task's rows
    return back.withColumn("_before", before).agg(F.count("*").alias("n"), F.count_distinct("serial").alias("frames"), F.bool_and(F.coalesce(F.col("_before") < F.col("serial"), F.lit(True))).alias("in_order"))


@query("snk09_event_records", "select event_type as outcome, count(*) as n, round(sum(value), 2) as value from events group by event_type")
def snk09(spark, sf_dir):
    """Events as JSON records for a callback, read again."""
    from stillframe.operators.files import kept

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("serial"), F.to_json(F.struct(F.col("event_id").alias("ev"), F.col("event_type").alias("outcome"), "value")).alias("value"))
    back = spark.read.schema("ev long, outcome string, value double").json(kept(spark, e))
    return back.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
