"""Pixel operators: backgrounds, box integration, radial profiles, calibration, peaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillframe.plans.registry import query, view


def spot_pixels(pixels: DataFrame, spots: DataFrame, reach: int, by: list[str]) -> DataFrame:
    """Pixels within ``reach`` (Chebyshev) of each spot (css, cfs), of its frame (and panel, if it is in
    ``by``); ``ring`` is the distance.  Both sides are dealt into tiles as wide as a box, so that a spot is a
    row for each of the four tiles at most that its box meets, not for each of its pixels; the join is on
    tiles, the distance decides within them."""
    tile = 2 * reach + 1
    number = lambda c: F.floor(c / tile)
    for n in ("ss", "fs"):
        spots = spots.withColumn(f"_{n}", F.explode(F.sequence(number(F.col(f"c{n}") - reach), number(F.col(f"c{n}") + reach))))
    dealt = pixels.withColumns({f"_{n}": number(F.col(n)) for n in ("ss", "fs")})
    ring = F.greatest(F.abs(F.col("ss") - F.col("css")), F.abs(F.col("fs") - F.col("cfs")))
    return spots.join(dealt, [*by, "_ss", "_fs"]).drop("_ss", "_fs").withColumn("ring", ring).where(F.col("ring") <= reach)


KEY = ["frame", "css", "cfs"]


def spots(spark, sf_dir) -> DataFrame:
    """Boxes' centres on a grid of every frame."""
    return view(spark, sf_dir, "frame_images").where("ss % 16 = 8 and fs % 16 = 8").select("frame", F.col("ss").alias("css"), F.col("fs").alias("cfs"))


GATHER = "(select r.frame, r.ss as css, r.fs as cfs, i.adu, greatest(abs(i.ss-r.ss), abs(i.fs-r.fs)) as ring from frame_images r join frame_images i on i.frame = r.frame and i.ss between r.ss-8 and r.ss+8 and i.fs between r.fs-8 and r.fs+8 where r.ss % 16 = 8 and r.fs % 16 = 8)"


def gathered(spark, sf_dir, radius: int = 8) -> DataFrame:
    """Range join of reflections and pixels as an equi join on tiles."""
    return spot_pixels(view(spark, sf_dir, "frame_images"), spots(spark, sf_dir), radius, ["frame"])


@query("join10_box_gather", f"select frame, css, cfs, count(*) as n, round(sum(adu), 4) as total from {GATHER} group by frame, css, cfs", "frame_images")
def join10(spark, sf_dir):
    return gathered(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), F.round(F.sum("adu"), 4).alias("total"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once; a column of its own would be copied into every use, and
    into lambdas for each element."""
    return F.transform(F.array(value), fn)[0]


def _median(ordered: Column) -> Column:
    """Of an ordered array, the mean of the two in the middle if they are two; null if it is empty."""
    n = F.size(ordered)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, at((n + 1) / 2)).otherwise(0.5 * at(n / 2) + 0.5 * at(n / 2 + 1)))


def clipped(px: DataFrame, by: list[str], value: Column, nsig: float, *more: Column) -> DataFrame:
    """by, the aggregates ``more``, and ``bg``, from one grouping: ``bg`` is the mean of the values (nulls are
    none) within nsig scales of their median; the scale is the larger of 1.4826 MAD and
    sqrt(max(median, 1)).  A group's values meet in one row, as in any exact median."""
    def mean(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))

    def kept(v: Column, med: Column) -> Column:
        off = lambda x: F.abs(x - med)
        mad = _let(F.array_sort(F.transform(v, off)), _median)
        scale = F.greatest(1.4826 * mad, F.sqrt(F.greatest(med, F.lit(1.0))))
        return _let(nsig * scale, lambda most: _let(F.filter(v, lambda x: off(x) <= most), mean))

    own = [c.alias(f"_more{i}") for i, c in enumerate(more)]
    g = px.groupBy(*by).agg(F.collect_list(value).alias("_v"), *own)
    return g.withColumn("bg", _let(F.array_sort("_v"), lambda v: _let(_median(v), lambda med: kept(v, med)))).drop("_v")


def clipped_mean(px: DataFrame, by: list[str], value: str, nsig: float = 5.0) -> DataFrame:
    """Per group: mean of the values within nsig scales of the median; the scale is the
    larger of 1.4826 MAD and sqrt(max(median, 1))."""
    return clipped(px, by, F.col(value), nsig)


ANNULUS = f"(select * from {GATHER} where ring > 5)"
BG = f"(select frame, css, cfs, avg(adu) as bg from (select g.*, m.med, m.mad from {ANNULUS} g join (select frame, css, cfs, max(med) as med, median(abs(adu-med)) as mad from (select g.*, median(adu) over (partition by frame, css, cfs) as med from {ANNULUS} g) group by frame, css, cfs) m using (frame, css, cfs)) where abs(adu-med) <= 5*greatest(1.4826*mad, sqrt(greatest(med,1))) group by frame, css, cfs)"


@query("agg18_clipmean", f"select frame, css, cfs, round(bg, 6) as bg from {BG}", "frame_images")
def agg18(spark, sf_dir):
    return clipped_mean(gathered(spark, sf_dir).where("ring > 5"), KEY, "adu").withColumn("bg", F.round("bg", 6))


@query("agg19_box_integrate", f"select frame, css, cfs, round(s - n*bg, 4) as i, round(sqrt(greatest(s + n*greatest(bg,0), 1)), 6) as sigma, peak from (select frame, css, cfs, sum(adu) as s, count(*) as n, max(adu) as peak from {GATHER} where ring <= 3 group by frame, css, cfs) b join {BG} g using (frame, css, cfs)", "frame_images")
def agg19(spark, sf_dir):
    """Background-subtracted sums over the inner box, with their error."""
    inner, outer = F.col("ring") <= 3, F.col("ring") > 5
    adu = F.when(inner, F.col("adu"))
    own = {"s": F.sum(adu), "n": F.count_if(inner), "peak": F.max(adu), "around": F.count_if(outer)}
    b = clipped(gathered(spark, sf_dir), KEY, F.when(outer, F.col("adu")), 5.0, *own.values()).toDF(*KEY, *own, "bg")
    i = F.col("s") - F.col("n") * F.col("bg")
    e = F.sqrt(F.greatest(F.col("s") + F.col("n") * F.greatest("bg", F.lit(0.0)), F.lit(1.0)))
    return b.where("n > 0 and around > 0").select(*KEY, F.round(i, 4).alias("i"), F.round(e, 6).alias("sigma"), "peak")


TERMS = "(select frame, floor(t) + o as bin, adu, case when o = 1 then t-floor(t) else 1-(t-floor(t)) end as w from (select frame, adu, sqrt(cast((ss-32)*(ss-32)+(fs-32)*(fs-32) as double))/2 - cast(0.5 as double) as t from frame_images) p, (select 0 as o union all select 1) o)"


def radial(px: DataFrame, radius, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Profile with linear pixel splitting: two (bin, weight) rows a pixel, then one
    aggregation; also the error of the mean for counting statistics."""
    t = radius / step - 0.5
    o = F.explode(F.array(F.lit(0), F.lit(1)))
    x = px.select(*by, "adu", t.alias("t"), o.alias("o")).withColumn("w", F.when(F.col("o") == 1, F.col("t") - F.floor("t")).otherwise(1 - (F.col("t") - F.floor("t"))))
    den = F.sum("w")
    return x.groupBy(*by, (F.floor("t") + F.col("o")).cast("long").alias("bin")).agg(F.try_divide(F.sum(F.col("w") * F.col("adu")), den).alias("mean"), F.try_divide(F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("adu"))), den).alias("error"))


@query("agg21_radial_profile", f"select frame, cast(bin as bigint) as bin, round(sum(w*adu)/sum(w), 6) as mean, round(sqrt(sum(w*w*adu))/sum(w), 6) as error from {TERMS} group by frame, bin having sum(w) > 0.001", "frame_images")
def agg21(spark, sf_dir):
    """Each frame's profile about its middle."""
    i = view(spark, sf_dir, "frame_images")
    r = F.sqrt(((F.col("ss") - 32) * (F.col("ss") - 32) + (F.col("fs") - 32) * (F.col("fs") - 32)).cast("double"))
    return radial(i, r, 2.0, ("frame",)).where("mean is not null").select("frame", "bin", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query("agg20_common_mode", "select frame, ss, round(sum(adu - case when n > 10 and abs(m) < 100 then m else 0 end), 4) as total from (select *, median(adu) filter (adu < 100) over (partition by frame, ss) as m, count(*) filter (adu < 100) over (partition by frame, ss) as n from frame_images) group by frame, ss", "frame_images")
def agg20(spark, sf_dir):
    """Masked exact median of each row taken off, unless too few pixels or too large."""
    i = view(spark, sf_dir, "frame_images")
    ok = F.when(F.col("adu") < 100, F.col("adu"))
    m = i.groupBy("frame", "ss").agg(F.median(ok).alias("m"), F.count(ok).alias("n"))
    use = F.when((F.col("n") > 10) & (F.abs("m") < 100), F.col("m")).otherwise(0.0)
    return i.join(m, ["frame", "ss"]).groupBy("frame", "ss").agg(F.round(F.sum(F.col("adu") - use), 4).alias("total"))


@query("prj31_calibrate", "select frame, cast(ss % 4 as int) as bank, round(sum(case when raw & 1 = 1 then (raw - 3)*cast('0.5' as double) else cast(raw - 1 as double) end), 4) as total from (select frame, ss, cast(adu as bigint) as raw from frame_images) where raw & 4 = 0 group by 1, 2", "frame_images")
def prj31(spark, sf_dir):
    """Gain by a bit of the raw value, pedestal, and a mask bit."""
    raw = F.col("adu").cast("long")
    v = F.when(raw.bitwiseAND(1) == 1, (raw - 3) * 0.5).otherwise((raw - 1).cast("double"))
    return view(spark, sf_dir, "frame_images").where(raw.bitwiseAND(4) == 0).groupBy("frame", (F.col("ss") % 4).cast("int").alias("bank")).agg(F.round(F.sum(v), 4).alias("total"))


@query("agg24_scatter_max", "select frame, cast((ss*7+fs*3) % 50 as int) as slot, max(adu) as top, round(sum(adu), 4) as total from frame_images group by 1, 2", "frame_images")
def agg24(spark, sf_dir):
    slot = ((F.col("ss") * 7 + F.col("fs") * 3) % 50).cast("int")
    return view(spark, sf_dir, "frame_images").groupBy("frame", slot.alias("slot")).agg(F.max("adu").alias("top"), F.round(F.sum("adu"), 4).alias("total"))


@query("agg25_first_index", "select frame, adu, min(ss*64+fs) as first_at from frame_images group by frame, adu", "frame_images")
def agg25(spark, sf_dir):
    return view(spark, sf_dir, "frame_images").groupBy("frame", "adu").agg(F.min(F.col("ss") * 64 + F.col("fs")).alias("first_at"))


@query("join18_bin_matrix", "select frame, bin, round(sum(w*adu), 4) as total from frame_images i join (select distinct ss, fs, (ss+fs) // 8 as bin, cast(1 + (ss % 3) as double)/3 as w from frame_images) m using (ss, fs) group by frame, bin", "frame_images")
def join18(spark, sf_dir):
    """Sparse matrix times image: an equi join on the pixel and a sum per bin."""
    i = view(spark, sf_dir, "frame_images")
    # a row a pixel of the detector, which all frames share
    m = i.select("ss", "fs").distinct().select("ss", "fs", F.floor((F.col("ss") + F.col("fs")) / 8).cast("int").alias("bin"), ((1 + F.col("ss") % 3) / 3.0).alias("w"))
    return i.join(m, ["ss", "fs"]).groupBy("frame", "bin").agg(F.round(F.sum(F.col("w") * F.col("adu")), 4).alias("total"))


@query("agg41_profile_corr", "select frame, round(corr(a, b), 6) as r from (select frame, bin, avg(adu) as a from (select frame, cast((ss-32)*(ss-32)+(fs-32)*(fs-32) as bigint) // 40 as bin, adu from frame_images where ss < 32) group by frame, bin) x join (select frame, bin, avg(adu) as b from (select frame, cast((ss-32)*(ss-32)+(fs-32)*(fs-32) as bigint) // 40 as bin, adu from frame_images where ss >= 32) group by frame, bin) y using (frame, bin) group by frame", "frame_images")
def agg41(spark, sf_dir):
    """Correlation of two half-image profiles over their common bins."""
    i = view(spark, sf_dir, "frame_images").withColumn("bin", F.floor(((F.col("ss") - 32) * (F.col("ss") - 32) + (F.col("fs") - 32) * (F.col("fs") - 32)) / 40))
    a, b = (i.where(w).groupBy("frame", "bin").agg(F.avg("adu").alias(n)) for w, n in (("ss < 32", "a"), ("ss >= 32", "b")))
    return a.join(b, ["frame", "bin"]).groupBy("frame").agg(F.round(F.corr("a", "b"), 6).alias("r"))
