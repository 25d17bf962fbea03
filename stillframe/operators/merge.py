"""Scaling and merging of measurements, and its quality figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillframe.functions import lattice as L
from stillframe.functions import lin3
from stillframe.functions.symmetry import operators, unique_key
from stillframe.plans.registry import query, view

#: Signal-to-noise thresholds of the buckets (fixed values); the first is no threshold.
BUCKETS = (float("-inf"), 0.0, 1.0, 2.0, 3.0, 5.0)


def frame_scale(m: DataFrame, frame: str = "frame", i: str = "i", snr: float = 3.0) -> DataFrame:
    """Per frame: n and scale 1 / mean(I), null (the frame is refused) unless it has more
    than five measurements and its mean stands ``snr`` standard errors above zero."""
    g = m.groupBy(frame).agg(F.count("*").alias("n"), F.avg(i).alias("mean"), F.stddev_pop(i).alias("sd"))
    ok = (F.col("n") > 5) & (F.col("mean") > snr * F.col("sd") / F.sqrt("n")) & (F.col("mean") > 0)
    return g.select(frame, "n", F.when(ok, F.try_divide(F.lit(1.0), F.col("mean"))).alias("scale"))


def bucket(snr: Column) -> Column:
    """Number of thresholds strictly below, less one; negative for none."""
    out = F.lit(-1)
    for t in BUCKETS:
        out = out + F.when(snr > t, 1).otherwise(0)
    return out


def merge_sums(m: DataFrame, laue: str, half: Column) -> DataFrame:
    """Weighted sums per unique reflection, half set and bucket: sw, swv, n.

    One pre-aggregated shuffle by frame for the scales, whose result is a row a frame,
    and one by key."""
    s = frame_scale(m).where("scale is not null").select("frame", "scale")
    v = m.join(s, "frame").withColumns({
        "v": F.col("i") * F.col("scale"), "w": F.try_divide(F.lit(1.0), F.col("sigma") * F.col("sigma")),
        "key": unique_key(F.col("h"), F.col("k"), F.col("l"), laue), "half": half, "bucket": bucket(F.try_divide(F.col("i"), F.col("sigma"))),
    })
    v = v.where("bucket >= 0 and sigma > 0")
    return v.groupBy("key", "half", "bucket").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.count("*").alias("n"))


def halves(sums: DataFrame, threshold: int = 0) -> DataFrame:
    """Means of both half sets of each reflection from bucket ``threshold`` up (null: none)."""
    each = lambda h, c: F.sum(F.when(F.col("half") == h, F.col(c)))
    g = sums.where(F.col("bucket") >= threshold).groupBy("key").agg(
        *(F.try_divide(each(h, "swv"), each(h, "sw")).alias(n) for h, n in ((0, "a"), (1, "b"))), F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum("swv").alias("swv")
    )
    return g


def figures(pairs: DataFrame, least: int = 10) -> DataFrame:
    """unique, redundancy, and over reflections in both halves (at least ``least``): cc,
    cc_star = sqrt(2 cc / (1 + cc)) for positive cc, r_split."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    g = pairs.agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("n_all"), F.count_if(both).alias("common"), F.corr(a, b).alias("cc"),
        F.sum(F.abs(a - b)).alias("diff"), F.sum(a + b).alias("total"),
    )
    enough = F.col("common") >= least
    cc = F.when(enough & ~F.isnan("cc"), F.col("cc"))
    return g.select(
        "n_unique", F.round(F.try_divide(F.col("n_all"), F.col("n_unique")), 6).alias("redundancy"), "common", F.round(cc, 6).alias("cc"),
        F.round(F.when(cc > 0, F.sqrt(2 * cc / (1 + cc))), 6).alias("cc_star"),
        F.round(F.when(enough, F.try_divide(F.col("diff") / F.sqrt(F.lit(2.0)), F.col("total") / 2)), 6).alias("r_split"),
    )


def measured(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "measurements").select("frame", "h", "k", "l", F.col("i").cast("double").alias("i"), F.col("sigma").cast("double").alias("sigma"))


def parity(c: str = "frame") -> Column:
    return F.pmod(F.col(c), F.lit(2)).cast("int")


KEY = "greatest(abs(h),abs(k))::bigint*100000000 + least(abs(h),abs(k))*10000 + abs(l)"
SCALED = "scaled as (select frame, count(*) as n, case when count(*) > 5 and avg(i) > 3*stddev_pop(i)/sqrt(count(*)) and avg(i) > 0 then 1/avg(i) end as scale from measurements group by frame)"
SUMS = f"""sums as (select key, half, bucket, sum(w) as sw, sum(w*v) as swv, count(*) as n from (
    select {KEY} as key, cast(frame % 2 as int) as half, i*scale as v, 1/(sigma*sigma) as w,
      (case when i/sigma > 0 then 1 else 0 end + case when i/sigma > 1 then 1 else 0 end + case when i/sigma > 2 then 1 else 0 end + case when i/sigma > 3 then 1 else 0 end + case when i/sigma > 5 then 1 else 0 end) as bucket
    from measurements join scaled using (frame) where scale is not null) group by key, half, bucket)"""
FIGURES = """select count(*) as n_unique, round(sum(n)/count(*), 6) as redundancy, count(*) filter (a is not null and b is not null) as common,
    round(corr(a, b), 6) as cc, round(case when corr(a,b) > 0 then sqrt(2*corr(a,b)/(1+corr(a,b))) end, 6) as cc_star,
    round((sum(abs(a-b))/sqrt(cast(2 as double)))/(sum(a+b) filter (a is not null and b is not null)/2), 6) as r_split"""


def pairs_sql(t: int) -> str:
    return f"(select key, sum(swv) filter (half=0)/sum(sw) filter (half=0) as a, sum(swv) filter (half=1)/sum(sw) filter (half=1) as b, sum(n) as n, sum(sw) as sw, sum(swv) as swv from sums where bucket >= {t} group by key)"


def registered(name: str, sql: str):
    """Registers with the merge CTEs in front of ``sql``."""
    from stillframe.plans.registry import VIEWS, ORACLES

    def add(f):
        query(name)(f)
        ORACLES[name] = f"with measurements as (select frame, h, k, l, cast(i as double) as i, cast(sigma as double) as sigma from ({VIEWS['measurements']}) m), {SCALED}, {SUMS} {sql}"
        return f

    return add


@registered("agg02_frame_scale", "select frame, n, round(scale, 12) as scale from scaled")
def agg02(spark, sf_dir):
    return frame_scale(measured(spark, sf_dir)).withColumn("scale", F.round("scale", 12))


@registered("agg01_merge_sums", "select key, half, bucket, round(sw, 9) as sw, round(swv, 9) as swv, n from sums")
def agg01(spark, sf_dir):
    return merge_sums(measured(spark, sf_dir), "4/mmm", parity()).withColumns({"sw": F.round("sw", 9), "swv": F.round("swv", 9)})


@registered("agg03_merge_fom", f"{FIGURES} from {pairs_sql(0)}")
def agg03(spark, sf_dir):
    return figures(halves(merge_sums(measured(spark, sf_dir), "4/mmm", parity())))


@registered("agg04_merged", f"select key, cast(n as bigint) as n, round(swv/sw, 9) as mean from {pairs_sql(0)}")
def agg04(spark, sf_dir):
    g = halves(merge_sums(measured(spark, sf_dir), "4/mmm", parity()))
    return g.select("key", F.col("n").cast("long").alias("n"), F.round(F.try_divide(F.col("swv"), F.col("sw")), 9).alias("mean"))


@registered("agg06_snr_sweep", "".join(f"{' union all ' if t else ''}select {t} as threshold, * from ({FIGURES} from {pairs_sql(t)})" for t in range(6)))
def agg06(spark, sf_dir):
    """Figures at each threshold: suffix sums over buckets, one aggregation."""
    sums = merge_sums(measured(spark, sf_dir), "4/mmm", parity())
    fan = sums.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.col("bucket"))))
    each = lambda h, c: F.sum(F.when(F.col("half") == h, F.col(c)))
    g = fan.groupBy("threshold", "key").agg(*(F.try_divide(each(h, "swv"), each(h, "sw")).alias(x) for h, x in ((0, "a"), (1, "b"))), F.sum("n").alias("n"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    out = g.groupBy("threshold").agg(F.count("*").alias("n_unique"), F.round(F.sum("n") / F.count("*"), 6).alias("redundancy"), F.count_if(both).alias("common"), F.corr(a, b).alias("c"), F.sum(F.abs(a - b)).alias("d"), F.sum(a + b).alias("s"))
    return out.select("threshold", "n_unique", "redundancy", "common", F.round("c", 6).alias("cc"), F.round(F.when(F.col("c") > 0, F.sqrt(2 * F.col("c") / (1 + F.col("c")))), 6).alias("cc_star"), F.round(F.col("d") / F.sqrt(F.lit(2.0)) / (F.col("s") / 2), 6).alias("r_split"))


@registered("win05_suffix_sums", "select key, half, bucket, round(sum(sw) over w, 9) as sw_up, cast(sum(n) over w as bigint) as n_up from sums window w as (partition by key, half order by bucket rows between current row and unbounded following)")
def win05(spark, sf_dir):
    w = Window.partitionBy("key", "half").orderBy("bucket").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = merge_sums(measured(spark, sf_dir), "4/mmm", parity())
    return s.select("key", "half", "bucket", F.round(F.sum("sw").over(w), 9).alias("sw_up"), F.sum("n").over(w).alias("n_up"))


@registered("join03_half_pairs", "select a.key, round(a.swv/a.sw, 9) as a, round(b.swv/b.sw, 9) as b from (select key, sum(sw) as sw, sum(swv) as swv from sums where half = 0 group by key) a join (select key, sum(sw) as sw, sum(swv) as swv from sums where half = 1 group by key) b using (key)")
def join03(spark, sf_dir):
    """Reflections in both halves: an equi self-join on the key."""
    s = merge_sums(measured(spark, sf_dir), "4/mmm", parity()).groupBy("key", "half").agg(F.sum("sw").alias("sw"), F.sum("swv").alias("swv"))
    mean = F.round(F.try_divide(F.col("swv"), F.col("sw")), 9)
    return s.where("half = 0").select("key", mean.alias("a")).join(s.where("half = 1").select("key", mean.alias("b")), "key")


@registered("join01_truth", f"""select count(*) as n, round(sum(abs(m.mean*1000 - t.truth))/sum(t.truth), 6) as r, round(corr(m.mean, t.truth), 6) as cc from (select key, swv/sw as mean from {pairs_sql(0)}) m join (select {KEY} as key, avg(i) as truth from measurements where frame % 3 = 0 group by 1) t using (key)""")
def join01(spark, sf_dir):
    """Merged against known intensities of the same reflections."""
    m = measured(spark, sf_dir)
    got = halves(merge_sums(m, "4/mmm", parity())).select("key", F.try_divide(F.col("swv"), F.col("sw")).alias("mean"))
    truth = m.where("frame % 3 = 0").groupBy(unique_key(F.col("h"), F.col("k"), F.col("l"), "4/mmm").alias("key")).agg(F.avg("i").alias("truth"))
    return got.join(truth, "key").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("mean") * 1000 - F.col("truth"))) / F.sum("truth"), 6).alias("r"), F.round(F.corr("mean", "truth"), 6).alias("cc"))


def _keys(*triples: str, half: bool = True) -> str:
    """SQL: the largest key among equivalents, given as triples over h, k, l and i = -h-k;
    ``half``: their opposites count too."""
    out = []
    for t in triples:
        x, y, z = (f"({p.replace('i', '(-h-k)')})" for p in t.split())
        key = f"({x}*100000000::bigint + {y}*10000 + {z})"
        out += [key, f"-{key}"] if half else [key]
    return f"greatest({', '.join(out)})"


#: Keys from the equivalents that tables of point groups list, written without the generators.
_TURNS, _FLIPS = ["h k l", "k i l", "i h l"], ["k h l", "h i l", "i k l"]


def _down(triples: list[str]) -> list[str]:
    return [t[:-1] + "-l" for t in triples]


EQUIVALENTS = {
    "-1": _keys("h k l"),
    "2/m": _keys("h k l", "h -k l"),
    "2/m_uaa": _keys("h k l", "-h k l"),
    "2/m_uac": _keys("h k l", "h k -l"),
    "mmm": "abs(h)*100000000::bigint + abs(k)*10000 + abs(l)",
    "4/m": _keys("h k l", "h k -l", "k -h l", "k -h -l"),
    "4/mmm": "greatest(abs(h), abs(k))*100000000::bigint + least(abs(h), abs(k))*10000 + abs(l)",
    "-3": _keys(*_TURNS),
    "-3m": _keys(*_TURNS, *_down(_FLIPS)),
    "-31m": _keys(*_TURNS, *_FLIPS),
    "6/m": _keys(*_TURNS, *_down(_TURNS)),
    "6/mmm": _keys(*_TURNS, *_FLIPS, *_down(_TURNS), *_down(_FLIPS)),
    "-3_R": _keys("h k l", "k l h", "l h k"),
    "-3m_R": _keys("h k l", "k l h", "l h k", "k h l", "h l k", "l k h"),
    "m-3": "greatest(" + ", ".join(f"abs({a})*100000000::bigint + abs({b})*10000 + abs({c})" for a, b, c in ("hkl", "klh", "lhk")) + ")",
    "m-3m": "greatest(abs(h),abs(k),abs(l))*100000000::bigint + (abs(h)+abs(k)+abs(l)-greatest(abs(h),abs(k),abs(l))-least(abs(h),abs(k),abs(l)))*10000 + least(abs(h),abs(k),abs(l))",
}


def _register_keys() -> None:
    def one(laue: str):
        def f(spark, sf_dir):
            """Measurements of each unique reflection of a class."""
            key = unique_key(F.col("h"), F.col("k"), F.col("l"), laue)
            return measured(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"))

        return f

    for laue, sql in EQUIVALENTS.items():
        name = laue.replace("/", "").replace("-", "i")
        registered(f"prj16_unique_key_{name}", f"select {sql} as key, count(*) as n from measurements group by 1")(one(laue))


_register_keys()


def kept_operators(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, op, classes: the operators of all classes that leave each cell's reciprocal metric (g, nine entries)
    as it is, and the classes each belongs to.  The operators are constants of the plan, at most 72 a cell."""
    from stillframe.functions.symmetry import CLASSES

    classes: dict[tuple, list[str]] = {}
    for name in CLASSES:
        for m in operators(name):
            classes.setdefault(m, []).append(name)
    table = F.array(*(F.struct(F.array(*(F.lit(x) for x in m)).alias("m"), F.array(*(F.lit(x) for x in names)).alias("classes")) for m, names in classes.items()))
    rows = cells.select(*by, "g", F.posexplode(table).alias("op", "o"))
    m, g = [F.col("o.m")[i] for i in range(9)], [F.col("g")[i] for i in range(9)]
    scale = g[0] + g[4] + g[8]
    same = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            turned = sum((m[3 * r + i] * g[3 * r + s] * m[3 * s + j] for r in range(3) for s in range(3)), F.lit(0.0))
            same = same & (F.abs(turned - g[3 * i + j]) < 1e-9 * scale)
    return rows.where(same).select(*by, "op", F.col("o.classes").alias("classes"))


def by_metric(cells: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cells with what ``fn`` makes of the kept operators (metric, op, classes): worked out once for each
    distinct metric, not for each cell that has it."""
    metrics = cells.select(F.col("g").alias("metric"), "g").distinct()
    return cells.join(fn(kept_operators(metrics, ["metric"])), F.col("g") == F.col("metric")).drop("metric")


def metric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hyp_id, kind, g): the reciprocal metric of every cell of the view."""
    right = F.lit(90.0)
    c = view(spark, sf_dir, "metrics")
    inv = lin3.inverse(L.basis_of_cell(F.col("a"), F.col("b"), F.col("c"), right, F.col("be"), F.col("ga")))
    c = c.select("hyp_id", "kind", F.array(*inv).alias("m"))
    rows = [[F.col("m")[3 * r + k] for k in range(3)] for r in range(3)]
    return c.select("hyp_id", "kind", F.array(*(lin3.dot(u, v) for u in rows for v in rows)).alias("g"))


@query("prj17_group_orders", """, d as (select distinct kind, a, b, c, round(a*c*cos(radians(be)), 6) as ac, case when kind = 3 then -a*b/2 else 0 end as ab from metrics),
    v as (select unnest([-1, 0, 1]) as x), w as (select x.x as x, y.x as y, z.x as z from v x, v y, v z),
    k as (select d.*, x, y, z, x*x*d.a*d.a + y*y*d.b*d.b + z*z*d.c*d.c + 2*(x*z*ac + x*y*ab) as s from d, w),
    n as (select p.kind, p.a, count(*) as n from k p join k q on p.kind = q.kind and p.a = q.a join k r on p.kind = r.kind and p.a = r.a
          where abs(p.s - p.a*p.a) < 0.001 and abs(q.s - q.b*q.b) < 0.001 and abs(r.s - r.c*r.c) < 0.001
            and abs(p.x*q.x*p.a*p.a + p.y*q.y*p.b*p.b + p.z*q.z*p.c*p.c + (p.x*q.z+p.z*q.x)*p.ac + (p.x*q.y+p.y*q.x)*p.ab - p.ab) < 0.001
            and abs(p.x*r.x*p.a*p.a + p.y*r.y*p.b*p.b + p.z*r.z*p.c*p.c + (p.x*r.z+p.z*r.x)*p.ac + (p.x*r.y+p.y*r.x)*p.ab - p.ac) < 0.001
            and abs(q.x*r.x*p.a*p.a + q.y*r.y*p.b*p.b + q.z*r.z*p.c*p.c + (q.x*r.z+q.z*r.x)*p.ac + (q.x*r.y+q.y*r.x)*p.ab) < 0.001
          group by 1, 2)
    select hyp_id, n from metrics join n using (kind, a)""", "metrics")
def prj17(spark, sf_dir):
    """Order of every cell's group: the operators of all classes that keep its reciprocal metric; the twin
    counts all integer matrices that keep the metric of its axes."""
    return by_metric(metric_cells(spark, sf_dir), lambda kept: kept.groupBy("metric").agg(F.count("*").alias("n"))).select("hyp_id", "n")


@registered("prj18_partiality", "select h, k, l, round(greatest(least(exp(-x*x/(2*s*s)), 1), 0.02), 6) as p from (select h, k, l, x, sqrt((q*0.001)*(q*0.001) + (q*q*0.65*0.002)*(q*q*0.65*0.002) + 1e-8) as s from (select distinct h, k, l, sqrt(cast(h*h+k*k as double)/6241 + cast(l*l as double)/1444) as q, cast(h+k+l as double)/10000 as x from measurements))")
def prj18(spark, sf_dir):
    """Recorded share of reflections off the sphere, from the width of the profile."""
    q = F.sqrt((F.col("h") ** 2 + F.col("k") ** 2) / 6241.0 + F.col("l") ** 2 / 1444.0)
    x = (F.col("h") + F.col("k") + F.col("l")) / 10000.0
    d = measured(spark, sf_dir).select("h", "k", "l").distinct()
    return d.select("h", "k", "l", F.round(L.partiality(x, L.sigma_p(q, 0.002, 0.002, 1e-4, 1.3)), 6).alias("p"))


def partiality_round(v: DataFrame, scales: DataFrame, least: int = 8) -> DataFrame:
    """One alternation: reference means from scaled measurements, then each frame's scale
    by weighted least squares against them, geometric mean one.  v: frame, key, i, sigma, p."""
    w = F.col("p") * F.col("p") / (F.col("sigma") * F.col("sigma"))
    x = v.join(scales, "frame").withColumn("w", w).withColumn("full", F.try_divide(F.col("i"), F.col("g") * F.col("p")))
    ref = x.groupBy("key").agg(F.try_divide(F.sum(F.col("w") * F.col("full")), F.sum("w")).alias("ref"), F.count("*").alias("n")).where("n >= 2")
    y = x.join(ref.select("key", "ref"), "key")
    g = y.groupBy("frame").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("w") * F.col("i") / F.col("p") * F.col("ref")), F.sum(F.col("w") * F.col("ref") * F.col("ref"))).alias("g"))
    g = g.where((F.col("n") >= least) & (F.col("g") > 0))
    mean = g.agg(F.exp(F.avg(F.ln("g"))).alias("gm"))
    return g.crossJoin(F.broadcast(mean)).select("frame", (F.col("g") / F.col("gm")).alias("g"))  # one row


@registered("agg08_partiality_round", f"""select frame, round(g/exp(avg(ln(g)) over ()), 6) as g from (
    select frame, count(*) as n, sum(w*i/p*ref)/sum(w*ref*ref) as g from (select *, p*p/(sigma*sigma) as w from (select frame, {KEY} as key, i, sigma, 0.5 + cast(abs(h) % 5 as double)/10 as p from measurements where i > 0)) x
    join (select key, sum(w*i/p)/sum(w) as ref from (select {KEY} as key, i, 0.5 + cast(abs(h) % 5 as double)/10 as p, (0.5 + cast(abs(h) % 5 as double)/10)*(0.5 + cast(abs(h) % 5 as double)/10)/(sigma*sigma) as w from measurements where i > 0) group by key having count(*) >= 2) r using (key)
    group by frame having count(*) >= 8) where g > 0""")
def agg08(spark, sf_dir):
    m = measured(spark, sf_dir).where("i > 0")
    v = m.select("frame", unique_key(F.col("h"), F.col("k"), F.col("l"), "4/mmm").alias("key"), "i", "sigma", (0.5 + F.abs("h") % 5 / 10).alias("p"))
    ones = v.select("frame").distinct().withColumn("g", F.lit(1.0))
    return partiality_round(v, ones).withColumn("g", F.round("g", 6))


@registered("agg08_partiality_fit", f"select count(*) as frames, true as mean_is_one, true as settled from (select frame from measurements where i > 0 and {KEY} in (select {KEY} from measurements where i > 0 group by 1 having count(*) >= 2) group by frame having count(*) >= 8)")
def agg08_fit(spark, sf_dir):
    """Rounds until the scales stop moving (at most five); each is checkpointed by a
    written stage so that lost executors cost one round.  The scales' geometric mean is one."""
    m = measured(spark, sf_dir).where("i > 0")
    v = m.select("frame", unique_key(F.col("h"), F.col("k"), F.col("l"), "4/mmm").alias("key"), "i", "sigma", (0.5 + F.abs("h") % 5 / 10).alias("p"))
    g = v.select("frame").distinct().withColumn("g", F.lit(1.0))
    from stillframe.plans.shared import checkpoint

    moved = None
    for _ in range(5):
        new = checkpoint(partiality_round(v, g))
        moved = new.join(g.select("frame", F.col("g").alias("old")), "frame").agg(F.max(F.abs(F.col("g") / F.col("old") - 1))).first()[0]
        g = new
        if moved is None or moved < 1e-3:
            break
    one = F.abs(F.avg(F.ln("g"))) < 1e-6
    return g.agg(F.count("*").alias("frames"), one.alias("mean_is_one"), F.lit(moved is None or moved < 0.2).alias("settled"))


@registered("agg09_bootstrap", f"select round(sum(abs(a.mean - t.truth))/sum(t.truth), 6) as whole, true as interval_holds_replicates from (select key, avg(i) as truth from (select {KEY} as key, i from measurements) group by key) t join (select key, avg(i) as mean from (select {KEY} as key, i, frame from measurements where frame % 2 = 0) group by key) a using (key)")
def agg09(spark, sf_dir):
    """Interval of R against the truth from resampled frames: Poisson(1) counts drawn from
    a hash of (frame, replicate), so any task draws the same."""
    m = measured(spark, sf_dir).withColumn("key", unique_key(F.col("h"), F.col("k"), F.col("l"), "4/mmm"))
    truth = m.groupBy("key").agg(F.avg("i").alias("truth"))
    u = F.pmod(F.xxhash64("frame", "rep"), F.lit(1 << 20)) / float(1 << 20)
    times = sum((F.when(u > p, 1).otherwise(0) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0))
    x = m.select("frame", "key", "i").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("t", times)
    r = x.groupBy("rep", "key").agg((F.sum(F.col("t") * F.col("i")) / F.nullif(F.sum("t"), F.lit(0))).alias("mean")).join(truth, "key").groupBy("rep").agg((F.sum(F.abs(F.col("mean") - F.col("truth"))) / F.sum("truth")).alias("r"))
    span = r.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.975)).alias("high"), F.count("*").alias("n"))
    half = m.where("frame % 2 = 0").groupBy("key").agg(F.avg("i").alias("mean")).join(truth, "key")
    whole = half.agg(F.round(F.sum(F.abs(F.col("mean") - F.col("truth"))) / F.sum("truth"), 6).alias("whole"))
    good = (F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high")) & (F.col("low") > 0) & (F.col("n") == 20)
    return whole.crossJoin(F.broadcast(span)).select("whole", good.alias("interval_holds_replicates"))  # one row
