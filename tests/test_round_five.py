"""Work that grew faster than its input, or was done more than once: counted in plans, compared with plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_round_four import small  # noqa: F401  a fixture

from stillframe.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["join10_box_gather", "agg18_clipmean", "agg19_box_integrate", "krn33_integrate_frames", "krn34_integrate_stack"])
def test_boxes_meet_pixels_once(spark, name):
    """A box is no row for each of its pixels, and its pixels are joined and grouped once, not for each of their statistics."""
    text = plan(catalog.queries()[name](spark, SF))
    keyed = [line for line in text.splitlines() if "Join Inner, " in line and "_ss" in line]
    assert len(keyed) == 1 and "explode(org" not in text
    assert "median" not in text and "percentile" not in text


def test_boxes_by_tiles(spark):
    """Every pixel within reach of each spot, over edges of tiles and below zero; clipped means of few, even and null values."""
    from stillframe.operators.imaging import clipped_mean, spot_pixels

    r = random.Random(3)
    px = [(f, s, t, r.choice([None, 1.0, 2.5, 4.0, 900.0])) for f in (1, 2) for s in range(-9, 12) for t in range(-7, 9)]
    spots = [(f, i, r.randrange(-14, 15), r.randrange(-12, 13)) for f in (1, 2, 3) for i in range(30)]
    near = [(f, i, s, t, v, d) for f, i, a, b in spots for g, s, t, v in px if f == g and (d := max(abs(s - a), abs(t - b))) <= 3]
    got = spot_pixels(spark.createDataFrame(px, "frame long, ss int, fs int, adu double"), spark.createDataFrame(spots, "frame long, i int, css int, cfs int"), 3, ["frame"])
    assert sorted(map(repr, near)) == sorted(repr(tuple(x)) for x in got.select("frame", "i", "ss", "fs", "adu", "ring").collect())
    means = {(x.frame, x.i): x.bg for x in clipped_mean(got.where(F.col("ring") > 1), ["frame", "i"], "adu").collect()}
    outer = {}
    for f, i, _, _, v, d in near:
        if d > 1:
            outer.setdefault((f, i), []).append(v)
    assert outer.keys() == means.keys()
    for key, values in outer.items():
        values = [v for v in values if v is not None]
        if values:
            med = statistics.median(values)
            scale = max(1.4826 * statistics.median(abs(v - med) for v in values), max(med, 1.0) ** 0.5)
            kept = [v for v in values if abs(v - med) <= 5 * scale]
            assert means[key] == pytest.approx(statistics.mean(kept))
        else:
            assert means[key] is None


def test_pairs_of_cells_are_counted(spark, small):  # noqa: F811
    """Frames of many hypotheses of few cells, some of them twice: pairs are products of counts."""
    rows = "select * replace (p_partkey % 9 * 120 + 7 as p_partkey, p_size % 3 + 1 as p_size) from {} where p_partkey < 200 union all select * replace (p_partkey * 120 + 9 as p_partkey) from {} where p_partkey < 40"
    assert len(small("flt08_same_lattice_pairs", part=rows)) == 2
    df = catalog.queries()["flt08_same_lattice_pairs"](spark, SF)
    assert "hyp_id < " not in plan(df) and "hyp_id#" not in "".join(x for x in plan(df).splitlines() if "Join Inner" in x and "< hyp_id" in x)


def test_keys_are_short_and_the_same(spark):
    """Half of a class's operators, three products each; equal to the largest of all equivalents."""
    from stillframe.functions.symmetry import GENERATORS, operators, unique_key

    r = random.Random(2)
    rows = [tuple(r.randrange(-40, 41) for _ in "hkl") for _ in range(60)] + [(None, 1, 2), (0, 0, 0)]
    df = spark.createDataFrame(rows, "h int, k int, l int")
    for laue in GENERATORS:
        key = unique_key(F.col("h"), F.col("k"), F.col("l"), laue)
        assert str(key).count("*") <= 3 * len(operators(laue)) / 2
        got = {(x.h, x.k, x.l): x.key for x in df.select("*", key.alias("key")).collect()}
        for q, value in got.items():
            each = [] if None in q else [sum(sum(m[3 * i + j] * q[j] for j in range(3)) * s for i, s in enumerate((100_000_000, 10_000, 1))) for m in operators(laue)]
            assert value == max(each, default=None)


@pytest.mark.parametrize("name", ["prj17_group_orders", "set07_subgroup"])
def test_operators_once_a_metric(spark, small, name):  # noqa: F811
    """Cells of one metric are one row when the operators are tried, and each has its rows, twice if it is there twice."""
    rows = "select * from {} where p_partkey < 30 union all select * from {} where p_partkey = 7"
    small(name, part=rows)
    text = plan(catalog.queries()[name](spark, SF)).splitlines()
    tried = next(i for i, line in enumerate(text) if "Generate posexplode" in line)
    assert any("Aggregate" in line for line in text[tried:])


def test_tasks_follow_the_pixels(spark, monkeypatch):
    """More rows are more tasks where frames are many bytes, so that a task's memory does not grow with the input."""
    from stillframe.operators import frames

    few = catalog.queries()["krn23_find_peaks"](spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(frames, "ROOM", 500)
    df = catalog.queries()["krn23_find_peaks"](spark, SF)
    n = frames.images(spark, SF).count()
    assert few < n // 500 < df.rdd.getNumPartitions()
