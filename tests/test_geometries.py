"""Geometry texts by detector, overlaps, sublattices, metric symmetry and the figure of merit against plain loops."""

import numpy as np
import pytest

from stillframe.functions.symmetry import CLASSES, operators

PANEL = "{p}/min_fs = 0\n{p}/max_fs = 9\n{p}/min_ss = 0\n{p}/max_ss = 9\n{p}/corner_x = 1\n{p}/corner_y = 2\n{p}/fs = x\n{p}/ss = y\n"


def test_each_text_has_its_own_defaults_and_numbers(spark):
    from stillframe.sources.text import parse_geometry, slab_axes

    first = "res = 10\n" + PANEL.format(p="a") + "res = 20\n" + PANEL.format(p="b") + "b/dim0 = %\nb/dim1 = ss\n"
    second = "coffset = 0.5\nres = 30\n" + PANEL.format(p="a") + "a/res = 7\nbad1/dim0 = %\n"
    texts = spark.createDataFrame([(1, first, "x"), (2, second, "x"), (3, None, "x"), (4, "", "x"), (5, "no pairs", "x")], "det int, text string, ord string")
    got = {(r.det, r.panel): (r.ord, r.res, r.coffset) for r in parse_geometry(texts, ["det"]).collect()}
    assert got == {(1, "a"): (0, 10.0, 0.0), (1, "b"): (1, 20.0, 0.0), (2, "a"): (0, 7.0, 0.5)}
    assert [tuple(r) for r in slab_axes(texts, ["det"]).collect()] == [(1, "b", 2, 1)]
    assert parse_geometry(texts.where("det > 9"), ["det"]).count() == 0


def test_a_panel_without_a_resolution_is_named(spark):
    from stillframe.sources.text import parse_geometry

    texts = spark.createDataFrame([(1, PANEL.format(p="late") + "res = 10\n")], "det int, text string")
    with pytest.raises(Exception, match="no resolution for panel late"):
        parse_geometry(texts, ["det"]).collect()


def test_overlaps_stay_within_a_detector(spark):
    from stillframe.operators.geometry import overlaps

    rows = [(1, 0, 0, 9, 0, 9), (1, 1, 9, 12, 9, 12), (1, 2, 10, 12, 0, 8), (2, 0, 0, 9, 0, 9), (None, 0, 0, 9, 0, 9), (None, 1, 0, 9, 0, 9)]
    p = spark.createDataFrame(rows, "det int, ord int, min_fs int, max_fs int, min_ss int, max_ss int")
    assert [tuple(r) for r in overlaps(p, ["det"]).select("a.det", "a.ord", "b.ord").collect()] == [(1, 0, 1)]


def test_sublattices_are_distinct_and_inside(spark):
    from stillframe.operators.files import sublattices

    m = [50.0, 3.0, -2.0, 0.0, 61.0, 5.0, 0.0, 0.0, 70.0]
    cells = spark.createDataFrame([(1, m)], "id int, m array<double>")
    base = np.reshape(m, (3, 3))
    seen: dict[int, set] = {}
    for r in sublattices(cells, ["id"], 4).collect():
        whole = np.linalg.solve(base, np.reshape(r.m, (3, 3))).T  # rows: new axes by the old ones
        assert np.allclose(whole, whole.round(), atol=1e-9) and round(np.linalg.det(whole)) == r.idx
        seen.setdefault(r.idx, set()).add(tuple(whole.round().astype(int).ravel()))
    assert {i: len(s) for i, s in seen.items()} == {1: 1, 2: 7, 3: 13, 4: 35}


@pytest.mark.parametrize("axes, angle, want", [((40, 53, 69), 90, "mmm"), ((40, 40, 69), 90, "4/mmm"), ((40, 40, 40), 90, "m-3m"), ((40, 40, 69), 120, "6/mmm")])
def test_a_metric_keeps_its_own_operators(spark, axes, angle, want):
    from stillframe.operators.merge import kept_operators

    a, b, c = axes
    g = np.diag(np.square(axes).astype(float))
    g[0, 1] = g[1, 0] = a * b * np.cos(np.radians(angle))
    star = np.linalg.inv(g)
    cells = spark.createDataFrame([(1, [float(x) for x in star.ravel()])], "id int, g array<double>")
    rows = kept_operators(cells, ["id"]).collect()
    every = {m for n in CLASSES for m in operators(n)}
    kept = {m for m in every if np.allclose(np.reshape(m, (3, 3)).T @ star @ np.reshape(m, (3, 3)), star, rtol=0, atol=1e-12)}
    assert len(rows) == len(kept) == len(operators(want))
    assert {n for n in CLASSES if sum(n in r.classes for r in rows) == len(operators(n))} == {n for n in CLASSES if set(operators(n)) <= kept}


def test_merit_of_each_group(spark):
    from stillframe.operators.predict import figure_of_merit

    calc = [0.001 * i for i in range(1, 41)]
    lines = {1: [0.001 * i + 0.0001 for i in range(1, 31)], 2: [0.0012, 0.0031]}
    observed = spark.createDataFrame([(g, q) for g, qs in lines.items() for q in qs], "g int, qo double")
    got = {r.g: (r.m20, r.n) for r in figure_of_merit(observed, spark.createDataFrame([(q,) for q in calc], "qc double"), ["g"]).collect()}
    for g, qs in lines.items():
        first = sorted(qs)[:20]
        miss = np.mean([min(abs(q - c) for c in calc) for q in first])
        n = sum(c <= first[-1] for c in calc)
        assert got[g][1] == n and got[g][0] == pytest.approx(first[-1] / (2 * max(miss, 1e-4 * first[-1]) * n), abs=1e-4)
