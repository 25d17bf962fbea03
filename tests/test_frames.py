"""Kernels, sources, sinks and the streaming driver on synthetic truth."""

import numpy as np
import pytest

from stillframe.kernels import indexing as X
from stillframe.kernels import peaks as P
from stillframe.kernels import reduction as R
from stillframe.sources import synthetic

CELL = np.diag([79.0, 79.0, 38.0])
SMALL = X.Search(directions=300, lengths=tuple(range(30, 124, 6)), known_directions=1200, anchors=12, azimuths=120)


def test_fingerprint_is_invariant():
    rng = np.random.default_rng(1)
    m = synthetic.rotation(rng) @ np.array([[50.0, 5, 3], [0, 60, 7], [0, 0, 70]])
    want = R.fingerprint(m)
    for u in ([[1, 1, 0], [0, 1, 0], [0, 0, 1]], [[1, 0, 1], [0, 1, 1], [0, 0, 1]], [[0, 1, 0], [1, 0, 0], [0, 0, -1]]):
        assert np.allclose(R.fingerprint(synthetic.rotation(rng) @ m @ np.array(u)), want)
    assert R.fingerprint(np.zeros((3, 3))) is None


def test_many_fingerprints_equal_single_ones():
    rng = np.random.default_rng(6)
    ms = rng.normal(scale=40, size=(300, 3, 3))
    ms[3], ms[5, 0, 0], ms[7] = 0, np.nan, np.diag([1.0, 1.0, 0.0])
    many = R.fingerprints(ms)
    for m, f in zip(ms, many):
        one = R.fingerprint(m) if np.isfinite(m).all() else None
        assert np.isnan(f).all() if one is None else np.allclose(f, one)


def test_hermite_forms():
    assert [len(R.hermite_forms(i)) for i in (2, 3, 4)] == [7, 13, 35]


def test_group_closure():
    from stillframe.functions.symmetry import CLASSES, operators

    assert [len(operators(n)) for n in CLASSES] == [2, 4, 8, 8, 16, 6, 12, 12, 24, 24, 48]


#: A cell of each setting's system: a, b, c and angles.
METRICS = {
    "-1": (31, 47, 59, 77, 83, 101), "2/m": (31, 47, 59, 90, 101, 90), "2/m_uaa": (31, 47, 59, 101, 90, 90), "2/m_uac": (31, 47, 59, 90, 90, 101),
    "mmm": (31, 47, 59, 90, 90, 90), "4/m": (31, 31, 59, 90, 90, 90), "4/mmm": (31, 31, 59, 90, 90, 90),
    **{n: (31, 31, 59, 90, 90, 120) for n in ("-3", "-3m", "-31m", "6/m", "6/mmm")}, "-3_R": (31, 31, 31, 77, 77, 77), "-3m_R": (31, 31, 31, 77, 77, 77),
    "m-3": (31, 31, 31, 90, 90, 90), "m-3m": (31, 31, 31, 90, 90, 90),
}


def test_every_operator_keeps_its_reciprocal_metric():
    """Equivalent reflections have the same length of q; else different ones would merge."""
    from stillframe.functions.symmetry import GENERATORS, operators

    assert set(METRICS) == set(GENERATORS)
    for name, (a, b, c, *angles) in METRICS.items():
        x, y, z = np.cos(np.radians(angles))
        g = np.linalg.inv(np.array([[a * a, a * b * z, a * c * y], [a * b * z, b * b, b * c * x], [a * c * y, b * c * x, c * c]]))
        for m in operators(name):
            m = np.reshape(m, (3, 3))
            assert np.allclose(m.T @ g @ m, g, atol=1e-12), (name, m)


def test_class_names():
    from stillframe.functions import symmetry as S

    assert S.holohedry("hexagonal", "H") == S.holohedry("hexagonal", "R") == S.class_name("-3m1") == "-3m" and S.holohedry("hexagonal") == "6/mmm"
    assert [S.holohedry("Monoclinic", "P", x) for x in ("*", "a", "b", "c")] == ["2/m", "2/m_uaa", "2/m", "2/m_uac"] and S.holohedry(None) is None
    assert S.is_subgroup("-3", "6/m") and S.is_subgroup("-3m", "6/mmm") and not S.is_subgroup("6/m", "-3m") and not S.is_subgroup("-3", "m-3") and S.is_subgroup("-3_R", "m-3")
    for bad in (lambda: S.class_name("5/m"), lambda: S.holohedry("cubical"), lambda: S.holohedry("monoclinic", "P", "d")):
        with pytest.raises(ValueError):
            bad()


def test_grouping_ignores_order_and_is_not_transitive():
    rng = np.random.default_rng(4)
    f = np.array([R.fingerprint(np.diag([50.0, 60.0, 70.0 + 0.4 * i])) for i in range(12)] + [R.fingerprint(np.diag([30.0, 40.0, 90.0]))] * 3)
    w = np.ones(len(f))
    first = R.group_fingerprints(f, w)
    for _ in range(5):
        p = rng.permutation(len(f))
        win, run, members = R.group_fingerprints(f[p], w[p])
        assert (win, run) == first[:2] and set(p[members]) == set(first[2])
    a, b, c = (np.array(R.fingerprint(np.diag([50.0, 60.0, x]))) for x in (70.0, 73.0, 76.0))
    assert R.same(a, b[None])[0] and R.same(b, c[None])[0] and not R.same(a, c[None])[0]
    assert R.same(b, a[None])[0]


def test_blind_finds_planted_cells():
    want = np.array(R.fingerprint(CELL))
    hits = 0
    for frame in range(6):
        q, *_ = synthetic.shot(frame, CELL)
        got = X.blind(q)
        hits += any(R.same(want, np.array(R.fingerprint(m))[None])[0] for m, _ in got)
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
    assert hits >= 4
    assert X.blind(np.zeros((0, 3))) == [] and X.blind(np.full((20, 3), np.nan)) == []


def test_known_cell_and_null():
    for frame in range(6):
        q, *_ = synthetic.shot(frame, CELL)
        m = X.known(q, CELL, SMALL)
        assert m is not None and X.passes(m, q)
        truth = synthetic.shot(frame, CELL)[3]
        assert X.matched(m, q) >= 0.95 * X.matched(truth, q)
    q = synthetic.shot(0, CELL)[0]
    s = X.scramble(q, np.random.default_rng(0))
    assert np.allclose((q * q).sum(axis=1), (s * s).sum(axis=1)) and np.allclose(q[:, 2], s[:, 2])
    assert X.known(q[:3], CELL, SMALL) is None


def test_escalation_beats_its_null():
    q = synthetic.shot(3, CELL)[0]
    m, tried = X.escalate(q, CELL, 3, copies=8, c=SMALL)
    assert m is not None and tried == 8
    fake = X.scramble(q, np.random.default_rng(5))
    assert X.escalate(fake, CELL, 3, copies=8, c=SMALL)[0] is None


def test_peak_finder():
    rng = np.random.default_rng(0)
    image = rng.poisson(10, (96, 96)).astype(float)
    at = [(20, 30), (50, 70), (80, 12)]
    for y, x in at:
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                image[y + dy, x + dx] += 200 / (1 + dy * dy + dx * dx)
    got = P.find(image)
    assert {(round(p[1]), round(p[0])) for p in got} == set(at)
    ring = P.components(np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]], dtype=bool))
    assert len(set(ring.ravel())) == 4
    assert P.find(np.zeros((8, 8))) == []


GEOM = """; a comment
photon_energy = 9378.7
clen = 0.10
res = 10000
p0/min_fs = 0
p0/max_fs = 99
p0/min_ss = 0
p0/max_ss = 49
p0/corner_x = -50.5
p0/corner_y = -25.0 ; behind
p0/fs = +1.0x +0.01y
p0/ss = -0.01x + y
bad_left/min_fs = 0
p1/min_fs = 100
p1/max_fs = 199
p1/min_ss = 0
p1/max_ss = 49
p1/corner_x = 10
p1/corner_y = 10
p1/res = 5000
p1/coffset = 0.002
p1/fs = -y
p1/ss = x
"""


def test_geometry_reader(spark, tmp_path):
    from stillframe.sources.text import read_geometry

    f = tmp_path / "a.geom"
    f.write_text(GEOM)
    p = {r.panel: r for r in read_geometry(spark, str(f)).collect()}
    assert set(p) == {"p0", "p1"}
    assert (p["p0"].res, p["p0"].clen, p["p0"].coffset) == (10000.0, 0.10, 0.0) and p["p1"].res == 5000.0 and p["p1"].coffset == 0.002
    assert (p["p0"].fsx, p["p0"].fsy, p["p0"].ssx, p["p0"].ssy) == (1.0, 0.01, -0.01, 1.0)
    assert (p["p1"].fsx, p["p1"].fsy, p["p1"].ssx, p["p1"].ssy) == (0.0, -1.0, 1.0, 0.0)
    assert (p["p0"].ord, p["p1"].ord) == (0, 1)


def test_stream_round_trip(spark, tmp_path):
    from stillframe.sinks import text as sinks
    from stillframe.sources import text as sources

    m = [50.0, 0.0, 0.0, 0.0, 60.0, 0.0, 0.0, 0.0, 70.0]
    results = spark.createDataFrame([(0, "a.h5", 3, m), (1, "a.h5", 4, None), (2, "b.h5", 5, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 3.0, 6.0, 9.0])], "serial long, image string, event long, m array<double>")
    refl = spark.createDataFrame([(0, 1, 2, 3, 10.0, 1.0, 5.0, 2.0, 7.5, 8.5, "p0"), (0, -1, 0, 3, 1.0, 1.0, 5.0, 2.0, 7.5, 8.5, "p0")], "serial long, h int, k int, l int, i double, sigma double, peak double, bg double, fs double, ss double, panel string")
    out = str(tmp_path / "s")
    sinks.write_ordered(sinks.stream_chunks(results, refl), out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text.startswith(sinks.HEADER) and text.count("Begin chunk") == 3 and text.count("Begin crystal") == 1
    assert "Cell parameters 5.00000 6.00000 7.00000 nm, 90.00000 90.00000 90.00000 deg" in text
    assert text.index("  -1    0    3") < text.index("   1    2    3")
    back = sources.read_chunks(spark, out)
    assert {(r.image, sources_event(r.event)) for r in back.collect()} == {("a.h5", 3), ("a.h5", 4), ("b.h5", 5)}
    lines = sinks.orientations(results).collect()
    assert len(lines) == 1 and lines[0].value.startswith("a.h5 //3 +0.2000000")


def sources_event(e):
    return int(e)


def test_frame_blocks_and_bases(spark, tmp_path):
    from stillframe.sinks import text as sinks
    from stillframe.sources import text as sources

    peaks = spark.createDataFrame([(7, 0, 0.1, 0.2, 0.3), (7, 1, -0.1, 0.0, 0.25), (9, 0, 0.5, 0.5, 0.5)], "frame_id long, peak_id int, qx double, qy double, qz double")
    sinks.write_ordered(sinks.frame_blocks(peaks), str(tmp_path / "q"), header=None)
    got = {(r.frame_id, r.peak_id, r.qx, r.qy, r.qz) for r in sources.read_frames(spark, str(tmp_path / "q")).collect()}
    assert got == {tuple(r) for r in peaks.collect()}
    (tmp_path / "b.txt").write_text("3 1 2 3 4 5 6 7 8 9 0.5 12\n4 NONE 3\n")
    b = {r.frame_id: r.m for r in sources.read_bases(spark, str(tmp_path / "b.txt")).collect()}
    assert b == {3: [1.0, 4.0, 7.0, 2.0, 5.0, 8.0, 3.0, 6.0, 9.0], 4: None}


def test_peak_reader(spark, tmp_path):
    from stillframe.sources.text import event_number, read_peaks

    (tmp_path / "p.stream").write_text(
        "CrystFEL stream format 2.3\n----- Begin chunk -----\nImage filename: x.h5\nEvent: a//7\nPeaks from peak search\n  fs/px   ss/px (1/d)/nm^-1   Intensity  Panel\n 10.5 20.5 1.1 300.0 p0\n 11.0 bad 1 2 p0\nEnd of peak list\n----- End chunk -----\n"
        "----- Begin chunk -----\nImage filename: y.h5\nPeaks from peak search\nEnd of peak list\n----- End chunk -----\n"
    )
    rows = read_peaks(spark, str(tmp_path / "p.stream"))
    got = rows.select("image", event_number(rows["event"]).alias("n"), "fs", "ss", "intensity").collect()
    assert [tuple(r) for r in got] == [("x.h5", 7, 10.5, 20.5, 300.0)]


def fake_driver(**options):
    """A driver whose searches look a frame's lattice up: q's first row names it."""
    from stillframe.streaming.driver import Config, Driver

    bases = {1.0: np.diag([79.0, 79.0, 38.0]), 2.0: np.diag([50.0, 60.0, 70.0])}

    def blind(q):
        return [(bases[round(float(q[0, 0]) * 10)], 1.0)] if round(float(q[0, 0]) * 10) in bases else []

    def known(q, m):
        return m

    d = Driver(Config(batch=4, **options), blind, known)
    d._fits = lambda m, q: 20 if round(float(q[0, 0]) * 10) in bases and np.allclose(bases[round(float(q[0, 0]) * 10)], m) else 0
    return d


def frame(kind, n=12):
    q = np.random.default_rng(3).uniform(0.02, 0.03, (n, 3))
    q[0, 0] = kind / 10
    return q


def test_driver_locks_rescues_and_finds_a_second_cell():
    from stillframe.streaming.driver import TERMINAL

    d = fake_driver()
    events = []
    kinds = [1, 0, 5, 1, 1, 1, 2, 2, 1, 2, 2, 1, 1]
    for ev, k in enumerate(kinds):
        events += d.push(ev, frame(k, 3 if k == 0 else 12))
    events += d.close(len(kinds) - 1)
    terminal = [e for e in events if e[2] in TERMINAL]
    assert sorted(e[0] for e in terminal) == list(range(len(kinds)))
    outcome = {e[0]: e[2] for e in terminal}
    assert outcome[1] == "blank" and outcome[4] == "warmup_lock" and outcome[0] == "warmup_vote"
    late = {(e[0], e[2]) for e in events if e[2] not in TERMINAL}
    assert {(0, "rescued_warmup"), (3, "rescued_warmup")} <= late
    assert {(6, "rescued_relock"), (7, "rescued_relock")} <= late
    assert len(d.cells) == 2 and all(e[1] >= e[0] for e in events)
    assert list(d.close(99)) == []


def test_driver_state_survives_serialisation():
    import json

    from stillframe.streaming.driver import Driver

    a, b = fake_driver(), fake_driver()
    ea, eb = [], []
    for ev, k in enumerate([1, 1, 5, 1, 1, 2, 2, 2, 2, 1]):
        ea += a.push(ev, frame(k))
        eb += b.push(ev, frame(k))
        fresh = Driver(b.c, b.blind, b.known, json.loads(json.dumps(b.state())))
        fresh._fits = b._fits
        b = fresh
    assert ea == eb


def test_running_merge_equals_batch(spark, tmp_path):
    from stillframe.streaming.driver import running_merge

    rows = spark.range(2000).selectExpr("cast(id % 2 as int) cell", "id % 37 key", "cast(id % 2 as int) half", "cast(id % 5 as int) bucket", "1.0D + id % 3 w", "cast(id as double) v")
    rows.repartition(3).write.parquet(str(tmp_path / "m"))
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    q = running_merge(s).writeStream.outputMode("complete").format("memory").queryName("merged").trigger(availableNow=True).start()
    q.awaitTermination()
    assert set(map(tuple, spark.table("merged").collect())) == set(map(tuple, running_merge(rows).collect()))


def test_vote_refuses_and_ignores_order(spark):
    from stillframe.operators.consensus import vote

    good = [(i, (CELL + 0).ravel().tolist()) for i in range(5)] + [(i, np.diag([40.0 + 3 * i, 90.0, 100.0]).ravel().tolist()) for i in range(5)]
    df = spark.createDataFrame(good, "frame_id long, m array<double>")
    r = vote(df).first()
    assert r.accepted and r.support == 5 and r.pool == 10
    again = vote(df.orderBy(df.frame_id.desc())).first()
    assert (again.support, again.runner_up, again.m) == (r.support, r.runner_up, r.m)
    few = spark.createDataFrame(good[:2], "frame_id long, m array<double>")
    assert not vote(few).first().accepted
    assert vote(df.limit(0)).first() is None


def test_gate_withdraws(spark):
    from stillframe.operators.perframe import gate

    p = synthetic.shots(spark, 2, CELL)
    m = synthetic.shot(0, CELL)[3].ravel().tolist()
    wrong = np.diag([211.0, 307.0, 401.0]).ravel().tolist()
    r = spark.createDataFrame([(0, m), (1, wrong)], "frame_id long, m array<double>")
    got = {x.frame_id: (x.m is None, x.withdrawn) for x in gate(r, p).collect()}
    assert got == {0: (False, False), 1: (True, True)}


def test_partiality_and_negative_intensities(spark):
    from stillframe.operators.merge import frame_scale, merge_sums
    from pyspark.sql import functions as F

    rows = [(1, 1, 2, 3, 100.0 + i, 5.0) for i in range(10)] + [(2, 1, 2, 3, -1.0 if i % 2 else 1.0, 5.0) for i in range(10)] + [(3, 2, 0, 0, 90.0, 1.0)] * 3
    m = spark.createDataFrame(rows, "frame long, h int, k int, l int, i double, sigma double")
    s = {r.frame: r.scale for r in frame_scale(m).collect()}
    assert s[1] is not None and s[2] is None and s[3] is None
    assert merge_sums(m, "mmm", F.lit(0)).agg(F.sum("n")).first()[0] == 10


def test_fourier_search_and_refinement():
    from stillframe.kernels import fourier, refine

    want = np.array(R.fingerprint(CELL))
    for frame_id in range(3):
        q = synthetic.shot(frame_id, CELL, n_peaks=90)[0]
        m = fourier.search(q)
        assert m is not None and R.same(want, np.array(R.fingerprint(m))[None])[0]
    assert fourier.search(np.zeros((3, 3))) is None
    q, m = synthetic.shot(1, CELL)[0], synthetic.shot(1, CELL)[3]
    start = m @ (np.eye(3) + np.random.default_rng(1).normal(scale=2e-3, size=(3, 3)))
    got = refine.refine(start, q, "tetragonal")
    assert refine.deviation("tetragonal", got)[0] < 1e-9 and X.matched(got, q, 0.05) > X.matched(start, q, 0.05)
    assert abs(np.linalg.norm(got[:, 0]) - 79) < 0.1 and abs(np.linalg.norm(got[:, 2]) - 38) < 0.1


def test_powder():
    from stillframe.kernels import powder

    lengths = (4.6, 4.6, 2.96)
    g = powder.indices(6)
    lines = np.unique(np.round(powder.SYSTEMS["tetragonal"](*g.T) @ np.array(lengths)[[0, 2]] ** -2.0, 9))[:20]
    best = powder.index_lines(lines)[0]
    assert best[1] == "tetragonal" and np.allclose(best[2], lengths, rtol=1e-4) and best[0] > 100
    x = np.arange(200.0)
    y = 0.1 * x + 50 * np.exp(-((x - 60) ** 2) / 20) + 30 * np.exp(-((x - 140) ** 2) / 20)
    assert np.allclose(powder.profile_peaks(x, y), [60, 140], atol=1)
