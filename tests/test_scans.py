"""Schedules and decaying sums as relations, against plain loops; the batched search against one frame's."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillframe.kernels import batched, pairs
from stillframe.kernels import indexing as X
from stillframe.kernels import reduction as R
from stillframe.operators.runs import decayed, schedule
from stillframe.sources import synthetic

CELL = np.diag([79.0, 79.0, 38.0])
SMALL = X.Search(known_directions=1200, anchors=12, azimuths=120)


def rows(df):
    return sorted((r.position, r.species, r["cursor"]) for r in df.collect())


def test_schedule_skip(spark):
    sizes = {"a": 40, "b": 300, "c": 0}
    got = rows(schedule(spark, sizes, [{"length": 30, "weights": {"a": 1, "c": 5}}, {"length": 500, "weights": {"a": 1, "b": 1}, "hold": 4}], seed=3))
    assert [p for p, *_ in got] == list(range(340))  # both sources used up, nothing more
    for name in "ab":
        assert [c for _, s, c in got if s == name] == list(range(sizes[name]))
    assert {s for p, s, _ in got if p < 30} == {"a"}
    again = rows(schedule(spark, sizes, [{"length": 30, "weights": {"a": 1, "c": 5}}, {"length": 500, "weights": {"a": 1, "b": 1}, "hold": 4}], seed=3))
    assert again == got


def test_schedule_wrap_hold_and_stop(spark):
    got = rows(schedule(spark, {"a": 7, "b": 11}, [{"length": 400, "weights": {"a": 1, "b": 3}, "hold": 4}], seed=1, exhausted="wrap"))
    assert len(got) == 400 and all(len({s for _, s, _ in got[i : i + 4]}) == 1 for i in range(0, 400, 4))
    for name, size in (("a", 7), ("b", 11)):
        own = [c for _, s, c in got if s == name]
        assert own == [i % size for i in range(len(own))]
    share = Counter(s for _, s, _ in got)["b"] / 400
    assert 0.6 < share < 0.9
    cut = rows(schedule(spark, {"a": 20, "b": 9}, [{"length": 400, "weights": {"a": 1, "b": 1}}], seed=1, exhausted="stop"))
    assert max(Counter(s for _, s, _ in cut).items(), key=lambda x: x[1] / {"a": 20, "b": 9}[x[0]])[1] in (20, 9)
    with pytest.raises(ValueError):
        schedule(spark, {"a": 1}, [{"length": 1, "weights": {"x": 1}}])
    with pytest.raises(ValueError):
        schedule(spark, {"a": 1}, [], exhausted="never")
    assert schedule(spark, {"a": 0}, [{"length": 5, "weights": {"a": 1}}]).count() == 0


@pytest.mark.parametrize("keep", [0.9, 0.5, 0.995])
def test_decayed(spark, keep):
    rng = np.random.default_rng(1)
    data = [(int(g), int(i * 3 + 1), float(x)) for g in range(3) for i, x in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame(data, "g long, i long, x double")
    got = {(r.g, r.i): r.x_so_far for r in decayed(df.repartition(5), ["g"], "i", ["x"], keep).collect()}
    assert len(got) == len(data)
    for g in range(3):
        s = 0.0
        for _, i, x in (d for d in data if d[0] == g):
            s = keep * s + x
            assert abs(got[g, i] - s) < 1e-8


def plain_known(q, cell, c):
    """The search of one frame as loops over anchors, all in double precision."""
    order = np.argsort(np.linalg.norm(cell, axis=0), kind="stable")
    a, b, d = (cell[:, k] for k in order)
    la, lb = np.linalg.norm(a), np.linalg.norm(b)
    u = X.half_sphere(c.known_directions)
    top = u[np.argsort(-np.cos(2 * np.pi * la * (u @ q.T)).sum(axis=1), kind="stable")[: 4 * c.anchors]]
    for _ in range(20):
        g = -np.sin(2 * np.pi * la * (top @ q.T)) @ q
        g -= (g * top).sum(axis=1, keepdims=True) * top
        top = top + 0.004 * g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        top /= np.linalg.norm(top, axis=1, keepdims=True)
    f, kept = np.cos(2 * np.pi * la * (top @ q.T)).sum(axis=1), []
    for i in np.argsort(-f, kind="stable"):
        if len(kept) < c.anchors and all(abs(top[i] @ k) < 0.9995 for k in kept):
            kept.append(top[i])
    found = []
    for k in kept:
        side = np.cross(k, [1.0, 0, 0] if abs(k[0]) < 0.9 else [0, 1.0, 0])
        side /= np.linalg.norm(side)
        for phi in np.linspace(0, 2 * np.pi, c.azimuths, endpoint=False):
            v = np.cos(phi) * side + np.sin(phi) * np.cross(k, side)
            m = np.empty((3, 3))
            for slot, x in zip(order, (la * k, lb * v, np.linalg.norm(d) * np.cross(k, v))):
                m[:, slot] = x
            found.append((-np.cos(2 * np.pi * lb * (v @ q.T)).sum(), m))
    ms = np.array([m for _, m in sorted(found, key=lambda x: x[0])[:300]])
    ms = X.anneal(ms, q, 0.30, 0.82, 20, 0.05)
    return max(X.matched(m, q) for m in ms)


def test_batches_equal_single_frames():
    """Frames of unequal length in one padded call, alone, and by a plain search."""
    # shot 9 has an orientation that no search of this depth finds
    frames = [X.clean(synthetic.shot(i, CELL, n_peaks=40 + 17 * (i % 5), dmin=8.0)[0]) for i in (*range(9), 10)]
    frames += [np.zeros((0, 3)), frames[0][:4]]
    got = batched.known_many(frames, CELL, SMALL)
    assert got[10] is None and got[11] is None
    for q, m in zip(frames[:10], got):
        alone = batched.known_many([q], CELL, SMALL)[0]
        assert abs(X.matched(alone, q) - X.matched(m, q)) <= 1 and X.passes(m, q)
        assert X.matched(m, q) >= plain_known(q, CELL, SMALL) - 1
    assert batched.known_many([], CELL, SMALL) == []


def test_batches_are_cut_by_room(spark):
    """Room for a few frames a call: the same answers; a broken frame has no answer and takes no other with it."""
    from stillframe.operators.planted import known_batches, known_depths

    shots = synthetic.shots(spark, 9, CELL, parts=2)
    bad = shots.where("frame_id = 3").withColumns({c: F.lit(float("nan")) for c in ("qx", "qy", "qz")})
    peaks = shots.where("frame_id <> 3").unionByName(bad)
    wide = {r.frame_id: (r.n_peaks, r.n_matched, r.error) for r in known_batches(peaks, CELL, SMALL).collect()}
    tight = {r.frame_id: (r.n_peaks, r.n_matched, r.error) for r in known_batches(peaks, CELL, SMALL, room=100).collect()}
    assert wide.keys() == tight.keys() == set(range(9)) and wide[3] == (0, 0, None)
    assert all(abs(wide[k][1] - tight[k][1]) <= 1 for k in wide)
    depths = known_depths(peaks, CELL, (SMALL, SMALL)).collect()
    assert Counter(r.frame_id for r in depths) == {k: 2 for k in range(9)}
    with pytest.raises(ValueError):
        known_batches(peaks, CELL, SMALL, room=0)


def test_pair_table():
    table = pairs.pair_table(CELL)
    assert table.bytes < pairs.MOST_BYTES and (np.diff(table.keys) >= 0).all()
    with pytest.raises(ValueError):
        pairs.pair_table(CELL * 6)
    for i in range(6):
        q, _, _, m = synthetic.shot(i, CELL, n_peaks=90, dmin=10.0)
        got, tier = pairs.cascade(q, table, lambda x: None)
        assert tier in (1, 2) and R.same(np.array(R.fingerprint(m)), np.array(R.fingerprint(got))[None])[0]
    assert pairs.cascade(np.zeros((3, 3)), table, lambda x: None) == (None, 0)
