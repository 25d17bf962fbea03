"""Findings of round 3, third round on them: the searches' work a frame."""

import numpy as np

from stillframe.kernels import indexing as X
from stillframe.kernels import reduction as R

CELL = np.diag([79.0, 79.0, 38.0])


def frame(n: int = 300, blur: float = 0.0008, noise: float = 0.4, seed: int = 1) -> np.ndarray:
    """Peaks of the cell turned about the beam, some of them anywhere."""
    rng = np.random.default_rng(seed)
    h = np.c_[rng.integers(-6, 7, n), rng.integers(-5, 6, n), rng.integers(-4, 5, n)]
    c, s = np.cos(0.7), np.sin(0.7)
    q = h @ np.linalg.inv(CELL) @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])
    return X.clean(q + np.where(rng.random(n) < noise, 0.02, blur)[:, None] * rng.uniform(-1, 1, (n, 3)))


def test_climb_is_the_one_by_sines():
    """The sums in powers of the distance stand for the sine and cosine they replace."""
    q, c = frame(), X.Search(directions=20, lengths=(38.0, 79.0), steps=2)
    starts = (X.half_sphere(c.directions)[:, None, :] * np.array(c.lengths)[None, :, None]).reshape(-1, 3)
    for weight in (None, np.linalg.norm(q, axis=1) ** -0.5):
        v, drift, w = starts.copy(), np.zeros_like(starts), np.ones(len(q)) if weight is None else weight
        qmax = np.linalg.norm(q, axis=1).max()
        for s in range(c.steps):
            d = v @ q.T - np.rint(v @ q.T)
            g = -(np.sin(2 * np.pi * d) * (np.abs(d) < c.band) * w) @ q
            drift = 0.5 * drift + g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
            v = v + 0.25 / qmax * (1 - 0.7 * s / c.steps) * drift
        d = v @ q.T - np.rint(v @ q.T)
        f = (np.cos(np.pi * d) ** 2 * (np.abs(d) < c.band) * w).sum(axis=1)
        got, high = X.ascend(starts, q, c, weight)
        near = np.abs(got - v).max(axis=1) < 0.01  # a peak at the band's edge may fall to either side
        assert near.mean() > 0.9 and np.abs(high - f)[near].max() < 1.5 * w.max()


def test_candidates_of_a_blind_search_are_reduced_together(monkeypatch):
    """No call a candidate (there were up to 200 of each)."""
    calls = {"reduce": 0, "primitive": 0}
    reduce_, primitive = R.reduce_basis, X.primitive

    def counted(name, fn):
        def run(*args):
            calls[name] += 1
            return fn(*args)
        return run

    monkeypatch.setattr(R, "reduce_basis", counted("reduce", reduce_))
    monkeypatch.setattr(X, "primitive", counted("primitive", primitive))
    got = X.blind(frame(), X.Search())
    want = np.array(R.fingerprint(CELL))
    assert any(R.same(want, np.array(R.fingerprint(m))[None])[0] for m, _ in got)
    assert calls["reduce"] <= 10 and calls["primitive"] <= 100


def test_many_bases_reduce_as_each_does():
    rng = np.random.default_rng(2)
    ms = np.concatenate([rng.normal(size=(50, 3, 3)) * 40, CELL[None] @ np.array([[2.0, 1, 0], [0, 1, 0], [0, 1, 1]])[None], np.zeros((1, 3, 3)), np.full((1, 3, 3), np.nan)])
    got = R.reduce_many(ms)
    for m, r in zip(ms, got):
        want = R.reduce_basis(m)
        assert np.isnan(r).all() if want is None else np.allclose(r, want)
    q, wide = frame(), CELL @ np.diag([1, 1, 2.0])
    c, s = np.cos(0.7), np.sin(0.7)
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    assert X._uneven(np.array([turn @ CELL, turn @ wide]), q).tolist() == [True, False]


def test_voxels_of_the_best_vectors_are_those_of_all():
    rng = np.random.default_rng(3)
    c = X.Search()
    v = np.round(rng.normal(size=(20_000, 3)) * 30)
    v[:15_000] = v[0]  # many of one voxel, and the best
    f = rng.integers(0, 50, len(v)).astype(float)
    f[:15_000] = 99
    w = np.where(v[:, :1] < 0, -v, v)
    ok = np.linalg.norm(w, axis=1) >= c.shortest
    w, g = w[ok], f[ok]
    w = w[np.lexsort((w[:, 2], w[:, 1], w[:, 0], -g))]
    _, first = np.unique(np.rint(w / c.voxel).astype(int), axis=0, return_index=True)
    assert np.array_equal(X.distinct(v, f, c), w[np.sort(first)[: c.keep]][: c.candidates])
    assert len(X.distinct(v[:0], f[:0], c)) == 0


def lines_of(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_lengths_are_not_tested_on_the_scan(spark):
    """The filter's copy of every coordinate's expression took most of the time."""
    from stillframe.plans import catalog

    for name in ("win10_voxel_dedup", "top11_distinct_maxima"):
        text = lines_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        assert not any("Filter" in t and "SQRT" in t for t in text)


def test_short_vectors_do_not_compete(spark):
    """A short vector with the highest value, one without a length, and a voxel of short ones alone."""
    from stillframe.operators.ranking import one_per_voxel

    rows = [(1, 2.4, 0.0, 0.0, 5), (1, 1.2, 0.0, 0.0, 9), (1, -2.2, 0.0, 0.0, 5), (1, 0.1, 0.0, 0.0, 7), (1, float("nan"), 5.0, 0.0, 8), (1, None, 0.0, 9.0, 8), (2, 1.2, 0.0, 0.0, 1)]
    got = one_per_voxel(spark.createDataFrame(rows, "frame_id long, x double, y double, z double, f int"), "f", 2.0, 2.0).collect()
    assert sorted((r.frame_id, r.x, r.f) for r in got if r.x == r.x) == [(1, 2.2, 5)]
    assert sum(r.x != r.x for r in got) == 1  # nan is larger than any length


def test_a_block_is_split_once(spark, tmp_path):
    """Above the explode the whole block was split again for each of its rows."""
    from stillframe.sources.text import read_frames

    (tmp_path / "a.txt").write_text("FRAME 7 3\n0.1 0.2  0.3\n x y z\n 1 2  3 \nFRAME 8 0\n\nFRAME ? 1\n1 1 1\n")
    df = read_frames(spark, str(tmp_path / "a.txt"))
    text = lines_of(df)
    at = next(i for i, t in enumerate(text) if "Generate" in t)
    assert not any("split(" in t for t in text[: at])
    assert sorted((r.frame_id or -1, r.peak_id, r.qx, r.qz) for r in df.collect()) == [(-1, 0, 1.0, 1.0), (7, 0, 0.1, 0.3), (7, 2, 1.0, 3.0)]


def test_written_blocks_are_computed_once(spark):
    """A known-cell search, or a frame's text, ran once for the ranges and once for the files."""
    from stillframe.operators.files import kept

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(40).selectExpr("id as serial", "concat('line ', id) as value").mapInPandas(count, "serial long, value string")
    assert [r.value for r in spark.read.text(kept(spark, rows)).orderBy("value").limit(2).collect()] == ["line 0", "line 1"]
    assert seen.value == 40


def test_one_of_two_opposite_vectors():
    """A reduction sorted both, with the same choice; that was a tenth of the driver's time."""
    assert R.COMBINATIONS.shape == (3, 171)
    n = np.array(list(np.ndindex(7, 7, 7))).T - 3
    n = n[:, (n != 0).any(axis=0)]
    m = np.diag([50.0, 50.0, 50.0]) @ np.array([[1.0, 2, 0], [0, 1, 0], [1, 0, 1]])
    v = (m @ n)[:, np.argsort(np.linalg.norm(m @ n, axis=0), kind="stable")]
    assert np.array_equal(R.reduce_basis(m)[:, 0], v[:, 0])


def test_known_cell_of_even_and_odd_azimuths():
    """Half a circle stands for both halves, for a cell whose axes are at right angles or not; the rest is
    scanned whole."""
    from stillframe.kernels import batched as B

    skew = CELL @ np.array([[1.0, 0.2, 0], [0, 1, 0], [0, 0, 1]])
    for cell in (CELL, skew):
        rng = np.random.default_rng(5)
        h = np.c_[rng.integers(-6, 7, 200), rng.integers(-5, 6, 200), rng.integers(-4, 5, 200)]
        q = X.clean(h @ np.linalg.inv(cell) + 0.0005 * rng.uniform(-1, 1, (200, 3)))
        for azimuths in (120, 121):
            m = B.known_many([q, q[:90]], cell, X.Search(known_directions=1200, anchors=12, azimuths=azimuths))
            assert X.matched(m[0], q) == len(q) and X.matched(m[1], q[:90]) == 90


def test_a_fit_that_would_come_again_is_left(monkeypatch):
    """Of 24 finalists all were refitted 20 times while one of a block still moved."""
    from stillframe.kernels import batched as B

    q, fits = frame(blur=0.0, noise=0.0), []
    c, s = np.cos(0.7), np.sin(0.7)
    m = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ CELL
    ms = np.array([m, m * 1.001, *(m @ (np.eye(3) + np.random.default_rng(i).normal(scale=0.05, size=(3, 3))) for i in range(22))])
    inverse = X.inverse
    monkeypatch.setattr(B, "inverse", lambda a: (fits.append(a.size // 9), inverse(a))[1])
    got = B.anneal_many(ms[None], q[None], np.ones((1, len(q)), dtype=bool), 0.30, 0.82, 20, 0.05)[0]
    assert np.allclose(got, X.anneal(ms, q, 0.30, 0.82, 20, 0.05)) and sum(fits) < 0.9 * 20 * len(ms)


def test_pairs_of_bins_at_once(monkeypatch):
    """one pass over the 27 bins around a pair, not one each."""
    from stillframe.kernels import pairs as PR

    t, calls = PR.pair_table(CELL), []
    search = np.searchsorted
    monkeypatch.setattr(PR.np, "searchsorted", lambda *a, **k: (calls.append(1), search(*a, **k))[1])
    r = PR.orientations(frame(), t, 10)
    assert len(r) and np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and len(calls) == 2
