"""Steps that took their time beside the work: frames as tables, pixels as rows, a task a file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillframe.kernels import fourier
from stillframe.operators.perframe import per_frame_row
from stillframe.operators.planted import of_frames

SF = "/root/testdata/sf0.001"


def test_frames_are_slices_of_sorted_rows(spark):
    """Frames over several batches are whole, a failing one has its error, a missing number is null."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("frame_id"), F.col("id").cast("double").alias("x"))

    def fn(frame, of):
        if frame == 3:
            raise ValueError("bad frame")
        return {"n": len(of["x"]), "total": float(of["x"].sum()) if frame else float("nan"), "odd": bool(frame % 2)}

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("100", "714", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.frame_id: tuple(r)[1:] for r in per_frame_row(rows, fn, "n long, total double, odd boolean").collect()}
            want = {f: (len(range(f, 5000, 7)), float(sum(range(f, 5000, 7))), bool(f % 2), None) for f in range(7)}
            want[0] = (want[0][0], None, False, None)
            want[3] = (None, None, None, "ValueError: bad frame")
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert per_frame_row(rows.where("false"), fn, "n long, total double, odd boolean").count() == 0


def test_no_list_a_peak(spark):
    """the planted basis went to each frame as a list for each of its peaks."""
    plan = of_frames(spark, SF, lambda q, m, frame: {"n": len(q)}, "n long")._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan
    got = of_frames(spark, SF, lambda q, m, frame: {"n": len(q), "m": m.ravel().tolist()}, "n long, m array<double>")
    from stillframe.operators.acceptance import planted

    want = {r.frame_id: (r.n, r.m) for r in planted(spark, SF).groupBy("frame_id").agg(F.count("*").alias("n"), F.first("m").alias("m")).collect()}
    assert {r.frame_id: (r.n, r.m) for r in got.collect()} == want


@pytest.mark.parametrize("n", [7, 8, 32, 33])
def test_volume_in_kept_memory(n):
    """A volume equals the plain transform of its grid, and the next frame leaves it alone."""
    rng = np.random.default_rng(n)
    q, other = rng.normal(size=(50, 3)), rng.normal(size=(80, 3))
    qmax = 1.0001 * np.sqrt((q * q).sum(axis=1).max())
    t = (q / (2 * qmax) + 0.5) * (n - 1)
    low, grid = np.floor(t).astype(int), np.zeros((n, n, n))
    for c in np.ndindex(2, 2, 2):
        np.add.at(grid, tuple(np.minimum(low + c, n - 1).T), np.where(np.array(c) == 1, t - low, 1 - t + low).prod(axis=1))
    vol, _ = fourier.volume(q, n)
    fourier.volume(other, n)
    assert np.allclose(vol, np.fft.fftshift(np.abs(np.fft.fftn(grid))), atol=1e-9)
    assert fourier.scratch(n)[0] is fourier.scratch(n)[0]


def test_small_files_share_tasks(spark, tmp_path):
    """a file of eight events was a task of its own; now as many share one as it has room for."""
    from stillframe.operators.frames import StackReader, StackSource, write_stacks

    px = spark.range(37 * 24).select((F.col("id") % 37 + 5).alias("frame"), F.floor(F.col("id") / 37 / 6).cast("int").alias("ss"), (F.floor(F.col("id") / 37) % 6).cast("int").alias("fs"), (F.col("id") * 0.5).alias("adu"))
    want = sorted((r.frame, r.ss, r.fs, r.adu) for r in px.where("adu > 100").collect())
    spark.dataSource.register(StackSource)
    for panels in (None, 2):
        folder = f"{tmp_path}/{panels}"
        assert write_stacks(px, folder, 4, 6, panels=panels) == 6
        options = {"path": folder, "rows": 4, "columns": 6, "peaks": 100, "per_task": 20}
        parts = StackReader(options | {"across": "true"}).partitions()
        assert len(StackReader(options).partitions()) == 6 and [sum(r.stop - r.first for r in p.runs) for p in parts] == [19, 18]
        for across in ("true", "false"):
            got = spark.read.format("image_stack").options(**options, across=across).load().collect()
            # the first file has only three frames: 5, 6 and 7
            rows = sorted((int(r.file[4:10]) * 8 + r.event + 5 * (r.file[4:10] == "000000"), r.ss, r.fs, r.adu) for r in got)
            assert rows == want


def test_frames_are_collected_where_they_are_made(spark):
    """no pixel is shuffled on the way to the files."""
    from stillframe.operators.frames import images, whole_images

    a, b = whole_images(spark, SF), images(spark, SF)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    g = a.groupBy("frame").agg(F.collect_list("adu"))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(s_suppkey" in plan
