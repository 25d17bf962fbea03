"""Filters that reach the stack reader, layouts of arrays, and the committing sink."""

import os

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from stillframe.operators.frames import FilteredStackReader, StackSource, filters_go_down, layout, stack_layouts
from stillframe.sinks.stream import ChunkSink, StreamChunkWriter, read_committed

ROWS, COLUMNS = 4, 6


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    for i in range(2):
        (tmp_path / f"a{i}.raw").write_bytes(rng.uniform(0, 100, (5, ROWS, COLUMNS)).astype("<f4").tobytes())
    np.save(tmp_path / "b.npy", rng.uniform(0, 100, (3, 2, 2, COLUMNS)))
    np.save(tmp_path / "c.npy", rng.integers(0, 100, (ROWS, COLUMNS)).astype(np.uint16))
    return str(tmp_path)


def reader(folder, *filters, **options):
    r = FilteredStackReader({"path": folder, "rows": ROWS, "columns": COLUMNS} | options)
    return r, list(r.pushFilters(list(filters)))


def events(r):
    return [(p.path.rsplit("/", 1)[-1], e) for p in r.partitions() for e in range(p.first, p.stop)]


def test_filters_choose_what_is_read(folder):
    r, left = reader(folder, D.EqualTo(("event",), 2))
    assert left == [] and events(r) == [("a0.raw", 2), ("a1.raw", 2), ("b.npy", 2)]
    r, left = reader(folder, D.In(("event",), (0, 4)), D.EqualTo(("file",), "a1.raw"), D.GreaterThan(("adu",), 50.0))
    assert left == [] and events(r) == [("a1.raw", 0), ("a1.raw", 4)] and r.level == 50.0
    r, left = reader(folder, D.GreaterThan(("event",), 1), D.LessThanOrEqual(("event",), 3), D.EqualTo(("ss",), 1))
    assert [f.attribute for f in left] == [("ss",)] and events(r) == [("a0.raw", 2), ("a0.raw", 3), ("a1.raw", 2), ("a1.raw", 3), ("b.npy", 2)]
    r, left = reader(folder, D.GreaterThanOrEqual(("adu",), 60.0), peaks="70")
    assert len(left) == 1  # less than what the option keeps: nothing new, Spark may test it
    r, _ = reader(folder, D.In(("event",), (1, 2)), D.EqualTo(("event",), 3))
    assert r.partitions() == []


@pytest.mark.parametrize("what", ["event = 1", "event in (0, 3) and file = 'a1.raw'", "adu >= 50 and event > 2", "adu > 90", "event = 77", "ss = 2 and event < 2"])
def test_pushed_equals_tested(spark, folder, what):
    spark.dataSource.register(StackSource)
    read = lambda down: spark.read.format("image_stack").option("path", folder).option("rows", ROWS).option("columns", COLUMNS).option("filters", down).load().where(what)
    want = sorted(map(tuple, read("false").collect()))
    filters_go_down(spark)
    assert sorted(map(tuple, read("true").collect())) == want


def test_layouts(spark, tmp_path, folder):
    assert [layout(s, 4, 6) for s in ((4, 6), (9, 4, 6), (9, 2, 2, 6), (9, 6, 4), (24,), (2, 2, 2, 4, 6))] == [1, 9, 9, None, None, None]
    np.save(tmp_path / "d.npy", np.zeros((3, 5, COLUMNS)))
    (tmp_path / "e.raw").write_bytes(b"123")
    found = {r.file: (r.events, r.wrong is None) for r in stack_layouts(spark, folder, ROWS, COLUMNS).collect()}
    assert found == {"a0.raw": (5, True), "a1.raw": (5, True), "b.npy": (3, True), "c.npy": (1, True), "d.npy": (0, False), "e.raw": (0, False)}
    with pytest.raises(ValueError):
        reader(folder)[0].partitions()
    assert len(events(reader(folder, bad="skip")[0])) == 14


def blocks(rows):
    return iter([{"serial": s, "value": v} for s, v in rows])


def test_a_batch_is_committed_once(spark, tmp_path):
    w = StreamChunkWriter({"path": f"file://{tmp_path}/out"})
    lost = w.write(blocks([(0, "a\nb"), (1, "c")]))  # a task whose answer never came
    first = [w.write(blocks([(5, "e")])), w.write(blocks([(0, "a\nb"), (1, "c")])), w.write(blocks([])), None]
    w.commit(first, 0)
    again = [w.write(blocks([(0, "a\nb"), (1, "c"), (5, "e")]))]
    w.commit(again, 0)  # the batch again after a restart
    w.abort([w.write(blocks([(7, "x")]))], 1)
    w.commit([w.write(blocks([(6, "f")]))], 1)
    got = read_committed(spark, f"file://{tmp_path}/out").orderBy("batch", "part", "serial").collect()
    assert [(r.batch, r.part, r.serial, r.value) for r in got] == [("b000000000", 0, 0, "a\nb"), ("b000000000", 0, 1, "c"), ("b000000000", 1, 5, "e"), ("b000000001", 0, 6, "f")]
    assert lost.name in os.listdir(tmp_path / "out" / "parts")


def test_a_killed_micro_batch_leaves_no_double(spark, tmp_path):
    """The stream's last commit is taken away, so Spark runs the batch again from its checkpoint."""
    spark.dataSource.register(ChunkSink)
    rows = spark.range(40).select(F.col("id").alias("serial"), F.concat(F.lit("chunk "), "id").alias("value"))

    def run():
        s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        s.writeStream.format("ordered_chunks").option("path", f"file://{tmp_path}/out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    rows.where("id < 20").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    commits = tmp_path / "cp" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        (commits / f).unlink(missing_ok=True)
    rows.where("id >= 20").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = read_committed(spark, f"file://{tmp_path}/out").collect()
    assert sorted(r.serial for r in got) == list(range(40)) and all(r.value == f"chunk {r.serial}" for r in got)


def test_batch_writes_come_behind_each_other(spark, tmp_path):
    spark.dataSource.register(ChunkSink)
    for i in range(2):
        df = spark.range(3).select((F.col("id") + 10 * i).alias("serial"), F.lit("x").alias("value"))
        df.write.format("ordered_chunks").mode("append").option("path", f"file://{tmp_path}/out").save()
    got = read_committed(spark, f"file://{tmp_path}/out").select("batch", "serial").collect()
    assert sorted((r.batch, r.serial) for r in got) == [("w000000000", i) for i in range(3)] + [("w000000001", i + 10) for i in range(3)]
