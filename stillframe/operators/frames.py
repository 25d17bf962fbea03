"""Images of many frames: peak finding, backgrounds, integration of predicted spots, readers of stacks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stillframe.kernels import peaks as P
from stillframe.operators.imaging import clipped, radial, spot_pixels
from stillframe.operators.perframe import per_frame, tasks
from stillframe.plans.registry import query, table, view
from stillframe.plans.shared import shared_folder

WIDTH = 64
#: Pixels of one task where images are looked at whole.
ROOM = 1_000_000
#: Rows that a reader of stacks collects before it hands them over, about.
BATCH = 10_000


def images(spark, sf_dir) -> DataFrame:
    """Pixels of a frame a supplier: frame, ss, fs, adu."""
    return view(spark, sf_dir, "frame_images")


def integrate(pixels: DataFrame, spots: DataFrame, by: list[str], half: int = 2, gap: int = 2, ring: int = 3, gain: float = 1.0) -> DataFrame:
    """Background-subtracted sums of each spot (by, h, k, l, css, cfs): i, sigma, peak, bg, n_pix.

    The box has ``half`` pixels to each side, the background is the clipped mean of a square
    annulus ``ring`` wide behind a ``gap``.  A spot whose box has no pixel at all has no row; one
    without background pixels takes none off.
    """
    key = [*by, "h", "k", "l"]
    px = spot_pixels(pixels, spots, half + gap + ring, by)
    inner, outer = F.col("ring") <= half, F.col("ring") > half + gap
    adu = F.when(inner, F.col("adu"))
    own = {"css": F.first("css"), "cfs": F.first("cfs"), "s": F.sum(adu), "n_pix": F.count_if(inner), "peak": F.max(adu)}
    box = clipped(px, key, F.when(outer, F.col("adu")), 5.0, *own.values()).toDF(*key, *own, "bg").where("n_pix > 0")
    own = F.coalesce("bg", F.lit(0.0))
    i = F.col("s") - F.col("n_pix") * own
    e = F.sqrt(F.greatest((F.col("s") + F.col("n_pix") * F.greatest(own, F.lit(0.0))) / gain, F.lit(1.0)))
    return box.select(*key, "css", "cfs", i.alias("i"), e.alias("sigma"), "peak", own.alias("bg"), "n_pix")


def _gather(extra: str = "") -> str:
    return f"(select r.frame, r.h, r.k, r.l, i.adu, greatest(abs(i.ss-r.css), abs(i.fs-r.cfs)) as ring from predictions r join frame_images i on i.frame = r.frame and i.ss between r.css-7 and r.css+7 and i.fs between r.cfs-7 and r.cfs+7 {extra})"


def _integrated(extra: str = "") -> str:
    g = _gather(extra)
    ring = f"(select *, median(adu) over (partition by frame, h, k, l) as med from {g} where ring > 4)"
    bg = f"(select frame, h, k, l, avg(adu) as bg from (select r.*, m.mad from {ring} r join (select frame, h, k, l, median(abs(adu-med)) as mad from {ring} group by all) m using (frame, h, k, l)) where abs(adu-med) <= 5*greatest(1.4826*mad, sqrt(greatest(med,1))) group by frame, h, k, l)"
    return f"(select frame, h, k, l, s - n_pix*coalesce(bg,0) as i, sqrt(greatest(s + n_pix*greatest(coalesce(bg,0),0), 1)) as sigma, peak, n_pix from (select frame, h, k, l, sum(adu) as s, count(*) as n_pix, max(adu) as peak from {g} where ring <= 2 group by frame, h, k, l) left join {bg} using (frame, h, k, l))"


@query("krn33_integrate_frames", f"select frame, count(*) as n, round(sum(i), 3) as i, round(sum(sigma), 4) as sigma, max(peak) as peak from {_integrated()} group by frame", "frame_images predictions")
def krn33(spark, sf_dir):
    """All predicted spots of all frames at once; those off the frame have no row."""
    r = integrate(images(spark, sf_dir), view(spark, sf_dir, "predictions"), ["frame"])
    return r.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("i"), 3).alias("i"), F.round(F.sum("sigma"), 4).alias("sigma"), F.max("peak").alias("peak"))


def panel_of(ss: Column) -> Column:
    """Panels of the stack: 32 rows each."""
    return F.floor(ss / 32).cast("int")


def checked_stack(pixels: DataFrame, panels: int, rows: int, columns: int) -> DataFrame:
    """``pixels`` (frame, panel, ...) of frames whose stack has every pixel of every panel; an error
    names a frame that lacks some."""
    n = pixels.groupBy("frame").agg(F.count("*").alias("_n"), F.count_distinct("panel").alias("_panels"))
    whole = (F.col("_n") == panels * rows * columns) & (F.col("_panels") == panels)
    ok = n.select("frame", F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("frame without all its pixels: "), F.col("frame").cast("string"))).cast("boolean")).alias("_ok"))
    return pixels.join(ok, "frame").where("_ok").drop("_ok")


@query("krn34_integrate_stack", f"select frame, count(*) as n, round(sum(i), 3) as i, cast(sum(n_pix) as bigint) as n_pix from {_integrated('and i.ss // 32 = r.css // 32')} group by frame", "frame_images predictions")
def krn34(spark, sf_dir):
    """The same from a stack of panels: boxes and annuli end at their panel's edge; every panel is
    checked first."""
    px = checked_stack(images(spark, sf_dir).withColumn("panel", panel_of(F.col("ss"))), 2, 32, WIDTH)
    spots = view(spark, sf_dir, "predictions").withColumn("panel", panel_of(F.col("css")))
    r = integrate(px, spots, ["frame", "panel"])
    return r.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("i"), 3).alias("i"), F.sum("n_pix").alias("n_pix"))


def integrate_results(pixels: DataFrame, spots: DataFrame, results: DataFrame) -> DataFrame:
    """Integrated reflections of the indexed frames only (results: frame, indexed), measured ones: a
    finite value that is not exactly zero and an error above zero."""
    own = spots.join(results.where("indexed").select("frame"), "frame", "left_semi")
    r = integrate(pixels, own, ["frame"])
    return r.where(~F.isnan("i") & (F.col("sigma") > 0) & (F.col("i") != 0))


@query("krn35_integrate_results", f"select frame, count(*) as n, round(sum(i), 3) as i, count(*) filter (i < 0) as negative from {_integrated()} where frame % 3 <> 0 and sigma > 0 and i <> 0 group by frame", "frame_images predictions")
def krn35(spark, sf_dir):
    """A batch of results: predicted, integrated and filtered."""
    spots = view(spark, sf_dir, "predictions")
    results = spots.select("frame", (F.col("frame") % 3 != 0).alias("indexed")).distinct()
    r = integrate_results(images(spark, sf_dir), spots, results)
    return r.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("i"), 3).alias("i"), F.count_if(F.col("i") < 0).alias("negative"))


def found_peaks(pixels: DataFrame, by: str) -> DataFrame:
    """Peaks of each image (``by`` names it): fs, ss, mass, snr, n_pix, error.  An image is one task's
    work, of bounded size."""
    def fn(_: int, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["ss"].min()
        image = np.full((rows["ss"].max() - first + 1, rows["fs"].max() + 1), np.nan)
        image[rows["ss"] - first, rows["fs"]] = rows["adu"]
        got = P.find(image)
        return pd.DataFrame([(x, y + first, *rest) for x, y, *rest in got], columns=["fs", "ss", "mass", "snr", "n_pix"])

    return per_frame(pixels.select(by, "ss", "fs", "adu"), fn, "fs double, ss double, mass double, snr double, n_pix int", by, ROOM)


SPOTS = "(select frame, css, cfs from predictions where h < 4 and k < 4)"


@query("krn23_find_peaks", f"select frame, round(ss, 0) as ss, floor(fs) as fs, 2 as n_pix from (select p.frame, p.css as ss, cast(p.cfs as double) as fs from {SPOTS} p)", "predictions")
def krn23(spark, sf_dir):
    """The planted spots of every frame, each of two pixels."""
    p = found_peaks(images(spark, sf_dir), "frame")
    return p.select("frame", F.round("ss", 0).alias("ss"), F.floor("fs").cast("double").alias("fs"), "n_pix")


@query("krn24_find_by_panel", f"select frame, css // 32 as panel, count(*) as n from {SPOTS} group by all", "predictions")
def krn24(spark, sf_dir):
    """Each panel by itself: the same spots, none across an edge."""
    px = images(spark, sf_dir).withColumn("image", F.col("frame") * 2 + panel_of(F.col("ss")))
    p = found_peaks(px, "image")
    return p.groupBy(F.floor(F.col("image") / 2).alias("frame"), (F.col("image") % 2).cast("int").alias("panel")).agg(F.count("*").alias("n"))


def labelled(pixels: DataFrame, least: float, by: str = "frame") -> DataFrame:
    """Pixels above a level with the label of their 8-connected component in each image."""
    def fn(_: int, rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((rows["ss"].max() + 1, rows["fs"].max() + 1), dtype=bool)
        mask[rows["ss"], rows["fs"]] = True
        label = P.components(mask)
        return pd.DataFrame({"ss": rows["ss"], "fs": rows["fs"], "adu": rows["adu"], "label": label[rows["ss"], rows["fs"]]})

    return per_frame(pixels.where(F.col("adu") > least).select(by, "ss", "fs", "adu"), fn, "ss int, fs int, adu double, label int", by)


@query("agg23_peak_stats", "select frame, css, count(*) as n_pix, round(sum(adu), 3) as mass, round(sum(adu*fs)/sum(adu), 7) as cx, max(adu) > 150 as seeded from (select i.frame, p.css, p.cfs, i.fs, i.adu from frame_images i join predictions p on i.frame = p.frame and i.ss = p.css and i.fs between p.cfs and p.cfs + 1 where i.adu > 60) group by frame, css, cfs", "frame_images predictions")
def agg23(spark, sf_dir):
    """Size, mass, centroid and seed of each connected component."""
    l = labelled(images(spark, sf_dir), 60.0)
    m = F.sum("adu")
    g = l.groupBy("frame", "label").agg(F.min("ss").alias("css"), F.count("*").alias("n_pix"), F.round(m, 3).alias("mass"), F.round(F.sum(F.col("adu") * F.col("fs")) / m, 7).alias("cx"), (F.max("adu") > 150).alias("seeded"))
    return g.where("n_pix between 1 and 200").drop("label")


@query("agg22_radial_frames", "select frame, bin, round(sum(w*adu)/sum(w), 5) as mean from (select frame, cast(floor(t) as bigint)+o as bin, adu, case when o = 1 then t-floor(t) else 1-(t-floor(t)) end as w from (select frame, adu, sqrt(cast((ss-32)*(ss-32)+(fs-32)*(fs-32) as double))/4 - cast(0.5 as double) as t from frame_images) p, (select 0 as o union all select 1) o) group by frame, bin having sum(w) > 0.001", "frame_images")
def agg22(spark, sf_dir):
    """Radial profiles of all frames in one aggregation."""
    t = F.sqrt(((F.col("ss") - 32) * (F.col("ss") - 32) + (F.col("fs") - 32) * (F.col("fs") - 32)).cast("double")) / 4 - 0.5
    x = images(spark, sf_dir).select("frame", "adu", t.alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("o"))
    x = x.withColumn("w", F.when(F.col("o") == 1, F.col("t") - F.floor("t")).otherwise(1 - (F.col("t") - F.floor("t"))))
    g = x.groupBy("frame", (F.floor("t") + F.col("o")).alias("bin")).agg(F.sum("w").alias("w"), F.round(F.try_divide(F.sum(F.col("w") * F.col("adu")), F.sum("w")), 5).alias("mean"))
    return g.where("w > 0.001").drop("w")


class _Event(InputPartition):
    def __init__(self, path: str, first: int, stop: int, offset: int = 0, kind: str = "<f4"):
        self.path, self.first, self.stop, self.offset, self.kind = path, first, stop, offset, kind


class _Events(InputPartition):
    def __init__(self, runs: list[_Event]):
        self.runs = runs


class StackSource(DataSource):
    """Image stacks: events behind each other, raw (little-endian 32-bit readings) or as .npy arrays.

    Options: path (files of a folder, by name), rows, columns, and optionally first and stop
    (events of each file to read), peaks (rows above a level only), per_task (events of a task),
    across (``true``: a task takes events of several files, up to ``per_task``, so that small files are no task each) and
    bad (``error``, or ``skip`` for files that don't fit; ``stack_layouts`` lists them).

    The layout of an array follows from its shape: (events, rows, columns); (events, panels, rows of a
    panel, columns), whose panels stand below each other; or one event (rows, columns).

    With the option ``filters`` filters on event, file and a least reading are taken over by the reader: only
    those bytes are read.  It needs ``filters_go_down(spark)``.
    """

    @classmethod
    def name(cls) -> str:
        return "image_stack"

    def schema(self) -> str:
        return "file string, event long, ss int, fs int, adu double"

    def reader(self, schema) -> DataSourceReader:
        # Spark refuses a reader that takes filters where they are not handed down
        return FilteredStackReader(self.options) if self.options.get("filters", "false") == "true" else StackReader(self.options)


def layout(shape: tuple[int, ...], rows: int, columns: int) -> int | None:
    """Events of an array of a shape, or None if it holds no such images."""
    if shape == (rows, columns):
        return 1
    if len(shape) == 3 and shape[1:] == (rows, columns):
        return shape[0]
    if len(shape) == 4 and shape[1] * shape[2] == rows and shape[3] == columns:
        return shape[0]
    return None


class StackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.shape = int(options["rows"]), int(options["columns"])
        self.first, self.stop = int(options.get("first", 0)), options.get("stop")
        self.level, self.or_equal = float(options.get("peaks", "-inf")), False
        self.per_task = int(options.get("per_task", 16))
        self.across = options.get("across", "false") == "true"
        self.skip = options.get("bad", "error") == "skip"
        self.events: set[int] | None = None
        self.least, self.most = 0, None
        self.names: set[str] | None = None

    def _files(self):
        from pyarrow import fs

        uri = self.folder.replace("file:///", "/").replace("file:/", "/") if self.folder.startswith("file:/") else self.folder
        return fs.FileSystem.from_uri(uri)

    def layouts(self) -> list[tuple[str, int, int, str, str | None]]:
        """(path, events, offset of the first, type, what is wrong) of every file."""
        from pyarrow import fs

        system, top = self._files()
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            if info.base_name.endswith(".npy"):
                with system.open_input_file(info.path) as f:
                    version = np.lib.format.read_magic(f)
                    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    shape, by_columns, kind = read(f)
                    offset = f.tell()
                events = layout(shape, *self.shape)
                wrong = f"an array of shape {shape}" if events is None else "columns first" if by_columns and len(shape) > 1 else None
                out.append((info.path, events or 0, offset, kind.str, wrong))
            else:
                events, rest = divmod(info.size, 4 * self.shape[0] * self.shape[1])
                out.append((info.path, events, 0, "<f4", f"{info.size} bytes are no whole number of events" if rest else None))
        return out

    def partitions(self) -> list[_Event] | list[_Events]:
        out = []
        for path, events, offset, kind, wrong in self.layouts():
            name = path.rsplit("/", 1)[-1]
            if self.names is not None and name not in self.names:
                continue
            if wrong and self.skip:
                continue
            if wrong:
                raise ValueError(f"{name}: {wrong}")
            stop = events if self.stop is None else int(self.stop)
            if stop > events:
                raise ValueError(f"{name}: event {stop - 1} of {events}")
            stop = stop if self.most is None else min(stop, self.most)
            start = max(self.first, self.least)
            if self.events is None:
                runs = [(a, min(a + self.per_task, stop)) for a in range(start, stop, self.per_task)]
            else:
                runs = [(e, e + 1) for e in sorted(self.events) if start <= e < stop]
            out += [_Event(path, a, b, offset, kind) for a, b in runs]
        return self.together(out) if self.across else out

    def together(self, runs: list[_Event]) -> list[_Events]:
        out, room = [], 0
        for run in runs:
            if run.stop - run.first > room:
                out.append(_Events([]))
                room = self.per_task
            out[-1].runs.append(run)
            room -= run.stop - run.first
        return out

    def read(self, part: _Event | _Events | None) -> Iterator:
        import pyarrow as pa

        if part is None:  # no event is asked for
            return
        system, _ = self._files()
        h, w = self.shape
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.chunked_array([x[i] for x in held]).combine_chunks() for i in range(5)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "event", "ss", "fs", "adu"])

        for run in part.runs if isinstance(part, _Events) else [part]:
            size, name = np.dtype(run.kind).itemsize * h * w, run.path.rsplit("/", 1)[-1]
            with system.open_input_file(run.path) as f:
                f.seek(run.offset + size * run.first)
                for event in range(run.first, run.stop):
                    x = np.frombuffer(f.read(size), run.kind)
                    at = np.flatnonzero(x >= self.level if self.or_equal else x > self.level)
                    held.append((pa.repeat(name, len(at)), pa.repeat(event, len(at)), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), pa.array(x[at].astype(float))))
                    n += len(at)
                    if n >= BATCH:
                        yield batch()
                        held, n = [], 0
        if n:
            yield batch()


class FilteredStackReader(StackReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Takes what says which events, files or readings; the others stay with Spark."""
        from pyspark.sql import datasource as D

        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            values = set(f.value) if isinstance(f, D.In) else {getattr(f, "value", None)}
            if None in values:
                yield f
            elif column == "event" and isinstance(f, (D.EqualTo, D.In)):
                self.events = values if self.events is None else self.events & values
            elif column == "file" and isinstance(f, (D.EqualTo, D.In)):
                self.names = values if self.names is None else self.names & values
            elif column == "event" and isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, D.GreaterThan))
            elif column == "event" and isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                top = f.value + isinstance(f, D.LessThanOrEqual)
                self.most = top if self.most is None else min(self.most, top)
            elif column == "adu" and isinstance(f, D.GreaterThan) and f.value >= self.level:
                self.level, self.or_equal = float(f.value), False
            elif column == "adu" and isinstance(f, D.GreaterThanOrEqual) and f.value > self.level:
                self.level, self.or_equal = float(f.value), True
            else:
                yield f


def stack_layouts(spark: SparkSession, folder: str, rows: int, columns: int) -> DataFrame:
    """(file, events, wrong): the files of a folder and why those that don't fit are skipped; a row a file."""
    found = StackReader({"path": folder, "rows": rows, "columns": columns}).layouts()
    return spark.createDataFrame([(p.rsplit("/", 1)[-1], n, wrong) for p, n, _, _, wrong in found], "file string, events long, wrong string")


def filters_go_down(spark: SparkSession) -> None:
    """Lets Spark hand filters to readers of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_stacks(pixels: DataFrame, folder: str, rows: int, columns: int, per_file: int = 8, panels: int | None = None) -> int:
    """Writes frames (frame, ss, fs, adu) as stacks of ``per_file`` events a file; the number of files.
    Frames are numbered by their own order within files of consecutive numbers.  Raw, or with
    ``panels`` as .npy arrays (events, panels, rows, columns)."""
    import pyarrow as pa

    from stillframe.plans.shared import put_file

    def run(part: pa.Table) -> pa.Table:
        out = []
        for of in part.sort_by("frame").select(["ss", "fs", "adu"]).to_batches(1):
            ss, fs, adu = (c.flatten().to_numpy(zero_copy_only=False) for c in of.columns)
            image = np.zeros((rows, columns), "<f4")
            image[ss, fs] = adu
            out.append(image.tobytes())
        number = part["_file"][0].as_py()
        if panels is None:
            put_file(folder, f"run-{number:06d}.raw", b"".join(out))
        else:
            held = io.BytesIO()
            np.save(held, np.frombuffer(b"".join(out), "<f4").reshape(-1, panels, rows // panels, columns))
            put_file(folder, f"run-{number:06d}.npy", held.getvalue())
        return pa.table({"file": pa.array([number], pa.int64())})

    # a frame is one row of its pixels, so that rows and not pixels are sorted and handed over
    pixel = F.struct("ss", "fs", F.col("adu").cast("float").alias("adu"))
    frames = pixels.groupBy("frame").agg(F.collect_list(pixel).alias("p"))
    frames = frames.select("frame", F.col("p.ss").alias("ss"), F.col("p.fs").alias("fs"), F.col("p.adu").alias("adu"), F.floor(F.col("frame") / per_file).alias("_file"))
    # files are few rows but much work: as many tasks as there are cores, not as rows ask for
    return frames.repartition(tasks(pixels.sparkSession), "_file").groupBy("_file").applyInArrow(lambda part: run(part), "file long").count()


def whole_images(spark, sf_dir) -> DataFrame:
    """``images`` with all pixels of a frame in one task, where its supplier meets all places, which are
    few: so they are collected without a shuffle."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(tasks(spark), "s_suppkey")
    return view(spark, sf_dir, "frame_images", "BROADCAST(r)", supplier=suppliers)


def stacks(spark: SparkSession, sf_dir: str) -> str:
    """The images of all frames as raw stacks in the shared folder."""
    folder = f"{shared_folder(spark)}/stacks"
    write_stacks(whole_images(spark, sf_dir), folder, WIDTH, WIDTH)
    spark.dataSource.register(StackSource)
    return folder


def read_stacks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All files of a folder, as many in one task as have ``ROOM`` pixels."""
    reader = spark.read.format("image_stack").options(path=folder, rows=WIDTH, columns=WIDTH, per_task=ROOM // WIDTH**2, across="true", **options)
    return reader.load()


@query("src05_read_stacks", "select cast(count(distinct frame // 8) as bigint) as files, count(*) as n, round(sum(adu), 1) as total from frame_images", "frame_images")
def src05(spark, sf_dir):
    """Every event of every file of a folder of stacks, a few events a task."""
    s = read_stacks(spark, stacks(spark, sf_dir))
    return s.agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"), F.round(F.sum("adu"), 1).alias("total"))


@query("src07_read_one_event", "select 0 as event, count(*) as n, round(sum(adu), 1) as total from frame_images where frame % 8 = 0 or frame = (select min(frame) from frame_images)", "frame_images")
def src07(spark, sf_dir):
    """The first event of each file (one event is the feature): only its bytes are read."""
    s = read_stacks(spark, stacks(spark, sf_dir), stop=1)
    return s.agg(F.max("event").cast("int").alias("event"), F.count("*").alias("n"), F.round(F.sum("adu"), 1).alias("total"))


@query("src05_event_arrays", "select file, event, count(*) as n, max(adu) as top from (select 'run-' || lpad(cast(frame // 8 as varchar), 6, '0') || '.npy' as file, dense_rank() over (partition by frame // 8 order by frame) - 1 as event, adu from frame_images) where event in (1, 4) and adu > 60 group by file, event", "frame_images")
def src05_arrays(spark, sf_dir):
    """Arrays (events, panels, rows, columns): the layout from their shape, and two events and a least reading
    that the reader is asked for (both are the feature)."""
    folder = f"{shared_folder(spark)}/arrays"
    write_stacks(whole_images(spark, sf_dir), folder, WIDTH, WIDTH, panels=2)
    spark.dataSource.register(StackSource)
    filters_go_down(spark)
    s = read_stacks(spark, folder, filters="true")
    return s.where("event in (1, 4) and adu > 60").groupBy("file", "event").agg(F.count("*").alias("n"), F.max("adu").alias("top"))


@query("src12_stream_of_events", "select cast(sum(case when adu > 60 then 1 else 0 end) as bigint) as pixels, count(distinct frame) as frames from frame_images", "frame_images")
def src12(spark, sf_dir):
    """A scan that keeps hits only: the level is tested in the reader, before rows are made."""
    s = read_stacks(spark, stacks(spark, sf_dir), peaks=60)
    return s.agg(F.count("*").alias("pixels"), F.count_distinct("file", "event").alias("frames"))


@query("src13_second_pass", f"select frame, count(*) as pixels from frame_images where frame in (select frame from frame_images where adu > 60 group by frame having max(adu) >= 220) group by frame", "frame_images")
def src13(spark, sf_dir):
    """Two passes: hits of all frames first, then all pixels of the wanted frames (a left-semi join)."""
    px = images(spark, sf_dir)
    wanted = px.where("adu > 60").groupBy("frame").agg(F.max("adu").alias("top")).where("top >= 220").select("frame")
    return px.join(wanted, "frame", "left_semi").groupBy("frame").agg(F.count("*").alias("pixels"))


def strongest_or_stored(peaks: DataFrame, top: int, by: str = "frame") -> DataFrame:
    """The ``top`` strongest peaks of each frame, or the first stored ones where all are as strong
    (columns: by, at, intensity)."""
    own = Window.partitionBy(by)
    flat = F.max("intensity").over(own) - F.min("intensity").over(own) <= 1e-9
    p = peaks.withColumn("_key", F.when(flat, 0.0).otherwise(-F.col("intensity")))
    return p.withColumn("_r", F.row_number().over(own.orderBy("_key", "at"))).where(F.col("_r") <= top).drop("_r", "_key")


@query("src05_stored_peaks", "select frame, count(*) as n, round(sum(i), 3) as i, cast(sum(place) as bigint) as places from (select *, row_number() over (partition by frame order by case when flat then 0 else -i end, place) as r from (select *, max(i) over (partition by frame) - min(i) over (partition by frame) <= 1e-9 as flat from (select frame, cast(h*100 + k*10 + l as bigint) as place, case when frame % 4 = 1 then 5 else max(cast(i as double)) end as i from measurements group by frame, h, k, l))) where r <= 50 group by frame", "measurements")
def src05_peaks(spark, sf_dir):
    """Peaks that a file already has: the fifty strongest, by order where all are equal."""
    i = F.max(F.col("i").cast("double"))
    m = view(spark, sf_dir, "measurements").groupBy("frame", "h", "k", "l").agg(i.alias("i"))
    m = m.select("frame", (F.col("h") * 100 + F.col("k") * 10 + F.col("l")).cast("long").alias("at"), F.when(F.col("frame") % 4 == 1, 5.0).otherwise(F.col("i")).alias("intensity"))
    return strongest_or_stored(m, 50).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 3).alias("i"), F.sum("at").alias("places"))
