"""Files of frames: catalogue, ranges, formats, the sink's attempts and refusals."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfleet.plans import files, fleet  # noqa: F401
from lumenfleet.sources import export, raw_files


@pytest.fixture(scope="module")
def frames(spark):
    """Two lots of frames of 5 x 3 pixels of 10 bits, with every way of packing, and their rows."""
    r = np.random.default_rng(1)
    table = [(i, f"/in/lot{i // 3}.raw", i // 3, 5, 3, 10, ("Lsb", "Msb")[i % 2], ("Little", "Big")[i // 2 % 2], i % 3 * 7, 0xFFFF) for i in range(6)]
    frames = spark.createDataFrame(table, "frame_id long, source string, stack long, width int, height int, bit_depth int, packing string, endianness string, header int, padding int")
    rows = [(i, y, r.integers(0, 1024, 5).tolist()) for i in range(6) for y in range(3)]
    return frames.withColumn("name", export.output_name("source", F.col("frame_id") % 3, F.lit(3))), spark.createDataFrame(rows, "frame_id long, y int, codes array<int>"), rows


def test_export_and_read_back(spark, frames, tmp_path):
    table, rows, want = frames
    folder = str(tmp_path / "out")
    done = {r["name"]: r for r in export.export_frames(rows, table, folder).collect()}
    assert sorted(done) == sorted(f"lot{i}_f{j:03d}.raw" for i in range(2) for j in range(3))
    for name, r in done.items():
        raw = (tmp_path / "out" / name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r["bytes"], r["sha256"])
    raw = (tmp_path / "out" / "lot0_f001.raw").read_bytes()  # the second frame: high-aligned, 7 bytes of header
    assert raw[:7] == b"\xee" * 7 and np.frombuffer(raw[7:], "<u2").tolist() == [v << 6 | 63 for _, _, codes in want[3:6] for v in codes]
    files = raw_files.catalogue(spark, folder, "*.raw", recursive=False)
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    plan = files.join(table.select("name", "frame_id", "width", "height", "bit_depth", "packing", "endianness", "header", F.lit(1).alias("frames")), "name")
    got = raw_files.read_frames(plan, band_bytes=11, task_bytes=40)
    assert got.rdd.getNumPartitions() > 1
    named = {f"lot{i // 3}_f{i % 3:03d}.raw": i for i in range(6)}
    assert sorted((named[r["path"].split("/")[-1]], r["y"], r["codes"]) for r in got.collect()) == sorted(want)
    some = raw_files.read_frames(plan, band_bytes=10, only=F.col("y") == 1).collect()
    assert sorted((named[r["path"].split("/")[-1]], r["codes"]) for r in some) == sorted((i, codes) for i, y, codes in want if y == 1)
    with pytest.raises(export.ExportRefused, match="exists"):
        export.export_frames(rows, table, folder)
    assert raw_files.publish(spark, folder).count() == 6  # again, after all is done


def test_refusals_before_any_byte(spark, frames, tmp_path):
    table, rows, _ = frames
    folder = str(tmp_path / "none")
    refused = lambda t, **k: {(r["name"], r["reason"]) for r in export.refusals(t, folder, **k).collect()}
    assert refused(table) == set()
    one = table.filter("frame_id = 0")
    assert refused(one.withColumn("name", F.lit("../x"))) == {("../x", "name")} and refused(one.withColumn("name", F.lit(None).cast("string"))) == {(None, "name")}
    assert refused(table.filter("frame_id < 2").withColumn("name", F.when(F.col("frame_id") == 0, "A.raw").otherwise("a.RAW"))) == {("A.raw", "name"), ("a.RAW", "name")}
    assert refused(one.withColumn("source", F.lit(f"file:/{folder}/LOT0_F000.raw"))) == {("lot0_f000.raw", "source")}
    mixed = table.withColumn("width", F.when(F.col("frame_id") == 1, 4).otherwise(F.col("width")))
    assert {n for n, why in refused(mixed, one_size=True) if why == "size"} == {f"lot0_f{i:03d}.raw" for i in range(3)}
    assert refused(one, kind="gray8", most_pixels=14) == {("lot0_f000.raw", "pixels")} and refused(one, kind="full16", most_pixels=14) == set()
    with pytest.raises(export.ExportRefused, match="size"):
        export.export_frames(rows, mixed, folder, one_size=True)
    assert not os.path.exists(folder)


def batches(*rows):
    yield pa.RecordBatch.from_pylist(list(rows), schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("data", pa.binary())]))


def test_an_attempt_that_runs_twice_counts_once(spark, tmp_path):
    folder = str(tmp_path / "twice")
    job = raw_files.RawWriter(folder)
    rows = [{"name": "a.raw", "part": 0, "data": b"ab"}, {"name": "a.raw", "part": 1, "data": None}, {"name": "a.raw", "part": 2, "data": b"c"}, {"name": "b.raw", "part": 0, "data": b""}]
    job.write(batches(*rows))  # an executor lost after it wrote all
    second = job.write(batches(*rows))
    assert raw_files.committed(spark, folder).count() == 0 and not os.path.exists(tmp_path / "twice" / "a.raw")
    job.commit([second, None])
    assert raw_files.committed(spark, folder).count() == 2
    for _ in range(2):  # a driver lost after the note: the names are given on the next try
        done = {r["name"]: r["bytes"] for r in raw_files.publish(spark, folder).collect()}
    assert done == {"a.raw": 3, "b.raw": 0} and (tmp_path / "twice" / "a.raw").read_bytes() == b"abc"
    lost = raw_files.RawWriter(folder)
    lost.write(batches({"name": "c.raw", "part": 0, "data": b"x"}))
    lost.abort([None])
    assert not any(p.startswith(lost.job) for p in os.listdir(tmp_path / "twice" / "_attempts"))
    for bad in ([{"name": "../x", "part": 0, "data": b""}], [{"name": "a", "part": 0, "data": b""}, {"name": "b", "part": 0, "data": b""}, {"name": "a", "part": 1, "data": b""}]):
        with pytest.raises(ValueError):
            raw_files.RawWriter(folder).write(batches(*bad))


def test_source_plans_ranges(spark, tmp_path):
    """Three files of 4 frames of 6 x 5 pixels of 8 bits behind 3 bytes: runs, pruned columns, short files, pushed conditions."""
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(b"hdr" + bytes((i * 50 + k) % 251 for k in range(4 * 30)) + b"rest")
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    raw_files.register(spark)
    options = {"width": 6, "height": 5, "bit_depth": 8, "header": 3, "task_bytes": 50}
    df = spark.read.format("raw_frames").options(**options).load(str(tmp_path))
    want = {(f"f{i}.bin", k // 30, k % 30 // 6): [(i * 50 + j) % 251 for j in range(k, k + 6)] for i in range(3) for k in range(0, 120, 6)}
    assert {(r["path"].split("/")[-1], r["frame"], r["y"]): r["codes"] for r in df.collect()} == want and df.rdd.getNumPartitions() == 9
    assert spark.read.schema("frame long, y int").format("raw_frames").options(**options).load(str(tmp_path)).agg(F.count("*"), F.sum("y")).first() == (60, 120)
    reader = raw_files.RawReader(options | {"path": str(tmp_path)}, ["path", "frame", "y", "codes"])
    path = f"file:{tmp_path}/f1.bin"
    left = list(reader.pushFilters([raw_files.EqualTo(("path",), path), raw_files.GreaterThan(("frame",), 1), raw_files.LessThanOrEqual(("frame",), 2), raw_files.In(("y",), (1, 2))]))
    assert left == [raw_files.In(("y",), (1, 2))]
    assert [run for p in reader.partitions() for run in p.runs] == [(path, 10, 5)]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 5
    found = df.filter((F.col("y") == 2) & (F.col("frame") < 2)).collect()
    assert {(r["path"].split("/")[-1], r["frame"], r["y"]): r["codes"] for r in found} == {k: v for k, v in want.items() if k[1] < 2 and k[2] == 2}
    with pytest.raises(Exception, match="declared"):
        spark.read.format("raw_frames").options(**options, frames=5).load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="not a format"):
        spark.read.format("raw_frames").options(**options | {"bit_depth": 9}).load(str(tmp_path)).collect()


def test_a_file_above_two_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    """A sparse file of 3 GB: only the wanted rows are read, wherever they lie."""
    width, height = 1 << 15, 49152
    path = tmp_path / "large.raw"
    with path.open("wb") as f:
        f.truncate(2 * width * height)
        f.seek(2 * width * (height - 1))
        f.write(np.arange(width, dtype="<u2").tobytes())
    files = raw_files.catalogue(spark, str(path)).select("*", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(16).alias("bit_depth"), F.lit("Lsb").alias("packing"), F.lit("Little").alias("endianness"), F.lit(0).alias("header"), F.lit(1).alias("frames"))
    got = raw_files.read_frames(files, only=F.col("y") >= height - 128).filter(F.col("y") == height - 1).collect()
    assert len(got) == 1 and got[0]["codes"][-1] == width - 1
    reader = raw_files.RawReader({"path": str(path), "width": width, "height": height, "bit_depth": 16}, ["y"])
    assert len(reader.partitions()) >= 48 and max(p.bytes for p in reader.partitions()) <= raw_files.TASK_BYTES


def test_small_files_are_put_together(spark, frames, tmp_path):
    """a thousand small files are listed by a few tasks a core and read in few batches; a frame's rows need one shuffle to their file."""
    (tmp_path / "many").mkdir()
    for i in range(1000):
        (tmp_path / "many" / f"f{i:04d}.raw").write_bytes(bytes([i % 256, i // 256]))
    files = raw_files.catalogue(spark, str(tmp_path / "many"))
    assert files.count() == 1000 and files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    plan = files.select("*", F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit(8).alias("bit_depth"), F.lit("Lsb").alias("packing"), F.lit("Little").alias("endianness"), F.lit(0).alias("header"), F.lit(1).alias("frames"))
    read = raw_files.read_frames(plan)
    assert {(r["path"][-8:-4], r["y"]): r["codes"] for r in read.collect()} == {(f"{i:04d}", y): [(i % 256, i // 256)[y]] for i in range(1000) for y in range(2)}
    sizes = read.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()
    assert len(sizes) == 1 and sizes[0]["n"] == 2000
    table, rows, _ = frames
    table = table.unionByName(table.filter("frame_id = 1").withColumns({"frame_id": F.lit(9).cast("long"), "name": F.lit("empty.raw")}))  # a header and no rows
    done = export.export_frames(rows, table, str(tmp_path / "out"))
    assert done.count() == 7 and (tmp_path / "out" / "empty.raw").read_bytes() == b"\xee" * 7


def test_rows_are_encoded_by_format(spark):
    """rows of several formats and lengths in one batch, as if each were encoded alone; a row that lacks a value is refused."""
    formats = [(10, "Msb", "Big", 63), (8, "Lsb", "Little", 0), (12, "Lsb", "Little", 5)]
    lists, own = [[1, 2, 3], [], [4], [5, 1023], [255], [7]], [0, 1, 1, 0, 1, 2]
    whole = pa.array([[9], *lists], pa.list_(pa.int32())).slice(1)
    got = export.encoded_rows(whole, formats, np.array(own)).to_pylist()
    assert got == [raw_files.encoded(np.array(v, np.int32), *formats[k]) for v, k in zip(lists, own, strict=True)]
    for bad in ([None], [[1, None]]):
        with pytest.raises(ValueError, match="lacks"):
            export.encoded_rows(pa.array(bad, pa.list_(pa.int32())), formats, np.array([0]))


def test_digests_of_files_by_their_names(spark, tmp_path, monkeypatch):
    """Files are opened by name in tasks, in bands; what isn't there gives no row, and the export lists no folder."""
    for i in range(5):
        (tmp_path / f"f{i}.raw").write_bytes(bytes([i]) * (i * 1000))
    names = spark.createDataFrame([(f"f{i}.raw",) for i in range(7)], "name string")
    want = {f"f{i}.raw": (i * 1000, hashlib.sha256(bytes([i]) * (i * 1000)).hexdigest()) for i in range(5)}
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert {r["name"]: (r["bytes"], r["sha256"]) for r in raw_files.digests(names, folder, band_bytes=300).collect()} == want
    monkeypatch.setattr(raw_files, "TASK_FILES", 1)
    assert raw_files.digests(names, str(tmp_path)).rdd.getNumPartitions() == 7
    found = fleet.QUERIES["k08_batch_export"](spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString() and found.filter("same").count() == found.count() > 0
