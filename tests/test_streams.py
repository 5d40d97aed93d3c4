"""Streams over landed files: noise between consecutive frames with late, missing, repeated and idle frames; quality values in parts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfleet.plans import fleet, streams  # noqa: F401
from lumenfleet.sources import frames as src
from lumenfleet.streaming import noise, qc

START = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
LANDED = "sensor long, frame long, ts timestamp, y int, codes array<int>"
KEYS = ["sensor", "frame", "y", "parity", "n", "s", "s2", "ds", "ds2"]


class Landing:
    """A folder that rows land in, and the stream that runs over what is new."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options, self.n = spark, tmp_path, options, 0

    def add(self, *frames):
        """frames: (sensor, frame, second, {y: codes})."""
        rows = [(s, f, START + dt.timedelta(seconds=at), y, codes) for s, f, at, lines in frames for y, codes in lines.items()]
        self.spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        stream = self.spark.readStream.schema(LANDED).parquet(str(self.path / "in"))
        job = noise.consecutive_moments(stream, **self.options).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        job.awaitTermination()
        return {tuple(r[k] for k in KEYS[:4]): tuple(r[k] for k in KEYS[4:]) for r in self.spark.read.parquet(str(self.path / "out")).collect()} if (self.path / "out").exists() else {}


def moments(a, b, parity):
    v, d = np.array(a[parity::2]), np.array(a[parity::2]) - np.array(b[parity::2])
    return len(v), int(v.sum()), int((v * v).sum()), int(d.sum()), int((d * d).sum())


def expected(lines, pairs):
    """lines: {(sensor, frame): {y: codes}}; pairs of (sensor, later frame)."""
    return {(s, f, y, p): moments(lines[s, f - 1][y], lines[s, f][y], p) for s, f in pairs for y in lines[s, f] if y in lines[s, f - 1] for p in (0, 1)}


@pytest.fixture
def lines():
    r = np.random.default_rng(3)
    return {(s, f): {y: r.integers(0, 4096, 7).tolist() for y in range(2)} for s in (1, 2) for f in range(8)}


def test_late_missing_repeated_and_idle_frames(spark, tmp_path, lines):
    land = Landing(spark, tmp_path, late="10 seconds", idle_ms=60_000)
    at = lambda s, f, second, **k: (s, f, second, lines[s, f] | k)
    land.add(at(1, 1, 1), at(1, 0, 0), at(2, 0, 0))  # in any order
    land.add(at(1, 3, 3), at(2, 2, 2))
    land.add(at(1, 2, 2), (1, 3, 3, {0: [0] * 7}))  # 2 comes after 3, within the bound; a row comes twice
    done = land.add(at(1, 4, 30))  # the watermark passes the frames before
    want = expected(lines, [(1, 1), (1, 2), (1, 3)])
    doubled = {k for k in want if k[:3] == (1, 3, 0)}  # which of two rows with one ts counts is open
    assert {k: v for k, v in done.items() if k not in doubled} == {k: v for k, v in want.items() if k not in doubled}
    done = land.add(at(2, 1, 1), at(1, 5, 31))  # sensor 2's frame 1 is too late: it counts as missing, on both sides
    done = land.add((1, 6, 32, {0: [1] * 6, 1: lines[1, 6][1]}), at(1, 7, 50))
    done = land.add((9, 0, 100, {0: [1]}))  # moves the watermark on
    assert not any(k[0] == 2 for k in done)
    lines[1, 6] = {1: lines[1, 6][1]}  # a row of another length makes no pair
    later = {k: v for k, v in done.items() if k[1] >= 4}
    assert later == expected(lines, [(1, 4), (1, 5), (1, 6), (1, 7)])
    done = land.add(at(2, 3, 101), at(2, 4, 200))  # idle for longer than a minute: forgotten, though the number follows
    done = land.add((9, 1, 400, {0: [1]}))
    assert not any(k[0] == 2 for k in done)


def test_stream_equals_batch(spark, tmp_path, lines):
    land = Landing(spark, tmp_path)
    for f in range(8):
        land.add(*[(s, f, f, lines[s, f]) for s in (1, 2) if (s, f) != (2, 5)])
    done = land.add((9, 0, 10_000, {0: []}))
    del lines[2, 5]
    pairs = [(s, f) for s, f in lines if (s, f - 1) in lines]
    assert done == expected(lines, pairs) and (2, 6) not in pairs
    table = spark.read.schema(LANDED).parquet(str(tmp_path / "in"))
    batch = noise.consecutive_moments(table.unionByName(table))  # repeated rows count once
    assert {tuple(r[k] for k in KEYS[:4]): tuple(r[k] for k in KEYS[4:]) for r in batch.collect()} == done
    found = noise.frame_noise(batch, F.lit("Rggb"), 4095).filter("sensor = 1 AND frame = 3").first()
    a, b = (np.array([lines[1, f][y] for y in range(2)]) for f in (2, 3))
    pools = [(a[y, x::2], (a - b)[y, x::2]) for y in range(2) for x in range(2)]
    assert found["sigma_total"] == pytest.approx(np.sqrt(sum(v.size * v.var() for v, _ in pools) / a.size))
    assert found["sigma_temporal"] == pytest.approx(np.sqrt(sum(d.size * d.var() for _, d in pools) / a.size / 2))


def test_appended_quality_in_parts(spark, tmp_path):
    """A frame whose rows land in two batches has one row of values, and a batch that runs again counts once."""
    rows = [(f, [100 * f + y, 4095]) for f in range(3) for y in range(4)]
    schema = "frame_id long, codes array<int>"
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        qc.append_qc(stream, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    got = {r["frame_id"]: r for r in qc.read_qc(spark, str(tmp_path / "table")).collect()}
    assert len(list((tmp_path / "table").glob("batch=*"))) == 2
    want = {r["frame_id"]: r for r in qc.frame_qc(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and got[1]["n"] == 8 and got[1]["saturated"] == 4
    qc.qc_moments(spark.createDataFrame(rows[6:], schema)).write.mode("overwrite").parquet(str(tmp_path / "table" / "batch=1"))
    assert {r["frame_id"]: r for r in qc.read_qc(spark, str(tmp_path / "table")).collect()} == want


def test_values_of_a_sensor_one_after_another(spark, tmp_path):
    """The stateful difference of values over several batches equals the batch form, which needs no group in one task."""
    schema = "user_id long, ts timestamp, event_id long, value double"
    r = np.random.default_rng(4)
    rows = [(int(u), START + dt.timedelta(seconds=i), i, float(v)) for i, (u, v) in enumerate(zip(r.integers(0, 3, 60), r.integers(0, 99, 60), strict=True))]
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at : at + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = qc.consecutive_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(x) for x in qc.consecutive_difference(spark.createDataFrame(rows, schema)).collect()) and len(got) == 57


def test_a_band_of_rows_is_one_entry_of_state(spark, tmp_path):
    """What waits of a sensor's 70 rows stands in two entries, and comes out as the batch has it."""
    r = np.random.default_rng(5)
    rows = [(1, f, START + dt.timedelta(seconds=f), y, r.integers(-9, 1 << 17, 5 + y % 2).tolist()) for f in range(3) for y in range(70)]
    spark.createDataFrame(rows, LANDED).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = noise.consecutive_moments(spark.readStream.schema(LANDED).parquet(str(tmp_path / "in")), late="10 seconds")
    sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    job = sink.trigger(availableNow=True).start()
    job.awaitTermination()
    assert job.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    spark.createDataFrame([(9, 0, START + dt.timedelta(hours=1), 0, [1])], LANDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink.trigger(availableNow=True).start().awaitTermination()
    want = noise.consecutive_moments(spark.createDataFrame(rows, LANDED))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(KEYS).collect())) == sorted(map(tuple, want.select(KEYS).collect()))


def test_few_batches_and_nothing_moved_before_it_is_due(spark, tmp_path, monkeypatch):
    """A batch takes four files a core; rows that all wait are kept as they are, and give what they give when the watermark has passed."""
    rows = noise.Rows.of([1, 2, 2], [5, 6, 6], [0, 0, 1], [[1, 2], [3, 5], [4, 4]])
    none = noise.Rows.joined([])
    found, last, waiting = noise.passed(none, rows, 4, 1000)
    assert found.shape == (0, 8) and not len(last) and waiting is rows
    found, last, waiting = noise.passed(none, rows, 10, 1000)
    assert found[:, :4].tolist() == [[2, 0, 0, 1], [2, 0, 1, 1]] and last.keys.tolist() == [[2, 2], [6, 6], [0, 1]] and not len(waiting)
    monkeypatch.setattr(src, "LOT_ROWS", 100)
    stream, table = streams.landed(spark, "/root/testdata/sf0.001")
    job = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    job.awaitTermination()
    read = [p["numInputRows"] for p in job.recentProgress if p["numInputRows"]]
    assert sum(read) == table.count() and len(read) == 1
