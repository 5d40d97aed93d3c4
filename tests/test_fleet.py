"""Queries against their SQL on the smallest tables, and golden values."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfleet.functions import semantics as sem
from lumenfleet.operators import catalog, measure, transform
from lumenfleet.plans import fleet, points
from lumenfleet.sources import frames as src
from lumenfleet.sources import raw
from lumenfleet.streaming import qc

SF = "/root/testdata/sf0.001"
#: Each family once; the driver runs all of them.
SOME = ["a07_noise_pair", "a03_w01_channel_metrics", "a01_region_statistics", "j06_defects", "n11_defect_correction", "a15_binning", "n06_median", "n02_gaussian", "j12_exposure_merge", "j08_format_candidates", "t03_drift", *sorted(k for k, f in fleet.QUERIES.items() if f.__module__ == points.__name__)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = fleet.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({fleet.ORACLES[name]})").fetchall()
    key = lambda r: [str(round(float(v), 6)) if isinstance(v, (int, float)) else str(v) for v in r]
    assert sorted(key(r) for r in got.select(names).collect()) == sorted(key(r) for r in want)


def test_tiling_maps_every_pixel(spark, duck):
    test_query_equals_sql(spark, duck, "f10_channel_tiling_whole")
    tiles = fleet.QUERIES["f10_channel_tiling_whole"](spark, SF)
    heights = {r["frame_id"]: r["height"] // 2 * 2 for r in src.frames(spark, SF).collect()}
    assert tiles.count() == tiles.select("frame_id", "tx", "ty").distinct().count() == 64 * sum(heights.values())


def test_profiles_of_every_row(spark, duck):
    test_query_equals_sql(spark, duck, "a24_profile_statistics_rows")
    assert fleet.QUERIES["a24_profile_statistics_rows"](spark, SF).count() == src.rows(spark, SF).count()


def test_default_cap_leaves_all_defects_and_caps_truncate(spark, duck):
    test_query_equals_sql(spark, duck, "o03_capped_defects_default")
    assert fleet.QUERIES["o03_capped_defects_default"](spark, SF).count() == fleet.QUERIES["j06_defects"](spark, SF).count()
    some = spark.createDataFrame([(1, 0, 3), (1, 0, 1), (1, 2, 0), (2, 5, 5)], "frame_id long, y int, x int")
    assert sorted(tuple(r[k] for k in ("frame_id", "y", "x", "truncated")) for r in transform.capped(some, 2).collect()) == [(1, 0, 1, True), (1, 0, 3, True), (2, 5, 5, False)]


def test_rank_quantiles_take_the_upper_middle(spark):
    hist = spark.createDataFrame([(1, 100, 1), (1, 200, 1)], "frame_id long, code int, n long")
    r = measure.histogram_metrics(hist, ["frame_id"], 12).first()
    assert (r["median"], r["p1"], r["p99"]) == (200, 100, 200)


def test_profile_median_averages_and_constant_sigma_is_zero(spark):
    v = spark.createDataFrame([(1, 100), (1, 200), (2, 65535), (2, 65535)], "k int, v int")
    r = {x["k"]: x for x in measure.profile_statistics(v, ["k"], "v").collect()}
    assert r[1]["median"] == 150 and r[2]["sigma"] == 0


def test_constant_region_has_no_dynamic_range(spark):
    r = spark.range(1).select(sem.to_db(F.lit(4095), F.lit(0.0)).alias("d")).first()
    assert r["d"] is None


def test_natural_order_and_full_width_digits(spark):
    t = spark.createDataFrame([("img10.raw",), ("img2.raw",), ("IMG１.raw",)], "name string").orderBy(catalog.natural_key(F.col("name")))
    assert [r[0] for r in t.collect()] == ["IMG１.raw", "img2.raw", "img10.raw"]


def test_name_dimensions(spark):
    t = spark.createDataFrame([("a_1920x1080.raw",), ("123456x100",), ("1x2",)], "name string").select(catalog.name_dimensions(F.col("name")).alias("d"))
    assert [r["d"] for r in t.collect()] == [[[1920, 1080]], [], []]


def test_banded_stencil_equals_whole(spark):
    from lumenfleet.operators.transform import stencil_rows

    rows = src.rows(spark, SF).filter("frame_id < 2")
    whole, names = stencil_rows(rows, 1, 2)
    banded, _ = stencil_rows(rows, 1, 2, band=8)
    cols = ["frame_id", "y", *names[0]]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, banded.select(cols).collect()))


def test_drift_stream_runs_and_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = qc.drift(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.format("memory").queryName("drift").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("drift").count() == qc.drift(events).count()


def test_raw_files_are_read_frame_by_frame(spark, tmp_path):
    import struct

    (tmp_path / "a.raw").write_bytes(b"head" + struct.pack(">12H", *[v << 4 for v in range(100, 112)]) + b"rest")
    got = raw.read_raw(spark, str(tmp_path), 3, 2, 12, high_aligned=True, big_endian=True, header=4).orderBy("frame_id", "y").collect()
    assert [(r["frame_id"], r["y"], list(r["codes"])) for r in got] == [(0, 0, [100, 101, 102]), (0, 1, [103, 104, 105]), (1, 0, [106, 107, 108]), (1, 1, [109, 110, 111])]
