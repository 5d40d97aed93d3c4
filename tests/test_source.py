"""The source of frames: what groups and joins pixels by frame moves no pixel; numpy's codes are those of SQL."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfleet.operators import colour as tones
from lumenfleet.operators import sampling, transform
from lumenfleet.plans import colour, fleet, targets  # noqa: F401
from lumenfleet.sources import frames as src
from lumenfleet.sources import raw

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["a01_region_statistics", "a15_binning", "a16_binning_rgb", "f10_channel_tiling", "f10_channel_tiling_whole", "a03_channel_histogram", "a03_w01_channel_metrics", "w03_auto_levels", "w04_cumulative_histogram", "a22_display_columns"])
def test_pixels_stay_where_their_frame_is(spark, no_broadcast, name):
    plan = fleet.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "ENSURE_REQUIREMENTS" in line]
    assert "REPARTITION_BY_NUM" in plan and all("roi_id" in line for line in moved)  # sums of regions may move


def test_partitions_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(src, "LOT_ROWS", 100)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    found = src.rows(spark, SF).select(F.spark_partition_id().alias("p"), "frame_id").distinct()
    assert found.count() == found.select("frame_id").distinct().count() and found.select("p").distinct().count() > n // 200


@pytest.mark.parametrize("kind", ["scene", "flat"])
def test_codes_equal_sql(spark, tmp_path, kind):
    keys = [0, 1, 47, 48, 4099, 10**9 + 7, None, 5, 6, 132, -5]
    prices = [1.5, 99999.99, 0.0, None, 12.0, 3.7, 5.0, float(10**7), None, None, 4.0]
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_totalprice": pa.array(prices, pa.float64())}), str(tmp_path / "orders.parquet"))
    got = {(r["frame_id"], r["y"]): list(r["codes"]) for r in src.rows(spark, str(tmp_path), kind).collect()}
    px = src.pixels(spark, str(tmp_path), kind).groupBy("frame_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "code"))).alias("v"))
    assert got == {(r["frame_id"], r["y"]): [p["code"] for p in r["v"]] for r in px.collect()}
    assert any(v is None for v in got[1, 0]) and set(got[None, None]) == {None}


def test_strides_in_batches_and_kept_columns(spark):
    pairs = [(1, 6), (4, 6), (9, 3 * 5 * 7 * 11), (2, 2 * 3 * 5 * 7 * 11 * 13 * 17 * 19 * 23), (None, 6), (5, None), (7, 1)]
    found = spark.createDataFrame(pairs, "s long, p long").select(sampling.coprime_stride(F.col("s"), F.col("p")).alias("v"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["v"] for r in found.collect()] == [1, 5, 13, 29, 1, None, 7]
    rows = spark.createDataFrame([(1, y, list(range(6)), 3, 2) for y in range(4)], "frame_id long, y int, codes array<int>, cs long, rs long")
    assert sorted(map(tuple, sampling.sampled(rows, "cs", "rs", "rs").collect())) == [(1, y, x, x, 2) for y in (0, 2) for x in (0, 3)]


def test_filters_share_a_pass(spark):
    """All filters read their rows once, and each gives what it gives alone."""
    plan = fleet.QUERIES["n08_rgb_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("FlatMapGroupsInArrow") == 1
    rows = src.rows(spark, SF).filter("frame_id < 3")
    filters = {"median": transform.median_of(1, 12, 2), "gaussian": transform.separable_filter(transform.gaussian_weights(2, 1.2), 12, 2), "sobel": transform.sobel_filter(12, 2)}
    both = transform.stencils(rows, filters, 2, ("codes",), band=8)
    alone = {"median": transform.median_filter(rows, 1, 12, 2), "gaussian": transform.separable(rows, transform.gaussian_weights(2, 1.2), 12, 2), "sobel": transform.sobel(rows, 12, 2)}
    for name, df in alone.items():
        assert sorted(map(tuple, both.filter(F.col("filter") == name).drop("filter").collect())) == sorted(map(tuple, df.collect()))


def test_float_rows_meet_without_a_join(spark, no_broadcast):
    plan = fleet.QUERIES["k02_float_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    some = spark.createDataFrame([(1, 0, [1.5, 2.0], "a"), (1, 1, None, "b")], "frame_id long, y int, values array<float>, own string")
    back = raw.decode_floats(raw.encode_floats(some, "values", "own"), "own")
    assert sorted(map(tuple, back.collect())) == [(1, 0, [1.5, 2.0], "a"), (1, 1, None, "b")]


def test_records_of_pixels_from_batches(spark):
    """Rows of several widths, without values and cut into parts; interleaved rows of another length give none; no array is worked on value by value."""
    lines = [(f, y, None if y == 2 else [(f * 7 + y * 3 + x) % 50 for x in range(3 + f % 2)]) for f in range(6) for y in range(4)]
    rows = spark.createDataFrame(lines, "frame_id long, y int, r array<int>").selectExpr("frame_id", "y", "r", "transform(r, v -> v + 100) AS g", "transform(r, v -> v + 200) AS b")
    want = sorted((f, y, x, v, v + 100, v + 200) for f, y, r in lines for x, v in enumerate(r or []))
    assert sorted(map(tuple, transform.wide(rows, "r", "g", "b").collect())) == want
    again = transform.wide(tones.apart(tones.interleaved(rows), 4), "r", "g", "b")
    assert sorted(map(tuple, again.collect())) == [w for w in want if w[0] % 2] and again.columns == ["frame_id", "y", "x", "r", "g", "b"]
    for name in ("s12_interleaved", "n08_rgb_maximum"):
        plan = fleet.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "arrays_zip" not in plan and "Generate posexplode" not in plan


@pytest.mark.parametrize("step", [1, 2])
def test_frames_that_are_filtered_together(spark, monkeypatch, step):
    """Frames of several widths and heights in one call, with rows that have no values and in pieces, give what each gives alone; a fold
    leaves a number for each row, and the query's rows don't come back to Python."""
    r = np.random.default_rng(4)
    lines = [(f, y, None if (f + y) % 7 == 3 else r.integers(0, 4096, 5 + f % 3).tolist()) for f in range(9) for y in range(1 + f * 4)]
    rows = spark.createDataFrame(lines, "frame_id long, y int, codes array<int>").coalesce(2)
    filters = {"mean": transform.separable_filter(transform.box_weights(1), 12, step), "bell": transform.unsharp_filter(transform.gaussian_weights(2, 1.2), 1.5, 12, step), "low": transform.extreme_filter(1, 12, step, False), "median": transform.median_of(1, 12, step), "sobel": transform.sobel_filter(12, step)}
    alone = sorted((x["filter"], x["frame_id"], x["y"], x["codes"]) for x in transform.stencils(rows, filters, step, ("codes",), band=8).collect())
    monkeypatch.setattr(transform, "PIECE", 30)
    assert alone == sorted((x["filter"], x["frame_id"], x["y"], x["codes"]) for x in transform.stencils(rows, filters, step, ("codes",), band=8, together=4).collect())
    folded = transform.stencils(rows, filters, step, ("codes",), band=8, together=4, fold=lambda v: v.sum(1)).collect()
    assert sorted((x["filter"], x["frame_id"], x["y"], x["codes"]) for x in folded) == [(n, f, y, sum(v)) for n, f, y, v in alone]
    near = [(y, v) for f, y, v in lines if f == 8 and y % step == 0 and v]
    want = {near[i][0]: [sorted(t[min(max(x + d * step, x % step), (6 - x % step) // step * step + x % step)] for t in (near[max(0, i - 1)][1], near[i][1], near[min(len(near) - 1, i + 1)][1]) for d in (-1, 0, 1))[4] for x in range(7)] for i in range(len(near))}
    assert {y: v for n, f, y, v in alone if n == "median" and f == 8 and y in want} == {y: [min(65535, int(v * (65535 / (4095 << 4) * 16) + 0.5)) for v in codes] for y, codes in want.items()}
    assert fleet.QUERIES["n08_rgb_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
