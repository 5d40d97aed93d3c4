"""Filters and reductions by bands against whole frames, places within large groups, and the source's spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfleet.operators import ranking, transform
from lumenfleet.sources import frames as src


def rows_of(spark, frames):
    return spark.createDataFrame([(f, y, v[y].tolist()) for f, v in frames.items() for y in range(len(v))], "frame_id long, y int, codes array<int>").repartition(3)


@pytest.fixture(scope="module")
def frames():
    r = np.random.default_rng(7)
    return {1: r.integers(0, 4096, (37, 12)), 2: r.integers(0, 4096, (5, 9)), 3: r.integers(0, 4096, (1, 4))}


def around(v, radius, step):
    """Same-phase windows, edges repeated: (window row, window pixel, y, x)."""
    h, w = v.shape
    side = lambda n, k: [i % step + int(np.clip(i // step + k, 0, (n - 1 - i % step) // step)) * step for i in range(n)]
    return np.array([[v[np.ix_(side(h, a), side(w, b))] for b in range(-radius, radius + 1)] for a in range(-radius, radius + 1)])


@pytest.mark.parametrize(("radius", "step", "band"), [(1, 1, 4), (2, 2, 4), (1, 2, 256), (4, 1, 8)])
def test_filters_in_bands(spark, frames, radius, step, band):
    got = transform.stencil(rows_of(spark, frames), radius, step, lambda v: np.maximum.reduce([transform.side(np.maximum.reduce(v), k, step) for k in range(-radius, radius + 1)]), ("codes",), band=band)
    for f, v in frames.items():
        rows = {r["y"]: r["codes"] for r in got.filter(F.col("frame_id") == f).collect()}
        assert [rows[y] for y in range(len(v))] == around(v, radius, step).max((0, 1)).tolist()
    median = {(r["frame_id"], r["y"]): r["codes"] for r in transform.median_filter(rows_of(spark, frames), 1, 12, step).collect()}
    want = np.sort(around(frames[1], 1, step).reshape(9, 37, 12), 0)[4]
    assert [median[1, y] for y in range(37)] == transform.to_full_scale(want, transform.full_scale_factor(12) * 16).tolist()


def test_a_band_is_the_key_of_a_task(spark):
    tall = spark.range(20_000).selectExpr("1L AS frame_id", "CAST(id AS INT) AS y", "array(CAST(id % 7 AS INT), 1) AS codes")
    found = transform.extreme(tall, 1, 12, 1, True)
    assert "band" in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1].split(")")[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so little data together
    try:
        tasks = found.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found.count() == 20_000 and tasks > 1


def test_rows_without_values_and_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, None), (1, 2, []), (1, 3, [7, 0])], "frame_id long, y int, codes array<int>")
    got = {r["y"]: r["codes"] for r in transform.stencil(rows, 1, 1, lambda v: v.max(0), ("codes",)).collect()}
    assert got == {0: [7, 2], 1: [], 2: [], 3: [7, 2]}
    bad = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [1])], "frame_id long, y int, codes array<int>")
    with pytest.raises(Exception, match="several lengths"):
        transform.stencil(bad, 1, 1, lambda v: v.max(0), ("codes",)).collect()


def test_pyramids(spark, frames):
    rows = rows_of(spark, frames)
    for band in (8, 256):
        got = {(r["frame_id"], r["level"], r["y"]): r["codes"] for r in transform.pyramid(rows, 3, band).collect()}
        for f, v in frames.items():
            for k in (1, 2, 3):
                h, w = (-(-n // 2**k) for n in v.shape)
                want = [[int(v[y << k : y + 1 << k, x << k : x + 1 << k].sum()) // v[y << k : y + 1 << k, x << k : x + 1 << k].size for x in range(w)] for y in range(h)]
                assert [got[f, 1 << k, y] for y in range(h)] == want
    taller = rows.withColumn("height", F.when(F.col("frame_id") == 1, 37).when(F.col("frame_id") == 2, 5).otherwise(1))
    for band in (8, 256):
        got = {(r["frame_id"], r["level"], r["y"]): r["codes"] for r in transform.bayer_pyramid(taller, "height", 2, band).collect()}
        want = {}
        for f, v in frames.items():
            for k in (1, 2):
                h, w = (n // 4 for n in v.shape)
                v = np.array([[v[4 * (y // 2) + y % 2 : 4 * (y // 2) + y % 2 + 3 : 2, 4 * (x // 2) + x % 2 : 4 * (x // 2) + x % 2 + 3 : 2].sum() // 4 for x in range(2 * w)] for y in range(2 * h)]).reshape(2 * h, 2 * w)
                want |= {(f, 1 << k, y): v[y].tolist() for y in range(len(v)) if v.size}
        assert got == want
    with pytest.raises(ValueError):
        transform.pyramid(rows, 4, 8)


def test_places_in_large_groups(spark):
    """One key holds most rows: its places run through many partitions."""
    df = spark.range(0, 3000).selectExpr("IF(id % 10 = 0, id % 3, NULL) AS k", "'x' AS l", "(id * 7919) % 3001 AS v")
    got = ranking.placed(df, ["k", "l"], ["v"], size="n")
    assert got.columns == ["k", "l", "v", "index", "n"]
    rows = sorted((-1 if r["k"] is None else r["k"], r["v"], r["index"], r["n"]) for r in got.collect())
    for k in (-1, 0, 1, 2):
        own = [r for r in rows if r[0] == k]
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
    near = ranking.beside(got, ["k", "l"], "v", previous=-1, next=1).filter("k = 1").orderBy("v").collect()
    vs = [r["v"] for r in near]
    assert [r["previous"] for r in near] == [None, *vs[:-1]] and [r["next"] for r in near] == [*vs[1:], None]
    assert ranking.placed(df.limit(0), ["k"], ["v"]).count() == 0


def test_the_source_shuffles_small_scans_only(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "t"))
    many = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = many if many.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else many.repartition(9)
    assert plan(src.spread(wide, "id")) == plan(wide)
    narrow = many.coalesce(1)
    assert "rangepartitioning" in plan(src.spread(narrow, "id"))
