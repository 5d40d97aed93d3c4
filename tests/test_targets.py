"""Readouts of panes, projection targets, float rows and histograms from rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenfleet.functions.semantics import CFA
from lumenfleet.operators import measure
from lumenfleet.operators import regions as reg
from lumenfleet.sources import raw


def test_readouts(spark):
    rows = spark.createDataFrame([(f, y, [f * 10 + y, 5]) for f in range(4) for y in range(2)], "frame_id long, y int, codes array<int>")
    views = [(1, [(0, 0, 12), (1, 1, 12)], 0, 1), (2, [(0, 0, 12), (1, 1, 10)], 0, 1), (3, [(0, 0, 12), (1, 1, 12), (2, 2, 12)], 1, 0), (4, [(0, 3, 12)], -1, 0), (5, [(0, 0, 12), (1, 1, 12)], 0, 7), (6, [(i, i, 12) for i in range(4)], 2, 0)]
    points = spark.createDataFrame([(v, pane, frame, depth, x, y) for v, panes, x, y in views for pane, frame, depth in panes], "view_id long, pane int, frame_id long, bit_depth int, x int, y int")
    got = {r["view_id"]: tuple(r[k] for k in ("code0", "code1", "code2", "code3", "delta")) for r in reg.readouts(points, rows).collect()}
    assert got == {1: (1, 11, None, None, 10), 2: (1, 11, None, None, None), 3: (5, 5, 5, None, None), 4: (None,) * 5, 5: (None,) * 5, 6: (None,) * 5}


def test_projection_targets(spark):
    boxes = [(0, None, None, None, None, False, 0, False), (1, None, None, None, None, True, 0, False), (2, None, None, None, None, False, 16, False), (3, 3, 5, 4, 2, False, 0, True), (4, 3, 5, 4, 2, True, 0, False), (5, 30, 5, 4, 2, True, 0, False), (6, -2, -1, 9, 9, False, 0, False), (7, 3, 5, 0, 2, False, 0, False)]
    rois = reg.resolved(spark.createDataFrame(boxes, "roi_id int, x int, y int, w int, h int, tiled boolean, segment int, mixed boolean").withColumns({"width": F.lit(64), "height": F.lit(48), "frame_id": F.lit(1)}))
    each = rois.withColumn("direction", F.explode(F.array(F.lit("horizontal"), F.lit("vertical"))))
    got = {(r["roi_id"], r["direction"][0]): (r["target"], r["refusal"], r["axis_start"], r["axis_source"]) for r in reg.projection_targets(each).collect()}
    assert got[0, "h"] == got[0, "v"] == ("whole", None, 0, None) and got[1, "h"] == ("refused", "no region in quadrants", None, None)
    assert got[2, "h"] == ("whole", None, 0, None) and got[2, "v"] == ("refused", "exposures side by side", None, None)
    assert got[3, "h"] == ("refused", "exposures in rows", None, None) and got[3, "v"] == ("rectangle", None, 5, None)
    assert got[4, "h"] == ("lattice", None, 3, 6) and got[4, "v"] == ("lattice", None, 5, 10) and got[5, "h"][:2] == ("refused", "quadrants")
    assert got[6, "h"] == ("rectangle", None, 0, None) and got[7, "v"] == ("whole", None, 0, None)


def test_float_rows(spark):
    rows = spark.createDataFrame([(1, 0, [1.5, -0.0, float("inf")]), (1, 1, []), (2, 0, None)], "frame_id long, y int, values array<float>")
    data = raw.encode_floats(rows)
    assert {(r["frame_id"], r["y"]): r["data"] for r in data.collect()} == {(1, 0): np.array([1.5, -0.0, np.inf], "<f4").tobytes(), (1, 1): b"", (2, 0): None}
    assert {(r["frame_id"], r["y"]): r["values"] for r in raw.decode_floats(data).collect()} == {(1, 0): [1.5, -0.0, float("inf")], (1, 1): [], (2, 0): None}


def test_histograms_from_rows(spark):
    r = np.random.default_rng(1)
    frames = {f: r.integers(0, 65536 if f == 3 else 9, (7, 5)) for f in (1, 2, 3)}
    patterns = {1: "Rggb", 2: "Gbrg", 3: "Bggr"}
    rows = spark.createDataFrame([(f, y, v[y].tolist(), patterns[f]) for f, v in frames.items() for y in range(7)] + [(4, 0, None, "Rggb"), (5, 0, [], "Rggb")], "frame_id long, y int, codes array<int>, bayer string").repartition(4)
    want = Counter((f, CFA[patterns[f]][y % 2 * 2 + x % 2], int(v[y, x])) for f, v in frames.items() for y in range(7) for x in range(5))
    got = {(h["frame_id"], h["channel"], h["code"]): h["n"] for h in measure.channel_histogram(rows, F.col("bayer")).collect()}
    assert {k: n for k, n in got.items() if k[1]} == want
    total = Counter()
    for (f, _, code), n in want.items():
        total[f, None, code] += n
    assert {k: n for k, n in got.items() if not k[1]} == total
    assert {(h["frame_id"], None, h["code"]): h["n"] for h in measure.row_histogram(rows).collect()} == total
