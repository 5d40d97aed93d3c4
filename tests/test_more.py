"""Lineage, strides, meaning, marked defects and their correction against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfleet.operators import meaning, provenance, sampling, transform

LINEAGE = "frame_id long, parents array<long>"


def resolved(spark, rows):
    return {(r["frame_id"], r["source"]): (r["steps"], r["known"]) for r in provenance.sources_of(spark.createDataFrame(rows, LINEAGE)).collect()}


def test_lineage_of_deep_chains_and_merges(spark):
    r = random.Random(5)
    rows = [(0, None), (1, [])] + [(i, [i - 1]) for i in range(2, 52)] + [(i, sorted({r.randrange(0, i), r.randrange(0, i)})) for i in range(52, 90)] + [(90, [7, 7, -5]), (90, [7, 7, -5])]
    parents = {f: set(p or []) for f, p in rows}

    def brute(frame):
        out = {}
        for p in parents[frame]:
            for s, n in (brute(p) if parents.get(p) else {p: 0}).items():
                out[s] = max(out.get(s, 0), n + 1)
        return out

    want = {(f, s): (n, s in parents) for f, p in parents.items() if p for s, n in brute(f).items()}
    assert want[51, 1] == (50, True) and want[90, -5] == (1, False)
    assert resolved(spark, rows) == want and resolved(spark, []) == {} and resolved(spark, [(1, None)]) == {}


def test_lineage_with_circles(spark):
    got = resolved(spark, [(1, [2]), (2, [3, 9]), (3, [1]), (4, [4]), (5, [1]), (9, None)])
    assert set(got) == {(f, s) for f in (1, 2, 3, 5) for s in (9, None)} | {(4, None)}
    assert got[2, 9][1] and all(v == (None, False) for (_, s), v in got.items() if s is None)


def test_derivation(spark):
    df = spark.createDataFrame([(1, [2, 3], 16.0), (2, [4], None)], "i int, p array<long>, ratio double")
    got = {r["frame_id"]: r for r in df.select(*provenance.derivation("i", "p", F.lit("merge"), {"ratio": F.col("ratio"), "kind": F.lit("x")})).collect()}
    assert got[1]["params"] == {"ratio": "16.0", "kind": "x"} and got[2]["params"] == {"kind": "x"} and got[1]["parents"] == [2, 3]
    assert df.select(*provenance.derivation("i", "p", F.lit("copy"))).first()["params"] == {}


def test_strides(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 60), r.choice([1, 2, 3, 4, 6, 12, 30, 2310, 223092870])) for _ in range(60)]
    got = spark.createDataFrame(pairs, "s long, p long").select(sampling.coprime_stride(F.col("s"), F.col("p")), sampling.gcd(F.col("s"), F.col("p"))).collect()
    for (s, p), row in zip(pairs, got, strict=True):
        low = max(1, s)
        want = low if low == 1 or p <= 1 else next(v for v in range(low, low + 100) if math.gcd(v, p) == 1)
        assert tuple(row) == (want, math.gcd(s, p))
    cases = [(4000, 3000, 10**5, "None", 1, 2, 0), (4000, 40, 10**3, "None", 1, 2, 0), (40, 4000, 10**3, "LineInterleaved", 1, 3, 5), (4000, 3000, 10**5, "Auto", 1, 2, 0), (4000, 3000, 10**5, "Auto", 5, 3, 0), (4000, 3000, 10**5, "FrameSequential", 2, 2, 7), (10, 10, 1000, "None", 1, 2, 0), (0, 10, 5, "None", 1, 2, 0), (4000, 3000, 10**5, "LineInterleaved", 1, 3, 2**30)]
    df = spark.createDataFrame(cases, "w int, h int, most long, hdr string, frames int, stages int, block int")
    out = [tuple(x) for x in df.select(*sampling.sampling_strides("w", "h", F.col("most"), "hdr", "frames", "stages", "block")).collect()]
    assert out == [(11, 11), (169, 1), (1, 169), (11, 11), (11, 11), (11, 11), (1, 1), (1, 1), (11, 11)]
    assert sampling.sampled(spark.createDataFrame([(1, y, list(range(10)), 3, 2) for y in range(5)], "frame_id long, y int, codes array<int>, column_stride long, row_stride long")).count() == 12


def folded(state, steps):
    for op, factor, bayer in steps:
        s = dict(state)
        calc = op in meaning.CALCULATIONS
        state["bayer"] = bayer or s["bayer"]
        if op in meaning.BINNINGS:
            step = 1 if state["bayer"] == "None" else 2
            state["width"], state["height"] = (s[k] // (factor * step) * step for k in ("width", "height"))
        way = s["hdr"] if s["hdr"] != "Auto" else "FrameSequential" if s["frames"] == s["stages"] else "LineInterleaved" if s["frames"] == 1 else None
        state["hdr"] = s["hdr"] if calc and way == "LineInterleaved" else "None"
        state["bit_depth"], state["frames"] = s["bit_depth"] if calc else 16, 1
        if s["value_per_code"] is None or (op == "flat_field" and s["value_offset"] != 0):
            state["value_offset"] = state["value_per_code"] = None
        else:
            state["value_offset"] = s["value_offset"] * factor**2 if op == "bin_sum" else 0.0 if op in ("subtract", "absolute_difference", "sobel") else s["value_offset"]
            state["value_per_code"] = s["value_per_code"] * (4 if op == "sobel" else 1)
    return state


def test_meaning_of_random_chains(spark):
    r = random.Random(3)
    frames, steps, want = [], [], {}
    for i in range(80):
        state = {"width": r.randint(4, 90), "height": r.randint(4, 90), "bit_depth": r.choice([8, 12]), "bayer": r.choice(["None", "Rggb"]), "hdr": r.choice(["None", "Auto", "LineInterleaved", "FrameSequential"]), "frames": r.randint(1, 3), "stages": r.randint(2, 3), "value_offset": r.choice([0.0, -1.5]), "value_per_code": 0.25}
        if i % 9 == 0:
            state |= {"value_offset": None, "value_per_code": None}
        frames.append((i, *state.values()))
        own = [(r.choice(meaning.CALCULATIONS + meaning.FILTERS + meaning.BINNINGS), r.randint(2, 4), r.choice([None, None, "Bggr", "None"])) for _ in range(r.randint(0, 6))]
        steps += [(i, k, *s) for k, s in enumerate(own)]
        want[i] = folded(dict(state), own)
    r.shuffle(steps)
    got = meaning.carried(spark.createDataFrame(frames, "frame_id long, width int, height int, bit_depth int, bayer string, hdr string, frames int, stages int, value_offset double, value_per_code double"), spark.createDataFrame(steps, "frame_id long, step int, op string, factor int, bayer string"))
    for row in got.collect():
        assert {k: row[k] for k in meaning.STATE} == want[row["frame_id"]] and row["convertible"] == (row["value_per_code"] is not None)
    choice = spark.createDataFrame([(True, "a", True, "b", "c"), (False, "a", True, "b", "c"), (False, "a", False, "b", "c")], "raw boolean, shown string, paged boolean, page string, seq string")
    assert [x[0] for x in choice.select(meaning.batch_filter("raw", "shown", "paged", "page", "seq")).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(("step", "mean", "segment"), [(1, False, None), (2, False, None), (2, True, None), (2, False, 10)])
def test_defects_and_correction_by_bands(spark, step, mean, segment):
    """Frames of 40 rows in bands of 7, defects in clusters, at edges and at band borders."""
    r = np.random.default_rng(step)
    frames = {f: r.integers(1000, 1030, (40, 20)) for f in (1, 2)}
    for v in frames.values():
        for y, x in r.integers(0, (40, 20), (12, 2)):
            v[y, x] = r.choice([0, 4095])
        v[6:8, 0:3] = 4095
    rows = spark.createDataFrame([(f, y, v[y].tolist()) for f, v in frames.items() for y in range(40)], "frame_id long, y int, codes array<int>").repartition(3)
    bad = {}
    for f, v in frames.items():
        y, x = np.indices(v.shape)
        group = (x // segment * 4 if segment else 0) + y % 2 * 2 + (x % segment if segment else x) % 2
        for g in np.unique(group):
            own = v[group == g]
            for at in np.argwhere((group == g) & ((v > own.mean() + 3 * own.std()) | (v < own.mean() - 3 * own.std()))):
                bad[f, *map(int, at)] = (v[tuple(at)] - own.mean()) / own.std()
    found = transform.defects(rows, F.lit("Rggb"), 3.0, segment).collect()
    assert {(d["frame_id"], d["y"], d["x"]): pytest.approx(d["deviation"]) for d in found} == bad
    got = {(d["frame_id"], d["y"], d["x"]): d for d in transform.corrected(transform.marked(rows, 3.0, segment), step, mean, band=7).collect()}
    assert set(got) == set(bad)
    for (f, y, x), d in got.items():
        near = []
        for ring in (1, 2, 3):
            near += [int(frames[f][y + dy * step, x + dx * step]) for dy in range(-ring, ring + 1) for dx in range(-ring, ring + 1) if max(abs(dy), abs(dx)) == ring and 0 <= y + dy * step < 40 and 0 <= x + dx * step < 20 and (f, y + dy * step, x + dx * step) not in bad]
            if len(near) >= 2:
                break
        want = math.floor((np.mean(near) if mean else np.median(near)) + 0.5) if near else int(frames[f][y, x])
        assert (d["corrected"], d["neighbours"], d["code"], d["type"]) == (want, len(near), int(frames[f][y, x]), "hot" if frames[f][y, x] > 2000 else "dead")


def test_a_tall_frame_is_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("1L AS frame_id", "CAST(id AS INT) AS y", "IF(id = 9000, array(4095, 11), array(10, 11)) AS codes")
    plan = transform.corrected(transform.marked(rows, 6.0), 1)
    assert "hashpartitioning(frame_id" in plan._jdf.queryExecution().executedPlan().toString() and ", band" in plan._jdf.queryExecution().executedPlan().toString()
    assert [(d["y"], d["x"], d["corrected"]) for d in plan.collect()] == [(9000, 0, 11)]


def test_ranks_by_deviation(spark):
    table = [(1, 0, 0, 5.0), (1, 0, 1, -7.0), (1, 2, 0, 7.0), (1, 1, 0, None), (2, 0, 0, -7.0), (2, 0, 5, 1.0)]
    found = spark.createDataFrame(table, "frame_id long, y int, x int, deviation double")
    order = lambda df, *k: [tuple(r) for r in df.orderBy(*k).select("frame_id", "y", "x", "rank").collect()]
    assert order(transform.ranked_by_deviation(found, 4), "rank") == [(1, 0, 1, 1), (1, 2, 0, 2), (2, 0, 0, 3), (1, 0, 0, 4)]
    assert order(transform.ranked_by_deviation(found, 9, "frame_id"), "frame_id", "rank") == [(1, 0, 1, 1), (1, 2, 0, 2), (1, 0, 0, 3), (1, 1, 0, 4), (2, 0, 0, 1), (2, 0, 5, 2)]
    plan = transform.ranked_by_deviation(found, 4)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_defects_from_batches_of_rows(spark):
    """A batch leaves one record of moments for each frame and phase; rows of several widths and without values share it; bounds are each segment's own."""
    r = np.random.default_rng(8)
    lines = [(f, y, None if (f, y) == (1, 3) else r.integers(0, 5000 if r.random() < 0.1 else 900, 40 if f < 3 else 24 + y % 2).tolist()) for f in range(5) for y in range(12)]
    rows = spark.createDataFrame(lines, "frame_id long, y int, codes array<int>").coalesce(1)
    assert transform.phase_moments(rows).count() == 5 * 4
    for segment in (None, 12):
        pools = {}
        for f, y, codes in lines:
            for x, v in enumerate(codes or []):
                pools.setdefault((f, x // segment if segment else 0, y % 2 * 2 + (x % segment if segment else x) % 2), []).append((y, x, v))
        want = set()
        for (f, _, _), own in pools.items():
            v = np.array([p[2] for p in own], float)
            want |= {(f, y, x, c, "hot" if c > v.mean() else "dead") for y, x, c in own if abs(c - v.mean()) > 1.5 * v.std()}
        got = [(d["frame_id"], d["y"], d["x"], d["code"], d["type"]) for d in transform.defects(rows, F.lit("Rggb"), 1.5, segment).collect()]
        assert want and len(got) == len(want) and set(got) == want
