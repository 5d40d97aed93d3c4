"""Wide samples: every kind from its bytes, ranges and codes of odd frames."""

import struct

import numpy as np
import pytest

from lumenfleet.operators import wide


def decoded(spark, sample, data, big=False, samples=1, invert=False, channels=1):
    rows = spark.createDataFrame([(1, data, sample, big, samples, invert)], "frame long, data binary, sample string, big_endian boolean, samples int, invert boolean")
    return wide.decode_samples(rows, "frame", channels=channels).first()


@pytest.mark.parametrize(("sample", "code", "values"), [("u8", "B", [0, 255]), ("u16", "H", [1, 65535]), ("u32", "I", [0, 2**32 - 1]), ("u64", "Q", [2**64 - 1, 5]), ("i8", "b", [-128, 127]), ("i16", "h", [-32768, 9]), ("i32", "i", [-(2**31), 2**31 - 1]), ("i64", "q", [-(2**63), 3]), ("f16", "e", [0.5, -65504.0]), ("f32", "f", [1.5, float("inf")]), ("f64", "d", [1e300, -0.0])])
def test_every_kind(spark, sample, code, values):
    for big in (False, True):
        data = struct.pack((">" if big else "<") + code * 2, *values)
        assert decoded(spark, sample, data, big)["v0"] == [float(v) for v in values]
    turned = decoded(spark, sample, struct.pack("<" + code * 2, *values), invert=True)["v0"]
    bits = int(sample[1:])
    assert turned == [float({"u": 2**bits - 1 - v, "i": -1 - v, "f": 1 - v}[sample[0]]) for v in values]


def test_samples_of_a_pixel(spark):
    data = struct.pack("<7h", *range(7))  # two pixels of three, and one sample that fills none
    r = decoded(spark, "i16", data, samples=3, channels=2)
    assert (r["v0"], r["v1"]) == ([0.0, 3.0], [1.0, 4.0]) and decoded(spark, "i16", None)["v0"] == []


def scaled(spark, values, sample="f32"):
    rows = spark.createDataFrame([(1, sample, values[:2]), (1, sample, values[2:])], "frame long, sample string, v0 array<double>")
    out = wide.scaled_frames(rows, "frame", "v0").collect()
    return out[0]["offset"], out[0]["upper"], out[0]["not_finite"], sorted(v for r in out for v in r["v0"])


@pytest.mark.parametrize(("values", "ends"), [([0.0, 1.0, 0.5], (0, 1)), ([0.0, 4095.5], (0, 4095.5)), ([-499.5, 3595.5], (-499.5, 3595.5)), ([-3.0, -3.0], (-3, -2)), ([float("nan"), float("inf")], (0, 1)), ([0.0, 0.25], (0, 1)), ([-0.0, -0.0], (0, 1)), ([-1e300, -1e300], (-1e300, np.nextafter(-1e300, 0))), ([-1.7e308, 1.7e308], (-1.7e308, 1.7e308))])
def test_ends_of_real_ranges(spark, values, ends):
    offset, upper, bad, codes = scaled(spark, values)
    assert (offset, upper) == ends and np.copysign(1, offset) == (-1 if ends[0] < 0 else 1)
    assert bad == sum(not np.isfinite(v) for v in values)
    half = upper * 0.5 - offset * 0.5
    assert codes == sorted(int(np.clip(np.rint((v * 0.5 - offset * 0.5) / half * 65535.0), 0, 65535)) if np.isfinite(v) else 0 for v in values)


def test_whole_numbers(spark):
    assert scaled(spark, [0.0, 0.0], "i32")[:2] == (0, 1) and scaled(spark, [5.0, 1.0], "u32")[:2] == (0, 5)
    assert scaled(spark, [7.0, 250.0], "u8") == (0, 255, 0, [7, 250])  # codes already


def test_a_pixel_counts_once(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, "f32", [nan, 2.0, 3.0], [inf, -1.0, 0.0], [0.5, 8.0, nan])], "frame long, sample string, r array<double>, g array<double>, b array<double>")
    out = wide.scaled_frames(rows, "frame", "r", "g", "b").first()
    assert (out["offset"], out["upper"], out["not_finite"]) == (-1.0, 8.0, 2) and out["r"][0] == out["b"][2] == 0 and out["b"][1] == 65535
