"""Samples of other kinds than codes (signed, of 32 and 64 bits, half and float) to 16-bit codes by each frame's own range.

Two passes: a range for each frame, in the engine from row arrays, then the codes. Bytes become values in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c

#: Kinds of samples: unsigned, signed, real, with their bits.
SAMPLES = {"u8": "u1", "u16": "u2", "u32": "u4", "u64": "u8", "i8": "i1", "i16": "i2", "i32": "i4", "i64": "i8", "f16": "f2", "f32": "f4", "f64": "f8"}


def bit_depth(sample) -> Column:
    """Unsigned samples of up to 16 bits are codes of that depth; all others become codes of 16 bits."""
    return F.when(c(sample) == "u8", 8).otherwise(16)


def inverted(values: np.ndarray) -> np.ndarray:
    """White at zero turned round: all bits of whole numbers, one minus a real number."""
    return 1 - values.astype(np.float64) if values.dtype.kind == "f" else ~values


def decode_samples(rows: DataFrame, *keys: str, channels: int = 1) -> DataFrame:
    """rows (keys, data binary, sample, big_endian, samples: to a pixel, invert) to keys, sample and the values of the first channels of each pixel
    as doubles, in columns v0, v1 ... Further samples of a pixel are left out, and so is what doesn't fill a pixel; null data gives
    no values. An unknown sample fails."""
    names = [f"v{i}" for i in range(channels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for r in batch.select(["data", "sample", "big_endian", "samples", "invert"]).to_pylist():
                kind = np.dtype(SAMPLES[r["sample"]]).newbyteorder(">" if r["big_endian"] else "<")
                raw = r["data"] or b""
                pixels = np.frombuffer(raw, kind, len(raw) // (kind.itemsize * r["samples"]) * r["samples"]).reshape(-1, r["samples"])
                for i, values in enumerate(out):
                    one = pixels[:, i].astype(kind.newbyteorder("="))
                    values.append((inverted(one) if r["invert"] else one).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.select([*keys, "sample"]).columns, *[pa.array(v, pa.list_(pa.float64())) for v in out]], names=[*keys, "sample", *names])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "sample string", *[f"{n} array<double>" for n in names]])
    return rows.select(*keys, "data", "sample", "big_endian", "samples", "invert").mapInArrow(run, schema)


def encode_samples(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, values array<double>, sample, big_endian) to the same with data in place of values: the inverse of decode_samples for one
    sample to a pixel."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(r["values"], np.float64).astype(np.dtype(SAMPLES[r["sample"]]).newbyteorder(">" if r["big_endian"] else "<")).tobytes() for r in batch.select(["values", "sample", "big_endian"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select([*keys, "sample", "big_endian"]).columns, pa.array(data, pa.binary())], names=[*keys, "sample", "big_endian", "data"])

    return rows.select(*keys, "values", "sample", "big_endian").mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "sample string", "big_endian boolean", "data binary"]))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def frame_ranges(values: DataFrame, frame: str, *columns: str) -> DataFrame:
    """frame, real, low, high, not_finite: the range of finite values over all columns together; a pixel with any value that isn't finite counts
    once. Without finite values it is 0 to 0; -0 counts as 0."""
    each = [F.filter(k, finite) for k in columns]
    bad = F.size(F.filter(F.arrays_zip(*columns), lambda p: ~F.forall(F.array(*[p[k] for k in columns]), finite))).cast("long")
    rows = values.select(frame, "sample", F.array_min(F.concat(*each)).alias("low"), F.array_max(F.concat(*each)).alias("high"), bad.alias("bad"))
    per = rows.groupBy(frame).agg(F.bool_or(c("sample").startswith("f")).alias("real"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bad").alias("not_finite"))
    return per.select(frame, "real", *[(F.coalesce(k, F.lit(0.0)) + 0.0).alias(k) for k in ("low", "high")], "not_finite")


def scaling(real, low, high) -> tuple[Column, Column]:
    """(offset, upper): the values of the codes 0 and 65535. Below zero a frame starts at its least value; reals up to 1 end at 1; a range without
    width gets a width of one, or of one step of a double."""
    offset = F.when(c(low) < 0, c(low)).otherwise(0.0)
    upper = F.when(c(real) & (offset == 0) & (c(high) <= 1), 1.0).otherwise(c(high))
    step = F.when(offset + 1 > offset, offset + 1).otherwise(offset * F.lit(1 - 2.0**-53))
    return offset, F.when(upper <= offset, step).otherwise(upper)


def to_code(value: Column, offset, upper) -> Column:
    """To the nearest code, ties to even; what isn't finite is 0. Halves keep the widest ranges within doubles."""
    code = F.rint((value * 0.5 - c(offset) * 0.5) / (c(upper) * 0.5 - c(offset) * 0.5) * 65535.0)
    return F.when(finite(value), F.greatest(F.lit(0.0), F.least(F.lit(65535.0), code))).otherwise(0.0).cast("int")


def scaled_frames(values: DataFrame, frame: str, *columns: str) -> DataFrame:
    """The columns of values as 16-bit codes, one range for all columns of a frame, with offset, upper and not_finite of the frame. Unsigned
    samples of up to 16 bits stay as they are (offset 0; upper is their largest value)."""
    offset, upper = scaling("real", "low", "high")
    ranges = frame_ranges(values, frame, *columns).select(frame, offset.alias("offset"), upper.alias("upper"), "not_finite")
    narrow = c("sample").isin("u8", "u16")
    joined = values.join(ranges, frame)
    joined = joined.withColumns({"offset": F.when(narrow, 0.0).otherwise(c("offset")), "upper": F.when(narrow, F.pow(F.lit(2.0), bit_depth("sample")) - 1).otherwise(c("upper"))})
    codes = {k: F.when(narrow, F.transform(k, lambda v: v.cast("int"))).otherwise(F.transform(k, lambda v: to_code(v, "offset", "upper"))) for k in columns}
    return joined.withColumns(codes)
