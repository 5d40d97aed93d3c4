"""Raw bytes of image rows: containers of one or two bytes to a code, low or high aligned, in either byte order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _kind(depth: int, big_endian: bool) -> np.dtype:
    return np.dtype("u1" if depth <= 8 else ">u2" if big_endian else "<u2")


def encode_rows(rows: DataFrame, depth: int, high_aligned: bool = False, big_endian: bool = False) -> DataFrame:
    """rows (frame_id, y, codes) to frame_id, y, data: one binary value for each image row."""
    kind, shift = _kind(depth, big_endian), 16 - depth if high_aligned and depth > 8 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2)
            flat, ends = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            packed = (flat << shift).astype(kind)
            data = [part.tobytes() for part in np.split(packed, ends[:-1])] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["frame_id", "y", "data"])

    return rows.select("frame_id", "y", "codes").mapInArrow(run, "frame_id long, y int, data binary")


def decode_rows(data: DataFrame, depth: int, high_aligned: bool = False, big_endian: bool = False) -> DataFrame:
    """frame_id, y, data back to rows (frame_id, y, codes). Bits outside the codes are dropped; null data gives no codes."""
    kind, shift = _kind(depth, big_endian), 16 - depth if high_aligned and depth > 8 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [(np.frombuffer(raw or b"", kind).astype(np.int32) >> shift) & ((1 << depth) - 1) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.list_(pa.int32()))], names=["frame_id", "y", "codes"])

    return data.select("frame_id", "y", "data").mapInArrow(run, "frame_id long, y int, codes array<int>")


def read_raw(spark: SparkSession, path: str, width: int, height: int, depth: int, high_aligned: bool = False, big_endian: bool = False, header: int = 0) -> DataFrame:
    """path, frame_id (counted within its file), y, codes of headerless frames in files of less than 2 GB; an incomplete last frame is left out."""
    line = width * (1 if depth <= 8 else 2)
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    frames = F.expr(f"CAST((length - {header}) DIV {line * height} AS INT)")
    each = files.select("path", "content", F.explode(F.when(frames > 0, F.sequence(F.lit(0), frames * height - 1))).alias("i"))
    cut = each.select("path", F.col("i").cast("long").alias("i"), F.expr(f"substring(content, {header} + i * {line} + 1, {line})").alias("data"))
    kind, shift = _kind(depth, big_endian), 16 - depth if high_aligned and depth > 8 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(np.frombuffer(raw, kind).astype(np.int32) >> shift) & ((1 << depth) - 1) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], names=["path", "i", "codes"])

    lines = cut.mapInArrow(run, "path string, i long, codes array<int>")
    return lines.select("path", F.expr(f"i DIV {height}").alias("frame_id"), F.expr(f"CAST(i % {height} AS INT)").alias("y"), "codes")


def encode_floats(rows: DataFrame, values: str = "values", *keep: str) -> DataFrame:
    """rows (frame_id, y, array of numbers) to frame_id, y, data and the kept columns: real samples of 32 bits, little end first."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() if v.is_valid else None for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), *batch.columns[3:]], names=["frame_id", "y", "data", *keep])

    return rows.select("frame_id", "y", values, *keep).mapInArrow(run, "frame_id long, y int, data binary" + "".join(f", {k} {kinds[k]}" for k in keep))


def decode_floats(data: DataFrame, *keep: str) -> DataFrame:
    """frame_id, y, data back to frame_id, y, values, and the kept columns."""
    kinds = dict(data.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(raw, "<f4") if raw is not None else None for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float32())), *batch.columns[3:]], names=["frame_id", "y", "values", *keep])

    return data.select("frame_id", "y", "data", *keep).mapInArrow(run, "frame_id long, y int, values array<float>" + "".join(f", {k} {kinds[k]}" for k in keep))
