"""Batch export: all frames of all files as headerless files, one job, refused as a whole before a byte is written where anything is wrong."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c
from .raw_files import catalogue, committed, container, encoded, publish, register

#: codes in their containers, 16-bit full scale, 8-bit gray, 8-bit red, green and blue.
KINDS = ("codes", "full16", "gray8", "rgb8")
#: Pixels of a frame that is rendered to 8 bits, at most.
MOST_PIXELS = 100_000_000
HEADER_BYTE = 0xEE


class ExportRefused(ValueError):
    """What is wrong, by output name."""


def plain_path(path) -> Column:
    """A path without its scheme and doubled slashes, in small letters: what two names of one file have in common."""
    return F.lower(F.regexp_replace(F.regexp_replace(c(path), "^file:", ""), "/+", "/"))


def output_name(source, frame, frames, extension: str = ".raw") -> Column:
    """The source's name without its extension, with the frame's number where its file has several."""
    stem = F.regexp_replace(F.regexp_extract(c(source), r"[^/\\]*$", 0), r"\.[^.]*$", "")
    return F.concat(stem, F.when(c(frames) > 1, F.format_string("_f%03d", c(frame).cast("int"))).otherwise(""), F.lit(extension))


def refusals(frames: DataFrame, folder: str, kind: str = "codes", one_size: bool = False, existing: DataFrame | None = None, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """name, reason of every frame (source, stack, name, width, height) that can't be written to folder: "name" (no file name, or that of another
    frame too), "source" (the output would replace a frame's own or another source), "exists" (a file of existing (name)), "size" (the
    stack has several sizes, where one is needed), "pixels" (too large to be rendered). Names differ by more than case. Counts by
    name and stack are joined back; no group is brought together."""
    key = F.lower("name")
    doubled = frames.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    sources = frames.select(plain_path("source").alias("target")).distinct()
    all_frames = frames.select("*", key.alias("key"), plain_path(F.concat(F.lit(folder.rstrip("/") + "/"), "name")).alias("target"))
    found = [("name", all_frames.filter(c("name").isNull() | c("name").rlike(r"^[._]|[/\\]") | (c("name") == ""))), ("name", all_frames.join(doubled, "key", "left_semi")), ("source", all_frames.join(sources, "target", "left_semi"))]
    if existing is not None:
        found.append(("exists", all_frames.join(existing.select(F.lower("name").alias("key")), "key", "left_semi")))
    if one_size:
        mixed = frames.groupBy("stack").agg(F.min(F.struct("width", "height")).alias("a"), F.max(F.struct("width", "height")).alias("b")).filter("a <> b").select("stack")
        found.append(("size", all_frames.join(mixed, "stack", "left_semi")))
    if kind in ("gray8", "rgb8"):
        found.append(("pixels", all_frames.filter(c("width").cast("long") * c("height") > most_pixels)))
    out = None
    for reason, bad in found:
        one = bad.select("name", F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def encoded_rows(values: pa.ListArray, formats: list[tuple], codes: np.ndarray) -> pa.Array:
    """Each row of values in containers of its own format, formats[codes[i]]: (bit_depth, packing, endianness, padding). The rows of a format
    are encoded at once."""
    flat, ends = values.flatten(), np.concatenate([[0], np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    if values.null_count or flat.null_count:
        raise ValueError("a row to be written lacks values")
    flat, owner = flat.to_numpy(zero_copy_only=False), np.repeat(codes, np.diff(ends))
    order, parts = np.argsort(codes, kind="stable"), []
    for k in np.unique(codes):
        raw, sizes = encoded(flat[owner == k], *formats[k]), np.diff(ends)[codes == k] * container(*formats[k][::2]).itemsize
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(raw)]))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.concat_arrays(parts).take(pa.array(back)) if parts else pa.array([], pa.binary())


def as_bytes(rows: DataFrame) -> DataFrame:
    """(name, part, values, bit_depth, packing, endianness, padding, head) to (name, part, data): head, and values in containers of their depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, int] = {}
            codes = np.array([known.setdefault(k, len(known)) for k in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)], np.int64)
            data = encoded_rows(batch.column(2), list(known), codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.binary_join_element_wise(batch.column(7), data, pa.scalar(b"", pa.binary()))], names=["name", "part", "data"])

    return rows.select("name", "part", "values", "bit_depth", "packing", "endianness", "padding", "head").mapInArrow(run, "name string, part long, data binary")


def export_frames(rows: DataFrame, frames: DataFrame, folder: str, kind: str = "codes", one_size: bool = False) -> DataFrame:
    """Write every frame to a file of its own in folder; returns name, bytes, sha256 of the files.

    rows (frame_id, y, codes; for "rgb8" r, g, b of 8 bits); frames (frame_id, source, stack, name, width, height, bit_depth, and where given
    packing, endianness, padding, header). Everything is checked first; ExportRefused names up to twenty frames, and nothing is written.
    A task that runs twice leaves one file: attempts write apart, one note on the driver makes them count, and names are given in
    tasks. After a failure in between, publish(spark, folder) finishes it. A file is written by one task, row by row.
    """
    spark = rows.sparkSession
    register(spark)
    defaults = {"packing": F.lit("Lsb"), "endianness": F.lit("Little"), "padding": F.lit(0), "header": F.lit(0)}
    frames = frames.withColumns({k: v for k, v in defaults.items() if k not in frames.columns})
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    existing = catalogue(spark, folder, recursive=False).select("name") if there else None
    bad = refusals(frames, folder, kind, one_size, existing).limit(20).collect()
    if bad:
        raise ExportRefused("; ".join(f"{r['name']}: {r['reason']}" for r in sorted(bad)))
    # Both sides are dealt by frame, and the numbers of the rows come from there: a frame's rows meet in one task, in order, by one shuffle.
    described = frames.select("frame_id", "name", "bit_depth", "packing", "endianness", "padding", "header").hint("shuffle_hash")
    joined = described.join(rows.withColumn("there", F.lit(True)), "frame_id", "left").filter("there OR header > 0")
    joined = joined.withColumn("part", F.row_number().over(Window.partitionBy("frame_id", "name").orderBy("y")).cast("long"))
    top = F.pow(F.lit(2), c("bit_depth")).cast("int") - 1
    narrow = {"bit_depth": F.lit(8)}
    if kind == "codes":
        made = joined.withColumn("values", c("codes"))
    elif kind == "full16":
        made = joined.withColumn("values", F.transform("codes", lambda v: v * F.pow(F.lit(2), 16 - c("bit_depth")).cast("int"))).withColumns({"bit_depth": F.lit(16)})
    elif kind == "gray8":
        made = joined.withColumn("values", F.transform("codes", lambda v: F.rint(v / top * 255).cast("int"))).withColumns(narrow)
    elif kind == "rgb8":
        made = joined.withColumn("values", F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.array(p["r"], p["g"], p["b"])))).withColumns(narrow)
    else:
        raise ValueError(f"not a kind of export: {kind}")
    head = F.when((c("part") == 1) & (c("header") > 0), F.unhex(F.repeat(F.lit(f"{HEADER_BYTE:02x}"), c("header").cast("int")))).otherwise(F.lit(b""))
    parts = as_bytes(made.withColumns({"head": head, "values": F.when(c("there"), c("values")).otherwise(F.array().cast("array<int>"))}))
    parts.write.format("raw_frames").mode("append").save(folder)
    return publish(spark, folder, committed(spark, folder))
