"""Formats of headerless files: rules, frames within a file, previews, memory of formats and plans to open, stacks and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from .ranking import beside

#: Values that a descriptor may hold (fixed values).
DEPTHS, PACKINGS, ORDERS = (8, 10, 12, 14, 16), ("Lsb", "Msb"), ("Little", "Big")
BAYERS, LAYOUTS = ("None", "Rggb", "Bggr", "Grbg", "Gbrg"), ("None", "Auto", "LineInterleaved", "FrameSequential")
#: Pixels of one frame at most.
MOST_PIXELS = 100_000_000_000


def bytes_per_pixel(depth) -> Column:
    return F.when(c(depth) <= 8, 1).otherwise(2)


def frame_bytes(width, height, depth) -> Column:
    """Null where the product leaves 64 bits."""
    return F.try_multiply(F.try_multiply(c(width).cast("long"), c(height).cast("long")), bytes_per_pixel(depth).cast("long"))


def required_bytes(width, height, depth, header, frames) -> Column:
    return F.try_add(c(header).cast("long"), F.try_multiply(frame_bytes(width, height, depth), c(frames).cast("long")))


def broken_rules(length=None) -> Column:
    """Every rule that a descriptor (width, height, bit_depth, packing, endianness, bayer, hdr, stages, line_block, exposure_ratio, header,
    frames) breaks, in a fixed order; with length, also whether the file is too short for it."""
    ratio, pixels = c("exposure_ratio"), F.try_multiply(c("width").cast("long"), c("height").cast("long"))
    rules = [
        ("width", c("width") <= 0), ("height", c("height") <= 0),
        ("exposure_ratio", ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf")) | (ratio <= 0)),
        ("pixels", pixels.isNull() | (pixels > MOST_PIXELS)), ("bit_depth", ~c("bit_depth").isin(*DEPTHS)),
        ("packing", ~c("packing").isin(*PACKINGS)), ("endianness", ~c("endianness").isin(*ORDERS)), ("bayer", ~c("bayer").isin(*BAYERS)), ("hdr", ~c("hdr").isin(*LAYOUTS)),
        ("header", c("header") < 0), ("frames", c("frames") <= 0),
        ("stages", (c("hdr") != "None") & ~c("stages").isin(2, 3)), ("line_block", c("line_block") < 0),
    ]
    if length is not None:
        needed = required_bytes("width", "height", "bit_depth", "header", "frames")
        rules.append(("short", needed.isNull() | (needed > c(length))))
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))


def frames_of(files: DataFrame) -> DataFrame:
    """files (length, width, height, bit_depth, header, frames) with one row per frame that is there whole: frame and its byte offset."""
    size = frame_bytes("width", "height", "bit_depth")
    there = F.least(c("frames").cast("long"), F.floor((c("length") - c("header")) / size))
    each = files.withColumn("frame", F.explode(F.when(there > 0, F.sequence(F.lit(0).cast("long"), there - 1))))
    return each.withColumn("offset", c("header") + c("frame") * size)


def preview_step(width, height, bayer, most_width: int, most_height: int) -> Column:
    """Every so-manieth row and column for a preview of at most this size; even above 1 for colour-filtered frames, so that one colour is taken."""
    step = F.greatest(F.ceil(c(width) / most_width), F.ceil(c(height) / most_height)).cast("int")
    return F.when((c(bayer) != "None") & (step > 1) & (step % 2 == 1), step + 1).otherwise(step)


def preview(rows: DataFrame, step) -> DataFrame:
    """Every step-th row and column of the rows that are there."""
    kept = rows.filter(c("y") % c(step) == 0)
    return kept.select("frame_id", F.floor(c("y") / c(step)).cast("int").alias("y"), F.filter("codes", lambda _, i: i % c(step) == 0).alias("codes"))


def normal_extension(ext) -> Column:
    plain = F.lower(F.trim(F.coalesce(c(ext), F.lit(""))))
    return F.when((plain == "") | plain.startswith("."), plain).otherwise(F.concat(F.lit("."), plain))


def extension_of(path) -> Column:
    """From the last dot of the name on; none where the name has no dot or ends with it."""
    return normal_extension(F.regexp_extract(F.regexp_extract(c(path), r"[^/\\]*$", 0), r"\.[^.]+$", 0))


def folder_of(path) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c(path), r"[/\\]+$", ""), r"[/\\]+[^/\\]*$", ""))


def auto_open_formats(history: DataFrame) -> DataFrame:
    """length, ext, format: the format that opens by itself for a length and extension: the only one that may."""
    may = history.filter("auto_open").groupBy("length", normal_extension("ext").alias("ext")).agg(F.count(F.lit(1)).alias("m"), F.min("format").alias("format"))
    return may.filter("m = 1").drop("m")


def open_plans(files: DataFrame, path_memory: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """path, origin, format: the file's own memory, the memory of its length and extension, or a dialog that starts with the first candidate
    or with what is displayed. Tables: path_memory (path, format), candidates (path, format, rank)."""
    size = auto_open_formats(history).withColumnRenamed("format", "of_size")
    first = candidates.filter("rank = 1").select("path", c("format").alias("candidate"))
    rows = files.withColumn("ext", extension_of("path")).join(path_memory.select("path", c("format").alias("own")), "path", "left").join(size, ["length", "ext"], "left").join(first, "path", "left")
    by_size = c("of_size").isNotNull() & (c("length") > 0)
    origin = F.when(c("own").isNotNull(), "PathMemory").when(by_size, "SizeMemory").otherwise("Dialog")
    return rows.select("path", origin.alias("origin"), F.coalesce("own", F.when(by_size, c("of_size")), "candidate", "displayed").alias("format"))


def history_after(events: DataFrame) -> DataFrame:
    """The memory after a log of events (ts, action record or remove, length, ext, format, auto_open or null): one row per length, extension and
    format still there. Recording keeps the former auto_open where none is given; allowing it takes it from the other formats of
    the key."""
    key = ["length", "ext"]
    log = events.withColumn("ext", normal_extension("ext"))
    # A removal forgets what was set before it; its time is one record of the format's key.
    removed = log.filter("action = 'remove'").groupBy(*key, "format").agg(F.max("ts").alias("removed"))
    kept = log.filter("action = 'record'").join(removed, [*key, "format"], "left").filter("removed IS NULL OR ts > removed")
    alive = kept.groupBy(*key, "format").agg(F.max("ts").alias("used"), F.max_by("auto_open", F.when(c("auto_open").isNotNull(), c("ts"))).alias("auto_open"), F.max(F.when(c("auto_open"), c("ts"))).alias("allowed"))
    last = log.filter("action = 'record' AND auto_open").groupBy(*key).agg(F.max("ts").alias("last_allowed"))
    found = alive.join(last, key, "left")
    return found.select(*key, "format", "used", (F.coalesce("auto_open", F.lit(False)) & c("allowed").eqNullSafe(c("last_allowed"))).alias("auto_open"))


def neighbours(stacked: DataFrame, key: list[str]) -> DataFrame:
    """Stacks of several files with the names before and after each."""
    return beside(stacked.filter("stack_size > 1"), key, "name", previous=-1, next=1)


def export_bytes(kind: str, pixels, frames, depth, colour) -> Column:
    """Bytes of pixel data of a save; null where the product leaves 64 bits."""
    each = {"raw": F.try_multiply(c(frames).cast("long"), bytes_per_pixel(depth).cast("long")), "float": F.lit(4).cast("long"), "wide": F.when(c(colour), 6).otherwise(2).cast("long"), "narrow": F.when(c(colour), 3).otherwise(1).cast("long")}
    return F.try_multiply(c(pixels).cast("long"), each[kind])

