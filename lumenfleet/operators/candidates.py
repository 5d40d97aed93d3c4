"""Formats that a file may have, proposed by seven sources in order, the first that names a format wins.

A format is a row of FIELDS. Memory is the recent part of what was used before, bounded by its own rule (history_recency), so it travels to
the files; what a memory proposes depends on a file's length alone and is worked out once for each length. Sources that fix the size of
a frame meet lengths by an equi join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c
from .catalog import name_dimensions
from .formats import broken_rules, bytes_per_pixel, frame_bytes, normal_extension, required_bytes

FIELDS = ("width", "height", "bit_depth", "packing", "endianness", "header", "frames", "bayer", "hdr", "stages", "exposure_ratio", "line_block", "row_offset")
#: What a format has where nothing is known (fixed values).
DEFAULTS = {"bit_depth": 12, "packing": "Lsb", "endianness": "Little", "header": 0, "frames": 1, "bayer": "None", "hdr": "None", "stages": 2, "exposure_ratio": 16.0, "line_block": 0, "row_offset": 0}
#: In order of priority (fixed values).
SOURCES = ("SameSizeMemory", "DisplayedImage", "MemoryFrameCount", "MemoryHeight", "MemoryResolution", "FileName", "ResolutionTable")
#: Sizes of common sensors and test images, in the order in which they are proposed (fixed values).
RESOLUTIONS = (
    (640, 480), (720, 480), (800, 600), (1024, 768), (1280, 720), (1280, 800), (1280, 960), (1280, 1024), (1440, 1080), (1600, 1200), (1920, 1080),
    (1920, 1200), (2048, 1080), (2048, 1536), (2560, 1440), (2560, 1600), (2592, 1944), (3072, 2048), (3264, 2448), (3840, 2160), (4000, 3000),
    (4056, 3040), (4096, 2160), (4096, 3072), (4608, 3456), (5120, 2880), (5472, 3648), (6000, 4000), (6144, 4096), (7680, 4320), (8192, 4320),
    (8192, 6144), (9152, 6944), (9344, 7000), (11648, 8736), (13376, 9528),
    (512, 512), (1024, 1024), (2048, 2048), (4096, 4096), (8192, 8192), (16384, 16384), (32768, 32768),
)
#: Entries of memory that count, newest first.
MEMORY = 200
MOST_COUNT = 2**31 - 1


def fits_exactly(length) -> Column:
    """A valid format whose frames, behind the header, are the whole file."""
    return (F.size(broken_rules()) == 0) & F.coalesce(required_bytes("width", "height", "bit_depth", "header", "frames") == c(length), F.lit(False))


def can_open(length) -> Column:
    """A valid format whose frames are there; the file may go on behind them."""
    return (F.size(broken_rules()) == 0) & F.coalesce(required_bytes("width", "height", "bit_depth", "header", "frames") <= c(length), F.lit(False))


def fit_count(length, header, unit) -> Column:
    """How many units fill the file behind the header exactly; null where none do."""
    data = c(length) - c(header)
    n = F.expr("bigint(null)")
    return F.when((c(unit) > 0) & (c(header) >= 0) & (data > 0) & (F.try_mod(data, F.when(c(unit) > 0, c(unit))) == 0), F.floor(data / c(unit))).otherwise(n)


def ranked_memory(memory: DataFrame) -> DataFrame:
    """Entries (length, ext, used and the format) as they count: the newest of each (length, ext, format), 200 in all, with rank from 1. Ties
    of used go by length, extension and format."""
    valid = memory.withColumn("ext", normal_extension("ext")).filter("length is not null").filter(can_open("length"))
    newest = valid.groupBy("length", "ext", *FIELDS).agg(F.max("used").alias("used"))
    order = [F.desc("used"), "length", "ext", *FIELDS]
    few = newest.orderBy(*order).limit(MEMORY)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most 200 rows


def combinations(ranked: DataFrame) -> DataFrame:
    """What of remembered formats describes containers, each once, with the rank of its newest entry; the rest are defaults."""
    own = ("bit_depth", "packing", "endianness", "header", "bayer")
    each = ranked.groupBy(*own).agg(F.min("rank").alias("rank"))
    return each.select("rank", *[F.lit(v).alias(k) if k not in own else c(k) for k, v in DEFAULTS.items()])


def proposed(rows: DataFrame, key: str, source: int, *order, **values) -> DataFrame:
    """(key, length, format, place): place orders a source's proposals behind those of sources before it."""
    fields = [(values[k] if k in values else c(k)).alias(k) for k in FIELDS]
    parts = [*order, *[F.lit(0)] * (3 - len(order))]
    place = F.struct(F.lit(source).alias("source"), *[c(p).cast("long").alias(f"p{i}") for i, p in enumerate(parts)])
    kinds = {"width": "int", "height": "int", "bit_depth": "int", "header": "long", "frames": "int", "stages": "int", "exposure_ratio": "double", "line_block": "int", "row_offset": "int"}
    out = rows.select(key, "length", *fields, place.alias("place"))
    return out.withColumns({k: c(k).cast(kind) for k, kind in kinds.items()})


def first_ones(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Each format once, where its first source has it, and the first most of a key."""
    once = rows.groupBy(key, "length", *FIELDS).agg(F.min("place").alias("place"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place"))).filter(c("rank") <= most)


def format_proposals(files: DataFrame, memory: DataFrame, resolutions: tuple[tuple[int, int], ...] = RESOLUTIONS, most: int = 10) -> DataFrame:
    """path, rank (from 1), source and the format, at most so many for each file: files (path, name, ext, length, displayed: a format as a struct,
    or null), memory (length, ext, used and a format).

    In order: memories of the file's length and extension, newest first, where they can open it; the displayed image's format; memories
    with another number of frames, then with another height, then their containers with every listed size; sizes that the name
    states, one frame before several, with remembered containers and then the default; the listed sizes with the default. All but
    the first kind must fill the file exactly. Where frames carry exposures in sequence, or may, their number is not changed, and
    another height makes one frame without exposures.
    """
    spark = files.sparkSession
    files = files.select("path", "name", normal_extension("ext").alias("ext"), c("length").cast("long"), "displayed").filter("length > 0")
    ranked = F.broadcast(ranked_memory(memory).withColumnsRenamed({"length": "of_length", "ext": "of_ext"}))
    sequenced = c("hdr").isin("FrameSequential", "Auto")
    listed = spark.createDataFrame([(*s, i) for i, s in enumerate(resolutions)], "width int, height int, at int")
    probes = combinations(ranked)

    lengths = files.select("length").distinct()
    of_frames = lengths.join(ranked, (F.try_mod(c("length") - c("header"), frame_bytes("width", "height", "bit_depth")) == 0) & (c("length") > c("header")))
    of_frames = of_frames.withColumn("n", fit_count("length", "header", frame_bytes("width", "height", "bit_depth")))
    of_frames = of_frames.filter((c("n") <= MOST_COUNT) & ~((c("n") != c("frames")) & sequenced))
    line = c("width").cast("long") * bytes_per_pixel("bit_depth")
    of_height = lengths.join(ranked, (F.try_mod(c("length") - c("header"), line) == 0) & (c("length") > c("header")))
    of_height = of_height.withColumn("n", fit_count("length", "header", line)).filter(c("n") <= MOST_COUNT)
    bare = sequenced & (c("frames") != 1)
    plain = {k: F.when(bare, F.lit(DEFAULTS[k])).otherwise(c(k)) for k in ("hdr", "stages", "exposure_ratio", "line_block", "row_offset")}
    sized = probes.join(F.broadcast(listed)).withColumn("length", required_bytes("width", "height", "bit_depth", "header", "frames"))
    of_sizes = lengths.join(F.broadcast(sized), "length")
    by_length = [
        proposed(of_frames.withColumn("key", c("length")), "key", 2, "rank", frames=c("n")),
        proposed(of_height.withColumn("key", c("length")), "key", 3, "rank", height=c("n"), frames=F.lit(1), **plain),
        proposed(of_sizes.withColumn("key", c("length")), "key", 4, "rank", "at"),
    ]
    of_memory = first_ones(reduce(DataFrame.unionByName, by_length).filter(fits_exactly("length")), "key", most).drop("rank", "key")

    same = files.select("path", "ext", "length").join(ranked, (c("length") == c("of_length")) & (c("ext") == c("of_ext")))
    shown = files.filter("displayed is not null").select("path", "length", *[c("displayed")[k].alias(k) for k in FIELDS])
    default = {k: F.lit(v) for k, v in DEFAULTS.items()}
    all_probes = probes.unionByName(spark.range(1).select(F.lit(MEMORY + 1).alias("rank"), *[v.alias(k) for k, v in default.items()]))
    once = all_probes.groupBy(*DEFAULTS).agg(F.min("rank").alias("rank"))
    stated = files.select("path", "length", F.posexplode(name_dimensions(c("name"))).alias("at", "d")).select("path", "length", "at", F.get("d", F.lit(0)).alias("width"), F.get("d", F.lit(1)).alias("height"))
    stated = stated.filter("width > 0 AND height > 0").join(F.broadcast(once), (c("length") > c("header")) & (F.try_mod(c("length") - c("header"), c("width").cast("long") * c("height") * bytes_per_pixel("bit_depth")) == 0))
    stated = stated.withColumn("n", fit_count("length", "header", frame_bytes("width", "height", "bit_depth"))).filter(c("n") <= MOST_COUNT)
    plain_sizes = listed.select("*", *[v.alias(k) for k, v in default.items()]).withColumn("length", required_bytes("width", "height", "bit_depth", "header", "frames"))
    by_path = [
        proposed(same.filter(can_open("length")), "path", 0, "rank"),
        proposed(shown.filter(fits_exactly("length")), "path", 1),
        files.select("path", "length").join(of_memory, "length").select("path", "length", *FIELDS, "place"),
        proposed(stated, "path", 5, "at", (c("n") != 1).cast("int"), "rank", frames=c("n")).filter(fits_exactly("length")),
        proposed(files.select("path", "length").join(F.broadcast(plain_sizes), "length"), "path", 6, "at").filter(fits_exactly("length")),
    ]
    found = first_ones(reduce(DataFrame.unionByName, by_path), "path", most)
    return found.select("path", "rank", F.element_at(F.array(*map(F.lit, SOURCES)), c("place.source") + 1).alias("source"), *FIELDS)
