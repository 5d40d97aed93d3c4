"""Queries that write files of frames, list them and read them back by byte ranges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..sources import export, raw_files
from ..sources import frames as src
from ..sources.shared import fresh, staged
from .fleet import SCENE, query

#: Frames of a lot, whose files are named after one source.
LOT = 8


def descriptors(spark, d) -> DataFrame:
    """Frames with the formats that their files get: every packing, byte order and header turn up."""
    f = src.frames(spark, d)
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (F.expr(k) + 1).cast("int"))
    f = f.withColumns({"stack": F.expr(f"frame_id DIV {LOT}"), "frame": c("frame_id") % LOT, "packing": pick("frame_id % 2", "Lsb", "Msb"), "endianness": pick("frame_id DIV 2 % 2", "Little", "Big"), "header": (c("frame_id") % 3 * 16).cast("int"), "padding": F.lit(0xAAAA)})
    f = f.withColumn("source", F.concat(F.lit("/fleet/lot"), c("stack").cast("string"), F.lit(".RAW")))
    return f.withColumn("name", export.output_name("source", "frame", F.lit(LOT)))


NAME = f"'lot' || frame_id//{LOT} || '_f' || lpad((frame_id%{LOT})::VARCHAR, 3, '0') || '.raw'"
ROWS = f"r AS (SELECT frame_id, y, {NAME} AS name, string_agg(code, ',' ORDER BY x) AS codes FROM px GROUP BY ALL)"


def exported(spark, d, kind: str = "codes", plain: bool = False) -> tuple[str, DataFrame, DataFrame]:
    """The folder of the scene's frames, each a file; their descriptors; name, bytes, sha256 of the files."""
    frames, folder = staged(descriptors(spark, d), "descriptors"), fresh(spark, "frames")
    own = frames.drop("packing", "endianness", "header", "padding") if plain else frames
    return folder, frames, export.export_frames(src.rows(spark, d), own, folder, kind)


@query(f"WITH {SCENE}, {ROWS} SELECT name, y, codes FROM r")
def s01_raw_files(spark, d):
    """Files with headers, padding bits and both byte orders, found by their catalogue and read by bands, each by its own format."""
    folder, frames, done = exported(spark, d)
    done.write.format("noop").mode("overwrite").save()
    files = raw_files.catalogue(spark, folder, "*.raw", recursive=False).join(frames.select("name", "width", "height", "bit_depth", "packing", "endianness", "header", F.lit(1).alias("frames")), "name")
    read = raw_files.read_frames(files)
    return read.select(F.substring_index("path", "/", -1).alias("name"), "y", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {SCENE}, l AS (SELECT o_orderkey//48 AS frame_id, o_orderkey, (o_orderkey%48)::INT AS row, x::INT AS x, ({src.CODES['scene']})::INT AS code FROM orders, range(0,64) r(x)) SELECT {NAME} AS name, (row//12)::BIGINT AS frame, (row%12)::INT AS y, string_agg(code, ',' ORDER BY x) AS codes FROM l GROUP BY ALL")
def s01_raw_source(spark, d):
    """The data source: files of one format, cut into frames of 12 rows."""
    folder, _, done = exported(spark, d, plain=True)
    done.write.format("noop").mode("overwrite").save()
    raw_files.register(spark)
    read = spark.read.format("raw_frames").options(width=64, height=12, bit_depth=12, glob="*.raw").load(folder)
    return read.select(F.substring_index("path", "/", -1).alias("name"), "frame", "y", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {SCENE}, f AS (SELECT frame_id, max(y) + 1 AS height FROM px GROUP BY frame_id) SELECT {NAME} AS name, '.raw' AS ext, (frame_id%3*16 + 128*height)::BIGINT AS length FROM f")
def s09_file_catalogue(spark, d):
    """What listing gives of the exported files; none is opened."""
    folder, _, done = exported(spark, d)
    done.write.format("noop").mode("overwrite").save()
    return raw_files.catalogue(spark, folder, "*.raw", recursive=False).select("name", "ext", "length")


_HEX = {"codes": "printf('%02x%02x', code%256, code//256)", "full16": "printf('%02x%02x', code*16%256, code*16//256)", "gray8": "printf('%02x', round_even(code/4095.0::DOUBLE*255, 0)::INT)"}


@query(f"WITH {SCENE} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {NAME} AS name, octet_length(unhex(string_agg({h}, '' ORDER BY y, x)))::BIGINT AS bytes, sha256(unhex(string_agg({h}, '' ORDER BY y, x))) AS sha256, true AS same FROM px GROUP BY frame_id" for k, h in _HEX.items()))
def k08_batch_export(spark, d):
    """All frames, each a file, in three kinds; sizes and digests of the files as they lie there, which what the sink noted must equal."""
    out = None
    for kind in _HEX:
        folder, _, done = exported(spark, d, kind, plain=True)
        done.write.parquet(f"{folder}-noted")
        noted = spark.read.schema(done.schema).parquet(f"{folder}-noted").select("name", c("bytes").alias("noted_bytes"), c("sha256").alias("noted"))
        lying = raw_files.digests(noted, folder)
        one = lying.join(noted, "name").select(F.lit(kind).alias("kind"), "name", "bytes", "sha256", ((c("noted") == c("sha256")) & (c("noted_bytes") == c("bytes"))).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out
