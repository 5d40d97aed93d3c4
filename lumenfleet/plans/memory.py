"""Format memory from files with broken entries, and what is left when two files are merged, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators.candidates import FIELDS
from ..sources import memory
from ..sources.shared import fresh
from .fleet import query


def written(spark, d) -> str:
    """Files with an entry a line: of this version, of the one before, and four kinds of broken ones."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (c("doc_id") % 6).alias("k"))
    text = lambda form, *names: F.format_string(form, *[c(n) for n in names])
    t = t.withColumns({"n": c("doc_id") * 1000 + 100000, "w": c("doc_id") % 5 + 8, "s": c("doc_id") % 60})
    used = '"%s": "2024-03-01T10:00:%02dZ"'
    line = (
        F.when(c("k") == 0, text('{"length": %d, "ext": "RAW", ' + used.replace("%s", "used") + ', "auto_open": true, "format": {"width": %d, "height": 4, "bit_depth": 12, "header": 16}}', "n", "s", "w"))
        .when(c("k") == 1, text('{"fileSize": %d, "extension": ".bin", ' + used.replace("%s", "lastUsedUtc") + ', "format": {"width": %d, "height": 4, "hdr": "Dol", "frameCount": 2, "headerOffset": 8}}', "n", "s", "w"))
        .when(c("k") == 2, text('{"length": %d, "format": {"width": 8', "n")).when(c("k") == 3, text('{"length": %d, "format": {"width": 8, "height": 4, "bit_depth": 9}}', "n"))
        .when(c("k") == 4, text('{"length": %d, "format": {"width": "8", "height": 4}}', "n")).otherwise(text('{"length": %d, "ext": ".raw"}', "n"))
    )
    folder = fresh(spark, "memory")
    t.select(line.alias("value")).repartition(4).write.text(folder)
    return folder


@query("""SELECT doc_id*1000+100000 AS length, CASE k WHEN 0 THEN '.raw' WHEN 1 THEN '.bin' END AS ext, CASE WHEN k < 2 THEN doc_id%60 END AS second, CASE WHEN k < 2 THEN k = 0 END AS auto_open, CASE WHEN k < 2 THEN doc_id%5+8 END::INT AS width, CASE k WHEN 0 THEN 12 WHEN 1 THEN 16 END AS bit_depth,
 CASE k WHEN 0 THEN 16 WHEN 1 THEN 8 END::BIGINT AS header, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 END AS frames, CASE k WHEN 0 THEN 'None' WHEN 1 THEN 'Auto' END AS hdr, CASE k WHEN 2 THEN 'not JSON' WHEN 3 THEN 'bit_depth' WHEN 4 THEN 'a field of another kind' WHEN 5 THEN 'no format' END AS reason FROM (SELECT doc_id, doc_id%6 AS k FROM documents)""")
def s10_format_memory(spark, d):
    """Good entries as formats, each broken one by its reason."""
    good, bad = memory.read_entries(spark, written(spark, d))
    good = good.select("length", "ext", F.second("used").cast("long").alias("second"), "auto_open", "width", "bit_depth", "header", "frames", "hdr", F.lit(None).cast("string").alias("reason"))
    bad = bad.select(F.regexp_extract("entry", "[0-9]+", 0).cast("long").alias("length"), *[F.lit(None).cast(kind).alias(k) for k, kind in good.dtypes[1:-1]], "reason")
    return good.unionByName(bad)


@query("""WITH e AS (SELECT doc_id%50*100+100000 AS length, '.raw' AS ext, (doc_id%4+8)::INT AS width, doc_id AS t, doc_id%3 = 0 AS opens FROM documents), n AS (SELECT length, ext, width, max(t) AS t, arg_max(opens, t) AS opens FROM e GROUP BY ALL)
SELECT length, ext, width, t AS used, coalesce(opens AND t = max(CASE WHEN opens THEN t END) OVER (PARTITION BY length, ext), false) AS auto_open FROM n""")
def s10_merged_memory(spark, d):
    """Two memories as one: the newest of each format, one of a key that opens by itself."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    formats = {"height": 4, "bit_depth": 12, "packing": "Lsb", "endianness": "Little", "header": 0, "frames": 1, "bayer": "None", "hdr": "None", "stages": 2, "exposure_ratio": 16.0, "line_block": 0, "row_offset": 0}
    fixed = {k: F.lit(v) for k, v in formats.items()}
    e = t.select("doc_id", (c("doc_id") % 50 * 100 + 100000).alias("length"), F.lit(".raw").alias("ext"), F.timestamp_seconds("doc_id").alias("used"), (c("doc_id") % 3 == 0).alias("auto_open"), (c("doc_id") % 4 + 8).cast("int").alias("width"), *[v.alias(k) for k, v in fixed.items()])
    kept = ["length", "ext", "used", "auto_open", *FIELDS]
    found = memory.merged_memory(e.filter("doc_id % 2 = 0").select(kept), e.filter("doc_id % 2 = 1").select(kept))
    return found.select("length", "ext", "width", F.unix_seconds("used").alias("used"), "auto_open")
