"""Queries over file formats, catalogues, exports and raw bytes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import catalog, measure
from ..operators import formats as fmt
from ..sources import frames as src
from ..sources import raw
from .fleet import FILES, SCENE, files, flat_defects, query, scene

DESCRIPTOR = """v AS (SELECT doc_id, (doc_id%7*10-10)::INT AS width, (doc_id%5*16)::INT AS height, (doc_id%6*2+6)::INT AS bit_depth, (['Lsb','Msb','Odd'])[doc_id%3+1] AS packing, (['Little','Big'])[doc_id%2+1] AS endianness, (['None','Rggb','X'])[doc_id//3%3+1] AS bayer,
 (['None','Auto','LineInterleaved','FrameSequential'])[doc_id//2%4+1] AS hdr, (doc_id%4+1)::INT AS stages, (doc_id%9-1)::INT AS line_block, (doc_id%11-1)::DOUBLE AS exposure_ratio, (doc_id%13*4-4)::INT AS header, (doc_id%3)::INT AS frames, n_chars AS length FROM documents)"""


def descriptors(spark, d):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.expr(k) + 1).cast("int"))
    number = lambda e, n, t="INT": F.expr(f"CAST({e} AS {t})").alias(n)
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select(
        "doc_id", number("doc_id % 7 * 10 - 10", "width"), number("doc_id % 5 * 16", "height"), number("doc_id % 6 * 2 + 6", "bit_depth"), pick(("Lsb", "Msb", "Odd"), "doc_id % 3").alias("packing"),
        pick(("Little", "Big"), "doc_id % 2").alias("endianness"), pick(("None", "Rggb", "X"), "doc_id DIV 3 % 3").alias("bayer"), pick(("None", "Auto", "LineInterleaved", "FrameSequential"), "doc_id DIV 2 % 4").alias("hdr"),
        number("doc_id % 4 + 1", "stages"), number("doc_id % 9 - 1", "line_block"), number("doc_id % 11 - 1", "exposure_ratio", "DOUBLE"), number("doc_id % 13 * 4 - 4", "header"), number("doc_id % 3", "frames"), c("n_chars").alias("length"),
    )


BPP = "(CASE WHEN bit_depth <= 8 THEN 1 ELSE 2 END)"


@query(f"""WITH {DESCRIPTOR} SELECT doc_id, concat_ws(',', CASE WHEN width<=0 THEN 'width' END, CASE WHEN height<=0 THEN 'height' END, CASE WHEN exposure_ratio<=0 THEN 'exposure_ratio' END, CASE WHEN bit_depth NOT IN (8,10,12,14,16) THEN 'bit_depth' END, CASE WHEN packing NOT IN ('Lsb','Msb') THEN 'packing' END,
 CASE WHEN bayer = 'X' THEN 'bayer' END, CASE WHEN header < 0 THEN 'header' END, CASE WHEN frames <= 0 THEN 'frames' END, CASE WHEN hdr <> 'None' AND stages NOT IN (2,3) THEN 'stages' END, CASE WHEN line_block < 0 THEN 'line_block' END, CASE WHEN header + width*height*{BPP}*frames > length THEN 'short' END) AS reasons FROM v""")
def s03_every_rule(spark, d):
    return descriptors(spark, d).select("doc_id", F.array_join(fmt.broken_rules("length"), ",").alias("reasons"))


@query(f"""WITH {DESCRIPTOR}, g AS (SELECT doc_id, 8 AS w, 4 AS h, bit_depth, greatest(header, 0) AS header, 20 AS declared, length, 32*{BPP} AS fb FROM v), t AS (SELECT *, least(declared, (length-header)//fb) AS n FROM g WHERE length > header)
SELECT doc_id, unnest(range(0, n))::BIGINT AS frame, (header + unnest(range(0, n))*fb)::BIGINT AS offset FROM t WHERE n > 0""")
def s04_frames_in_files(spark, d):
    t = descriptors(spark, d).select("doc_id", "length", F.lit(8).alias("width"), F.lit(4).alias("height"), "bit_depth", F.greatest("header", F.lit(0)).alias("header"), F.lit(20).alias("frames"))
    return fmt.frames_of(t).select("doc_id", "frame", "offset")


@query(f"WITH {SCENE} SELECT frame_id, (y//4)::INT AS y, (x//4)::INT AS x, code FROM px WHERE y % 4 = 0 AND x % 4 = 0")
def s11_preview(spark, d):
    """Frames for a preview of 24 x 24: a step of three, made even for the colour filter."""
    step = fmt.preview_step("width", "height", "bayer", 24, 24)
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", F.lit(64).alias("width"), F.lit(48).alias("height"), "bayer"), "frame_id").withColumn("step", step)
    return fmt.preview(rows, "step").select("frame_id", "y", F.posexplode("codes").alias("x", "code"))


@query(f"""WITH {FILES}, n AS (SELECT folder||'/'||name AS path, name, ext, length, doc_id, k FROM f), hist AS (SELECT length, ext, doc_id%5 AS format, count(*) FILTER (doc_id%7=0) > 0 AS auto_open FROM n GROUP BY ALL), may AS (SELECT length, ext, min(format) AS format FROM hist WHERE auto_open GROUP BY ALL HAVING count(*) = 1)
SELECT path, CASE WHEN doc_id%10=0 THEN 'PathMemory' WHEN may.format IS NOT NULL AND n.length > 0 THEN 'SizeMemory' ELSE 'Dialog' END AS origin, CASE WHEN doc_id%10=0 THEN doc_id%5 WHEN may.format IS NOT NULL AND n.length > 0 THEN may.format WHEN k = 1 THEN 3 ELSE 9 END::BIGINT AS format FROM n LEFT JOIN may USING (length, ext)""")
def j09_j10_open_plans(spark, d):
    f = files(spark, d)
    history = f.groupBy("length", "ext", (c("doc_id") % 5).alias("format")).agg((F.count_if(c("doc_id") % 7 == 0) > 0).alias("auto_open"))
    memory = f.filter("doc_id % 10 = 0").select("path", (c("doc_id") % 5).alias("format"))
    candidates = f.filter("doc_id % 3 = 1").select("path", F.lit(3).cast("long").alias("format"), F.lit(1).alias("rank"))
    return fmt.open_plans(f.select("path", "length", F.lit(9).cast("long").alias("displayed")), memory, history, candidates)


@query("""WITH e AS (SELECT doc_id AS ts, CASE WHEN doc_id%6=5 THEN 'remove' ELSE 'record' END AS action, n_chars%20 AS length, '.raw' AS ext, doc_id//2%3 AS format, CASE doc_id%4 WHEN 0 THEN true WHEN 1 THEN false END AS auto_open FROM documents),
w AS (SELECT *, count(*) FILTER (action='remove') OVER (PARTITION BY length, format ORDER BY ts) AS life, max(ts) FILTER (action='record' AND auto_open) OVER (PARTITION BY length) AS last_allowed FROM e),
l AS (SELECT *, max(life) OVER (PARTITION BY length, format) AS last_life FROM w)
SELECT length, ext, format, max(ts) AS used, coalesce(arg_max(auto_open, ts) FILTER (auto_open IS NOT NULL), false) AND coalesce(max(ts) FILTER (auto_open) = max(last_allowed), false) AS auto_open FROM l WHERE action='record' AND life = last_life GROUP BY ALL""")
def w06_history_after(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    auto = F.when(c("doc_id") % 4 == 0, True).when(c("doc_id") % 4 == 1, False)
    events = t.select(c("doc_id").alias("ts"), F.when(c("doc_id") % 6 == 5, "remove").otherwise("record").alias("action"), (c("n_chars") % 20).alias("length"), F.lit(" RAW").alias("ext"), F.expr("doc_id DIV 2 % 3").alias("format"), auto.alias("auto_open"))
    return fmt.history_after(events)


@query(f"WITH {FILES}, s AS (SELECT *, count(*) OVER w AS n, lag(name) OVER o AS previous, lead(name) OVER o AS next FROM f WINDOW w AS (PARTITION BY folder, ext, k), o AS (PARTITION BY folder, ext, k ORDER BY doc_id)) SELECT folder, name, previous, next FROM s WHERE n > 1")
def u08_stack_neighbours(spark, d):
    return fmt.neighbours(catalog.numbered_stacks(files(spark, d)), ["folder", "ext", "prefix", "suffix"]).select("folder", "name", "previous", "next")


@query(f"WITH {FILES}, t AS (SELECT folder, ext, length FROM f WHERE doc_id % 10 = 0) SELECT folder, name FROM f WHERE EXISTS (SELECT 1 FROM t WHERE t.folder = f.folder AND t.ext = f.ext AND t.length = f.length)")
def j14_u09_stacks_of_references(spark, d):
    """Files of the stacks that hold a reference file, every tenth, by folder, extension and length; folders come from paths."""
    named = files(spark, d).withColumns({"at": fmt.folder_of("path"), "kind": fmt.extension_of("path")})
    return named.join(named.filter("doc_id % 10 = 0").select("at", "kind", "length"), ["at", "kind", "length"], "left_semi").select("folder", "name")


@query("""WITH p AS (SELECT page_id, url FROM pages), n AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name, url FROM p) SELECT page_id, lower(regexp_extract(name, '\\.[^.]+$')) AS ext, lower(regexp_replace(regexp_replace(url, '/+$', ''), '/+[^/]*$', '')) AS folder FROM n""".replace("\\\\", "\\"))
def x22_extensions_and_folders(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fmt.extension_of("url").alias("ext"), fmt.folder_of("url").alias("folder"))


@query(f"WITH {SCENE} SELECT frame_id, 'horizontal' AS axis, x AS position, printf('%.6f', avg(code)) AS mean, min(code) AS min, max(code) AS max FROM px GROUP BY frame_id, x UNION ALL SELECT frame_id, 'vertical', y, printf('%.6f', avg(code)), min(code), max(code) FROM px GROUP BY frame_id, y")
def k04_projection_table(spark, d):
    """Projections as they are written out: means as text."""
    return measure.projections(scene(spark, d)).withColumn("mean", F.format_string("%.6f", "mean"))


@query(f"WITH {SCENE} SELECT frame_id, y, x AS position, code AS value FROM px")
def k05_line_profiles(spark, d):
    """The profile table of every row."""
    return src.rows(spark, d).select("frame_id", "y", F.posexplode("codes").alias("position", "value"))


def _defect_sql() -> str:
    from .fleet import DEFECT_SQL

    return f"WITH {DEFECT_SQL} SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY y, x))::INT AS place, x, y, code AS raw_code, type FROM d"


@query(_defect_sql())
def k06_defect_table(spark, d):
    """Defects in the order of detection."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("y", "x"))
    return flat_defects(spark, d).select("frame_id", place.alias("place"), "x", "y", c("code").alias("raw_code"), "type")


def _noise_sql() -> str:
    from .fleet import ORACLES

    return f"SELECT 'single' AS method, frame_id AS id, n, mean, sigma_total, NULL::DOUBLE AS sigma_temporal, NULL::DOUBLE AS sigma_fpn FROM ({ORACLES['a06_noise_single']}) UNION ALL SELECT 'pair', pair_id, n, mean, sigma_total, sigma_temporal, sigma_fpn FROM ({ORACLES['a07_noise_pair']})"


@query(_noise_sql())
def k07_noise_history(spark, d):
    """One row per measurement, single or of a pair."""
    from .fleet import a06_noise_single, a07_noise_pair

    one = a06_noise_single(spark, d).select(F.lit("single").alias("method"), c("frame_id").alias("id"), "n", "mean", "sigma_total", F.lit(None).cast("double").alias("sigma_temporal"), F.lit(None).cast("double").alias("sigma_fpn"))
    return one.unionByName(a07_noise_pair(spark, d).select(F.lit("pair").alias("method"), c("pair_id").alias("id"), "n", "mean", "sigma_total", "sigma_temporal", "sigma_fpn"))


@query("""WITH t AS (SELECT doc_id, n_chars AS pixels, doc_id%4+1 AS frames, (8+doc_id%5*2)::INT AS bit_depth, doc_id%3=0 AS colour FROM documents)
SELECT doc_id, (pixels*frames*(CASE WHEN bit_depth<=8 THEN 1 ELSE 2 END))::BIGINT AS raw, (pixels*4)::BIGINT AS float, (pixels*(CASE WHEN colour THEN 6 ELSE 2 END))::BIGINT AS wide, (pixels*(CASE WHEN colour THEN 3 ELSE 1 END))::BIGINT AS narrow FROM t""")
def k10_export_sizes(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", c("n_chars").alias("pixels"), (c("doc_id") % 4 + 1).alias("frames"), (8 + c("doc_id") % 5 * 2).cast("int").alias("depth"), (c("doc_id") % 3 == 0).alias("colour"))
    return t.select("doc_id", *[fmt.export_bytes(k, "pixels", "frames", "depth", "colour").alias(k) for k in ("raw", "float", "wide", "narrow")])


@query(f"WITH {SCENE}, h AS (SELECT frame_id, y, string_agg(printf('%04x', code*16), '' ORDER BY x) AS big, string_agg(printf('%02x%02x', code%256, code//256), '' ORDER BY x) AS little FROM px GROUP BY ALL) SELECT frame_id, y, sha256(unhex(big)) AS high_big, sha256(unhex(little)) AS low_little, length(unhex(big))::BIGINT AS n_bytes FROM h".replace("length(unhex", "octet_length(unhex"))
def k01_raw_bytes(spark, d):
    """The bytes of every image row: codes high-aligned, big end first, and low-aligned, little end first."""
    rows = src.rows(spark, d)
    big = raw.encode_rows(rows, src.DEPTH, high_aligned=True, big_endian=True).select("frame_id", "y", F.sha2("data", 256).alias("high_big"), F.octet_length("data").cast("long").alias("n_bytes"))
    little = raw.encode_rows(rows, src.DEPTH).select("frame_id", "y", F.sha2("data", 256).alias("low_little"))
    return big.join(little, ["frame_id", "y"])

