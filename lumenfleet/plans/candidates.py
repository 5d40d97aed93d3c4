"""Format proposals for a catalogue of files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import candidates
from ..operators.candidates import FIELDS, MEMORY, RESOLUTIONS, SOURCES
from .fleet import query

_N = len(RESOLUTIONS)


def catalogue(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files whose lengths follow the listed sizes, some with bytes behind their frames, some with sizes in their names; and the memory of
    the formats that they were opened with."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    side = lambda i, k: F.element_at(F.array(*[F.lit(r[i]) for r in RESOLUTIONS]), (F.expr(k) % _N + 1).cast("int"))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (F.expr(k) + 1).cast("int"))
    t = t.withColumns({"width": side(0, "doc_id"), "height": side(1, "doc_id"), "bit_depth": F.when(c("doc_id") % 5 == 0, 8).otherwise(12), "header": c("doc_id") % 4 * 64, "frames": (c("doc_id") % 3 + 1).cast("int"), "ext": pick("doc_id % 2", ".raw", ".bin")})
    t = t.withColumn("length", c("header") + c("width").cast("long") * c("height") * F.when(c("bit_depth") == 8, 1).otherwise(2) * c("frames") + F.when(c("doc_id") % 7 == 0, 100).otherwise(0))
    t = t.withColumn("name", F.concat(F.when(c("doc_id") % 3 == 1, F.format_string("cap_%dx%d_", "width", "height")).otherwise("img"), c("doc_id").cast("string"), "ext"))
    rest = {"packing": F.when(c("doc_id") % 6 == 0, "Msb").otherwise("Lsb"), "endianness": F.when(c("doc_id") % 10 == 5, "Big").otherwise("Little"), "bayer": pick("doc_id % 4", "None", "Rggb", "Bggr", "Grbg"), "hdr": pick("doc_id DIV 3 % 4", "None", "Auto", "LineInterleaved", "FrameSequential"), "stages": F.lit(2), "exposure_ratio": F.lit(16.0), "line_block": (c("doc_id") % 2).cast("int"), "row_offset": F.lit(0)}
    memory = t.withColumns(rest).select("length", "ext", c("doc_id").alias("used"), *FIELDS)
    shown = {k: F.lit(v) for k, v in candidates.DEFAULTS.items()} | {"width": side(0, "doc_id * 5"), "height": side(1, "doc_id * 5"), "header": F.lit(0).cast("long"), "frames": F.lit(1)}
    displayed = F.when(c("doc_id") % 2 == 0, F.struct(*[shown[k].alias(k) for k in FIELDS]))
    files = t.select(F.concat_ws("/", "source", "name").alias("path"), "name", "ext", "length", displayed.alias("displayed"))
    return files, memory


def _sql(most: int = 10) -> str:
    fields = ", ".join(FIELDS)
    default = {k: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for k, v in candidates.DEFAULTS.items()}
    own = lambda **k: ", ".join(f"{(default | k).get(x, x)} AS {x}" for x in FIELDS)
    of = lambda t, **k: ", ".join(f"{k.get(x, f'{t}.{x}')} AS {x}" for x in FIELDS)
    res = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(RESOLUTIONS))
    bpp = lambda t: f"(CASE WHEN {t}.bit_depth <= 8 THEN 1 ELSE 2 END)"
    seq, bare = "m.hdr IN ('FrameSequential', 'Auto')", "(m.frames <> 1 AND m.hdr IN ('FrameSequential', 'Auto'))"
    line, frame = f"(m.width::BIGINT * {bpp('m')})", f"(m.width::BIGINT * m.height * {bpp('m')})"
    plain = {k: f"CASE WHEN {bare} THEN {default[k]} ELSE m.{k} END" for k in ("hdr", "stages", "exposure_ratio", "line_block", "row_offset")}
    names = "list_transform(regexp_extract_all('|' || name || '|', '[^0-9]([0-9]{2,5}x[0-9]{2,5})[^0-9]', 1), lambda s: string_split(s, 'x'))"
    sources = ", ".join(f"'{s}'" for s in SOURCES)
    return f"""WITH res AS (SELECT * FROM (VALUES {res}) t(i, w, h)),
t0 AS (SELECT doc_id, source, w AS width, h AS height, (CASE WHEN doc_id%5=0 THEN 8 ELSE 12 END) AS bit_depth, doc_id%4*64 AS header, (doc_id%3+1)::INT AS frames, CASE WHEN doc_id%2=0 THEN '.raw' ELSE '.bin' END AS ext FROM documents JOIN res ON i = doc_id % {_N}),
t AS (SELECT *, header + width::BIGINT*height*(CASE WHEN bit_depth=8 THEN 1 ELSE 2 END)*frames + (CASE WHEN doc_id%7=0 THEN 100 ELSE 0 END) AS length,
  (CASE WHEN doc_id%3=1 THEN 'cap_'||width||'x'||height||'_' ELSE 'img' END)||doc_id||ext AS name FROM t0),
f AS (SELECT doc_id, source||'/'||name AS path, name, ext, length FROM t),
e AS (SELECT length, ext, doc_id AS used, width, height, bit_depth, CASE WHEN doc_id%6=0 THEN 'Msb' ELSE 'Lsb' END AS packing, CASE WHEN doc_id%10=5 THEN 'Big' ELSE 'Little' END AS endianness, header, frames,
  (['None','Rggb','Bggr','Grbg'])[doc_id%4+1] AS bayer, (['None','Auto','LineInterleaved','FrameSequential'])[doc_id//3%4+1] AS hdr, 2 AS stages, 16.0::DOUBLE AS exposure_ratio, (doc_id%2)::INT AS line_block, 0 AS row_offset FROM t),
m AS (SELECT *, row_number() OVER (ORDER BY used DESC, length, ext, {fields}) AS rank FROM (SELECT length, ext, {fields}, max(used) AS used FROM e GROUP BY ALL) QUALIFY rank <= {MEMORY}),
p AS (SELECT bit_depth, packing, endianness, header, bayer, min(rank) AS rank FROM m GROUP BY ALL),
pd AS (SELECT bit_depth, packing, endianness, header, bayer, min(rank) AS rank FROM (SELECT * FROM p UNION ALL SELECT 12, 'Lsb', 'Little', 0, 'None', {MEMORY + 1}) GROUP BY ALL),
d AS (SELECT path, length, x.w AS width, x.h AS height FROM f JOIN res x ON x.i = doc_id * 5 % {_N} WHERE doc_id % 2 = 0),
nd AS (SELECT path, length, unnest(range(0, len(l))) AS pos, unnest(l)[1]::INT AS w, unnest(l)[2]::INT AS h FROM (SELECT path, length, list_distinct({names}) AS l FROM f)),
a AS (
SELECT path, f.length, {of('m')}, 0 AS src, rank AS p0, 0 AS p1, 0 AS p2 FROM f JOIN m USING (length, ext)
UNION ALL SELECT path, length, {own(width='width', height='height')}, 1, 0, 0, 0 FROM d
UNION ALL SELECT path, f.length, {of('m', frames=f'(f.length - m.header) // {frame}')}, 2, rank, 0, 0 FROM f, m WHERE f.length > m.header AND (f.length - m.header) % {frame} = 0 AND NOT ((f.length - m.header) // {frame} <> m.frames AND {seq})
UNION ALL SELECT path, f.length, {of('m', height=f'(f.length - m.header) // {line}', frames='1', **plain)}, 3, rank, 0, 0 FROM f, m WHERE f.length > m.header AND (f.length - m.header) % {line} = 0
UNION ALL SELECT path, f.length, {own(width='w', height='h', bit_depth='p.bit_depth', packing='p.packing', endianness='p.endianness', header='p.header', bayer='p.bayer')}, 4, rank, i, 0 FROM f, p, res
UNION ALL SELECT path, n.length, {own(width='w', height='h', bit_depth='pd.bit_depth', packing='pd.packing', endianness='pd.endianness', header='pd.header', bayer='pd.bayer', frames=f"(n.length - pd.header) // (w::BIGINT * h * {bpp('pd')})")}, 5, pos, CASE WHEN (n.length - pd.header) // (w::BIGINT * h * {bpp('pd')}) <> 1 THEN 1 ELSE 0 END, rank FROM nd n, pd WHERE n.length > pd.header
UNION ALL SELECT path, length, {own(width='w', height='h')}, 6, i, 0, 0 FROM f, res),
u AS (SELECT path, {fields}, min([src, p0, p1, p2]) AS place FROM a WHERE (src = 0 OR header + width::BIGINT * height * {bpp('a')} * frames = length) GROUP BY path, {fields})
SELECT path, rank::INT AS rank, ([{sources}])[place[1] + 1] AS source, width::INT AS width, height::INT AS height, bit_depth::INT AS bit_depth, packing, endianness, header::BIGINT AS header, frames::INT AS frames, bayer, hdr, stages::INT AS stages, exposure_ratio, line_block::INT AS line_block, row_offset::INT AS row_offset
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place) AS rank FROM u) WHERE rank <= {most}"""


@query(_sql())
def j08_all_sources(spark, d):
    return candidates.format_proposals(*catalogue(spark, d))
