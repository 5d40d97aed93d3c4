"""Region queries over the derived frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..functions.semantics import c
from ..operators import measure
from ..operators import regions as reg
from ..sources import frames as src
from .fleet import MOM, SCENE, TOP, VAR, query, rounded, scene

FR = "fr AS (SELECT frame_id, max(height) AS height, any_value(bayer) AS bayer FROM px GROUP BY frame_id)"
#: Six regions for each frame: none, a rectangle, one reaching over the edge, one outside, one in a quadrant, one across quadrants.
BOXES = [(0, None, None, None, None, False, 0), (1, 3, 5, 20, 9, False, 0), (2, 50, 2, 40, 90, False, 32), (3, 70, 2, 8, 8, False, 0), (4, 2, 3, 11, 6, True, 0), (5, 20, 3, 30, 6, True, 0), (6, 20, 1, 20, 4, False, 32)]
VALUES = ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() for v in b) + ")" for b in BOXES)
RESOLVED = f"""{FR}, b AS (SELECT * FROM (VALUES {VALUES}) t(roi_id, x, y, w, h, tiled, segment)), z AS (SELECT *, CASE WHEN tiled THEN 64 ELSE 64 END AS uw, CASE WHEN tiled THEN height//2*2 ELSE height END AS uh FROM fr, b),
k AS (SELECT *, least(greatest(x,0),uw) AS cx, least(greatest(y,0),uh) AS cy, greatest(0, least(x+w,uw)-least(greatest(x,0),uw)) AS cw0, greatest(0, least(y+h,uh)-least(greatest(y,0),uh)) AS ch0 FROM z),
l AS (SELECT *, CASE WHEN cw0 > 0 AND ch0 > 0 THEN cw0 ELSE 0 END AS cw, CASE WHEN cw0 > 0 AND ch0 > 0 THEN ch0 ELSE 0 END AS ch, cx//32 AS qx, cy//(uh//2) AS qy FROM k),
m AS (SELECT *, (cx-qx*32)*2+qx AS lx, (cy-qy*(uh//2))*2+qy AS ly FROM l),
o AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN cw = 0 THEN 'outside' WHEN tiled AND ((cx+cw-1)//32 <> qx OR (cy+ch-1)//(uh//2) <> qy) THEN 'quadrants'
  WHEN segment > 0 AND (CASE WHEN tiled THEN lx ELSE cx END)//segment <> (CASE WHEN tiled THEN lx+2*(cw-1) ELSE cx+cw-1 END)//segment THEN 'exposures' END AS reason FROM m),
rr AS (SELECT *, CASE WHEN x IS NULL THEN 'whole' WHEN reason IS NOT NULL THEN 'refused' WHEN tiled THEN 'lattice' ELSE 'rectangle' END AS kind FROM o),
rs AS (SELECT frame_id, roi_id, kind, reason, CASE WHEN tiled AND x IS NOT NULL THEN 2 ELSE 1 END AS step, CASE kind WHEN 'whole' THEN 0 WHEN 'lattice' THEN lx WHEN 'rectangle' THEN cx END AS tx, CASE kind WHEN 'whole' THEN 0 WHEN 'lattice' THEN ly WHEN 'rectangle' THEN cy END AS ty,
  CASE kind WHEN 'whole' THEN 64 WHEN 'refused' THEN NULL ELSE cw END AS tw, CASE kind WHEN 'whole' THEN height WHEN 'refused' THEN NULL ELSE ch END AS th FROM rr)"""


def regions_of(spark, d):
    box = lambda b: F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(b, ("roi_id", "x", "y", "w", "h", "tiled", "segment"), ("int", "int", "int", "int", "int", "boolean", "int"), strict=True)])
    each = F.explode(F.array(*map(box, BOXES))).alias("r")
    return reg.resolved(src.frames(spark, d).select("frame_id", "width", "height", "bayer", each).select("frame_id", "width", "height", "bayer", "r.*"))


@query(f"WITH {SCENE}, {RESOLVED} SELECT frame_id, roi_id, kind, reason, tx::INT AS tx, ty::INT AS ty, tw::INT AS tw, th::INT AS th, step, coalesce(tw*th, 0)::BIGINT AS pixels FROM rs")
def f11_f12_region_targets(spark, d):
    return regions_of(spark, d).select("frame_id", "roi_id", "kind", "reason", "tx", "ty", "tw", "th", "step", "pixels")


@query(f"""WITH {SCENE}, {RESOLVED}, p AS (SELECT rs.frame_id, roi_id, code FROM rs JOIN px ON px.frame_id = rs.frame_id AND px.x >= tx AND px.x < tx+tw*step AND px.y >= ty AND px.y < ty+th*step AND (px.x-tx)%step=0 AND (px.y-ty)%step=0)
SELECT frame_id, roi_id, code, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def a04_a05_region_histograms(spark, d):
    """The histogram of every region that isn't refused: whole frames, rectangles and lattices in one pass."""
    return reg.of_regions(scene(spark, d).select("frame_id", "y", "x", "code"), regions_of(spark, d)).groupBy("frame_id", "roi_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCENE}, p AS (SELECT a.frame_id//2 AS pair_id, a.code AS a, b.code AS b FROM px a JOIN px b ON b.frame_id=a.frame_id+1 AND a.y=b.y AND a.x=b.x WHERE a.frame_id%2=0 AND a.x >= 3 AND a.x < 61 AND a.y >= 5 AND (a.x-3)%2=0 AND (a.y-5)%2=0),
m AS (SELECT pair_id, count(*) AS n, sum(a)::BIGINT AS s, sum(a::BIGINT*a)::BIGINT AS s2, sum(a-b)::BIGINT AS ds, sum((a-b)::BIGINT*(a-b))::BIGINT AS ds2 FROM p GROUP BY ALL),
e AS (SELECT pair_id, n, s::DOUBLE/n AS mean, sqrt({VAR}) AS st, sqrt({VAR.replace('s2', 'DS2').replace('s::', 'ds::').replace('DS2', 'ds2')}/2) AS tt FROM m)
SELECT pair_id, n, round(mean,6) AS mean, round(st,6) AS sigma_total, round(tt,6) AS sigma_temporal, round(sqrt(greatest(0, st*st-tt*tt)),6) AS sigma_fpn FROM e""")
def a08_lattice_noise_pair(spark, d):
    """Noise of a lattice of one channel in every A/B pair: rows meet first, then every second place of them."""
    rows = src.rows(spark, d).filter("y >= 5 AND (y - 5) % 2 = 0").withColumn("codes", F.slice("codes", 4, 58))
    even = rows.filter("frame_id % 2 = 0").select(c("frame_id").alias("frame_a"), "y", c("codes").alias("a"))
    odd = rows.filter("frame_id % 2 = 1").select((c("frame_id") - 1).alias("frame_a"), "y", c("codes").alias("b"))
    px = even.join(odd, ["frame_a", "y"]).select(F.expr("frame_a DIV 2").alias("pair_id"), F.posexplode(F.arrays_zip("a", "b")).alias("x", "v")).filter("x % 2 = 0")
    out = measure.noise_pair(px.select("pair_id", F.lit("lattice").alias("channel"), "v.a", "v.b"), TOP)
    return rounded(out.select("pair_id", "n", "mean", "sigma_total", "sigma_temporal", "sigma_fpn"), "mean", "sigma_total", "sigma_temporal", "sigma_fpn")


@query(f"""WITH {SCENE}, {FR}, s AS (SELECT frame_id, height, (frame_id%3)*20 AS seg, (frame_id%5)::INT AS stage FROM fr), a AS (SELECT *, CASE WHEN seg > 0 THEN least(stage, 64//seg-1)*seg ELSE 0 END AS l, CASE WHEN seg > 0 THEN seg ELSE 64 END AS aw FROM s)
SELECT frame_id, (l + (aw - greatest(1, aw//2))//2)::INT AS x, ((height - greatest(1, height//2))//2)::INT AS y, greatest(1, aw//2)::INT AS w, greatest(1, height//2)::INT AS h FROM a""")
def f17_centre_region(spark, d):
    fr = src.frames(spark, d).select("frame_id", "width", "height", (c("frame_id") % 3 * 20).cast("int").alias("segment"), (c("frame_id") % 5).cast("int").alias("stage"))
    box = reg.centre("width", "height", c("segment"), c("stage"))
    return fr.select("frame_id", *[v.alias(k) for k, v in box.items()])


@query(f"WITH {SCENE}, q AS (SELECT frame_id, channel, min(y) AS py, min(x) AS px_, any_value(height) AS height FROM px GROUP BY ALL) SELECT frame_id, channel, (px_*32)::INT AS x, (py*(height//2))::INT AS y, 32 AS w, (height//2)::INT AS h, (2*32-2+px_)::INT AS last_source_x FROM q")
def f18_f19_quadrants(spark, d):
    """Each channel's quadrant in the tiled frame, and the source column of its last one."""
    each = src.frames(spark, d).select("frame_id", "width", "height", "bayer", F.explode(F.array(*map(F.lit, ("R", "Gr", "Gb", "B")))).alias("channel"))
    q = each.withColumn("q", reg.quadrant("bayer", "channel", "width", "height"))
    origin = reg.div(c("q.x"), reg.div("width", 2))  # of the axis in the source
    return q.select("frame_id", "channel", "q.x", "q.y", "q.w", "q.h", (origin + 2 * (c("q.w") - 1)).alias("last_source_x"))


@query(f"""WITH {SCENE}, {FR}, t AS (SELECT frame_id, (frame_id*13%64)::INT AS x, (frame_id*7%height)::INT AS y, (32+frame_id%3*32)::INT AS tw, height FROM fr), m AS (SELECT *, CASE WHEN tw=64 THEN x::DOUBLE ELSE (x+0.5::DOUBLE)/64*tw-0.5::DOUBLE END AS mx FROM t)
SELECT frame_id, round(mx, 6) AS mapped_x, CASE WHEN mx >= -0.5 AND mx < tw-0.5 THEN least(tw-1, greatest(0, floor(mx+0.5)))::INT END AS pixel_x FROM m""")
def f20_mapped_cursor(spark, d):
    """Where a cursor stands in a frame of another width."""
    t = src.frames(spark, d).select("frame_id", "width", (c("frame_id") * 13 % 64).cast("int").alias("x"), (32 + c("frame_id") % 3 * 32).cast("int").alias("tw"))
    t = t.withColumn("mx", reg.mapped_cursor("x", "width", "tw"))
    return t.select("frame_id", F.round("mx", 6).alias("mapped_x"), reg.corresponding_pixel("mx", "tw").alias("pixel_x"))


HDR = "(['None','Auto','LineInterleaved','FrameSequential'])[doc_id%4+1] AS hdr, (doc_id//4%4+1)::INT AS frames, (doc_id//3%4+1)::INT AS stages, (['None','Rggb'])[doc_id//5%2+1] AS bayer, (doc_id//7%4)::INT AS line_block, (doc_id//11%7-3)::INT AS row_offset, (n_chars%40)::INT AS height"


def exposure_formats(spark, d):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.expr(k) + 1).cast("int"))
    number = lambda e, n: F.expr(f"CAST({e} AS INT)").alias(n)
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", pick(("None", "Auto", "LineInterleaved", "FrameSequential"), "doc_id % 4").alias("hdr"), number("doc_id DIV 4 % 4 + 1", "frames"), number("doc_id DIV 3 % 4 + 1", "stages"), pick(("None", "Rggb"), "doc_id DIV 5 % 2").alias("bayer"), number("doc_id DIV 7 % 4", "line_block"), number("doc_id DIV 11 % 7 - 3", "row_offset"), number("n_chars % 40", "height"))


WAY = "CASE WHEN hdr <> 'Auto' THEN hdr WHEN frames = stages THEN 'FrameSequential' WHEN frames = 1 THEN 'LineInterleaved' END"


@query(f"""WITH f AS (SELECT doc_id, {HDR} FROM documents), e AS (SELECT *, {WAY} AS way, CASE WHEN line_block > 0 THEN line_block WHEN bayer <> 'None' THEN 2 ELSE 1 END AS block FROM f),
g AS (SELECT *, hdr <> 'None' AND coalesce(way = 'LineInterleaved', false) AS in_frame FROM e), h AS (SELECT *, bayer <> 'None' AND in_frame AND (block % 2 <> 0 OR row_offset % 2 <> 0) AS phase_mismatch FROM g)
SELECT doc_id, in_frame, phase_mismatch, concat_ws(',', CASE WHEN in_frame THEN 'noise,horizontal_projection,defects' END, CASE WHEN phase_mismatch THEN 'channel_histogram,white_balance,colour_display' END) AS refused FROM h""")
def f15_exposure_guards(spark, d):
    t = exposure_formats(spark, d).withColumns(reg.exposure_guards("hdr", "frames", "stages", "bayer", "line_block", "row_offset"))
    return t.select("doc_id", "in_frame", "phase_mismatch", F.array_join("refused", ",").alias("refused"))


@query(f"""WITH f AS (SELECT doc_id, {HDR} FROM documents), e AS (SELECT *, {WAY} AS way, CASE WHEN line_block > 0 THEN line_block WHEN bayer <> 'None' THEN 2 ELSE 1 END AS block FROM f)
SELECT doc_id, way AS layout, block, CASE WHEN hdr = 'None' THEN 'no exposures' WHEN stages NOT IN (2,3) THEN 'stages' WHEN way IS NULL THEN 'layout open' WHEN way = 'FrameSequential' AND frames <> stages THEN 'frames'
 WHEN way = 'LineInterleaved' AND stages*block > height THEN 'period' WHEN way = 'LineInterleaved' AND height//(stages*block)*block - abs(row_offset)*(stages-1) <= 0 THEN 'offset' END AS refusal FROM e""")
def u03_x24_layouts(spark, d):
    """How the exposures of a format lie, its effective line block, and why it can't be split."""
    block = reg.effective_line_block("line_block", "bayer")
    t = exposure_formats(spark, d).withColumn("block", block)
    return t.select("doc_id", reg.layout("hdr", "frames", "stages").alias("layout"), "block", reg.split_refusal("hdr", "frames", "stages", "height", "block", "row_offset").alias("refusal"))


@query(f"WITH {SCENE} SELECT frame_id//2 AS sequence_id, (frame_id%2)::INT AS stage, y, x, code FROM px")
def u02_frame_sequential_split(spark, d):
    """Frames that follow each other are the stages of one exposure sequence."""
    rows = src.rows(spark, d).select(F.expr("frame_id DIV 2").alias("sequence_id"), (c("frame_id") % 2).cast("int").alias("stage"), "y", F.posexplode("codes").alias("x", "code"))
    return rows.select("sequence_id", "stage", "y", "x", "code")


@query(f"""WITH {SCENE}, {FR}, pt AS (SELECT frame_id//2 AS pair_id, frame_id%2 AS k, frame_id, (frame_id//2*13%80)::INT AS x, (frame_id//2*7%60)::INT AS y FROM fr), g AS (SELECT pair_id, pt.x, pt.y, max(code) FILTER (pt.k=0) AS a, max(code) FILTER (pt.k=1) AS b FROM pt LEFT JOIN px ON px.frame_id=pt.frame_id AND px.x=pt.x AND px.y=pt.y GROUP BY ALL)
SELECT pair_id, x, y, a, b, b - a AS delta FROM g""")
def j13_readout(spark, d):
    """Codes at one point of both frames of a pair, and their difference where both have one."""
    pt = src.frames(spark, d).select("frame_id", F.expr("frame_id DIV 2").alias("pair_id"), (c("frame_id") % 2).alias("k"), F.expr("CAST(frame_id DIV 2 * 13 % 80 AS INT)").alias("x"), F.expr("CAST(frame_id DIV 2 * 7 % 60 AS INT)").alias("y"))
    got = pt.join(src.rows(spark, d), ["frame_id", "y"], "left").withColumn("code", F.get("codes", c("x")))
    both = got.groupBy("pair_id", "x", "y").agg(F.max(F.when(c("k") == 0, c("code"))).alias("a"), F.max(F.when(c("k") == 1, c("code"))).alias("b"))
    return both.withColumn("delta", c("b") - c("a"))


@query(f"""WITH {SCENE}, {FR}, t AS (SELECT frame_id AS a, frame_id+1 AS b FROM fr WHERE frame_id%2=0), w AS (SELECT a, b, x.height AS ha, y.height AS hb, a%3 AS oa, b%2 AS ob FROM t LEFT JOIN fr x ON x.frame_id=a LEFT JOIN fr y ON y.frame_id=b)
SELECT a AS frame_a, b AS frame_b, CASE WHEN hb IS NULL THEN 'missing' WHEN ha <> hb THEN 'size' WHEN oa <> ob THEN 'scaling' END AS reason FROM w""")
def j11_reference_frames(spark, d):
    """Which frames can't stand as the reference of the frame before them: missing, of another size, or scaled between other ends."""
    fr = src.frames(spark, d)
    a = fr.filter("frame_id % 2 = 0").select(c("frame_id").alias("frame_a"), (c("frame_id") + 1).alias("frame_b"), c("height").alias("ha"), (c("frame_id") % 3).alias("oa"))
    b = fr.select(c("frame_id").alias("frame_b"), c("height").alias("hb"), (c("frame_id") % 2).alias("ob"))
    reason = F.when(c("hb").isNull(), "missing").when(~c("ha").eqNullSafe(c("hb")), "size").when(~c("oa").eqNullSafe(c("ob")), "scaling")
    return a.join(b, "frame_b", "left").select("frame_a", "frame_b", reason.alias("reason"))


@query("""WITH v AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE n_chars END::DOUBLE AS code, (8 + doc_id%5*2)::INT AS depth, n_chars::DOUBLE AS gain FROM documents)
SELECT doc_id, CASE WHEN code > 0 THEN least(code, pow(2,depth)-1) ELSE pow(2,depth)-1 END AS saturation, round(20*log10(gain),6) AS gain_db, round_even(n_chars_/255.0::DOUBLE*(pow(2,depth)-1), 0)::BIGINT AS transferred, CASE WHEN depth < 16 THEN least(65535, floor(n_chars_*256*65535.0::DOUBLE/65280.0::DOUBLE + 0.5::DOUBLE))::INT ELSE (n_chars_*256)::INT END AS carried
FROM (SELECT *, gain::BIGINT % 256 AS n_chars_ FROM v)""")
def x13_x14_x15_x28_levels(spark, d):
    """Saturation codes, gains in decibels, level codes at another depth, and levels carried to processed frames."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(c("doc_id") % 4 == 0, None).when(c("doc_id") % 4 == 1, -1.0).otherwise(c("n_chars").cast("double")).alias("code"), (8 + c("doc_id") % 5 * 2).cast("int").alias("depth"), c("n_chars").cast("double").alias("gain"), (c("n_chars") % 256).alias("level"))
    carried = F.when(c("depth") < 16, sem.carried_level(c("level") * 256, 8)).otherwise(c("level") * 256).cast("int")
    return t.select("doc_id", sem.saturation_code("code", "depth").alias("saturation"), F.round(sem.gain_db("gain"), 6).alias("gain_db"), sem.transferred_level("level", F.lit(8), "depth").cast("long").alias("transferred"), carried.alias("carried"))
