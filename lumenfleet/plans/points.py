"""Queries at single points, over segments and over raw bytes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..functions.semantics import c
from ..sources import frames as src
from ..sources import raw
from .fleet import DEFECT_SQL, SCENE, flat_defects, query, rounded, scene

H = "fr AS (SELECT frame_id, max(height) AS height FROM px GROUP BY frame_id)"
#: A point for each frame, on some frames beyond the edge.
POINT = ("CAST(frame_id * 13 % 80 AS INT)", "CAST(frame_id * 7 % 60 AS INT)")
POINT_SQL = f"{H}, pt AS (SELECT frame_id, height, (frame_id*13%80)::INT AS px_, (frame_id*7%60)::INT AS py_ FROM fr)"


def points(spark, d):
    return src.frames(spark, d).select("frame_id", "width", "height", "bayer", F.expr(POINT[0]).alias("px"), F.expr(POINT[1]).alias("py"))


@query(f"""WITH {SCENE}, t AS (SELECT frame_id, x//21 AS segment, (['R','Gr','Gb','B'])[(y%2*2 + (x - x//21*21)%2) + 1] AS c0, (y%2*2 + (x - x//21*21)%2) AS k, code FROM px),
u AS (SELECT frame_id, segment, code, CASE frame_id%4 WHEN 0 THEN c0 WHEN 1 THEN (['B','Gb','Gr','R'])[k+1] WHEN 2 THEN (['Gr','R','B','Gb'])[k+1] ELSE (['Gb','B','R','Gr'])[k+1] END AS channel FROM t)
SELECT frame_id, segment::INT AS segment, channel, count(*)::BIGINT AS n, sum(code)::BIGINT AS total FROM u GROUP BY ALL""")
def f04_segment_channels(spark, d):
    """Segments of an odd width: their own left edge sets the colour phase."""
    px = scene(spark, d).select("frame_id", F.expr("CAST(x DIV 21 AS INT)").alias("segment"), sem.cfa_channel("bayer", "x", "y", 21).alias("channel"), "code")
    return px.groupBy("frame_id", "segment", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("total"))


@query(f"""WITH {SCENE}, {H} SELECT frame_id, (['Rggb','Grbg','Gbrg','Bggr'])[xor(([0,3,1,2])[frame_id%4+1], (frame_id%3%2 + 2*(frame_id%5%2))::INT) + 1] AS shifted FROM fr""")
def f05_origin_shift(spark, d):
    """The pattern that a crop at (frame_id % 3, frame_id % 5) starts with: told by its first pixel and the one to the right."""
    f = src.frames(spark, d).select("frame_id", "bayer", (c("frame_id") % 3).alias("dx"), (c("frame_id") % 5).alias("dy"))
    first, right = sem.cfa_channel("bayer", "dx", "dy"), sem.cfa_channel("bayer", c("dx") + 1, "dy")
    shifted = F
    for name, channels in sem.CFA.items():
        shifted = shifted.when((first == channels[0]) & (right == channels[1]), name)
    return f.select("frame_id", shifted.alias("shifted"))


@query("SELECT o_orderkey, (o_orderkey%5000 << 4)::INT AS code16, least(4095, o_orderkey%5000)::INT AS code, least(65535, (o_orderkey%5000 << 4))::INT AS clamped FROM orders")
def f06_code_scales(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (c("o_orderkey") % 5000).cast("int").alias("v"))
    wide = sem.code16("v", F.lit(src.DEPTH)).cast("int")
    return o.select("o_orderkey", wide.alias("code16"), F.shiftright(F.least(wide, F.lit(65535)), 4).alias("code"), F.least(wide, F.lit(65535)).alias("clamped"))


@query(f"""WITH {SCENE}, {POINT_SQL} SELECT pt.frame_id, px_ AS x, py_ AS y, code FROM pt LEFT JOIN px ON px.frame_id = pt.frame_id AND px.x = px_ AND px.y = py_""")
def s06_point_lookup(spark, d):
    p = points(spark, d).select("frame_id", c("py").alias("y"), c("px").alias("x"))
    return p.join(src.rows(spark, d), ["frame_id", "y"], "left").select("frame_id", "x", "y", F.try_element_at("codes", c("x") + 1).alias("code"))


@query(f"""WITH {SCENE}, {POINT_SQL}, i AS (SELECT * FROM pt WHERE px_ < 64 AND py_ < height)
SELECT i.frame_id, 'horizontal' AS axis, x AS position, code FROM i JOIN px ON px.frame_id = i.frame_id AND y = py_ UNION ALL SELECT i.frame_id, 'vertical', y, code FROM i JOIN px ON px.frame_id = i.frame_id AND x = px_
UNION ALL SELECT frame_id, NULL, NULL, NULL FROM pt WHERE px_ >= 64 OR py_ >= height""")
def f07_f09_cross_profile(spark, d):
    """Row and column through each frame's point: one join by frame, pixels only within the joined rows."""
    p = points(spark, d).withColumn("inside", (c("px") < c("width")) & (c("py") < c("height")))
    both = src.rows(spark, d).join(p.filter("inside"), "frame_id")
    across = both.filter("y = py").select("frame_id", F.lit("horizontal").alias("axis"), F.posexplode("codes").alias("position", "code"))
    down = both.select("frame_id", F.lit("vertical").alias("axis"), c("y").alias("position"), F.element_at("codes", c("px") + 1).alias("code"))
    none = p.filter("NOT inside").selectExpr("frame_id", "CAST(NULL AS STRING) axis", "CAST(NULL AS INT) position", "CAST(NULL AS INT) code")
    return across.unionByName(down).unionByName(none)


@query(f"""WITH {SCENE}, {POINT_SQL}, b AS (SELECT frame_id, least(px_, 62)//2*2 AS bx, least(py_, height-2)//2*2 AS by_ FROM pt WHERE height >= 2),
m AS (SELECT b.frame_id, max(code) FILTER (channel='R') AS r, (max(code) FILTER (channel='Gr') + max(code) FILTER (channel='Gb'))//2 AS g, max(code) FILTER (channel='B') AS b FROM b JOIN px ON px.frame_id=b.frame_id AND x//2*2 = bx AND y//2*2 = by_ GROUP BY b.frame_id)
SELECT frame_id, round(CASE WHEN r <= 64 OR g <= 64 THEN 1 ELSE (g-64)::DOUBLE/(r-64) END,6) AS gain_r, round(CASE WHEN b <= 64 OR g <= 64 THEN 1 ELSE (g-64)::DOUBLE/(b-64) END,6) AS gain_b FROM m""")
def a14_spot_white_balance(spark, d):
    """Gains from the 2 x 2 block at each frame's point, moved inside the frame."""
    block = points(spark, d).filter("height >= 2").selectExpr("frame_id", "bayer", "CAST(least(px, 62) DIV 2 * 2 AS INT) bx", "CAST(least(py, height - 2) DIV 2 * 2 AS INT) by")
    near = block.select("*", F.explode(F.array("by", c("by") + 1)).alias("y")).join(src.rows(spark, d), ["frame_id", "y"])
    px = near.select("frame_id", "bayer", "y", "bx", F.posexplode(F.slice("codes", c("bx") + 1, 2)).alias("i", "code"))
    of = px.select("frame_id", sem.cfa_channel("bayer", c("bx") + c("i"), "y").alias("channel"), "code")
    one = lambda k: F.max(F.when(c("channel") == k, c("code")))
    m = of.groupBy("frame_id").agg(one("R").alias("r"), one("Gr").alias("gr"), one("Gb").alias("gb"), one("B").alias("b")).withColumn("g", F.expr("(gr + gb) DIV 2"))
    gain = lambda v: F.when((c(v) <= 64) | (c("g") <= 64), 1.0).otherwise((c("g") - 64) / (c(v) - 64))
    return rounded(m.select("frame_id", gain("r").alias("gain_r"), gain("b").alias("gain_b")), "gain_r", "gain_b")


@query("""WITH v AS (SELECT vec_id, embedding, list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: isfinite(x)) AS f FROM embeddings)
SELECT vec_id, list_min(f) + 0 AS min, list_max(f) + 0 AS max, (len(embedding) - len(f))::BIGINT AS non_finite FROM v""")
def a18_sample_range(spark, d):
    """Range of each row's finite samples; negative zero counts as zero."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("v"))
    finite = F.filter("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    e = e.withColumn("f", finite)
    return e.select("vec_id", F.array_min("f").alias("min"), F.array_max("f").alias("max"), (F.size("v") - F.size("f")).cast("long").alias("non_finite"))


@query(f"WITH {SCENE} SELECT frame_id, round(sum(code*16)::DOUBLE/count(*), 6) AS mean16 FROM px GROUP BY frame_id")
def a19_reference_mean(spark, d):
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, v: s + v)
    per = src.rows(spark, d).groupBy("frame_id").agg((F.sum(total) * (1 << 16 - src.DEPTH) / F.sum(F.size("codes"))).alias("mean16"))
    return rounded(per, "mean16")


@query(f"WITH {DEFECT_SQL} SELECT frame_id, count(*) FILTER (type='hot')::BIGINT AS hot, count(*) FILTER (type='dead')::BIGINT AS dead FROM d GROUP BY frame_id")
def a21_defect_counts(spark, d):
    found = flat_defects(spark, d)
    return found.groupBy("frame_id").agg(F.count_if(c("type") == "hot").alias("hot"), F.count_if(c("type") == "dead").alias("dead"))


@query(f"WITH {SCENE}, r AS (SELECT frame_id, y, count(*) AS n, sum(code)::BIGINT AS total, max(code) AS top FROM px GROUP BY frame_id, y) SELECT frame_id, y, (2*n)::BIGINT AS n_bytes, total, top FROM r")
def k01_s01_raw_round_trip(spark, d):
    """Rows to high-aligned big-endian bytes and back."""
    data = raw.encode_rows(src.rows(spark, d), src.DEPTH, high_aligned=True, big_endian=True)
    back = raw.decode_rows(data, src.DEPTH, high_aligned=True, big_endian=True)
    return back.select("frame_id", "y", (2 * F.size("codes")).cast("long").alias("n_bytes"), F.aggregate("codes", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_max("codes").alias("top"))
