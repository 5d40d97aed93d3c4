"""Queries over the derived pixel frames, the file catalogue and the event stream, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..functions.semantics import c
from ..operators import catalog, measure, transform
from ..operators.ranking import placed
from ..sources import frames as src
from ..streaming import qc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP = (1 << src.DEPTH) - 1


def _px(kind: str) -> str:
    return f"""px0 AS (SELECT (o_orderkey//48)::BIGINT AS frame_id, (o_orderkey%48)::INT AS y, x::INT AS x, ({src.CODES[kind]})::INT AS code FROM orders, range(0,64) r(x)),
px AS (SELECT *, (['Rggb','Bggr','Grbg','Gbrg'])[frame_id % 4 + 1] AS bayer,
  CASE frame_id % 4 WHEN 0 THEN (['R','Gr','Gb','B'])[k] WHEN 1 THEN (['B','Gb','Gr','R'])[k] WHEN 2 THEN (['Gr','R','B','Gb'])[k] ELSE (['Gb','B','R','Gr'])[k] END AS channel,
  height FROM (SELECT *, y % 2 * 2 + x % 2 + 1 AS k, (max(y) OVER (PARTITION BY frame_id) + 1)::INT AS height FROM px0))"""


SCENE, FLAT = _px("scene"), _px("flat")
VAR = "((n::DECIMAL(38,0) * s2::DECIMAL(38,0) - s::DECIMAL(38,0) * s::DECIMAL(38,0))::DOUBLE / n / n)"
MOM = "count(*)::BIGINT AS n, sum(code)::BIGINT AS s, sum(code::BIGINT * code)::BIGINT AS s2"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def scene(spark, d):
    return src.pixels(spark, d, "scene")


def flat(spark, d):
    return src.pixels(spark, d, "flat")


def pattern_of(frame: str = "frame_id"):
    return F.element_at(F.array(*map(F.lit, src.BAYER)), (c(frame) % 4 + 1).cast("int"))


def flat_defects(spark, d):
    return transform.defects(src.rows(spark, d, "flat"), pattern_of(), 6.0)


def scene_with_height(spark, d):
    return src.pixels(spark, d, "scene", height=True)


def with_height(px: DataFrame, frames: DataFrame) -> DataFrame:
    return px.join(frames.select("frame_id", "height"), "frame_id")


METRIC_SQL = f"""h AS (SELECT frame_id, channel, code, count(*) AS n FROM px GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, channel ORDER BY code) AS cum, sum(n) OVER (PARTITION BY frame_id, channel) AS total FROM h),
m AS (SELECT frame_id, channel, max(total)::BIGINT AS n, sum(code*n)::BIGINT AS s, sum(code::BIGINT*code*n)::BIGINT AS s2,
  min(code) FILTER (cum > floor(0.5*(total-1)+0.5)) AS median, min(code) FILTER (cum > floor(0.01*(total-1)+0.5)) AS p1, min(code) FILTER (cum > floor(0.99*(total-1)+0.5)) AS p99,
  arg_max(code, n*10000 - code) AS mode, coalesce(sum(n) FILTER (code = {TOP}), 0) AS hot, coalesce(sum(n) FILTER (code = 0), 0) AS zeros FROM r GROUP BY frame_id, channel)
SELECT frame_id, channel, n AS count, round(s::DOUBLE/n, 6) AS mean, round(sqrt({VAR}), 6) AS sigma, median, p1, p99, mode, round(100.0::DOUBLE*hot/n, 6) AS saturated_pct, round(100.0::DOUBLE*zeros/n, 6) AS zero_pct,
  round(CASE WHEN {VAR} > 0 THEN 20*log10({TOP}/sqrt({VAR})) ELSE 0 END, 6) AS dr_db FROM m"""


@query(f"WITH {SCENE}, {METRIC_SQL}")
def a03_w01_channel_metrics(spark, d):
    hist = measure.histogram(scene(spark, d), "frame_id", "channel")
    return rounded(measure.histogram_metrics(hist, ["frame_id", "channel"], src.DEPTH), "mean", "sigma", "saturated_pct", "zero_pct", "dr_db")


@query(f"WITH {SCENE}, t AS (SELECT frame_id, channel, code, count(*)::BIGINT AS n FROM px GROUP BY ALL) SELECT * FROM t UNION ALL SELECT frame_id, NULL, code, sum(n)::BIGINT FROM t GROUP BY frame_id, code")
def a03_channel_histogram(spark, d):
    return measure.pixel_histogram(scene(spark, d))


PAIR_SQL = f"""p AS (SELECT a.frame_id // 2 AS pair_id, a.channel, a.code AS a, b.code AS b FROM px a JOIN px b ON b.frame_id = a.frame_id + 1 AND a.y = b.y AND a.x = b.x WHERE a.frame_id % 2 = 0),
m AS (SELECT pair_id, channel, count(*) AS n, sum(a)::BIGINT AS s, sum(a::BIGINT*a)::BIGINT AS s2, sum(a-b)::BIGINT AS ds, sum((a-b)::BIGINT*(a-b))::BIGINT AS ds2 FROM p GROUP BY ALL),
v AS (SELECT *, {VAR} AS v, {VAR.replace('s2', 'DS2').replace('s::', 'ds::').replace('DS2', 'ds2')} AS dv FROM m),
e AS (SELECT pair_id, sum(n)::BIGINT AS n, sum(s)::DOUBLE/sum(n) AS mean, sqrt(sum(n*v)/sum(n)) AS st, sqrt(sum(n*dv)/sum(n)/2) AS tt FROM v GROUP BY pair_id)
SELECT pair_id, n, round(mean, 6) AS mean, round(st, 6) AS sigma_total, round(tt, 6) AS sigma_temporal, round(sqrt(greatest(0, st*st-tt*tt)), 6) AS sigma_fpn,
 round(CASE WHEN st > 0 THEN 20*log10({TOP}/st) END, 6) AS dr_total_db, round(CASE WHEN tt > 0 THEN 20*log10({TOP}/tt) END, 6) AS dr_temporal_db FROM e"""


@query(f"WITH {SCENE}, {PAIR_SQL}")
def a07_noise_pair(spark, d):
    """Temporal and fixed-pattern noise of every A/B pair: rows meet by (frame, y) and become two records of sums each."""
    rows = src.rows(spark, d)
    even = rows.filter("frame_id % 2 = 0").select(F.expr("frame_id DIV 2").alias("pair_id"), "y", c("codes").alias("a"))
    odd = rows.filter("frame_id % 2 = 1").select(F.expr("frame_id DIV 2").alias("pair_id"), "y", c("codes").alias("b"))
    parts = measure.pair_moments(even.join(odd, ["pair_id", "y"]), "pair_id")
    pattern = pattern_of(c("pair_id") * 2)
    noise = measure.pair_noise(parts.withColumn("channel", sem.cfa_channel(pattern, "parity", "y")), ["pair_id"], TOP)
    return rounded(noise, "mean", "sigma_total", "sigma_temporal", "sigma_fpn", "dr_total_db", "dr_temporal_db")


@query(f"""WITH {SCENE}, m AS (SELECT frame_id, channel, {MOM} FROM px GROUP BY ALL), e AS (SELECT frame_id, sum(n)::BIGINT AS n, sum(s)::DOUBLE/sum(n) AS mean, sqrt(sum(n*{VAR})/sum(n)) AS st FROM m GROUP BY frame_id)
SELECT frame_id, n, round(mean,6) AS mean, round(st,6) AS sigma_total, round(20*log10({TOP}/st),6) AS dr_total_db, round(log2({TOP}/st),6) AS dr_total_stops FROM e""")
def a06_noise_single(spark, d):
    return rounded(measure.noise_single(scene(spark, d), TOP), "mean", "sigma_total", "dr_total_db", "dr_total_stops")


@query(f"WITH {SCENE}, m AS (SELECT frame_id, {MOM} FROM px WHERE x >= 3 AND x < 61 AND y >= 5 AND (x-3)%2=0 AND (y-5)%2=0 GROUP BY frame_id) SELECT frame_id, n, round(s::DOUBLE/n,6) AS mean, round(sqrt({VAR}),6) AS sigma FROM m")
def a08_lattice_noise(spark, d):
    px = scene(spark, d).filter("x >= 3 AND x < 61 AND y >= 5 AND (x - 3) % 2 = 0 AND (y - 5) % 2 = 0")
    out = px.groupBy("frame_id").agg(*measure.moments())
    return rounded(out.select("frame_id", "n", (c("s") / c("n")).alias("mean"), F.sqrt(sem.pop_variance("n", "s", "s2")).alias("sigma")), "mean", "sigma")


ROI_SQL = "q AS (SELECT DISTINCT frame_id, height FROM px), b AS (SELECT * FROM (VALUES (0,0,0,64,48),(1,5,7,21,13),(2,60,40,30,30),(3,70,2,8,8)) t(roi_id,x0,y0,w,h)), z AS (SELECT * FROM q, b)"


@query(f"""WITH {SCENE}, {ROI_SQL}, m AS (SELECT z.frame_id, roi_id, {MOM}, min(code) AS lo, max(code) AS hi FROM z JOIN px ON px.frame_id = z.frame_id AND px.x >= x0 AND px.x < x0+w AND px.y >= y0 AND px.y < y0+h GROUP BY ALL)
SELECT z.frame_id, z.roi_id, coalesce(n,0)::BIGINT AS n, coalesce(round(s::DOUBLE/n,6),0) AS mean, coalesce(round(sqrt({VAR}),6),0) AS sigma, coalesce(lo,0) AS min, coalesce(hi,0) AS max FROM z LEFT JOIN m USING (frame_id, roi_id)""")
def a01_region_statistics(spark, d):
    return rounded(measure.region_statistics(scene(spark, d), src.regions(src.frames(spark, d))), "mean", "sigma")


@query(f"WITH {SCENE} SELECT frame_id, 'horizontal' AS axis, x AS position, round(avg(code),6) AS mean, min(code) AS min, max(code) AS max FROM px GROUP BY frame_id, x UNION ALL SELECT frame_id, 'vertical', y, round(avg(code),6), min(code), max(code) FROM px GROUP BY frame_id, y")
def a11_projections(spark, d):
    return rounded(measure.projections(scene(spark, d)), "mean")


@query(f"WITH {SCENE} SELECT frame_id, y AS position, round(avg(code),6) AS mean, min(code) AS min, max(code) AS max FROM px GROUP BY frame_id, y")
def a10_vertical_projection(spark, d):
    return rounded(measure.vertical_projection(src.rows(spark, d)), "mean")


@query(f"WITH {SCENE} SELECT frame_id, (x-1)//2 AS position, round(avg(code),6) AS mean, min(code) AS min, max(code) AS max FROM px WHERE x >= 1 AND (x-1)%2=0 AND y%2=0 GROUP BY frame_id, (x-1)//2")
def a12_lattice_projection(spark, d):
    px = scene(spark, d).filter("x >= 1 AND (x - 1) % 2 = 0 AND y % 2 = 0").withColumn("x", F.expr("(x - 1) DIV 2").cast("int"))
    return rounded(px.groupBy("frame_id", c("x").alias("position")).agg(F.avg("code").alias("mean"), F.min("code").alias("min"), F.max("code").alias("max")), "mean")


@query(f"WITH {SCENE}, h AS (SELECT frame_id, code, count(*)::BIGINT AS n FROM px GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY frame_id ORDER BY code))::BIGINT AS cumulative FROM h")
def w04_cumulative_histogram(spark, d):
    return measure.cumulative(measure.histogram(scene(spark, d), "frame_id"), "frame_id")


@query(f"""WITH {SCENE}, h AS (SELECT frame_id, code, count(*) AS n FROM px GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY code) AS up, sum(n) OVER (PARTITION BY frame_id ORDER BY code DESC) AS down, floor(sum(n) OVER (PARTITION BY frame_id)*0.0035::DOUBLE) AS cut FROM h),
l AS (SELECT frame_id, min(code) FILTER (up > cut) AS black, max(code) FILTER (down > cut) AS white FROM w GROUP BY frame_id) SELECT frame_id, CASE WHEN white > black THEN black END AS black, CASE WHEN white > black THEN white END AS white FROM l""")
def w03_auto_levels(spark, d):
    return measure.auto_levels(measure.histogram(scene(spark, d), "frame_id"), ["frame_id"])


@query(f"WITH {SCENE}, h AS (SELECT frame_id, (code*256)//4096 AS col, count(*)::BIGINT AS n FROM px GROUP BY ALL) SELECT *, (sum(n) OVER (PARTITION BY frame_id ORDER BY col))::BIGINT AS cumulative FROM h")
def a22_display_columns(spark, d):
    return measure.display_columns(measure.histogram(scene(spark, d), "frame_id"), ["frame_id"], 256, 4096)


@query(f"""WITH {SCENE}, h AS (SELECT channel, code, count(*)::BIGINT AS n FROM px GROUP BY ALL), a AS (SELECT c.code, k.channel FROM range(0,4096) c(code), (SELECT DISTINCT channel FROM px) k)
SELECT a.code::INT AS raw_code, a.channel, coalesce(n,0)::BIGINT AS count, (sum(coalesce(n,0)) OVER (PARTITION BY a.channel ORDER BY a.code))::BIGINT AS cumulative FROM a LEFT JOIN h USING (code, channel)""")
def k03_histogram_table(spark, d):
    """All 4096 codes by channel over the fleet, absent ones as 0."""
    hist = measure.histogram(scene(spark, d), "channel")
    full = spark.range(1 << src.DEPTH).select(c("id").cast("int").alias("code"), F.explode(F.array(*map(F.lit, ("R", "Gr", "Gb", "B")))).alias("channel"))
    return measure.cumulative(full.join(hist, ["code", "channel"], "left").select("code", "channel", F.coalesce("n", F.lit(0)).alias("n")), "channel").select(c("code").alias("raw_code"), "channel", c("n").alias("count"), "cumulative")


@query(f"""WITH {SCENE} SELECT frame_id, x, count(*)::BIGINT AS n, round(avg(code),6) AS mean, min(code) AS min, max(code) AS max, median(code)::DOUBLE AS median, round(stddev_pop(code),6) AS sigma FROM px GROUP BY frame_id, x""")
def a24_profile_statistics(spark, d):
    """The profile of every column of every frame."""
    return rounded(measure.profile_statistics(scene(spark, d).select("frame_id", "x", c("code").alias("v")), ["frame_id", "x"], "v"), "mean", "sigma")


@query(f"""WITH {SCENE} SELECT frame_id, y, count(*)::BIGINT AS n, round(avg(code),6) AS mean, min(code) AS min, max(code) AS max, median(code)::DOUBLE AS median, round(stddev_pop(code),6) AS sigma FROM px GROUP BY frame_id, y""")
def a24_profile_statistics_rows(spark, d):
    """The profile of every row of every frame."""
    return rounded(measure.profile_statistics(scene(spark, d).select("frame_id", "y", c("code").alias("v")), ["frame_id", "y"], "v"), "mean", "sigma")


@query(f"""WITH {SCENE}, b AS (SELECT frame_id, y//2 AS by, x//2 AS bx, count(*) AS k, max(code) FILTER (channel='R') AS r, (max(code) FILTER (channel='Gr') + max(code) FILTER (channel='Gb'))//2 AS g, max(code) FILTER (channel='B') AS bl FROM px GROUP BY ALL),
m AS (SELECT frame_id, avg(r) AS r, avg(g) AS g, avg(bl) AS b FROM b WHERE k = 4 GROUP BY frame_id) SELECT frame_id, round(CASE WHEN r <= 64 OR g <= 64 THEN 1 ELSE (g-64)/(r-64) END,6) AS gain_r, round(CASE WHEN b <= 64 OR g <= 64 THEN 1 ELSE (g-64)/(b-64) END,6) AS gain_b FROM m""")
def a13_gray_world(spark, d):
    return rounded(measure.gray_world(scene(spark, d), 64), "gain_r", "gain_b")


@query(f"WITH {SCENE} SELECT frame_id, count(*) FILTER (code >= ceil(0.98::DOUBLE*{TOP}))::BIGINT AS saturated, count(*) FILTER (code <= floor(0.02::DOUBLE*{TOP}))::BIGINT AS crushed FROM px GROUP BY frame_id")
def f16_zebra(spark, d):
    high, low = -(-98 * TOP // 100), 2 * TOP // 100
    return scene(spark, d).groupBy("frame_id").agg(F.count_if(c("code") >= high).alias("saturated"), F.count_if(c("code") <= low).alias("crushed"))


@query(f"WITH {SCENE} SELECT frame_id, bayer, channel, count(*)::BIGINT AS n, sum(code)::BIGINT AS total FROM px GROUP BY ALL")
def f03_channels(spark, d):
    return scene(spark, d).groupBy("frame_id", "bayer", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("total"))


@query(f"WITH {SCENE} SELECT frame_id, y, (x%2)*32 + x//2 AS tx, (y%2)*(height//2) + y//2 AS ty, code FROM px WHERE y < height//2*2")
def f10_channel_tiling(spark, d):
    """Every pixel in the tile of its channel; only an odd last row goes."""
    px = scene_with_height(spark, d).filter("y < height DIV 2 * 2")
    return px.select("frame_id", "y", F.expr("CAST((x % 2) * 32 + x DIV 2 AS INT)").alias("tx"), F.expr("CAST((y % 2) * (height DIV 2) + y DIV 2 AS INT)").alias("ty"), "code")


@query(f"""WITH {SCENE}, t AS (SELECT frame_id, height, x AS tx, y AS ty, x//32 AS qx, y//(height//2) AS qy FROM px WHERE y < height//2*2)
SELECT t.frame_id, tx, ty, (tx - qx*32)*2 + qx AS x, ((ty - qy*(height//2))*2 + qy)::INT AS y FROM t""")
def f10_channel_tiling_whole(spark, d):
    """The way back: where every pixel of the tiled frame comes from."""
    t = scene_with_height(spark, d).filter("y < height DIV 2 * 2").select("frame_id", c("x").alias("tx"), c("y").alias("ty"), F.expr("height DIV 2").alias("qh"))
    back = lambda at, quad: F.expr(f"CAST(({at} - ({at} DIV {quad}) * {quad}) * 2 + {at} DIV {quad} AS INT)")
    return t.select("frame_id", "tx", "ty", back("tx", "32").alias("x"), back("ty", "qh").alias("y"))


@query(f"WITH {SCENE} SELECT frame_id, y, x, code FROM px WHERE x % 7 = 0 AND y % 5 = 0")
def f13_systematic_sample(spark, d):
    return src.explode_rows(src.rows(spark, d).filter("y % 5 = 0")).filter("x % 7 = 0").select("frame_id", "y", "x", "code")


@query(f"WITH {SCENE} SELECT frame_id, y, x, code FROM px WHERE y BETWEEN 8 AND 15 AND x BETWEEN 10 AND 19")
def s05_region_read(spark, d):
    rows = src.rows(spark, d).filter("y BETWEEN 8 AND 15")
    return rows.select("frame_id", "y", F.posexplode(F.slice("codes", 11, 10)).alias("x", "code")).select("frame_id", "y", (c("x") + 10).alias("x"), "code")


@query("WITH o AS (SELECT o_orderkey, (o_orderkey*37 % 65536)::INT AS v, (o_orderkey % 2 = 0) AS lsb FROM orders) SELECT o_orderkey, (CASE WHEN lsb THEN (v & 4095) << 4 ELSE v & 65520 END)::INT AS code16, (((v & 255) << 8) + (v >> 8))::INT AS swapped FROM o")
def s02_normalize(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (c("o_orderkey") * 37 % 65536).cast("int").alias("v"))
    lsb = F.shiftleft(c("v").bitwiseAND(4095), 4)
    return o.select("o_orderkey", F.when(c("o_orderkey") % 2 == 0, lsb).otherwise(c("v").bitwiseAND(65520)).alias("code16"), (F.shiftleft(c("v").bitwiseAND(255), 8) + F.shiftright("v", 8)).alias("swapped"))


@query("""WITH r AS (SELECT min(x::DOUBLE) AS lo, max(x::DOUBLE) AS hi FROM (SELECT unnest(embedding) AS x FROM embeddings) WHERE isfinite(x)),
v AS (SELECT vec_id, generate_subscripts(embedding,1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, (i-1)::INT AS x, CASE WHEN isfinite(v.x) THEN round_even((v.x - least(lo,0)) / (CASE WHEN hi <= 1 THEN 1 ELSE hi END - least(lo,0)) * 65535, 0)::INT ELSE 0 END AS code16 FROM v, r""")
def s07_wide_samples(spark, d):
    """Float rows to 16-bit codes by the table's own finite range."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "f")).withColumn("v", c("f").cast("double"))
    finite = ~F.isnan("v") & (F.abs("v") != float("inf"))
    r = e.filter(finite).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    low, up = F.least("lo", F.lit(0.0)), F.when(c("hi") <= 1, 1.0).otherwise(c("hi"))
    code = F.when(finite, F.rint((c("v") - low) / (up - low) * 65535)).otherwise(0).cast("int")
    return e.join(F.broadcast(r)).select("vec_id", "x", code.alias("code16"))


@query(f"""WITH {FLAT}, m AS (SELECT frame_id, channel, {MOM} FROM px GROUP BY ALL), t AS (SELECT *, s::DOUBLE/n AS mean, sqrt({VAR}) AS sigma FROM m)
SELECT px.frame_id, y, x, code, px.channel, CASE WHEN code > mean+6*sigma THEN 'hot' ELSE 'dead' END AS type, round((code-mean)/sigma,6) AS deviation FROM px JOIN t USING (frame_id, channel) WHERE code > mean+6*sigma OR code < mean-6*sigma""")
def j06_defects(spark, d):
    return rounded(flat_defects(spark, d), "deviation")


DEFECT_SQL = f"""{FLAT}, m AS (SELECT frame_id, channel, {MOM} FROM px GROUP BY ALL), t AS (SELECT *, s::DOUBLE/n AS mean, sqrt({VAR}) AS sigma FROM m),
d AS (SELECT px.frame_id, y, x, code, CASE WHEN code > mean+6*sigma THEN 'hot' ELSE 'dead' END AS type FROM px JOIN t USING (frame_id, channel) WHERE code > mean+6*sigma OR code < mean-6*sigma)"""


@query(f"WITH {DEFECT_SQL} SELECT frame_id, y, x, code, type, truncated FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) AS r, count(*) OVER (PARTITION BY frame_id) > 1 AS truncated FROM d) WHERE r <= 1")
def o03_capped_defects(spark, d):
    return transform.capped(flat_defects(spark, d), 1).select("frame_id", "y", "x", "code", "type", "truncated")


@query(f"WITH {DEFECT_SQL} SELECT frame_id, y, x, code, type, truncated FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) AS r, count(*) OVER (PARTITION BY frame_id) > 100000 AS truncated FROM d) WHERE r <= 100000")
def o03_capped_defects_default(spark, d):
    """The cap as the reference has it by default, 100000 a frame."""
    return transform.capped(flat_defects(spark, d), 100_000).select("frame_id", "y", "x", "code", "type", "truncated")


@query(f"""WITH {DEFECT_SQL}, o AS (SELECT dy, dx, greatest(abs(dy),abs(dx)) AS r FROM range(-3,4) a(dy), range(-3,4) b(dx) WHERE dy<>0 OR dx<>0),
g AS (SELECT d.frame_id, d.y, d.x, o.r, px.code AS v FROM d, o JOIN px ON px.frame_id=d.frame_id AND px.y=d.y+2*dy AND px.x=d.x+2*dx WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.frame_id=px.frame_id AND e.y=px.y AND e.x=px.x)),
k AS (SELECT *, count(*) OVER (PARTITION BY frame_id,y,x ORDER BY r) AS known FROM g), s AS (SELECT frame_id,y,x,coalesce(min(r) FILTER (known>=2),3) AS stop FROM k GROUP BY ALL),
u AS (SELECT g.frame_id,g.y,g.x,floor(median(v)+0.5)::INT AS value,count(*)::BIGINT AS m FROM g JOIN s USING (frame_id,y,x) WHERE r<=stop GROUP BY ALL)
SELECT d.*, coalesce(value,code) AS corrected, coalesce(m,0)::BIGINT AS neighbours FROM d LEFT JOIN u USING (frame_id,y,x)""")
def n11_defect_correction(spark, d):
    return transform.corrected(transform.marked(src.rows(spark, d, "flat"), 6.0), 2)


ARITH_SQL = "p AS (SELECT a.frame_id//2 AS pair_id, a.y, a.x, a.code AS a, b.code AS b FROM px a JOIN px b ON b.frame_id=a.frame_id+1 AND a.y=b.y AND a.x=b.x WHERE a.frame_id%2=0)"


@query(f"WITH {SCENE}, {ARITH_SQL} SELECT pair_id, y, sum(greatest(a-b,0))::BIGINT AS subtracted, sum(abs(a-b))::BIGINT AS difference FROM p GROUP BY ALL")
def j02_j03_frame_arithmetic(spark, d):
    rows = src.rows(spark, d)
    pairs = src.frames(spark, d).filter("frame_id % 2 = 0").select(F.expr("frame_id DIV 2").alias("pair_id"), c("frame_id").alias("frame_a"), (c("frame_id") + 1).alias("frame_b"))
    both = measure.frame_pairs(rows, pairs)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return both.select("pair_id", "y", total(transform.subtract(c("a"), c("b"))).alias("subtracted"), total(transform.absolute_difference(c("a"), c("b"))).alias("difference"))


@query(f"""WITH {SCENE}, {ARITH_SQL}, m AS (SELECT pair_id, sum(b*16)::DOUBLE/count(*) AS mean FROM p GROUP BY pair_id)
SELECT pair_id, y, x, greatest(0, least(4095, floor(a*16.0::DOUBLE*mean/greatest(1.0::DOUBLE, b*16.0::DOUBLE)/16.0::DOUBLE + 0.5::DOUBLE)))::INT AS code FROM p JOIN m USING (pair_id)""")
def j04_flat_field(spark, d):
    rows = src.rows(spark, d)
    pairs = src.frames(spark, d).filter("frame_id % 2 = 0").select(F.expr("frame_id DIV 2").alias("pair_id"), c("frame_id").alias("frame_a"), (c("frame_id") + 1).alias("frame_b"))
    px = measure.frame_pairs(rows, pairs).select("pair_id", "y", F.posexplode(F.arrays_zip("a", "b")).alias("x", "v")).select("pair_id", "y", "x", "v.a", "v.b")
    mean = px.groupBy("pair_id").agg((F.sum(c("b") * 16) / F.count(F.lit(1))).alias("mean"))
    return transform.flat_field(px.join(mean, "pair_id"), "mean", src.DEPTH).select("pair_id", "y", "x", "code")


@query(f"WITH {SCENE}, b AS (SELECT frame_id, ((y//4)*2 + y%2)::INT AS y2, ((x//4)*2 + x%2)::INT AS x2, sum(code*16) AS s FROM px WHERE y < height//4*4 GROUP BY ALL) SELECT frame_id, y2 AS y, x2 AS x, greatest(0, least(65535, floor(s*({sem.full_scale_factor(12)!r}::DOUBLE/4) + 0.5::DOUBLE)))::INT AS v16 FROM b")
def a15_binning(spark, d):
    px = scene_with_height(spark, d)
    return transform.binned(px, 2, src.WIDTH, "height", src.DEPTH)


PYR = "l1 AS (SELECT frame_id, y//2 AS y, x//2 AS x, sum(code) AS s, count(*) AS n FROM px GROUP BY ALL), l2 AS (SELECT frame_id, y//2 AS y, x//2 AS x, sum(s) AS s, sum(n) AS n FROM l1 GROUP BY ALL), l3 AS (SELECT frame_id, y//2 AS y, x//2 AS x, sum(s) AS s, sum(n) AS n FROM l2 GROUP BY ALL)"


@query(f"WITH {SCENE}, {PYR} SELECT frame_id, 2 AS level, y, x, (s//n)::INT AS code FROM l1 UNION ALL SELECT frame_id, 4, y, x, (s//n)::INT FROM l2 UNION ALL SELECT frame_id, 8, y, x, (s//n)::INT FROM l3")
def a17_pyramid(spark, d):
    return transform.pyramid(src.rows(spark, d), 3).select("frame_id", "level", "y", F.posexplode("codes").alias("x", "code"))


@query(f"""WITH {SCENE}, b1 AS (SELECT frame_id, (y//4)*2+y%2 AS y, (x//4)*2+x%2 AS x, sum(code)//4 AS code, max(height)//4*2 AS h FROM px WHERE y < height//4*4 GROUP BY frame_id, (y//4)*2+y%2, (x//4)*2+x%2),
b2 AS (SELECT frame_id, (y//4)*2+y%2 AS y, (x//4)*2+x%2 AS x, sum(code)//4 AS code FROM b1 WHERE y < h//4*4 GROUP BY frame_id, (y//4)*2+y%2, (x//4)*2+x%2)
SELECT frame_id, 2 AS level, y::INT AS y, x::INT AS x, code::INT AS code FROM b1 UNION ALL SELECT frame_id, 4, y::INT, x::INT, code::INT FROM b2""")
def a26_bayer_pyramid(spark, d):
    found = transform.bayer_pyramid(with_height(src.rows(spark, d), src.frames(spark, d)), "height", 2)
    return found.select("frame_id", "level", "y", F.posexplode("codes").alias("x", "code"))


def _neighbour(k_y: int, k_x: int) -> str:
    return f"p.frame_id=px.frame_id AND p.y = px.y%2 + greatest(0, least(px.y//2 + {k_y}, (px.height-1-px.y%2)//2))*2 AND p.x = px.x%2 + greatest(0, least(px.x//2 + {k_x}, (63-px.x%2)//2))*2"


STENCIL = "n AS (SELECT px.frame_id, px.y, px.x, dy, dx, p.code FROM px, range(-1,2) a(dy), range(-1,2) b(dx) JOIN px p ON " + _neighbour("dy", "dx") + ")"
FULL16 = f"{sem.full_scale_factor(12) * 16!r}::DOUBLE"


def _wide(rows: DataFrame) -> DataFrame:
    return rows.select("frame_id", "y", F.posexplode("codes").alias("x", "v16"))


@query(f"WITH {SCENE}, {STENCIL} SELECT frame_id, y, x, greatest(0, least(65535, floor(min(code)*{FULL16} + 0.5::DOUBLE)))::INT AS v16 FROM n GROUP BY frame_id, y, x")
def n04_minimum(spark, d):
    return _wide(transform.extreme(src.rows(spark, d), 1, src.DEPTH, 2, False))


@query(f"WITH {SCENE}, {STENCIL} SELECT frame_id, y, x, greatest(0, least(65535, floor(max(code)*{FULL16} + 0.5::DOUBLE)))::INT AS v16 FROM n GROUP BY frame_id, y, x")
def n05_maximum(spark, d):
    return _wide(transform.extreme(src.rows(spark, d), 1, src.DEPTH, 2, True))


@query(f"WITH {SCENE}, {STENCIL} SELECT frame_id, y, x, greatest(0, least(65535, floor(median(code)*{FULL16} + 0.5::DOUBLE)))::INT AS v16 FROM n GROUP BY frame_id, y, x")
def n06_median(spark, d):
    return _wide(transform.median_filter(src.rows(spark, d), 1, src.DEPTH, 2))


@query(f"""WITH {SCENE}, {STENCIL}, g AS (SELECT frame_id, y, x, sum(code*dx*(2-abs(dy))) AS gx, sum(code*dy*(2-abs(dx))) AS gy FROM n GROUP BY frame_id, y, x)
SELECT frame_id, y, x, greatest(0, least(65535, floor(sqrt((gx*gx+gy*gy)::DOUBLE)/4*{FULL16} + 0.5::DOUBLE)))::INT AS v16 FROM g""")
def n07_sobel(spark, d):
    return _wide(transform.sobel(src.rows(spark, d), src.DEPTH, 2))


def _separable_sql(weights: list[float]) -> str:
    r = len(weights) // 2
    h = " + ".join(f"c{k}*{w!r}::DOUBLE" for k, w in enumerate(weights))
    cols = ", ".join(f"(codes[x%2 + greatest(0, least(x//2 + {k}, (63-x%2)//2))*2 + 1]*16)::DOUBLE AS c{k + r}" for k in range(-r, r + 1))
    v = " + ".join(f"(vals[(y%2 + greatest(0, least(y//2 + {k}, (height-1-y%2)//2))*2 + 1)::BIGINT])*{weights[k + r]!r}::DOUBLE" for k in range(-r, r + 1))
    return f"""rr AS (SELECT frame_id, y, any_value(height) AS height, list(code ORDER BY x) AS codes FROM px GROUP BY frame_id, y),
hh AS (SELECT frame_id, y, x, height, {h} AS v FROM (SELECT frame_id, y, x, height, {cols} FROM rr, range(0,64) t(x))),
cc AS (SELECT frame_id, x, any_value(height) AS height, list(v ORDER BY y) AS vals FROM hh GROUP BY frame_id, x),
oo AS (SELECT frame_id, y::INT AS y, x::INT AS x, {v} AS v FROM (SELECT *, unnest(range(0, height)) AS y FROM cc))
SELECT frame_id, y, x, greatest(0, least(65535, floor(v*{sem.full_scale_factor(12)!r}::DOUBLE + 0.5::DOUBLE)))::INT AS v16 FROM oo"""


@query(f"WITH {SCENE}, {_separable_sql(transform.box_weights(1))}")
def n01_box_mean(spark, d):
    return _wide(transform.separable(src.rows(spark, d), transform.box_weights(1), src.DEPTH, 2))


@query(f"WITH {SCENE}, {_separable_sql(transform.gaussian_weights(2, 1.2))}")
def n02_gaussian(spark, d):
    return _wide(transform.separable(src.rows(spark, d), transform.gaussian_weights(2, 1.2), src.DEPTH, 2))


SPLIT = "z AS (SELECT frame_id, ((y//2)%2) AS stage, (y//4)*2+y%2 AS sy, x, code, height FROM px), sp AS (SELECT * FROM z WHERE sy < height//4*2)"


@query(f"WITH {SCENE}, {SPLIT} SELECT frame_id, stage::INT AS stage, sy::INT AS y, x, code FROM sp")
def u01_exposure_split(spark, d):
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", "height"), "frame_id")
    out = transform.split_exposures(rows, 2, 2, "height")
    return out.select("frame_id", "stage", "y", F.posexplode("codes").alias("x", "code"))


@query(f"""WITH {SCENE}, {SPLIT}, q AS (SELECT frame_id, sy AS y, x, max(code) FILTER (stage = 0) AS a, max(code) FILTER (stage = 1) AS b FROM sp GROUP BY ALL),
j AS (SELECT frame_id, y, x, ((a*16)::FLOAT - 1024::FLOAT)::FLOAT AS l, (((b*16)::FLOAT - 1024::FLOAT) * 16::FLOAT)::FLOAT AS s FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT *, ((l - {0.9 * 64496.0 - 0.1 * 64496.0!r}::FLOAT) / {0.9 * 64496.0 - (0.9 * 64496.0 - 0.1 * 64496.0)!r}::FLOAT)::FLOAT AS t FROM j),
m AS (SELECT *, CASE WHEN l <= {0.9 * 64496.0 - 0.1 * 64496.0!r}::FLOAT THEN l WHEN l >= {0.9 * 64496.0!r}::FLOAT THEN s ELSE (l + (s-l)*((t*t)::FLOAT*(3::FLOAT-2::FLOAT*t))::FLOAT)::FLOAT END AS v FROM t)
SELECT frame_id, y::INT AS y, x, greatest(0, least(65535, round_even(greatest(v::DOUBLE, 0)*{65535.0 / (64496.0 * 16)!r}::DOUBLE, 0)))::INT AS v16 FROM m""")
def j12_exposure_merge(spark, d):
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", "height"), "frame_id")
    merged = transform.merge_exposures(transform.split_exposures(rows, 2, 2, "height"), 16.0, 1024.0, src.DEPTH)
    return _wide(transform.quantized(merged, 64496.0 * 16))


@query(f"WITH {SCENE} SELECT frame_id, y, x, round_even(pow(greatest(0, least(1, (code-100.0::DOUBLE)/2900.0::DOUBLE*1.5::DOUBLE)), {1 / 2.2!r}::DOUBLE)*255, 0)::INT AS gray FROM px")
def x04_display_transfer(spark, d):
    return scene(spark, d).select("frame_id", "y", "x", transform.display_transfer(c("code"), 100, 3000, gain=1.5).alias("gray"))


@query("SELECT doc_id, least(65535, round_even(0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b, 0))::INT AS luma FROM (SELECT doc_id, n_chars*7%65536 AS r, n_chars*13%65536 AS g, doc_id*101%65536 AS b FROM documents)")
def x01_luma(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (c("n_chars") * 7 % 65536).alias("r"), (c("n_chars") * 13 % 65536).alias("g"), (c("doc_id") * 101 % 65536).alias("b"))
    return t.select("doc_id", sem.luma("r", "g", "b").alias("luma"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """The file catalogue: folders are sources, names hold numbers and dimensions, lengths follow the documents."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    name = F.concat(F.when(c("doc_id") % 3 == 0, "img").when(c("doc_id") % 3 == 1, "Dark_64x48_").otherwise("flat"), c("doc_id").cast("string"), F.when(c("doc_id") % 2 == 0, ".raw").otherwise(".bin"))
    return t.select(c("source").alias("folder"), name.alias("name"), F.when(c("doc_id") % 2 == 0, ".raw").otherwise(".bin").alias("ext"), F.when(c("doc_id") % 3 == 1, c("doc_id") % 4 * 3072 + 3072).otherwise(c("n_chars")).alias("length"), F.concat_ws("/", "source", name).alias("path"), "doc_id")


FILES = """f AS (SELECT source AS folder, (CASE doc_id%3 WHEN 0 THEN 'img' WHEN 1 THEN 'Dark_64x48_' ELSE 'flat' END) || doc_id || (CASE WHEN doc_id%2=0 THEN '.raw' ELSE '.bin' END) AS name,
 CASE WHEN doc_id%2=0 THEN '.raw' ELSE '.bin' END AS ext, CASE WHEN doc_id%3=1 THEN doc_id%4*3072+3072 ELSE n_chars END AS length, doc_id, doc_id%3 AS k FROM documents)"""


@query(f"""WITH {FILES} SELECT folder, name, ext, (row_number() OVER (PARTITION BY folder, ext, k ORDER BY doc_id) - 1)::INT AS index, count(*) OVER (PARTITION BY folder, ext, k)::BIGINT AS stack_size FROM f""")
def u07_numbered_stacks(spark, d):
    return catalog.numbered_stacks(files(spark, d)).select("folder", "name", "ext", "index", "stack_size")


@query(f"WITH {FILES} SELECT folder, ext, length, count(*)::BIGINT AS files, arg_min(name, [CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, doc_id]) AS first_name FROM f GROUP BY ALL")
def u06_same_size_stacks(spark, d):
    return catalog.same_size_stacks(files(spark, d))


@query(f"WITH {FILES} SELECT folder, name FROM f WHERE (k = 1 AND ext = '.raw') OR name LIKE '%7%'")
def f14_name_filter(spark, d):
    return files(spark, d).filter(catalog.name_filter("dark*.raw; 7")).select("folder", "name")


@query(f"WITH {FILES} SELECT folder, name, (row_number() OVER (PARTITION BY folder ORDER BY CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, doc_id))::INT AS place FROM f")
def o01_natural_order(spark, d):
    each = placed(files(spark, d), ["folder"], [catalog.natural_key(c("name"))], "place")
    return each.select("folder", "name", (c("place") + 1).cast("int").alias("place"))


@query(f"""WITH {FILES}, o AS (SELECT * FROM f, (VALUES (1,1),(1,2),(1,4),(2,1),(2,2),(2,4)) t(bytes, frames) WHERE length % (bytes*frames) = 0), dm AS (SELECT * FROM (VALUES (64,48),(48,64),(32,48),(96,64)) t(width,height)),
cand AS (SELECT folder||'/'||name AS path, width, height, bytes, frames, 2 AS priority FROM o JOIN dm ON length // (bytes*frames) = width*height UNION ALL SELECT folder||'/'||name, 64, 48, bytes, frames, 1 FROM o WHERE k = 1 AND length // (bytes*frames) = 3072),
u AS (SELECT path, width, height, bytes, frames, min(priority) AS priority FROM cand GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY priority, frames, bytes, width DESC, height DESC))::INT AS rank FROM u) WHERE rank <= 10""")
def j08_format_candidates(spark, d):
    dims = spark.sql("SELECT * FROM VALUES (64,48),(48,64),(32,48),(96,64) AS t(width, height)")
    return catalog.format_candidates(files(spark, d), dims)


@query(f"WITH {FILES}, e AS (SELECT length, ext, k AS format, max(doc_id) AS used FROM f GROUP BY ALL) SELECT * FROM e ORDER BY used DESC, length, ext, format LIMIT 200")
def w05_history_recency(spark, d):
    return catalog.history_recency(files(spark, d).select("length", "ext", (c("doc_id") % 3).alias("format"), c("doc_id").alias("used")))


@query("""WITH v AS (SELECT doc_id, doc_id%7*10-10 AS width, doc_id%5*16 AS height, doc_id%6*2+6 AS depth, n_chars AS length FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN width<=0 THEN 'width' END, CASE WHEN height<=0 THEN 'height' END, CASE WHEN depth NOT IN (8,10,12,14,16) THEN 'depth' END, CASE WHEN width*height*(CASE WHEN depth<=8 THEN 1 ELSE 2 END) > length THEN 'short' END) AS reasons FROM v""")
def s03_validation(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (c("doc_id") % 7 * 10 - 10).alias("width"), (c("doc_id") % 5 * 16).alias("height"), (c("doc_id") % 6 * 2 + 6).alias("depth"), c("n_chars").alias("length"))
    return t.select("doc_id", F.array_join(catalog.validation_reasons("width", "height", "depth", "length"), ",").alias("reasons"))


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, value, round_even(value*1000,0)::BIGINT AS v FROM events), m AS (SELECT w, event_type, count(*) AS n, sum(v)::BIGINT AS s, sum(v*v)::BIGINT AS s2, max(value) AS max FROM e GROUP BY ALL)
SELECT w::VARCHAR AS window_start, event_type, n, round(s::DOUBLE/n/1000,6) AS mean, round(sqrt((n::DECIMAL(38,0)*s2::DECIMAL(38,0)-s::DECIMAL(38,0)*s::DECIMAL(38,0))::DOUBLE/n/n)/1000,6) AS sigma, max FROM m""")
def t03_drift(spark, d):
    out = qc.drift(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", c("ts").cast("timestamp_ntz")))
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), "mean", "sigma")


@query("SELECT user_id, event_id, round(value - p, 6) AS difference FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL")
def t02_consecutive_difference(spark, d):
    return rounded(qc.consecutive_difference(spark.read.parquet(f"{d}/events.parquet")), "difference")


@query(f"WITH {SCENE}, m AS (SELECT frame_id, {MOM}, min(code) AS min, max(code) AS max, count(*) FILTER (code = 4095)::BIGINT AS saturated FROM px GROUP BY frame_id) SELECT frame_id, n, round(s::DOUBLE/n,6) AS mean, round(sqrt({VAR}),6) AS sigma, min, max, saturated FROM m")
def t01_frame_qc(spark, d):
    return rounded(qc.frame_qc(src.rows(spark, d)), "mean", "sigma")
