"""Colour queries over the derived frames, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import colour, transform
from ..sources import frames as src
from .fleet import SCENE, _separable_sql, _wide, pattern_of, query, rounded, scene

RGB = "rgb AS (SELECT frame_id, y, x, height, code AS r, (code*3+7)%4096 AS g, (code*5+11)%4096 AS b FROM px)"


def rgb_pixels(spark, d, height: bool = False):
    return src.pixels(spark, d, height=height).select("frame_id", "y", "x", c("code").alias("r"), ((c("code") * 3 + 7) % 4096).alias("g"), ((c("code") * 5 + 11) % 4096).alias("b"), *["height"][:height])


def rgb_rows(spark, d):
    """frame_id, y, r, g, b: one array of codes for each component of an image row, a batch at once."""

    def run(batches):
        for batch in batches:
            codes = batch.column(2)
            v = codes.flatten()  # codes are 0 to 4095
            shade = lambda k, o: pa.ListArray.from_arrays(ends, pc.bit_wise_and(pc.add(pc.multiply(v, k), o), 4095).cast(pa.int32()))
            ends = pa.array(np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, shade(3, 7), shade(5, 11)], names=["frame_id", "y", "r", "g", "b"])

    return src.rows(spark, d).mapInArrow(run, "frame_id long, y int, r array<int>, g array<int>, b array<int>")


def wide_rgb(df):
    return transform.wide(df, "r", "g", "b")


@query(f"""WITH {SCENE}, nb AS (SELECT p.frame_id, p.y, p.x, p.code, p.channel, CASE q.channel WHEN 'R' THEN 'R' WHEN 'B' THEN 'B' ELSE 'G' END AS hue, q.code AS v
  FROM px p JOIN px q ON q.frame_id = p.frame_id AND q.y BETWEEN p.y-1 AND p.y+1 AND q.x BETWEEN p.x-1 AND p.x+1 AND (q.y <> p.y OR q.x <> p.x)),
m AS (SELECT frame_id, y, x, max(code) AS code, max(channel) AS channel, sum(v) FILTER (hue='R') // count(*) FILTER (hue='R') AS r, sum(v) FILTER (hue='G') // count(*) FILTER (hue='G') AS g, sum(v) FILTER (hue='B') // count(*) FILTER (hue='B') AS b FROM nb GROUP BY ALL)
SELECT frame_id, y, x, (CASE WHEN channel='R' THEN code ELSE coalesce(r, code) END)::INT AS r, (CASE WHEN channel IN ('Gr','Gb') THEN code ELSE coalesce(g, code) END)::INT AS g, (CASE WHEN channel='B' THEN code ELSE coalesce(b, code) END)::INT AS b FROM m""")
def n09_demosaic(spark, d):
    return wide_rgb(colour.demosaic(src.rows(spark, d), pattern_of()))


@query(f"WITH {SCENE}, t AS (SELECT frame_id, y//2 AS y, x//2 AS x, max(code) FILTER (channel='R') AS r, (max(code) FILTER (channel='Gr') + max(code) FILTER (channel='Gb'))//2 AS g, max(code) FILTER (channel='B') AS b, count(*) AS n FROM px GROUP BY ALL) SELECT frame_id, y::INT AS y, x::INT AS x, r, g::INT AS g, b FROM t WHERE n = 4")
def x07_block_rgb(spark, d):
    return colour.block_rgb(scene(spark, d)).withColumns({k: c(k).cast("int") for k in ("y", "x")})


@query(f"""WITH {SCENE}, {RGB} SELECT frame_id, y, x, least(4095, greatest(0, round_even(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b, 0)))::INT AS luma,
 least(4095, greatest(0, round_even(-0.168736::DOUBLE*r+-0.331264::DOUBLE*g+0.5::DOUBLE*b+2048::DOUBLE, 0)))::INT AS cb, least(4095, greatest(0, round_even(0.5::DOUBLE*r+-0.418688::DOUBLE*g+-0.081312::DOUBLE*b+2048::DOUBLE, 0)))::INT AS cr,
 least(4095, greatest(0, round_even(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b, 0)))::INT*16 AS luminance FROM rgb""")
def x02_x03_luminance(spark, d):
    return rgb_pixels(spark, d).select("frame_id", "y", "x", *colour.ycbcr("r", "g", "b", 4095), colour.luminance("r", "g", "b", src.DEPTH).alias("luminance"))


@query(f"WITH {SCENE}, {RGB}, t AS (SELECT frame_id, y, count(*) AS n FROM rgb GROUP BY ALL) SELECT rgb.frame_id, rgb.y, rgb.x, r, g, b FROM rgb")
def s12_interleaved(spark, d):
    """Interleaved rows r, g, b, r, g, b ... apart again."""
    return wide_rgb(colour.apart(colour.interleaved(rgb_rows(spark, d)), src.WIDTH))


def _develop_sql(v: str, wb: float) -> str:
    return f"round_even(pow(least(1, greatest(0, ((({v})*16 - 1024::DOUBLE) * {1.0 / (61440 - 1024)!r}::DOUBLE * {wb * 1.25!r}::DOUBLE - 0.5::DOUBLE) * 1.1::DOUBLE + 0.5::DOUBLE)), {1 / 2.2!r}::DOUBLE) * 255, 0)::INT"


WB = (1.8, 1.0, 1.5)


@query(f"WITH {SCENE}, {RGB} SELECT frame_id, y, x, {_develop_sql('r', 1.8)} AS r8, {_develop_sql('g', 1.0)} AS g8, {_develop_sql('b', 1.5)} AS b8 FROM rgb")
def x05_develop(spark, d):
    return rgb_pixels(spark, d).select("frame_id", "y", "x", *[colour.develop(c(k) * 16, 1024, 61440, w, 1.25, 1.1).alias(k + "8") for k, w in zip("rgb", WB, strict=True)])


MATRIX = [1.6, -0.4, -0.2, -0.3, 1.5, -0.2, 0.1, -0.6, 1.5]


def _matrix_sql() -> str:
    import numpy as np

    f = lambda v: f"{float(np.float32(v))!r}::FLOAT"
    lin = ", ".join(f"(({k}*16 - 1024::DOUBLE) * {1.0 / (61440 - 1024)!r}::DOUBLE * {w * 0.5!r}::DOUBLE)::FLOAT AS l{k}" for k, w in zip("rgb", WB, strict=True))
    ceiling = f(min(1.0, *(w * 0.5 for w in WB)))
    clamped = ", ".join(f"CASE WHEN burnt THEN CASE WHEN l{k} > 0 THEN least(l{k}, {ceiling}) ELSE 0::FLOAT END ELSE l{k} END AS c{k}" for k in "rgb")
    m = [f(v * 1.1) for v in MATRIX]
    rows = ", ".join(f"((({m[3 * i]} * cr)::FLOAT + ({m[3 * i + 1]} * cg)::FLOAT)::FLOAT + ({m[3 * i + 2]} * cb)::FLOAT)::FLOAT + {f(0.5 - 0.55)} AS v{k}" for i, k in enumerate("rgb"))
    step = lambda k: f"floor((least(1, greatest(0, v{k}))::FLOAT * 65535::FLOAT)::FLOAT + 0.5::FLOAT)"
    out = ", ".join(f"round_even(pow({step(k)}::DOUBLE / 65535::DOUBLE, {1 / 2.2!r}::DOUBLE) * 255, 0)::INT AS {k}8" for k in "rgb")
    return f"l AS (SELECT frame_id, y, x, greatest(r, g, b)*16 >= 61440 AS burnt, {lin} FROM rgb), k AS (SELECT frame_id, y, x, {clamped} FROM l), v AS (SELECT frame_id, y, x, {rows} FROM k) SELECT frame_id, y, x, {out} FROM v"


@query(f"WITH {SCENE}, {RGB}, {_matrix_sql()}")
def x06_develop_with_matrix(spark, d):
    px = rgb_pixels(spark, d)
    return px.select("frame_id", "y", "x", *colour.develop_with_matrix(*[c(k) * 16 for k in "rgb"], MATRIX, 1024, 61440, WB, 0.5, 1.1, depth=src.DEPTH))


@query(f"""WITH {SCENE}, {RGB}, t AS (SELECT frame_id, (y//3)::INT AS y, (x//3)::INT AS x, sum(r*16) AS r, sum(g*16) AS g, sum(b*16) AS b FROM rgb WHERE x < 63 AND y < height//3*3 GROUP BY ALL)
SELECT frame_id, y, x, {', '.join(f"least(65535, floor({k}*{65535.0 / (4095 << 4) / 9!r}::DOUBLE + 0.5))::INT AS {k}" for k in 'rgb')} FROM t""")
def a16_binning_rgb(spark, d):
    return colour.binned_rgb(rgb_pixels(spark, d, height=True), 3, src.WIDTH, "height", src.DEPTH)


def _extreme_sql(k: str) -> str:
    return f"least(65535, floor(max({k}) OVER w * {65535.0 / (4095 << 4) * 16!r}::DOUBLE + 0.5))::INT"


@query(f"""WITH {SCENE}, {RGB}, a AS (SELECT frame_id, y, x, {', '.join(f'max({k}) OVER v AS {k}' for k in 'rgb')} FROM rgb WINDOW v AS (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT frame_id, y, x, {', '.join(f'{_extreme_sql(k)} AS {k}' for k in 'rgb')} FROM a WINDOW w AS (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def n08_rgb_maximum(spark, d):
    return wide_rgb(transform.extreme(rgb_rows(spark, d), 1, src.DEPTH, 1, True, ("r", "g", "b")))


def _unsharp_sql() -> str:
    smooth = _separable_sql(transform.gaussian_weights(2, 1.2)).rsplit("\nSELECT", 1)[0]
    v = "(p.code*16)::DOUBLE"
    return f"{smooth} SELECT oo.frame_id, oo.y, oo.x, greatest(0, least(65535, floor(({v} + 1.5::DOUBLE*({v} - oo.v))*{65535.0 / (4095 << 4)!r}::DOUBLE + 0.5::DOUBLE)))::INT AS v16 FROM oo JOIN px p ON p.frame_id=oo.frame_id AND p.y=oo.y AND p.x=oo.x"


@query(f"WITH {SCENE}, {_unsharp_sql()}")
def n03_unsharp_mask(spark, d):
    return _wide(transform.unsharp_mask(src.rows(spark, d), transform.gaussian_weights(2, 1.2), 1.5, src.DEPTH, 2))


@query(f"""WITH {SCENE}, z AS (SELECT frame_id, height, x, code, (y//2)%3 AS stage, (y//6)*2 + y%2 - ((y//2)%3) AS sy, y FROM px),
q AS (SELECT frame_id, sy AS y, x, max(code) FILTER (stage=0) AS a, max(code) FILTER (stage=1) AS b, max(code) FILTER (stage=2) AS e FROM z WHERE sy >= 0 AND sy < height//6*2 - 2 AND y < height//6*6 GROUP BY ALL)
SELECT frame_id, y::INT AS y, x, a, b, e FROM q""")
def u01_three_exposures_with_offset(spark, d):
    """Three stages in blocks of two rows, each one row later than the one before: the codes of the sensor rows that all have."""
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", "height"), "frame_id")
    split = transform.split_exposures(rows, 3, 2, "height", offset=1)
    met = split.groupBy("frame_id", "y").agg(*[F.max(F.when(c("stage") == k, c("codes"))).alias(n) for k, n in enumerate("abe")])
    return met.select("frame_id", "y", F.posexplode(F.arrays_zip("a", "b", "e")).alias("x", "v")).select("frame_id", "y", "x", "v.a", "v.b", "v.e")


def _merge3_sql() -> str:
    import numpy as np

    f = lambda v: f"{float(np.float32(v))!r}::FLOAT"
    steps, linear, last = [], 64496.0, "j"
    for k, n in ((1, "b"), (2, "e")):
        full = linear * 8.0 ** (k - 1)
        t1 = 0.9 * full
        t0 = t1 - 0.1 * full
        steps.append(f"w{k} AS (SELECT *, ((m - {f(t0)})::FLOAT / {f(t1 - t0)})::FLOAT AS t, ({n} * {f(8.0**k)})::FLOAT AS s FROM {last})")
        steps.append(f"j{k} AS (SELECT frame_id, y, x, b, e, CASE WHEN m <= {f(t0)} THEN m WHEN m >= {f(t1)} THEN s ELSE (m + ((s - m)::FLOAT * ((t*t)::FLOAT * (3::FLOAT - (2::FLOAT*t)::FLOAT)::FLOAT)::FLOAT)::FLOAT)::FLOAT END AS m FROM w{k})")
        last = f"j{k}"
    return f"j AS (SELECT frame_id, y, x, ((a*16)::FLOAT - 1024::FLOAT)::FLOAT AS m, ((b*16)::FLOAT - 1024::FLOAT)::FLOAT AS b, ((e*16)::FLOAT - 1024::FLOAT)::FLOAT AS e FROM q), " + ", ".join(steps) + f" SELECT frame_id, y::INT AS y, x, greatest(0, least(65535, round_even(greatest(m::DOUBLE, 0)*{65535.0 / (64496.0 * 64)!r}::DOUBLE, 0)))::INT AS v16 FROM {last}"


@query(f"""WITH {SCENE}, z AS (SELECT frame_id, height, x, code, y%3 AS stage, y//3 AS sy FROM px WHERE y < height//3*3),
q AS (SELECT frame_id, sy AS y, x, max(code) FILTER (stage=0) AS a, max(code) FILTER (stage=1) AS b, max(code) FILTER (stage=2) AS e FROM z GROUP BY ALL), {_merge3_sql()}""")
def j12_three_exposure_merge(spark, d):
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", "height"), "frame_id")
    merged = transform.merge_exposures(transform.split_exposures(rows, 3, 1, "height"), 8.0, 1024.0, src.DEPTH, stages=3)
    return _wide(transform.quantized(merged, 64496.0 * 64))


@query(f"""WITH {SCENE}, z AS (SELECT frame_id, ((y//2)%2)*64 + x AS x, (y//4)*2 + y%2 AS y, code FROM px WHERE y < height//4*4) SELECT frame_id, y::INT AS y, x::INT AS x, code FROM z""")
def u05_side_by_side(spark, d):
    rows = src.rows(spark, d).join(src.frames(spark, d).select("frame_id", "height"), "frame_id")
    return transform.side_by_side(transform.split_exposures(rows, 2, 2, "height")).select("frame_id", "y", F.posexplode("codes").alias("x", "code"))


@query("SELECT doc_id, step, CASE WHEN step > lsb THEN round(log2(step / lsb), 6) ELSE 0 END AS lost_bits FROM (SELECT doc_id, (n_chars * 1000.0::DOUBLE) / 65535.0::DOUBLE AS step, CASE doc_id % 3 WHEN 0 THEN 256 WHEN 1 THEN 16 ELSE 1 END::DOUBLE AS lsb FROM documents)")
def x20_quantization(spark, d):
    """Step of 16-bit values over a float full scale, and the bits that it costs against the source's own step."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (c("n_chars") * 1000.0).alias("full"), F.when(c("doc_id") % 3 == 0, 8).when(c("doc_id") % 3 == 1, 12).otherwise(16).alias("depth"))
    step, lost = transform.quantization(c("full"), c("depth"))
    return rounded(t.select("doc_id", step.alias("step"), lost.alias("lost_bits")), "lost_bits")


@query(f"""WITH {SCENE}, h AS (SELECT frame_id, channel, (code*64)//4096 AS col, count(*) AS n FROM px GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY frame_id) AS top FROM h)
SELECT frame_id, channel, col::INT AS col, round(n::DOUBLE / (4096/64), 6) AS per_bin, round(ln(1+n)/ln(1+top), 6) AS height FROM m""")
def a25_x25_histogram_plot(spark, d):
    """Display columns per bin of the histogram, and their heights on a log scale against the highest of all channels."""
    from pyspark.sql import Window

    h = scene(spark, d).groupBy("frame_id", "channel", F.expr("code * 64 DIV 4096").cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy("frame_id"))
    return rounded(h.select("frame_id", "channel", "col", (c("n") / (4096 / 64)).alias("per_bin"), (F.log1p(c("n").cast("double")) / F.log1p(top.cast("double"))).alias("height")), "per_bin", "height")
