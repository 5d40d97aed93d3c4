"""Projection targets, readouts of several panes, thresholds by segment, fits of formats, float rows and filters of colour frames, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import candidates, transform
from ..operators import regions as reg
from ..sources import frames as src
from ..sources import raw
from .colour import RGB, rgb_rows
from .fleet import FLAT, MOM, SCENE, VAR, query, rounded
from .regions import RESOLVED, regions_of


@query(f"""WITH {SCENE}, {RESOLVED}, e AS (SELECT rr.*, rs.tx, rs.ty, d AS direction, rr.frame_id % 3 = 0 AS mixed FROM rr JOIN rs USING (frame_id, roi_id), (VALUES ('horizontal'), ('vertical')) t(d)),
f AS (SELECT *, CASE WHEN direction = 'horizontal' AND mixed THEN 'exposures in rows' WHEN x IS NOT NULL THEN reason WHEN tiled THEN 'no region in quadrants' WHEN segment > 0 AND direction = 'vertical' AND 64 > segment THEN 'exposures side by side' END AS refusal FROM e),
g AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN 'refused' ELSE kind END AS target FROM f)
SELECT frame_id, roi_id, direction, target, refusal, (CASE WHEN target IN ('rectangle','lattice') THEN CASE direction WHEN 'horizontal' THEN cx ELSE cy END WHEN target = 'whole' THEN 0 END)::INT AS axis_start,
 (CASE WHEN target = 'lattice' THEN CASE direction WHEN 'horizontal' THEN tx ELSE ty END END)::INT AS axis_source FROM g""")
def f19_projection_targets(spark, d):
    """Every region of every frame in both directions: what is projected, where its axis begins, and why it may not be."""
    rois = regions_of(spark, d).withColumns({"direction": F.explode(F.array(F.lit("horizontal"), F.lit("vertical"))), "mixed": c("frame_id") % 3 == 0})
    return reg.projection_targets(rois).select("frame_id", "roi_id", "direction", "target", "refusal", "axis_start", "axis_source")


@query(f"""WITH {SCENE}, p AS (SELECT frame_id//5 AS view_id, (frame_id%5)::INT AS pane, frame_id, CASE WHEN frame_id%7=0 THEN 10 ELSE 12 END AS depth, (frame_id//5*13%80)::INT AS x, (frame_id//5*7%60)::INT AS y FROM (SELECT DISTINCT frame_id FROM px) WHERE frame_id%5 < 1 + frame_id//5%4),
j AS (SELECT p.*, code FROM p LEFT JOIN px USING (frame_id, y, x))
SELECT view_id, x, y, {', '.join(f'max(code) FILTER (pane={i}) AS code{i}' for i in range(4))}, CASE WHEN count(*) = 2 AND max(depth) FILTER (pane=0) = max(depth) FILTER (pane=1) THEN max(code) FILTER (pane=1) - max(code) FILTER (pane=0) END AS delta FROM j GROUP BY ALL""")
def j13_four_panes(spark, d):
    """Views of one to four frames."""
    p = src.frames(spark, d).select(F.expr("frame_id DIV 5").alias("view_id"), (c("frame_id") % 5).cast("int").alias("pane"), "frame_id", F.when(c("frame_id") % 7 == 0, 10).otherwise(12).alias("bit_depth"))
    p = p.filter(c("pane") < 1 + c("view_id") % 4).withColumns({"x": (c("view_id") * 13 % 80).cast("int"), "y": (c("view_id") * 7 % 60).cast("int")})
    return reg.readouts(p, src.rows(spark, d))


@query(f"""WITH {FLAT}, s AS (SELECT frame_id, x//24 AS part, (y%2*2 + x%24%2)::INT AS phase, code FROM px), m AS (SELECT frame_id, part, phase, {MOM} FROM s GROUP BY ALL)
SELECT frame_id, part::INT AS part, phase, round(s::DOUBLE/n, 6) AS mean, round(sqrt({VAR}), 6) AS sigma, round(s::DOUBLE/n + 6*sqrt({VAR}), 6) AS high, round(s::DOUBLE/n - 6*sqrt({VAR}), 6) AS low FROM m""")
def a20_segment_thresholds(spark, d):
    """Bounds by side-by-side segment of 24 columns and phase; the last segment is narrower."""
    limits = transform.phase_limits(src.rows(spark, d, "flat"), 6.0, 24).select("frame_id", F.explode("limits").alias("t")).select("frame_id", "t.*")
    found = limits.select("frame_id", F.expr("at DIV 4").alias("part"), (c("at") % 4).alias("phase"), "mean", "sigma", (c("mean") + 6 * c("sigma")).alias("high"), (c("mean") - 6 * c("sigma")).alias("low"))
    return rounded(found.withColumn("part", c("part").cast("int")), "mean", "sigma", "high", "low")


_FIT = """f AS (SELECT doc_id, (doc_id%9*4)::BIGINT AS width, (doc_id%7*2 - 2)::BIGINT AS height, CASE WHEN doc_id%3=0 THEN 8 ELSE 12 END AS bit_depth, (doc_id%4*8)::BIGINT AS header, (doc_id%3+1)::INT AS frames FROM documents),
g AS (SELECT *, width*height*(CASE WHEN bit_depth <= 8 THEN 1 ELSE 2 END) AS unit FROM f), h AS (SELECT *, header + unit*frames + CASE doc_id%5 WHEN 0 THEN 0 WHEN 1 THEN unit WHEN 2 THEN 7 WHEN 3 THEN -1 ELSE 0 END AS length FROM g)"""


@query(f"""WITH {_FIT} SELECT doc_id, width > 0 AND height > 0 AND header + unit*frames = length AS exact, width > 0 AND height > 0 AND header + unit*frames <= length AS opens, CASE WHEN unit > 0 AND length > header AND (length-header) % unit = 0 THEN (length-header)//unit END AS count FROM h""")
def x23_fits(spark, d):
    """Whether a file is just a format's frames, can be opened with it, and how many of its frames fill it."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    t = t.withColumns({"width": c("doc_id") % 9 * 4, "height": c("doc_id") % 7 * 2 - 2, "bit_depth": F.when(c("doc_id") % 3 == 0, 8).otherwise(12), "header": c("doc_id") % 4 * 8, "frames": (c("doc_id") % 3 + 1).cast("int")})
    t = t.withColumns({k: F.lit(v) for k, v in candidates.DEFAULTS.items() if k not in t.columns})
    t = t.withColumn("unit", c("width") * c("height") * F.when(c("bit_depth") <= 8, 1).otherwise(2))
    length = c("header") + c("unit") * c("frames") + F.when(c("doc_id") % 5 == 1, c("unit")).when(c("doc_id") % 5 == 2, 7).when(c("doc_id") % 5 == 3, -1).otherwise(0)
    return t.withColumn("length", length).select("doc_id", candidates.fits_exactly("length").alias("exact"), candidates.can_open("length").alias("opens"), candidates.fit_count("length", c("header"), c("unit")).alias("count"))


_BITS = "CASE WHEN v = 0 THEN 0 ELSE (126 + length(ltrim(bin(v), '0'))) * 8388608 + ((v::BIGINT << (24 - length(ltrim(bin(v), '0')))) - 8388608) END"


@query(f"WITH {SCENE}, b AS (SELECT frame_id, y, x, ({_BITS})::BIGINT AS b FROM (SELECT frame_id, y, x, code*16 AS v FROM px)) SELECT frame_id, y, sha256(unhex(string_agg(printf('%02x%02x%02x%02x', b%256, b//256%256, b//65536%256, b//16777216), '' ORDER BY x))) AS sha256, true AS back FROM b GROUP BY ALL")
def k02_float_rows(spark, d):
    """16-bit values as real samples of 32 bits, and whether the bytes give them back."""
    rows = src.rows(spark, d).select("frame_id", "y", F.transform("codes", lambda v: (v * 16).cast("float")).alias("given"))
    data = raw.encode_floats(rows, "given", "given").withColumn("sha256", F.sha2("data", 256))
    return raw.decode_floats(data, "sha256", "given").select("frame_id", "y", "sha256", (c("values") == c("given")).alias("back"))


_SCALE, _FULL = f"{65535.0 / (4095 << 4) * 16!r}::DOUBLE", f"{65535.0 / (4095 << 4)!r}::DOUBLE"
_TOP = lambda v: f"greatest(0, least(65535, floor({v} + 0.5::DOUBLE)))"


def _weighted(weights: list[float], k: str) -> str:
    """A weighted mean along x and then along y, edges repeated."""
    r = len(weights) // 2
    at = lambda name, i, w: name if not i else "coalesce(" + ", ".join([f"{'lag' if i < 0 else 'lead'}({name}, {j}) OVER {w}" for j in range(abs(i), 0, -1)] + [name]) + ")"
    across = " + ".join(f"{at('v', i, 'wx')}*{weights[i + r]!r}::DOUBLE" for i in range(-r, r + 1))
    down = " + ".join(f"{at('v', i, 'wy')}*{weights[i + r]!r}::DOUBLE" for i in range(-r, r + 1))
    return f"(SELECT frame_id, y, x, c, {down} AS v FROM (SELECT frame_id, y, x, ({k}*16)::DOUBLE AS c, {across} AS v FROM (SELECT *, ({k}*16)::DOUBLE AS v FROM rgb) WINDOW wx AS (PARTITION BY frame_id, y ORDER BY x)) WINDOW wy AS (PARTITION BY frame_id, x ORDER BY y))"


def _component(k: str) -> str:
    near = f"(SELECT p.frame_id, p.y, p.x, dy, dx, q.{k} AS v FROM rgb p, range(-1,2) a(dy), range(-1,2) b(dx) JOIN rgb q ON q.frame_id = p.frame_id AND q.y = greatest(0, least(p.y + dy, p.height - 1)) AND q.x = greatest(0, least(p.x + dx, 63)))"
    box, bell = transform.box_weights(1), transform.gaussian_weights(2, 1.2)
    parts = [
        f"SELECT 'mean' AS filter, frame_id, y, x, {_TOP(f'v*{_FULL}')} AS v FROM {_weighted(box, k)}", f"SELECT 'gaussian', frame_id, y, x, {_TOP(f'v*{_FULL}')} FROM {_weighted(bell, k)}",
        f"SELECT 'unsharp', frame_id, y, x, {_TOP(f'(c + 1.5::DOUBLE*(c - v))*{_FULL}')} FROM {_weighted(bell, k)}",
        f"SELECT unnest(['minimum', 'median', 'sobel']), frame_id, y, x, unnest([{_TOP(f'min(v)*{_SCALE}')}, {_TOP(f'median(v)*{_SCALE}')}, {_TOP(f'sqrt((sum(v*dx*(2-abs(dy)))*sum(v*dx*(2-abs(dy))) + sum(v*dy*(2-abs(dx)))*sum(v*dy*(2-abs(dx))))::DOUBLE)/4*{_SCALE}')}]) FROM {near} GROUP BY frame_id, y, x",
    ]
    return f"SELECT filter, frame_id, y, '{k}' AS component, sum(v*(x+1))::BIGINT AS checked FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


#: Frames that a call filters: 64 have 200,000 pixels.
TOGETHER = 64


@query(f"WITH {SCENE}, {RGB} " + " UNION ALL ".join(map(_component, "rgb")))
def n08_rgb_filters(spark, d):
    """Six filters of each component; a sum over each row that tells where its values stand."""
    box, bell, rgb = transform.box_weights(1), transform.gaussian_weights(2, 1.2), ("r", "g", "b")
    filters = {
        "mean": transform.separable_filter(box, src.DEPTH, 1), "gaussian": transform.separable_filter(bell, src.DEPTH, 1), "unsharp": transform.unsharp_filter(bell, 1.5, src.DEPTH, 1),
        "minimum": transform.extreme_filter(1, src.DEPTH, 1, False), "median": transform.median_of(1, src.DEPTH, 1), "sobel": transform.sobel_filter(src.DEPTH, 1),
    }

    checked = lambda v: (v * np.arange(1, v.shape[1] + 1)).sum(1)
    folded = transform.stencils(rgb_rows(spark, d), filters, 1, rgb, together=TOGETHER, fold=checked)
    return folded.unpivot(["filter", "frame_id", "y"], list(rgb), "component", "checked")
