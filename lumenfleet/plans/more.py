"""Sampling by each frame's format, ranks of defects, means of defects' neighbours and lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import provenance, sampling, transform
from ..sources import frames as src
from .fleet import DEFECT_SQL, ORACLES, SCENE, flat_defects, query, rounded

MOST = 40
_WAY = "CASE WHEN hdr <> 'Auto' THEN hdr WHEN frames = stages THEN 'FrameSequential' WHEN frames = 1 THEN 'LineInterleaved' ELSE 'LineInterleaved' END"
_NEXT = lambda s: f"CASE WHEN {s} = 1 THEN 1 ELSE list_filter(range({s}, {s} + 65), lambda v: gcd(v, even) = 1)[1] END"


@query(f"""WITH {SCENE}, f AS (SELECT frame_id, 64 AS w, max(y)::BIGINT + 1 AS h, 30 + frame_id % 7 * 150 AS most, (['None','Auto','LineInterleaved','FrameSequential'])[frame_id % 4 + 1] AS hdr, frame_id % 3 + 1 AS frames, 2 + frame_id % 2 AS stages, frame_id % 4 AS line_block FROM px GROUP BY frame_id),
s AS (SELECT *, greatest(1, ceil(sqrt((w*h)::DOUBLE/most))::BIGINT) AS s FROM f), n AS (SELECT *, (w+s-1)//s < 16 AS nw, (h+s-1)//s < 16 AS nh FROM s),
a AS (SELECT *, CASE WHEN s <= 1 OR nw = nh THEN s WHEN nw THEN 1 ELSE least(s*s, w) END AS cs, CASE WHEN s <= 1 OR nw = nh THEN s WHEN nw THEN least(s*s, h) ELSE 1 END AS rs,
 CASE WHEN hdr = 'None' OR {_WAY} <> 'LineInterleaved' THEN 1 ELSE stages*(CASE WHEN line_block > 0 THEN line_block ELSE 2 END) END AS period FROM n),
e AS (SELECT *, CASE WHEN period % 2 = 0 THEN period ELSE period*2 END AS even FROM a), t AS (SELECT frame_id, ({_NEXT('cs')})::BIGINT AS column_stride, ({_NEXT('rs')})::BIGINT AS row_stride FROM e)
SELECT frame_id, column_stride, row_stride, y, x, code FROM px JOIN t USING (frame_id) WHERE y % row_stride = 0 AND x % column_stride = 0""")
def f13_strides_by_format(spark, d):
    """Samples whose strides follow each frame's size, exposures and bound."""
    pick = F.element_at(F.array(*map(F.lit, ("None", "Auto", "LineInterleaved", "FrameSequential"))), (c("frame_id") % 4 + 1).cast("int"))
    f = src.frames(spark, d).select("frame_id", "width", "height", pick.alias("hdr"), (c("frame_id") % 3 + 1).alias("frames"), (c("frame_id") % 2 + 2).alias("stages"), (c("frame_id") % 4).alias("line_block"), (c("frame_id") % 7 * 150 + 30).alias("most"))
    column, row = sampling.sampling_strides("width", "height", c("most"), "hdr", "frames", "stages", "line_block")
    strides = f.select("frame_id", column.alias("column_stride"), row.alias("row_stride"))
    rows = src.rows(spark, d).join(strides, "frame_id")
    return sampling.sampled(rows, "column_stride", "row_stride", "column_stride", "row_stride").select("frame_id", "column_stride", "row_stride", "y", "x", "code")


_DEVIATION = f"{DEFECT_SQL}, v AS (SELECT d.*, CASE WHEN sigma > 0 THEN (d.code - mean)/sigma END AS deviation FROM d JOIN px USING (frame_id, y, x) JOIN t ON t.frame_id = px.frame_id AND t.channel = px.channel)"


@query(f"WITH {_DEVIATION} SELECT frame_id, rank, y, x, code, type, round(deviation, 6) AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY abs(deviation) DESC NULLS LAST, y, x)::INT AS rank FROM v) WHERE rank <= {MOST}")
def o06_deviations_by_frame(spark, d):
    """The defects of each frame that deviate most."""
    found = transform.ranked_by_deviation(flat_defects(spark, d), MOST, "frame_id")
    return rounded(found.select("frame_id", "rank", "y", "x", "code", "type", "deviation"), "deviation")


@query(f"WITH {_DEVIATION} SELECT frame_id, rank, y, x, code, type, round(deviation, 6) AS deviation FROM (SELECT *, row_number() OVER (ORDER BY abs(deviation) DESC NULLS LAST, frame_id, y, x)::INT AS rank FROM v) WHERE rank <= 1000")
def o06_deviations_of_fleet(spark, d):
    """The thousand defects of all frames that deviate most."""
    found = transform.ranked_by_deviation(flat_defects(spark, d), 1000)
    return rounded(found.select("frame_id", "rank", "y", "x", "code", "type", "deviation"), "deviation")


@query(ORACLES["n11_defect_correction"].replace("median(", "avg("))
def n11_defect_mean(spark, d):
    """Defects with the mean of their neighbours."""
    return transform.corrected(transform.marked(src.rows(spark, d, "flat"), 6.0), 2, mean=True)


_PARENTS = "CASE WHEN doc_id % 51 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN [-doc_id - 1] END WHEN doc_id % 51 > 1 AND doc_id % 3 = 0 THEN [doc_id - 1, doc_id - 2] ELSE [doc_id - 1] END"


@query(f"""WITH RECURSIVE l AS (SELECT DISTINCT doc_id AS node, unnest({_PARENTS}) AS up FROM documents), r AS (SELECT node, up, 1 AS steps FROM l UNION SELECT r.node, l.up, r.steps + 1 FROM r JOIN l ON l.node = r.up)
SELECT node AS frame_id, up AS source, max(steps)::BIGINT AS steps, up IN (SELECT doc_id FROM documents) AS known FROM r WHERE up NOT IN (SELECT node FROM l) GROUP BY node, up""")
def k09_provenance(spark, d):
    """Chains of fifty derivations, some merges of two frames, resolved to their sources; some sources have no record."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").cast("long"))
    place, up = c("doc_id") % 51, lambda *ids: F.array(*[i.cast("long") for i in ids])
    parents = F.when(place == 0, F.when(c("doc_id") % 7 == 0, up(-c("doc_id") - 1))).when((place > 1) & (c("doc_id") % 3 == 0), up(c("doc_id") - 1, c("doc_id") - 2)).otherwise(up(c("doc_id") - 1))
    op = F.when(c("doc_id") % 3 == 0, "merge").otherwise("filter")
    lineage = t.select(*provenance.derivation("doc_id", parents, op, {"ratio": F.when(c("doc_id") % 3 == 0, 16)}))
    return provenance.sources_of(lineage)
