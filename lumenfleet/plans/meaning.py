"""What chains of operations leave of a frame's meaning, with SQL that goes step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import meaning
from .fleet import query

OPS = (*meaning.CALCULATIONS, *meaning.FILTERS, *meaning.BINNINGS)
_CALC = "op IN (" + ", ".join(f"'{k}'" for k in meaning.CALCULATIONS) + ")"
_BIN = "op IN ('bin_mean', 'bin_sum')"
_WAY = "CASE WHEN hdr <> 'Auto' THEN hdr WHEN frames = stages THEN 'FrameSequential' WHEN frames = 1 THEN 'LineInterleaved' END"
_LOST = "(value_per_code IS NULL OR (op = 'flat_field' AND value_offset <> 0))"


@query(f"""WITH RECURSIVE f AS (SELECT doc_id AS frame_id, (64 + doc_id%50)::INT AS width, (48 + doc_id%31)::INT AS height, ([8,10,12,14])[doc_id%4+1]::INT AS bit_depth, CASE WHEN doc_id%11=0 THEN 'None' ELSE (['None','Rggb','Bggr'])[doc_id%3+1] END AS bayer,
 (['None','Auto','LineInterleaved','FrameSequential'])[doc_id//3%4+1] AS hdr, (doc_id%3+1)::INT AS frames, (2+doc_id%2)::INT AS stages, CASE WHEN doc_id%13 <> 0 THEN doc_id%5*0.5::DOUBLE END AS value_offset, CASE WHEN doc_id%13 <> 0 THEN 0.25::DOUBLE*(1+doc_id%4) END AS value_per_code, 0 AS k FROM documents),
s AS (SELECT *, ([{', '.join(f"'{k}'" for k in OPS)}])[(frame_id*7 + k*5) % {len(OPS)} + 1] AS op, 2 + (frame_id + k) % 3 AS factor, CASE WHEN k % 3 = 2 THEN (['Rggb','None'])[frame_id%2+1] ELSE bayer END AS b FROM f),
r AS (SELECT * FROM s UNION ALL SELECT frame_id, width, height, bit_depth, bayer, hdr, frames, stages, value_offset, value_per_code, k, ([{', '.join(f"'{k}'" for k in OPS)}])[(frame_id*7 + k*5) % {len(OPS)} + 1], 2 + (frame_id + k) % 3, CASE WHEN k % 3 = 2 THEN (['Rggb','None'])[frame_id%2+1] ELSE bayer END FROM
 (SELECT frame_id, (CASE WHEN {_BIN} THEN width//(factor*(CASE WHEN b <> 'None' THEN 2 ELSE 1 END))*(CASE WHEN b <> 'None' THEN 2 ELSE 1 END) ELSE width END)::INT AS width, (CASE WHEN {_BIN} THEN height//(factor*(CASE WHEN b <> 'None' THEN 2 ELSE 1 END))*(CASE WHEN b <> 'None' THEN 2 ELSE 1 END) ELSE height END)::INT AS height,
  (CASE WHEN {_CALC} THEN bit_depth ELSE 16 END)::INT AS bit_depth, b AS bayer, CASE WHEN {_CALC} AND ({_WAY}) = 'LineInterleaved' THEN hdr ELSE 'None' END AS hdr, 1 AS frames, stages,
  CASE WHEN {_LOST} THEN NULL WHEN op = 'bin_sum' THEN value_offset*(factor*factor) WHEN op IN ('subtract','absolute_difference','sobel') THEN 0 ELSE value_offset END AS value_offset, CASE WHEN {_LOST} THEN NULL WHEN op = 'sobel' THEN value_per_code*4 ELSE value_per_code END AS value_per_code, k + 1 AS k FROM r WHERE k < frame_id % 6))
SELECT frame_id, width, height, bit_depth, bayer, hdr, frames, stages, value_offset, value_per_code, value_per_code IS NOT NULL AS convertible FROM r WHERE k = frame_id % 6""")
def x26_j05_x27_meaning(spark, d):
    """Chains of up to five operations on frames with and without exposures, filters and values."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("frame_id"))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (F.expr(k) + 1).cast("int"))
    known = c("frame_id") % 13 != 0
    frames = t.select(
        "frame_id", (64 + c("frame_id") % 50).alias("width"), (48 + c("frame_id") % 31).alias("height"), pick("frame_id % 4", 8, 10, 12, 14).alias("bit_depth"), meaning.filter_for(pick("frame_id % 3", "None", "Rggb", "Bggr"), c("frame_id") % 11 == 0).alias("bayer"),
        pick("frame_id DIV 3 % 4", "None", "Auto", "LineInterleaved", "FrameSequential").alias("hdr"), (c("frame_id") % 3 + 1).alias("frames"), (2 + c("frame_id") % 2).alias("stages"), F.when(known, c("frame_id") % 5 * 0.5).alias("value_offset"), F.when(known, 0.25 * (1 + c("frame_id") % 4)).alias("value_per_code"),
    )
    steps = t.select("frame_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k < c("frame_id") % 6)).alias("step"))
    op = F.element_at(F.array(*map(F.lit, OPS)), ((c("frame_id") * 7 + c("step") * 5) % len(OPS) + 1).cast("int"))
    operations = steps.select("frame_id", "step", op.alias("op"), (2 + (c("frame_id") + c("step")) % 3).alias("factor"), F.when(c("step") % 3 == 2, pick("frame_id % 2", "Rggb", "None")).alias("bayer"))
    return meaning.carried(frames, operations)
