"""Systematic samples of frames: strides that meet every colour phase and every exposure, from each frame's own format."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.semantics import c
from .regions import layout

#: An axis that would keep fewer places is read in full (fixed value).
LEAST_PLACES = 16
#: How far the next number coprime to a period of 31 bits may lie: such a period has nine different primes at most.
WITHIN = 64


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of two whole numbers of 31 bits: at most 46 divisions."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    return pair["a"]


@F.arrow_udf(LongType())
def first_coprime(low: pa.Array, period: pa.Array) -> pa.Array:
    """The first of low to low + WITHIN that is coprime to the period, null where there is none: a batch at once, mostly in one to three steps."""
    known = ~(low.is_null().to_numpy(zero_copy_only=False) | period.is_null().to_numpy(zero_copy_only=False))
    at, of = (v.fill_null(1).to_numpy(zero_copy_only=False).copy() for v in (low, period))
    open_ = np.flatnonzero(known)
    for _ in range(WITHIN + 1):
        open_ = open_[np.gcd(at[open_], of[open_]) != 1]
        if not len(open_):
            break
        at[open_] += 1
    known[open_] = False
    return pa.array(at, pa.int64(), mask=~known)


def coprime_stride(stride: Column, period: Column) -> Column:
    """The first number from stride on that has no common divisor with the period; a stride of 1, or a period of 1, needs no change."""
    low = F.greatest(F.lit(1).cast("long"), stride.cast("long"))
    return F.when((low == 1) | (period <= 1), low).otherwise(first_coprime(low, period.cast("long")))


def exposure_period(hdr, frames, stages, line_block) -> Column:
    """Rows after which line-interleaved exposures repeat, 1 for others. Layouts that stay open count as line-interleaved; a period that
    passes half of 31 bits is none."""
    way = F.coalesce(layout(hdr, frames, stages), F.lit("LineInterleaved"))
    rows = c(stages).cast("long") * F.when(c(line_block) > 0, c(line_block)).otherwise(2)
    return F.when((c(hdr) == "None") | (c(stages) < 2) | (way != "LineInterleaved") | (rows > (2**31 - 1) // 2), F.lit(1).cast("long")).otherwise(rows)


def sampling_strides(width, height, most, hdr, frames, stages, line_block) -> tuple[Column, Column]:
    """(column stride, row stride) for about most of width x height pixels: odd, and coprime to the exposures' period. An axis that would keep
    fewer than 16 places is read in full, and the other one by the square of the stride."""
    width, height = c(width).cast("long"), c(height).cast("long")
    stride = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt((width * height).cast("double") / c(most))).cast("long"))
    few = lambda n: F.floor((n + stride - 1) / stride) < LEAST_PLACES
    squared = lambda n: F.greatest(F.lit(1).cast("long"), F.least(stride * stride, F.greatest(F.lit(1).cast("long"), n)))
    one, both = F.lit(1).cast("long"), few(width) == few(height)
    column = F.when((stride <= 1) | both, stride).when(few(width), one).otherwise(squared(width))
    row = F.when((stride <= 1) | both, stride).when(few(width), squared(height)).otherwise(one)
    period = exposure_period(hdr, frames, stages, line_block)
    even = F.when(period % 2 == 0, period).otherwise(period * 2)
    return coprime_stride(column, even), coprime_stride(row, even)


def sampled(rows: DataFrame, column_stride: str = "column_stride", row_stride: str = "row_stride", *keep: str) -> DataFrame:
    """frame_id, y, x, code of the sample, and the kept columns: rows carry the strides of their frame. Rows are left out before they come apart."""
    kept = rows.filter(c("y") % c(row_stride) == 0)
    places = kept.select("frame_id", "y", c(column_stride).alias("__stride"), *keep, F.posexplode("codes").alias("x", "code"))
    return places.filter(c("x") % c("__stride") == 0).select("frame_id", "y", "x", "code", *keep)
