"""What a chain of operations does to a frame's meaning: its size, depth, colour filter and exposures, and which physical value a code stands for.

A frame's values are value_offset + value_per_code * code. The state is folded over the frame's operations in one expression; a chain is
as long as its frame was processed often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from .regions import layout

STATE = ("width", "height", "bit_depth", "bayer", "hdr", "frames", "stages", "value_offset", "value_per_code")
#: Operations with another frame, pixel by pixel, on codes; all others give 16-bit frames.
CALCULATIONS = ("subtract", "absolute_difference", "flat_field")
FILTERS = ("mean", "gaussian", "unsharp", "minimum", "maximum", "median", "sobel")
BINNINGS = ("bin_mean", "bin_sum")


def mapping_after(op, factor, offset, per_code) -> tuple[Column, Column]:
    """(offset, per_code) after an operation; null per_code, and then null offset, where codes no longer stand for values. A sum of n pixels
    has n times the offset, differences have none, a gradient has none and four times the value per code; a gain can be corrected only
    where the offset is zero."""
    op, factor, offset, per_code = c(op), c(factor), c(offset), c(per_code)
    lost = per_code.isNull() | ((op == "flat_field") & (offset != 0))
    new_offset = F.when(op == "bin_sum", offset * (factor * factor)).when(op.isin("subtract", "absolute_difference", "sobel"), F.lit(0.0)).otherwise(offset)
    new_scale = F.when(op == "sobel", per_code * 4.0).otherwise(per_code)
    return F.when(~lost, new_offset), F.when(~lost, new_scale)


def filter_for(bayer, is_color) -> Column:
    """The colour filter that a file's frame gets: none for colour frames, else the one that was chosen."""
    return F.when(c(is_color), "None").otherwise(c(bayer))


def batch_filter(raw_targets, shown, paged, page_choice, sequence_choice) -> Column:
    """The colour filter of a batch: what is shown for raw files; else the choice for the file's pages where it has pages, or for its sequence."""
    return F.when(c(raw_targets), c(shown)).when(c(paged), c(page_choice)).otherwise(c(sequence_choice))


def after(state: Column, step: Column) -> Column:
    """The state after one operation (op, factor, bayer: a colour filter to set, or null)."""
    s, op, factor = {k: state[k] for k in STATE}, step["op"], step["factor"]
    calculated, binned = op.isin(*CALCULATIONS), op.isin(*BINNINGS)
    bayer = F.coalesce(step["bayer"], s["bayer"])
    period = F.when(bayer != "None", 2).otherwise(1)
    binned_side = lambda side: F.when(binned, F.floor(side / (factor * period)).cast("int") * period).otherwise(side)
    keeps = calculated & (s["hdr"] != "None") & F.coalesce(layout(s["hdr"], s["frames"], s["stages"]) == "LineInterleaved", F.lit(False))
    offset, per_code = mapping_after(op, factor, s["value_offset"], s["value_per_code"])
    made = {"width": binned_side(s["width"]), "height": binned_side(s["height"]), "bit_depth": F.when(calculated, s["bit_depth"]).otherwise(16), "bayer": bayer, "hdr": F.when(keeps, s["hdr"]).otherwise("None"), "frames": F.lit(1), "stages": s["stages"], "value_offset": offset, "value_per_code": per_code}
    kinds = {"width": "int", "height": "int", "bit_depth": "int", "frames": "int", "stages": "int", "value_offset": "double", "value_per_code": "double"}
    return F.struct(*[(made[k].cast(kinds[k]) if k in kinds else made[k]).alias(k) for k in STATE])


def carried(frames: DataFrame, operations: DataFrame) -> DataFrame:
    """frames (frame_id and STATE) after their operations (frame_id, step, op, factor, bayer), in order of step, with convertible. A frame
    without operations stays as it is. Steps of a frame that are equal go by op, factor and bayer."""
    steps = operations.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("step", "op", "factor", "bayer"))).alias("steps"))
    kinds = {"width": "int", "height": "int", "bit_depth": "int", "frames": "int", "stages": "int", "value_offset": "double", "value_per_code": "double"}
    start = F.struct(*[(c(k).cast(kinds[k]) if k in kinds else c(k)).alias(k) for k in STATE])
    joined = frames.join(steps, "frame_id", "left")
    out = joined.select("frame_id", F.when(c("steps").isNull(), start).otherwise(F.aggregate("steps", start, after)).alias("s"))
    return out.select("frame_id", "s.*", c("s.value_per_code").isNotNull().alias("convertible"))
