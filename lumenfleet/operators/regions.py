"""Regions of frames: what a drawn rectangle means, lattices of one channel, centre and quadrant regions, and refusals with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import CFA, c, clamp


def div(a, b) -> Column:
    return F.floor(c(a) / c(b)).cast("int")


def clamped(x, y, w, h, width, height) -> dict[str, Column]:
    """The part of a rectangle inside the frame: cx, cy, cw, ch; both sides 0 where there is none."""
    left, top = clamp(x, 0, width), clamp(y, 0, height)
    right, low = clamp(c(x) + c(w), 0, width), clamp(c(y) + c(h), 0, height)
    some = (right > left) & (low > top)
    return {"cx": left.cast("int"), "cy": top.cast("int"), "cw": F.when(some, right - left).otherwise(0).cast("int"), "ch": F.when(some, low - top).otherwise(0).cast("int")}


def resolved(rois: DataFrame) -> DataFrame:
    """rois (x, y, w, h null for no region; tiled, width, height, segment) with kind (whole, rectangle, lattice, refused), reason, tx, ty, tw, th, step
    and pixels.

    In tiled frames, whose channels stand in quadrants, a region within one quadrant is a lattice of the source: every second pixel from (tx, ty)
    on. Regions outside, across quadrants or across exposure segments are refused.
    """
    even = lambda v: F.when(c("tiled"), div(v, 2) * 2).otherwise(c(v))
    rois = rois.withColumns({"uw": even("width"), "uh": even("height")})
    rois = rois.withColumns(clamped("x", "y", "w", "h", "uw", "uh")).withColumns({"qw": div("uw", 2), "qh": div("uh", 2)})
    q = {"qx": div("cx", "qw"), "qy": div("cy", "qh")}
    rois = rois.withColumns(q).withColumns({"lx": (c("cx") - c("qx") * c("qw")) * 2 + c("qx"), "ly": (c("cy") - c("qy") * c("qh")) * 2 + c("qy")})
    across = (div(c("cx") + c("cw") - 1, c("qw")) != c("qx")) | (div(c("cy") + c("ch") - 1, c("qh")) != c("qy"))
    first, last = F.when(c("tiled"), c("lx")).otherwise(c("cx")), F.when(c("tiled"), c("lx") + 2 * (c("cw") - 1)).otherwise(c("cx") + c("cw") - 1)
    spans = (c("segment") > 0) & (div(first, c("segment")) != div(last, c("segment")))
    none = c("x").isNull()
    reason = F.when(none, F.lit(None)).when(c("cw") == 0, "outside").when(c("tiled") & across, "quadrants").when(spans, "exposures")
    kind = F.when(none, "whole").when(reason.isNotNull(), "refused").when(c("tiled"), "lattice").otherwise("rectangle")
    rois = rois.withColumns({"reason": reason, "kind": kind, "step": F.when(c("tiled") & ~none, 2).otherwise(1)})
    place = lambda whole, lattice, own: F.when(c("kind") == "whole", whole).when(c("kind") == "lattice", lattice).when(c("kind") == "rectangle", own).cast("int")
    rois = rois.withColumns({"tx": place(F.lit(0), c("lx"), c("cx")), "ty": place(F.lit(0), c("ly"), c("cy")), "tw": place(c("width"), c("cw"), c("cw")), "th": place(c("height"), c("ch"), c("ch"))})
    return rois.withColumn("pixels", F.coalesce(c("tw").cast("long") * c("th"), F.lit(0))).drop("uw", "uh", "qw", "qh", "qx", "qy", "lx", "ly")


def of_regions(px: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels of resolved regions, each with roi_id; refused regions have none."""
    some = rois.filter("kind <> 'refused'").select("roi_id", "frame_id", "tx", "ty", "tw", "th", "step")
    inside = (c("x") >= c("tx")) & (c("x") < c("tx") + c("tw") * c("step")) & (c("y") >= c("ty")) & (c("y") < c("ty") + c("th") * c("step"))
    return px.join(some, "frame_id").filter(inside & ((c("x") - c("tx")) % c("step") == 0) & ((c("y") - c("ty")) % c("step") == 0)).drop("tx", "ty", "tw", "th", "step")


def centre(width, height, segment=0, stage=0) -> dict[str, Column]:
    """The middle region of half the size, of one exposure segment where there are some."""
    inside = (c(segment) > 0) & (c(segment) <= c(width))
    stages = F.greatest(F.lit(1), div(width, F.when(inside, c(segment)).otherwise(c(width))))
    left = F.when(inside, clamp(stage, 0, stages - 1) * c(segment)).otherwise(0)
    area = F.when(inside, c(segment)).otherwise(c(width))
    w, h = F.greatest(F.lit(1), div(area, 2)), F.greatest(F.lit(1), div(height, 2))
    return {"x": (left + div(area - w, 2)).cast("int"), "y": div(c(height) - h, 2), "w": w, "h": h}


def quadrant(pattern, channel, width, height) -> Column:
    """Place of a channel's quadrant in the tiled frame: struct x, y, w, h; null for a channel that the pattern doesn't have."""
    out = F.lit(None)
    w, h = div(width, 2), div(height, 2)
    for name, channels in CFA.items():
        for k, own in enumerate(channels):
            out = F.when((c(pattern) == name) & (c(channel) == own), F.struct((w * (k % 2)).alias("x"), (h * (k // 2)).alias("y"), w.alias("w"), h.alias("h"))).otherwise(out)
    return out


def effective_line_block(block, bayer) -> Column:
    return F.when(c(block) > 0, c(block)).when(c(bayer) != "None", 2).otherwise(1)


def layout(hdr, frames, stages) -> Column:
    """FrameSequential or LineInterleaved; Auto by the number of frames, null where that leaves it open."""
    return F.when(c(hdr) != "Auto", c(hdr)).when(c(frames) == c(stages), "FrameSequential").when(c(frames) == 1, "LineInterleaved")


def split_refusal(hdr, frames, stages, height, block, offset) -> Column:
    """Why a frame can't be split into its exposures; null if it can."""
    way, period = layout(hdr, frames, stages), c(stages).cast("long") * c(block)
    keep = F.floor(c(height) / period) * c(block) - F.abs(c(offset).cast("long")) * (c(stages) - 1)
    lines = way == "LineInterleaved"
    return (
        F.when(c(hdr) == "None", "no exposures").when(~c(stages).isin(2, 3), "stages").when(way.isNull(), "layout open")
        .when((way == "FrameSequential") & (c(frames) != c(stages)), "frames").when(lines & (period > c(height)), "period").when(lines & (keep <= 0), "offset")
    )


def exposure_guards(hdr, frames, stages, bayer, block, offset) -> dict[str, Column]:
    """in_frame: rows of several exposures in one frame, which noise, horizontal projections and defects refuse; phase_mismatch: rows whose
    parity doesn't tell their colour, which channel histograms, white balance and colour display refuse."""
    inside = (c(hdr) != "None") & F.coalesce(layout(hdr, frames, stages) == "LineInterleaved", F.lit(False))
    odd = (effective_line_block(block, bayer) % 2 != 0) | (c(offset) % 2 != 0)
    mismatch = (c(bayer) != "None") & inside & odd
    refused = F.array_compact(F.array(*[F.when(inside, F.lit(n)) for n in ("noise", "horizontal_projection", "defects")], *[F.when(mismatch, F.lit(n)) for n in ("channel_histogram", "white_balance", "colour_display")]))
    return {"in_frame": inside, "phase_mismatch": mismatch, "refused": refused}


def mapped_cursor(at, source, target) -> Column:
    """The place in a frame of another size, by pixel centres; the same place where the sizes are equal."""
    return F.when(c(source) == c(target), c(at).cast("double")).otherwise((c(at) + 0.5) / c(source) * c(target) - 0.5)


def corresponding_pixel(at, size) -> Column:
    return F.when((c(at) >= -0.5) & (c(at) < c(size) - 0.5), clamp(F.floor(c(at) + 0.5), F.lit(0), c(size) - 1).cast("int"))


def projection_targets(rois: DataFrame, direction: str = "direction") -> DataFrame:
    """Resolved regions (with mixed: the frame shows line-interleaved exposures, and the direction of a projection) with target, refusal, axis_start
    and axis_source: where the axis begins in what is shown, and, for a lattice, in the source.

    Columns of line-interleaved exposures mix them, so horizontal projections of such frames are refused; tiled frames need a region, and
    side-by-side exposures are not projected vertically as a whole.
    """
    horizontal, none = c(direction) == "horizontal", (c("x").isNull()) | (F.coalesce(c("w"), F.lit(0)) <= 0) | (F.coalesce(c("h"), F.lit(0)) <= 0)
    refusal = (
        F.when(horizontal & c("mixed"), "exposures in rows").when(~none, c("reason")).when(c("tiled"), "no region in quadrants")
        .when((c("segment") > 0) & ~horizontal & (c("width") > c("segment")), "exposures side by side")
    )
    rows = rois.withColumn("refusal", refusal)
    target = F.when(c("refusal").isNotNull(), "refused").when(none, "whole").otherwise(c("kind"))
    rows = rows.withColumn("target", target)
    start = F.when(c("target").isin("rectangle", "lattice"), F.when(horizontal, c("cx")).otherwise(c("cy"))).when(c("target") == "whole", 0)
    return rows.withColumns({"axis_start": start.cast("int"), "axis_source": F.when(c("target") == "lattice", F.when(horizontal, c("tx")).otherwise(c("ty"))).cast("int")})


def readouts(points: DataFrame, rows: DataFrame, panes: int = 4) -> DataFrame:
    """view_id, x, y, code0 ... and delta of points (view_id, pane, frame_id, bit_depth, x, y) in up to so many frames each: codes are null outside
    their frame, and delta is the second less the first where there are just two panes, of one depth, with a code each."""
    met = points.join(rows.select("frame_id", "y", "codes"), ["frame_id", "y"], "left").withColumn("code", F.when(c("x") >= 0, F.get("codes", c("x"))))
    own = lambda i, name: F.max(F.when(c("pane") == i, c(name)))
    per = met.groupBy("view_id", "x", "y").agg(F.count(F.lit(1)).alias("n"), *[own(i, "code").alias(f"code{i}") for i in range(panes)], *[own(i, "bit_depth").alias(f"depth{i}") for i in range(2)])
    delta = F.when((c("n") == 2) & (c("depth0") == c("depth1")), c("code1") - c("code0"))
    return per.select("view_id", "x", "y", *[f"code{i}" for i in range(panes)], delta.alias("delta"))
