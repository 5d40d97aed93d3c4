"""Statistics, histograms, percentile metrics, noise, projections and white balance over all frames at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c, cfa_channel, pop_variance, quantile_rank, to_db, to_stops


def moments(code: str = "code") -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(code).alias("s"), F.sum(c(code).cast("long") * c(code)).alias("s2"), F.min(code).alias("min"), F.max(code).alias("max")]


def clamp_regions(rois: DataFrame) -> DataFrame:
    """Regions cut to their frames: x0, y0 (inclusive) to x1, y1 (exclusive); outside regions become empty, not errors."""
    return (
        rois.withColumn("x0", F.greatest(F.lit(0), "x")).withColumn("y0", F.greatest(F.lit(0), "y"))
        .withColumn("x1", F.least("width", c("x") + c("w"))).withColumn("y1", F.least("height", c("y") + c("h")))
    )


def region_statistics(px: DataFrame, rois: DataFrame) -> DataFrame:
    """frame_id, roi_id, n, mean, sigma, min, max for every region of every frame; an empty region gives zeros.

    Regions meet their frame's pixels by an equi join on frame_id, as tables of a partition's regions, so that pixels need no sort; the box is
    the residual condition.
    """
    cut = clamp_regions(rois).select("frame_id", "roi_id", "x0", "y0", "x1", "y1")
    inside = (c("x") >= c("x0")) & (c("x") < c("x1")) & (c("y") >= c("y0")) & (c("y") < c("y1"))
    found = px.select("frame_id", "x", "y", "code").join(cut.hint("shuffle_hash"), "frame_id").filter(inside).groupBy("frame_id", "roi_id").agg(*moments())
    full = cut.select("frame_id", "roi_id").join(found, ["frame_id", "roi_id"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return full.select("frame_id", "roi_id", zero(c("n")).alias("n"), zero(c("s") / c("n")).cast("double").alias("mean"), zero(F.sqrt(pop_variance("n", "s", "s2"))).cast("double").alias("sigma"), zero(c("min")).alias("min"), zero(c("max")).alias("max"))


def histogram(px: DataFrame, *keys: str) -> DataFrame:
    return px.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))


def row_histogram(rows: DataFrame, pattern: Column | None = None) -> DataFrame:
    """frame_id, code, n of image rows (frame_id, y, codes), and channel with the frames' colour filter: codes are counted batch by batch in numpy,
    so that no pixel leaves its row, and the counts of batches are added up."""
    lines = rows.select("frame_id", "y", "codes", (F.lit(None).cast("string") if pattern is None else pattern).alias("pattern"))
    by_phase = pattern is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, first, which = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
            lengths = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            codes, own = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
            phase = np.zeros(len(codes), np.int64)
            if by_phase:
                x = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                phase = batch.column(1).to_numpy()[own] % 2 * 2 + x % 2
            found, n = np.unique((which[own] * 4 + phase) << 16 | codes, return_counts=True)
            at = found >> 18
            yield pa.RecordBatch.from_arrays([pa.array(frames[at]), batch.column(3).take(pa.array(first[at])), pa.array(found >> 16 & 3, pa.int32()), pa.array(found & 0xFFFF, pa.int32()), pa.array(n)], names=["frame_id", "pattern", "phase", "code", "n"])

    counted = lines.mapInArrow(run, "frame_id long, pattern string, phase int, code int, n long")
    if pattern is None:
        return counted.groupBy("frame_id", "code").agg(F.sum("n").alias("n"))
    per = counted.groupBy("frame_id", "pattern", "phase", "code").agg(F.sum("n").alias("n"))
    return per.select("frame_id", cfa_channel("pattern", c("phase") % 2, F.floor(c("phase") / 2)).alias("channel"), "code", "n")


def channel_histogram(rows: DataFrame, pattern: Column) -> DataFrame:
    """frame_id, channel, code, n; the frame's total, channel null, follows from the channels without a second scan."""
    per = row_histogram(rows, pattern)
    total = per.groupBy("frame_id", "code").agg(F.sum("n").alias("n")).select("frame_id", F.lit(None).cast("string").alias("channel"), "code", "n")
    return per.unionByName(total)


def pixel_histogram(px: DataFrame) -> DataFrame:
    """The same from pixels (frame_id, channel, code), which no shuffle moves where they lie by frame: one record of counts a code, which comes
    apart at the end."""
    names = ("R", "Gr", "Gb", "B")
    per = px.groupBy("frame_id", "code").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c("channel") == k).alias(k) for k in names])
    each = F.array(F.struct(F.lit(None).cast("string").alias("channel"), c("total").alias("n")), *[F.struct(F.lit(k).alias("channel"), c(k).alias("n")) for k in names])
    return per.select("frame_id", "code", F.explode(each).alias("v")).select("frame_id", "v.channel", "code", "v.n").filter("n > 0")


def histogram_metrics(hist: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """median, p1, p99 (by rank), mode (lowest of the most frequent), mean, sigma, saturated and zero shares, simple dynamic range."""
    by = Window.partitionBy(*keys)
    running = hist.withColumn("cum", F.sum("n").over(by.orderBy("code"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(c("cum") > quantile_rank(q, "total"), c("code")))
    top = (1 << depth) - 1
    out = running.groupBy(*keys).agg(
        F.max("total").alias("count"), F.sum(c("code") * c("n")).alias("s"), F.sum(c("code").cast("long") * c("code") * c("n")).alias("s2"),
        at(0.5).alias("median"), at(0.01).alias("p1"), at(0.99).alias("p99"), F.max(c("n") * 65536 + (65535 - c("code"))).alias("top_count"),  # of the most frequent the lowest, as one number
        F.sum(F.when(c("code") == top, c("n")).otherwise(0)).alias("hot"), F.sum(F.when(c("code") == 0, c("n")).otherwise(0)).alias("zeros"),
    )
    sigma = F.sqrt(pop_variance("count", "s", "s2"))
    out = out.withColumn("mode", (65535 - c("top_count") % 65536).cast("int"))
    return out.withColumn("sigma", sigma).select(*keys, "count", (c("s") / c("count")).alias("mean"), "sigma", "median", "p1", "p99", "mode", (100.0 * c("hot") / c("count")).alias("saturated_pct"), (100.0 * c("zeros") / c("count")).alias("zero_pct"), F.coalesce(to_db(F.lit(top), "sigma"), F.lit(0.0)).alias("dr_db"))


def cumulative(hist: DataFrame, *keys: str) -> DataFrame:
    return hist.withColumn("cumulative", F.sum("n").over(Window.partitionBy(*keys).orderBy("code")))


def auto_levels(hist: DataFrame, keys: list[str], clip: float = 0.0035) -> DataFrame:
    """black and white after clipping a share from both ends; null where white would not lie above black."""
    by = Window.partitionBy(*keys)
    h = hist.withColumn("up", F.sum("n").over(by.orderBy("code"))).withColumn("down", F.sum("n").over(by.orderBy(F.desc("code")))).withColumn("cut", F.floor(F.sum("n").over(by) * F.lit(clip)))
    lv = h.groupBy(*keys).agg(F.min(F.when(c("up") > c("cut"), c("code"))).alias("black"), F.max(F.when(c("down") > c("cut"), c("code"))).alias("white"))
    ok = c("white") > c("black")
    return lv.select(*keys, F.when(ok, c("black")).alias("black"), F.when(ok, c("white")).alias("white"))


def display_columns(hist: DataFrame, keys: list[str], columns: int, bins: int) -> DataFrame:
    """Counts by display column i * columns div bins, with a running sum."""
    per = hist.groupBy(*keys, F.floor(c("code") * columns / bins).cast("int").alias("col")).agg(F.sum("n").alias("n"))
    return per.withColumn("cumulative", F.sum("n").over(Window.partitionBy(*keys).orderBy("col")))


def pooled_noise(per_channel: DataFrame, keys: list[str]) -> DataFrame:
    """From moments by channel: n, mean, sigma_total pooled within channels."""
    within = per_channel.withColumn("v", pop_variance("n", "s", "s2"))
    return within.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(F.sum(c("n") * c("v")) / F.sum("n")).alias("sigma_total"))


def noise_single(px: DataFrame, saturation: int) -> DataFrame:
    per = px.groupBy("frame_id", "channel").agg(*moments())
    out = pooled_noise(per, ["frame_id"])
    return out.select("*", to_db(F.lit(saturation), "sigma_total").alias("dr_total_db"), to_stops(F.lit(saturation), "sigma_total").alias("dr_total_stops"))


def frame_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, y, a, b: the rows of both frames side by side. The join shuffles one record per image row, not per pixel."""
    a = rows.select(c("frame_id").alias("frame_a"), "y", c("codes").alias("a"))
    b = rows.select(c("frame_id").alias("frame_b"), "y", c("codes").alias("b"))
    return pairs.join(a, "frame_a").join(b, ["frame_b", "y"]).select("pair_id", "frame_a", "frame_b", "y", "a", "b")


def noise_pair(px_pairs: DataFrame, saturation: int) -> DataFrame:
    """From pixels (pair_id, channel, a, b): total, temporal (sigma of the difference / sqrt 2) and fixed-pattern noise, dynamic range."""
    d = c("a") - c("b")
    per = px_pairs.groupBy("pair_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("s"), F.sum(c("a").cast("long") * c("a")).alias("s2"), F.sum(d).alias("ds"), F.sum(d.cast("long") * d).alias("ds2"))
    return pair_noise(per, ["pair_id"], saturation)


#: Pixels that are worked on at once.
CELLS = 1 << 20


def two_phases(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(parity of x, n, sum of a, of its square, of a - b, of its square) for the two column phases of each pair of rows, which are tables of rows
    of one width: two records a pair, one after the other."""
    out = np.zeros((len(a), 2, 6), np.int64)
    each = max(1, CELLS // max(1, a.shape[1]))
    for at in range(0, len(a), each):
        for parity in (0, 1):
            v, w = (x[at : at + each, parity::2].astype(np.int64) for x in (a, b))
            d = v - w
            columns = (parity, v.shape[1], v.sum(1), (v * v).sum(1), d.sum(1), (d * d).sum(1))
            for i, x in enumerate(columns):
                out[at : at + each, parity, i] = x
    return out.reshape(-1, 6)


def paired_phases(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows are of equal length, and the records of two_phases for them. Values lie one row after another; ends begin with 0."""
    widths = np.diff(a_ends)
    alike = widths == np.diff(b_ends)
    of = [np.flatnonzero(alike & (widths == w)) for w in np.unique(widths[alike])]
    made = [two_phases(*(v[ends[own][:, None] + np.arange(int(widths[own[0]]))] for v, ends in ((a, a_ends), (b, b_ends)))) for own in of]
    which = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64)
    return which, np.concatenate([*made, np.zeros((0, 6), np.int64)])


def pair_moments(rows: DataFrame, *keys: str) -> DataFrame:
    """From rows (keys, y, a, b: codes of two frames) the keys, y, parity, n, s, s2, ds, ds2: two records a row, no pixel leaves its row. Rows
    of unequal length give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(batch.column(k).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(k).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])) for k in ("a", "b")]
            which, numbers = paired_phases(*lists[0], *lists[1])
            own = batch.select([*keys, "y"]).take(pa.array(np.repeat(which, 2), pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers[:, 0], pa.int32()), *[pa.array(numbers[:, i]) for i in range(1, 6)]], names=[*keys, "y", "parity", "n", "s", "s2", "ds", "ds2"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "y"))
    return rows.select(*keys, "y", "a", "b").mapInArrow(run, f"{schema}, parity int, n long, s long, s2 long, ds long, ds2 long")


def pair_noise(moments_of: DataFrame, keys: list[str], saturation: int) -> DataFrame:
    """Noise of a pair from its moments (keys, channel, n, s, s2, ds, ds2), in as many parts as there are: variances are pooled within channels."""
    per = moments_of.groupBy(*keys, "channel").agg(*[F.sum(k).alias(k) for k in ("n", "s", "s2", "ds", "ds2")]).filter("n > 0")
    per = per.withColumn("v", pop_variance("n", "s", "s2")).withColumn("dv", pop_variance("n", "ds", "ds2"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(F.sum(c("n") * c("v")) / F.sum("n")).alias("sigma_total"), F.sqrt(F.sum(c("n") * c("dv")) / F.sum("n") / 2).alias("sigma_temporal"))
    fpn = F.sqrt(F.greatest(F.lit(0.0), c("sigma_total") * c("sigma_total") - c("sigma_temporal") * c("sigma_temporal")))
    return out.select("*", fpn.alias("sigma_fpn"), to_db(F.lit(saturation), "sigma_total").alias("dr_total_db"), to_db(F.lit(saturation), "sigma_temporal").alias("dr_temporal_db"))


def projections(px: DataFrame) -> DataFrame:
    """Both axes from one scan: axis "horizontal" has the mean of each column along x, "vertical" of each row."""
    sets = px.groupingSets([["frame_id", "x"], ["frame_id", "y"]], "frame_id", "x", "y").agg(*moments())
    axis = F.when(c("x").isNotNull(), "horizontal").otherwise("vertical")
    return sets.select("frame_id", axis.alias("axis"), F.coalesce("x", "y").alias("position"), (c("s") / c("n")).alias("mean"), "min", "max")


def vertical_projection(rows: DataFrame) -> DataFrame:
    """Row means of whole frames from the row arrays: no shuffle."""
    s = F.aggregate("codes", F.lit(0).cast("long"), lambda acc, v: acc + v)
    return rows.select("frame_id", c("y").alias("position"), (s / F.size("codes")).alias("mean"), F.array_min("codes").alias("min"), F.array_max("codes").alias("max"))


def profile_statistics(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, min, max, median (the mean of the middle pair), sigma from one scan of whole numbers: sums are exact, so constant profiles have
    a sigma of exactly zero."""
    v = c(value).cast("long")
    per = values.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"))
    return per.select(*keys, "n", (c("s") / c("n")).alias("mean"), "min", "max", "median", F.sqrt(pop_variance("n", "s", "s2")).alias("sigma"))


def gray_world(px: DataFrame, black: int) -> DataFrame:
    """Gains of red and blue so that 2 x 2 blocks are gray on average; green of a block is its truncated mean; gain 1 where a mean is at or below black."""
    block = px.groupBy("frame_id", F.floor(c("y") / 2).alias("by"), F.floor(c("x") / 2).alias("bx")).agg(F.count(F.lit(1)).alias("k"), *[F.max(F.when(c("channel") == ch, c("code"))).alias(ch) for ch in ("R", "Gr", "Gb", "B")]).filter("k = 4")
    per = block.groupBy("frame_id").agg(F.avg("R").alias("r"), F.avg(F.floor((c("Gr") + c("Gb")) / 2)).alias("g"), F.avg("B").alias("b"))
    gain = lambda ch: F.when((c(ch) <= black) | (c("g") <= black), 1.0).otherwise((c("g") - black) / (c(ch) - black))
    return per.select("frame_id", gain("r").alias("gain_r"), gain("b").alias("gain_b"))
