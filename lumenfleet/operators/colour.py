"""Colour: demosaicing, developing with and without a matrix, luminance and the RGB forms of reduction and filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import CFA, c, cfa_channel, clamp, full_scale_factor, half_up
from .transform import by_row, stencil_rows

#: Numbers of the colours in a demosaiced row.
COLOURS = ("r", "g", "b")


def demosaic(rows: DataFrame, pattern: Column) -> DataFrame:
    """frame_id, y, r, g, b: each pixel keeps its own colour; the others are truncated means of the same-colour pixels among its up to eight
    neighbours, or its own value where there are none. Edges use what exists."""
    index = F.when(pattern == "Rggb", 0).when(pattern == "Bggr", 1).when(pattern == "Grbg", 2).when(pattern == "Gbrg", 3)
    rows = rows.select("frame_id", "y", "codes", index.alias("p"))
    around, names = stencil_rows(rows, 1, 1, missing=True)
    # Missing rows travel as -1 and count for nothing; the pattern's number and the row's parity stand in front of the row.
    head = F.array(c("p") * 2 + (c("y") % 2).cast("int"))
    lists = [F.concat(head, F.coalesce(c(n), F.transform("codes", lambda _: F.lit(-1)))).alias(n) for n in names[0]]
    channel = {"R": 0, "Gr": 1, "Gb": 1, "B": 2}
    colour = np.array([[[channel[CFA[name][y * 2 + x]] for x in (0, 1)] for y in (0, 1)] for name in ("Rggb", "Bggr", "Grbg", "Gbrg")])

    def one(v: np.ndarray) -> np.ndarray:
        kind, own = v[1, :, 0], v[1, :, 1:]
        wide = np.pad(v[:, :, 1:], ((0, 0), (0, 0), (1, 1)), constant_values=-1)
        x = np.arange(-1, own.shape[1] + 1)
        sums, counts = np.zeros((3, *own.shape), np.int64), np.zeros((3, *own.shape), np.int64)
        for dy in range(3):
            parity = (kind + dy + 1) % 2  # of row y - 1 + dy
            tone = colour[kind[:, None] // 2, parity[:, None], x[None] % 2]
            for dx in range(3):
                if dy == dx == 1:
                    continue
                near, hue = wide[dy, :, dx : dx + own.shape[1]], tone[:, dx : dx + own.shape[1]]
                for k in range(3):
                    hit = (hue == k) & (near >= 0)
                    sums[k] += np.where(hit, near, 0)
                    counts[k] += hit
        mine = colour[kind[:, None] // 2, (kind % 2)[:, None], x[None, 1:-1] % 2]
        full = [np.where((mine == k) | (counts[k] == 0), own, sums[k] // np.maximum(counts[k], 1)) for k in range(3)]
        return np.concatenate(full, 1)

    base = around.select("frame_id", "y", *lists)
    whole = by_row(base, [names[0]], ["rgb"], one, shape=lambda w: 3 * (w - 1))
    n = (F.size("rgb") / 3).cast("int")
    return whole.select("frame_id", "y", *[F.slice("rgb", i * n + 1, n).alias(k) for i, k in enumerate(COLOURS)])


def block_rgb(px: DataFrame) -> DataFrame:
    """frame_id, y, x, r, g, b of every whole 2x2 block; green is the truncated mean of its two."""
    of = lambda name: F.max(F.when(c("channel") == name, c("code")))
    blocks = px.groupBy("frame_id", F.expr("y DIV 2").alias("y"), F.expr("x DIV 2").alias("x")).agg(of("R").alias("r"), F.floor((of("Gr") + of("Gb")) / 2).cast("int").alias("g"), of("B").alias("b"), F.count(F.lit(1)).alias("n"))
    return blocks.filter("n = 4").drop("n")


def ycbcr(r, g, b, top: int) -> list[Column]:
    """y, cb, cr on codes 0 to top, to the nearest even."""
    half = (top + 1) / 2.0
    weights = {"luma": (0.299, 0.587, 0.114, 0.0), "cb": (-0.168736, -0.331264, 0.5, half), "cr": (0.5, -0.418688, -0.081312, half)}
    return [clamp(F.rint(w[0] * c(r) + w[1] * c(g) + w[2] * c(b) + w[3]), F.lit(0.0), F.lit(float(top))).cast("int").alias(name) for name, w in weights.items()]


def luminance(r, g, b, depth: int) -> Column:
    """The luma of codes, placed in 16 bit as the colours are."""
    top = (1 << depth) - 1
    return (clamp(F.rint(0.299 * c(r) + 0.587 * c(g) + 0.114 * c(b)), F.lit(0.0), F.lit(float(top))).cast("int") * (1 << (16 - depth))).cast("int")


def interleaved_pixels(samples: Column, width: int) -> Column:
    """Triples r, g, b of an interleaved row; null where its length is not three times the width."""
    triple = lambda i: F.struct(F.get(samples, i * 3).alias("r"), F.get(samples, i * 3 + 1).alias("g"), F.get(samples, i * 3 + 2).alias("b"))
    return F.when(F.size(samples) == 3 * width, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), triple))


def interleaved(rows: DataFrame) -> DataFrame:
    """frame_id, y, samples: r, g, b, r, g, b ... of the arrays r, g, b of a row, a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, g, b = (batch.column(k).flatten() for k in COLOURS)
            sizes = batch.column("r").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not all(batch.column("r").value_lengths().equals(batch.column(k).value_lengths()) for k in COLOURS):
                raise ValueError("components of a row are of several lengths")
            samples = pa.concat_arrays([r, g, b]).take(pa.array(np.arange(3 * len(r)).reshape(3, -1).T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(3 * sizes)]), pa.int32()), samples)], names=["frame_id", "y", "samples"])

    return rows.select("frame_id", "y", *COLOURS).mapInArrow(run, "frame_id long, y int, samples array<int>")


def apart(rows: DataFrame, width: int) -> DataFrame:
    """frame_id, y, r, g, b of interleaved rows (frame_id, y, samples), a batch at once; rows whose length is not three times the width give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(batch.column("samples").value_lengths(), 3 * width))
            flat, offsets = batch.column("samples").flatten(), pa.array(np.arange(len(batch) + 1) * width, pa.int32())
            parts = [pa.ListArray.from_arrays(offsets, flat.take(pa.array(np.arange(k, len(flat), 3)))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), batch.column("y"), *parts], names=["frame_id", "y", *COLOURS])

    return rows.select("frame_id", "y", "samples").mapInArrow(run, "frame_id long, y int, r array<int>, g array<int>, b array<int>")


def develop(value: Column, black: float, white: float, wb: float = 1.0, gain: float = 1.0, contrast: float = 1.0, gamma: float = 2.2) -> Column:
    """16-bit value of one channel to 8 bit: levels, white balance and gain, contrast about one half, clamp, gamma."""
    x = (value - F.lit(float(black))) * F.lit(1.0 / (white - black)) if white > black else F.when(value > black, 1.0).otherwise(0.0)
    x = clamp((x * F.lit(wb * gain) - 0.5) * F.lit(contrast) + 0.5, F.lit(0.0), F.lit(1.0))
    return F.rint(F.pow(x, F.lit(1.0 / gamma)) * 255).cast("int")


def develop_with_matrix(r: Column, g: Column, b: Column, matrix: list[float], black: int, white: int, wb: tuple[float, float, float], gain: float = 1.0, contrast: float = 1.0, gamma: float = 2.2, depth: int = 16) -> list[Column]:
    """8-bit r, g, b of 16-bit values through a 3x3 matrix, in float32. A pixel with a channel at the white point is clamped before the matrix
    to what the weakest channel reaches there, so that burnt-out areas stay neutral; contrast goes with the matrix, gamma in 65536 steps."""
    f = lambda v: F.lit(v).cast("float")
    narrow = lambda v: v.cast("float")
    level = lambda v: (v - black) / (white - black) if white > black else float(v > black)
    padding = (1 << (16 - depth)) - 1
    threshold = white & ~padding if white > black else black + 1
    at = white if white > black and threshold <= black else threshold
    ceiling = min(1.0, *(float(np.float32(level(at) * w * gain)) for w in wb))
    x = lambda v: (v - F.lit(float(black))) * F.lit(1.0 / (white - black)) if white > black else F.when(v > black, 1.0).otherwise(0.0)
    linear = [narrow(x(v) * F.lit(w * gain)) for v, w in zip((r, g, b), wb, strict=True)]
    burnt = F.greatest(r, g, b) >= threshold
    linear = [F.when(burnt, F.when(v > 0, F.when(v < f(ceiling), v).otherwise(f(ceiling))).otherwise(f(0.0))).otherwise(v) for v in linear]
    m = [float(np.float32(v * contrast)) for v in matrix]
    offset = float(np.float32(0.5 - 0.5 * contrast))
    out = []
    for i, name in enumerate(("r8", "g8", "b8")):
        v = narrow(narrow(narrow(f(m[3 * i]) * linear[0]) + narrow(f(m[3 * i + 1]) * linear[1])) + narrow(f(m[3 * i + 2]) * linear[2])) + f(offset)
        unit = F.when(v > 0, F.when(v < 1, v).otherwise(f(1.0))).otherwise(f(0.0))
        step = F.floor(narrow(narrow(unit * f(65535.0)) + f(0.5)))
        out.append(F.rint(F.pow(step / F.lit(65535.0), F.lit(1.0 / gamma)) * 255).cast("int").alias(name))
    return out


def binned_rgb(px: DataFrame, factor: int, width: int, height: str, depth: int, total: bool = False) -> DataFrame:
    """Blocks of factor x factor pixels of each component alone; what is left over right and below is dropped. Rescaled to 16 bit."""
    cell = lambda v: F.floor(c(v) / factor).cast("int")
    keep = (c("x") < width // factor * factor) & (c("y") < F.floor(c(height) / factor) * factor)
    per = px.filter(keep).groupBy("frame_id", cell("y").alias("y"), cell("x").alias("x")).agg(*[F.sum(c(k) * (1 << (16 - depth))).alias(k) for k in COLOURS])
    scale = full_scale_factor(depth) / (1 if total else factor * factor)
    return per.select("frame_id", "y", "x", *[clamp(half_up(c(k) * F.lit(scale)), F.lit(0), F.lit(65535)).cast("int").alias(k) for k in COLOURS])


def tagged(px: DataFrame, pattern: str = "bayer") -> DataFrame:
    return px.withColumn("channel", cfa_channel(pattern, "x", "y"))
