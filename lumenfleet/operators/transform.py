"""Frame arithmetic, reduction, filters, defects, exposures and colour: tables of pixels or image rows in, the same out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c, cfa_channel, clamp, full_scale_factor, half_up, pop_variance


# --- Arithmetic of two frames -------------------------------------------------------------------------------------------------
def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.greatest(p - q, F.lit(0)))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.abs(p - q))


def flat_field(px: DataFrame, reference_mean: str, depth: int) -> DataFrame:
    """code of a * mean16(b) / max(1, b) on the code grid, from pixels a, b and the reference's 16-bit mean."""
    shift = float(1 << (16 - depth))
    gained = c("a") * shift * c(reference_mean) / F.greatest(F.lit(1.0), c("b") * shift)
    return px.withColumn("code", clamp(half_up(gained / shift), F.lit(0), F.lit((1 << depth) - 1)).cast("int"))


# --- Reduction ----------------------------------------------------------------------------------------------------------------
def binned(px: DataFrame, factor: int, width: int, height: str, depth: int, step: int = 2, total: bool = False) -> DataFrame:
    """Same-colour binning: blocks of factor pixels at distance step; what is left over right and below is dropped. The result is rescaled to
    16 bit, averaged or summed with saturation."""
    cell = lambda v: (F.floor(c(v) / (step * factor)) * step + c(v) % step).cast("int")
    use_w, use_h = width // (step * factor) * step * factor, F.floor(c(height) / (step * factor)) * step * factor
    v16 = c("code") * (1 << (16 - depth))
    per = px.filter((c("x") < use_w) & (c("y") < use_h)).groupBy("frame_id", cell("y").alias("y"), cell("x").alias("x")).agg(F.sum(v16).alias("s"))
    scale = full_scale_factor(depth) / (1 if total else factor * factor)
    return per.select("frame_id", "y", "x", clamp(half_up(c("s") * F.lit(scale)), F.lit(0), F.lit(65535)).cast("int").alias("v16"))


#: Rows to a band: what a task of a filter or a reduction holds is a band of a frame and the rows around it, never a whole tall frame.
BAND = 256


def band_rows(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(first y, codes, which are there) of a band's rows as a table; rows and pixels that are missing are 0."""
    y = table.column("y").to_numpy()
    rows = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int64) for v in table.column("codes")]
    low, width = int(y.min()), max(map(len, rows))
    codes, there = np.zeros((int(y.max()) - low + 1, width), np.int64), np.zeros((int(y.max()) - low + 1, width), np.int64)
    for at, row in zip(y - low, rows, strict=True):
        codes[at, : len(row)], there[at, : len(row)] = row, 1
    return low, codes, there


def level_rows(frame: int, levels: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    """(level, first y, codes) of a frame's band as records frame_id, level, y, codes."""
    n = [len(v) for _, _, v in levels]
    lists = pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.int32())) for _, _, v in levels] or [pa.array([], pa.list_(pa.int32()))])
    ys = np.concatenate([first + np.arange(len(v)) for _, first, v in levels] or [np.zeros(0)])
    return pa.table([pa.array([frame] * sum(n), pa.int64()), pa.array(np.repeat([k for k, _, _ in levels], n), pa.int32()), pa.array(ys, pa.int32()), lists], names=["frame_id", "level", "y", "codes"])


_LEVELS = "frame_id long, level int, y int, codes array<int>"


def pyramid(rows: DataFrame, levels: int, band: int = BAND) -> DataFrame:
    """Block means of 2, 4, ... with truncation, as rows (frame_id, level, y, codes): sums and counts are chained, so that every level is the mean
    of its pixels. All levels come from one pass over bands, which hold whole blocks."""
    if band % (1 << levels):
        raise ValueError("a band holds whole blocks")

    def run(key, table):
        low, s, n = band_rows(table)
        made = []
        s, n = np.pad(s, ((low % band, 0), (0, 0))), np.pad(n, ((low % band, 0), (0, 0)))
        first = low - low % band
        for k in range(1, levels + 1):
            s, n = (np.add.reduceat(np.add.reduceat(v, np.arange(0, v.shape[0], 2), 0), np.arange(0, v.shape[1], 2), 1) if v.size else v for v in (s, n))
            keep = np.flatnonzero(n.any(1)) if n.size else np.zeros(0, int)
            for run_of in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1):
                if len(run_of):
                    made.append((1 << k, (first >> k) + int(run_of[0]), s[run_of] // np.maximum(n[run_of], 1)))
        return level_rows(key[0].as_py(), made)

    return rows.select("frame_id", "y", "codes", F.floor(c("y") / band).alias("band")).groupBy("frame_id", "band").applyInArrow(run, _LEVELS)


def bayer_pyramid(rows: DataFrame, height: str, levels: int, band: int = BAND) -> DataFrame:
    """Same-phase halving of rows that carry their frame's height, truncated at each level: the next level starts from truncated codes. What
    is left over right and below is dropped. One pass over bands, as in pyramid."""
    if band % (2 << levels):
        raise ValueError("a band holds whole blocks")

    def run(key, table):
        low, v, _ = band_rows(table)
        v = np.pad(v, ((low % band, 0), (0, 0)))
        first, tall, made = low - low % band, int(table.column("h")[0].as_py()), []
        for k in range(1, levels + 1):
            v = v[: max(0, tall // 4 * 4 - first)]
            v = v[: len(v) // 4 * 4, : v.shape[1] // 4 * 4]
            v = v.reshape(v.shape[0] // 4, 2, 2, v.shape[1] // 4, 2, 2).sum((1, 4)).reshape(v.shape[0] // 2, v.shape[1] // 2) // 4
            first, tall = first // 2, tall // 4 * 2
            if v.size:
                made.append((1 << k, first, v))
        return level_rows(key[0].as_py(), made)

    return rows.select("frame_id", "y", "codes", c(height).alias("h"), F.floor(c("y") / band).alias("band")).groupBy("frame_id", "band").applyInArrow(run, _LEVELS)


# --- Filters ------------------------------------------------------------------------------------------------------------------
def stencil_rows(rows: DataFrame, radius: int, step: int, band: int = BAND, columns: tuple[str, ...] = ("codes",), missing: bool = False) -> tuple[DataFrame, list[list[str]]]:
    """rows with the same-phase rows around each, for each of the columns a list of names from 2 * radius + 1 rows; the edge rows repeated, or null
    with missing. Frames are cut into bands, each with the neighbours it needs."""
    reach = radius * step
    own = F.floor(c("y") / band)
    near = F.array_distinct(F.array(own, F.greatest(F.lit(0), F.floor((c("y") - reach) / band)), F.floor((c("y") + reach) / band)))
    rows = rows.withColumn("band", F.explode(near))
    w = Window.partitionBy("frame_id", c("y") % step, "band").orderBy("y")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [[f"{name}_{k + radius}" for k in range(-radius, radius + 1)] for name in columns]
    for name, own_names in zip(columns, names, strict=True):
        for k, out in zip(range(-radius, radius + 1), own_names, strict=True):
            value = F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w) if k else c(name)
            if k and not missing:
                value = F.coalesce(value, (F.first(name) if k < 0 else F.last(name)).over(whole))
            rows = rows.withColumn(out, value)
    return rows.filter(F.floor(c("y") / band) == c("band")).drop("band"), names


def side(values: np.ndarray, k: int, step: int) -> np.ndarray:
    """The same-phase neighbour k steps on of every value along the last axis, the edge value repeated."""
    n, d = values.shape[-1], k * step
    inner, edge = (slice(0, max(0, n - d)), np.arange(max(0, n - d), n)) if d >= 0 else (slice(-d, n), np.arange(min(n, -d)))
    out = np.empty(values.shape, values.dtype)
    out[..., inner] = values[..., d:] if d >= 0 else values[..., : max(0, n + d)]
    last = (n - 1 - edge % step) // step
    out[..., edge] = values[..., edge % step + np.clip(edge // step + k, 0, last) * step]
    return out


def tables_of(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of image rows of one width, and their values as a table, in parts of at most CELLS pixels or one row; rows without values are
    left out."""
    widths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
    for w in np.unique(widths[widths > 0]):
        alike = np.flatnonzero(widths == w)
        for at in range(0, len(alike), max(1, CELLS // int(w))):
            own = alike[at : at + max(1, CELLS // int(w))]
            yield own, flat[starts[own][:, None] + np.arange(w)].astype(np.int64)


def of_rows(lists: list[pa.Array], one: Callable[[np.ndarray], np.ndarray], kind: pa.DataType, shape: Callable[[int], int]) -> pa.Array:
    """one(values) of image rows of one width at a time: values are tables of rows by pixels, one for each of the lists; shape tells the width
    of the result."""
    widths = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    given = {int(w): shape(int(w)) if w else 0 for w in np.unique(widths)}
    offsets = np.concatenate([[0], np.cumsum([given[int(w)] for w in widths])]).astype(np.int32)
    out = np.zeros(offsets[-1], kind.to_pandas_dtype())
    for w, wide in given.items():  # frames of several widths may share a batch
        own = np.flatnonzero(widths == w)
        if w:
            taken = lists if len(given) == 1 else [x.take(pa.array(own)) for x in lists]
            values = one(np.stack([x.flatten().to_numpy(zero_copy_only=False).reshape(len(own), w) for x in taken]))
            out[offsets[own][:, None] + np.arange(wide)] = values
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, kind))


def by_row(rows: DataFrame, groups: list[list[str]], names: list[str], one: Callable[[np.ndarray], np.ndarray], kind: str = "int", shape: Callable[[int], int] = lambda w: w) -> DataFrame:
    """frame_id, y and for each group of array columns its result under the name, batch by batch in numpy; no batch needs another."""
    flat, arrow = [n for own in groups for n in own], {"int": pa.int32(), "float": pa.float32()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, at = [], 2
            for own in groups:
                columns.append(of_rows([batch.column(at + i) for i in range(len(own))], one, arrow, shape))
                at += len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["frame_id", "y", *names])

    return rows.select("frame_id", "y", *flat).mapInArrow(run, "frame_id long, y int, " + ", ".join(f"{n} array<{kind}>" for n in names))


#: Pixels that leave a task at once as records.
RECORDS = 1 << 18


def wide(rows: DataFrame, *names: str) -> DataFrame:
    """frame_id, y, x and one value of each of the array columns: a record a pixel, from values as they lie in Arrow's batches. Arrays of a row are of one
    length; rows without values give no records."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(n).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            if any((own != sizes[0]).any() for own in sizes[1:]):
                raise ValueError("arrays of a row are of several lengths")
            each = max(1, RECORDS // max(1, int(sizes[0].max(initial=0))))
            for at in range(0, len(batch), each):
                some, n = batch.slice(at, each), sizes[0][at : at + each]
                line = np.repeat(np.arange(len(n)), n)
                x = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                keys = [some.column(k).take(pa.array(line)) for k in ("frame_id", "y")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(x, pa.int32()), *[some.column(k).flatten() for k in names]], names=["frame_id", "y", "x", *names])

    value = lambda n: kinds[n].removeprefix("array<").removesuffix(">")
    return rows.select("frame_id", "y", *names).mapInArrow(run, f"frame_id {kinds['frame_id']}, y {kinds['y']}, x int, " + ", ".join(f"{n} {value(n)}" for n in names))


def to_full_scale(values: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(np.floor(values * factor + 0.5), 0, 65535).astype(np.int32)


def weighted(values: list[np.ndarray], weights: list[float]) -> np.ndarray:
    total = values[0] * weights[0]
    for v, w in zip(values[1:], weights[1:], strict=True):
        total = total + v * w
    return total


def in_bands(rows: DataFrame, reach: int, band: int) -> DataFrame:
    """Each row in its band of so many rows and in those of its neighbours within reach: band is the key of a task's work."""
    at = lambda d: F.floor((c("y") + d) / band).cast("int")
    return rows.withColumn("band", F.explode(F.array_distinct(F.filter(F.array(at(-reach), at(0), at(reach)), lambda b: b >= 0))))


#: Pixels of a window's rows that are worked on at once.
CELLS = 1 << 22


#: Pixels that a filter works on at once: what a core keeps near itself.
PIECE = 1 << 15
#: Radius of a filter, and what it makes of the rows of a window: a table (row of the window, image row, pixel). Windows slide: row k + 1 of
#: one is row k of the next.
Filter = tuple[int, Callable[[np.ndarray], np.ndarray]]


def slid(v: np.ndarray) -> np.ndarray:
    """The rows over which windows slide, each once."""
    return np.concatenate([v[0], v[1:, -1]])


def filtered(values: np.ndarray, runs: np.ndarray, own: np.ndarray, radius: int, one: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows are own, and what the filter makes of them. runs numbers the rows that are neighbours, in order; windows end with their
    run, whose edge rows repeat, but many runs are worked on at once."""
    starts = np.flatnonzero(np.diff(runs, prepend=-1))
    ends, mine = np.append(starts[1:], len(runs)), np.flatnonzero(own)
    first, m = np.searchsorted(mine, starts), np.add.reduceat(own, starts, dtype=np.int64) if len(starts) else starts
    some = np.flatnonzero(m)
    if not len(some):
        return mine, np.zeros((0, values.shape[1]), np.int32)
    begun, m = mine[first[some]], m[some]
    lens = m + 2 * radius
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.clip(np.repeat(begun - radius, lens) + place, np.repeat(starts[some], lens), np.repeat(ends[some] - 1, lens))
    kept, out, done = place < np.repeat(m, lens), np.zeros((len(mine), values.shape[1]), np.int32), 0
    each = max(1, PIECE // max(1, values.shape[1]))
    for cut in range(0, len(at) - 2 * radius, each):
        n = min(each, len(at) - 2 * radius - cut)
        window = np.moveaxis(np.lib.stride_tricks.sliding_window_view(values[at[cut : cut + n + 2 * radius]], 2 * radius + 1, 0), 2, 0)
        keep = kept[cut : cut + n]
        k = int(keep.sum())
        out[done : done + k] = one(window)[keep]
        done += k
    return mine, out


def stencils(rows: DataFrame, filters: dict[str, Filter], step: int, columns: tuple[str, ...], band: int = BAND, together: int = 1, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """filter, frame_id, y and each of the columns as the filter leaves it, all filters from one pass: windows are the same-phase rows around, those
    at the edges repeated. Bands meet their neighbouring rows in tasks of their own, so a tall frame is as many tasks as it has bands;
    of small frames so many may go together. Rows without values give none, and don't count as neighbours. With fold, a whole number
    leaves in place of each row: fold of a table of filtered rows, 0 for rows without values."""
    schema = "filter string, frame_id long, y int, " + ", ".join(f"{n} {'long' if fold else 'array<int>'}" for n in columns)

    def run(key, table):
        ids, y = table.column("frame_id").combine_chunks(), table.column("y").to_numpy()
        frame = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)[1])
        order = np.lexsort((y, frame))
        table, frame, y = table.take(pa.array(order)).combine_chunks(), frame[order], y[order]
        own, made = y // band == key[1].as_py(), {n: [] for n in columns}
        for name in columns:
            lists = table.column(name).combine_chunks()
            widths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
            there = np.flatnonzero(widths)
            odd = there[1:][(frame[there[1:]] == frame[there[:-1]]) & (widths[there[1:]] != widths[there[:-1]])]
            if len(odd):
                raise ValueError(f"frame {table.column('frame_id')[int(odd[0])].as_py()} has rows of several lengths")
            if step > 1:
                there = there[np.lexsort((y[there], y[there] % step, frame[there]))]
            given = [(int(w), there[widths[there] == w]) for w in np.unique(widths[there])]
            kept = np.where(own, widths, 0)
            offsets = np.cumsum(kept) - kept
            for radius, one in filters.values():
                out, sums = np.zeros(0 if fold else kept.sum(), np.int32), np.zeros(len(y), np.int64)
                for w, which in given:  # frames of several widths may be together
                    values = flat.reshape(-1, w) if step == 1 and len(given) == 1 else flat[starts[which][:, None] + np.arange(w)]
                    mine, found = filtered(values, np.cumsum(np.diff(frame[which] * step + y[which] % step, prepend=-1) != 0), own[which], radius, one)
                    if fold:
                        sums[which[mine]] = fold(found)
                    else:
                        out[offsets[which[mine]][:, None] + np.arange(w)] = found
                made[name].append(pa.array(sums[own]) if fold else pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept[own])]), pa.int32()), pa.array(out, pa.int32())))
        n = int(own.sum())
        called = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(filters)), n), pa.int32()), pa.array(list(filters), pa.string())).cast(pa.string())
        of = table.column("frame_id").take(pa.array(np.tile(np.flatnonzero(own), len(filters))))
        return pa.table([called, of, pa.array(np.tile(y[own], len(filters)), pa.int32()), *map(pa.chunked_array, made.values())], names=["filter", "frame_id", "y", *columns])

    reach = max(radius for radius, _ in filters.values()) * step
    cut = in_bands(rows.select("frame_id", "y", *columns), reach, band)
    return cut.groupBy("frame_id" if together == 1 else F.expr(f"frame_id DIV {together}"), "band").applyInArrow(run, schema)


def stencil(rows: DataFrame, radius: int, step: int, one: Callable[[np.ndarray], np.ndarray], columns: tuple[str, ...], band: int = BAND) -> DataFrame:
    """frame_id, y and each of the columns as one filter leaves it."""
    return stencils(rows, {"one": (radius, one)}, step, columns, band).drop("filter")


def smoothing(weights: list[float], depth: int, step: int, finish: Callable) -> Filter:
    """finish(mean, 16-bit value) of the weighted mean over the window, horizontally and then vertically in the order of the offsets."""
    radius, shift = len(weights) // 2, 1 << (16 - depth)

    def one(v: np.ndarray) -> np.ndarray:
        lines, n = (slid(v) * shift).astype(np.float64), v.shape[1]
        across = weighted([side(lines, k, step) for k in range(-radius, radius + 1)], weights)
        return finish(weighted([across[k : k + n] for k in range(2 * radius + 1)], weights), lines[radius : radius + n])

    return radius, one


def separable_filter(weights: list[float], depth: int, step: int) -> Filter:
    return smoothing(weights, depth, step, lambda mean, _: to_full_scale(mean, full_scale_factor(depth)))


def unsharp_filter(weights: list[float], amount: float, depth: int, step: int) -> Filter:
    return smoothing(weights, depth, step, lambda mean, v: to_full_scale(v + amount * (v - mean), full_scale_factor(depth)))


def separable(rows: DataFrame, weights: list[float], depth: int, step: int, columns: tuple[str, ...] = ("codes",)) -> DataFrame:
    """Weighted mean over the window; 16-bit values rescaled to full scale."""
    radius, one = separable_filter(weights, depth, step)
    return stencil(rows, radius, step, one, columns)


def unsharp_mask(rows: DataFrame, weights: list[float], amount: float, depth: int, step: int, columns: tuple[str, ...] = ("codes",)) -> DataFrame:
    """v + amount * (v - weighted mean), rescaled to full scale."""
    radius, one = unsharp_filter(weights, amount, depth, step)
    return stencil(rows, radius, step, one, columns)


def box_weights(radius: int) -> list[float]:
    return [1.0 / (2 * radius + 1)] * (2 * radius + 1)


def gaussian_weights(radius: int, sigma: float) -> list[float]:
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def extreme_filter(radius: int, depth: int, step: int, largest: bool) -> Filter:
    scale, pick = full_scale_factor(depth) * (1 << (16 - depth)), np.maximum if largest else np.minimum
    return radius, lambda v: to_full_scale(pick.reduce([side(pick.reduce(v), k, step) for k in range(-radius, radius + 1)]), scale)


def extreme(rows: DataFrame, radius: int, depth: int, step: int, largest: bool, columns: tuple[str, ...] = ("codes",)) -> DataFrame:
    """Erode or dilate: minimum or maximum over the window, rescaled to 16 bit."""
    return stencil(rows, radius, step, extreme_filter(radius, depth, step, largest)[1], columns)


def median_of(radius: int, depth: int, step: int) -> Filter:
    scale, n = full_scale_factor(depth) * (1 << (16 - depth)), (2 * radius + 1) ** 2

    def one(v: np.ndarray) -> np.ndarray:
        if radius == 1 and v.dtype.kind == "i":  # of three ordered columns: the middle one of the largest low, the middle middle, the smallest high
            least, most = np.minimum(v[0], v[1]), np.maximum(v[0], v[1])
            low, middle, high = ([side(t, k, step) for k in (-1, 0, 1)] for t in (np.minimum(least, v[2]), np.maximum(least, np.minimum(most, v[2])), np.maximum(most, v[2])))
            centre = lambda a, b, d: np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), d))
            return to_full_scale(centre(np.maximum.reduce(low), centre(*middle), np.minimum.reduce(high)), scale)
        window = np.concatenate([side(v, k, step) for k in range(-radius, radius + 1)])
        return to_full_scale(np.partition(window, n // 2, 0)[n // 2], scale)

    return radius, one


def median_filter(rows: DataFrame, radius: int, depth: int, step: int, columns: tuple[str, ...] = ("codes",)) -> DataFrame:
    """Median of the same-phase window (the count is odd), rescaled to 16 bit."""
    return stencil(rows, radius, step, median_of(radius, depth, step)[1], columns)


def sobel_filter(depth: int, step: int) -> Filter:
    scale = full_scale_factor(depth) * (1 << (16 - depth))

    def one(v: np.ndarray) -> np.ndarray:
        lines, n = slid(v), v.shape[1]
        small = lines.dtype == np.int32 and lines.size and lines.max() < 1 << 16 and lines.min() >= 0  # sums fit, and their squares are exact
        left, mid, right = ([t[k : k + n] for k in range(3)] for t in (side(lines if small else lines.astype(np.int64), k, step) for k in (-1, 0, 1)))
        gx = right[0] + 2 * right[1] + right[2] - left[0] - 2 * left[1] - left[2]
        gy = left[2] + 2 * mid[2] + right[2] - left[0] - 2 * mid[0] - right[0]
        if small:
            gx, gy = gx.astype(np.float64), gy.astype(np.float64)
        return to_full_scale(np.sqrt((gx * gx + gy * gy).astype(np.float64)) / 4, scale)

    return 1, one


def sobel(rows: DataFrame, depth: int, step: int, columns: tuple[str, ...] = ("codes",)) -> DataFrame:
    """A quarter of the gradient's length, rescaled to 16 bit."""
    return stencil(rows, 1, step, sobel_filter(depth, step)[1], columns)


# --- Defects ------------------------------------------------------------------------------------------------------------------
def phase_moments(rows: DataFrame, segment: int | None = None) -> DataFrame:
    """frame_id, part, phase, n, s, s2 of each row's pixels, by exposure segment (0 without) and colour-filter phase: four records a
    frame and segment from each batch, no pixel leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, made = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), []
            for own, v in tables_of(batch.column(2)):
                each = max(1, min(segment or v.shape[1], v.shape[1]))
                for part, at in enumerate(range(0, v.shape[1], each)):
                    for parity in (0, 1):
                        some = v[:, at : at + each][:, parity::2]
                        n = np.full(len(own), some.shape[1])
                        made.append(np.stack([own, np.full(len(own), part), y[own] % 2 * 2 + parity, n, some.sum(1, dtype=np.int64), np.einsum("ij,ij->i", some, some, dtype=np.int64)]))
            columns = np.concatenate([*made, np.zeros((6, 0), np.int64)], 1)
            # What a batch holds of a frame's phase becomes one record.
            keys = pa.table([batch.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names=["frame_id", "part", "phase", "n", "s", "s2"])
            sums = keys.group_by(["frame_id", "part", "phase"]).aggregate([(k, "sum") for k in ("n", "s", "s2")])
            kinds = pa.schema([("frame_id", pa.int64()), ("part", pa.int32()), ("phase", pa.int32()), ("n", pa.int64()), ("s", pa.int64()), ("s2", pa.int64())])
            yield from sums.select(["frame_id", "part", "phase", "n_sum", "s_sum", "s2_sum"]).rename_columns(kinds.names).cast(kinds).to_batches()

    return rows.select("frame_id", "y", "codes").mapInArrow(run, "frame_id long, part int, phase int, n long, s long, s2 long").filter("n > 0")


def phase_limits(rows: DataFrame, k: float, segment: int | None = None) -> DataFrame:
    """frame_id and, as one array for each number, mean and sigma of each (part, phase), at part * 4 + phase."""
    per = phase_moments(rows, segment).groupBy("frame_id", "part", "phase").agg(*[F.sum(x).alias(x) for x in ("n", "s", "s2")])
    per = per.withColumn("t", F.struct((c("part") * 4 + c("phase")).alias("at"), (c("s") / c("n")).alias("mean"), F.sqrt(pop_variance("n", "s", "s2")).alias("sigma")))
    return per.groupBy("frame_id").agg(F.array_sort(F.collect_list("t")).alias("limits"))


def marked(rows: DataFrame, k: float, segment: int | None = None, **kept: Column) -> DataFrame:
    """Image rows with their defects: frame_id, y, codes, x and hot (arrays), mean and sigma of each. Pixels are compared with the bounds of
    their row's phases in numpy batches; frames' bounds are one record that meets their rows."""
    met = rows.select("frame_id", "y", "codes", *[v.alias(n) for n, v in kept.items()]).join(phase_limits(rows, k, segment), "frame_id")
    names = ["frame_id", "y", "codes", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, limits = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("limits")
            t, ends = limits.flatten(), np.concatenate([[0], np.cumsum(limits.value_lengths().to_numpy(zero_copy_only=False))])
            at, mean, sigma = (t.field(n).to_numpy(zero_copy_only=False) for n in ("at", "mean", "sigma"))
            found = []
            for own, v in tables_of(batch.column("codes")):
                each = max(1, min(segment or v.shape[1], v.shape[1]))
                bounds = np.full((2, len(own), -(-v.shape[1] // each) * 4), np.nan)
                sizes = ends[own + 1] - ends[own]
                line = np.repeat(np.arange(len(own)), sizes)
                from_ = np.repeat(ends[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                here = at[from_] < bounds.shape[2]  # wider rows of the frame have more segments
                bounds[:, line[here], at[from_][here]] = mean[from_][here], sigma[from_][here]
                phase = y[own] % 2 * 2
                for part, start in enumerate(range(0, v.shape[1], each)):
                    for parity in (0, 1):
                        some = v[:, start : start + each][:, parity::2]
                        m, s = bounds[:, np.arange(len(own)), part * 4 + phase + parity]
                        hot = some > (m + k * s)[:, None]
                        i, j = np.nonzero(hot | (some < (m - k * s)[:, None]))
                        found.append((own[i], start + parity + 2 * j, hot[i, j], m[i], s[i]))
            row, x, hot, m, s = (np.concatenate(v) for v in zip(*found, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), np.zeros(0)), strict=True))
            order = np.lexsort((x, row))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order], kind)) for v, kind in ((x, pa.int32()), (hot, pa.bool_()), (m, pa.float64()), (s, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *lists], names=[*names, "x", "hot", "mean", "sigma"])

    kinds = dict(met.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "x array<int>, hot array<boolean>, mean array<double>, sigma array<double>"])
    return met.mapInArrow(run, schema)


def defects(rows: DataFrame, pattern: Column, k: float, segment: int | None = None) -> DataFrame:
    """frame_id, y, x, code, channel, type and deviation in sigmas (null where sigma is 0) from image rows; strict comparisons with thresholds by channel,
    and by exposure segment of side-by-side frames. Only what is found leaves its row."""
    found = marked(rows, k, segment, pattern=pattern)
    px = found.select("frame_id", "y", "pattern", "codes", F.explode(F.arrays_zip("x", "hot", "mean", "sigma")).alias("d"))
    px = px.select("frame_id", "y", c("d.x").alias("x"), F.get("codes", c("d.x")).alias("code"), "pattern", "d.hot", "d.mean", "d.sigma")
    return px.select("frame_id", "y", "x", "code", cfa_channel("pattern", "x", "y", segment).alias("channel"), F.when(c("hot"), "hot").otherwise("dead").alias("type"), F.when(c("sigma") > 0, (c("code") - c("mean")) / c("sigma")).alias("deviation"))


def ranked_by_deviation(found: DataFrame, most: int, *keys: str) -> DataFrame:
    """The most defects that deviate most, by amount, of each key (of the whole fleet without keys), with rank from 1; ties by frame, y, x;
    unknown deviations come last. Each partition keeps its own best before anything is brought together, so no task sorts them all."""
    order = [F.abs("deviation").desc_nulls_last(), c("frame_id"), c("y"), c("x")]
    if not keys:
        return found.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most so many rows
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(c("rank") <= most)


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first most defects of each frame in y, x order, with truncated where there are more: one more is looked at, none counted."""
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("y", "x"))
    first = found.withColumn("r", rank).filter(c("r") <= most + 1)
    more = first.withColumn("truncated", F.max("r").over(Window.partitionBy("frame_id")) > most)
    return more.filter(c("r") <= most).drop("r")


def corrected(rows: DataFrame, step: int, mean: bool = False, band: int = BAND) -> DataFrame:
    """Defects of marked rows with the median, or mean, of their good neighbours: rings 1 to 3 at step, up to the first ring at which two or
    more are known; unchanged where none is. A band and its neighbouring rows meet once; a frame is as many tasks as it has bands."""
    schema = "frame_id long, y int, x int, code int, type string, corrected int, neighbours long"
    offsets = [(r, dy, dx) for r in (1, 2, 3) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if max(abs(dy), abs(dx)) == r]
    ring, down, right = (np.array(v) for v in zip(*offsets, strict=True))

    def run(key, table):
        table = table.sort_by("y").combine_chunks()
        y = table.column("y").to_numpy()
        def spread_out(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lists = table.column(name).combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            return np.repeat(np.arange(len(y)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), lists.flatten().to_numpy(zero_copy_only=False)

        (line, column, codes), (bad, _, places), (_, _, hot) = map(spread_out, ("codes", "x", "hot"))
        width, low = int(column.max(initial=-1)) + 1, int(y.min())
        values, good = np.zeros((int(y.max()) - low + 1, width), np.int64), np.zeros((int(y.max()) - low + 1, width), bool)
        values[y[line] - low, column], good[y[line] - low, column] = codes, True
        good[y[bad] - low, places] = False
        own = y[bad] // band == key[1].as_py()
        ys, xs, hot = y[bad][own], places[own], hot[own]
        ny, nx = ys[:, None] - low + down * step, xs[:, None] + right * step
        there = (ny >= 0) & (ny < len(values)) & (nx >= 0) & (nx < width)
        ny, nx = np.where(there, ny, 0), np.where(there, nx, 0)
        there &= good[ny, nx] if values.size else False
        counts = np.stack([(there & (ring <= r)).sum(1) for r in (1, 2, 3)])
        upto = np.where(counts[0] >= 2, 1, np.where(counts[1] >= 2, 2, 3))
        there &= ring <= upto[:, None]
        n = there.sum(1)
        near = np.where(there, values[ny, nx] if values.size else 0, np.iinfo(np.int64).max)
        if mean:
            value = np.where(there, near, 0).sum(1) / np.maximum(n, 1)
        else:
            near.sort(1)
            pick = lambda at: near[np.arange(len(near)), np.maximum(at, 0)]
            value = (pick((n - 1) // 2) + pick(n // 2)) / 2
        code = values[ys - low, xs] if values.size else np.zeros(0, np.int64)
        fixed = np.where(n > 0, np.floor(np.where(n > 0, value, 0) + 0.5), code).astype(np.int64)
        return pa.table([pa.array([key[0].as_py()] * len(ys), pa.int64()), pa.array(ys, pa.int32()), pa.array(xs, pa.int32()), pa.array(code, pa.int32()), pa.array(np.where(hot, "hot", "dead").tolist(), pa.string()), pa.array(fixed, pa.int32()), pa.array(n, pa.int64())], names=[part.split()[0] for part in schema.split(", ")])

    return in_bands(rows.select("frame_id", "y", "codes", "x", "hot"), 3 * step, band).groupBy("frame_id", "band").applyInArrow(run, schema)


# --- Exposures ----------------------------------------------------------------------------------------------------------------
def split_exposures(rows: DataFrame, stages: int, block: int, height: str, offset: int = 0) -> DataFrame:
    """Line-interleaved frames to one frame per stage: arithmetic on y alone. Each stage reads offset rows later than the one before it, so
    they are cut to the sensor rows that all of them have."""
    period, spread = stages * block, offset * (stages - 1)
    lowest = min(0, spread)
    keep = F.floor(c(height) / period) * block - abs(spread)
    stage = (F.floor(c("y") / block) % stages).cast("int")
    sub = F.floor(c("y") / period) * block + c("y") % block - (offset * stage - lowest)
    out = rows.withColumn("stage", stage).withColumn("sub_y", sub.cast("int"))
    return out.filter((c("sub_y") >= 0) & (c("sub_y") < keep) & (c("y") < F.floor(c(height) / period) * period)).select("frame_id", "stage", c("sub_y").alias("y"), "codes")


def merge_exposures(split: DataFrame, ratio: float, black: float, depth: int, saturation: float = 0.9, blend: float = 0.1, stages: int = 2) -> DataFrame:
    """Two or three stages (0 the longest) to float32 radiance: stage k, scaled by the ratio to the power of k, takes over where what is merged
    so far nears its saturation. One aggregate brings the stages of a row together; there is no join."""
    shift = 1 << (16 - depth)
    linear = float(((1 << depth) - 1) * shift) - black
    if linear <= 0 or stages not in (2, 3):
        raise ValueError("the black level must lie below the largest code, and stages are 2 or 3")
    names = [f"s{k}" for k in range(stages)]
    met = split.groupBy("frame_id", "y").agg(*[F.max(F.when(c("stage") == k, c("codes"))).alias(n) for k, n in enumerate(names)])
    f = np.float32

    def one(v: np.ndarray) -> np.ndarray:
        lines = (v * shift).astype(f) - f(black)
        merged = lines[0]
        for k in range(1, stages):
            full = linear * ratio ** (k - 1)
            t1 = saturation * full
            t0 = t1 - blend * full if t1 - blend * full > 0 else t1 / 2
            scaled = lines[k] * f(ratio**k)
            t = (merged - f(t0)) / f(t1 - t0)
            smooth = merged + (scaled - merged) * (t * t * (f(3) - f(2) * t))
            merged = np.where(merged <= f(t0), merged, np.where(merged >= f(t1), scaled, smooth))
        return merged

    return by_row(met.filter(" and ".join(f"{n} is not null" for n in names)), [names], ["values"], one, "float")


def quantized(merged: DataFrame, full_scale: float) -> DataFrame:
    scale = 65535.0 / full_scale if full_scale > 0 else 0.0
    return by_row(merged, [["values"]], ["codes"], lambda v: np.clip(np.rint(np.maximum(v[0].astype(np.float64), 0) * scale), 0, 65535).astype(np.int32))


def side_by_side(split: DataFrame) -> DataFrame:
    """The stages of each row beside each other, the longest exposure first; a segment is one stage wide."""
    stages = F.array_sort(F.collect_list(F.struct("stage", "codes")))
    return split.groupBy("frame_id", "y").agg(F.flatten(F.transform(stages, lambda s: s["codes"])).alias("codes"))


def quantization(full_scale: Column, depth: Column) -> tuple[Column, Column]:
    """Step of 16-bit values over the full scale, and the bits lost against the source's step."""
    step = F.when(full_scale > 0, full_scale / 65535.0).otherwise(0.0)
    own = F.pow(F.lit(2.0), 16 - depth)
    return step, F.when(step > own, F.log2(step / own)).otherwise(0.0)


# --- Colour -------------------------------------------------------------------------------------------------------------------
def display_transfer(code: Column, black: float, white: float, gain: float = 1.0, contrast: float = 1.0, gamma: float = 2.2) -> Column:
    """Code to 8 bit: levels, gain, contrast about one half, clamp, gamma; white at or below black makes a step."""
    if white <= black:
        return F.when(code >= white, 255).otherwise(0)
    v = (code - F.lit(float(black))) / F.lit(float(white - black)) * F.lit(gain)
    v = clamp((v - 0.5) * F.lit(contrast) + 0.5, F.lit(0.0), F.lit(1.0))
    return F.rint(F.pow(v, F.lit(1.0 / gamma)) * 255).cast("int")
