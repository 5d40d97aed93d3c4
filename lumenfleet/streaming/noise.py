"""Noise between consecutive frames of a sensor, as frames arrive: the state of a sensor's band of rows is what waits and the rows that came last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c, cfa_channel
from ..operators.measure import pair_moments, pair_noise, paired_phases

MOMENTS = "sensor long, frame long, y int, parity int, n long, s long, s2 long, ds long, ds2 long"
_STATE = "last binary, held binary"
#: Image rows of a sensor whose state stands together: a call, and an entry of the state, for so many rows.
BAND = 64
_ROWS = ("frame", "ms", "y")


class Rows:
    """Image rows one after another: frame, ms and y of each, its codes from ends[i] to ends[i + 1]."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, ends: np.ndarray):
        self.keys, self.codes, self.ends = keys, codes, ends

    @classmethod
    def of(cls, frame, ms, y, codes: list) -> Rows:
        lists = [np.asarray(v, np.int32) for v in codes]
        keys = np.stack([np.asarray(v, np.int64) for v in (frame, ms, y)])
        return cls(keys, np.concatenate([*lists, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int64))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(p.ends) for p in parts]])
        return cls(np.concatenate([np.zeros((3, 0), np.int64), *[p.keys for p in parts]], 1), np.concatenate([np.zeros(0, np.int32), *[p.codes for p in parts]]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def take(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.ends)[which]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.repeat(self.ends[which] - ends[:-1], sizes) + np.arange(ends[-1])
        return Rows(self.keys[:, which], self.codes[at], ends)

    def packed(self) -> bytes | None:
        """As an Arrow stream, codes in two bytes where they fit."""
        if not len(self):
            return None
        narrow = len(self.codes) == 0 or (self.codes.min() >= 0 and self.codes.max() < 1 << 16)
        codes = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.codes.astype(np.uint16) if narrow else self.codes))
        table = pa.table([*map(pa.array, self.keys), codes], names=[*_ROWS, "codes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, raw: bytes | None) -> Rows:
        if raw is None:
            return cls.joined([])
        table = pa.ipc.open_stream(bytes(raw)).read_all().combine_chunks()
        codes = table.column("codes").combine_chunks()
        return cls(np.stack([table.column(k).to_numpy() for k in _ROWS]), codes.values.to_numpy().astype(np.int32), codes.offsets.to_numpy().astype(np.int64))

    def __len__(self) -> int:
        return self.keys.shape[1]


def passed(last: Rows, rows: Rows, mark: int, idle_ms: int) -> tuple[np.ndarray, Rows, Rows]:
    """frame, y and moments of the pairs that the watermark has passed, what came last of each y, and what waits."""
    frame, ms, y = rows.keys
    if not len(last) and (ms > mark).all():  # nothing is due
        return np.zeros((0, len(MOMENTS.split(", ")) - 1), np.int64), last, rows
    waiting = rows.take(np.flatnonzero(ms > mark))
    after = np.full(len(rows), np.iinfo(np.int64).min)
    if len(last) and len(rows):
        at = np.minimum(np.searchsorted(last.keys[2], y), len(last) - 1)  # last is sorted by y
        after = np.where(last.keys[2][at] == y, last.keys[0][at], after)
    due = Rows.joined([last, rows.take(np.flatnonzero((ms <= mark) & (frame > after)))])
    order = np.lexsort((due.keys[1], due.keys[0], due.keys[2]))
    frame, ms, y = due.keys[:, order]
    first = np.ones(len(order), bool)
    first[1:] = (y[1:] != y[:-1]) | (frame[1:] != frame[:-1])  # of rows that repeat, the earliest
    due = due.take(order[first])
    frame, ms, y = due.keys
    pairs = 1 + np.flatnonzero((y[1:] == y[:-1]) & (frame[1:] == frame[:-1] + 1) & (ms[1:] - ms[:-1] <= idle_ms))
    a, b = due.take(pairs - 1), due.take(pairs)
    which, numbers = paired_phases(a.codes, a.ends, b.codes, b.ends)
    own = np.repeat(pairs[which], 2)
    found = np.column_stack([frame[own], y[own], numbers])
    ends = np.ones(len(due), bool)
    ends[:-1] = y[1:] != y[:-1]
    kept = ends & ((ms + idle_ms > mark) | np.isin(y, waiting.keys[2]))
    return found, due.take(np.flatnonzero(kept)), waiting


def consecutive_moments(rows: DataFrame, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """sensor, frame, y, parity and the moments of each row and its predecessor's (a is the frame before): rows (sensor, frame, ts, y, codes).

    Frames of a sensor are numbered in order of time. A pair is two frames with successive numbers: a frame that is missing, or whose
    rows have another length, makes none with either neighbour. On a stream, rows wait until the watermark has passed them, so
    that frames may arrive in any order within the bound; later ones are dropped, and count as missing. Of rows that repeat
    sensor, frame and y one counts, on a stream the one with the earliest ts. A sensor's row forgets its last frame idle_ms after it
    (by the watermark); a batch forgets nothing. State is kept by sensor and band of BAND rows: what waits, and one row for each y.
    """
    own = rows.select(c("sensor").cast("long"), c("frame").cast("long"), "ts", c("y").cast("int"), "codes")
    if not rows.isStreaming:
        # One of the rows that repeat a key counts; successive frames meet by an equi join, so no sensor's history stands in one task.
        once = own.groupBy("sensor", "frame", "y").agg(F.min_by("codes", "ts").alias("b"))
        before = once.select("sensor", (c("frame") + 1).alias("frame"), "y", c("b").alias("a"))
        return pair_moments(before.join(once, ["sensor", "frame", "y"]), "sensor", "frame")

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [part.split()[0] for part in MOMENTS.split(", ")]

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        last, held = map(Rows.unpacked, state.get if state.exists else (None, None))
        parts = [held]
        if not state.hasTimedOut:
            parts += [Rows.of(some["frame"], some["ms"], some["y"], some["codes"].to_list()) for some in frames]
        mark = state.getCurrentWatermarkMs()
        found, last, waiting = passed(last, Rows.joined(parts), mark, idle_ms)
        if not len(waiting) and not len(last):
            if state.exists:
                state.remove()
        else:
            state.update((last.packed(), waiting.packed()))
            alone = last.keys[1][~np.isin(last.keys[2], waiting.keys[2])] + idle_ms
            state.setTimeoutTimestamp(int(max(mark + 1, np.concatenate([waiting.keys[1], alone]).min())))
        out = pd.DataFrame(np.column_stack([np.full(len(found), key[0], np.int64), found]), columns=names)
        yield out.astype({"y": "int32", "parity": "int32"})

    marked = own.withWatermark("ts", late).withColumns({"band": F.floor(c("y") / BAND).cast("int"), "ms": F.unix_millis("ts")})  # pandas would see local time
    return marked.groupBy("sensor", "band").applyInPandasWithState(step, MOMENTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def frame_noise(moments: DataFrame, pattern: Column, saturation: int) -> DataFrame:
    """sensor, frame and the pair noise of each frame and the one before; pattern is the colour filter of a record's frame."""
    channelled = moments.withColumn("channel", cfa_channel(pattern, "parity", "y"))
    return pair_noise(channelled, ["sensor", "frame"], saturation)
