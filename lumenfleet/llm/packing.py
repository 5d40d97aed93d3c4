"""Bounded-space online packing of tokenized documents into sequences.

Every partition keeps a fixed number of open windows. A piece goes to the window where it fits with the least room left; when it
fits none, the fullest is topped up with the piece's head and emitted, and the rest of the piece goes on. Windows still open at
a partition's end are merged over ever fewer partitions by the same rule, and the last ones into each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import key_first, staged
from .units import document_ids, in_chunks, word_level_ids

LENGTH = 2048
WINDOWS = 32
#: Partitions whose open windows meet in one task of the next pass.
FAN_IN = 64

NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
KINDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Open windows of one task. emit() collects rows; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.windows, self.next = length, windows, first_sequence
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], final: bool = True) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), doc_tokens, self.next, offset, None if final else raw))
            offset += len(ids)
        self.next += 1

    def place(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[: self.length], doc_tokens)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.length]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
            n = min(len(ids), self.length - best[0])
            best[0] += n
            best[1].append((doc, start, ids[:n], doc_tokens))
            start, ids = start + n, ids[n:]
            if best[0] == self.length:
                self.emit(best[1])
                self.open.remove(best)

    def close(self, last: bool) -> None:
        """The open windows: kept for the next pass, or merged here so that one sequence at most stays short."""
        rest, self.open = sorted(self.open, key=lambda w: -w[0]), []
        if last:
            self.windows = 1
            for _, pieces in rest:
                for p in pieces:
                    self.place(*p)
            rest, self.open = self.open, []
        for _, pieces in rest:
            self.emit(pieces, final=last)

    def batch(self, id_col: str, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.binary())], names=[id_col, *NAMES])


def first_sequence(level: int, partition: int) -> int:
    return (level << 57) + (partition << 33)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id of every document, end_id behind it, lies in
    exactly one piece; sequences hold length ids but for the very last of all, which is padded unless its length is a power of two.

    Null and empty texts are one end_id. Repeated rows are packed each for itself, an empty table gives no pieces, other columns
    are ignored. A task holds its open windows only; the passes over what is left take FAN_IN times fewer tasks each.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {KINDS}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_level_ids(path)
        packer = Packer(first_sequence(0, TaskContext.get().partitionId()), length, windows)
        own = None
        for batch in batches:
            own = batch.column(0).type
            docs = batch.column(0).to_pylist()
            for at, chunk in in_chunks(batch.column(1).to_pylist()):
                ids, sizes = document_ids(table, chunk)
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end_id)
                cuts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                for k in range(len(chunk)):
                    packer.place(docs[at + k], 0, whole[cuts[k] : cuts[k + 1]], int(cuts[k + 1] - cuts[k]))
                yield packer.batch(id_col, own)
        if own is not None:
            packer.close(last=False)
            yield packer.batch(id_col, own)

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(first_sequence(level, TaskContext.get().partitionId()), length, windows)
            own = None
            for batch in batches:
                own = batch.column(0).type
                for r in zip(*[batch.column(c).to_pylist() for c in (id_col, "start", "ids", "doc_tokens")], strict=True):
                    packer.place(r[0], r[1], np.frombuffer(r[2], "<u4"), r[3])
                yield packer.batch(id_col, own)
            if own is not None:
                packer.close(last)
                yield packer.batch(id_col, own)

        return run

    packed = staged(key_first(docs, id_col, text_col).mapInArrow(first, schema), "packed")
    done = [packed.filter("ids IS NULL")]
    left, level = packed.filter("ids IS NOT NULL"), 0
    tasks = left.select(F.shiftright("sequence_id", 33).alias("p")).distinct().count()
    while tasks:
        level, last, tasks = level + 1, tasks <= FAN_IN, -(-tasks // FAN_IN)
        together = left.repartition(tasks).sortWithinPartitions("sequence_id", "offset")
        merged = staged(together.mapInArrow(merge(level, last), schema), "packed")
        done.append(merged.filter("ids IS NULL"))
        left = merged.filter("ids IS NOT NULL")
        tasks = 0 if last else tasks
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("ids")
