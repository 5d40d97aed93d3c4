"""Token-id files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

A file is a row of blocks. Each block holds first one control byte for every four ids (two bits each: how many bytes the id
takes, less one), then the data bytes, little-endian. Ids are written as their rank by corpus frequency, so that the 256 most
frequent take one byte. Reading looks up a control byte's four lengths in a table and gathers all ids of a block with numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import dropped, key_first, scratch, staged
from .units import byte_level_ids, document_ids, in_chunks

#: Lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
BLOCK_IDS = 1_000_000
FILE_IDS = 16_000_000


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= extra[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    starts = ends - lengths
    for k in range(int(lengths.max(initial=0))):
        has = lengths > k
        out[has] |= raw[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_by_frequency(counts: np.ndarray) -> np.ndarray:
    """order[r]: the id of rank r; ties to the smaller id."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def filesystem(uri: str):
    """The file system and the path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def encode_documents(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (little-endian unsigned 32-bit) of every document, end_id behind it; null reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_level_ids(path)
        for batch in batches:
            for first, chunk in in_chunks(batch.column(1).to_pylist()):
                ids, sizes = document_ids(table, chunk)
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end_id).astype("<u2" if ids.max(initial=0) < 1 << 16 > end_id else "<u4")
                at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * whole.itemsize
                raw = whole.tobytes()
                parts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(chunk)), pa.array(sizes + 1), pa.array(np.full(len(chunk), whole.itemsize, np.int32)), pa.array(parts, pa.binary())], names=[id_col, "n", "width", "ids"])

    return key_first(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n long, width int, ids binary")


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus. To the driver comes one row per vocabulary entry at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            widths = batch.column(1).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                raw = batch.column(0).filter(pa.array(widths == width))  # documents lie one after another: counted together, not one by one
                ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
                ids = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"<u{width}")
                for at in range(0, len(ids), BLOCK_IDS):
                    own = np.bincount(ids[at : at + BLOCK_IDS])
                    if len(own) > len(total):
                        total = np.pad(total, (0, len(own) - len(total)))
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = encoded.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, np.ndarray]:
    """Tokenize all documents and write their ids in ascending order of id_col.

    Returns the block index (one row per block of about a million ids: shard, block, file, at, control_bytes, data_bytes, n_ids, doc_ids,
    doc_n), the folder and the table from rank to id. Nulls sort first; rows with the same id follow by their number of ids, then by a hash of them.
    Files have names of their own for each attempt, and the index names those that counted, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    encoded = staged(encode_documents(docs, path, end_id, id_col, text_col), "token-ids")
    counts = id_counts(encoded)
    order = rank_by_frequency(counts)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number per vocabulary entry
    files = max(1, -(-int(counts.sum()) // FILE_IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shard = shared.value, TaskContext.get().partitionId()
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        name, out, at, block = f"{shard:06d}-{uuid.uuid4().hex}.ids", None, 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out, at, block
            out = out or system.open_output_stream(f"{base}/{name}")
            ids = np.concatenate([x[1] for x in held])
            control, data = encode_block(rank[ids])
            out.write(control + data)
            row = [shard, block, name, at, len(control), len(data), len(ids), [x[0] for x in held], [len(x[1]) for x in held]]
            at, block = at + len(control) + len(data), block + 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        kind = None
        size = 0
        for batch in batches:
            kind = batch.column(0).type
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64())]
            for doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((doc, np.frombuffer(raw, f"<u{width}")))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        if out:
            out.close()

    names = ["shard", "block", "file", "at", "control_bytes", "data_bytes", "n_ids", "doc_ids", "doc_n"]
    kind = dict(docs.dtypes)[id_col]
    keys = [F.col(id_col), F.col("n"), F.xxhash64("ids")]  # a full order: what starts where is the same in every run
    ordered = encoded.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select(id_col, "width", "ids")
    index = ordered.mapInArrow(run, f"shard long, block long, file string, at long, control_bytes long, data_bytes long, n_ids long, doc_ids array<{kind}>, doc_n array<long>")
    index = staged(index, "token-index")
    dropped(encoded)
    return index, folder, order


def read_token_files(index: DataFrame, folder: str, order: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit)."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(order)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    # Running sums in two levels: blocks within their shard, then one row per shard.
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("all")).select("shard", (F.sum("all").over(outer) - F.col("all")).alias("before"))
    placed = index.withColumn("start", F.sum("n_ids").over(inner) - F.col("n_ids")).join(shards, "shard")
    placed = placed.select("file", "at", "control_bytes", "data_bytes", "n_ids", "doc_ids", "doc_n", (F.col("start") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        system, base = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(r["at"])
                    control, data = f.read(r["control_bytes"]), f.read(r["data_bytes"])
                raw = order[decode_block(control, data, r["n_ids"])].astype("<u4").tobytes()
                sizes = np.array(r["doc_n"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                for i in range(0, len(sizes), 1000):
                    some = slice(i, i + 1000)
                    parts = [raw[4 * a : 4 * b] for a, b in zip(starts[some], ends[some], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"][some], batch.schema.field("doc_ids").type.value_type), pa.array(starts[some] + r["start"]), pa.array(sizes[some]), pa.array(parts, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    # A block is some megabytes: few to a batch, dealt out again since the index itself is small.
    return placed.repartition(F.col("file"), F.col("at")).mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
