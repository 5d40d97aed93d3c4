"""Files of headerless frames as tables: a catalogue that opens nothing, a data source that reads byte ranges, and a sink that commits.

`spark.read.format("raw_frames")` reads files of one format; read_frames reads files whose formats stand in a table. Both cut files into
ranges of image rows, so that a file of any size is read by many tasks, and each task holds one band. The sink writes each file under a
name of its task's attempt; what committed tasks wrote counts, and gets its own name afterwards.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.semantics import c
from ..operators.formats import extension_of, folder_of, frame_bytes, frames_of

SCHEMA = "path string, frame long, y int, codes array<int>"
#: Bytes that a task reads at once, and in all.
BAND_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Bands to a task at most: small files cost their opening, not their bytes.
TASK_BANDS = 1000
#: Files to a task at most that reads them whole.
TASK_FILES = 4096
#: Where a sink's unfinished files lie, and the note that makes them count.
ATTEMPTS, COMMITTED = "_attempts", "_committed"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. URIs go by the file systems that Arrow knows."""
    if path.startswith("/") or path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def container(depth: int, endianness: str) -> np.dtype:
    return np.dtype("u1" if depth <= 8 else ">u2" if endianness == "Big" else "<u2")


def decoded(raw: bytes, depth: int, packing: str, endianness: str) -> np.ndarray:
    """Codes of containers; bits outside the codes are dropped."""
    codes = np.frombuffer(raw, container(depth, endianness)).astype(np.int32)
    return (codes >> (16 - depth if packing == "Msb" and depth > 8 else 0)) & ((1 << depth) - 1)


def encoded(codes: np.ndarray, depth: int, packing: str, endianness: str, padding: int = 0) -> bytes:
    """Containers of codes. padding fills the bits that hold none, where there are any."""
    shift = 16 - depth if depth > 8 else 0
    fill = padding & ((1 << shift) - 1)
    values = (codes << shift | fill) if packing == "Msb" else (codes | fill << depth)
    return values.astype(container(depth, endianness)).tobytes()


def catalogue(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, folder, name, ext, length, modified of the files in a folder. No content is read: the scan is pruned to what listing gives, and
    its splits (32 files each, as Spark takes a file to cost 4 MB of reading) are put together to a few tasks a core."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    scan = scan.coalesce(4 * spark.sparkContext.defaultParallelism)
    name = F.substring_index("path", "/", -1)
    return scan.select("path", folder_of("path").alias("folder"), name.alias("name"), extension_of("path").alias("ext"), "length", c("modificationTime").alias("modified"))


# Reading ---------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How a file's frames lie in it."""

    width: int
    height: int
    depth: int
    packing: str = "Lsb"
    endianness: str = "Little"
    header: int = 0
    frames: int | None = None

    @property
    def line(self) -> int:
        return self.width * (1 if self.depth <= 8 else 2)

    def there(self, length: int) -> int:
        """Whole frames in a file of this length; what was declared must be there."""
        whole = max(0, length - self.header) // (self.line * self.height)
        if self.frames is not None and whole < self.frames:
            raise ValueError(f"the file has {length} bytes, {self.header + self.frames * self.line * self.height} are declared")
        return whole if self.frames is None else self.frames

    @classmethod
    def of(cls, options: dict) -> Layout:
        own = cls(int(options["width"]), int(options["height"]), int(options["bit_depth"]), options.get("packing", "Lsb"), options.get("endianness", "Little"), int(options.get("header", 0)), int(options["frames"]) if options.get("frames") else None)
        if own.width <= 0 or own.height <= 0 or own.header < 0 or own.depth not in (8, 10, 12, 14, 16) or own.packing not in ("Lsb", "Msb") or own.endianness not in ("Little", "Big"):
            raise ValueError(f"not a format: {own}")
        return own


@dataclass
class Ranges(InputPartition):
    """Runs of image rows: (path, first row counted through the file's frames, how many)."""

    runs: list[tuple[str, int, int]] = field(default_factory=list)
    bytes: int = 0


def row_runs(path: str, frames: range, rows: range, height: int) -> Iterator[tuple[str, int, int]]:
    """The wanted rows of the wanted frames as runs: all in one where whole frames are wanted."""
    if len(frames) and len(rows) == height:
        yield path, frames.start * height, len(frames) * height
    elif len(rows):
        for frame in frames:
            yield path, frame * height + rows.start, len(rows)


def dealt(runs: Iterator[tuple[str, int, int]], line: int, most: int) -> list[Ranges]:
    """Runs cut and put together to about so many bytes each."""
    out = [Ranges()]
    each = max(1, most // line)
    for path, first, n in runs:
        for at in range(0, n, each):
            part = min(each, n - at)
            if out[-1].bytes and out[-1].bytes + part * line > most:
                out.append(Ranges())
            out[-1].runs.append((path, first + at, part))
            out[-1].bytes += part * line
    return [r for r in out if r.runs]


def bands(path: str, first: int, n: int, layout: Layout, band: int = BAND_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(row counted through the file's frames, codes by row) of a run, band by band."""
    system, own = opened(path)
    each = max(1, band // layout.line)
    with system.open_input_file(own) as file:
        for at in range(first, first + n, each):
            rows = min(each, first + n - at)
            raw = file.read_at(rows * layout.line, layout.header + at * layout.line)
            if len(raw) != rows * layout.line:
                raise ValueError(f"{path} ends within row {at + len(raw) // layout.line}")
            yield at, decoded(raw, layout.depth, layout.packing, layout.endianness).reshape(rows, layout.width)


def as_lists(codes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))


class RawFrames(DataSource):
    """Options: width, height, bit_depth, packing (Lsb, Msb), endianness (Little, Big), header (bytes), frames (all whole ones where it is not
    given), glob, task_bytes. A schema without codes reads no bytes. Comparisons of path, frame and y with
    constants decide which ranges are read."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(dict(self.options), schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are never replaced: append to a folder, or name a new one")
        if schema.fieldNames() != ["name", "part", "data"]:
            raise ValueError("the sink takes name, part, data")
        return RawWriter(self.options["path"])


class RawReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns, self.layout = options, columns, Layout.of(options)
        self.paths: set[str] | None = None
        self.least, self.most = {"frame": 0, "y": 0}, {"frame": 1 << 62, "y": self.layout.height - 1}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "path" and isinstance(f, (EqualTo, In)):
                found = set(f.value if isinstance(f, In) else [f.value])
                self.paths = found if self.paths is None else self.paths & found
            elif name in self.least and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) or name in self.least and isinstance(f, (LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least[name] = max(self.least[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most[name] = min(self.most[name], f.value - isinstance(f, LessThan))
            else:
                yield f

    def files(self) -> Iterator[tuple[str, int]]:
        """(path, length); a folder is read through, names that begin with a dot or a low line are left out."""
        system, own = opened(self.options["path"])
        found = system.get_file_info(own)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        infos = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(own, recursive=True))
        uri = self.options["path"]
        prefix = "file:" if uri.startswith(("/", "file:")) else uri.split("://")[0] + "://"  # as Spark's own listing has it
        inner = len(own.rstrip("/"))
        for f in sorted((x for x in infos if x.type == pafs.FileType.File), key=lambda x: x.path):
            hidden = any(p[:1] in "._" for p in f.path[inner:].strip("/").split("/")) if f is not found else False
            if not hidden and fnmatch.fnmatch(f.base_name, self.options.get("glob", "*")):
                yield prefix + f.path, f.size

    def partitions(self) -> list[Ranges]:
        def runs() -> Iterator[tuple[str, int, int]]:
            for path, length in self.files():
                if self.paths is None or path in self.paths:
                    n = self.layout.there(length)
                    yield from row_runs(path, range(self.least["frame"], min(self.most["frame"] + 1, n)), range(self.least["y"], self.most["y"] + 1), self.layout.height)

        return dealt(runs(), self.layout.line, int(self.options.get("task_bytes", TASK_BYTES)))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, first, n in partition.runs:
            without = [(at, None) for at in range(first, first + n, 1 << 16)]
            for at, codes in bands(path, first, n, self.layout) if "codes" in self.columns else without:
                rows = np.arange(at, at + len(codes) if codes is not None else min(at + (1 << 16), first + n))
                made = {"path": lambda: pa.array([path] * len(rows)), "frame": lambda: pa.array(rows // self.layout.height, pa.int64()), "y": lambda: pa.array(rows % self.layout.height, pa.int32()), "codes": lambda: as_lists(codes)}
                yield pa.RecordBatch.from_arrays([made[k]() for k in self.columns], names=self.columns)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions reach it (Spark refuses sources that take them where that is off)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFrames)


def read_frames(files: DataFrame, band_bytes: int = BAND_BYTES, task_bytes: int = TASK_BYTES, only: Column | None = None) -> DataFrame:
    """path, frame, y, codes of files (path, length, width, height, bit_depth, packing, endianness, header, frames), each by its own format.

    The plan of bands (path, frame, y, rows, offset) is a table: only, a condition on it, says which are read. Bands are dealt evenly to as many
    tasks as their bytes and their number ask for; what small files give is handed on together. Frames that are not there whole are left out; formats should be checked first (broken_rules).
    """
    line = F.expr("CAST(width AS BIGINT) * IF(bit_depth <= 8, 1, 2)")
    each = frames_of(files).withColumn("line", line).withColumn("rows", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(band_bytes) / c("line"))).cast("int"))
    cut = each.select("path", "frame", "offset", "width", "bit_depth", "packing", "endianness", "line", F.explode(F.sequence(F.lit(0), c("height") - 1, c("rows"))).alias("y"), F.col("rows").alias("most"), "height")
    plan = cut.select("path", "frame", "y", F.least("most", c("height") - c("y")).alias("rows"), (c("offset") + c("y") * c("line")).alias("offset"), "width", "bit_depth", "packing", "endianness")
    plan = plan if only is None else plan.filter(only)
    total, n = plan.agg(F.sum(F.expr("CAST(rows AS BIGINT) * width * IF(bit_depth <= 8, 1, 2)")), F.count(F.lit(1))).first()

    def together(held: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(codes) for *_, codes in held]
        own = np.repeat(np.arange(len(held)), sizes)
        widths = np.repeat([codes.shape[1] for *_, codes in held], sizes)
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), pa.array(np.concatenate([codes.ravel() for *_, codes in held]), pa.int32()))
        rows = np.concatenate([np.arange(at, at + k) for (_, _, at, _), k in zip(held, sizes, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]).take(pa.array(own)), pa.array(np.array([h[1] for h in held])[own], pa.int64()), pa.array(rows, pa.int32()), codes], names=["path", "frame", "y", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                layout = Layout(r["width"], r["rows"], r["bit_depth"], r["packing"], r["endianness"], r["offset"])
                for at, codes in bands(r["path"], 0, r["rows"], layout, band_bytes):
                    if held and values + codes.size > band_bytes // 8:
                        yield together(held)
                        held, values = [], 0
                    held.append((r["path"], r["frame"], at + r["y"], codes))
                    values += codes.size
        if held:
            yield together(held)

    return plan.repartition(max(1, -(-(total or 0) // task_bytes), -(-n // TASK_BANDS))).mapInArrow(run, SCHEMA)


def digests(files: DataFrame, folder: str, band_bytes: int = BAND_BYTES) -> DataFrame:
    """name, bytes, sha256 of the files (name) as they lie in folder; names without a file give none. Tasks open them by their names, a band at a
    time, so that no list of the folder's files stands on the driver."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = opened(root)
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                try:
                    file = system.open_input_stream(f"{own}/{name}")
                except FileNotFoundError:
                    continue
                digest, n = hashlib.sha256(), 0
                with file:
                    while some := file.read(band_bytes):
                        digest.update(some)
                        n += len(some)
                found.append((name, n, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["name", "bytes", "sha256"])

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // TASK_FILES))
    return files.select("name").repartition(tasks).mapInArrow(run, "name string, bytes long, sha256 string")


# Writing ---------------------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int
    bytes: int


class RawWriter(DataSourceArrowWriter):
    """Rows (name, part, data), all of a name in one partition and in order of part, to one file each."""

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt = f"{self.job}-{uuid.uuid4().hex}"
        system, own = opened(f"{self.folder}/{ATTEMPTS}/{attempt}")
        system.create_dir(own, recursive=True)
        files: list[dict] = []
        out = name = None
        try:
            for batch in iterator:
                data = batch.column(2).cast(pa.large_binary()).fill_null(b"")
                ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                whole = memoryview(data.buffers()[2] or b"")
                at = 0
                for row_name, same in groupby(batch.column(0).to_pylist()):  # the rows of a name are written at once
                    first, at = at, at + sum(1 for _ in same)
                    if row_name != name:
                        if out:
                            out.close()
                        if any(f["name"] == row_name for f in files[-1:]) or not row_name or "/" in row_name or row_name[0] in "._":
                            raise ValueError(f"not a file name: {row_name!r}")
                        name, out = row_name, system.open_output_stream(f"{own}/{len(files)}")
                        files.append({"name": name, "file": f"{attempt}/{len(files)}", "bytes": 0, "sha256": hashlib.sha256()})
                    raw = whole[ends[first] : ends[at]]
                    out.write(raw)
                    files[-1]["bytes"] += len(raw)
                    files[-1]["sha256"].update(raw)
        finally:
            if out:
                out.close()
        if len({f["name"] for f in files}) < len(files):
            raise ValueError("the rows of a name must follow each other")
        with system.open_output_stream(f"{own}/files.json") as note:
            note.write("".join(json.dumps(f | {"sha256": f["sha256"].hexdigest()}) + "\n" for f in files).encode())
        return Written(attempt, len(files), sum(f["bytes"] for f in files))

    def commit(self, messages: list[Written | None]) -> None:
        """One note, renamed into place, makes all files of the job count."""
        system, own = opened(f"{self.folder}/{COMMITTED}")
        system.create_dir(own, recursive=True)
        with system.open_output_stream(f"{own}/.{self.job}") as note:
            note.write("".join(json.dumps({"attempt": m.attempt, "files": m.files, "bytes": m.bytes}) + "\n" for m in messages if m).encode())
        system.move(f"{own}/.{self.job}", f"{own}/{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing counts without the note; what was written goes."""
        system, own = opened(f"{self.folder}/{ATTEMPTS}")
        for info in system.get_file_info(pafs.FileSelector(own, allow_not_found=True)):
            if info.base_name.startswith(self.job):
                system.delete_dir(info.path)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """name, file (below the attempts), bytes, sha256 of all files that count. Attempts that did not commit are not among them."""
    system, own = opened(f"{folder.rstrip('/')}/{COMMITTED}")
    empty = spark.createDataFrame([], "name string, file string, bytes long, sha256 string")
    if not any(f.base_name.endswith(".json") for f in system.get_file_info(pafs.FileSelector(own, allow_not_found=True))):
        return empty
    notes = spark.read.schema("attempt string, files long, bytes long").json(f"{folder.rstrip('/')}/{COMMITTED}/*.json").filter("files > 0")
    listed = spark.read.schema("name string, file string, bytes long, sha256 string").option("recursiveFileLookup", "true").option("pathGlobFilter", "files.json").json(f"{folder.rstrip('/')}/{ATTEMPTS}/*/files.json")
    return listed.withColumn("attempt", F.substring_index("file", "/", 1)).join(notes.select("attempt"), "attempt", "left_semi").drop("attempt")


def publish(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Give committed files their own names, in tasks, and return them (name, bytes, sha256). It may be run again after a failure: what has
    its name already stays as it is. A file that is there with other bytes is not replaced: the task fails."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = opened(root)
        for batch in batches:
            for r in batch.to_pylist():
                here, there = f"{own}/{ATTEMPTS}/{r['file']}", f"{own}/{r['name']}"
                source, target = system.get_file_info([here, there])
                if target.type == pafs.FileType.File and (source.type == pafs.FileType.File or target.size != r["bytes"]):
                    raise FileExistsError(f"{there} is there already")
                if target.type != pafs.FileType.File:
                    system.move(here, there)
            yield batch.select(["name", "bytes", "sha256"])

    return (committed(spark, folder) if files is None else files).select("name", "file", "bytes", "sha256").mapInArrow(run, "name string, bytes long, sha256 string")
