"""Format memory and named presets as JSON files: read entry by entry, so that one broken entry costs itself alone, and merged by key.

A file is one JSON document: a list of entries, or an object with version and entries, for memory; an object of names and formats for
presets. Or it has an entry on each line. Older versions are read as they were written: fields that they lack get defaults, and names that changed get the new ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators.candidates import DEFAULTS, FIELDS, can_open
from ..operators.formats import broken_rules, normal_extension

VERSION = 2
FORMAT = "width int, height int, bit_depth int, packing string, endianness string, header long, frames int, bayer string, hdr string, stages int, exposure_ratio double, line_block int, row_offset int"
_KINDS = {part.split()[0]: part.split()[1] for part in FORMAT.split(", ")}
#: Names of exposure layouts in old files, both read as Auto (fixed values).
OLD_LAYOUTS = {"Dol": "Auto", "Staggered": "Auto"}
#: Names of fields in version 1.
OLD_FIELDS = {"bitDepth": "bit_depth", "headerOffset": "header", "frameCount": "frames", "hdrStages": "stages", "exposureRatio": "exposure_ratio", "hdrLineBlock": "line_block", "hdrRowOffset": "row_offset", "fileSize": "length", "extension": "ext", "lastUsedUtc": "used", "autoOpen": "auto_open", "format": "format"}
#: Depth of an entry that states none (fixed value).
STATED_DEPTH = 16


class Broken:
    """Text that is no JSON."""

    def __init__(self, text: str = ""):
        self.text = text


BROKEN = Broken()


def parsed(text: str, kept: str = ""):
    try:
        return json.loads(text)
    except ValueError:
        return Broken(kept) if kept else BROKEN


def entries(text: str) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(name, entry as JSON, what is wrong) of each entry of a file; a file that can't be read at all is one with its reason."""
    found, lines = parsed(text), [line for line in text.splitlines() if line.strip()]
    if found is BROKEN and len(lines) > 1 and all(line.lstrip()[0] == "{" for line in lines):
        found = [parsed(line, line) for line in lines]
    elif isinstance(found, dict) and len(lines) == 1 and isinstance(found.get("format"), dict) and ("length" in found or "fileSize" in found):
        found = [found]
    if found is BROKEN:
        yield None, text, "not JSON"
        return
    if isinstance(found, dict) and isinstance(found.get("entries"), list):
        if not isinstance(found.get("version", 1), int) or found.get("version", 1) > VERSION:
            yield None, None, f"version {found.get('version')} is not known"
            return
        found = found["entries"]
    if isinstance(found, list):
        each = [(None, e) for e in found]
    elif isinstance(found, dict):
        each = [(k, {"format": v}) for k, v in found.items()]
    else:
        yield None, None, "neither entries nor presets"
        return
    for name, entry in each:
        if isinstance(entry, Broken):
            yield name, entry.text, "not JSON"
        elif isinstance(entry, dict) and isinstance(entry.get("format"), dict):
            flat = {OLD_FIELDS.get(k, k): v for k, v in (entry | entry["format"]).items() if k != "format"}
            flat["hdr"] = OLD_LAYOUTS.get(flat.get("hdr"), flat.get("hdr")) if isinstance(flat.get("hdr"), (str, type(None))) else flat["hdr"]
            yield name, json.dumps({k: v for k, v in flat.items() if v is not None}), None
        else:
            yield name, json.dumps(entry), "no format"


def read_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of all files of path. Entries: file, name, length, ext, used, auto_open and the format, which is valid, and opens a
    file of length where that is stated. Quarantine: file, name, entry (its text), reason. Types are read strictly: a number as text
    is wrong. Each file is one record of the scan; its entries come apart in the task that reads it."""
    scan = spark.read.format("binaryFile").load(path).select("path", c("content").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(file, *e) for e in entries(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in (zip(*rows, strict=True) if rows else ([], [], [], []))], names=["file", "name", "entry", "reason"])

    each = scan.mapInArrow(run, "file string, name string, entry string, reason string")
    keys = "length long, ext string, used string, auto_open boolean"
    # _corrupt holds an entry in which a field is of another kind.
    parsed = F.from_json("entry", f"{keys}, {FORMAT}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = each.withColumn("e", F.when(c("reason").isNull(), parsed)).select("file", "name", "entry", "reason", "e.*")
    defaults = DEFAULTS | {"bit_depth": STATED_DEPTH}
    rows = rows.withColumns({k: F.coalesce(k, F.lit(defaults[k]).cast(_KINDS[k])) for k in FIELDS if k in defaults})
    rows = rows.withColumns({"ext": normal_extension("ext"), "used": c("used").try_cast("timestamp"), "auto_open": F.coalesce("auto_open", F.lit(False))})
    broken = F.array_join(broken_rules(), ",")
    reason: Column = F.coalesce("reason", F.when(c("_corrupt").isNotNull(), "a field of another kind").when(c("width").isNull() | c("height").isNull(), "no size").when(broken != "", broken).when(c("length").isNotNull() & ~can_open("length"), "the format doesn't open its length"))
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").select("file", "name", "length", "ext", "used", "auto_open", *FIELDS)
    return good, rows.filter("reason IS NOT NULL").select("file", "name", "entry", "reason")


def merged_memory(*tables: DataFrame) -> DataFrame:
    """One entry for each length, extension and format, as the newest has it; entries without a length are left out. Of a key (length,
    extension) only the newest of those that open by themselves keeps doing so."""
    all_entries = tables[0]
    for t in tables[1:]:
        all_entries = all_entries.unionByName(t)
    newest = all_entries.filter("length IS NOT NULL").groupBy("length", "ext", *FIELDS).agg(F.max(F.struct(F.coalesce("used", F.to_timestamp(F.lit("0001-01-01"))).alias("at"), "used", "auto_open")).alias("n"))
    flat = newest.select("length", "ext", *FIELDS, "n.at", "n.used", "n.auto_open")
    rest = F.struct("at", *FIELDS)
    one = flat.filter("auto_open").groupBy("length", "ext").agg(F.max(rest).alias("chosen"))
    return flat.join(one, ["length", "ext"], "left").select("length", "ext", *FIELDS, "used", F.coalesce(c("auto_open") & (rest == c("chosen")), F.lit(False)).alias("auto_open"))


def merged_presets(*tables: DataFrame) -> DataFrame:
    """One format for each name: a later table's, and of one table's the one in the last file."""
    ranked = None
    for i, t in enumerate(tables):
        own = t.filter("name IS NOT NULL").withColumn("rank", F.struct(F.lit(i).alias("table"), "file"))
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked.groupBy("name").agg(F.max_by(F.struct(*FIELDS), "rank").alias("f")).select("name", "f.*")


def as_file(memory: DataFrame) -> DataFrame:
    """entry: a memory's rows as JSON, in the present version, to be written as text, one a line."""
    return memory.select(F.to_json(F.struct("length", "ext", F.date_format("used", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("used"), "auto_open", F.struct(*FIELDS).alias("format"))).alias("entry"))
