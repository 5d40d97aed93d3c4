"""Format memory: broken files and entries, old versions, merges."""

import json

from pyspark.sql import functions as F

from lumenfleet.operators.candidates import FIELDS
from lumenfleet.sources import memory


def read(spark, tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))
    good, bad = memory.read_entries(spark, str(tmp_path / "*.json"))
    return good, {(r["file"].split("/")[-1], r["reason"]) for r in bad.collect()}, {r["entry"] for r in bad.collect()}


def test_a_broken_entry_costs_itself_alone(spark, tmp_path):
    fine = {"length": 1000, "ext": "RAW", "used": "2024-01-02T03:04:05Z", "auto_open": True, "format": {"width": 10, "height": 4}}
    wrong = [fine | {"format": {"width": "10", "height": 4}}, fine | {"format": {"width": 10, "height": 4, "packing": 3}}, fine | {"format": {"height": 4}}, fine | {"format": {"width": 10, "height": 4, "bit_depth": 9, "frames": 0}}, fine | {"length": 79}, {"length": 5}, 7, fine | {"format": {"width": 10, "height": 4, "hdr": "Unknown"}}]
    good, reasons, _ = read(spark, tmp_path, a={"version": 2, "entries": [fine, *wrong, fine | {"ext": None}]}, b="{not json", c={"version": 99, "entries": []}, d=[], e=json.dumps(fine) + "\n{broken\n" + json.dumps(fine | {"length": 2000}), f='"text"')
    rows = {(r["file"].split("/")[-1][0], r["length"], r["ext"]): r for r in good.collect()}
    assert set(rows) == {("a", 1000, ".raw"), ("a", 1000, ""), ("e", 1000, ".raw"), ("e", 2000, ".raw")}
    one = rows["a", 1000, ".raw"]
    assert (one["bit_depth"], one["frames"], one["exposure_ratio"], one["auto_open"], one["used"].year) == (16, 1, 16.0, True, 2024)
    assert reasons == {("a.json", "a field of another kind"), ("a.json", "packing"), ("a.json", "no size"), ("a.json", "bit_depth,frames"), ("a.json", "hdr"), ("a.json", "the format doesn't open its length"), ("a.json", "no format"), ("b.json", "not JSON"), ("c.json", "version 99 is not known"), ("e.json", "not JSON"), ("f.json", "neither entries nor presets")}


def test_old_versions_and_presets(spark, tmp_path):
    old = {"fileSize": 100, "extension": ".bin", "lastUsedUtc": "2023-01-01T00:00:00Z", "format": {"width": 5, "height": 4, "bitDepth": 8, "headerOffset": 7, "frameCount": 2, "hdr": "Staggered", "hdrStages": 3, "hdrLineBlock": 1, "hdrRowOffset": 2, "exposureRatio": 4.0}}
    good, reasons, _ = read(spark, tmp_path, a=[old], p={"night": {"width": 6, "height": 3}, "day": {"width": 0, "height": 3}}, q={"night": {"width": 7, "height": 3}, "dusk": {"width": 8, "height": 3, "hdr": "Dol"}})
    rows = {r["name"] or r["length"]: r for r in good.collect() if r["file"].endswith(("a.json", "p.json"))}
    assert [rows[100][k] for k in FIELDS] == [5, 4, 8, "Lsb", "Little", 7, 2, "None", "Auto", 3, 4.0, 1, 2] and not rows[100]["auto_open"]
    assert set(rows) == {100, "night"} and reasons == {("p.json", "width")}
    presets = {r["name"]: (r["width"], r["hdr"]) for r in memory.merged_presets(good).collect()}
    assert presets == {"night": (7, "None"), "dusk": (8, "Auto")}  # the last file's
    first, later = good.filter("file LIKE '%q.json'"), good.filter("file LIKE '%p.json'")
    assert {r["name"]: r["width"] for r in memory.merged_presets(first, later).collect()} == {"night": 6, "dusk": 8}


def test_round_trip_and_merge(spark, tmp_path):
    entry = lambda n, width, second, auto: {"length": n, "ext": ".raw", "used": f"2024-01-01T00:00:{second:02d}Z", "auto_open": auto, "format": {"width": width, "height": 2, "bit_depth": 8}}
    good, _, _ = read(spark, tmp_path, a=[entry(100, 5, 1, True), entry(100, 6, 2, True), entry(100, 7, 3, False), entry(200, 5, 1, True)], b=[entry(100, 5, 9, False), entry(100, 6, 1, True)])
    merged = memory.merged_memory(good.filter("file LIKE '%a.json'"), good.filter("file LIKE '%b.json'"))
    got = {(r["length"], r["width"]): (r["used"].second, r["auto_open"]) for r in merged.collect()}
    assert got == {(100, 5): (9, False), (100, 6): (2, True), (100, 7): (3, False), (200, 5): (1, True)}
    memory.as_file(merged).coalesce(1).write.text(str(tmp_path / "out"))
    again, bad = memory.read_entries(spark, str(tmp_path / "out"))
    assert bad.count() == 0 and {(r["length"], r["width"]): (r["used"].second, r["auto_open"]) for r in again.collect()} == got
    assert memory.merged_memory(good.filter(F.lit(False))).count() == 0
