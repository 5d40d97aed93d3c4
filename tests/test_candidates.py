"""Format proposals against a plain version of the rules, and the rules one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfleet.operators import candidates
from lumenfleet.operators.candidates import DEFAULTS, FIELDS, RESOLUTIONS, SOURCES

FORMAT = "width int, height int, bit_depth int, packing string, endianness string, header long, frames int, bayer string, hdr string, stages int, exposure_ratio double, line_block int, row_offset int"
SIZE = 640 * 480 * 2


def fmt(width, height, **other):
    return tuple((DEFAULTS | {"width": width, "height": height} | other)[k] for k in FIELDS)


def proposals(spark, files, memory, **options):
    """files: (path, length, displayed); memory from the oldest on: (length, ext, format)."""
    f = spark.createDataFrame([(p, p.split("/")[-1], "." + p.split(".")[-1], n, d) for p, n, d in files], f"path string, name string, ext string, length long, displayed struct<{FORMAT.replace(' ', ':').replace(',:', ',')}>")
    m = spark.createDataFrame([(n, e, i, *x) for i, (n, e, x) in enumerate(memory)], f"length long, ext string, used long, {FORMAT}")
    out = {}
    for r in candidates.format_proposals(f, m, **options).orderBy("path", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["path"], [])) + 1
        out[r["path"]].append((r["source"], tuple(r[k] for k in FIELDS)))
    return out


def bytes_of(f):
    d = dict(zip(FIELDS, f, strict=True))
    return d["width"] * d["height"] * (1 if d["bit_depth"] <= 8 else 2)


def plain(length, ext, dims, memory, displayed, resolutions, most):
    """The rules, one file at a time."""
    found, seen = [], set()
    as_dict = lambda f: dict(zip(FIELDS, f, strict=True))
    make = lambda f, **k: tuple((as_dict(f) | k)[x] for x in FIELDS)
    need = lambda f: as_dict(f)["header"] + bytes_of(f) * as_dict(f)["frames"]

    def add(source, f, exact=True):
        if f not in seen and (need(f) == length if exact else need(f) <= length):
            seen.add(f)
            found.append((source, f))

    def count(header, unit):
        return (length - header) // unit if unit > 0 and length > header and (length - header) % unit == 0 else None

    newest = []
    for n, e, f in reversed(memory):
        if (n, e, f) not in newest and need(f) <= n:
            newest.append((n, e, f))
    newest = newest[: candidates.MEMORY]
    for n, e, f in newest:
        if (n, e) == (length, ext):
            add("SameSizeMemory", f, exact=False)
    if displayed:
        add("DisplayedImage", displayed)
    for _, _, f in newest:
        d, n = as_dict(f), count(as_dict(f)["header"], bytes_of(f))
        if n and not (n != d["frames"] and d["hdr"] in ("FrameSequential", "Auto")):
            add("MemoryFrameCount", make(f, frames=n))
    for _, _, f in newest:
        d = as_dict(f)
        if n := count(d["header"], d["width"] * (1 if d["bit_depth"] <= 8 else 2)):
            bare = {k: DEFAULTS[k] for k in ("hdr", "stages", "exposure_ratio", "line_block", "row_offset")} if d["frames"] != 1 and d["hdr"] in ("FrameSequential", "Auto") else {}
            add("MemoryHeight", make(f, height=n, frames=1, **bare))
    probes = list(dict.fromkeys(fmt(1, 1, **{k: as_dict(f)[k] for k in ("bit_depth", "packing", "endianness", "header", "bayer")}) for _, _, f in newest))
    for f in probes:
        for w, h in resolutions:
            add("MemoryResolution", make(f, width=w, height=h))
    for w, h in dims:
        for several in (False, True):
            for f in dict.fromkeys([*probes, fmt(1, 1)]):
                sized = make(f, width=w, height=h)
                n = count(as_dict(f)["header"], bytes_of(sized))
                if n and (n > 1) == several:
                    add("FileName", make(sized, frames=n))
    for w, h in resolutions:
        add("ResolutionTable", fmt(w, h))
    return found[:most]


def test_order_and_repeats(spark):
    exact, other = fmt(640, 480, bayer="Rggb"), fmt(640, 240, bayer="Gbrg")
    want = [("SameSizeMemory", exact), ("DisplayedImage", fmt(480, 640, bit_depth=16)), ("MemoryFrameCount", fmt(640, 240, bayer="Gbrg", frames=2)), ("MemoryHeight", fmt(640, 480, bayer="Gbrg")), *[("FileName", fmt(320, 960, bayer=b)) for b in ("Gbrg", "Rggb", "None")], ("ResolutionTable", fmt(640, 480))]
    memory = [(SIZE, "RAW", exact), (SIZE // 2, ".raw", other)]
    assert proposals(spark, [("d/a_320x960.raw", SIZE, fmt(480, 640, bit_depth=16))], memory)["d/a_320x960.raw"] == want
    assert proposals(spark, [("d/a_320x960.raw", SIZE, fmt(480, 640, bit_depth=16))], memory, most=3)["d/a_320x960.raw"] == want[:3]
    assert proposals(spark, [("a.raw", 0, None), ("b.raw", -5, None)], memory) == {}


def test_trailing_bytes_and_exposures(spark):
    older, newer, headed = fmt(640, 480), fmt(640, 480, bayer="Bggr"), fmt(640, 480, bit_depth=10, header=100)
    got = proposals(spark, [("x_640x480.raw", SIZE + 100, fmt(640, 480, bit_depth=16))], [(SIZE + 100, ".raw", older), (SIZE + 100, ".raw", newer), (SIZE + 100, ".bin", headed)])
    assert got["x_640x480.raw"] == [("SameSizeMemory", newer), ("SameSizeMemory", older), ("MemoryFrameCount", headed)]
    lines, three = fmt(640, 480, hdr="LineInterleaved"), fmt(640, 480, hdr="FrameSequential", stages=3, frames=3)
    sequence, auto = fmt(640, 480, hdr="FrameSequential", frames=2, exposure_ratio=4.0, line_block=2, row_offset=1), fmt(640, 480, hdr="Auto", frames=2)
    got = proposals(spark, [("a.raw", 3 * SIZE, None)], [(SIZE, ".raw", lines), (2 * SIZE, ".raw", sequence), (2 * SIZE, ".bin", auto), (3 * SIZE, ".bin", three)], most=50)["a.raw"]
    of = lambda s: [f for source, f in got if source == s]
    assert of("MemoryFrameCount") == [three, fmt(640, 480, hdr="LineInterleaved", frames=3)] and of("MemoryHeight") == [fmt(640, 1440), fmt(640, 1440, hdr="LineInterleaved")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_plain_rules(spark, seed):
    r = random.Random(seed)
    sizes = [(8, 4), (4, 8), (16, 2), (6, 4), (8, 8)]
    one = lambda: fmt(*r.choice(sizes), bit_depth=r.choice([8, 12]), header=r.choice([0, 16]), frames=r.choice([1, 2]), bayer=r.choice(["None", "Rggb"]), hdr=r.choice(["None", "Auto", "LineInterleaved", "FrameSequential"]), line_block=r.choice([0, 1]))
    memory = [(16 + 32 * r.randint(1, 8), r.choice([".raw", ".bin"]), one()) for _ in range(300)]
    files = [(f"f{i}{r.choice(['', '_8x4', '_16x2_4 x 8', '_0x00'])}.{r.choice(['raw', 'bin'])}", r.choice([0, 16]) + 32 * r.randint(0, 9), r.choice([None, one()])) for i in range(60)]
    import re

    got = proposals(spark, files, memory, resolutions=tuple(sizes), most=7)
    for path, length, displayed in files:
        # no 8x4 in the name: one digit is too few
        dims = [(int(a), int(b)) for a, b in re.findall(r"(?<![0-9])([0-9]{2,5})\s*[xX×]\s*([0-9]{2,5})(?![0-9])", path)]
        want = plain(length, "." + path.split(".")[-1], [d for d in dict.fromkeys(dims) if min(d) > 0], memory, displayed, sizes, 7) if length > 0 else []
        assert got.get(path, []) == want, path
    assert {s for v in got.values() for s, _ in v} >= set(SOURCES[:4]) and len(RESOLUTIONS) == 43


def test_fits(spark):
    rows = spark.createDataFrame([(*fmt(10, 10), n) for n in (199, 200, 201)] + [(*fmt(10, -1), 200)], FORMAT + ", length long")
    got = [(r[0], r[1]) for r in rows.select(candidates.fits_exactly("length"), candidates.can_open("length")).collect()]
    assert got == [(False, False), (True, True), (False, True), (False, False)]
    n = spark.createDataFrame([(200, 0, 100), (200, 1, 100), (200, 200, 100), (200, 0, 0), (100, -1, 1)], "length long, header long, unit long")
    assert [r[0] for r in n.select(candidates.fit_count("length", F.col("header"), F.col("unit"))).collect()] == [2, None, None, None, None]
