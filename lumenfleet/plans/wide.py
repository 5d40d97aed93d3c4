"""Wide samples, from their bytes to codes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..operators import wide
from .fleet import query

KINDS = ("f32", "f64", "f16", "i8", "i16", "i32", "i64", "u32")
#: Values that each kind holds exactly, from a component x and its place i; reals get some that aren't finite.
_VALUE = {"f32": "x", "f64": "x * 3.7::DOUBLE", "f16": "floor(x * 1024) / 1024", "i8": "floor(x * 100)", "i16": "floor(x * 10000)", "i32": "floor(x * 1000000)", "i64": "floor(x * 1000000) * 1000003", "u32": "abs(floor(x * 1000000))"}
_CASES = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VALUE.values()))
V = f"""v0 AS (SELECT vec_id, vec_id // 8 AS frame, (vec_id % 8)::INT AS y, i, x::DOUBLE AS x FROM (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding) AS x FROM embeddings)),
v AS (SELECT *, CASE WHEN frame % 8 < 3 AND (vec_id * 64 + i) % 97 = 5 THEN 'NaN'::DOUBLE WHEN frame % 8 < 3 AND (vec_id * 64 + i) % 97 = 6 THEN '-Infinity'::DOUBLE ELSE CASE frame % 8 {_CASES} END END AS raw FROM v0)"""
_CODE = "CASE WHEN isfinite(v) THEN greatest(0, least(65535, round_even((v * 0.5::DOUBLE - lo * 0.5::DOUBLE) / (up * 0.5::DOUBLE - lo * 0.5::DOUBLE) * 65535.0::DOUBLE, 0)))::INT ELSE 0 END"
_ENDS = "SELECT *, CASE WHEN a < 0 THEN a ELSE 0 END AS lo, CASE WHEN real AND coalesce(a, 0) >= 0 AND coalesce(b, 0) <= 1 THEN 1 ELSE b END AS up FROM"


def samples(spark, d) -> DataFrame:
    """Vectors as rows of frames of eight rows, whose samples are of another kind in each frame, as bytes."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.expr("vec_id DIV 8").alias("frame"), (c("vec_id") % 8).cast("int").alias("y"), "embedding")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (c("frame") % 8 + 1).cast("int"))
    made = {"f32": lambda x: x, "f64": lambda x: x * 3.7, "f16": lambda x: F.floor(x * 1024) / 1024, "i8": lambda x: F.floor(x * 100), "i16": lambda x: F.floor(x * 10000), "i32": lambda x: F.floor(x * 1000000), "i64": lambda x: F.floor(x * 1000000) * 1000003, "u32": lambda x: F.abs(F.floor(x * 1000000))}

    def value(x, i):
        out = F
        at, real = (c("vec_id") * 64 + i) % 97, c("frame") % 8 < 3
        out = out.when(real & (at == 5), float("nan")).when(real & (at == 6), float("-inf"))
        for k, f in made.items():
            out = out.when(c("sample") == k, f(x.cast("double")).cast("double"))
        return out

    rows = e.withColumns({"sample": kind, "big_endian": c("frame") % 2 == 1}).withColumn("values", F.transform("embedding", value))
    return wide.encode_samples(rows, "vec_id", "frame", "y")


@query(f"""WITH {V}, k AS (SELECT frame, y, i // (1 + frame % 2) AS x, frame % 8 < 3 AS real, CASE WHEN frame // 8 % 2 = 0 THEN raw WHEN frame % 8 < 3 THEN 1 - raw WHEN frame % 8 = 7 THEN 4294967295 - raw ELSE -1 - raw END AS v FROM v WHERE i % (1 + frame % 2) = 0),
r AS ({_ENDS} (SELECT frame, bool_or(real) AS real, min(v) FILTER (isfinite(v)) AS a, max(v) FILTER (isfinite(v)) AS b, count(*) FILTER (NOT isfinite(v))::BIGINT AS not_finite FROM k GROUP BY frame))
SELECT frame, y, x::INT AS x, {_CODE} AS code, lo AS offset, up AS upper, not_finite FROM k JOIN r USING (frame)""")
def s07_frame_samples(spark, d):
    """Eight kinds of samples in both byte orders, one or two to a pixel, half of them with white at zero; ranges by frame."""
    rows = samples(spark, d).withColumns({"samples": (c("frame") % 2 + 1).cast("int"), "invert": F.expr("frame DIV 8 % 2 = 1")})
    codes = wide.scaled_frames(wide.decode_samples(rows, "frame", "y"), "frame", "v0")
    return codes.select("frame", "y", "offset", "upper", "not_finite", F.posexplode("v0").alias("x", "code"))


@query(f"""WITH {V}, k AS (SELECT frame, y, i // 4 AS x, i % 4 AS part, frame % 8 < 3 AS real, raw AS v FROM v WHERE i % 4 < 3),
n AS (SELECT frame, count(DISTINCT (y, x)) FILTER (NOT isfinite(v))::BIGINT AS not_finite FROM k GROUP BY frame),
r AS ({_ENDS} (SELECT frame, bool_or(real) AS real, min(v) FILTER (isfinite(v)) AS a, max(v) FILTER (isfinite(v)) AS b FROM k GROUP BY frame)),
w AS (SELECT frame, y, x, part, {_CODE} AS code, lo, up FROM k JOIN r USING (frame))
SELECT frame, y, x::INT AS x, max(code) FILTER (part = 0) AS r, max(code) FILTER (part = 1) AS g, max(code) FILTER (part = 2) AS b, max(lo) AS offset, max(up) AS upper, max(not_finite) AS not_finite FROM w JOIN n USING (frame) GROUP BY frame, y, x""")
def s08_wide_rgb(spark, d):
    """Pixels of four samples, the last left out: one range for the three components."""
    rows = samples(spark, d).withColumns({"samples": F.lit(4), "invert": F.lit(False)})
    codes = wide.scaled_frames(wide.decode_samples(rows, "frame", "y", channels=3), "frame", "v0", "v1", "v2")
    px = codes.select("frame", "y", "offset", "upper", "not_finite", F.posexplode(F.arrays_zip("v0", "v1", "v2")).alias("x", "p"))
    return px.select("frame", "y", "x", c("p.v0").alias("r"), c("p.v1").alias("g"), c("p.v2").alias("b"), "offset", "upper", "not_finite")
