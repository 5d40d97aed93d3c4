"""Whitening of vectors by the covariance of the distinct ones, each weighted by how often it occurs.

Equal vectors are grouped first, so that sums, covariance and projection read each distinct vector once. Sums are exact; vectors are
centred before they are multiplied, in tasks, and the products are added up by Spark, entry by entry. Only numbers by dimension, and a
matrix of dims x dims, reach the driver. Each distinct vector is whitened once and joined back to its rows; the few vectors that hold a
large share of all rows go by a broadcast of bounded size, so that no hot key is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .topk import usable

#: A vector is hot when it holds more than one in HOT_SHARE of all rows: there are fewer than HOT_SHARE such vectors.
HOT_SHARE = 1000
#: Components are held within +-LARGEST, so that they stay whole in 64 bits.
LARGEST = 2**40


def whole(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("long") + F.lit(shift).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers by vector and dimension; shorter vectors count as if filled with zeros before shifting, which the caller has done."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def added(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum("s").alias("s"))


def sums(distinct: DataFrame, dims: int) -> list[int]:
    """The exact weighted sum of each dimension."""
    each = distinct.select("w", F.posexplode("x").alias("dim", "v"))
    got = each.groupBy("dim").agg(F.sum(F.col("w").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).alias("s")).collect()
    by = {r["dim"]: int(r["s"]) for r in got}
    return [by[d] for d in range(dims)]


def products(table: DataFrame, dims: int, values) -> np.ndarray:
    """The sum over rows of w * a a', where values(batch) gives the weights and the centred matrix of a batch: dims x dims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            w, a = values(batch)
            total += (a * w[:, None]).T @ a
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    out = np.zeros((dims, dims))
    for r in added(table.mapInArrow(run, "i int, j int, s double"), "i", "j").collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """sum over dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    if largest * largest * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(s)) ** 2).sum(1).tolist()
    found = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(1)
    return [v if v < 2**63 else None for v in found]


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100000, weights: str = "count", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; repeated rows and null ids are kept. weights says how a
    distinct vector counts in the fit: "count" as often as it occurs, "one" once. Shorter vectors count as if filled with zeros;
    components beyond +-2^40 / scale are held there. A deviation that passes 64 bits is null. There are at most as many components as
    dimensions; a component without variance (all vectors alike, say) gives null for whitened, and for explained where no component
    has any. An empty table gives an empty result. Further columns of the input are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("e"))
    rows = rows.filter(usable(F.col("e")))
    dims = rows.agg(F.max(F.size("e"))).first()[0] or 0
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    filled = F.concat("e", F.array_repeat(F.lit(0.0).cast("float"), F.lit(dims) - F.size("e")).cast(dict(vectors.dtypes)[vector_col]))
    rows = staged(rows.select("id", whole(filled, scale, shift).alias("x")), "vectors")
    counted = staged(rows.groupBy("x").agg(F.count(F.lit(1)).alias("m")).select("x", "m", F.lit(1).cast("long").alias("one")), "distinct")
    distinct = counted.select("x", F.col("m" if weights == "count" else "one").alias("w"))
    n_rows, n = (int(v) for v in counted.agg(F.sum("m"), F.sum("m" if weights == "count" else "one")).first())
    s = sums(distinct, dims)
    mean_whole = [v // n for v in s]
    rest = np.array([(v - q * n) / n for v, q in zip(s, mean_whole, strict=True)])
    middle = np.array(mean_whole)

    def centred(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("w").to_numpy().astype(np.float64), (matrix(batch.column("x"), dims) - middle) - rest

    v = products(distinct, dims, centred) / n
    e, vectors_of = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")[: min(components, dims)]
    e, axes, trace = e[order], vectors_of[:, order], float(np.trace(v))
    varies = e > 1e-13 * max(trace, 0) if trace > 0 else np.zeros(len(e), bool)
    scaled = axes[:, varies] / np.sqrt(e[varies])
    numbers = (np.flatnonzero(varies) + 1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a = centred(batch)
            z = a @ scaled
            flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), max(1, z.shape[1])).cast(pa.list_(pa.float64())) if z.shape[1] else pa.array([[]] * len(z), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("w"), pa.array(deviations(matrix(batch.column("x"), dims), n, s), pa.int64()), flat], names=["x", "w", "deviation", "z"])

    white = staged(distinct.mapInArrow(run, "x array<long>, w long, deviation long, z array<double>"), "whitened")
    wide = len(numbers)

    def of_whitened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
        return batch.column("w").to_numpy().astype(np.float64), np.column_stack([z, np.ones(len(z))])

    error = None
    if wide:
        m = products(white, wide + 1, of_whitened) / n
        error = float(np.abs(m[:wide, :wide] - np.outer(m[:wide, wide], m[:wide, wide]) - np.eye(wide)).max())
    hot = counted.filter(F.col("m") > n_rows // HOT_SHARE).select("x")
    known = white.select("x", "deviation", "z")
    frequent = F.broadcast(known.join(F.broadcast(hot), "x", "left_semi"))
    few = rows.join(frequent, "x")
    rare = rows.join(F.broadcast(hot), "x", "left_anti").join(known.join(F.broadcast(hot), "x", "left_anti"), "x")
    every = few.unionByName(rare)
    place = {int(c): i for i, c in enumerate(numbers)}
    lit = lambda x: F.lit(x).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("component"), (F.col("z")[place[c]] if c in place else lit(None)).alias("whitened"), lit(float(e[c - 1]) / trace if trace > 0 else None).alias("explained")) for c in range(1, len(e) + 1)])
    out = every.select(F.col("id").alias(id_col), "deviation", F.explode(each).alias("c"))
    return out.select(id_col, "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", lit(error).alias("identity_error"))
