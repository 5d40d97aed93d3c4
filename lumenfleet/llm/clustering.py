"""Exact centroid clustering of integer vectors by scalar lookup tables.

Vectors are packed once into blocks of at most one Arrow batch. A block keeps, for each dimension, the integer values that occur in it
and each vector's places among them. In a round a task tabulates the squared difference of every occurring value to every centroid and
sums table entries by place; sums and counts by cluster and dimension are added up by Spark. Nothing that grows with the input reaches
the driver: a round returns at most k * (dims + 2) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .topk import usable

#: Components are held within +-LARGEST, so that a squared distance of up to 256 dimensions fits 64 bits.
LARGEST = 2**26


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, held within +-LARGEST."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("long"))


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """(id, v) to blocks: ids, places (of each vector's components among its dimension's values), values, starts (of each dimension's values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            each = [np.unique(v[:, d], return_inverse=True) for d in range(dims)]
            starts = np.cumsum([0, *[len(found) for found, _ in each]])
            places = np.column_stack([place.ravel() + start for (_, place), start in zip(each, starts, strict=False)])
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0))
            parts = [places.astype(np.int32), np.concatenate([found for found, _ in each]), starts]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["ids", "places", "values", "starts"])

    return rows.mapInArrow(run, "ids array<long>, places binary, values binary, starts binary")


def nearest(places: np.ndarray, values: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector: ties go to the smaller number."""
    table = (values[:, None] - np.repeat(centroids.T, np.diff(starts), axis=0)) ** 2
    total = np.zeros((len(places), len(centroids)), np.int64)
    for d in range(places.shape[1]):
        total += table[places[:, d]]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(total)), cluster]


def unpacked(batch: pa.RecordBatch, r: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places, values, starts = (np.frombuffer(batch.column(c)[r].as_py(), kind) for c, kind in (("places", np.int32), ("values", np.int64), ("starts", np.int64)))
    return places.reshape(-1, dims), values, starts


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(cluster, dimension) to the exact sum; dimension -1 has the count and -2 the summed squared distance."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                places, values, starts = unpacked(batch, r, dims)
                cluster, far = nearest(places, values, starts, centroids)
                v, order = values[places], np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                # Squared distances of a block may pass 64 bits together: halves are summed apart.
                low, high = (np.add.reduceat(x[order], first) for x in (far & 0xFFFFFFFF, far >> 32))
                added = np.add.reduceat(v[order], first, axis=0)
                n = np.diff(np.append(first, len(order)))
                columns = [*range(dims), -1, -2, -3]
                all_sums = np.column_stack([added, n, low, high])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, len(columns)), pa.int32()), pa.array(np.tile(columns, len(there)), pa.int32()), pa.array(all_sums.ravel(), pa.int64())], names=["cluster", "dim", "s"])

    got = blocks.mapInArrow(run, "cluster int, dim int, s long").groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {(r["cluster"], r["dim"]): int(r["s"]) for r in got.collect()}
    return found | {(j, -2): found.get((j, -2), 0) + (found.get((j, -3), 0) << 32) for j in range(k)}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector with exactly dims finite components.

    The first centroids are the k vectors with the smallest sha256 of "seed:id"; rows with a null id are clustered, but are no first
    centroid, and of rows that repeat an id the smaller vector counts first. With fewer vectors there are fewer centroids; an empty
    table gives an empty result, and so does one in which every id is null. Empty clusters keep their centroid. Components beyond
    +-2^26 / scale are held there. An inertia that passes 64 bits is null. Further columns of the input are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("e"))
    rows = rows.filter(usable(F.col("e")) & (F.size("e") == dims)).select("id", whole(F.col("e"), scale).alias("v"))
    named = rows.filter("id is not null").withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256))
    first = named.orderBy("h", "v").limit(k).collect()  # k rows
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    blocks = staged(packed(rows, dims), "blocks")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        found = sums(blocks, centroids)
        for j in range(len(centroids)):
            if n := found.get((j, -1), 0):
                centroids[j] = [found[j, d] // n for d in range(dims)]
    found = sums(blocks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                own, far = nearest(*unpacked(batch, r, dims), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(r, 1).flatten(), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=[id_col, "cluster", "distance"])

    inertia = [found[j, -2] for j in range(len(centroids))]
    per = [F.lit(x if x < 2**63 else None).cast("long") for x in [*inertia, sum(inertia)]]
    hashes = F.array(*[F.sha2(F.lit(",".join(map(str, c.tolist()))), 256) for c in centroids])
    own = F.col("cluster") + 1
    out = blocks.mapInArrow(run, f"{id_col} long, cluster int, distance long")
    return out.select(id_col, "cluster", "distance", F.element_at(F.array(*per[:-1]), own).alias("cluster_inertia"), per[-1].alias("inertia"), F.element_at(hashes, own).alias("centroid_sha256"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another, each a nearest centroid by vector and a floored mean by cluster and dimension."""
    nearest_of = lambda c: f"SELECT r, vec_id, e, unnest(min_by({{'k': k, 'd': d}}, (d, k))) FROM (SELECT v.r, v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1]-z[2])*(z[1]-z[2])))::BIGINT AS d FROM v, {c} c) GROUP BY r, vec_id, e"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1)::INT AS k, e FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest_of(f'c{i}')})")
        parts.append(f"m{i} AS (SELECT k, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT k, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY k, i))")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS e FROM m{i} GROUP BY k) n USING (k))")
    return f"""WITH {', '.join(parts)}, a AS MATERIALIZED ({nearest_of(f'c{rounds}')})
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c USING (k)"""


OP11_SQL = _sql()
