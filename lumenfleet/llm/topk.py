"""Exact top-k inner products by pivot-table elimination.

Vectors get one more coordinate so that all candidates have one norm: the largest inner product is then the smallest distance. Candidates
lie in order of their nearest pivot, and groups of neighbours keep the least and the largest distance to every pivot: by the triangle
inequality a query's distance to any member is at least its own distance to the pivot less the largest, or the least less its own,
at the best pivot. Groups are scored in the order of their bounds until the bound alone keeps the rest out. Queries meet candidates
block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIVOTS = 32
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Candidates to a group with one row of bounds.
GROUP = 128
NO_SCORE = np.iinfo(np.int64).min


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def narrowest(largest: int) -> np.dtype:
    """The smallest kind of integer that holds these numbers and their negatives."""
    return np.dtype(next(k for k in ("<i1", "<i2", "<i4", "<i8") if largest <= np.iinfo(k).max))


def with_extra(v: np.ndarray, top: float, augment: bool) -> np.ndarray:
    """Vectors with the coordinate that brings their squared norm up to top; queries have 0 there."""
    x = v.astype(np.float64)
    extra = np.sqrt(np.maximum(top - (x * x).sum(1), 0)) if augment else np.zeros(len(x))
    return np.column_stack([x, extra])


def distances(full: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: again and again the sampled vector farthest from those chosen."""
    chosen = [sample[0]]
    far = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(sample[int(far.argmax())])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def packed(rows: DataFrame, block: int, pivots: np.ndarray, top: float, dims: int, kind: np.dtype, augment: bool) -> DataFrame:
    """Blocks of at most block rows (row, id, v): row numbers, ids and vectors; for candidates in order of the nearest pivot, with the
    least and largest distance to the pivots of each group of GROUP rows; for queries with their own distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            row, own, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for at in range(0, len(row), block):
                some = slice(at, at + block)
                d = distances(with_extra(v[some], top, augment), pivots)
                order, least, most = np.arange(len(d)), d, d
                if augment:
                    near = d.argmin(1)
                    order = np.lexsort((d[np.arange(len(d)), near], near))
                    starts = np.arange(0, len(d), GROUP)
                    least, most = np.minimum.reduceat(d[order], starts, 0), np.maximum.reduceat(d[order], starts, 0)
                parts = (row[some][order], own[some][order], v[some][order].astype(kind), least, most)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["rows", "ids", "vectors", "least", "most"])

        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            v = np.zeros((len(sizes), dims), np.int64)
            v[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), v))
            if sum(len(x[0]) for x in held) >= block:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, "rows binary, ids binary, vectors binary, least binary, most binary")


def numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The blocks with numbers from 0 on, and how many there are. One row per block of thousands of vectors is ranked in one task."""
    marked = staged(blocks.withColumn("mark", F.monotonically_increasing_id()), name)
    ranks = marked.select("mark").withColumn(name, F.row_number().over(Window.orderBy("mark")) - 1)
    return marked.join(ranks, "mark").drop("mark"), marked.count()


def best_of_block(q, q_rows, q_table, x, x_ids, x_rows, least, most, top: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best in the block, NO_SCORE where there are fewer; ties to the smaller id."""
    small = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**52  # then doubles are exact
    kind = np.float64 if small else np.int64
    qk, xk = q.astype(kind), x.astype(kind)
    gap = np.zeros((len(q), len(least)))
    for p in range(q_table.shape[1]):
        d = q_table[:, p, None]
        np.maximum(gap, np.maximum(d - most[None, :, p], least[None, :, p] - d), out=gap)
    square = (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (1 + top + square[:, None])
    high = (square[:, None] + top - gap**2) / 2 + slack  # no score in the group is above it
    order = np.argsort(-high, axis=1, kind="stable")
    scores, ids = np.full((len(q), k), NO_SCORE), np.full((len(q), k), np.iinfo(np.int64).max)
    open_ = np.arange(len(q))
    for step in range(len(least)):
        group = order[open_, step]
        ok = high[open_, group] >= scores[open_, -1]
        open_, group = open_[ok], group[ok]
        if not len(open_):
            break
        by_group = np.argsort(group, kind="stable")
        for some in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
            at, own = open_[some], slice(group[some[0]] * GROUP, (group[some[0]] + 1) * GROUP)
            product = qk[at] @ xk[own].T
            s = np.rint(product).astype(np.int64) if small else product
            s = np.where(x_rows[own][None] == q_rows[at][:, None], NO_SCORE, s)
            better = s.max(1) >= scores[at, -1]
            if better.any():
                at = at[better]
                both = np.concatenate([scores[at], s[better]], 1)
                names = np.concatenate([ids[at], np.where(s[better] == NO_SCORE, np.iinfo(np.int64).max, x_ids[own][None])], 1)
                best = np.lexsort((names, -np.maximum(both, NO_SCORE + 1)), axis=1)[:, :k]
                scores[at], ids[at] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    return scores, ids


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, pivot_sample: int = 1000) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and its score, for the rows where queries holds, against every other row.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids; shorter vectors count as if
    filled with zeros. Rows that repeat an id are queries and candidates each for itself, and only a query's own row is barred. Scores
    are exact while they fit 64 bits. Pivots come from at most pivot_sample vectors and decide the work only. Query blocks hold at
    most 4096 rows, candidate blocks 16384. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), queries.alias("is_query")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), "id", whole_numbers(F.col("v"), scale).alias("v"), "is_query"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    largest = F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0))))
    dims, top, n_queries, n, most = rows.agg(F.max(F.size("v")), F.max(square), F.count_if("is_query"), F.count(F.lit(1)), F.max(largest)).first()
    if not n or not n_queries:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    dims, top, kind = max(1, dims), top * (1 + 1e-12), narrowest(most)
    sample = np.zeros((min(pivot_sample, n), dims))
    for i, r in enumerate(rows.select("v").limit(pivot_sample).collect()):
        sample[i, : len(r["v"])] = r["v"]
    pivots = spread_pivots(with_extra(sample, top, True), PIVOTS)
    q_rows = rows.filter("is_query").select("row", "id", "v").repartition(-(-n_queries // QUERY_BLOCK))
    q, _ = numbered(packed(q_rows, QUERY_BLOCK, pivots, top, dims, kind, False).select("rows", "ids", "vectors", "least"), "qb")
    x, n_x = numbered(packed(rows.select("row", "id", "v"), CANDIDATE_BLOCK, pivots, top, dims, kind, True), "xb")
    # Each query block goes to every candidate block; candidate blocks, the larger side, travel once for all of them.
    asked = q.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    x = x.select("xb", *[F.col(c).alias("x_" + c) for c in ("rows", "ids", "vectors", "least", "most")])
    pairs = asked.join(x, "xb").select("rows", "ids", "vectors", "least", "x_rows", "x_ids", "x_vectors", "x_least", "x_most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                raw = [batch.column(i)[r].as_py() for i in range(9)]
                (q_rows, q_ids), (x_rows, x_ids) = ([np.frombuffer(b, np.int64) for b in raw[i : i + 2]] for i in (0, 4))
                table = lambda b: np.frombuffer(b, np.float64).reshape(-1, len(pivots))
                q, x = (np.frombuffer(raw[i], kind).reshape(-1, dims) for i in (2, 6))
                scores, ids = best_of_block(q, q_rows, table(raw[3]), x, x_ids, x_rows, table(raw[7]), table(raw[8]), top, k)
                at, place = np.nonzero(scores != NO_SCORE)
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(ids[at, place]), pa.array(scores[at, place])], names=["row", "query_id", "candidate", "score"])

    best = Window.partitionBy("row").orderBy(F.desc("score"), "candidate")
    ranked = pairs.mapInArrow(run, "row long, query_id long, candidate long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("candidate").alias(id_col), "score")


OP1_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
