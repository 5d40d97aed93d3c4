"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated as often as its cap allows. A copy's virtual finish time is
the source's words served up to its end divided by the source's target; all sources then reach their targets at the same
virtual time, when the document in service is cut. The mix is the global order by virtual finish time, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, dropped, staged

#: Rows to a range of the running sums; bounds what one task sorts.
RANGE = 100_000
#: Sources to a broadcast at most (some 100 bytes each); with more, the join shuffles.
MOST_BROADCAST = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3) -> DataFrame:
    """source, source_size, n, target: shares of all words by weight (repeating over sources in code point order, null last), none above
    most_times its source's size, the excess reshared by weight. One row per source.

    Sorted by the level at which each source is full, the common level is the first that the next source can still take.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most_times)
    everything = Window.partitionBy(F.lit(1))
    open_ = (
        ranked.withColumn("before", F.sum("cap").over(full) - F.col("cap"))
        .withColumn("open_w", F.sum("w").over(everything) - F.sum("w").over(full) + F.col("w"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open_w"))
        .withColumn("common", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    )
    return open_.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")).alias("target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """A repeatable shuffle, the same on any engine."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)))


def running_sums(rows: DataFrame, value: str, order: list[str], out: str, group: str | None = None) -> DataFrame:
    """rows with the sum of value over the rows before each one in the order, by group; one group may hold all rows.

    The rows are range-sorted; sums go within each range, and one row per range and group tells what came before it.
    """
    keys = ([group] if group else []) + order
    ranges = max(1, -(-rows.count() // RANGE))
    sorted_ = staged(rows.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id()), "ranges")
    own = [group] if group else []
    until = (Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("range", *own).orderBy(*order).rowsBetween(*until)
    across = (Window.partitionBy(*own) if own else Window.partitionBy(F.lit(1))).orderBy("range").rowsBetween(*until)
    sums = sorted_.groupBy("range", *own).agg(F.sum(value).alias("all")).withColumn("earlier", F.sum("all").over(across) - F.col("all")).drop("all")
    placed = sorted_.withColumn(out, F.sum(value).over(within) - F.col(value)).join(sums, ["range", *own])
    found = staged(placed.withColumn(out, F.col(out) + F.col("earlier")).drop("range", "earlier"), "sums")
    dropped(sorted_)
    return found


def weighted_fair_queue(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, seed: str = ":mix", size_col: str | None = None) -> DataFrame:
    """docs with size, source_size, target, key (its place in the shuffle), row (a number of its own) and start (its source's words before it).

    docs needs doc_id, source and text, or size_col with the sizes. Null texts have size 0; the null source is a source like others
    and last. Documents with equal keys (a repeated or null doc_id) follow in order of size, then by row, so that many of them are
    split like any others. An empty table gives an empty result; input columns named like the new ones are replaced. Nothing
    gathers a whole source. The source table has one row per source.
    """
    new = ["source_size", "n", "target", "key", "start", "queue", "row", "range", "earlier"]
    size = docs[size_col] if size_col else count_words(docs["text"])
    rows = docs.select(*[c for c in docs.columns if c not in [*new, "size"]], size.cast("long").alias("size"))
    rows = rows.withColumn("key", shuffle_key(F.col("doc_id"), seed)).withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "queue")
    targets = staged(source_targets(rows.select("source", "size"), weights, most_times), "targets")
    targets = targets.withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source", "n")
    placed = running_sums(rows, "size", ["key", "size", "row"], "start", "queue")
    return placed.join(F.broadcast(targets) if targets.count() <= MOST_BROADCAST else targets, "queue").drop("queue")


def schedule(queued: DataFrame, most_times: int = 3) -> DataFrame:
    """The mix itself: one row per copy taken (copy from 0, copy_taken words of it, vfinish), in the global order of virtual finish time.

    A copy in service when its source reaches its target, at virtual time 1, is cut there. The order is range-sorted, its words are
    summed over the ranges, and what lies beyond the total budget, the words of all sources, goes.
    """
    times = F.explode(F.sequence(F.lit(0), F.lit(most_times - 1))).alias("copy")
    begun = F.col("start") + F.col("copy") * F.col("source_size")
    copies = queued.filter("size > 0").select("*", times)
    copies = copies.withColumn("copy_taken", F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begun)).cast("long")).filter("copy_taken > 0")
    copies = copies.withColumn("vfinish", (begun + F.col("copy_taken")) / F.col("target"))
    sources = queued.select("source", "source_size").distinct()
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    served = running_sums(copies, "copy_taken", ["vfinish", "key", "row", "copy"], "served")
    kept = served.withColumn("copy_taken", F.least(F.col("copy_taken"), F.lit(budget) - F.col("served"))).filter("copy_taken > 0").drop("served")
    return kept.orderBy("vfinish", "key", "row", "copy")


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, seed: str = ":mix", size_col: str | None = None) -> DataFrame:
    """docs as weighted_fair_queue() has them, with taken: the words that the schedule takes of each, repeats counted (at most most_times its size)."""
    queued = weighted_fair_queue(docs.drop("taken"), weights, most_times, seed, size_col)
    taken = schedule(queued.select("row", "source", "size", "source_size", "target", "key", "start"), most_times).groupBy("row").agg(F.sum("copy_taken").alias("taken"))
    return queued.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':mix')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER f - cap))::DOUBLE / (sum(w) OVER () - sum(w) OVER f + w)::DOUBLE AS level, cap / w AS fill
      FROM r WINDOW f AS (ORDER BY cap / w, source IS NULL, source)),
c AS (SELECT arg_min(level, fill) FILTER (level * w <= cap) AS common FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, common * w) AS target FROM o, c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
   + greatest(0, least(size, floor(target) - start - 2 * source_size)))::BIGINT AS taken
FROM p
"""
