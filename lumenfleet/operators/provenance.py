"""Where derived frames come from: a table of what made each, and its resolution to source frames in as many joins as the logarithm of the depth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..sources.shared import dropped, staged


def derivation(frame_id, parents, op, params: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a lineage table: frame_id, parents (array, in order), op, params (map of text). Parameters that are null are left out."""
    pairs = [x for k, v in (params or {}).items() for x in (F.lit(k), c(v).cast("string"))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("CAST(map() AS map<string,string>)")
    return [c(frame_id).cast("long").alias("frame_id"), c(parents).alias("parents"), c(op).alias("op"), kept.alias("params")]


def sources_of(lineage: DataFrame, deepest: int = 1 << 20) -> DataFrame:
    """frame_id, source, steps, known: for each derived frame every frame at the end of its parents, with the most steps to it. known says whether
    the source has a record of its own (frames without a record are sources that nothing is known of).

    lineage (frame_id, parents): frames without parents, null or empty, are sources. Each round joins what isn't at a source yet with the
    same relation, which doubles the steps; what has arrived waits aside, so that a source of many frames is no hot key. A chain
    of d steps takes log2(d) rounds. Repeated records and parents count once. Frames that come from themselves, by any number of
    steps, never arrive at a source by that way: such ways end in records with a null source.
    """
    edges = lineage.select(c("frame_id").cast("long").alias("node"), F.explode(F.array_distinct(c("parents").cast("array<bigint>"))).alias("up")).filter("up IS NOT NULL").distinct()
    records = lineage.select(c("frame_id").cast("long").alias("up")).distinct()
    derived = edges.select(c("node").alias("up")).distinct().withColumn("more", F.lit(True))
    # A way is at its end when its upper frame has no parents itself.
    ways = staged(edges.join(derived, "up", "left").select("node", "up", F.lit(1).cast("long").alias("steps"), F.coalesce("more", F.lit(False)).alias("more")), "ways")
    # No way without a circle has more steps than there are derived frames.
    for _ in range(math.ceil(math.log2(min(deepest, derived.count() + 1))) + 1):
        open_ways = ways.filter("more")
        if open_ways.isEmpty():
            break
        further = ways.select(c("node").alias("up"), c("up").alias("top"), c("steps").alias("on"), c("more").alias("then"))
        gone_on = open_ways.select("node", "up", "steps").join(further, "up").select("node", c("top").alias("up"), (c("steps") + c("on")).alias("steps"), c("then").alias("more"))
        both = ways.filter("NOT more").unionByName(gone_on).groupBy("node", "up", "more").agg(F.max("steps").alias("steps"))
        following = staged(both.select("node", "up", "steps", "more"), "ways")
        dropped(ways)
        ways = following
    known = records.withColumn("known", F.lit(True))
    ended = ways.filter("NOT more").join(known, "up", "left").select(c("node").alias("frame_id"), c("up").alias("source"), "steps", F.coalesce("known", F.lit(False)).alias("known"))
    circles = ways.filter("more").select(c("node").alias("frame_id"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("steps"), F.lit(False).alias("known")).distinct()
    return ended.unionByName(circles)
