"""Connected components of a link table by repeated contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the label of a component is its smallest node. Only nodes with a link appear.

    Each round every label takes the smallest neighbouring label, followed over two more steps; a round at least halves the
    labels that still have neighbours. Every table is written and read again, so that joins see plain inputs and can split hot keys.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        one = links.join(labels.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a").select("la", "b")
        two = one.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b").filter("la <> lb")
        up = staged(two.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("up")), "labels")
        if up.isEmpty():
            dropped(up)
            return labels
        for _ in range(2):
            further = up.select(F.col("label").alias("up"), F.col("up").alias("further"))
            before, up = up, staged(up.join(further, "up", "left").select("label", F.coalesce("further", "up").alias("up")), "labels")
            dropped(before)
        before, labels = labels, staged(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        dropped(before, up)
