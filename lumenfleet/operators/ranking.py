"""Places within groups of any size: no group stands in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..sources.shared import staged


def placed(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "index", size: str | None = None) -> DataFrame:
    """df with each row's place in its group by order, from 0, and, where size names a column, the group's rows. Null keys make a group.

    Rows are sorted by range over keys and order together, so that a large group lies in many partitions; places within a partition's
    part of a group are raised by what partitions before hold of it. The sorted rows are written once, as both steps need the same
    partitions. Rows that order leaves equal get places in some order.
    """
    own = [F.struct(*[c(k) for k in keys]).alias("__key"), *[(c(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]]
    by = ["__key", *[f"__o{i}" for i in range(len(order))]]
    cut = df.select("*", *own).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    rows = staged(cut.withColumn("__at", F.monotonically_increasing_id()), "placed")
    within = F.row_number().over(Window.partitionBy("__part", "__key").orderBy("__at"))
    counts = rows.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition that a group lies in
    before = Window.partitionBy("__key").orderBy("__part")
    offsets = counts.select(c("__key").alias("__of"), c("__part").alias("__in"), F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__key")).alias("__size"))
    joined = rows.withColumn("__within", within).join(offsets, (c("__key") == c("__of")) & (c("__part") == c("__in")))
    extra = [c("__size").alias(size)] if size else []
    return joined.select(*df.columns, (c("__before") + c("__within") - 1).alias(name), *extra)


def beside(placed_rows: DataFrame, keys: list[str], value: str, index: str = "index", **names: int) -> DataFrame:
    """placed_rows with the value of the rows so many places on (names: column=distance), null beyond the ends: equi joins by place."""
    out = placed_rows
    for name, distance in names.items():
        other = placed_rows.select(F.struct(*[c(k) for k in keys]).alias("__k"), (c(index) - distance).alias("__i"), c(value).alias(name))
        out = out.join(other, (F.struct(*[c(k) for k in keys]) == c("__k")) & (c(index) == c("__i")), "left").drop("__k", "__i")
    return out
