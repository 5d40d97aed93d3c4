"""Quality control of frames as they arrive: moments per frame, noise between consecutive frames, drift by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import c, pop_variance
from ..operators.ranking import beside, placed


def drift(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, mean, sigma by tumbling window with a watermark: batch or streaming. Moments in thousandths stay integers."""
    v = F.rint(c("value") * 1000).cast("long")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    per = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.max("value").alias("max"))
    return per.select(c("window")["start"].alias("window_start"), "event_type", "n", (c("s") / c("n") / 1000).alias("mean"), (F.sqrt(pop_variance("n", "s", "s2")) / 1000).alias("sigma"), "max")


def qc_moments(rows: DataFrame) -> DataFrame:
    """frame_id, n, s, s2, hot, min, max of the rows that are there (12 bit); parts of a frame can be added up later."""
    per_row = rows.select("frame_id", F.size("codes").cast("long").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, v: a + v).alias("s"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v).alias("s2"), F.array_min("codes").alias("lo"), F.array_max("codes").alias("hi"), F.size(F.filter("codes", lambda v: v == 4095)).cast("long").alias("hot"))
    return per_row.groupBy("frame_id").agg(*[F.sum(k).alias(k) for k in ("n", "s", "s2", "hot")], F.min("lo").alias("min"), F.max("hi").alias("max"))


def qc_values(parts: DataFrame) -> DataFrame:
    """frame_id, n, mean, sigma, min, max, saturated from one or more parts of each frame's moments."""
    per = parts.groupBy("frame_id").agg(*[F.sum(k).alias(k) for k in ("n", "s", "s2", "hot")], F.min("min").alias("min"), F.max("max").alias("max"))
    return per.select("frame_id", "n", (c("s") / c("n")).alias("mean"), F.sqrt(pop_variance("n", "s", "s2")).alias("sigma"), "min", "max", c("hot").alias("saturated"))


def frame_qc(rows: DataFrame) -> DataFrame:
    """frame_id, n, mean, sigma, min, max, saturated: one pass over arriving rows (12 bit)."""
    return qc_values(qc_moments(rows))


def append_qc(rows_stream: DataFrame, table_path: str, checkpoint: str):
    """Start the streaming job that appends qc_moments of each micro-batch to a Parquet table; a repeated batch overwrites its own folder. A frame
    whose rows arrive in several batches has several parts, which read_qc adds up."""

    def write(batch: DataFrame, number: int) -> None:
        qc_moments(batch).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return rows_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_qc(spark: SparkSession, table_path: str) -> DataFrame:
    """frame_qc of all that append_qc has seen so far."""
    return qc_values(spark.read.schema("frame_id long, n long, s long, s2 long, hot long, min int, max int").parquet(f"{table_path}/batch=*"))


def consecutive_difference(events: DataFrame) -> DataFrame:
    """Each sensor's value against its previous one: the batch twin of the stateful operator below."""
    each = placed(events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    both = beside(each, ["user_id"], "value", previous=-1).filter("previous is not null")
    return both.select("user_id", "event_id", (c("value") - c("previous")).alias("difference"))


def consecutive_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: the last value of each sensor is the state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for e, v in zip(rows["event_id"], rows["value"], strict=True):
            if last is not None:
                out.append((key[0], e, v - last))
            last = v
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "difference"]).astype({"user_id": "int64", "event_id": "int64", "difference": "float64"})

    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, difference double", "last double", "append", GroupStateTimeout.NoTimeout)
