"""Queries that run a stream over landed rows to its end and return what it wrote, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import c
from ..sources import frames as src
from ..sources.shared import fresh
from ..streaming import noise, qc
from .files import LOT
from .fleet import ORACLES, SCENE, TOP, VAR, pattern_of, query, rounded

LANDED = "sensor long, frame long, ts timestamp, y int, codes array<int>"


def landed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Rows of a sensor's frames, one frame a second, written as files and read as a stream; and the same as a table. A last record, of no
    sensor, moves the watermark past all others."""
    rows = src.rows(spark, d).select(F.expr(f"frame_id DIV {LOT}").alias("sensor"), (c("frame_id") % LOT).alias("frame"), F.timestamp_seconds(c("frame_id") % LOT + 1).alias("ts"), "y", "codes")
    end = spark.createDataFrame([(-1, -1, 0, [])], "sensor long, frame long, y int, codes array<int>").select("sensor", "frame", F.timestamp_seconds(F.lit(10**6)).alias("ts"), "y", "codes")
    folder = fresh(spark, "landed")
    rows.write.parquet(folder)
    end.coalesce(1).write.mode("append").parquet(folder)  # streams take files in the order in which they came
    each = max(5, 4 * spark.sparkContext.defaultParallelism)  # a batch costs its state's commits, and one of fewer files than cores leaves cores without work
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", each).parquet(folder), spark.read.schema(LANDED).parquet(folder)


def run_out(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark, folder = stream.sparkSession, fresh(stream.sparkSession, name)
    job = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_PAIRS = f"""p AS (SELECT a.frame_id // {LOT} AS sensor, b.frame_id % {LOT} AS frame, a.channel, a.code AS a, b.code AS b FROM px a JOIN px b ON b.frame_id = a.frame_id + 1 AND a.y = b.y AND a.x = b.x WHERE b.frame_id % {LOT} <> 0),
m AS (SELECT sensor, frame, channel, count(*) AS n, sum(a)::BIGINT AS s, sum(a::BIGINT*a)::BIGINT AS s2, sum(a-b)::BIGINT AS ds, sum((a-b)::BIGINT*(a-b))::BIGINT AS ds2 FROM p GROUP BY ALL),
v AS (SELECT *, {VAR} AS v, {VAR.replace('s2', 'DS2').replace('s::', 'ds::').replace('DS2', 'ds2')} AS dv FROM m),
e AS (SELECT sensor, frame, sum(n)::BIGINT AS n, sum(s)::DOUBLE/sum(n) AS mean, sqrt(sum(n*v)/sum(n)) AS st, sqrt(sum(n*dv)/sum(n)/2) AS tt FROM v GROUP BY ALL)
SELECT sensor, frame, n, round(mean, 6) AS mean, round(st, 6) AS sigma_total, round(tt, 6) AS sigma_temporal, round(sqrt(greatest(0, st*st-tt*tt)), 6) AS sigma_fpn,
 round(CASE WHEN st > 0 THEN 20*log10({TOP}/st) END, 6) AS dr_total_db, round(CASE WHEN tt > 0 THEN 20*log10({TOP}/tt) END, 6) AS dr_temporal_db FROM e"""


@query(f"WITH {SCENE}, {_PAIRS}")
def t02_frame_noise_stream(spark, d):
    """Noise of each frame and the one before of its sensor, as the stream found it."""
    stream, _ = landed(spark, d)
    moments = run_out(noise.consecutive_moments(stream, late="10 minutes"), "moments")
    found = noise.frame_noise(moments, pattern_of(c("sensor") * LOT + c("frame") - 1), TOP)
    return rounded(found, "mean", "sigma_total", "sigma_temporal", "sigma_fpn", "dr_total_db", "dr_temporal_db")


@query(f"WITH {SCENE}, {_PAIRS}")
def t02_frame_noise(spark, d):
    """The batch twin."""
    _, table = landed(spark, d)
    found = noise.frame_noise(noise.consecutive_moments(table), pattern_of(c("sensor") * LOT + c("frame") - 1), TOP)
    return rounded(found, "mean", "sigma_total", "sigma_temporal", "sigma_fpn", "dr_total_db", "dr_temporal_db")


@query(ORACLES["t01_frame_qc"])
def t01_appended_qc(spark, d):
    """Frames' quality values from the parts that the stream appended, batch by batch."""
    stream, _ = landed(spark, d)
    folder = fresh(spark, "qc")
    rows = stream.filter("sensor >= 0").select((c("sensor") * LOT + c("frame")).alias("frame_id"), "codes")
    qc.append_qc(rows, f"{folder}/table", f"{folder}/state").awaitTermination()
    return rounded(qc.read_qc(spark, f"{folder}/table"), "mean", "sigma")
