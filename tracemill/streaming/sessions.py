"""Streams: session files as they are appended, event-time activity windows, and a resumable scoring pass with a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.schema import EVENT_TYPES
from tracemill.sources.session_log import EVENT


def read_session_stream(spark: SparkSession, path: str) -> DataFrame:
    """Known events of new session files: file source, one row a line, typed columns and a real timestamp."""
    lines = spark.readStream.option("pathGlobFilter", "*.jsonl").text(path)
    e = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").filter(F.col("type").isin(*EVENT_TYPES))
    return e.withColumn("event_time", F.try_to_timestamp("timestamp"))


def activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per session and stretch of activity: session windows closed by ``gap``, rows later than ``late`` dropped."""
    w = events.filter("event_time is not null").withWatermark("event_time", late)
    return w.groupBy("sessionId", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n_events")).select("sessionId", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n_events")


def scoring_pass(units: DataFrame, score: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str) -> StreamingQuery:
    """Score a stream of units once each: units already complete in the ledger are left out, attempts are appended atomically.

    ``score`` maps units (unit_id, text) to attempts (unit_id, attempt, valid, score). After a crash the batch is scored again
    only for units that the ledger lacks.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.parquet(ledger).groupBy("unit_id").agg(F.max("valid").alias("v"), F.count("*").alias("n")).filter("v or n >= 2").select("unit_id")
            df = df.join(done, "unit_id", "left_anti")
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        score(df).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(ledger)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
