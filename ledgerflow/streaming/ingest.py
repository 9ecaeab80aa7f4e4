"""Streaming ingestion of statements: an extension, built from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.operators.canonical import RAW_ROWS
from ledgerflow.operators.validate import duplicate_key


def landing(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of CSV files as they land in a folder."""
    return spark.readStream.schema(RAW_ROWS).option("header", True).csv(path)


def distinct_transactions(ledger: DataFrame, delay: str = "30 days") -> DataFrame:
    """First of each duplicate key within the watermark; state of older keys is dropped."""
    keyed = ledger.withColumn("event_time", F.col("transaction_date").cast("timestamp")).withColumn("key", F.concat_ws("|", "statement_id", duplicate_key()))
    return keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["key"]).drop("key")


def weekly_totals(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Sum and count by week and type of a stream of (ts, event_type, value); late events count until the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "7 days"), "event_type").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("events"))


def write(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to Parquet, once over what is there; the checkpoint makes a restart go on where it stopped."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
