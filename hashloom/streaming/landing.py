"""Extension: the same work on streams. A landing folder of tables is matched as files come; events are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import shortlist, vote_cascade


def match_landing(spark: SparkSession, folder: str, schema: str, index: DataFrame, libs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Shortlists of units whose hashes land in folder (app_id, unit_id, hash, weight), a micro-batch at a time."""
    rows = spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, epoch: int) -> None:
        votes = vote_cascade([batch], [index], [[]], ["app_id", "unit_id"])
        shortlist(votes, libs, ["app_id", "unit_id"]).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window_start, keys, n, total of event values; on a stream, rows later than late are dropped by the watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")
