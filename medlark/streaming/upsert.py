"""Structured Streaming twin of the cohort's latest versions, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The row of largest order for each key, as a streaming aggregate (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("row")).select(key, "row.*")


def windowed_counts(stream: DataFrame, ts: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Counts by event-time window. In update or append mode, windows that the watermark has passed take no further rows; in
    complete mode nothing is ever late."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Drains what is there into a memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def drained(df: DataFrame, folder: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Runs a streaming query over what is there and reads its result. Complete mode: the last micro-batch's table. Update
    mode, in which a watermark drops late rows and closes windows: the last row of each of the `keys`."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result" if mode == "complete" else f"{folder}/result/batch={n}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = df.sparkSession.read.parquet(f"{folder}/result")
    if mode == "complete":
        return out
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")
