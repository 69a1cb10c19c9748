"""Structured Streaming over event and check tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total for each window; the watermark bounds the state. Works on batches as well."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def new_rows(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once: what a resumed run skips."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def changes(checks: DataFrame) -> DataFrame:
    """file, result, status: each check against the last one of its file, which is kept as state."""

    def step(key, frames, state):
        import pandas as pd

        # A file's checks of one trigger may come in several frames: they are put in order together.
        rows, out = pd.concat(list(frames)).sort_values("ts", kind="stable"), []
        before = state.get[0] if state.exists else None
        for result in rows["result"]:
            out.append((key[0], result, "first" if before is None else "unchanged" if before == result else "changed"))
            before = result
        state.update((before,))
        yield pd.DataFrame(out, columns=["file", "result", "status"])

    return checks.groupBy("file").applyInPandasWithState(step, "file string, result string, status string", "result string", "append", "NoTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
