"""Streaming operators; each gives the batch result once its windows close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import scale
from furrow.operators.tables import upsert_status
from furrow.sources.readers import parse_feature_lines


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone; zone-less ones are read in the session zone (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_extract(spark: SparkSession, source: str, sink: str, checkpoint: str,
                   keep: Callable[[DataFrame], DataFrame]) -> int:
    """Resumable scan: filter new feature-line files and append matches; returns rows written so far."""
    lines = spark.readStream.schema("value string").text(source)
    query = (keep(parse_feature_lines(lines)).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(sink).count()


def weekly_composite(events: DataFrame, key: str, value: str, *, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Tumbling seven-day mean and count per key, starting Mondays.

    Works on streams and on tables. Partial aggregation keeps one state row per key and week.
    """
    timed = as_event_time(events, ts)
    if events.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, "7 days", startTime="4 days").alias("w"), key).agg(
        F.avg(value).alias("mean_value"), F.count("*").alias("n")).select(
        F.col("w.start").alias("week_start"), key, "mean_value", "n")


def stream_dedupe(events: DataFrame, keys: list[str], *, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """One row per key; on a stream, repeats within the watermark delay are dropped."""
    timed = as_event_time(events, ts)
    if events.isStreaming:
        return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return scale.first_per_key(timed, keys, [F.col(ts)])


def _collapsed(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row for each key of a batch: a column's last value by ``order``, the largest where that leaves a choice."""
    by = [F.col(order)] if order else []
    return batch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by, F.col(c)))).alias(c)
                                    for c in batch.columns if c not in (key, order)])


def _with_new_keys(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    fresh = changes.select(key).join(table, key, "left_anti")
    return table.unionByName(fresh.select(*[
        F.col(c) if c == key else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def folded_changes(changes: DataFrame, key: str, notes: str = "notes") -> DataFrame:
    """One row for each key of a change log with a ``batch`` number: the last value of each column, all notes in order."""
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch")))

    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col(notes) != "", F.struct("batch", F.col(notes).alias("t"))))),
                        lambda x: x["t"]) if notes in changes.columns else None
    return changes.groupBy(key).agg(*[(F.nullif(F.array_join(texts, " | "), F.lit("")) if c == notes else last(c)).alias(c)
                                      for c in changes.columns if c not in (key, "batch")])


def read_status(spark: SparkSession, path: str, number: int, key: str = "batch_id", every: int = 1) -> DataFrame:
    """The status table after the micro-batch ``number`` (-1: before the first) of a stream that folds ``every`` batches.

    The latest full version is read with the changes logged since, which are one row for each changed key and batch.
    """
    version = (number + 1) // every * every
    table = spark.read.parquet(f"{path}/version={version}")
    if version == number + 1:
        return table
    logged = [f"{path}/changes/batch={n}" for n in range(version, number + 1)]
    changes = folded_changes(spark.read.option("basePath", f"{path}/changes").parquet(*logged), key)
    return upsert_status(_with_new_keys(table, changes, key), changes, key)


def stream_status_upsert(updates: DataFrame, path: str, checkpoint: str, key: str = "batch_id",
                         order: str | None = None, every: int = 1):
    """Apply each micro-batch of status changes to a table kept as numbered versions.

    Of several changes to a key in a batch, each column takes its last value by ``order`` (a time or sequence column),
    the largest where these are equal or ``order`` is not given, so a repeated batch gives the same table.

    With ``every`` above 1 a batch writes the rows that it changes only, to a log; each ``every`` batches the log is
    folded into a full version, so that a batch costs what it changes and a reader at most ``every`` small files more
    (``read_status``). Notes join in the order of batches, as if each had been applied alone.

    A log entry or version is written before its number is used, so a repeated batch after a
    lost executor rewrites the same one.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = _collapsed(batch, key, order)
        if every > 1:
            latest.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
            if (number + 1) % every:
                return
            version = number + 1 - every
            last = spark.read.parquet(f"{path}/version={version}")
            logged = [f"{path}/changes/batch={n}" for n in range(version, number + 1)]
            latest = folded_changes(spark.read.option("basePath", f"{path}/changes").parquet(*logged), key)
        else:
            last = spark.read.parquet(f"{path}/version={number}")
        upsert_status(_with_new_keys(last, latest, key), latest, key).write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    return (updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a bounded stream to its end and return what it emitted; for tests and small checks."""
    query = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Drive a bounded stream into a parquet folder and read it back."""
    query = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)
