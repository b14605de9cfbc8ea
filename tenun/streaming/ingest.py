"""Incremental runs: new raw files in, checked and prepared once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest_available(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], fmt: str = "parquet", files_per_batch: int = 100, options: dict[str, str] | None = None) -> StreamingQuery:
    """Run ``step`` over the files that arrived since the last call, then stop.

    Batches follow each other and are written under their number, so a batch that
    is tried again after a failure replaces its own output and nothing else. A
    ``step`` that raises leaves the batch, and its files, for the next call.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    stream = spark.readStream.format(fmt).schema(schema).options(**(options or {})).option("maxFilesPerTrigger", files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")


def _seen(order: str, kept: list[str]):
    def mark(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of a key's rows in a batch the order alone is held
        found = np.sort(np.concatenate([part[order].to_numpy() for part in parts]))
        out = pd.DataFrame({order: found, "repeated": np.arange(len(found)) > 0, "across": state.exists})
        for name, value in zip(kept, key):
            out[name] = value
        state.update((True,))
        yield out

    return mark


def mark_seen(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, keys: tuple[str, ...] = ("program", "id"), order: str = "seq") -> StreamingQuery:
    """For every new row ``order, repeated, across`` and its keys: whether its keys came before in its run, and in an earlier run.

    A file of ``source`` is a run; files are taken one after the other, as they arrived. The
    stream's state has one row for each combination of keys, wherever it was seen, so a run
    costs what it holds, and a stream that was stopped goes on with what it knew.
    ``order`` is unique within a run.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    kinds = [T.StructField(order, schema[order].dataType), T.StructField("repeated", T.BooleanType()), T.StructField("across", T.BooleanType()), *(T.StructField(k, schema[k].dataType) for k in keys)]
    marked = rows.select(*keys, order).groupBy(*keys).applyInPandasWithState(_seen(order, list(keys)), T.StructType(kinds), "seen boolean", "append", GroupStateTimeout.NoTimeout)
    query = marked.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums per window and key; on a stream, windows close ``delay`` behind the newest event."""
    given = events.withWatermark(ts, delay) if events.isStreaming else events
    found = given.groupBy(F.window(ts, width), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), key, "events", "total")
