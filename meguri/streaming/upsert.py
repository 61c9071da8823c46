"""Structured Streaming forms: keyed upserts, breakers and windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from meguri.operators.merge import latest


def event_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_a_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: list, checkpoint: str):
    """Writes a stream as the latest row of each key into alternating folders under ``target``; returns the started query.

    Every micro-batch is united with the table written before, reduced to one
    row a key and written anew beside it, so a lost executor or a repeated
    batch leaves the same table. Read the result with :func:`read_upserted`.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_upserted(spark, target, number)
        rows = batch if before is None else before.unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{target}/v{number:09d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest table that :func:`upsert_stream` wrote whole, of a batch before ``before`` if given."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    whole = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")) and (before is None or int(n[1:]) < before)]
    return spark.read.parquet(f"{target}/{whole[-1]}") if whole else None


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of events by kind in tumbling or sliding windows; on a stream, late rows up to ``late`` are waited for."""
    rows = events.withWatermark(time, late) if late else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(window.alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: events with no pause longer than ``gap``."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("s"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), "n")


def breaker_stream(stream: DataFrame, key: str, failed: str, limit: int) -> DataFrame:
    """``(key, run)`` each time a key's failures in a row reach ``limit``; state is one counter a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        fired = []
        for batch in batches:
            for bad in batch[failed]:
                count = count + 1 if bad else 0
                if count == limit:
                    fired.append(count)
        state.update((count,))
        yield pd.DataFrame({key: [k[0]] * len(fired), "run": fired})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, run long", "count long", "append", GroupStateTimeout.NoTimeout)
