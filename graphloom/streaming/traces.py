"""Structured Streaming over trace logs: windows, reconciliation with merged state, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces
from ..sources.files import TRACE


def trace_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Trace events of a growing folder of JSON lines, with ts from their epoch seconds."""
    df = spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return df.withColumn("ts", F.timestamp_seconds("timestamp"))


def windowed_edges(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, caller, callee, count): calls by event-time window; events later than late are dropped."""
    counted = events.where("callee IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", width), "caller", "callee").agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").alias("start"), "caller", "callee", "count")


def run_state(routed: DataFrame) -> DataFrame:
    """(caller, callee, kind, count) of a batch of routed events."""
    return routed.where("route IN ('confirmed', 'discovered')").groupBy("caller", "callee", F.col("route").alias("kind")).agg(F.count("*").alias("count"))


def accumulate(events: DataFrame, symbols: DataFrame, edges: DataFrame, state_path: str, checkpoint: str):
    """Starts a query that reconciles each micro-batch with the static graph and merges it into the state under state_path.

    Each version of the state is a folder of its own, named by its batch: a batch that runs again
    overwrites its own version only, starts from the one before it, and adds nothing twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = run_state(traces.route_events(batch.where("callee IS NOT NULL").select("caller", "callee", "source"), symbols, edges))
        old = spark.read.parquet(f"{state_path}/v{number - 1}") if number else run.limit(0)
        traces.merge_state(old, run).write.mode("overwrite").parquet(f"{state_path}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_rate(hits: DataFrame, seconds: int = 60, most: int = 60) -> DataFrame:
    """(key, ts, allowed) of a stream of hits (key string, ts timestamp): at most most allowed hits of a key in any span of seconds.

    State of a key is the times of its allowed hits in the last span, most of them at most.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def check(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values("ts", ignore_index=True)
            allowed = []
            for at in pdf["ts"].astype("int64") / (1e9 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1e6):
                times = [x for x in times if x > at - seconds]
                allowed.append(len(times) < most)
                if allowed[-1]:
                    times.append(at)
            yield pd.DataFrame({"key": pdf["key"], "ts": pdf["ts"], "allowed": allowed})
        state.update((times,))

    return hits.select("key", "ts").groupBy("key").applyInPandasWithState(check, "key string, ts timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
