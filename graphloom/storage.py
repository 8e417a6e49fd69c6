"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Bytes that may be sent to every executor.
BROADCAST_LIMIT = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a folder of this machine on a local master, as in tests, and an error on any other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + _own.setdefault("dir", tempfile.mkdtemp(prefix="graphloom-"))
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, each: int = 500_000) -> DataFrame:
    """df written in buckets of key, about each rows in one, so that joins and groups on key read it without a shuffle."""
    rows, path = written(df), shared_dir(df.sparkSession)
    n, name = tasks_for(rows.count(), each), "graphloom_" + uuid.uuid4().hex
    rows.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def sized(df: DataFrame, rows: int, row_bytes: int = 64, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df marked for broadcast if its size is within limit; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def tasks_for(rows: int, each: int = 2_000_000) -> int:
    """Tasks for a step that makes about so many rows, however few bytes it reads."""
    return max(1, min(4096, rows // each))


def dealt(df: DataFrame, key: str, each: int = 5_000) -> DataFrame:
    """df dealt by key to tasks of about each rows, for work that is long for the bytes of a row; the number is fixed, so that adaptive execution doesn't join the tasks again."""
    return df.repartition(tasks_for(df.count(), each), F.xxhash64(key))
