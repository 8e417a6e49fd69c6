"""Ground-truth tasks in YAML files, where the yaml library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import agreement

TASK = "task_id string, repo string, seed_symbol string, task_type string, kappa double, adjudicated boolean, pipeline array<string>, error string"


def load_tasks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Accepted tasks, and rejected ones with a reason: what can't be read, lacks a field or fails the agreement gate."""

    def parse(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                try:
                    d = yaml.safe_load(value)
                    best = d.get("adjudicated") or d.get("annotation_a") or {}
                    rows.append((d["task_id"], d["repo"], d["seed_symbol"], d["task_type"], d.get("cohen_kappa"), bool(d.get("adjudicated")), best.get("pipeline_symbols") or [], None))
                except Exception as e:  # noqa: BLE001  any file may be anything
                    rows.append((None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TASK.split(", ")])

    tasks = spark.read.text(folder, wholetext=True).mapInPandas(parse, TASK)
    gate = agreement(F.coalesce("kappa", F.lit(0.0)), F.coalesce("adjudicated", F.lit(False)))
    judged = tasks.withColumn("reason", F.coalesce("error", F.when(gate != "accept", gate)))
    return judged.where("reason IS NULL").drop("reason", "error"), judged.where("reason IS NOT NULL").select("task_id", "reason")
