"""Append-only record of runs, their metrics and their model signatures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from transferlens.schema import RUN_METRICS, RUNS


class RunLog:
    """Two Parquet tables, ``run_metrics`` and ``runs``, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log_metrics(self, report: DataFrame, run_id: str, metrics: list[str], ts_ms: int, step: int = 0, by: str | None = None) -> None:
        """Appends one row per metric of a report table. ``by`` extends the run id with a column."""
        run = F.concat_ws("/", F.lit(run_id), F.col(by)) if by else F.lit(run_id)
        rows = report.select(run.alias("run_id"), *[F.col(m).cast("double").alias(m) for m in metrics])
        rows = rows.unpivot(["run_id"], metrics, "metric", "value").select(
            "run_id", "metric", F.lit(ts_ms).cast("bigint").alias("ts_ms"), "value", F.lit(step).alias("step")
        )
        rows.write.mode("append").parquet(f"{self.path}/run_metrics")

    def log_run(self, run_id: str, start_ms: int, end_ms: int, status: str, source: str) -> None:
        row = self.spark.createDataFrame([(run_id, start_ms, end_ms, status, source)], RUNS)
        row.write.mode("append").parquet(f"{self.path}/runs")

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(RUN_METRICS).parquet(f"{self.path}/run_metrics")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")


def save_signature(inputs: DataFrame, outputs: DataFrame, path: str) -> None:
    """Keeps the input and output schema of a model as one JSON line."""
    text = json.dumps({"inputs": json.loads(inputs.schema.json()), "outputs": json.loads(outputs.schema.json())})
    inputs.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_signature(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def check_signature(df: DataFrame, signature: dict) -> None:
    """Fails when a column the model needs is absent or has another type."""
    have = {f["name"]: f["type"] for f in json.loads(df.schema.json())["fields"]}
    for field in signature["inputs"]["fields"]:
        if field["name"] not in have:
            raise ValueError(f"input column {field['name']} is missing")
        if have[field["name"]] != field["type"]:
            raise ValueError(f"input column {field['name']} has type {have[field['name']]}, not {field['type']}")
