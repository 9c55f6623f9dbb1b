"""Stage report over a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.reports import STAGE_LABELS, fill_stages
from broadsheet.operators.registry import register_files


def stage_updates(logs: DataFrame) -> DataFrame:
    """Latest entry of each job and stage, for update or complete mode.

    A full report of a job is ``fill_stages`` over the latest of these rows.
    """
    known = logs.where(F.col("step_name").isin(*[k for k, _ in STAGE_LABELS]))
    return known.groupBy("job_id", "step_name").agg(
        F.max_by(F.struct("status", "message", "created_at"), F.struct("created_at", "log_id")).alias("l"),
        F.bool_or(F.col("status") == "failed").alias("failed"))


def register_stream(found: DataFrame, registry_path: str, checkpoint: str):
    """Writer that adds each new (path, hash) of a stream to the registry table once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "source_path string, file_hash string, file_size long"
        registry = spark.read.schema(schema).parquet(registry_path)
        created = register_files(registry, batch).where("created").drop("created")
        created.write.mode("append").parquet(registry_path)

    return found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)


__all__ = ["fill_stages", "register_stream", "stage_updates"]
