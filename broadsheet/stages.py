"""Jobs in stages, so that the shuffle files of one are gone before the next begins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def lazy(df: DataFrame, name: str) -> DataFrame:
    """No stage: ``df`` as it is. Operators that can run in stages do so where the caller gives ``staged`` instead."""
    return df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again; without such a folder it stays as it is.

    Spark keeps all shuffle files of a query until its end. A stage leaves its rows alone, compressed by column, and its shuffle files are removed.
    """
    spark = df.sparkSession
    shared = folder(spark)
    if shared is None:
        return df
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
