"""The folder that driver and executors share, and tables written there to cut a long or undetermined lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str = "stream") -> str:
    """A new folder under ``spark.checkpoint.dir``; a cluster without one is an error, only local mode has its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-veil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/veil-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as it is now, whatever reads it how often: what is lost with an executor is read again, not made again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
