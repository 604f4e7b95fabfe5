"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only local sessions without it get a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return tempfile.mkdtemp(prefix="tallyspark-")


def written(df: DataFrame) -> DataFrame:
    """The rows as written once: whatever reads them sees the same ones, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
