"""Corpus pipeline: stages that each write what they keep and hand it to the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import stages
from tallyspark.llm.common import cleared, delete, is_written, shared_dir, table

#: (name, function of (spark, docs, sf_dir)), in order; all but the last return the columns of documents.
STAGES = stages.STAGES

#: SQL can't train and apply the toxicity classifier of the first stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared folder and read again.

    What a stage's operators write beside goes with the stage.  base: a folder of the caller's that stages' rows
    stay in; a run with the same one goes on behind the last stage that was written to its end.  Without
    it the folder is a new one, and only the last stage's rows stay.
    """
    docs, folder, last = table(spark, sf_dir, "documents"), base or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        if not is_written(spark, path):
            with cleared(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if last and not base:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
