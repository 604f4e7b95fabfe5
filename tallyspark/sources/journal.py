"""Tolerant readers and writers of JSON: journals line by line, stored results and earlier histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JOURNAL, RESULT, RESULT_REQUIRED


def journal_lines(backups: DataFrame) -> DataFrame:
    """One JSON object per backup; fields that are null are left out."""
    return backups.select("session_id", "idx", F.to_json(F.struct("original", "backup", "output", "written")).alias("line"))


def parse_journal(lines: DataFrame) -> DataFrame:
    """Lines that are whole: bad ones and those without original or backup are left out."""
    parsed = lines.withColumn("j", F.from_json("line", JOURNAL))
    return parsed.filter("j.original IS NOT NULL AND j.backup IS NOT NULL").select(*[c for c in lines.columns if c != "line"], "j.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The same from text files."""
    return parse_journal(spark.read.text(path).withColumnRenamed("value", "line"))


def append_journal(backups: DataFrame, path: str) -> None:
    journal_lines(backups).select("line").write.mode("append").text(path)


def decode_results(files: DataFrame) -> DataFrame:
    """files with ``result`` as a struct; rows whose document is broken or lacks a required field are dropped, lacking options get their defaults."""
    parsed = files.withColumn("result", F.from_json("result", RESULT))
    whole = reduce(lambda a, b: a & b, [F.col(f"result.{f}").isNotNull() for f in RESULT_REQUIRED])
    false: Column = F.lit(False)
    return parsed.filter(whole).withColumn(
        "result", F.col("result").withField("lossless", F.coalesce("result.lossless", false)).withField("converted", F.coalesce("result.converted", false))
    )


def read_history_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Records kept as one JSON document a file; unreadable ones and odd ids are left out."""
    records = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return records.withColumn("id", F.col("summary.id")).filter(F.col("id").rlike("^[A-Za-z0-9-]{1,32}$"))
