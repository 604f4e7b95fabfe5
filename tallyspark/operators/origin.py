"""Where a session's files came from: common folder, its kind and how it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many files of one folder are named one by one.
FEW_FILES = 3


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of sorted arrays: that of the smallest and the largest one."""
    n = F.least(F.size(low), F.size(high))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.element_at(low, i) != F.element_at(high, i))
    return F.slice(low, F.lit(1), F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def shorten_home(path: Column, home: str) -> Column:
    """The home folder as ``~``, by whole components."""
    return F.when(path == home, F.lit("~")).when(path.startswith(home + "/"), F.concat(F.lit("~/"), F.substring(path, F.lit(len(home) + 2), F.length(path)))).otherwise(path)


def session_origins(files: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session with files: origin_kind (files, folder, folders, scattered), origin_name, origin_count and origin_path.

    Needs path and idx.  One pass of partial aggregates: no list of files is ever collected.
    """
    folder = components(parent_of(F.col("path")))
    sums = files.withColumn("folder", folder).groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct("folder").alias("folders"), F.min("folder").alias("low"), F.max("folder").alias("high"), F.min_by("path", "idx").alias("first")
    )
    common = sums.withColumn("common", common_prefix(F.col("low"), F.col("high")))
    one, meaningful = F.col("folders") == 1, F.size("common") >= 2
    kind = F.when(one & (F.col("n") <= FEW_FILES), "files").when(one, "folder").when(~meaningful, "scattered").otherwise("folders")
    named = common.withColumn("origin_kind", kind)
    last = F.try_element_at("common", F.lit(-1))
    return named.select(
        key,
        "origin_kind",
        F.when(F.col("origin_kind") == "files", F.regexp_extract("first", "[^/]*$", 0)).when(F.col("origin_kind") != "scattered", last).alias("origin_name"),
        F.when(F.col("origin_kind") == "files", F.col("n") - 1).when(F.col("origin_kind") == "folders", F.col("folders")).alias("origin_count"),
        F.when(F.col("origin_kind") != "scattered", F.concat(F.lit("/"), F.concat_ws("/", "common"))).alias("origin_path"),
    )
