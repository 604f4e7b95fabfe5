"""Ledger reads: summaries, totals, history pages and nested records over sessions, files and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Page of the history, and its bounds.
PAGE, PAGE_MAX = 50, 10_000


def saved(original: Column, output: Column) -> Column:
    """original - output, never below 0."""
    return F.greatest(original - output, F.lit(0).cast("long"))


def session_summary(files: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts by status over all rows, bytes over rows that aren't conversions, savings clamped on the total."""
    plain = ~F.col("converted")
    sums = files.groupBy(key).agg(
        F.count("*").alias("photos"),
        F.count_if(F.col("status") == "done").alias("optimized"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(plain, F.col("original_bytes"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(plain, F.col("output_bytes"))), F.lit(0)).alias("output_bytes"),
    )
    return sums.withColumn("saved_bytes", saved(F.col("original_bytes"), F.col("output_bytes")))


def live_stats(files: DataFrame, *keys: str) -> DataFrame:
    """Statistics as shown while a session runs: conversions only count as such, savings are clamped row by row."""
    plain = ~F.col("converted")
    return files.groupBy(*keys).agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("converted")).alias("converted"),
        F.count_if(plain & (F.col("status") == "done")).alias("optimized"),
        F.coalesce(F.sum(F.when(plain, F.col("original_bytes"))), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum(F.when(plain, F.col("output_bytes"))), F.lit(0)).alias("output_bytes"),
        F.coalesce(F.sum(F.when(plain, saved(F.col("original_bytes"), F.col("output_bytes")))), F.lit(0)).alias("saved_bytes"),
    )


def batch_totals(files: DataFrame) -> DataFrame:
    """Totals of a command-line batch: skipped files count before and after, conversions and failures in neither."""
    counted = F.col("status").isin("done", "skipped") & ~F.col("converted")
    sums = files.agg(
        F.count_if(F.col("status") == "done").alias("optimized"),
        F.count_if(F.col("converted")).alias("converted"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(counted, F.col("original_bytes"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(counted, F.col("output_bytes"))), F.lit(0)).alias("after"),
    )
    left = saved(F.col("before"), F.col("after"))
    return sums.withColumn("saved", left).withColumn("saved_permille", F.when(F.col("before") == 0, 0).otherwise(F.expr("saved * 1000 div before")).cast("long"))


def totals(sessions: DataFrame) -> DataFrame:
    """All-time totals in one row, also over no sessions; undone sessions count."""
    sums = sessions.agg(
        F.coalesce(F.sum("saved_bytes"), F.lit(0)).alias("saved_bytes"),
        F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"),
        F.coalesce(F.sum("optimized"), F.lit(0)).alias("photos"),
        F.count("*").alias("sessions"),
        F.min("started_at").alias("since"),
    )
    return sums.withColumn("reduction_permille", F.expr("CASE WHEN original_bytes = 0 THEN 0L ELSE saved_bytes * 1000 div original_bytes END"))


def page_size(limit: int | None) -> int:
    return min(max(PAGE if limit is None else limit, 1), PAGE_MAX)


def history_page(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest sessions; ties of the start go by id as text, descending."""
    return sessions.orderBy(F.desc("started_at"), F.desc("id")).limit(page_size(limit))


def with_disk_state(files: DataFrame, backups: DataFrame, disk: DataFrame, outputs_on_disk: Column) -> DataFrame:
    """files with original_path (the backup if it is still there) and output_path (null once the output has gone)."""
    found = backups.select("session_id", "idx", "backup").join(disk.select(F.col("path").alias("backup")), "backup", "left_semi")
    return files.join(found, ["session_id", "idx"], "left").withColumns(
        {"original_path": F.col("backup"), "output_path": F.when((F.col("status") == "done") & outputs_on_disk, F.col("path"))}
    )


def comparable(files: DataFrame) -> DataFrame:
    """Rows of ``with_disk_state`` whose original and first output can be shown side by side."""
    return files.filter((F.col("status") == "done") & F.col("original_path").isNotNull() & F.col("output_path").isNotNull())


def backup_sizes(disk: DataFrame) -> DataFrame:
    """Bytes of backups on disk by session."""
    return disk.groupBy("session_id").agg(F.sum("bytes").alias("backup_bytes"))


def history_overview(sessions: DataFrame, stated: DataFrame, disk: DataFrame, origins: DataFrame, limit: int | None = None) -> DataFrame:
    """A page of the history in one plan: the top sessions first, then their backup bytes, comparability and origin."""
    page = history_page(sessions, limit)
    ids = page.select(F.col("id").alias("session_id"))
    sizes = backup_sizes(disk.join(F.broadcast(ids), "session_id", "left_semi"))
    shown = comparable(stated.join(F.broadcast(ids), "session_id", "left_semi")).select("session_id").distinct().withColumn("any", F.lit(True))
    near = origins.join(F.broadcast(ids), "session_id", "left_semi")
    return (
        page.join(sizes.withColumnRenamed("session_id", "id"), "id", "left")
        .join(shown.withColumnRenamed("session_id", "id"), "id", "left")
        .join(near.withColumnRenamed("session_id", "id"), "id", "left")
        .withColumns({"comparable": ~F.col("undone") & F.coalesce("any", F.lit(False)), "backup_bytes": F.coalesce("backup_bytes", F.lit(0))})
        .drop("any")
    )


def nested_records(sessions: DataFrame, files: DataFrame, backups: DataFrame) -> DataFrame:
    """Sessions with their results and backups as arrays in order of idx."""
    results = files.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "path", "status", "original_bytes", "output_bytes"))).alias("results"))
    kept = backups.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "original", "backup", "output"))).alias("backups"))
    joined = sessions.join(results, sessions["id"] == results["session_id"], "left").drop("session_id")
    joined = joined.join(kept, joined["id"] == kept["session_id"], "left").drop("session_id")
    return joined.withColumns({"results": F.coalesce("results", F.array()), "backups": F.coalesce("backups", F.array())})
