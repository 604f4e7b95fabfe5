"""Snapshot-to-snapshot maintenance: retention, reconciliation, discarding, recovery, undo and upsert.

Tables are immutable here: every operation takes DataFrames of one state and returns those of
the next one; ``sources.snapshots`` commits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
VALID_ID = "^[A-Za-z0-9-]{1,32}$"


def valid_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.filter(F.col(column).rlike(VALID_ID))


def undoable_ids(sessions: DataFrame) -> DataFrame:
    return sessions.filter("can_undo").select("id")


def expired(folders: DataFrame, now_ms: int, days: int, column: str = "id") -> DataFrame:
    """Backup folders named by an instant strictly older than ``days`` before now; other names never expire."""
    limit = max(now_ms - days * DAY_MS, 0)
    return folders.filter(F.col(column).rlike("^[0-9]+$") & (F.expr(f"try_cast({column} AS BIGINT)") < limit))


def discard(sessions: DataFrame, backups: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions that can no longer be undone, and backups without theirs; totals stay as they are."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    marked = sessions.join(gone, "id", "left").withColumn("can_undo", F.col("can_undo") & F.col("__gone").isNull()).drop("__gone")
    return marked, backups.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def discard_finished(sessions: DataFrame, backups: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discards every folder on disk that a recorded session owns; folders of running sessions are spared."""
    owned = disk.select(F.col("session_id").alias("id")).distinct().join(sessions.select("id"), "id", "left_semi")
    return discard(sessions, backups, owned)


def reconcile_plan(sessions: DataFrame, backups: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, recorded, on_disk, decision) of undoable sessions: keep, shrink or discard."""
    there = disk.select(F.col("path").alias("backup"), F.lit(1).alias("there"))
    counts = backups.join(there, "backup", "left").groupBy("session_id").agg(F.count("*").alias("recorded"), F.count("there").alias("on_disk"))
    joined = sessions.filter("can_undo").select("id").join(counts.withColumnRenamed("session_id", "id"), "id", "left")
    filled = joined.select("id", F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("on_disk", F.lit(0)).alias("on_disk"))
    return filled.withColumn("decision", F.when(F.col("on_disk") == 0, "discard").when(F.col("on_disk") < F.col("recorded"), "shrink").otherwise("keep"))


def reconcile(sessions: DataFrame, backups: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after bringing undoable sessions in line with the disk; running it again changes nothing."""
    gone = reconcile_plan(sessions, backups, disk).filter("decision = 'discard'").select("id")
    marked, left = discard(sessions, backups, gone)
    undoable = sessions.filter("can_undo").select(F.col("id").alias("session_id")).withColumn("__checked", F.lit(True))
    checked = left.join(undoable, "session_id", "left").join(disk.select(F.col("path").alias("backup"), F.lit(True).alias("__there")).distinct(), "backup", "left")
    return marked, checked.filter("__checked IS NULL OR __there").select(*backups.columns)


def recover(journal: DataFrame, sessions: DataFrame, disk: DataFrame) -> DataFrame:
    """Sessions synthesised from the journals of folders without a record.

    journal: (session_id, original, backup, written) with bad lines already left out.  Lines
    whose backup has gone don't count; bytes include conversions, unlike in a summary.
    """
    lines = journal.join(disk.select(F.col("path").alias("backup"), F.col("bytes").alias("backup_bytes")), "backup")
    unknown = valid_ids(lines, "session_id").join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    sums = unknown.groupBy("session_id").agg(
        F.count("*").alias("photos"), F.coalesce(F.sum("backup_bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("written.bytes"), F.lit(0)).alias("output_bytes")
    )
    return sums.select(
        F.col("session_id").alias("id"), "photos", F.col("photos").alias("optimized"), "original_bytes", "output_bytes",
        F.greatest(F.col("original_bytes") - F.col("output_bytes"), F.lit(0)).alias("saved_bytes"), F.lit(True).alias("can_undo"), F.lit(False).alias("undone"),
    )


def undo(sessions: DataFrame, files: DataFrame, backups: DataFrame, disk: DataFrame) -> DataFrame:
    """Undoable sessions after restoring what can be restored.

    A backup is restored if it is on disk and its output is unchanged (``intact``).  Savings of
    restored rows that aren't conversions are taken back row by row and added to the output;
    ``optimized`` falls by the number of different restored paths; original bytes stay.
    """
    there = disk.select(F.col("path").alias("backup"), F.lit(True).alias("there"))
    mine = backups.join(sessions.filter("can_undo").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    tried = mine.join(there, "backup", "left").withColumn("ok", F.coalesce("there", F.lit(False)) & F.col("intact"))
    counts = tried.groupBy("session_id").agg(F.count_if("ok").alias("restored"), F.count_if(~F.col("ok")).alias("kept"))
    paths = tried.filter("ok").select("session_id", F.col("original").alias("path")).distinct()
    back = files.join(paths, ["session_id", "path"], "left_semi").groupBy("session_id").agg(
        F.count_distinct("path").alias("paths"),
        F.coalesce(F.sum(F.when(~F.col("converted"), F.greatest(F.col("original_bytes") - F.col("output_bytes"), F.lit(0)))), F.lit(0)).alias("taken_back"),
    )
    joined = sessions.filter("can_undo").join(counts.withColumnRenamed("session_id", "id"), "id", "left").join(back.withColumnRenamed("session_id", "id"), "id", "left")
    zero = F.lit(0).cast("long")
    taken, n, left = F.coalesce("taken_back", zero), F.coalesce("paths", zero), F.coalesce("kept", zero)
    return joined.select(
        "id", F.coalesce("restored", zero).alias("restored"), left.alias("kept"), F.greatest(F.col("optimized") - n, zero).alias("optimized"), "original_bytes",
        (F.col("output_bytes") + taken).alias("output_bytes"), F.greatest(F.col("saved_bytes") - taken, zero).alias("saved_bytes"),
        (left > 0).alias("can_undo"), (left == 0).alias("undone"),
    )


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in new replaced by new's rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def orphans(children: DataFrame, parents: DataFrame, child_key: str = "session_id", parent_key: str = "id") -> DataFrame:
    """Rows that break the reference from children to parents."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
