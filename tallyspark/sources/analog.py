"""Ledger views over the relational test tables, built with integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import session_summary
from ..schemas import SKIP_LABELS

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
REASONS = list(SKIP_LABELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, ids: list[str] | None = None) -> DataFrame:
    """One row per processed file: lines of an order are the files of a session; ids: only those of these sessions, by a filter of the scan."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    lines = lines if ids is None else lines.filter(F.col("l_orderkey").isin([int(i) for i in ids]))
    place = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    reasons = ", ".join(f"'{r}'" for r in REASONS)
    return (
        lines.withColumn("idx", F.row_number().over(place).cast("long") - 1)
        .selectExpr("*", "cast(round(l_extendedprice * 100) as bigint) AS ob", "cast(round(l_discount * 100) as bigint) AS pct", "cast(l_quantity as bigint) AS qty", "CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'skipped' ELSE 'failed' END AS status")
        .selectExpr(
            "cast(l_orderkey as string) AS session_id",
            "idx",
            "concat('IMG_', l_partkey, '.jpg') AS name",
            "concat('/Users/u', l_suppkey % 3, '/P', l_suppkey % 7, '/IMG_', l_partkey, '.jpg') AS path",
            "status",
            "status = 'done' AND l_linenumber = 7 AS converted",
            "ob AS original_bytes",
            "CASE WHEN status <> 'done' THEN ob WHEN l_linenumber = 7 THEN ob + ob div 4 WHEN l_linenumber = 6 THEN ob + 1000000 ELSE ob - (ob * pct * 5) div 100 END AS output_bytes",
            f"CASE WHEN status = 'skipped' THEN array({reasons})[cast(qty % 11 as int)] END AS skip_reason",
            "CASE WHEN status = 'failed' THEN 'decode' END AS error",
            "CASE WHEN status = 'done' THEN 60 + qty % 38 END AS quality",
            "status = 'done' AND l_linestatus = 'F' AS lossless",
        )
    )


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, started_at) of all sessions, from two columns of orders."""
    return table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) AS id", "unix_millis(cast(o_orderdate as timestamp)) AS started_at")


def sessions(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, ids: list[str] | None = None) -> DataFrame:
    """One row per order; orders without lines are sessions without files."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    orders = orders if ids is None else orders.filter(F.col("o_orderkey").isin([int(i) for i in ids]))
    totals = session_summary(files(spark, sf_dir) if of is None else of)
    zero = [f"coalesce({c}, 0L) AS {c}" for c in ("photos", "optimized", "skipped", "failed", "original_bytes", "output_bytes", "saved_bytes")]
    joined = orders.selectExpr(
        "cast(o_orderkey as string) AS id", "o_orderkey % 17 = 0 AS undone", "unix_millis(cast(o_orderdate as timestamp)) AS started_at",
        "CASE WHEN o_orderstatus = 'O' THEN 'export' ELSE 'replace' END AS output_mode",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'pristine' WHEN '5-LOW' THEN 'compact' ELSE 'identical' END AS strength",
    ).join(totals.withColumnRenamed("session_id", "id"), "id", "left")
    return (
        joined.selectExpr("id", "started_at", "output_mode", "strength", "undone", *zero)
        .selectExpr("*", "started_at + 1000 * photos AS finished_at", "output_mode = 'replace' AND NOT undone AND optimized > 0 AS can_undo")
        .select("id", "started_at", "finished_at", "photos", "optimized", "skipped", "failed", "original_bytes", "output_bytes", "saved_bytes", "output_mode", "strength", "can_undo", "undone")
    )


def backups(all_files: DataFrame, all_sessions: DataFrame) -> DataFrame:
    """Backups of what sessions in replace mode have rewritten."""
    return (
        all_files.filter("status = 'done'")
        .join(all_sessions.filter("output_mode = 'replace'").selectExpr("id AS session_id", "started_at"), "session_id")
        .selectExpr(
            "session_id", "idx", "path AS original", "concat('/backups/', session_id, '/', lpad(cast(idx as string), 5, '0'), '-', name) AS backup",
            "CASE WHEN converted THEN replace(path, '.jpg', '.JPG') END AS output", "struct(output_bytes AS bytes, started_at AS modifiedMs) AS written",
            "original_bytes", "output_bytes", "converted",
        )
    )


def disk(all_backups: DataFrame) -> DataFrame:
    """Backup files that are still there: (path, session_id, bytes)."""
    return all_backups.filter("(original_bytes + idx) % 5 <> 0").selectExpr("backup AS path", "session_id", "original_bytes AS bytes")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: what header inspection and both encoders would say of a photo."""
    return (
        table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) AS k", "cast(p_size as bigint) AS s")
        .selectExpr(
            "k AS id", "64 + (37 * k) % 7000 AS width", "64 + (53 * k) % 5000 AS height", "1 + k % 8 AS orientation",
            "CASE WHEN s % 20 = 0 THEN 'exotic' WHEN s % 2 = 0 THEN 'baseline' ELSE 'progressive' END AS kind",
            "CASE WHEN s % 10 = 1 THEN 4 WHEN s % 10 = 2 THEN 1 ELSE 3 END AS components", "CASE WHEN s % 25 = 3 THEN 12 ELSE 8 END AS bits",
            "s % 15 = 4 AS embedded", "k % 23 = 0 AS has_marker", "70 + k % 30 AS quality_estimate", "50000 + 1000 * k AS original_bytes",
        )
        .selectExpr("*", "(original_bytes * (40 + id % 70)) div 100 AS perceptual_bytes", "(original_bytes * (93 + id % 8)) div 100 AS lossless_bytes")
    )
