"""Command line: smaller JPEGs from photos and folders, a line per photo, a footer, and an exit code.

``python -m tallyspark.cli PATH...``; bytes of new files are written by the tasks that made them.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import bytes_text, export_path
from .operators import batch
from .schemas import STRENGTHS
from .sources import effects

FOLDER = "Optimized"


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyspark", description="Smaller JPEGs that look the same.")
    parser.add_argument("paths", nargs="+", help="photos or folders")
    parser.add_argument("-s", "--strength", choices=STRENGTHS, default="identical")
    where = parser.add_mutually_exclusive_group()
    where.add_argument("--in-place", action="store_true", help="overwrite the originals")
    where.add_argument("-o", "--out", help=f"write copies here (default: a folder {FOLDER} next to each photo)")
    side = parser.add_mutually_exclusive_group()
    for mode in ("long_edge", "max_width", "max_height"):
        side.add_argument("--" + mode.replace("_", "-"), type=int, metavar="N")
    parser.add_argument("--strip-location", action="store_true")
    parser.add_argument("--force", action="store_true", help="take photos that have been optimized already")
    parser.add_argument("--heic", action="store_true", help="convert HEIC photos (none can be decoded here: they are skipped as unsupported)")
    parser.add_argument("--dry-run", action="store_true", help="report, but write nothing")
    return parser.parse_args(argv)


def options(given: argparse.Namespace) -> batch.Options:
    mode = next((m for m in ("long_edge", "max_width", "max_height") if getattr(given, m)), None)
    return batch.Options(given.strength, mode, mode and getattr(given, mode), given.strip_location, not given.force, given.heic)


def paths_of(argv: list[str], folder: str) -> list[str]:
    """Paths among a program's arguments: without its name, flags and what doesn't exist, relative ones below ``folder``."""
    found = [os.path.normpath(os.path.join(folder, a)) for a in argv[1:] if not a.startswith("-")]
    return [p for p in found if os.path.exists(p)]


class OpenedPaths:
    """Paths that were opened from outside, until somebody takes them all."""

    def __init__(self):
        self._held: list[str] = []

    def push(self, *paths: str) -> None:
        self._held += paths

    def take(self) -> list[str]:
        held, self._held = self._held, []
        return held


def lines(rows: DataFrame) -> DataFrame:
    """One line of text per outcome, in batch order."""
    size = lambda c: bytes_text(F.col(c), 1024)
    saved = F.round(100 * (1 - F.col("output_bytes") / F.col("original_bytes"))).cast("int")
    done = F.format_string("  %4d%%  %s  %s -> %s  q%d, score %.1f", saved, "path", size("original_bytes"), size("output_bytes"), "quality", "score")
    text = F.when(F.col("status") == "done", done).when(F.col("status") == "skipped", F.format_string("  skip  %s  (%s)", "path", "skip_reason")).otherwise(F.format_string("  fail  %s: %s", "path", "error"))
    return rows.select("ordinal", "status", text.alias("line")).orderBy("ordinal")


def footer(rows: DataFrame, dry_run: bool) -> DataFrame:
    """One row: line and number of failures."""
    failed = F.col("status") == "failed"
    counts = rows.agg(
        F.count_if(F.col("status") == "done").alias("optimized"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(~failed, F.col("original_bytes"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(~failed, F.col("output_bytes"))), F.lit(0)).alias("after"),
    )
    share = F.when(F.col("before") > 0, 100 * (1 - F.col("after") / F.col("before"))).otherwise(0.0)
    saved = counts.withColumn("saved", F.greatest(F.col("before") - F.col("after"), F.lit(0)))
    text = F.format_string("%d optimized, %d skipped, %d failed, saved %s (%.1f%%)" + (" [dry run]" if dry_run else ""), "optimized", "skipped", "failed", bytes_text(F.col("saved"), 1024), share)
    return saved.select(text.alias("line"), "failed")


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    given = arguments(argv)
    spark = spark or SparkSession.builder.appName("tallyspark").getOrCreate()
    asked = options(given)
    listing, photos = batch.read_photos(spark, [os.path.abspath(p) for p in given.paths])
    listing = listing.cache()
    if listing.isEmpty():
        print("no photos found", file=sys.stderr)
        return 1
    named = photos.join(listing.select("path", "root"), "path")
    outcomes = batch.optimize(named, asked).join(listing.select("path", "root", "ordinal"), "path")
    if given.dry_run:
        results = outcomes.drop("output")
    elif given.in_place:
        results = effects.apply_results(outcomes.withColumn("destination", F.lit(None).cast("string")), effects.NO_BACKUP)
    else:
        parent, name = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", "[^/]*$", 0)
        beside = F.concat(parent, F.lit(f"/{FOLDER}/"), name)
        target = beside if given.out is None else export_path(F.col("path"), F.col("root"), os.path.abspath(given.out), F.lit("original"), 1)
        results = effects.apply_results(outcomes.withColumn("destination", target), None)
    rows = batch.with_unread(listing, results.drop("preview", "root", "ordinal")).cache()
    for row in lines(rows).toLocalIterator():
        print(row.line, file=sys.stderr if row.status == "failed" else sys.stdout)
    end = footer(rows, given.dry_run).first()
    print("\n" + end.line)
    return 1 if end.failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
