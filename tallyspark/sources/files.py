"""Listings of photo folders: a data source that walks directories as the batch dataflow needs it.

Unlike Spark's file sources it keeps names that start with an underscore and doesn't follow
links: hidden names, links and other extensions are skipped below a folder, loose files always
stay.  Each folder right below one that is asked for is a partition, and rows come out in path order.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".jpg", ".jpeg", ".jpe", ".jfif", ".heic", ".heif", ".hif")
SCHEMA = "path string, root string, bytes long, modified_ms long, ordinal long"


class _Part(InputPartition):
    """Paths that are listed by one task, in order: files, or folders to be walked."""

    def __init__(self, paths: list[str], root: str | None, first: int):
        self.paths, self.root, self.first = paths, root, first


class PhotoListing(DataSource):
    """format("photos"), option paths: a JSON list of absolute files and folders."""

    @classmethod
    def name(cls) -> str:
        return "photos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        """Each folder directly below one that is asked for is a task of its own, and so are the files between two of them."""
        parts: list[tuple[list[str], str | None]] = []
        for path in self.paths:
            if not os.path.isdir(path):
                parts.append(([path], None))
                continue
            files: list[str] = []
            for entry in _entries(path):
                if entry.is_dir():
                    parts += [(files, path)] if files else []
                    parts.append(([entry.path], path))
                    files = []
                else:
                    files.append(entry.path)
            parts += [(files, path)] if files else []
        # without any partition Spark would ask for the rows of None
        return [_Part(paths, root, n << 40) for n, (paths, root) in enumerate(parts or [([], None)])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        n = 0
        for path in partition.paths:
            for found in walk(path) if os.path.isdir(path) else [path]:
                if os.path.isfile(found):
                    stat = os.stat(found)
                    yield found, partition.root, stat.st_size, max(0, stat.st_mtime_ns // 1_000_000), partition.first + n
                    n += 1


def _entries(folder: str) -> list[os.DirEntry]:
    """Folders and photos of a folder by name, without hidden names and links; none if it can't be read."""
    try:
        found = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
    except OSError:
        return []
    shown = [e for e in found if not e.name.startswith(".") and not e.is_symlink()]
    return [e for e in shown if e.is_dir() or e.name.lower().endswith(SUFFIXES)]


def walk(folder: str) -> Iterator[str]:
    """Photos below a folder, entries of each directory by name, depth first; unreadable directories yield nothing."""
    for entry in _entries(folder):
        if entry.is_dir():
            yield from walk(entry.path)
        else:
            yield entry.path


def list_photos(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Each photo once, where it comes first: (path, root, bytes, modified_ms, ordinal)."""
    spark.dataSource.register(PhotoListing)
    listed = spark.read.format("photos").option("paths", json.dumps(paths)).load()
    return listed.groupBy("path").agg(F.min_by(F.struct("root", "bytes", "modified_ms", "ordinal"), "ordinal").alias("x")).select("path", "x.*")


def folder_sizes(listing: DataFrame) -> DataFrame:
    """Bytes of the direct files of each session folder; loose files beside the folders are left out."""
    parts = F.split("path", "/")
    return listing.filter(F.size(parts) >= 2).groupBy(F.element_at(parts, -2).alias("session_id")).agg(F.sum("bytes").alias("backup_bytes"))


def live_partners(photos: DataFrame, videos: DataFrame) -> DataFrame:
    """photos with the first ``.mov`` of the same folder and stem."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    clips = videos.filter(F.lower("path").endswith(".mov")).groupBy(stem(F.col("path")).alias("__stem")).agg(F.min("path").alias("video"))
    return photos.withColumn("__stem", stem(F.col("path"))).join(clips, "__stem", "left").drop("__stem")
