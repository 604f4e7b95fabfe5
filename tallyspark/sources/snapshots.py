"""A ledger of Parquet snapshots: numbered pointers, of which the highest names the folders of the current tables.

A commit writes the tables that change, each into a folder of its own, and then a pointer under the
next number: written beside it and renamed, so it is there whole or not at all.  No pointer is ever
replaced, so readers see the old state or the new one whatever moment a commit stops at; a failed
commit leaves unreferenced folders.  Tables that don't change are named again, not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Versions that can be read; a commit writes the last one.
VERSIONS = [1, 2]
TABLES = ["sessions", "files", "backups"]


class Ledger:
    """Tables under ``root`` on any Hadoop file system; of two writers of one number the second fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def numbers(self) -> list[int]:
        """Numbers of the pointers, in ascending order."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-") and n.removeprefix("CURRENT-").isdigit())

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found = json.loads(text)
        if found["version"] not in VERSIONS:
            raise ValueError(f"the ledger has version {found['version']}, this code reads {VERSIONS}")
        return found

    def pointer(self) -> dict | None:
        """{version, state, tables: folder by table} of the current state; None before the first commit."""
        numbers = self.numbers()
        if numbers:
            return self._load(f"CURRENT-{numbers[-1]:012}")
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            return None
        # version 1 had one pointer and all tables in one folder
        old = self._load("CURRENT")
        held = [t for t in TABLES if self._fs.exists(self._path(f"{self.root}/{old['state']}/{t}"))]
        return {**old, "tables": {t: f"{old['state']}/{t}" for t in held}}

    def current(self) -> str | None:
        """Name of the current state; None before the first commit."""
        found = self.pointer()
        return found and found["state"]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.pointer()['tables'][table]}")

    def commit(self, **tables: DataFrame) -> str:
        """Writes the given tables and makes them current beside the others."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        before, state, number = self.pointer(), uuid.uuid4().hex, (self.numbers() or [0])[-1] + 1
        folders = dict(before["tables"]) if before else {}
        for name, df in tables.items():
            folders[name] = f"{state}/{name}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        staged, pointer = self._path(f"{self.root}/{state}.json"), self._path(f"{self.root}/CURRENT-{number:012}")
        out = self._fs.create(staged, False)
        out.write(json.dumps({"version": VERSIONS[-1], "state": state, "tables": folders}).encode())
        out.close()
        if self._fs.exists(pointer) or not self._fs.rename(staged, pointer):
            self._fs.delete(staged, False)
            raise OSError(f"can't make {state} current: number {number} is taken")
        return state


def write_log(lines: DataFrame, path: str, header: str) -> None:
    """A session's log as one text file, the header first and lines in order of idx; sessions are small, so one task writes it."""
    from pyspark.sql import functions as F

    first = lines.sparkSession.createDataFrame([(-1, header)], "idx long, line string")
    ordered = first.unionByName(lines.select(F.col("idx").cast("long").alias("idx"), "line")).coalesce(1).sortWithinPartitions("idx")
    ordered.select("line").write.mode("overwrite").text(path)
