"""The ledger as a service: settings, history, records, logs and maintenance over committed snapshots."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import OpenedPaths
from .functions.text import CSV_HEADER, csv_log, export_path, language
from .operators import batch, ledger, maintenance
from .schemas import MODES, RECORD, SESSIONS, STRENGTHS, camel
from .sources.effects import NO_BACKUP, apply_results, restore_all, write_atomic
from .sources.journal import read_history_files
from .sources.snapshots import Ledger, write_log


FILES_KEPT = "session_id string, idx long, path string, status string, converted boolean, original_bytes long, output_bytes long, skip_reason string, error string, quality long, outputs array<string>"
FILE_COLUMNS = [c.split()[0] for c in FILES_KEPT.split(", ")]
BACKUPS_KEPT = "session_id string, idx long, original string, backup string, output string, written struct<bytes: long, modifiedMs: long>, kept struct<bytes: long, modifiedMs: long>"


def try_all(*actions: Callable[[], object]) -> list:
    """Runs every action, whether or not others fail; then raises the first error, if there was one."""
    results, first = [], None
    for action in actions:
        try:
            results.append(action())
        except Exception as error:  # noqa: BLE001
            results.append(None)
            first = first or error
    if first:
        raise first
    return results


@dataclass
class Settings:
    """What a batch is told to do; odd values are brought in range when read."""

    output_mode: str = "replace"
    strength: str = "identical"
    export_dir: str | None = None
    sizes: list[dict] = field(default_factory=lambda: [{"label": "original", "mode": None, "pixels": None}])
    keep_backups: bool = True
    retention_days: int = 30
    strip_location: bool = False
    convert_heic: bool = False

    @classmethod
    def parse(cls, text: str | None) -> Settings:
        """From JSON; missing or broken documents and fields give defaults."""
        try:
            given = json.loads(text or "{}")
        except ValueError:
            given = {}
        kinds = {k: (str, type(None)) if k == "export_dir" else type(getattr(cls(), k)) for k in cls.__dataclass_fields__}
        fits = lambda k, v: k in kinds and isinstance(v, kinds[k]) and not (kinds[k] is int and isinstance(v, bool))
        out = cls(**{k: v for k, v in (given.items() if isinstance(given, dict) else ()) if fits(k, v)})
        out.output_mode = out.output_mode if out.output_mode in MODES else "replace"
        out.strength = out.strength if out.strength in STRENGTHS else "identical"
        out.sizes = out.sizes[:4] or cls().sizes
        out.retention_days = min(max(out.retention_days, 1), 90)
        return out

    @classmethod
    def load(cls, path: str) -> Settings:
        """Those kept in a file; defaults if it can't be read."""
        try:
            with open(path, encoding="utf-8") as kept:
                return cls.parse(kept.read())
        except OSError:
            return cls()

    def save(self, path: str) -> None:
        """Writes the file whole or not at all, its folder first if there is none."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        write_atomic(path, self.dump().encode())

    def dump(self) -> str:
        return json.dumps(asdict(self))


class Service:
    """Commands over one ledger; ``disk`` listings (path, session_id, bytes) are given by the caller."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, backups: str | None = None):
        self.spark, self.books, self.settings = spark, Ledger(spark, root), settings or Settings()
        self.backups, self.settings_path = backups or f"{root}/backups", f"{root}/settings.json"
        self.gate, self.opened = batch.Gate(), OpenedPaths()

    def get_settings(self) -> Settings:
        self.settings = Settings.load(self.settings_path)
        return self.settings

    def save_settings(self, settings: Settings) -> None:
        settings.save(self.settings_path)
        self.settings = settings

    def ui_language(self, tags: list[str]) -> str:
        row = self.spark.createDataFrame([(tags,)], "tags array<string>").select(language(F.col("tags")).alias("x")).first()
        return row.x

    def take_opened_paths(self) -> list[str]:
        return self.opened.take()

    def cancel_session(self) -> None:
        self.gate.cancel()

    def optimize(self, paths: list[str], on_event: Callable[[dict], None] = lambda e: None, now_ms: int | None = None, at_once: int = 256) -> str | None:
        """Runs a batch and keeps its record; returns its id, or None if another one runs: then the paths go on behind it."""
        if self.gate.enter(paths) is None:
            return None
        last = None
        while paths:
            last = self._session(paths, on_event, now_ms, at_once)
            now_ms = None
            paths = self.gate.leave()
        return last

    def _session(self, paths: list[str], on_event: Callable[[dict], None], now_ms: int | None, at_once: int) -> str:
        own, started = self.settings, int(time.time() * 1000) if now_ms is None else now_ms
        asked = batch.Options(own.strength, strip_location=own.strip_location, convert_heic=own.convert_heic)
        replacing = own.output_mode == "replace"
        if not replacing and own.sizes[0].get("pixels"):
            asked = batch.replace(asked, mode=own.sizes[0]["mode"], pixels=own.sizes[0]["pixels"])
        folder = (f"{self.backups}/{started}" if own.keep_backups else NO_BACKUP) if replacing else None
        target = export_path(F.col("path"), F.col("root"), own.export_dir, F.lit(own.sizes[0].get("label") or "original"), len(own.sizes))
        finish = lambda outcomes: apply_results(outcomes.withColumn("destination", target), folder)
        try:
            rows = batch.run(self.spark, paths, asked, on_event, self.gate, at_once, finish)
        except BaseException:
            self.gate.leave()
            raise
        key = str(started)
        files = self.spark.createDataFrame([(key, *[r[c] for c in FILE_COLUMNS[1:]]) for r in rows], FILES_KEPT)
        kept = [(key, r["idx"], r["path"], r["backup"], None, tuple(r["written"]), tuple(r["kept"])) for r in rows if r["backup"]]
        summary = ledger.session_summary(files).withColumnRenamed("session_id", "id").selectExpr(
            "id", f"{started}L AS started_at", f"{max(started, int(time.time() * 1000))}L AS finished_at", "photos", "optimized", "skipped", "failed", "original_bytes", "output_bytes", "saved_bytes",
            f"'{own.output_mode}' AS output_mode", f"'{own.strength}' AS strength", f"{str(bool(kept)).lower()} AS can_undo", "false AS undone",
        )
        self.save(summary, files, self.spark.createDataFrame(kept, BACKUPS_KEPT))
        return key

    def undo_session(self, session_id: str, results: str) -> dict:
        """Puts back what can be, takes the savings back and keeps what is left; lists of what was restored and what was not.

        results: a new folder for the outcomes of restoring, which are written once.
        """
        found = self.session(session_id)
        if not found["summary"].can_undo:
            raise ValueError("session can't be undone")
        errors = restore_all(found["backups"], results)
        state = found["backups"].join(errors, ["session_id", "idx"]).withColumn("intact", F.col("error").isNull())
        one = self.books.read("sessions").filter(F.col("id") == session_id)
        there = state.select(F.col("backup").alias("path"), "session_id", F.lit(0).cast("long").alias("bytes"))
        after = maintenance.undo(one, found["files"], state, there).first()
        changed = one.selectExpr(*[f"cast({json.dumps(after[c]) if isinstance(after[c], bool) else after[c]} AS {t}) AS {c}" if c in after and c != "id" else c for c, t in one.dtypes])
        left = state.filter("error IS NOT NULL").select(*found["backups"].columns)
        lists = state.groupBy().agg(F.array_sort(F.collect_list(F.when(F.col("intact"), F.col("original")))).alias("restored"), F.array_sort(F.collect_list(F.when(~F.col("intact"), F.col("original")))).alias("kept")).first()
        self.save(changed, found["files"], left)
        return {"restored": lists.restored, "kept": lists.kept}

    def history(self, limit: int | None = None) -> DataFrame:
        return ledger.history_page(self.books.read("sessions"), limit)

    def totals(self) -> DataFrame:
        return ledger.totals(self.books.read("sessions"))

    def session(self, session_id: str) -> dict:
        """Summary, files and backups of one record; the filters reach the scans."""
        found = self.books.read("sessions").filter(F.col("id") == session_id).head(1)
        if not found:
            raise KeyError("session not found")
        of = lambda name: self.books.read(name).filter(F.col("session_id") == session_id).orderBy("idx")
        return {"summary": found[0], "files": of("files"), "backups": of("backups")}

    def session_results(self, session_id: str) -> DataFrame:
        """Files of a session in order; the filter reaches the scan."""
        return self.books.read("files").filter(F.col("session_id") == session_id).orderBy("idx")

    def save(self, sessions: DataFrame, files: DataFrame, backups: DataFrame) -> str:
        """Adds whole records; records of the same ids are replaced with their files and backups."""
        if self.books.current() is None:
            return self.books.commit(sessions=sessions, files=files, backups=backups)
        gone = sessions.select(F.col("id").alias("session_id")).distinct()
        replaced = lambda name, new: self.books.read(name).join(gone, "session_id", "left_anti").unionByName(new, allowMissingColumns=True)
        return self.books.commit(sessions=maintenance.upsert(self.books.read("sessions"), sessions, "id"), files=replaced("files", files), backups=replaced("backups", backups))

    def discard_backup(self, session_id: str) -> str:
        ids = self.spark.createDataFrame([(session_id,)], "id string")
        sessions, backups = maintenance.discard(self.books.read("sessions"), self.books.read("backups"), ids)
        return self.books.commit(sessions=sessions, backups=backups)

    def free_backups(self, disk: DataFrame) -> str:
        sessions, backups = maintenance.discard_finished(self.books.read("sessions"), self.books.read("backups"), disk)
        return self.books.commit(sessions=sessions, backups=backups)

    def maintain(self, disk: DataFrame, now_ms: int | None = None) -> str | None:
        """Retention, then reconciliation with what is left on disk; the second runs even if the first fails, whose error comes then."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        old = maintenance.expired(disk.select(F.col("session_id").alias("id")).distinct(), now, self.settings.retention_days)
        left = disk.join(old.select(F.col("id").alias("session_id")), "session_id", "left_anti")
        return try_all(lambda: self.prune(old), lambda: self.reconcile(left))[-1]

    def prune(self, ids: DataFrame) -> str:
        sessions, backups = maintenance.discard(self.books.read("sessions"), self.books.read("backups"), ids)
        return self.books.commit(sessions=sessions, backups=backups)

    def reconcile(self, disk: DataFrame) -> str:
        sessions, backups = maintenance.reconcile(self.books.read("sessions"), self.books.read("backups"), disk)
        return self.books.commit(sessions=sessions, backups=backups)

    def import_history(self, folder: str) -> int:
        """Takes over records kept as one JSON document a file, and retires the folder by renaming it.

        Records that the ledger has already stay as they are, so an import that was stopped can be run again; returns how many are new.
        """
        records = read_history_files(self.spark, folder, RECORD)
        known = self.books.read("sessions").select("id") if self.books.current() else self.spark.createDataFrame([], "id string")
        new = records.dropDuplicates(["id"]).join(known, "id", "left_anti")
        n = new.count()
        if n:
            listed = lambda part: new.select(F.col("id").alias("session_id"), F.posexplode(part).alias("idx", "x"))
            place = F.col("idx").cast("long").alias("idx")
            files = listed("files").select(
                "session_id", place, "x.path", "x.status", "x.converted", F.col("x.originalBytes").alias("original_bytes"), F.col("x.outputBytes").alias("output_bytes"),
                F.col("x.skipReason").alias("skip_reason"), "x.error", F.col("x.quality").cast("long").alias("quality"), F.transform("x.outputs", lambda o: o["path"]).alias("outputs"),
            )
            self.save(new.select("id", *[F.col(f"summary.{camel(f.name)}").alias(f.name) for f in SESSIONS.fields[1:]]), files, listed("backups").select("session_id", place, "x.*"))
        os.rename(folder, f"{folder}.imported")
        return n

    def export_log(self, session_id: str, path: str) -> None:
        if not path.startswith("/") and "://" not in path:
            raise ValueError("destination must be an absolute path")
        write_log(csv_log(self.session_results(session_id)), path, CSV_HEADER)
