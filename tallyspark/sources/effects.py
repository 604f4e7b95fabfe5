"""Effects on photo files: atomic writes, replacement with a backup, exports that never overwrite, and guarded restoring.

Plain functions on one file, and ``apply_results`` and ``restore_all`` that run them for the rows of a DataFrame.  Every
effect leaves either the old or the new state; temporary files go on failure; restoring what is restored already does nothing.
"""

from __future__ import annotations

import errno
import os
import shutil
import tempfile
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


#: Stands for a folder of backups where photos are replaced for good.
NO_BACKUP = ""


def fingerprint(path: str) -> tuple[int, int]:
    """(bytes, modification time in ms, instants before 1970 as 0)."""
    stat = os.stat(path)
    return stat.st_size, max(0, stat.st_mtime_ns // 1_000_000)


def write_atomic(path: str, data: bytes) -> None:
    """A sibling file, forced to disk and renamed."""
    handle, temporary = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        rename(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def back_up(path: str, backup: str) -> None:
    """A hard link where the file system has them, else a copy."""
    os.makedirs(os.path.dirname(backup), exist_ok=True)
    try:
        os.link(path, backup)
    except OSError:
        shutil.copy2(path, backup)


def replace(path: str, data: bytes, backup: str | None = None) -> None:
    """New contents under the old name, mode and times; the old file is backed up first if asked for."""
    stat = os.stat(path)
    if backup:
        back_up(path, backup)
    write_atomic(path, data)
    os.chmod(path, stat.st_mode)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


def unique_path(path: str) -> str:
    """path, or the first of ``stem 2``, ``stem 3`` ... that nothing has, reserved as an empty file."""
    stem, ext = os.path.splitext(path)
    number = 1
    while True:
        name = path if number == 1 else f"{stem} {number}{ext}"
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return name
        except FileExistsError:
            number += 1


def export(source: str, path: str, data: bytes) -> str:
    """Writes beside whatever is there, with the source's times; returns the name that was free."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    name = unique_path(path)
    try:
        write_atomic(name, data)
        stat = os.stat(source)
        os.utime(name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    except BaseException:
        os.unlink(name)
        raise
    return name


def convert(source: str, path: str, data: bytes, backup: str) -> str:
    """A converted file beside the source, which moves to its backup; if that fails the new file goes again."""
    name = export(source, path, data)
    try:
        os.makedirs(os.path.dirname(backup), exist_ok=True)
        move(source, backup)
    except BaseException:
        os.unlink(name)
        raise
    return name


def rename(source: str, target: str, tries: int = 8, pause: float = 0.04) -> None:
    """A rename that waits for whoever holds one of the files, longer from try to try."""
    for number in range(1, tries + 1):
        try:
            os.replace(source, target)
            return
        except PermissionError:
            if number == tries:
                raise
            time.sleep(pause * number)


def move(source: str, target: str) -> None:
    """A rename, or across file systems a whole copy under a temporary name, then the source goes."""
    try:
        rename(source, target)
    except OSError as error:
        if error.errno != errno.EXDEV:
            raise
        copy_whole(source, target)
        os.unlink(source)


def copy_whole(source: str, target: str) -> None:
    """A copy with the source's times that is there whole or not at all."""
    handle, temporary = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=os.path.dirname(target) or ".")
    os.close(handle)
    try:
        shutil.copy2(source, temporary)
        rename(temporary, target)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def export_partner(video: str, photo: str) -> str | None:
    """Copies a photo's video beside its exported file, under its own name; None if something of that name is there."""
    target = os.path.join(os.path.dirname(photo), os.path.basename(video))
    if os.path.exists(target):
        return None
    copy_whole(video, target)
    return target


def write_preview(folder: str, number: int, data: bytes | None) -> str | None:
    """A preview as ``00042.jpg``; None, and no error, if it can't be written."""
    if not data:
        return None
    path = os.path.join(folder, f"{number:05}.jpg")
    try:
        os.makedirs(folder, exist_ok=True)
        write_atomic(path, data)
    except OSError:
        return None
    return path


def apply_results(outcomes: DataFrame, backup_dir: str | None) -> DataFrame:
    """Outcomes (path, status, output, ordinal, destination) with the bytes of ``output`` written, and without them.

    With ``backup_dir`` photos are replaced and backed up there as ``ordinal-name`` (with NO_BACKUP not at all), else written to ``destination``,
    where nothing is overwritten.  Adds outputs (paths), backup, written and kept (fingerprints of the new file and of the backup);
    a photo that can't be written is a failed row.  A task that runs again leaves a photo alone that has its output already.
    """
    mark = "struct<bytes: long, modifiedMs: long>"
    schema = outcomes.drop("output", "destination").selectExpr("*", "cast(null AS array<string>) AS outputs", "cast(null AS string) AS backup", f"cast(null AS {mark}) AS written", f"cast(null AS {mark}) AS kept").schema

    def one(row) -> tuple:
        data = bytes(row.output)
        if backup_dir is None:
            return [export(row.path, row.destination, data)], None, None, None
        if backup_dir == NO_BACKUP:
            replace(row.path, data)
            return [row.path], None, None, None
        backup = f"{backup_dir}/{int(row.ordinal):05}-{os.path.basename(row.path)}"
        with open(row.path, "rb") as current:
            done = os.path.exists(backup) and current.read() == data
        if not done:
            replace(row.path, data, backup)
        named = lambda path: dict(zip(("bytes", "modifiedMs"), fingerprint(path)))
        return [row.path], backup, named(row.path), named(backup)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made, status, errors = [], list(rows["status"]), list(rows["error"])
            for i, row in enumerate(rows.itertuples()):
                made.append(([], None, None, None))
                if row.status == "done":
                    try:
                        made[-1] = one(row)
                    except OSError as failed:
                        status[i], errors[i] = "failed", str(failed)
            out = rows.drop(columns=["output", "destination"]).assign(status=status, error=errors)
            for place, name in enumerate(("outputs", "backup", "written", "kept")):
                out[name] = pd.Series([m[place] for m in made], index=rows.index, dtype=object)
            yield out[schema.names]

    return outcomes.mapInPandas(write, schema)


def restore(original: str, backup: str, output: str | None, written: tuple[int, int] | None, kept: tuple[int, int] | None = None) -> None:
    """Puts the backup back.

    Refuses if the output has been changed since it was written, or if a converted photo's old
    name is taken; a converted output that has been deleted is no obstacle.  The backup comes back
    before a converted output goes, so one of them is always there.

    kept: fingerprint of the backup.  With it a restore that has been done, or was stopped
    before the output went, is finished and not reported as a failure.
    """
    converted = bool(output) and output != original
    done = kept is not None and not os.path.exists(backup) and os.path.exists(original) and fingerprint(original) == tuple(kept)
    if converted and os.path.exists(output) and written and fingerprint(output) != tuple(written):
        raise ValueError(f"{output} has been changed")
    if not done:
        if converted and os.path.exists(original):
            raise FileExistsError(f"{original} is taken")
        if not converted and written and os.path.exists(original) and fingerprint(original) != tuple(written):
            raise ValueError(f"{original} has been changed")
        os.makedirs(os.path.dirname(original), exist_ok=True)
        move(backup, original)
    if converted and os.path.exists(output):
        os.unlink(output)


def restore_all(backups: DataFrame, results: str) -> DataFrame:
    """Restores rows (session_id, idx, original, backup, output, written, kept) and says which ones failed and why.

    The outcomes are written once, to the folder ``results``, and read from there, so that no action
    restores twice; a task that is run again finds its rows restored (see ``kept``, the backups' fingerprints).
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.itertuples():
                try:
                    written, kept = ((int(a), int(b)) if pd.notna(a) else None for a, b in ((row.bytes, row.modified_ms), (row.kept_bytes, row.kept_ms)))
                    restore(row.original, row.backup, row.output if isinstance(row.output, str) else None, written, kept)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(str(e))
            yield batch[["session_id", "idx"]].assign(error=errors)

    flat = backups.selectExpr("session_id", "idx", "original", "backup", "output", "written.bytes AS bytes", "written.modifiedMs AS modified_ms", "kept.bytes AS kept_bytes", "kept.modifiedMs AS kept_ms")
    flat.mapInPandas(run, "session_id string, idx long, error string").write.parquet(results)
    return backups.sparkSession.read.parquet(results)
