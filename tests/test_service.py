"""Effects on files, settings and the service."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.schemas import SESSIONS
from tallyspark.service import Service, Settings, try_all
from tallyspark.sources import effects
from tallyspark.sources.snapshots import Ledger


def test_replace_and_restore(tmp_path):
    photo, backup = str(tmp_path / "a.jpg"), str(tmp_path / "b" / "0-a.jpg")
    (tmp_path / "a.jpg").write_bytes(b"old")
    os.utime(photo, (1000, 1000))
    effects.replace(photo, b"new!", backup)
    assert open(photo, "rb").read() == b"new!" and open(backup, "rb").read() == b"old" and effects.fingerprint(photo) == (4, 1_000_000)
    with pytest.raises(ValueError):
        effects.restore(photo, backup, None, (3, 1_000_000))
    effects.restore(photo, backup, None, (4, 1_000_000))
    assert open(photo, "rb").read() == b"old" and not os.path.exists(backup)


def test_export_never_overwrites_and_conversion_rolls_back(tmp_path):
    (tmp_path / "a.heic").write_bytes(b"x")
    first, second = (effects.export(str(tmp_path / "a.heic"), str(tmp_path / "out" / "a.jpg"), bytes([n])) for n in (1, 2))
    assert second.endswith("a 2.jpg") and open(first, "rb").read() == b"\x01"
    with pytest.raises(OSError):
        (tmp_path / "file").write_bytes(b"")
        effects.convert(str(tmp_path / "a.heic"), str(tmp_path / "a.jpg"), b"y", str(tmp_path / "file" / "b"))
    assert not (tmp_path / "a.jpg").exists() and (tmp_path / "a.heic").exists()
    made = effects.convert(str(tmp_path / "a.heic"), str(tmp_path / "a.jpg"), b"y", str(tmp_path / "bk" / "a.heic"))
    os.unlink(made)
    effects.restore(str(tmp_path / "a.heic"), str(tmp_path / "bk" / "a.heic"), made, None)
    assert (tmp_path / "a.heic").read_bytes() == b"x"
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".tmp")]


def test_moves_and_copies_are_whole(tmp_path, monkeypatch):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    (tmp_path / "a").write_bytes(b"x")
    os.utime(source, (1000, 1000))
    held, replace = [PermissionError, PermissionError], os.replace

    def busy(a, b):
        if held:
            raise held.pop()()
        replace(a, b)

    monkeypatch.setattr(effects.os, "replace", busy)
    effects.move(source, target)
    assert not held and not os.path.exists(source) and open(target, "rb").read() == b"x"
    held += [PermissionError] * 9
    with pytest.raises(PermissionError):
        effects.rename(target, source, tries=2, pause=0)
    held.clear()
    first = []

    def across(a, b):
        if not first:
            first.append(1)
            raise OSError(effects.errno.EXDEV, "across")
        replace(a, b)

    monkeypatch.setattr(effects.os, "replace", across)
    effects.move(target, source)
    assert effects.fingerprint(source) == (1, 1_000_000) and not os.path.exists(target) and not [p for p in os.listdir(tmp_path) if p.endswith(".tmp")]


def test_partners_and_previews(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.mov").write_bytes(b"video")
    video, photo = str(tmp_path / "in" / "a.mov"), str(tmp_path / "out" / "a.jpg")
    assert effects.export_partner(video, photo) == str(tmp_path / "out" / "a.mov") and effects.export_partner(video, photo) is None
    assert effects.write_preview(str(tmp_path / "p"), 42, b"jpeg").endswith("/00042.jpg") and effects.write_preview(str(tmp_path / "p"), 1, None) is None
    (tmp_path / "file").write_bytes(b"")
    assert effects.write_preview(str(tmp_path / "file"), 1, b"x") is None


def test_restoring_twice_and_after_a_stop(spark, tmp_path, monkeypatch):
    original, output, backup = (str(tmp_path / n) for n in ("a.heic", "a.jpg", "bk/0-a.heic"))
    os.mkdir(tmp_path / "bk")
    (tmp_path / "bk" / "0-a.heic").write_bytes(b"heic")
    (tmp_path / "a.jpg").write_bytes(b"jpeg!")
    kept, written = effects.fingerprint(backup), effects.fingerprint(output)
    monkeypatch.setattr(effects.os, "unlink", lambda p: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        effects.restore(original, backup, output, written, kept)
    monkeypatch.undo()
    assert os.path.exists(original) and os.path.exists(output)
    rows = spark.createDataFrame([("s", 0, original, backup, output, tuple(written), tuple(kept)), ("s", 1, str(tmp_path / "b"), str(tmp_path / "none"), None, None, None)],
                                 "session_id string, idx long, original string, backup string, output string, written struct<bytes: long, modifiedMs: long>, kept struct<bytes: long, modifiedMs: long>")
    got = effects.restore_all(rows, str(tmp_path / "results"))
    assert [r.error is None for r in got.orderBy("idx").collect()] == [True, False] == [r.error is None for r in got.orderBy("idx").collect()]
    assert os.path.exists(original) and not os.path.exists(output)
    assert effects.restore_all(rows, str(tmp_path / "again")).filter("error is null").count() == 1


def test_a_commit_that_stops_leaves_the_old_state(spark, tmp_path, monkeypatch):
    rows = lambda n: spark.range(n).selectExpr("cast(id as string) id")
    books = Ledger(spark, str(tmp_path / "l"))
    first = books.commit(sessions=rows(3), files=rows(5))
    for stop_at in ("create", "rename"):
        stopped = Ledger(spark, str(tmp_path / "l"))

        class Fs:
            def __getattr__(self, name, inner=stopped._fs, stop_at=stop_at):
                if name == stop_at:
                    raise OSError("stopped")
                return getattr(inner, name)

        stopped._fs = Fs()
        with pytest.raises(OSError, match="stopped"):
            stopped.commit(sessions=rows(9))
        assert books.current() == first and books.read("sessions").count() == 3
    books.commit(sessions=rows(4))
    assert books.read("sessions").count() == 4 and books.pointer()["tables"]["files"].startswith(first) and books.read("files").count() == 5
    monkeypatch.setattr(Ledger, "numbers", lambda self: [1])
    with pytest.raises(OSError, match="taken"):
        Ledger(spark, str(tmp_path / "l")).commit(sessions=rows(1))


def test_maintenance_goes_on_after_an_error(spark, tmp_path, monkeypatch):
    done = []
    with pytest.raises(ValueError, match="first"):
        try_all(lambda: done.append(1), lambda: (_ for _ in ()).throw(ValueError("first")), lambda: (_ for _ in ()).throw(ValueError("second")), lambda: done.append(2))
    assert done == [1, 2]
    service = Service(spark, str(tmp_path / "books"))
    monkeypatch.setattr(service, "prune", lambda ids: (_ for _ in ()).throw(OSError("no retention")))
    monkeypatch.setattr(service, "reconcile", lambda disk: done.append("reconciled"))
    with pytest.raises(OSError, match="no retention"):
        service.maintain(spark.createDataFrame([("x", "1000", 9)], "path string, session_id string, bytes long"))
    assert done[-1] == "reconciled"


def test_earlier_histories_are_taken_over_once(spark, tmp_path):
    import json

    summary = {"id": "1000", "startedAt": 1, "finishedAt": 2, "photos": 1, "optimized": 1, "skipped": 0, "failed": 0, "originalBytes": 9, "outputBytes": 4, "savedBytes": 5, "outputMode": "replace", "strength": "identical", "canUndo": True, "undone": False}
    result = {"id": 0, "path": "/a", "name": "a", "status": "done", "originalBytes": 9, "outputBytes": 4, "outputs": [], "width": 1, "height": 1, "millis": 1}
    folder = tmp_path / "sessions"
    folder.mkdir()
    (folder / "1000.json").write_text(json.dumps({"summary": summary, "files": [result], "backups": [{"original": "/a", "backup": "/b"}]}))
    (folder / "odd.json").write_text(json.dumps({"summary": {**summary, "id": "../etc"}, "files": [], "backups": []}))
    (folder / "broken.json").write_text("{")
    service = Service(spark, str(tmp_path / "books"))
    assert service.import_history(str(folder)) == 1 and not folder.exists() and (tmp_path / "sessions.imported").is_dir()
    found = service.session("1000")
    assert found["summary"].saved_bytes == 5 and [r.path for r in found["files"].collect()] == ["/a"] and [r.backup for r in found["backups"].collect()] == ["/b"]
    with pytest.raises(KeyError, match="session not found"):
        service.session("2000")
    os.rename(tmp_path / "sessions.imported", folder)
    assert service.import_history(str(folder)) == 0 and service.totals().first().sessions == 1


def test_settings_are_kept_in_a_file(tmp_path):
    path = str(tmp_path / "new" / "settings.json")
    assert Settings.load(path) == Settings()
    Settings(retention_days=7, convert_heic=True).save(path)
    assert Settings.load(path) == Settings(retention_days=7, convert_heic=True) and os.listdir(tmp_path / "new") == ["settings.json"]
    odd = Settings.parse('{"keep_backups": "yes", "retention_days": true, "export_dir": 5, "sizes": {}}')
    assert odd == Settings()


def test_settings_are_repaired():
    assert Settings.parse("{") == Settings() == Settings.parse(None) == Settings.parse("[]")
    odd = Settings.parse('{"retention_days": 1000, "strength": "?", "sizes": [], "unknown": 1, "output_mode": "export"}')
    assert (odd.retention_days, odd.strength, len(odd.sizes), odd.output_mode) == (90, "identical", 1, "export")
    assert Settings.parse(odd.dump()) == odd


def test_service(spark, tmp_path):
    values = dict(finished_at=0, photos=1, optimized=1, skipped=0, failed=0, original_bytes=9, output_bytes=4, saved_bytes=5, output_mode="replace", strength="identical", can_undo=True, undone=False)
    row = lambda i: tuple({**values, "id": i, "started_at": int(i)}[f.name] for f in SESSIONS.fields)
    sessions = spark.createDataFrame([row("1000"), row("2000")], SESSIONS)
    files = spark.createDataFrame([("1000", 0, "=a.jpg", "done", 9, 4, None, None, 80, ["/o"]), ("2000", 0, "b", "failed", 9, 9, None, "decode", None, [])], "session_id string, idx long, path string, status string, original_bytes long, output_bytes long, skip_reason string, error string, quality int, outputs array<string>")
    backups = spark.createDataFrame([("1000", 0, "x"), ("2000", 0, "y")], "session_id string, idx long, backup string")
    disk = spark.createDataFrame([("x", "1000", 9), ("y", "2000", 9)], "path string, session_id string, bytes long")
    service = Service(spark, str(tmp_path / "books"), Settings(retention_days=1))
    service.save(sessions, files, backups)
    service.save(sessions.limit(1).withColumn("saved_bytes", F.lit(6).cast("long")), files.filter("session_id = '1000'"), backups.filter("session_id = '1000'"))
    assert service.totals().first().saved_bytes == 11 and service.books.read("files").count() == 2
    service.export_log("1000", str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()][1] == '"\'=a.jpg","done",9,4,55.6,80,,"","/o"'
    service.discard_backup("1000")
    assert {r.id: r.can_undo for r in service.history().collect()} == {"1000": False, "2000": True}
    service.maintain(disk, now_ms=86_400_000 + 2001)
    assert service.books.read("backups").count() == 0 and service.totals().first().saved_bytes == 11
    service.free_backups(disk)
    assert not any(r.can_undo for r in service.history().collect())
