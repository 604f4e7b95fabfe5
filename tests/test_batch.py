"""Codec, metadata, the batch and the command line, on photos made for the purpose."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.functions import codec, jpeg, metadata
from tallyspark.operators import batch
from tallyspark.plans import catalog
from tallyspark.service import Service, Settings


def picture(height=97, width=131, seed=0, noise=5):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([128 + 100 * np.sin(x / 9) + rng.normal(0, noise, x.shape), 128 + 90 * np.cos(y / 7), (x + y) % 256], 2).clip(0, 255).astype(np.uint8)


def photo(quality=97, segments=(), **changes):
    return metadata.splice(codec.encode(picture(**changes), quality), list(segments))


def exif(value=None):
    entry = struct.pack("<HHIHH", 0x0112, 3, 1, value, 0) if value else struct.pack("<HHII", 0x0100, 4, 1, 5)
    return b"II*\0\x08\0\0\0\x01\0" + entry + bytes(4)


@pytest.mark.parametrize("chroma", [(1, 1), (2, 1), (1, 2), (2, 2)])
def test_codec_round_trips(chroma):
    image = picture()
    for quality, most in ((50, 6), (95, 4)):
        data = codec.encode(image, quality, chroma)
        assert codec.transcode(data) == data and codec.read(data).tables.keys() == {0, 1}
        assert np.abs(codec.decode(data).astype(int) - image).mean() < most
    gray = image[:, :, :1]
    assert np.abs(codec.decode(codec.encode(gray, 95)).astype(int) - gray).mean() < 2 and codec.as_rgb(gray).shape[2] == 3


def test_codec_reads_restart_intervals_and_odd_codes():
    data = codec.encode(picture(40, 50), 80)
    image = codec.read(data)
    # the same coefficients with a restart behind every unit, by way of one-unit files
    parts, first = [], image.components[0]
    columns = first.blocks.shape[1] // first.h
    for unit in range(columns * (first.blocks.shape[0] // first.v)):
        y, x = divmod(unit, columns)
        parts.append([(c, c.blocks[y * c.v : (y + 1) * c.v, x * c.h : (x + 1) * c.h]) for c in image.components])
    single = [codec.Image(8 * first.h, 8 * first.v, [codec.Component(c.number, c.h, c.v, c.slot, b) for c, b in p], image.tables) for p in parts]
    # one set of codes for all of them: that of a file with every symbol that occurs
    whole = codec.write(image)
    assert np.array_equal(codec.decode(whole), codec.decode(data)) and len(single) == len(parts)
    assert all(np.array_equal(codec.read(codec.write(s)).components[0].blocks, s.components[0].blocks) for s in single)


def test_codec_goes_through_long_scans_in_windows(monkeypatch):
    image = codec.read(codec.encode(picture(70, 90), 97, (2, 1)))
    data = codec.write(image)
    for window, packed in ((1, 1), (100, 333)):
        monkeypatch.setattr(codec, "WINDOW", window)
        monkeypatch.setattr(codec, "PACKED", packed)
        assert codec.write(image) == data
        assert all(np.array_equal(a.blocks, b.blocks) for a, b in zip(codec.read(data).components, image.components))


@pytest.mark.parametrize("name", ["codec_roundtrip", "batch_outcomes"])
def test_photos_of_one_small_file_are_worked_on_in_many_tasks(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_codec_is_closed_against_hostile_bytes():
    data = photo()
    rng = np.random.default_rng(3)
    for cut in range(0, len(data), 41):
        with pytest.raises(codec.Unreadable):
            codec.read(data[:cut])
    for _ in range(150):
        noise = bytearray(data)
        for at in rng.integers(2, len(data), 8):
            noise[at] = rng.integers(256)
        try:
            codec.read(bytes(noise))
        except codec.Unreadable:
            pass


def test_requantising_never_refines_and_rounds_half_away():
    image = codec.read(codec.encode(picture(), 60))
    same = codec.requantized(image, 98)
    assert all(np.array_equal(a.blocks, b.blocks) for a, b in zip(image.components, same.components))
    coarse = codec.requantized(image, 30)
    for a, b in zip(image.components, coarse.components):
        old, new = image.tables[a.slot], coarse.tables[b.slot]
        assert (new >= old).all() and np.array_equal(np.sign(a.blocks) * np.floor(np.abs(a.blocks) * old / new + 0.5), b.blocks)


def test_resampling_and_scores():
    image = picture()
    flat = np.full((50, 70, 3), 77, np.uint8)
    assert (codec.resize(flat, 31, 20) == 77).all() and (codec.thumbnail(flat, 31, 20) == 77).all() and np.array_equal(codec.resize(image, 131, 97), image)
    assert codec.score(codec.error_map(image, image)) == 100
    near, far = (codec.score(codec.error_map(image, codec.decode(codec.encode(image, q)))) for q in (95, 10))
    assert 100 > near > far > 0
    found = codec.compare(image, codec.decode(codec.encode(image, 30)), 32)
    assert len(found["tiles"]) == 3 * 4 and sum(t["area"] for t in found["tiles"]) == 97 * 131
    assert codec.spans(700, 256) == [(0, 256), (256, 256), (512, 188)] and codec.spans(600, 256) == [(0, 256), (256, 344)] and codec.spans(5, 256) == [(0, 5)]
    assert codec.spectral_scans(1) == [([0], 0, 0), ([0], 1, 5), ([0], 6, 63)] and len(codec.spectral_scans(3)) == 7


def test_metadata_goes_over_in_order():
    own = [(0xE0, b"JFIF\0"), (0xE1, metadata.EXIF + exif(6)), (0xE2, metadata.ICC + b"\1\1profile"), (0xEE, b"Adobe\0\0\0\0\0\0\0"), (0xE2, metadata.MULTI + b"old"), (0xFE, jpeg.MARKER + b" 0"), (0xFE, b"a comment")]
    data = photo(segments=own)
    assert metadata.split(data)[0] == own
    made = metadata.prepared(metadata.split(data)[0], False, "1 q=80")
    assert made == [own[0], own[1], own[2], own[6], (0xFE, jpeg.MARKER + b" 1 q=80")]
    other = metadata.splice(codec.encode(picture(seed=1), 50), made)
    assert metadata.split(other)[0] == made and np.array_equal(codec.decode(other), codec.decode(codec.encode(picture(seed=1), 50)))
    profile = bytes(range(256)) * 600
    parts = metadata.icc_segments(profile)
    assert b"".join(b[14:] for _, b in parts) == profile and [b[12:14] for _, b in parts] == [bytes([i + 1, 3]) for i in range(3)] and max(len(b) for _, b in parts) == 65_533
    with pytest.raises(ValueError, match="no image data"):
        metadata.split(b"\xff\xd8\xff\xe0\0\4ab")


def test_places_go_from_exif_and_xmp():
    xmp = metadata.XMP + b"<x exif:GPSLatitude='1' a='2'><exif:GPSMapDatum>W</exif:GPSMapDatum><exif:GPSAltitude x='1'/>tiff:Orientation=\"6\"</x>"
    segments = [(0xE1, xmp), (0xE1, metadata.EXTENDED_XMP + b"more")]
    assert metadata.prepared(segments, True, "1")[:-1] == [(0xE1, metadata.XMP + b"<x a='2'>tiff:Orientation=\"6\"</x>")]
    assert len(metadata.prepared(segments, False, "1")) == 3
    assert metadata.set_xmp_orientation("tiff:Orientation=\"6\" <tiff:Orientation>8</tiff:Orientation>", 1) == "tiff:Orientation=\"1\" <tiff:Orientation>1</tiff:Orientation>"


def test_orientation_can_be_added():
    assert jpeg.orientation(metadata.orientation_only(7)) == 7
    patched, added = metadata.with_orientation(exif(6), 3), metadata.with_orientation(exif(), 8)
    assert jpeg.orientation(patched) == 3 and len(patched) == len(exif(6)) and jpeg.orientation(added) == 8
    order, at = jpeg._tiff(added)
    assert [e[0] for e in jpeg._ifd(added, at, order)] == [0x0100, 0x0112]
    assert metadata.with_orientation(b"II*\0", 3) is None and metadata.with_orientation(b"xx" * 9, 3) is None


def test_further_images_are_indexed_and_found():
    small = codec.encode(picture(16, 16), 60)
    data = metadata.append_images(photo(segments=[(0xE0, b"JFIF\0"), (0xE1, metadata.EXIF + exif(1)), (0xFE, b"text")]), [(5, small), (0, small[:-2] + b"\xff\xd9")])
    assert metadata.further_images(data) == [(5, small), (0, small)] and [m for m, _ in metadata.split(data)[0]] == [0xE0, 0xE1, 0xE2, 0xFE]
    assert [data[a : a + n] for a, n in jpeg.secondary_images(data)] == [small, small]
    assert metadata.append_images(data, []) == data
    with pytest.raises(ValueError):
        metadata.further_images(data[:-1])
    with pytest.raises(ValueError):
        metadata.further_images(photo())


def test_segment_filter_in_columns(spark):
    rows = [(0xE1, metadata.EXIF + b"x"), (0xFE, jpeg.MARKER + b"0"), (0xE2, b"MPF\0x"), (0xEE, b"Adobe"), (0xE1, metadata.EXTENDED_XMP + b"x"), (0xE2, b"other")]
    df = spark.createDataFrame([(rows,)], "s array<struct<marker: int, body: binary>>")
    for strip in (False, True):
        got = [(r.marker, bytes(r.body)) for r in df.select(metadata.kept_segments(F.col("s"), strip, "1").alias("s")).first().s]
        assert got == [*[r for r in rows if not metadata.dropped(*r, strip)], (0xFE, jpeg.MARKER + b" 1")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("photos")
    gain = metadata.append_images(photo(96, [(0xE1, b"hdrgm:Version")], seed=4), [(0, codec.encode(picture(16, 16), 60))])
    files = {
        "a.jpg": photo(99, [(0xE1, metadata.EXIF + exif(6))], height=300, width=280), "b.jpg": photo(60, seed=2), "c.jpg": photo(96, [(0xFE, jpeg.MARKER + b" 1")], seed=3), "d.jpg": gain,
        "e.jpg": photo(96, [(0xE1, b"hdrgm:Version")]), "f.jpg": photo(96) + b"\0\0ftyp", "g.jpg": b"text", "h.heic": b"\0\0\0\x18ftypheic", "i.jpg": b"\xff\xd8\xff\xe0", "j.jpg": photo(96, seed=5)[:-900], "sub/k.jpg": photo(98, seed=6),
    }
    for name, data in files.items():
        (home / name).parent.mkdir(exist_ok=True)
        (home / name).write_bytes(data)
    return home


def test_every_photo_ends_in_one_row(spark, folder):
    events = []
    rows = batch.run(spark, [str(folder)], batch.Options(), events.append, at_once=8)
    got = {os.path.relpath(r["path"], folder): r for r in rows}
    assert [e["kind"] for e in events] == ["started", *["file"] * 11, "finished"] and events[0]["total"] == 11 and [r["idx"] for r in rows] == list(range(11))
    assert {k: r["skip_reason"] for k, r in got.items() if r["status"] == "skipped"} == {"c.jpg": "alreadyOptimized", "e.jpg": "hdrGainMap", "f.jpg": "embeddedMedia", "g.jpg": "unsupported", "h.heic": "conversionOff"} | ({"b.jpg": "noGain"} if got["b.jpg"]["status"] == "skipped" else {})
    assert {k for k, r in got.items() if r["status"] == "failed"} == {"i.jpg", "j.jpg"} and got["j.jpg"]["error"]
    assert got["a.jpg"]["status"] == got["sub/k.jpg"]["status"] == got["d.jpg"]["status"] == "done"
    assert all(r["output_bytes"] < r["original_bytes"] for r in rows if r["status"] == "done") and all(r["output_bytes"] == r["original_bytes"] for r in rows if r["status"] == "skipped")
    assert got["a.jpg"]["score"] >= 91.5 and got["a.jpg"]["worst"] >= 86.5


def test_outputs_keep_metadata_and_are_not_taken_again(spark, folder):
    _, photos = batch.read_photos(spark, [str(folder)])
    chosen = photos.filter(F.col("path").rlike("/[ad].jpg$"))
    got = {os.path.basename(r.path): r for r in batch.optimize(chosen, batch.Options(preview=True)).collect()}
    made = bytes(got["a.jpg"].output)
    assert jpeg.inspect(made)["orientation"] == 6 and jpeg.inspect(made)["has_marker"] and codec.decode(made).shape == (300, 280, 3)
    assert metadata.further_images(bytes(got["d.jpg"].output)) == metadata.further_images((folder / "d.jpg").read_bytes())
    again = spark.createDataFrame([("x", made)], "path string, content binary")
    assert batch.optimize(again).first().skip_reason == "alreadyOptimized" and batch.optimize(again, batch.Options(skip_optimized=False)).first().skip_reason != "alreadyOptimized"
    assert codec.decode(bytes(got["a.jpg"].preview)).shape == (280, 300, 3)
    small = batch.optimize(chosen, batch.Options(mode="long_edge", pixels=150)).filter("path like '%a.jpg'").first()
    assert (small.status, small.height, small.width) == ("done", 150, 140) and codec.decode(bytes(small.output)).shape == (150, 140, 3)
    assert batch.optimize(photos.filter("false")).count() == 0


def test_unreadable_files_are_failed_rows(spark, folder):
    listing, photos = batch.read_photos(spark, [str(folder)])
    some = batch.optimize(photos.filter(~F.col("path").endswith("a.jpg"))).drop("output")
    row = batch.with_unread(listing, some).filter("path like '%a.jpg'").first()
    assert (row.status, row.original_bytes, row.error) == ("failed", 0, "can't be read")


def test_cancelled_photos_leave_no_row_and_waiting_ones_go_on(spark, folder):
    gate, events = batch.Gate(), []
    assert gate.enter(["x"]) == ["x"] and gate.enter(["y"]) is None and gate.enter(["y", "z"]) is None

    def told(event):
        events.append(event)
        if event["kind"] == "file":
            gate.cancel()

    rows = batch.run(spark, [str(folder)], batch.Options(), told, gate, at_once=2)
    assert len(rows) == 2 and events[-1] == {"kind": "finished", "processed": 2, "cancelled": True}
    assert gate.leave() == ["y", "z"] and not gate.cancelled and gate.leave() == [] and gate.enter(["w"]) == ["w"]


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([str(tmp_path)], spark) == 1 and "no photos" in capsys.readouterr().err
    before = {p: p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    assert cli.main([str(folder / "a.jpg"), str(folder / "c.jpg"), "--dry-run"], spark) == 0
    said = capsys.readouterr().out
    assert "skip" in said and "1 optimized, 1 skipped, 0 failed" in said and "[dry run]" in said
    assert cli.main([str(folder), "--out", str(tmp_path / "out")], spark) == 1
    captured = capsys.readouterr()
    assert captured.err.count("fail") == 2 and {p: p.read_bytes() for p in folder.rglob("*") if p.is_file()} == before
    written = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.jpg"))
    assert [os.path.basename(w) for w in written if "a.jpg" in w or "k.jpg" in w] == ["a.jpg", "k.jpg"]
    (tmp_path / "one.jpg").write_bytes(before[folder / "a.jpg"])
    assert cli.main([str(tmp_path / "one.jpg"), "--in-place"], spark) == 0 and len((tmp_path / "one.jpg").read_bytes()) < len(before[folder / "a.jpg"])
    with pytest.raises(SystemExit):
        cli.arguments(["x", "--in-place", "--out", "y"])
    assert cli.paths_of(["prog", "-f", "a.jpg", "missing"], str(folder)) == [str(folder / "a.jpg")]
    opened = cli.OpenedPaths()
    opened.push("a", "b")
    assert opened.take() == ["a", "b"] and opened.take() == []


def test_service_optimizes_and_undoes(spark, folder, tmp_path):
    home = tmp_path / "photos"
    home.mkdir()
    for name in ("a.jpg", "c.jpg", "g.jpg"):
        (home / name).write_bytes((folder / name).read_bytes())
    before = {p.name: p.read_bytes() for p in home.iterdir()}
    service = Service(spark, str(tmp_path / "books"))
    service.save_settings(Settings(strength="compact"))
    events = []
    assert service.get_settings().strength == "compact" and service.optimize([str(home)], events.append, now_ms=1000) == "1000"
    assert [e["kind"] for e in events] == ["started", "file", "file", "file", "finished"]
    found = service.session("1000")
    summary = found["summary"]
    assert (summary.photos, summary.optimized, summary.skipped, summary.can_undo) == (3, 1, 2, True) and summary.saved_bytes > 0
    assert len((home / "a.jpg").read_bytes()) < len(before["a.jpg"]) and [r.original for r in found["backups"].collect()] == [str(home / "a.jpg")]
    service.export_log("1000", str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4
    undone = service.undo_session("1000", str(tmp_path / "undo"))
    assert undone == {"restored": [str(home / "a.jpg")], "kept": []} and {p.name: p.read_bytes() for p in home.iterdir()} == before
    after = service.session("1000")["summary"]
    assert (after.undone, after.can_undo, after.saved_bytes, after.optimized) == (True, False, 0, 0)
    with pytest.raises(ValueError, match="undone"):
        service.undo_session("1000", str(tmp_path / "undo2"))
    assert service.ui_language(["de-DE", "es-MX"]) == "es"
    service.opened.push("x")
    assert service.take_opened_paths() == ["x"] and service.take_opened_paths() == []


def test_changed_outputs_are_kept_at_undo(spark, folder, tmp_path):
    home = tmp_path / "photos"
    home.mkdir()
    for name in ("a.jpg", "d.jpg"):
        (home / name).write_bytes((folder / name).read_bytes())
    service = Service(spark, str(tmp_path / "books"), Settings(strength="compact"))
    key = service.optimize([str(home)], now_ms=2000)
    (home / "d.jpg").write_bytes(b"changed since")
    assert service.undo_session(key, str(tmp_path / "undo")) == {"restored": [str(home / "a.jpg")], "kept": [str(home / "d.jpg")]}
    after = service.session(key)
    assert (after["summary"].undone, after["summary"].can_undo) == (False, True) and [r.original for r in after["backups"].collect()] == [str(home / "d.jpg")]
    service.settings = Settings(output_mode="export", export_dir=str(tmp_path / "out"), sizes=[{"label": "small", "mode": "long_edge", "pixels": 100}])
    assert service.optimize([str(home / "a.jpg")], now_ms=3000) == "3000" and codec.decode((tmp_path / "out" / "a.jpg").read_bytes()).shape == (100, 93, 3)
