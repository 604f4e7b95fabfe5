"""Golden cases of column functions, arrays, headers, search and streams."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import jpeg, text
from tallyspark.operators import blocks, decisions
from tallyspark.operators.search import lowest_passing, search_qualities
from tallyspark.sources import files as listing
from tallyspark.sources import journal
from tallyspark.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, want", [("=cmd()", "\"'=cmd()\""), ('a "b"', '"a ""b"""'), ("-1", "\"'-1\""), ("", '""')])
def test_csv_field(spark, value, want):
    assert one(spark, text.csv_field(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("../x/y", "-x-y"), ("  ", "Size"), ('2048 px: "web"?', "2048 px- -web--"), ("a\\b|c.", "a-b-c")])
def test_safe_label(spark, value, want):
    assert one(spark, text.safe_label(F.lit(value))) == want


def test_one_decimal_ties_to_even(spark):
    assert [one(spark, text.one_decimal(F.lit(v))) for v in (0.25, 0.35, -25.0, 0.0)] == ["0.2", "0.4", "-25.0", "0.0"]


def test_text_functions(spark):
    assert [one(spark, text.duration_text(F.lit(v).cast("long"))) for v in (999, 1500, 119_600)] == ["999 ms", "1.5 s", "1 min 60 s"]
    assert one(spark, text.bytes_text(F.lit(13_000_000).cast("long"))) == "13.0 MB"
    assert one(spark, text.converted_name(F.lit("/a/IMG.HEIC"))) == "/a/IMG.JPG"
    for tags, want in ((["fr", "es", "en"], "es"), (["de", "en", "es"], "en"), ([], "en")):
        assert one(spark, text.language(F.array(*[F.lit(t) for t in tags]).cast("array<string>"))) == want
    xmp = '<d exif:GPSLatitude="40,26.7N" exif:ExposureTime="1/60" exif:GPSLongitude=\'3,42W\'>\n<exif:GPSAltitude>650/1</exif:GPSAltitude><exif:GPSVersionID/><exif:FNumber>4</exif:FNumber>'
    left = one(spark, text.strip_property(F.lit(xmp), text.GPS))
    assert "GPS" not in left and "ExposureTime" in left and "FNumber" in left


def test_export_path(spark):
    rows = spark.createDataFrame([("/p/trip/day1/a.jpg", "/p/trip"), ("/p/a.jpg", None)], "path string, root string")
    got = [r.x for r in rows.select(text.export_path(F.col("path"), F.col("root"), "/out", F.lit("2048 px"), 2).alias("x")).collect()]
    assert got == ["/out/trip/day1/2048 px/a.jpg", "/out/2048 px/a.jpg"]


def test_unique_names_skip_taken_numbers(spark):
    rows = spark.createDataFrame([(i, "f", n) for i, n in enumerate(["a.jpg", "a.jpg", "a 2.jpg", "a.jpg", "b"])], "i long, folder string, name string")
    assert [r.unique for r in text.unique_names(rows, "folder", "name", "i").orderBy("i").collect()] == ["a.jpg", "a 3.jpg", "a 2.jpg", "a 4.jpg", "b"]


@pytest.mark.parametrize("size, turn, mode, pixels, want", [((6000, 4000), 1, "long_edge", 2048, (2048, 1365)), ((1600, 1200), 1, "long_edge", 2048, (None, None)), ((6000, 4000), 6, "max_width", 1000, (1500, 1000)), ((6000, 4000), 1, "max_width", 1000, (1000, 667))])
def test_target_size(spark, size, turn, mode, pixels, want):
    w, h = decisions.target_size(F.lit(size[0]), F.lit(size[1]), F.lit(turn), F.lit(mode), F.lit(pixels))
    assert (one(spark, w), one(spark, h)) == want


@pytest.mark.parametrize("quality", [50, 75, 85, 92])
def test_quality_estimate(spark, quality):
    assert abs(one(spark, blocks.estimate_quality(blocks.scaled_table(F.lit(quality)))) - quality) <= 1


@pytest.mark.parametrize("w, h", [(768, 512), (6000, 4000), (300, 9000), (257, 255)])
def test_tiles_cover_once(spark, w, h):
    grid = blocks.tile_grid(spark.createDataFrame([(1, w, h)], "id long, width long, height long")).collect()
    assert sum(t.w * t.h for t in grid) == w * h and sorted(t.tile for t in grid) == list(range(len(grid)))


@pytest.mark.parametrize("n, want", [(60, 10), (30, 8), (5, 5)])
def test_watch_list_sizes(spark, n, want):
    tiles = spark.range(n).select(F.lit(1).alias("id"), F.col("id").alias("tile"), F.when(F.col("id") == 7, 9).when(F.col("id") == 3, 8).otherwise(1).alias("difficulty"))
    got = blocks.watch_list(tiles).orderBy("rank").collect()
    assert len(got) == want and (n <= 7 or [r.tile for r in got][:3] == [7, 3, 0])


def test_pixels():
    assert blocks.half_res([10, 20, 30, 10, 20, 30, 100, 100, 100, 100, 100, 100] * 2, 4, 2, 3).reshape(-1).tolist() == [10, 20, 30, 100, 100, 100]
    image = np.arange(6).reshape(2, 3)
    assert all(blocks.orient(image, o).shape == ((3, 2) if o >= 5 else (2, 3)) for o in range(1, 9))
    assert blocks.orient(image, 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert sorted(blocks.zigzag()) == list(range(64)) and blocks.zigzag()[:6] == [0, 1, 8, 16, 9, 2]


@settings(max_examples=300, deadline=None)
@given(st.integers(35, 99), st.integers(35, 98), st.floats(0.75, 5))
def test_search_is_minimal_on_steep_curves(lowest, start, slope):
    found, probes = lowest_passing(lambda q: slope * (q - lowest), start, 35, 98)
    assert found == (lowest if lowest <= 98 else None) or (found is not None and 0 <= slope * (found - lowest) < 0.7)
    assert probes <= 64


def test_search_survives_nan_and_plateaus():
    assert lowest_passing(lambda q: math.nan, 60, 35, 98)[0] is None
    assert lowest_passing(lambda q: 5.0, 60, 35, 98)[0] == 35
    assert lowest_passing(lambda q: -0.1 if q < 70 else 0.1, 40, 35, 98)[0] >= 70


def test_batched_search_equals_single_searches(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(200):
        low, high = int(rng.integers(30, 60)), int(rng.integers(61, 99))
        curve = np.cumsum(rng.integers(-2, 12, high - low + 1)) - int(rng.integers(0, 300))
        rows.append((i, int(rng.integers(20, 110)), low, high, [None if x % 31 == 0 else int(x) for x in curve]))
    rows += [(200, 50, 40, 45, None), (201, 50, 40, 45, [1]), (202, 40, 40, 40, [5])]
    photos = spark.createDataFrame(rows, "id long, start int, low_q int, high_q int, slack10 array<int>")
    got = {r.id: (r.quality, r.probes) for r in search_qualities(photos).collect()}

    def one(_, start, low, high, curve):
        value = lambda q: curve[q - low] if curve and q - low < len(curve) else None
        return lowest_passing(lambda q: math.nan if value(q) is None else value(q) / 10, start, low, high)

    assert got == {r[0]: one(*r) for r in rows}
    for r in rows:
        quality, probes = got[r[0]]
        assert probes <= r[3] - r[2] + 1 and (quality is None or r[4][quality - r[2]] >= 0)
    plan = search_qualities(photos)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def photo(**changes):
    table = [16] * 64
    return jpeg.synthetic_jpeg(*{**dict(kind="baseline", width=640, height=480, bits=8, components=3, table=table, turn=6, marked=True, embedded=0, gain_map=0, thumbnail=False), **changes}.values())


def test_headers_round_trip_and_hostile_bytes():
    data = photo()
    found = jpeg.inspect(data)
    assert (found["kind"], found["width"], found["height"], found["components"], found["orientation"], found["has_marker"]) == ("baseline", 640, 480, 3, 6, True)
    assert found["table"] == [16] * 64 and not jpeg.has_embedded_media(data) and jpeg.has_embedded_media(photo(embedded=1))
    for cut in range(len(data)):
        jpeg.inspect(data[:cut]), jpeg.secondary_images(data[:cut]), jpeg.has_embedded_media(data[:cut])
    rng = np.random.default_rng(1)
    for _ in range(300):
        noise = bytearray(data)
        for at in rng.integers(2, len(data), 6):
            noise[at] = rng.integers(256)
        jpeg.inspect(bytes(noise)), jpeg.secondary_images(bytes(noise))


def test_headers_look_behind_thumbnails_and_through_the_whole_trailer():
    plain = photo(thumbnail=True)
    assert jpeg.primary_end(plain) == len(plain) and not jpeg.has_embedded_media(plain)
    late = photo(thumbnail=True, embedded=2)
    assert jpeg.primary_end(late) == len(plain) and jpeg.has_embedded_media(late) and jpeg.has_embedded_media(plain + bytes(100_000) + b"ftyp")
    assert [jpeg.inspect(photo(gain_map=n))["gain_map"] for n in range(4)] == [False, True, True, True]
    assert jpeg.inspect(photo() + b"aux:hdrgainmap")["gain_map"]
    assert jpeg.primary_end(b"\xff\xd8\xff\xda") is None and jpeg.primary_end(b"\xff\xd8\xff\xe1\x00\x09Exif") is None


def test_exif_gps_is_wiped_in_place():
    import struct

    gps = struct.pack("<HHHII", 1, 2, 5, 3, 90) + bytes(4)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, 60) + bytes(4)
    tiff = tiff.ljust(60, b"\0") + struct.pack("<H", 1) + struct.pack("<HHII", 2, 5, 3, 90) + bytes(4)
    tiff = tiff.ljust(90, b"\0") + b"SECRETSECRETSECRETSECRET"
    out = jpeg.strip_gps(tiff)
    assert len(out) == len(tiff) and b"SECRET" not in out and jpeg.orientation(out) == 6 and gps
    assert jpeg.orientation(jpeg.set_orientation(tiff, 3)) == 3 and jpeg.set_orientation(b"xx", 3) is None


def test_heif_classification():
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    item = box(b"infe", b"\2\0\0\0" + (7).to_bytes(2, "big") + b"\0\0" + b"Exif\0")
    meta = box(b"meta", bytes(4) + box(b"pitm", bytes(4) + b"\0\1") + box(b"iinf", bytes(4) + b"\0\1" + item) + box(b"grpl", box(b"ster", bytes(8))))
    data = box(b"ftyp", b"heic\0\0\0\0mif1") + meta
    found = jpeg.inspect_heif(data)
    assert found["primary"] == 1 and found["items"] == {7: "Exif"} and found["stereo"] and not found["hdr"]
    for cut in range(len(data)):
        jpeg.inspect_heif(data[:cut])
    assert jpeg.inspect_heif(b"") is None and jpeg.inspect_heif(photo()) is None


def test_heif_properties_belong_to_items():
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    colour = lambda transfer: box(b"colr", b"nclx\0\x09" + transfer.to_bytes(2, "big") + b"\0\x09\x80")

    def photo_with(items, flags=0):
        size = 2 if flags else 1
        rows = b"".join(item.to_bytes(2, "big") + bytes([len(places)]) + b"".join((p | 0x80 << 8 * (size - 1)).to_bytes(size, "big") for p in places) for item, places in items.items())
        ipma = box(b"ipma", bytes([0, 0, 0, flags]) + len(items).to_bytes(4, "big") + rows)
        props = box(b"iprp", box(b"ipco", colour(1) + colour(16) + box(b"irot", b"\1")) + ipma)
        return box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", bytes(4) + box(b"pitm", bytes(4) + b"\0\1") + props)

    plain, wide = jpeg.inspect_heif(photo_with({1: [1, 3], 2: [2]})), jpeg.inspect_heif(photo_with({1: [2, 3, 9]}, 1))
    assert not plain["hdr"] and wide["hdr"] and plain["associations"] == {1: [1, 3], 2: [2]}
    assert [n for n, _ in jpeg.properties_of(wide, 1)] == ["colr", "irot"] and jpeg.properties_of(wide, 7) == []
    data = photo_with({1: [2]})
    for cut in range(len(data)):
        jpeg.inspect_heif(data[:cut])


def test_results_decode_with_defaults(spark):
    whole = {"id": 1, "path": "/a", "name": "a", "status": "done", "originalBytes": 2, "outputBytes": 1, "outputs": [], "width": 1, "height": 1, "millis": 3}
    rows = [(json.dumps(whole),), (json.dumps({k: v for k, v in whole.items() if k != "millis"}),), ("{",), (None,)]
    got = journal.decode_results(spark.createDataFrame(rows, "result string")).collect()
    assert len(got) == 1 and got[0].result.lossless is False and got[0].result.previewPath is None


def test_journal_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "/a", "/b", None, (5, 6))], "session_id string, idx long, original string, backup string, output string, written struct<bytes: long, modifiedMs: long>")
    journal.append_journal(rows, str(tmp_path / "j"))
    (tmp_path / "j" / "broken.txt").write_text('{"original": "/x"\n\n')
    got = journal.read_journal(spark, str(tmp_path / "j")).collect()
    assert [(r.original, r.backup, r.written.bytes) for r in got] == [("/a", "/b", 5)]


def test_listing_walks_in_order_and_keeps_loose_files(spark, tmp_path):
    for name in ("one.JPG", "a/two.jpeg", "a/b/three.jpg", "a/_MAN1.jpg", "a/notes.txt", ".hidden/x.jpg", "a/.y.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = listing.list_photos(spark, [str(tmp_path), str(tmp_path / "a/notes.txt"), str(tmp_path / "one.JPG"), str(tmp_path / "missing")]).orderBy("ordinal").collect()
    assert [r.path.removeprefix(f"{tmp_path}/") for r in got] == ["a/_MAN1.jpg", "a/b/three.jpg", "a/two.jpeg", "one.JPG", "a/notes.txt"]
    assert got[0].root == str(tmp_path) and got[-1].root is None and got[0].bytes == 4


def test_live_statistics_go_on_from_their_checkpoint(spark, tmp_path):
    schema = "session_id string, seq long, status string, converted boolean, original_bytes long, output_bytes long"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    put(0, [("s", 1, "done", False, 100, 40), ("t", 1, "failed", False, 9, 9)])
    events = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    state = lambda df: {r.session_id: (r.processed, r.saved_bytes) for r in df.collect()}
    assert state(stream.streamed_live_stats(events, str(tmp_path / "w"))) == {"s": (1, 60), "t": (1, 0)}
    put(1, [("s", 2, "done", False, 10, 4)])
    assert state(stream.streamed_live_stats(events, str(tmp_path / "w"))) == {"s": (2, 66), "t": (1, 0)}
    batches = sorted(p.name for p in (tmp_path / "w" / "stats").iterdir())
    assert batches == ["batch=0", "batch=1"] and spark.read.parquet(str(tmp_path / "w" / "stats" / "batch=1")).count() == 1


def test_phase_machine_and_stream(spark, tmp_path):
    schema = "session_id string, seq long, kind string, total long, converted boolean, original_bytes long, output_bytes long"
    rows = [("s", 1, "started", 2, False, 0, 0), ("s", 2, "file", 0, False, 100, 40), ("s", 3, "file", 0, True, 100, 40), ("s", 4, "finished", 0, False, 0, 0), ("t", 1, "file", 0, False, 9, 1), ("t", 2, "started", 5, False, 0, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stream.phase_machine(events).writeStream.format("memory").queryName("phases").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.session_id: (r.phase, r.processed, r.total, r.saved_bytes) for r in spark.table("phases").collect()}
    assert got == {"s": ("done", 2, 2, 60), "t": ("running", 0, 5, 0)}
