"""Registered queries over real JPEG bytes, segment arrays and pixels kept as rows or arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import codec, jpeg, metadata, text
from ..operators import batch, blocks, decisions
from ..sources import analog
from ..sources.files import folder_sizes
from . import views
from .catalog import State, query


def _suppliers(spark, sf_dir):
    """Ids of suppliers, in four tasks a core by their hashes: one small file of ids makes hours of work on pixels."""
    rows = analog.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "id")


def _made(number: int, kind: int) -> bytes:
    """A small photo of which it is known how the batch ends: see ``batch_outcomes``."""
    if kind == 0:
        return b"no photo %d" % number
    if kind == 1:
        return b"\0\0\0\x18ftypheic" + bytes(16)
    rng = np.random.default_rng(number)
    height, width = 40 + number % 24, 48 + number % 17
    y, x = np.mgrid[0:height, 0:width]
    pixels = np.stack([128 + 100 * np.sin((x + number) / 9) + rng.normal(0, 6, x.shape), 128 + 90 * np.cos(y / 7), (3 * x + y) % 256], 2).clip(0, 255).astype(np.uint8)
    data = codec.encode(pixels, 60 if kind == 7 else 99, (1, 1))
    if kind == 2:
        return metadata.splice(data, [(0xFE, jpeg.MARKER + b" 1")])
    if kind == 3:
        return data + bytes(500) + b"ftyp"
    if kind == 4:
        return metadata.splice(data, [(0xE1, b"hdrgm:Version")])
    if kind == 5:
        return data[:30]
    return data[: len(data) * 2 // 3] if kind == 6 else data


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 IN (5, 6) THEN 'failed' WHEN s_suppkey % 10 >= 8 THEN 'done' ELSE 'skipped' END AS status,
CASE s_suppkey % 10 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'conversionOff' WHEN 2 THEN 'alreadyOptimized' WHEN 3 THEN 'embeddedMedia' WHEN 4 THEN 'hdrGainMap' WHEN 7 THEN 'noGain' END AS skip_reason,
s_suppkey % 10 IN (5, 6) AS has_error, s_suppkey % 10 >= 8 AS smaller, CASE WHEN s_suppkey % 10 >= 8 THEN 48 + s_suppkey % 17 END AS width, CASE WHEN s_suppkey % 10 >= 8 THEN 40 + s_suppkey % 24 END AS height,
s_suppkey % 10 >= 8 AS good_enough FROM supplier""")
def batch_outcomes(spark, sf_dir):
    """Real files through the whole batch: bytes, headers, checks, search, choice; one typed row for every file."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"path": rows["id"].astype(str), "content": [_made(int(i), int(i) % 10) for i in rows["id"]]})

    photos = _suppliers(spark, sf_dir).mapInPandas(make, "path string, content binary")
    done = F.col("status") == "done"
    return batch.optimize(photos).select(
        F.col("path").cast("long").alias("id"), "status", "skip_reason", F.col("error").isNotNull().alias("has_error"), (F.col("output_bytes") < F.col("original_bytes")).alias("smaller"), "width", "height",
        (done & (F.col("score") >= 91.5) & (F.col("worst") >= 86.5)).alias("good_enough"),
    )


@query("SELECT s_suppkey AS id, 48 + s_suppkey % 17 AS width, 40 + s_suppkey % 24 AS height, true AS same_file, true AS same_pixels, true AS coarser, true AS near FROM supplier")
def codec_roundtrip(spark, sf_dir):
    """Lossless recoding gives the same file and pixels; requantised coefficients have no finer step; pixels come back within a few levels."""
    schema = "id long, width long, height long, same_file boolean, same_pixels boolean, coarser boolean, near boolean"

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in rows["id"]:
                data = _made(int(i), 9)
                image = codec.read(data)
                again, coarse = codec.transcode(data), codec.requantized(image, 70)
                pixels = codec.pixels(image)
                back = codec.decode(codec.encode(pixels, 99, (1, 1)))
                steps = all((coarse.tables[c.slot] >= image.tables[c.slot]).all() for c in image.components)
                out.append((int(i), image.width, image.height, again == data, np.array_equal(codec.decode(again), pixels), steps, bool(np.abs(back.astype(int) - pixels).mean() < 2)))
            yield pd.DataFrame(out, columns=["id", "width", "height", "same_file", "same_pixels", "coarser", "near"])

    return _suppliers(spark, sf_dir).mapInPandas(check, schema)


# segments: photos have five, of which some don't go on


@query(f"""WITH {views.PHOTOS}, s AS (SELECT id, id % 2 = 0 AS strip, [{{'marker': CASE WHEN id % 3 = 0 THEN 254 ELSE 225 END, 'body': 'tallyspark ' || id}}, {{'marker': 226, 'body': CASE WHEN id % 5 = 0 THEN 'ICC' ELSE 'MPF' || chr(0) END || id}},
{{'marker': CASE WHEN id % 7 = 0 THEN 238 ELSE 237 END, 'body': 'Adobe' || id}}, {{'marker': 225, 'body': CASE WHEN id % 4 < 2 THEN 'http://ns.adobe.com/xmp/extension/' || chr(0) ELSE 'Exif' END || id}}, {{'marker': 254, 'body': 'text ' || id}}] AS segments FROM v_photos),
k AS (SELECT id, list_filter(segments, lambda x: NOT ((x.marker = 254 AND starts_with(x.body, 'tallyspark')) OR (x.marker = 226 AND starts_with(x.body, 'MPF' || chr(0))) OR x.marker = 238
OR (strip AND x.marker = 225 AND starts_with(x.body, 'http://ns.adobe.com/xmp/extension/')))) AS kept FROM s)
SELECT id, array_to_string(list_transform(kept, lambda x: x.marker || ':' || length(x.body)), ' ') || ' 254:14' AS segments FROM k""")
def segment_filter(spark, sf_dir):
    """Metadata that goes on to the new file, in order, with our marker at the end, as filters over arrays."""
    photos, i = analog.photos(spark, sf_dir), F.col("id")
    number = i.cast("string")
    seg = lambda marker, body: F.struct(F.lit(marker).cast("int").alias("marker") if isinstance(marker, int) else marker.cast("int").alias("marker"), body.cast("binary").alias("body"))
    segments = F.array(
        seg(F.when(i % 3 == 0, 254).otherwise(225), F.concat(F.lit("tallyspark "), number)), seg(226, F.concat(F.when(i % 5 == 0, "ICC").otherwise("MPF\0"), number)),
        seg(F.when(i % 7 == 0, 238).otherwise(237), F.concat(F.lit("Adobe"), number)), seg(225, F.concat(F.when(i % 4 < 2, "http://ns.adobe.com/xmp/extension/\0").otherwise("Exif"), number)),
        seg(254, F.concat(F.lit("text "), number)),
    )
    both = [metadata.kept_segments(segments, strip, "1 q") for strip in (True, False)]
    kept = F.when(i % 2 == 0, both[0]).otherwise(both[1])
    return photos.select("id", F.concat_ws(" ", F.transform(kept, lambda s: F.concat_ws(":", s["marker"].cast("string"), F.octet_length(s["body"]).cast("string")))).alias("segments"))


@query(f"""WITH {views.PHOTOS}, x AS (SELECT id, '<r tiff:Orientation="' || orientation || '" a="1"><tiff:Orientation>' || orientation || '</tiff:Orientation></r>' AS xmp FROM v_photos)
SELECT id, replace(regexp_replace(xmp, 'tiff:Orientation="\\d+"', 'tiff:Orientation="1"'), substr(xmp, strpos(xmp, '<tiff:Orientation>'), 38), '<tiff:Orientation>1</tiff:Orientation>') AS xmp FROM x""")
def upright_xmp(spark, sf_dir):
    """XMP that states the orientation of upright pixels, as an attribute and as an element."""
    o = F.col("orientation").cast("string")
    xmp = F.concat(F.lit('<r tiff:Orientation="'), o, F.lit('" a="1"><tiff:Orientation>'), o, F.lit("</tiff:Orientation></r>"))
    return analog.photos(spark, sf_dir).select("id", metadata.upright(xmp).alias("xmp"))


# pixels as rows: lines are pixels of their supplier's picture, 700 pixels wide and 500 high
_PIXELS = "SELECT CAST(l_suppkey AS BIGINT) AS id, CAST((l_partkey * 7 + l_linenumber) % 700 AS BIGINT) AS x, CAST((l_orderkey * 13 + l_linenumber) % 500 AS BIGINT) AS y, CAST(l_quantity AS BIGINT) AS error FROM lineitem"


def _pixels(spark, sf_dir):
    return analog.table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as bigint) AS id", "cast((l_partkey * 7 + l_linenumber) % 700 as bigint) AS x", "cast((l_orderkey * 13 + l_linenumber) % 500 as bigint) AS y", "cast(l_quantity as bigint) AS error")


@query(f"""WITH p AS ({_PIXELS}) SELECT id, least(y // 256, 1) * 3 + least(x // 256, 2) AS tile, CAST(sum(error) * 100 // count(*) AS BIGINT) AS difficulty_hundredths, count(*) AS pixels FROM p GROUP BY ALL""")
def tile_difficulty(spark, sf_dir):
    """Mean error of the pixels of each tile."""
    rows = _pixels(spark, sf_dir).withColumns({"width": F.lit(700), "height": F.lit(500)})
    return blocks.tile_difficulty(rows).select("id", "tile", "difficulty_hundredths", "pixels")


@query(f"""WITH p AS ({_PIXELS}), one AS (SELECT id, x, y, max(error) AS v FROM p GROUP BY ALL) SELECT id, x // 2 AS x, y // 2 AS y, CAST((sum(v) * 4 // count(*) + 2) // 4 AS BIGINT) AS v FROM one GROUP BY id, x // 2, y // 2""")
def half_resolution(spark, sf_dir):
    """Half-size pictures from pixels as rows, of those pixels that there are."""
    one = _pixels(spark, sf_dir).groupBy("id", "x", "y").agg(F.max("error").alias("v"))
    return blocks.half_resolution(one)


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 8 + 1 AS o, p_partkey % 60 AS x, p_partkey % 40 AS y FROM part)
SELECT id, CASE o WHEN 1 THEN x WHEN 2 THEN 59 - x WHEN 3 THEN 59 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 39 - y WHEN 7 THEN 39 - y ELSE y END AS x,
CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 39 - y WHEN 4 THEN 39 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 59 - x ELSE 59 - x END AS y FROM p""")
def upright_places(spark, sf_dir):
    """Where a stored pixel is shown, for the eight orientations."""
    rows = analog.table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) AS id", "p_partkey % 8 + 1 AS o", "p_partkey % 60 AS x", "p_partkey % 40 AS y")
    x, y = blocks.upright(F.col("x"), F.col("y"), F.lit(60), F.lit(40), F.col("o"))
    return rows.select("id", x.cast("long").alias("x"), y.cast("long").alias("y"))


@query("""WITH g AS (SELECT p_partkey AS id, [p_size % 256, p_partkey % 256, 255] AS gray FROM part) SELECT id, array_to_string(flatten(list_transform(gray, lambda v: [v, v, v])), ',') AS rgb FROM g""")
def gray_to_rgb(spark, sf_dir):
    gray = F.array((F.col("p_size") % 256).cast("int"), (F.col("p_partkey") % 256).cast("int"), F.lit(255))
    return analog.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat_ws(",", F.transform(blocks.as_rgb(gray), lambda v: v.cast("string"))).alias("rgb"))


@query("""SELECT * FROM (VALUES (1, 0, '0', 0, 0), (1, 1, '0', 1, 5), (1, 2, '0', 6, 63), (3, 0, '0,1,2', 0, 0), (3, 1, '0', 1, 5), (3, 2, '1', 1, 5), (3, 3, '2', 1, 5), (3, 4, '0', 6, 63), (3, 5, '1', 6, 63), (3, 6, '2', 6, 63)) t(components, scan, planes, first, last)""")
def scan_script(spark, sf_dir):
    """Scans of a progressive file for one and three components."""
    rows = [(n, i, ",".join(map(str, planes)), first, last) for n in (1, 3) for i, (planes, first, last) in enumerate(codec.spectral_scans(n))]
    return spark.createDataFrame(rows, "components int, scan int, planes string, first int, last int")


@query(f"""WITH {views.PHOTOS} SELECT id, CASE WHEN id % 20 - 9 < 0 THEN id % 20 - 9 ELSE least(id % 20 - 9, id % 7 - 3) END AS slack, id % 20 - 9 >= 0 AS ok FROM v_photos""")
def score_gate(spark, sf_dir):
    """Slack of a probe: watched tiles decide if they fail, else the whole frame is scored too."""
    tiles, whole = F.col("id") % 20 - 9, F.col("id") % 7 - 3
    return analog.photos(spark, sf_dir).select("id", decisions.gated_slack(tiles, whole).alias("slack"), (tiles >= 0).alias("ok"))


@query(f"WITH {views.PHOTOS} SELECT id, CAST(least(greatest(floor((1 + id % 4) / (1 + id % 3)), 1), 4) AS BIGINT) AS columns, CAST(least(greatest(floor((1 + id % 5) / (1 + id % 2)), 1), 4) AS BIGINT) AS rows FROM v_photos")
def chroma_blocks(spark, sf_dir):
    i = F.col("id")
    return analog.photos(spark, sf_dir).select("id", decisions.chroma_block(1 + i % 4, 1 + i % 3).cast("long").alias("columns"), decisions.chroma_block(1 + i % 5, 1 + i % 2).cast("long").alias("rows"))


# small reads of the ledger


@query("""SELECT o_orderkey AS id, CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'low' THEN 'compact' WHEN 'urgent' THEN 'pristine' ELSE 'identical' END AS strength, CASE WHEN o_orderstatus = 'O' THEN 'export' ELSE 'replace' END AS output_mode FROM orders""")
def enum_defaults(spark, sf_dir):
    """Stored names of strengths and modes; unknown ones give the defaults."""
    stored = F.expr("CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'low' THEN 'compact' WHEN 'urgent' THEN 'pristine' ELSE o_orderpriority END")
    mode = F.expr("CASE o_orderstatus WHEN 'O' THEN 'export' WHEN 'F' THEN 'replace' ELSE o_orderstatus END")
    return analog.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), text.strength_of(stored).alias("strength"), text.known_or(mode, ["replace", "export"], "replace").alias("output_mode"))


@query(f"""WITH {views.BACKUPS} SELECT string_split(path, '/')[3] AS session_id, CAST(sum(bytes) AS BIGINT) AS backup_bytes FROM v_disk GROUP BY 1""")
def backup_folders(spark, sf_dir):
    """Sizes of the folders of backups from a listing of files; loose files beside them don't count."""
    disk = State(spark, sf_dir).disk
    loose = spark.createDataFrame([("loose.jpg", 9)], "path string, bytes long")
    return folder_sizes(disk.select("path", "bytes").unionByName(loose))


@query(f"""WITH {views.BACKUPS}, shown AS (SELECT id, saved_bytes AS shown_saved FROM v_sessions WHERE CAST(id AS BIGINT) % 3 = 0), fresh AS (SELECT id, saved_bytes, can_undo FROM v_sessions WHERE CAST(id AS BIGINT) % 5 <> 0)
SELECT s.id, coalesce(f.saved_bytes, s.shown_saved) AS saved_bytes, coalesce(f.can_undo, false) AS can_undo, f.id IS NOT NULL AS refreshed FROM shown s LEFT JOIN fresh f ON f.id = s.id""")
def refreshed_sessions(spark, sf_dir):
    """What is on screen after a refresh: rows of the new history where it still has them."""
    sessions = State(spark, sf_dir).sessions
    shown = sessions.filter("cast(id as bigint) % 3 = 0").select("id", F.col("saved_bytes").alias("shown_saved"))
    fresh = sessions.filter("cast(id as bigint) % 5 <> 0").select("id", "saved_bytes", "can_undo", F.lit(True).alias("known"))
    joined = shown.join(fresh, "id", "left")
    return joined.select("id", F.coalesce("saved_bytes", "shown_saved").alias("saved_bytes"), F.coalesce("can_undo", F.lit(False)).alias("can_undo"), F.coalesce("known", F.lit(False)).alias("refreshed"))


@query(f"""WITH {views.FILES}, n AS (SELECT DISTINCT name FROM v_files) SELECT name FROM n ORDER BY name LIMIT 25""")
def first_names(spark, sf_dir):
    """The first names of a benchmark's folder: a top-k, nothing is sorted as a whole."""
    return analog.files(spark, sf_dir).select("name").distinct().orderBy("name").limit(25)


@query("""SELECT event_id AS id, CAST(floor(1000 * (sin(event_id % 1000 * 12.9898::DOUBLE) * 43758.5453::DOUBLE - floor(sin(event_id % 1000 * 12.9898::DOUBLE) * 43758.5453::DOUBLE))) AS BIGINT) AS noise_permille FROM events""")
def sine_noise(spark, sf_dir):
    """Noise between 0 and 1 that is the same everywhere, in thousandths."""
    return analog.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), F.floor(1000 * text.noise(F.col("event_id") % 1000)).cast("long").alias("noise_permille"))


@query(f"""WITH {views.FILES} SELECT session_id, idx, status = 'done' AND NOT coalesce(error IS NOT NULL, false) AS comparable FROM v_files""")
def comparable_on_screen(spark, sf_dir):
    """Files that the screen offers for comparison: those with outputs, whatever is on disk."""
    outputs = F.when((F.col("status") == "done") & F.col("error").isNull(), F.array("path")).otherwise(F.array().cast("array<string>"))
    return analog.files(spark, sf_dir).select("session_id", "idx", (F.size(outputs) > 0).alias("comparable"))
