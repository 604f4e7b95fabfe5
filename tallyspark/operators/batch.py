"""The batch itself: photos are read, checked, encoded as far down as the eye allows, and end in one row each.

Headers, checks and the choice between candidates are columns; only pixels need Python, in ``candidates``,
and only for photos that no check has taken out.  Files travel once: rows are worked on where ``binaryFile``
reads them, and what can't be read or parsed is a failed row, never a failed job.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, jpeg, metadata
from ..schemas import STRENGTH_ROWS
from ..sources.files import list_photos
from . import blocks, decisions, search

VERSION = "1"
PREVIEW_EDGE, PREVIEW_QUALITY = 720, 80


@dataclass(frozen=True)
class Options:
    """What to do with the photos; ``mode`` and ``pixels`` bound a side, null keeps the size."""

    strength: str = "identical"
    mode: str | None = None
    pixels: int | None = None
    strip_location: bool = False
    skip_optimized: bool = True
    convert_heic: bool = False
    max_pixels: int = decisions.MAX_PIXELS
    quality_hint: int | None = None
    preview: bool = False


# one photo


class Reference:
    """A photo's pixels and what is found out about them once: tile side, and the tiles that the hardest probe marks."""

    def __init__(self, pixels: np.ndarray):
        self.pixels = codec.as_rgb(pixels)
        self.side = min(max(max(pixels.shape[:2]) // 6, blocks.MIN_TILE), blocks.MAX_TILE)
        self.watched: list[tuple[int, int, int, int]] = []
        self._maps: dict[tuple, np.ndarray] = {}

    def scores(self, made: np.ndarray) -> tuple[float, float]:
        """(global score, worst tile) of other pixels; the hardest tiles of the latest comparison are watched."""
        found = codec.compare(self.pixels, codec.as_rgb(made), self.side)
        places = [(y, x, h, w) for y, h in codec.spans(made.shape[0], self.side) for x, w in codec.spans(made.shape[1], self.side)]
        hardest = sorted(range(len(places)), key=lambda i: (-found["tiles"][i]["difficulty"], i))[: max(len(places) // blocks.WATCH_SHARE, blocks.WATCH_MIN)]
        self.watched = [places[i] for i in hardest]
        return found["global"], min(t["score"] for t in found["tiles"])

    def watched_worst(self, made: np.ndarray) -> float | None:
        """Worst score of the watched tiles, None before there are any."""
        made = codec.as_rgb(made)
        parts = [codec.score(codec.error_map(self.pixels[y : y + h, x : x + w], made[y : y + h, x : x + w])) for y, x, h, w in self.watched]
        return min(parts) if parts else None


def smallest(encoder: Callable[[int], bytes], pixels: np.ndarray, strength: str, targets: tuple[float, float], start: int | None) -> dict | None:
    """bytes, quality, global score and worst tile of the smallest file that reaches the targets; None if none does.

    A probe whose watched tiles fail already isn't scored as a whole.
    """
    _, _, _, low, high, prior, _, _ = next(r for r in STRENGTH_ROWS if r[0] == strength)
    reference, made = Reference(pixels), {}

    def slack(quality: int) -> float:
        data = encoder(quality)
        seen = codec.decode(data)
        watched = reference.watched_worst(seen)

        def whole() -> float:
            made[quality] = (data, *reference.scores(seen))
            return min(made[quality][1] - targets[0], made[quality][2] - targets[1])

        return search.passes_gate(np.inf if watched is None else watched - targets[1], whole)

    quality, _ = search.lowest_passing(slack, prior if start is None else start, low, high)
    return None if quality is None else dict(zip(("bytes", "score", "worst"), made[quality]), quality=quality)


def at_top(encoder: Callable[[int], bytes], pixels: np.ndarray, strength: str) -> dict:
    """The same for the highest quality, whatever it scores."""
    quality = next(r[4] for r in STRENGTH_ROWS if r[0] == strength)
    data = encoder(quality)
    whole, worst = Reference(pixels).scores(codec.decode(data))
    return {"bytes": data, "quality": quality, "score": whole, "worst": worst}


def chroma_block(image: codec.Image) -> tuple[int, int]:
    """Columns and rows of the first plane for each one of the second, 4 at most."""
    if len(image.components) < 3:
        return 1, 1
    first, second = image.components[:2]
    return min(max(first.h // second.h, 1), 2), min(max(first.v // second.v, 1), 2)


def fitted(width: int, height: int, orientation: int, mode: str | None, pixels: int | None) -> tuple[int, int] | None:
    """Stored sides of a photo that is shown in a bounded size; None where it fits already."""
    shown = (height, width) if orientation >= 5 else (width, height)
    edge = {"long_edge": max(shown), "max_width": shown[0], "max_height": shown[1]}.get(mode)
    if not edge or not pixels or pixels >= edge:
        return None
    return tuple(max(1, int(side * (pixels / edge) + 0.5)) for side in (width, height))


def preview(pixels: np.ndarray, orientation: int, edge: int = PREVIEW_EDGE) -> bytes:
    """A small upright JPEG."""
    sides = fitted(pixels.shape[1], pixels.shape[0], orientation, "long_edge", edge)
    small = codec.thumbnail(pixels, *sides) if sides else pixels
    return codec.encode(np.ascontiguousarray(blocks.orient(small, orientation)), PREVIEW_QUALITY)


def render(data: bytes, options: Options, quality_estimate: int | None, gain_map: bool, adobe_transform: int | None) -> dict:
    """Candidates for one photo that has passed the checks: a perceptual and a lossless one, each complete with metadata, or null.

    At its own size a photo's coefficients are requantised, so its blocks stay where they are; a resized one is encoded anew and always has a candidate.
    """
    image = codec.read(data)
    pixels, orientation = codec.pixels(image), next((jpeg.orientation(b[6:]) for m, b in jpeg.segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), 1)
    further = metadata.further_images(data) if gain_map else []
    sides = fitted(image.width, image.height, orientation, options.mode, options.pixels)
    out = dict.fromkeys(f.name for f in CANDIDATES) | {"decoded_width": image.width, "decoded_height": image.height, "resized": sides is not None}
    if options.preview:
        out["preview"] = preview(pixels, orientation)
    own = metadata.split(data)[0]

    def whole(made: bytes, text: str) -> bytes:
        return metadata.append_images(metadata.splice(made, metadata.prepared(own, options.strip_location, f"{VERSION} {text}")), further)

    requantizable = not (adobe_transform == 0 and len(image.components) == 3)
    compressed = quality_estimate is not None and quality_estimate < decisions.COMPRESSED_BELOW
    if sides or not compressed:
        made = codec.resize(pixels, *sides) if sides else pixels
        if sides or not requantizable:
            chroma = chroma_block(image)
            encoder = lambda q: codec.encode(made, q, chroma)
        else:
            encoder = lambda q: codec.write(codec.requantized(image, q))
        targets = next(r[1:3] for r in STRENGTH_ROWS if r[0] == options.strength)
        found = smallest(encoder, made, options.strength, targets, options.quality_hint) or (at_top(encoder, made, options.strength) if sides else None)
        if found:
            out |= {"perceptual": whole(found["bytes"], f"q={found['quality']} s={found['score']:.1f}"), "quality": found["quality"], "score": found["score"], "worst": found["worst"], "out_width": made.shape[1], "out_height": made.shape[0]}
    if not sides and requantizable:
        out["lossless"] = whole(codec.write(image), "lossless")
    return out


CANDIDATES = T.StructType(
    [
        T.StructField("decoded_width", T.LongType()), T.StructField("decoded_height", T.LongType()), T.StructField("resized", T.BooleanType()),
        T.StructField("perceptual", T.BinaryType()), T.StructField("lossless", T.BinaryType()), T.StructField("quality", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("worst", T.DoubleType()), T.StructField("out_width", T.LongType()), T.StructField("out_height", T.LongType()),
        T.StructField("preview", T.BinaryType()), T.StructField("broken", T.StringType()),
    ]
)


def candidates(photos: DataFrame, options: Options) -> DataFrame:
    """photos with the fields of ``CANDIDATES``; rows with a ``reason`` or an ``error`` pass untouched, a photo that can't be decoded has ``broken``."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                out = dict.fromkeys(f.name for f in CANDIDATES)
                if not isinstance(row.reason, str) and not isinstance(row.error, str):
                    try:
                        known = lambda v: None if pd.isna(v) else int(v)
                        out = render(bytes(row.content), options, known(row.quality_estimate), bool(row.gain_map), known(row.adobe_transform))
                        if (out["decoded_width"], out["decoded_height"]) != (known(row.width), known(row.height)):
                            out["broken"] = "decoded size differs from header"
                    except Exception as error:  # noqa: BLE001 - one hostile file must not end the batch
                        out["broken"] = str(error) or type(error).__name__
                rows.append(out)
            made = pd.DataFrame(rows, columns=CANDIDATES.names, index=batch.index, dtype=object)
            yield pd.concat([batch.drop(columns=["content"]), made], axis=1)

    fields = [f for f in photos.schema.fields if f.name != "content"]
    return photos.mapInPandas(make, T.StructType([*fields, *CANDIDATES.fields]))


# all photos


def is_heif(content: Column) -> Column:
    return F.substring(content, 5, 4) == F.lit(b"ftyp")


def prepared(photos: DataFrame, options: Options) -> DataFrame:
    """photos (path, content) with header fields, quality_estimate, and ``reason`` to skip or ``error``, both null for those that go on."""
    read = jpeg.with_headers(photos.withColumn("__header", F.col("content")), "__header")
    estimate = F.when(F.col("table").isNotNull(), blocks.estimate_quality(F.col("table")))
    indexed = F.col("indexed")
    reason = (
        F.when(F.col("content").isNull(), None)
        .when(is_heif(F.col("content")), F.when(F.lit(options.convert_heic), "unsupported").otherwise("conversionOff"))
        .when(~jpeg.is_jpeg(F.col("content")), "unsupported").when(F.col("kind").isNull(), None)
        .otherwise(F.coalesce(decisions.jpeg_precheck(options.max_pixels), F.when(F.col("gain_map") & ~indexed, "hdrGainMap")))
    )
    if options.mode is None and options.skip_optimized:
        reason = F.coalesce(reason, F.when(F.col("has_marker"), "alreadyOptimized"))
    error = F.when(F.col("content").isNull(), "can't be read").when(jpeg.is_jpeg(F.col("content")) & F.col("kind").isNull(), "malformed header")
    return read.withColumns({"quality_estimate": estimate, "reason": reason, "error": error})


def optimize(photos: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per photo of (path, content): status, skip_reason or error, sizes, scores, and ``output``, the new file's bytes where there is one."""
    made = candidates(prepared(photos.select("path", "content", F.octet_length("content").cast("long").alias("original_bytes")), options), options)
    sizes = made.withColumns({"perceptual_bytes": F.octet_length("perceptual").cast("long"), "lossless_bytes": F.octet_length("lossless").cast("long")})
    decided = F.when(F.col("resized"), "perceptual").otherwise(decisions.render_decision(options.skip_optimized))
    sure = sizes.withColumn("error", F.coalesce("error", "broken")).withColumn("decision", F.when(F.col("error").isNull() & F.col("reason").isNull(), decided))
    done = F.col("decision").isin("perceptual", "lossless")
    lossless = F.coalesce(F.col("decision") == "lossless", F.lit(False))
    output = F.when(F.col("decision") == "perceptual", F.col("perceptual")).when(lossless, F.col("lossless"))
    return sure.select(
        "path",
        F.when(F.col("error").isNotNull(), "failed").when(done, "done").otherwise("skipped").alias("status"),
        F.when(F.col("error").isNull() & ~F.coalesce(done, F.lit(False)), F.coalesce("reason", "decision")).alias("skip_reason"), "error",
        F.coalesce("original_bytes", F.lit(0)).cast("long").alias("original_bytes"), F.coalesce(F.octet_length(output).cast("long"), "original_bytes", F.lit(0)).cast("long").alias("output_bytes"),
        F.when(done, F.when(lossless, F.coalesce("quality_estimate", F.lit(100))).otherwise(F.col("quality"))).cast("long").alias("quality"),
        F.when(lossless, 100.0).when(done, F.col("score")).alias("score"), F.when(lossless, 100.0).when(done, F.col("worst")).alias("worst"),
        F.when(done, F.when(lossless, F.col("decoded_width")).otherwise(F.col("out_width"))).alias("width"),
        F.when(done, F.when(lossless, F.col("decoded_height")).otherwise(F.col("out_height"))).alias("height"),
        lossless.alias("lossless"), F.lit(False).alias("converted"), "preview", output.alias("output"),
    )


def read_photos(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(listing of the photos below the paths in batch order, their path and content); files that can't be read are only in the listing."""
    listing = list_photos(spark, paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    loaded = files.load([f"file://{p}" for p in paths]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return listing, loaded.join(listing.select("path"), "path", "left_semi")


def with_unread(listing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row for every listed photo, in batch order (``idx``); those without an outcome couldn't be read and have 0 bytes."""
    missing = F.col("status").isNull()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("original_bytes", "output_bytes")}
    rows = listing.select("path", "root", "ordinal").join(outcomes, "path", "left").withColumns({"error": F.when(missing, "can't be read").otherwise(F.col("error")), **zero})
    return rows.withColumn("status", F.coalesce("status", F.lit("failed")))


class Gate:
    """One batch at a time: what comes meanwhile waits and goes on as one batch; a batch can be asked to stop."""

    def __init__(self):
        self._lock, self._busy, self._waiting, self._stop = threading.Lock(), False, [], False

    def enter(self, paths: list[str]) -> list[str] | None:
        """The paths, if nothing runs; else None, and they wait."""
        with self._lock:
            if self._busy:
                self._waiting += [p for p in paths if p not in self._waiting]
                return None
            self._busy, self._stop = True, False
            return paths

    def leave(self) -> list[str]:
        """Ends the batch; what has waited is the next one, which runs already if there is any."""
        with self._lock:
            waiting, self._waiting = self._waiting, []
            self._busy, self._stop = bool(waiting), False
            return waiting

    def cancel(self) -> None:
        with self._lock:
            self._stop = self._busy

    @property
    def cancelled(self) -> bool:
        return self._stop


def run(spark: SparkSession, paths: list[str], options: Options, on_event: Callable[[dict], None], gate: Gate | None = None, at_once: int = 256, finish: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """Runs a batch in slices of ``at_once`` photos and tells of its start, of every file and of its end.

    finish: what is done with a slice's outcomes (with ``root`` and ``ordinal``); it returns them without their bytes.
    The quality of one slice's photos is where the search of the next begins.  After a cancellation no
    further slice starts; its photos leave no row.
    """
    listing, photos = read_photos(spark, paths)
    names = [r.path for r in listing.select("path", "ordinal").orderBy("ordinal").toLocalIterator()]
    on_event({"kind": "started", "total": len(names)})
    rows: list[dict] = []
    for first in range(0, len(names), at_once):
        if gate and gate.cancelled:
            break
        part = spark.createDataFrame([(p,) for p in names[first : first + at_once]], "path string")
        sliced = listing.join(part, "path", "left_semi")
        outcomes = optimize(photos.join(part, "path", "left_semi"), options)
        if finish:
            outcomes = finish(outcomes.join(sliced.select("path", "root", "ordinal"), "path")).drop("root", "ordinal")
        found = with_unread(sliced, outcomes.drop("output", "preview")).orderBy("ordinal").collect()
        for row in found:
            rows.append(row.asDict() | {"idx": len(rows)})
            on_event({"kind": "file", **rows[-1]})
        qualities = sorted(r.quality for r in found if r.quality is not None and not r.lossless)
        if qualities and options.mode is None:
            options = replace(options, quality_hint=int(qualities[len(qualities) // 2]))
    on_event({"kind": "finished", "processed": len(rows), "cancelled": bool(gate and gate.cancelled)})
    return rows
