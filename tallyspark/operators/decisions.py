"""What to do with a photo, as ordered CASE expressions over columns of its header and candidate sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 120_000_000
#: Source quality below which only lossless recoding is tried; size shares in percent.
COMPRESSED_BELOW, MIN_GAIN, MARGINAL_GAIN, LOSSLESS_GAIN, LOSSLESS_PREFERENCE = 90, 3, 10, 1, 103
MODES = ["long_edge", "max_width", "max_height"]


def jpeg_precheck(max_pixels: int = MAX_PIXELS) -> Column:
    """First reason to skip a JPEG, null if there is none; needs kind, bits, components, width, height, embedded."""
    return (
        F.when((F.col("kind") == "exotic") | (F.col("bits") != 8), "exoticJpeg")
        .when(F.col("components") == 4, "cmyk")
        .when(F.col("width").cast("long") * F.col("height").cast("long") > max_pixels, "tooLarge")
        .when(F.col("embedded"), "embeddedMedia")
    )


def heic_precheck(enabled: Column) -> Column:
    """First reason to skip a HEIC photo; needs sequence, stereo, hdr."""
    return F.when(~enabled, "conversionOff").when(F.col("sequence"), "unsupported").when(F.col("stereo"), "spatialPhoto").when(F.col("hdr"), "hdrPhoto")


def requantizable(adobe_transform: Column, components: Column) -> Column:
    """False for three components that an Adobe marker declares untransformed."""
    return ~(F.coalesce(adobe_transform == 0, F.lit(False)) & (components == 3))


def is_transposed(orientation: Column) -> Column:
    return orientation.between(5, 8)


def target_size(width: Column, height: Column, orientation: Column, mode: Column, pixels: Column) -> tuple[Column, Column]:
    """Stored width and height after fitting the displayed photo into a size; null where it fits already."""
    turned = is_transposed(orientation)
    shown_w, shown_h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    edge = F.when(mode == "long_edge", F.greatest(shown_w, shown_h)).when(mode == "max_width", shown_w).otherwise(shown_h)
    scale = pixels.cast("double") / edge.cast("double")
    fits = pixels.isNull() | (pixels == 0) | (scale >= 1)
    side = lambda x: F.when(~fits, F.greatest(F.floor(x * scale + 0.5).cast("long"), F.lit(1)))
    return side(width), side(height)


def chroma_block(luma_factor: Column, chroma_factor: Column) -> Column:
    return F.least(F.greatest(F.floor(luma_factor / chroma_factor), F.lit(1)), F.lit(4))


def size_matrix(photos: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every photo in every size; there are four sizes at most, so they are sent to all executors."""
    w, h = target_size(F.col("width"), F.col("height"), F.col("orientation"), F.col("mode"), F.col("pixels"))
    return photos.crossJoin(F.broadcast(sizes.limit(4))).select("id", "size_no", "label", w.alias("target_width"), h.alias("target_height"))


def _gain_at_least(size: Column, original: Column, percent: int) -> Column:
    return (original - size) * 100 >= original * percent


def render_decision(skip_optimized: bool = True) -> Column:
    """perceptual, lossless, noGain or alreadyOptimized for an unresized JPEG; sizes may be null where there is no candidate."""
    o, p, s = F.col("original_bytes"), F.col("perceptual_bytes"), F.col("lossless_bytes")
    lossless = F.coalesce(_gain_at_least(s, o, LOSSLESS_GAIN), F.lit(False))
    perceptual = F.coalesce(_gain_at_least(p, o, MIN_GAIN), F.lit(False))
    return (
        F.when(F.col("has_marker") & F.lit(skip_optimized), "alreadyOptimized")
        .when(F.coalesce(F.col("quality_estimate") < COMPRESSED_BELOW, F.lit(False)), F.when(lossless, "lossless").otherwise("noGain"))
        .when(F.coalesce(_gain_at_least(p, o, MARGINAL_GAIN), F.lit(False)), "perceptual")
        .when(perceptual & lossless & (s * 100 <= p * LOSSLESS_PREFERENCE), "lossless")
        .when(perceptual, "perceptual")
        .when(lossless, "lossless")
        .otherwise("noGain")
    )


def ceiling_targets(strengths: DataFrame, best: DataFrame) -> DataFrame:
    """Targets for sources that are not JPEGs: the best reachable scores less the strength's margins, never above its own targets."""
    return best.join(F.broadcast(strengths), "strength").select(
        *best.columns,
        F.least("target_global", F.col("best_global") - F.col("margin_global")).alias("ceiling_global"),
        F.least("target_worst", F.col("best_worst") - F.col("margin_worst")).alias("ceiling_worst"),
    )


def gated_slack(tiles: Column, whole: Column) -> Column:
    """Slack of a candidate: that of its watched tiles alone if they fail already, else the smaller of both."""
    return F.when(tiles < 0, tiles).otherwise(F.least(tiles, whole))
