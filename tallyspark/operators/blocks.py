"""Array analytics on 8x8 coefficient blocks and image tiles, as array and row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The standard luma quantisation table (ITU-T T.81, Annex K), row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]

#: Tile sides, and the shortest rest that is a tile of its own.
MIN_TILE, MAX_TILE, MIN_EDGE = 256, 768, 96
#: Share and least number of watched tiles.
WATCH_SHARE, WATCH_MIN = 6, 8


def zigzag() -> list[int]:
    """Natural position of each coefficient in zig-zag order: along diagonals, turning at the borders."""
    order = []
    for d in range(15):
        diagonal = [(d - x, x) for x in range(8) if 0 <= d - x < 8]
        order += [8 * y + x for y, x in (reversed(diagonal) if d % 2 else diagonal)]
    return order


def luma() -> Column:
    return F.array(*[F.lit(x) for x in LUMA])


def scaled_table(quality: Column, base: Column | None = None) -> Column:
    """The table for a quality of 1 to 100."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality).cast("int")
    return F.transform(luma() if base is None else base, lambda q: F.least(F.greatest(F.floor((q * scale + 50) / 100).cast("int"), F.lit(1)), F.lit(255)))


def estimate_quality(table: Column) -> Column:
    """Quality from the upper median of the 64 ratios to the standard table."""
    ratios = F.zip_with(table, luma(), lambda q, s: F.greatest(q, F.lit(1)) * F.lit(100.0) / s)
    scale = F.get(F.sort_array(ratios), F.lit(32))
    quality = F.when(scale <= 100, (200 - scale) / 2).otherwise(5000 / scale)
    return F.least(F.greatest(F.floor(quality + 0.5).cast("int"), F.lit(1)), F.lit(100))


def merge_steps(target: Column, source: Column) -> Column:
    """Steps to quantise with: never finer than the source's."""
    return F.zip_with(target, source, lambda t, s: F.least(F.greatest(t, s, F.lit(1)), F.lit(255)))


def requantize(coefficients: Column, source: Column, merged: Column) -> Column:
    """Integer coefficients in new steps, rounded half away from zero."""
    pairs = F.zip_with(source, merged, lambda s, m: F.struct(s.alias("s"), m.alias("m")))

    def step(c: Column, p: Column) -> Column:
        size = F.floor((F.abs(c) * p["s"] * 2 + p["m"]) / (p["m"] * 2)).cast("int")
        return F.when(c < 0, -size).otherwise(size)

    return F.zip_with(coefficients, pairs, step)


def slot_steps(components: DataFrame, *keys: str) -> DataFrame:
    """The steps of each table slot: those of the first component that uses it."""
    return components.groupBy(*keys, "slot").agg(F.min_by("steps", "component").alias("steps"))


def spans(length: Column, side: Column) -> Column:
    """Array of (start, size) that covers 0..length; a rest shorter than MIN_EDGE joins the last one."""
    whole = F.floor(length / side).cast("int")
    n = F.greatest(whole + F.when(length % side >= MIN_EDGE, 1).otherwise(0), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * side).alias("start"), F.when(i == n - 1, length - i * side).otherwise(side).alias("size")))
    return F.when(length > 0, cut)


def tile_grid(photos: DataFrame, key: str = "id") -> DataFrame:
    """One row per tile, numbered row by row: x, y, w, h."""
    side = F.least(F.greatest(F.floor(F.greatest("width", "height") / 6), F.lit(MIN_TILE)), F.lit(MAX_TILE)).cast("long")
    sized = photos.select(key, "width", "height", side.alias("side"))
    rows = sized.select(key, "width", "side", F.posexplode(spans(F.col("height"), F.col("side"))).alias("row", "v"))
    cells = rows.select(key, "row", "v", F.posexplode(spans(F.col("width"), F.col("side"))).alias("col", "u"), F.size(spans(F.col("width"), F.col("side"))).alias("cols"))
    return cells.select(key, (F.col("row") * F.col("cols") + F.col("col")).cast("long").alias("tile"), F.col("u.start").alias("x"), F.col("v.start").alias("y"), F.col("u.size").alias("w"), F.col("v.size").alias("h"))


def tile_summary(tiles: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """Area-weighted mean (0 without tiles) and minimum of integer scores; the mean in hundredths, rounded down."""
    area = F.greatest(F.col("w") * F.col("h"), F.lit(1))
    sums = tiles.groupBy(key).agg(F.sum(F.col(score) * area).alias("weighted"), F.sum(area).alias("area"), F.min(score).alias("worst"), F.count("*").alias("tiles"))
    return sums.select(key, F.expr("weighted * 100 div greatest(area, 1)").alias("mean_hundredths"), "worst", "tiles")


def watch_list(tiles: DataFrame, key: str = "id") -> DataFrame:
    """The hardest sixth of each photo's tiles, at least WATCH_MIN; ties keep the lower number."""
    order, whole = Window.partitionBy(key).orderBy(F.desc("difficulty"), "tile"), Window.partitionBy(key)
    ranked = tiles.withColumns({"rank": F.row_number().over(order).cast("long"), "n": F.count("*").over(whole)})
    return ranked.filter(F.col("rank") <= F.greatest(F.floor(F.col("n") / WATCH_SHARE), F.lit(WATCH_MIN))).drop("n")


def tile_difficulty(errors: DataFrame, key: str = "id") -> DataFrame:
    """Mean error of each tile, in hundredths rounded down, from pixel rows (key, width, height, x, y, error): partial sums, no row is joined to a tile."""
    side = F.least(F.greatest(F.floor(F.greatest("width", "height") / 6), F.lit(MIN_TILE)), F.lit(MAX_TILE))

    def place(at: str, length: str) -> Column:
        return F.least(F.floor(F.col(at) / side), F.size(spans(F.col(length), side)) - 1)

    columns = F.size(spans(F.col("width"), side))
    placed = errors.select(key, (place("y", "height") * columns + place("x", "width")).cast("long").alias("tile"), "error")
    return placed.groupBy(key, "tile").agg(F.sum("error").alias("total"), F.count("*").alias("pixels")).select(key, "tile", F.expr("total * 100 div pixels").alias("difficulty_hundredths"), "pixels")


def half_resolution(pixels: DataFrame, key: str = "id") -> DataFrame:
    """Means of 2 x 2 pixels from rows (key, x, y, v), rounded; of those that there are."""
    summed = pixels.groupBy(key, F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return summed.select(key, "x", "y", F.expr("(total * 4 div n + 2) div 4").alias("v"))


def upright(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Where a stored pixel is shown."""
    back_x, back_y = width - 1 - x, height - 1 - y
    shown_x = F.when(orientation.isin(2, 3), back_x).when(orientation.isin(5, 8), y).when(orientation.isin(6, 7), back_y).otherwise(x)
    shown_y = F.when(orientation.isin(3, 4), back_y).when(orientation.isin(5, 6), x).when(orientation.isin(7, 8), back_x).otherwise(y)
    return shown_x, shown_y


def as_rgb(gray: Column) -> Column:
    """Interleaved channels of an array of gray values."""
    return F.flatten(F.transform(gray, lambda v: F.array(v, v, v)))


def half_res(pixels, width: int, height: int, channels: int):
    """2x2 box average of interleaved bytes, rounded; an odd last row or column is dropped."""
    import numpy as np

    image = np.asarray(pixels, np.uint16).reshape(height, width, channels)[: height // 2 * 2, : width // 2 * 2]
    total = image[0::2, 0::2] + image[0::2, 1::2] + image[1::2, 0::2] + image[1::2, 1::2]
    return ((total + 2) // 4).astype(np.uint8)


def orient(image, orientation: int):
    """An image array turned and mirrored as its EXIF orientation says."""
    import numpy as np

    turns = {1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: lambda a: np.swapaxes(a, 0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(np.swapaxes(a, 0, 1), 2), 8: np.rot90}
    return turns.get(orientation, turns[1])(np.asarray(image))
