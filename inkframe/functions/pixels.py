"""Pixel maths on rasters as arrays, and on exploded ones: one row per pixel with columns x, y and g."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 4 x 4 ordered-dither matrix, row by row.
BAYER = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]


def gray_of(e: Column) -> Column:
    """-1..1 to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5).cast("int")))


def pixels(rasters: DataFrame, id_col: str = "vec_id", value_col: str = "embedding", width: int = 8) -> DataFrame:
    """(id, x, y, g) of flat rasters of a given width."""
    return rasters.select(id_col, F.posexplode(value_col).alias("i", "e")).select(id_col, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), gray_of(F.col("e")).alias("g"))


def stretched(rasters: DataFrame, level: int, id_col: str = "vec_id", value_col: str = "embedding", width: int = 8) -> DataFrame:
    """(id, x, y, g, black, white): pixels with the points of their raster's contrast, in one pass without a shuffle.

    The points are made before the values are exploded, once a raster."""
    black, white = contrast_points(grays_of(F.col(value_col)), level)
    cells = rasters.select(id_col, value_col, black.alias("black"), white.alias("white")).select(id_col, "black", "white", F.posexplode(value_col).alias("i", "e"))
    return cells.select(id_col, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), gray_of(F.col("e")).alias("g"), "black", "white")


def quantize(g: Column, two_bit: bool = False) -> Column:
    if two_bit:
        return F.when(g < 42, 0).when(g < 127, 85).when(g < 212, 170).otherwise(255)
    return F.when(g < 128, 0).otherwise(255)


def code2(g: Column) -> Column:
    return F.when(g >= 212, 0).when(g >= 127, 1).when(g >= 42, 2).otherwise(3)


def ordered(g: Column, x: Column, y: Column) -> Column:
    matrix = F.array(*[F.lit(v * 16) for v in BAYER])
    return F.when(g > F.get(matrix, (y % 4) * 4 + x % 4), 255).otherwise(0)


def gamma(g: Column, power: float) -> Column:
    return F.floor(F.pow(g / 255.0, F.lit(power)) * 255 + 0.5).cast("int")


def grays_of(values: Column) -> Column:
    """The grays of a flat raster, as an array."""
    return F.transform(values, gray_of)


def contrast_points(grays: Column, level: int) -> tuple[Column, Column]:
    """(black, white): grays at which the counts from below and above pass their cut-offs; else 0 and 255.

    The first gray that has enough others at or below it is a place of the sorted grays, so a raster's row is enough: no
    histogram, no shuffle. Null and empty rasters give 0 and 255."""
    ranked, n = F.sort_array(grays), F.size(grays)
    dark, light = F.ceil(n * (3 * level) / 100), F.ceil(n * (3 + 9 * level) / 100)
    black = F.get(ranked, (F.greatest(dark, F.lit(1)) - 1).cast("int"))
    white = F.get(ranked, (n - F.greatest(light, F.lit(1))).cast("int"))
    return F.coalesce(black, F.lit(0)), F.coalesce(white, F.lit(255))


def stretch(g: Column, black: Column, white: Column) -> Column:
    """Contrast between two grays, truncated and clamped; unchanged if they don't leave a range."""
    v = ((g - black) * 255 / (white - black)).cast("int")
    return F.when(white > black, F.greatest(F.lit(0), F.least(F.lit(255), v))).otherwise(g)


@lru_cache(maxsize=8)
def curve(width: int, height: int) -> np.ndarray:
    """(n, 2) places x, y of a raster in the order of the curve over the enclosing power-of-two square."""
    n = 1
    while n < max(width, height):
        n *= 2
    # grow the curve: a square's four quarters are the half-size curve, turned for the first and last
    order, s = np.zeros((1, 2), np.int32), 1
    while s < n:
        turned = order[:, ::-1]
        order = np.concatenate([turned, order + np.array([0, s], np.int32), order + np.array([s, s], np.int32), np.array([2 * s - 1, s - 1], np.int32) - turned])
        s *= 2
    return order[(order[:, 0] < width) & (order[:, 1] < height)]


def hilbert(width: int, height: int) -> list[tuple[int, int]]:
    """The same places as a list."""
    return [(x, y) for x, y in curve(width, height).tolist()]


def float_luma(r: Column, g: Column, b: Column) -> Column:
    """Gray of exact weights, rounded half to even."""
    return F.bround(r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114), 0).cast("int")


def contrast_alone(g: Column, black: Column, white: Column) -> Column:
    """Contrast between two grays, clamped and rounded half to even; unchanged if they don't leave a range."""
    v = (g - black) / F.nullif(white - black, F.lit(0)) * 255
    return F.when(white > black, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)), 0).cast("int")).otherwise(g)
