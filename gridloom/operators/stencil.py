"""Neighbourhoods on dense rasters: windows along an axis, and separable kernels by scattering.

Every window's partition holds ``tile_id``, so a tile's border is an image border, and
a row or a column, so that even one huge tile spreads over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIXEL, Raster, Resolution, ratio


def along(axis: str):
    """The window of a pixel's row (x) or column (y)."""
    return Window.partitionBy("tile_id", "y" if axis == "x" else "x").orderBy(axis)


def extent(axis: str, size: Resolution) -> int:
    return size.width if axis == "x" else size.height


def difference(value: Column, axis: str, size: Resolution, spacing: float = 1.0, flat: bool = False) -> Column:
    """Central differences, one-sided at the two borders.

    A middle value plays no part inside, so it may be NULL there.  An axis of one
    pixel has no gradient: an error, or zero if ``flat``.
    """
    n = extent(axis, size)
    if n < 2:
        if flat:
            return F.lit(0.0)
        raise ValueError(f"a gradient along {axis} needs at least two pixels")
    before, after, at = F.lag(value).over(along(axis)), F.lead(value).over(along(axis)), F.col(axis)
    return F.when(at == 0, (after - value) / spacing).when(at == n - 1, (value - before) / spacing).otherwise((after - before) / (2 * spacing))


def sobel(value: Column, axis: str) -> tuple[Column, str]:
    """The first pass of a Sobel filter along ``axis`` and the axis of its second, ``smooth121``; NULL where any of 3 x 3 is NULL or outside."""
    w = along(axis)
    return F.lead(value).over(w) - F.lag(value).over(w) + 0 * value, "y" if axis == "x" else "x"


def smooth121(value: Column, axis: str) -> Column:
    w = along(axis)
    return F.lag(value).over(w) + 2 * value + F.lead(value).over(w)


def any_neighbour(flag: Column, axis: str) -> Column:
    """Whether the flag holds at the pixel or one beside it along the axis; outside it doesn't."""
    w = along(axis)
    return flag | F.lag(flag, 1, False).over(w) | F.lead(flag, 1, False).over(w)


def gaussian_weights(sigma: float) -> list[float]:
    """Half of a normalised kernel of radius ``int(4 sigma + 0.5)``: the weights at distance 0, 1, ..."""
    radius = int(4.0 * sigma + 0.5)
    half = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)]
    whole = half[0] + 2 * sum(half[1:])
    return [w / whole for w in half]


def spread(df: DataFrame, columns: tuple[str, ...], axis: str, size: Resolution, weights: list[float]) -> DataFrame:
    """Each column's weighted sums along an axis, borders reflected (edge pixels repeated); NULL counts as nothing.

    A pixel sends its value to those in reach of it and of its mirror images, however
    often the kernel wraps; sums are combined before the one shuffle.
    """
    n, radius = extent(axis, size), len(weights) - 1
    turns = radius // (2 * n) + 1
    p = F.col(axis)
    images = F.array(*[image for k in range(-turns, turns + 1) for image in (p + 2 * n * k, 2 * n * k - 1 - p)])
    keys = [c for c in PIXEL if c != axis]
    far = df.select(*keys, *columns, F.explode(images).alias("q")).where((F.col("q") >= -radius) & (F.col("q") < n + radius))
    targets = F.sequence(F.greatest(F.lit(0), F.col("q") - radius), F.least(F.lit(n - 1), F.col("q") + radius))
    sent = far.select(*keys, *columns, "q", F.explode(targets).alias(axis))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.abs(F.col("q") - F.col(axis)) + 1)
    sums = sent.groupBy(*PIXEL).agg(*[F.sum(F.col(c) * weight).alias(c) for c in columns])
    return sums


def smooth(raster: DataFrame, value: str, sigma: float, size: Resolution, least: float = 1e-5) -> DataFrame:
    """Gaussian means over the values there are: ``value`` (NULL where their weight is ``least`` or below) and ``weight``."""
    weights = gaussian_weights(sigma)
    start = raster.select(*PIXEL, F.coalesce(value, F.lit(0.0)).alias("s"), F.col(value).isNotNull().cast("double").alias("m"))
    both = spread(spread(start, ("s", "m"), "y", size, weights), ("s", "m"), "x", size, weights)
    return both.select(*PIXEL, F.when(F.col("m") > least, ratio(F.col("s"), F.col("m"))).alias(value), F.col("m").alias("weight"))


def convolve(raster: Raster, kernel: list[list[float]]) -> DataFrame:
    """Per pixel the sums ``s`` of kernel times value and ``k`` of the kernel, over the values there are.

    A true convolution of the same size with nothing outside.  A pixel sends its value to
    all that its kernel reaches; sums are combined before the shuffle.
    """
    rows, columns = len(kernel), len(kernel[0])
    cy, cx = (rows - 1) // 2, (columns - 1) // 2
    cells = [(i - cy, j - cx, float(kernel[i][j])) for i in range(rows) for j in range(columns)]
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in cells])
    sent = raster.df.where(F.col(raster.single).isNotNull()).select("tile_id", "y", "x", F.col(raster.single).alias("value"), F.explode(table).alias("k"))
    moved = sent.select("tile_id", (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), (F.col("k.w") * F.col("value")).alias("s"), F.col("k.w").alias("k"))
    inside = moved.where((F.col("y") >= 0) & (F.col("y") < raster.size.height) & (F.col("x") >= 0) & (F.col("x") < raster.size.width))
    return inside.groupBy(*PIXEL).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
