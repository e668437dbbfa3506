"""Red relief: slope, openness and their colour composite."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PIXEL, Raster, clamp, ratio
from . import stencil
from .rasters import _finite, _percentiles, percentile_bounds


@dataclass(frozen=True)
class Settings:
    """How far and in how many directions openness looks, and how the composite is coloured."""

    distance: int = 16
    directions: int = 8
    slope_clip: tuple[float, float] = (2.0, 98.0)
    structure_clip: tuple[float, float] = (2.0, 98.0)
    pixel: tuple[float, float] = (1.0, 1.0)
    z: float = 1.0
    red: float = 1.0

    def checked(self) -> Settings:
        if self.directions < 1 or self.distance < 1:
            raise ValueError(f"directions and distance are at least 1: {self.directions}, {self.distance}")
        if min(self.pixel) <= 0 or self.z <= 0 or self.red < 0:
            raise ValueError(f"pixel sizes and z are positive, red is not negative: {self.pixel}, {self.z}, {self.red}")
        clips = {}
        for name in ("slope_clip", "structure_clip"):
            try:
                clips[name] = percentile_bounds(*getattr(self, name), strict=False)
            except ValueError as error:
                raise ValueError(f"{name}: {error}") from error
        return replace(self, **clips)


@lru_cache(maxsize=64)
def rays(directions: int, distance: int, pixel: tuple[float, float] = (1.0, 1.0)) -> tuple[tuple[int, int, int, float], ...]:
    """(ray, dy, dx, length) of each distinct step; steps are rounded half to even."""
    out = []
    for ray in range(directions):
        angle = 2.0 * math.pi * ray / directions
        steps = np.arange(1, distance + 1)
        places = dict.fromkeys(zip(np.rint(np.sin(angle) * steps).astype(int).tolist(), np.rint(np.cos(angle) * steps).astype(int).tolist(), strict=True))
        out += [(ray, dy, dx, math.hypot(dx * pixel[0], dy * pixel[1])) for dy, dx in places if (dy, dx) != (0, 0)]
    return tuple(out)


def slope(raster: Raster, settings: Settings = Settings()) -> Raster:  # noqa: B008
    """The gradient's length, missing values as zero; NULL at those and beside them."""
    start = raster.df.select(*PIXEL, _finite(raster.single).isNull().alias("gone"), F.coalesce(_finite(raster.single) * settings.z, F.lit(0.0)).alias("v"))
    dx = stencil.difference(F.col("v"), "x", raster.size, settings.pixel[0], flat=True)
    dy = stencil.difference(F.col("v"), "y", raster.size, settings.pixel[1], flat=True)
    beside = stencil.any_neighbour(F.col("gone"), "x") | stencil.any_neighbour(F.col("gone"), "y")
    both = start.select(*PIXEL, dx.alias("dx"), dy.alias("dy"), beside.alias("beside"))
    return Raster(both.select(*PIXEL, F.when(~F.col("beside"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("v")), raster.size)


#: A block's pixels along each axis, unless the rays are longer.
BLOCK = 256


def openness(height: np.ndarray, steps: tuple[tuple[int, int, int, float], ...], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative openness of what a border of ``reach`` pixels surrounds; NaN is missing.  A ray's pixels are those that its steps lead from."""
    rows, columns = height.shape[0] - 2 * reach, height.shape[1] - 2 * reach
    here = height[reach : reach + rows, reach : reach + columns]
    sums, counts = np.zeros((2, rows, columns)), np.zeros((rows, columns))
    for ray in dict.fromkeys(step[0] for step in steps):
        up, down = np.full((2, rows, columns), np.nan)
        for _, dy, dx, far in (step for step in steps if step[0] == ray):
            rise = (height[reach - dy : reach - dy + rows, reach - dx : reach - dx + columns] - here) / far
            np.fmax(up, rise, out=up)
            np.fmin(down, rise, out=down)
        seen = ~np.isnan(up)
        counts += seen
        sums += np.where(seen, np.stack([90.0 - np.degrees(np.arctan(up)), 90.0 + np.degrees(np.arctan(down))]), 0.0)
    mean = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
    return mean[0], mean[1]


def pack(raster: Raster, settings: Settings = Settings()) -> Raster:  # noqa: B008
    """Positive and negative openness in degrees, and half their difference, ``structure``.

    Per ray the steepest rise and fall count, and rays are averaged.  Pixels meet in square
    blocks with a border as wide as the rays are long: one shuffle of about as many rows as
    there are pixels, and tasks whose size doesn't depend on the tile's.
    """
    steps = rays(settings.directions, settings.distance, settings.pixel)
    size, reach = raster.size, max(1, settings.distance)
    side = max(BLOCK, reach)
    start = raster.df.select(*PIXEL, (_finite(raster.single) * settings.z).alias("v"))

    def blocks(axis: str, n: int) -> Column:
        first, last = (F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(axis) + d)) / side).cast("int") for d in (-reach, reach))
        return F.explode(F.sequence(first, last))

    dealt = start.select("*", blocks("y", size.height).alias("by")).select("*", blocks("x", size.width).alias("bx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["by"].iloc[0]) * side, int(pdf["bx"].iloc[0]) * side
        y, x = pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left
        rows, columns = min(side, size.height - top), min(side, size.width - left)
        height = np.full((rows + 2 * reach, columns + 2 * reach), np.nan)
        height[y + reach, x + reach] = pdf["v"].to_numpy(dtype=float)
        positive, negative = openness(height, steps, reach)
        own = (y >= 0) & (y < rows) & (x >= 0) & (x < columns)
        y, x = y[own], x[own]
        return pdf.loc[own, list(PIXEL)].assign(positive=positive[y, x], negative=negative[y, x])

    schema = start.select(*PIXEL).schema.add("positive", "double").add("negative", "double")
    made = dealt.groupBy("tile_id", "by", "bx").applyInPandas(run, schema)
    known = [F.when(~F.isnan(c), F.col(c)) for c in ("positive", "negative")]
    return Raster(made.select(*PIXEL, known[0].alias("positive"), known[1].alias("negative"), (0.5 * (known[0] - known[1])).alias("structure")), size, ("positive", "negative", "structure"))


def robust(raster: Raster, low: float, high: float, fill: float) -> Raster:
    """From percentile to percentile as 0 to 1, clipped; ``fill`` where they don't ascend; NULL where missing."""
    low, high = percentile_bounds(low, high, strict=False)
    value = _finite(raster.single)
    df = raster.df.join(_percentiles(raster, low, high, finite_only=True), "tile_id", "left")
    span = F.col("p_high") - F.col("p_low")
    scaled = F.when(span > 0, clamp(ratio(value - F.col("p_low"), span), 0.0, 1.0)).otherwise(fill)
    return Raster(df.select(*PIXEL, F.when(value.isNotNull(), scaled).alias("v")), raster.size)


def compose(slope_raster: Raster, structure: Raster, settings: Settings = Settings()) -> Raster:  # noqa: B008
    """Structure as grey, slope as red on top; bands r, g, b."""
    grey = robust(structure, *settings.structure_clip, 0.5).df.withColumnRenamed("v", "grey")
    steep = robust(slope_raster, *settings.slope_clip, 0.0).df.withColumnRenamed("v", "steep")
    both = grey.join(steep, list(PIXEL))
    g, s = F.col("grey"), F.coalesce("steep", F.lit(0.0))
    red: Column = clamp(g + settings.red * s * (1.0 - g), 0.0, 1.0)
    return Raster(both.select(*PIXEL, red.alias("r"), g.alias("g"), g.alias("b")), structure.size, ("r", "g", "b"))


@dataclass(frozen=True)
class Relief:
    slope: Raster
    positive: Raster
    negative: Raster
    structure: Raster
    rgb: Raster


def relief(raster: Raster, settings: Settings = Settings()) -> Relief:  # noqa: B008
    """All products of one raster of one band."""
    settings = settings.checked()
    raster.single  # noqa: B018
    packed = pack(raster, settings)
    parts = {b: packed.select({"v": F.col(b)}) for b in packed.bands}
    steep = slope(raster, settings)
    return Relief(steep, **parts, rgb=compose(steep, parts["structure"], settings))
