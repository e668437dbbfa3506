"""Raster to raster: derivatives, relief, normalisation, arithmetic, multi-scale gradients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL, Raster, Resolution, clamp, join_all, log10, ratio, root, total
from . import stencil

LEAST_WEIGHT = 1e-5


def percentile_bounds(low: float, high: float, strict: bool) -> tuple[float, float]:
    """Two percentages in order; equal ones only if not ``strict``."""
    low, high = float(low), float(high)
    if not (0 <= low <= 100 and 0 <= high <= 100) or low > high or (strict and low == high):
        raise ValueError(f"percentiles must be between 0 and 100 and ascend{' strictly' if strict else ''}: {low}, {high}")
    return low, high


def gradient(raster: Raster, axis: str, spacing: float = 100.0) -> Raster:
    """Every band's derivative along an axis; the pixels are ``spacing`` apart."""
    if spacing <= 0:
        raise ValueError(f"the spacing is positive, not {spacing}")
    return raster.map(lambda v: stencil.difference(v, axis, raster.size, spacing))


def sobel(raster: Raster, axis: str) -> Raster:
    """The Sobel derivative of one band, NULL on the border and beside NULL."""
    first, across = stencil.sobel(F.col(raster.single), axis)
    step = raster.select({"v": first})
    return step.select({"v": stencil.smooth121(F.col("v"), across)})


def _percentiles(raster: Raster, low: float, high: float, finite_only: bool = False) -> DataFrame:
    """Each tile's two percentiles over all bands together, one row a tile."""
    values = raster.df.select("tile_id", F.explode(F.array(*raster.bands)).alias("p"))
    if finite_only:
        values = values.where(F.abs("p") < float("inf"))
    return values.groupBy("tile_id").agg(F.percentile("p", low / 100).alias("p_low"), F.percentile("p", high / 100).alias("p_high"))


def normalized(raster: Raster, low: float = 0.0, high: float = 100.0) -> Raster:
    """From percentile to percentile as 0 to 1, clipped; a flat raster is clipped only."""
    low, high = percentile_bounds(low, high, strict=True)
    df = raster.df.join(_percentiles(raster, low, high), "tile_id")
    span = F.col("p_high") - F.col("p_low")
    scaled = {b: clamp(F.when(span != 0, ratio(F.col(b) - F.col("p_low"), span)).otherwise(F.col(b)), 0.0, 1.0) for b in raster.bands}
    return Raster(df.select(*PIXEL, *[c.alias(b) for b, c in scaled.items()]), raster.size, raster.bands)


def clip(raster: Raster, low: float, high: float) -> Raster:
    """Clamped to two percentiles of the finite values; a tile without any is unchanged."""
    low, high = percentile_bounds(low, high, strict=False)
    df = raster.df.join(_percentiles(raster, low, high, finite_only=True), "tile_id", "left")
    return Raster(df.select(*PIXEL, *[clamp(F.col(b), F.col("p_low"), F.col("p_high")).alias(b) for b in raster.bands]), raster.size, raster.bands)


def logarithm(raster: Raster) -> Raster:
    return raster.map(log10)


def square(raster: Raster) -> Raster:
    return raster.map(lambda v: v * v)


def square_root(raster: Raster) -> Raster:
    return raster.map(root)


def hillshade(raster: Raster, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0) -> Raster:
    """Illumination from an azimuth and altitude in degrees, rows counting as they are stored; not clipped."""
    value = F.col(raster.single) * z
    down, right = (stencil.difference(value, a, raster.size) for a in "yx")
    flat = raster.select({"down": down, "right": right})
    d, r = F.col("down"), F.col("right")
    slope = math.pi / 2 - F.atan(F.sqrt(d * d + r * r))
    aspect = F.atan2(-d, r)
    az, alt = math.radians(azimuth), math.radians(altitude)
    return flat.select({"v": math.sin(alt) * F.sin(slope) + math.cos(alt) * F.cos(slope) * F.cos(az - aspect)})


def _combine(rasters: Sequence[Raster], f) -> Raster:
    """Band by band over the same pixels; a single band serves for each band of the others."""
    if len(rasters) < 2:
        raise ValueError("at least two rasters are combined")
    widths = {len(r.bands) for r in rasters} - {1}
    if len(widths) > 1 or len({r.size for r in rasters}) > 1:
        raise ValueError("rasters of different sizes or numbers of bands")
    bands = next((r.bands for r in rasters if len(r.bands) > 1), ("v",))
    frames = [r.df.select(*PIXEL, *[F.col(b).alias(f"i{k}_{j}") for j, b in enumerate(r.bands)]) for k, r in enumerate(rasters)]
    joined = join_all(frames)
    column = lambda k, j: F.col(f"i{k}_{j if len(rasters[k].bands) > 1 else 0}")
    out = [f([column(k, j) for k in range(len(rasters))]).alias(b) for j, b in enumerate(bands)]
    return Raster(joined.select(*PIXEL, *out), rasters[0].size, bands)


def average(rasters: Sequence[Raster]) -> Raster:
    """Means; NULL where any is."""
    return _combine(rasters, lambda c: total(c) / len(c))


def add(rasters: Sequence[Raster]) -> Raster:
    return _combine(rasters, total)


def norm(rasters: Sequence[Raster]) -> Raster:
    """Euclidean norms; NULL where any is."""
    return _combine(rasters, lambda c: F.sqrt(total([v * v for v in c])))


def _magnitude(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _component(df: DataFrame, size: Resolution, axis: str | None) -> Column:
    """A gradient's part along an axis, or its length."""
    if axis is not None:
        return stencil.difference(F.col("v"), axis, size)
    return _magnitude(stencil.difference(F.col("v"), "x", size), stencil.difference(F.col("v"), "y", size))


def _fuse(layers: list[DataFrame], how: str, size: Resolution) -> Raster:
    """Layers ``v`` of the same pixels into one, skipping NULL; a sum of nothing is zero."""
    stacked = layers[0]
    for layer in layers[1:]:
        stacked = stacked.unionByName(layer)
    value = {"max": F.max("v"), "mean": F.avg("v"), "sum": F.coalesce(F.sum("v"), F.lit(0.0))}[how]
    return Raster(stacked.groupBy(*PIXEL).agg(value.alias("v")), size)


def _scales(sigmas: Sequence[float], axis: str | None, fuse: str) -> list[float]:
    if not sigmas or min(sigmas) <= 0:
        raise ValueError(f"scales are positive, not {list(sigmas)}")
    if axis not in (None, "x", "y"):
        raise ValueError(f"the axis is x or y, not {axis!r}")
    if fuse not in ("max", "mean", "sum"):
        raise ValueError(f"fusion is max, mean or sum, not {fuse!r}")
    return [float(s) for s in sigmas]


def multigrad(raster: Raster, sigmas: Sequence[float], axis: str | None = None, fuse: str = "max", scaled: bool = True) -> Raster:
    """Gradients of Gaussian means at several scales, each times its scale if ``scaled``, fused pixel by pixel."""
    sigmas = _scales(sigmas, axis, fuse)
    start = raster.select({"v": F.col(raster.single)})
    start = start.df.select(*PIXEL, _finite("v").alias("v"))
    layers = []
    for sigma in sigmas:
        soft = stencil.smooth(start, "v", sigma, raster.size, LEAST_WEIGHT).select(*PIXEL, F.coalesce("v", F.lit(0.0)).alias("v"), "weight")
        part = _component(soft, raster.size, axis) * (sigma if scaled else 1.0)
        layers.append(soft.select(*PIXEL, F.when(F.col("weight") > LEAST_WEIGHT, part).alias("v")))
    return _fuse(layers, fuse, raster.size)


def _finite(c: str) -> Column:
    return F.when(F.abs(c) < float("inf"), F.col(c))


def occlusion_mask(raster: Raster, threshold: float = 1.0, sigma: float = 0.0, dilate: int = 1) -> DataFrame:
    """``v`` and ``hidden``: where the gradient of the raster, NULL as zero, reaches the threshold, grown by ``dilate`` pixels, and where ``v`` is missing."""
    if threshold < 0 or sigma < 0 or dilate < 0:
        raise ValueError("threshold, sigma and dilation are not negative")
    kept = raster.df.select(*PIXEL, _finite(raster.single).alias("kept"), F.coalesce(_finite(raster.single), F.lit(0.0)).alias("v"))
    edges = kept.select(*PIXEL, "kept", _component(kept, raster.size, None).alias("edge"))
    if sigma > 0:
        soft = stencil.smooth(edges, "edge", sigma, raster.size, 0.0).drop("weight")
        edges = edges.drop("edge").join(soft, list(PIXEL))
    grown = edges.select(*PIXEL, "kept", (F.col("edge") >= threshold).alias("hidden"))
    for _ in range(dilate):  # a square of side 2 * dilate + 1, an axis at a time
        grown = grown.select(*PIXEL, "kept", stencil.any_neighbour(F.col("hidden"), "x").alias("hidden"))
        grown = grown.select(*PIXEL, "kept", stencil.any_neighbour(F.col("hidden"), "y").alias("hidden"))
    return grown.select(*PIXEL, F.col("kept").alias("v"), (F.col("hidden") | F.col("kept").isNull()).alias("hidden"))


def multigradocc(
    raster: Raster, sigmas: Sequence[float], axis: str | None = None, fuse: str = "max", scaled: bool = True, threshold: float = 1.0,
    edge_sigma: float = 0.0, dilate: int = 1, soft: float | None = None, with_mask: bool = False,
) -> Raster:
    """``multigrad`` with edges of occlusion left out of the means; there gradients are NULL, or weighted by ``soft``.

    ``with_mask`` adds the mask as a second band, ``mask``.
    """
    sigmas = _scales(sigmas, axis, fuse)
    if soft is not None and not 0 <= soft <= 1:
        raise ValueError(f"the soft weight is between 0 and 1, not {soft}")
    masked = occlusion_mask(raster, threshold, edge_sigma, dilate)
    seen = masked.select(*PIXEL, F.when(~F.col("hidden"), F.col("v")).alias("v"))
    hidden = masked.select(*PIXEL, "hidden")
    layers = []
    for sigma in sigmas:
        means = stencil.smooth(seen, "v", sigma, raster.size, LEAST_WEIGHT).select(*PIXEL, F.coalesce("v", F.lit(0.0)).alias("v"), "weight").join(hidden, list(PIXEL))
        part = _component(means, raster.size, axis) * (sigma if scaled else 1.0)
        gated = F.when(~F.col("hidden"), part) if soft is None else F.when(F.col("hidden"), part * soft).otherwise(part)
        layers.append(means.select(*PIXEL, F.when(F.col("weight") > LEAST_WEIGHT, gated).alias("v")))
    out = _fuse(layers, fuse, raster.size)
    if with_mask:
        return Raster(out.df.join(hidden.select(*PIXEL, F.col("hidden").cast("double").alias("mask")), list(PIXEL)), raster.size, ("v", "mask"))
    return out
