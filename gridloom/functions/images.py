"""Rasters as images: filling, convolution, grey, eight bits, flow colours; and dip directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import stencil
from ..schema import PIXEL, Raster, clamp, ratio, total


def gaussian_kernel(side: int = 5, sigma: float = 1.0) -> list[list[float]]:
    """The normalised outer product of Gaussian samples at unit steps around the middle."""
    line = [math.exp(-0.5 * ((k - (side - 1) / 2) / sigma) ** 2) for k in range(side)]
    whole = sum(line) ** 2
    return [[a * b / whole for b in line] for a in line]


def nan_convolve(raster: Raster, kernel: list[list[float]], fill: str | float | None = None) -> Raster:
    """Means weighted by the kernel over the values there are; NULL where their weights sum to zero, then filled if asked."""
    sums = stencil.convolve(raster, kernel)
    joined = raster.df.select(*PIXEL).join(sums, list(PIXEL), "left")
    out = Raster(joined.select(*PIXEL, ratio(F.col("s"), F.col("k")).alias("v")), raster.size)
    return out if fill is None else replace_missing(out, fill)


def replace_missing(raster: Raster, policy: str | float = "max", seed: int | None = None) -> Raster:
    """NULL by each band's greatest or least value in its tile, a random one between, or a float; another type of number is refused."""
    if isinstance(policy, float):
        return raster.map(lambda v: F.coalesce(v, F.lit(policy)))
    if policy not in ("max", "min", "random"):
        raise ValueError(f"the policy is max, min, random or a float, not {policy!r}")
    stats = raster.df.groupBy("tile_id").agg(*[f(b).alias(f"{n}_{b}") for b in raster.bands for n, f in (("lo", F.min), ("hi", F.max))])
    wide = raster.df.join(stats, "tile_id")

    def fill(b: str) -> Column:
        if policy == "random":
            return F.col(f"lo_{b}") + (F.rand(seed) if seed is not None else F.rand()) * (F.col(f"hi_{b}") - F.col(f"lo_{b}"))
        return F.col(f"{'hi' if policy == 'max' else 'lo'}_{b}")

    return Raster(wide.select(*PIXEL, *[F.coalesce(F.col(b), fill(b)).alias(b) for b in raster.bands]), raster.size, raster.bands)


def to_gray(raster: Raster, full: float | None = None, policy: str = "keep", weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> Raster:
    """One band: weighted sums of the first three, or the one there is.  ``full``: what integers of the type reach, to divide by."""
    scaled = raster if full is None else raster.map(lambda v: v / float(full))
    if len(raster.bands) == 2:
        raise ValueError("grey needs one band or at least three")
    if len(raster.bands) == 1:
        gray = scaled.select({"v": F.col(scaled.single)})
    else:
        gray = scaled.select({"v": total([F.col(b) * w for b, w in zip(raster.bands, weights, strict=False)])})
    return gray if policy == "keep" else replace_missing(gray, policy)


def to_image(raster: Raster, fill: str | float = "max", normalize: bool = False, colormap: str | None = None, full: float | None = None) -> Raster:
    """Bands of whole numbers 0 to 255: gaps filled, and stretched to each tile's range if asked or if any value is outside 0 to 1.

    A tile of one value that is stretched, or without values, is zero.  The colour map
    ``gray`` repeats the grey mean of the bands three times; others are not available.
    """
    if colormap is not None:
        if colormap != "gray":
            raise RuntimeError(f"the colour map {colormap!r} needs a plotting library that is not here")
        mean = raster.select({"v": total([F.col(b) for b in raster.bands]) / len(raster.bands)})
        image = to_image(mean, fill, normalize, None, full)
        return image.select({b: F.col("v") for b in "rgb"})
    whole = raster if full is None else raster.map(lambda v: v / float(full))
    filled = replace_missing(whole, fill)
    real = [F.when(F.abs(b) < float("inf"), F.col(b)) for b in filled.bands]
    least, greatest = (F.least(*real), F.greatest(*real)) if len(real) > 1 else (real[0], real[0])
    stats = filled.df.groupBy("tile_id").agg(F.min(least).alias("lo"), F.max(greatest).alias("hi"))
    wide = filled.df.join(stats, "tile_id")
    lo, hi = F.col("lo"), F.col("hi")
    stretch = F.lit(normalize) | (lo < 0) | (hi > 1)

    def byte(b: str) -> Column:
        v = F.when(stretch, F.when(hi > lo, ratio(F.col(b) - lo, hi - lo)).otherwise(0.0)).otherwise(F.col(b))
        return F.coalesce(F.floor(v * 255.0 + 0.5).cast("int"), F.lit(0))

    return Raster(wide.select(*PIXEL, *[byte(b).alias(b) for b in filled.bands]), raster.size, filled.bands)


def dip(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``df`` with ``dip_angle`` and ``dip_direction`` of the vector; the angle between it and its shadow is NULL if it has none."""
    n = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    nx, ny = ratio(F.col(x), n), ratio(F.col(y), n)
    flat = F.sqrt(nx * nx + ny * ny)
    return df.select("*", F.acos(clamp(ratio(nx * nx + ny * ny, flat), -1.0, 1.0)).alias("dip_angle"), F.when(nx.isNotNull(), F.atan2(ny, nx)).alias("dip_direction"))


# Entries from one corner colour to the next, and the channel that changes on the way.
_ARCS = (("red-yellow", 15, 1, True), ("yellow-green", 6, 0, False), ("green-cyan", 4, 2, True), ("cyan-blue", 11, 1, False), ("blue-magenta", 13, 0, True), ("magenta-red", 6, 2, False))


def color_wheel() -> list[tuple[int, int, int]]:
    """The 55 colours around the wheel, from red; one channel rises or falls on each arc."""
    color, out = [255, 0, 0], []
    for _, steps, channel, rises in _ARCS:
        for k in range(steps):
            step = list(color)
            step[channel] = 255 * k // steps if rises else 255 - 255 * k // steps
            out.append(tuple(step))
        color[channel] = 255 if rises else 0
    return out


def flow_colors(df: DataFrame, u: str = "u", v: str = "v", bgr: bool = False) -> DataFrame:
    """``df`` with ``r, g, b`` of each flow vector: hue by direction, paler towards zero, darker beyond length 1.

    With ``bgr`` the first and the last column change places.
    """
    wheel = color_wheel()
    far = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    # A flow straight along u has the angle -pi; Spark's atan2 takes no notice of a zero's sign.
    angle = F.when((F.col(v) == 0) & (F.col(u) >= 0), -math.pi).otherwise(F.atan2(-F.col(v), -F.col(u)))
    place = (angle / math.pi + 1) / 2 * (len(wheel) - 1)
    low = F.floor(place).cast("int")
    wide = df.select("*", far.alias("__far"), low.alias("__low"), (place - low).alias("__part"))
    names = "bgr" if bgr else "rgb"

    def channel(i: int) -> Column:
        values = F.array(*[F.lit(c[i] / 255.0) for c in wheel])
        first = F.get(values, F.col("__low"))
        second = F.get(values, F.when(F.col("__low") + 1 == len(wheel), 0).otherwise(F.col("__low") + 1))
        mixed = (1 - F.col("__part")) * first + F.col("__part") * second
        return F.floor(255 * F.when(F.col("__far") <= 1, 1 - F.col("__far") * (1 - mixed)).otherwise(mixed * 0.75)).cast("int")

    return wide.select("*", *[channel(i).alias(n) for i, n in enumerate(names)]).drop("__far", "__low", "__part")


def flow_image(flow: Raster, clip: float | None = None, bgr: bool = False, quantile: float | None = None) -> Raster:
    """Flow colours of a raster of two bands, lengths relative to each tile's greatest, or to a quantile and at most 1."""
    if len(flow.bands) != 2:
        raise AssertionError(f"a flow has two bands, not {len(flow.bands)}")
    bands = [F.col(b) if clip is None else clamp(F.col(b), 0.0, float(clip)) for b in flow.bands]
    start = flow.df.select(*PIXEL, bands[0].alias("fu"), bands[1].alias("fv"))
    sized = start.select("*", F.sqrt(F.col("fu") * F.col("fu") + F.col("fv") * F.col("fv")).alias("far"))
    most = F.max("far") if quantile is None else F.percentile("far", float(quantile))
    wide = sized.join(sized.groupBy("tile_id").agg(most.alias("most")), "tile_id")
    length = clamp(ratio(F.col("far"), F.col("most")), 0.0, 1.0)
    unit = wide.select(*PIXEL, (F.col("fu") / (F.col("far") + 1e-5) * length).alias("u"), (F.col("fv") / (F.col("far") + 1e-5) * length).alias("v"))
    colored = flow_colors(unit, bgr=bgr)
    return Raster(colored.select(*PIXEL, "r", "g", "b"), flow.size, ("r", "g", "b"))
