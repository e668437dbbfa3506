"""From points to pixel positions ``u, v``, and back.

Spherical angles: ``h = atan2(y, x)`` and ``v = acos(z / r)``, row 0 being the field of
view's top.  All bounds of fields of view and regions are inclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL, Raster, Resolution, ratio


def distance() -> Column:
    """A point's distance from the origin."""
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


@dataclass(frozen=True)
class FieldOfView:
    """Angles in radians; a view whose left exceeds its right would wrap around and is refused."""

    left: float
    right: float
    top: float
    bottom: float

    @property
    def crosses_pi(self) -> bool:
        return self.left > self.right

    def require_plain(self) -> None:
        if self.crosses_pi:
            raise NotImplementedError(f"a field of view that wraps around is not supported: {self}")


Frame = tuple[float, float, float, float]


def to_pixels(df: DataFrame, size: Resolution, frame: Frame | None) -> DataFrame:
    """``u, v`` from the columns ``a, b``: the frame (or each tile's own extent) spans the first to the last pixel.

    A frame is (least a, least b, greatest a, greatest b); a zero span counts as one.
    Extents are one row a tile, aggregated before they are joined.
    """
    names = ("a0", "b0", "a1", "b1")
    if frame is None:
        extent = df.groupBy("tile_id").agg(F.min("a").alias("a0"), F.min("b").alias("b0"), F.max("a").alias("a1"), F.max("b").alias("b1"))
        wide = df.join(extent, "tile_id")
    else:
        wide = df.select("*", *[F.lit(float(f)).alias(n) for f, n in zip(frame, names, strict=True)])

    def place(c: str, low: str, high: str, n: int) -> Column:
        span = F.col(high) - F.col(low)
        return (F.col(c) - F.col(low)) / F.when(span == 0, 1.0).otherwise(span) * (n - 1)

    placed = wide.select("*", place("a", "a0", "a1", size.width).alias("u"), place("b", "b0", "b1", size.height).alias("v"))
    return placed.drop("a", "b", *names)


class Projection:
    """Points that are seen, with pixel positions ``u, v``."""

    def project(self, points: DataFrame, size: Resolution) -> DataFrame:
        raise NotImplementedError

    def inverse(self, raster: Raster) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")


@dataclass(frozen=True)
class Orthographic(Projection):
    """Two coordinates as they are; row 0 is the least of the second axis.  ``roi``: (min0, min1, max0, max1)."""

    plane: str = "xy"
    roi: Frame | None = None

    def __post_init__(self) -> None:
        if self.plane not in ("xy", "yz", "xz"):
            raise ValueError(f"the plane is xy, yz or xz, not {self.plane!r}")

    def project(self, points: DataFrame, size: Resolution) -> DataFrame:
        a, b = (F.col(c) for c in self.plane)
        seen = points if self.roi is None else points.where(a.between(self.roi[0], self.roi[2]) & b.between(self.roi[1], self.roi[3]))
        return to_pixels(seen.select("*", a.alias("a"), b.alias("b")), size, self.roi)


@dataclass(frozen=True)
class Spherical(Projection):
    """Azimuth and polar angle; points at the origin have no direction and are left out."""

    field_of_view: FieldOfView | None = None

    def project(self, points: DataFrame, size: Resolution) -> DataFrame:
        fov = self.field_of_view
        if fov is not None:
            fov.require_plain()
        r = distance()
        angles = points.select("*", F.atan2("y", "x").alias("a"), F.acos(ratio(F.col("z"), r)).alias("b")).where("b IS NOT NULL")
        if fov is None:
            return to_pixels(angles, size, None)
        seen = angles.where(F.col("a").between(fov.left, fov.right) & F.col("b").between(fov.top, fov.bottom))
        return to_pixels(seen, size, (fov.left, fov.top, fov.right, fov.bottom))

    def inverse(self, raster: Raster, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
        """``tile_id, y, x`` of each pixel with a range, and its point as ``px, py, pz``; needs a field of view."""
        fov = self.field_of_view
        if fov is None:
            raise ValueError("the inverse of a spherical projection needs a field of view")
        fov.require_plain()
        step = lambda c, low, high, n: F.lit(low) + F.col(c) * ((high - low) / max(n - 1, 1))
        r = F.col(raster.single)
        seen = raster.df.where(r.isNotNull()).select(
            *PIXEL, r.alias("r"), step("x", fov.left, fov.right, raster.size.width).alias("h"), step("y", fov.top, fov.bottom, raster.size.height).alias("v")
        )
        r, h, v = F.col("r"), F.col("h"), F.col("v")
        xyz = (r * F.sin(v) * F.cos(h), r * F.sin(v) * F.sin(h), r * F.cos(v))
        return seen.select(*PIXEL, *[(c + o).alias(n) for c, o, n in zip(xyz, origin, ("px", "py", "pz"), strict=True)])


class Perspective(Projection):
    """A pinhole camera ``K (R X + t)``; keeps what is before it and falls on the image, half-open."""

    def __init__(self, K, R, translation=None) -> None:
        self.K, self.R = np.asarray(K, dtype=float), np.asarray(R, dtype=float)
        self.t = np.zeros(3) if translation is None else np.asarray(translation, dtype=float)
        if self.R.shape != (3, 3):
            raise TypeError(f"R is 3 x 3, not {self.R.shape}")
        if not np.allclose(self.R @ self.R.T, np.eye(3), rtol=0, atol=1e-6) or not math.isclose(np.linalg.det(self.R), 1.0, abs_tol=1e-6):
            raise ValueError("R is not a rotation")
        if self.t.shape != (3,):
            raise ValueError(f"the translation has three parts, not {self.t.shape}")
        if self.K.shape != (3, 3) or not np.array_equal(self.K[2], [0, 0, 1]):
            raise ValueError("K is 3 x 3 and ends in the row 0, 0, 1")

    def project(self, points: DataFrame, size: Resolution) -> DataFrame:
        def row(m: np.ndarray, c: tuple[str, str, str], add: float = 0.0) -> Column:
            return F.lit(float(m[0])) * F.col(c[0]) + F.lit(float(m[1])) * F.col(c[1]) + F.lit(float(m[2])) * F.col(c[2]) + F.lit(float(add))

        camera = points.select("*", *[row(self.R[i], ("x", "y", "z"), self.t[i]).alias(f"c{i}") for i in range(3)]).where("c2 > 0")
        image = camera.select("*", *[ratio(row(self.K[i], ("c0", "c1", "c2")), F.col("c2")).alias(n) for i, n in enumerate("uv")])
        seen = image.where((F.col("u") >= 0) & (F.col("u") < size.width) & (F.col("v") >= 0) & (F.col("v") < size.height))
        return seen.drop("c0", "c1", "c2")
