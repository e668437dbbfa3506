"""Schemas, and what stands for missing values.

Points are rows ``tile_id, point_id, x, y, z`` and any scalar fields as columns.
Rasters are rows ``tile_id, y, x`` and one DOUBLE column a band, one row for every
pixel of a tile.  A missing value is NULL: Spark's aggregates skip it, arithmetic
passes it on.  NaN is turned into NULL where points enter.  Every expression below
guards what ANSI mode would refuse, and what ``greatest`` and ``least`` would hide by
skipping NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ("tile_id", "point_id", "x", "y", "z")
PIXEL = ("tile_id", "y", "x")


class Resolution(NamedTuple):
    """Pixels of a raster; its shape is (height, width)."""

    width: int
    height: int

    @classmethod
    def of(cls, value: Resolution | tuple[int, int]) -> Resolution:
        """A resolution from itself or a tuple of two positive whole numbers; a list is refused."""
        if not isinstance(value, tuple) or len(value) != 2 or not all(isinstance(n, int) and not isinstance(n, bool) for n in value):
            raise TypeError(f"a resolution is a tuple of two whole numbers, not {value!r}")
        if min(value) < 1:
            raise ValueError(f"a resolution is positive, not {value!r}")
        return cls(*value)


@dataclass(frozen=True)
class Raster:
    """A raster DataFrame with its size and bands: one (``v``), three for RGB, or as an operator names them."""

    df: DataFrame
    size: Resolution
    bands: tuple[str, ...] = ("v",)

    def __post_init__(self) -> None:
        missing = [c for c in (*PIXEL, *self.bands) if c not in self.df.columns]
        if missing:
            raise ValueError(f"a raster lacks the columns {missing}")

    @property
    def single(self) -> str:
        """The only band's column; several are an error."""
        if len(self.bands) != 1:
            raise ValueError(f"one band is needed, not {len(self.bands)}")
        return self.bands[0]

    def map(self, f) -> Raster:
        """Every band through a Column function."""
        return self.select({b: f(F.col(b)) for b in self.bands})

    def select(self, bands: dict[str, Column]) -> Raster:
        """The same pixels with these bands instead."""
        return replace(self, df=self.df.select(*PIXEL, *[c.alias(b) for b, c in bands.items()]), bands=tuple(bands))


def storable(raster: Raster) -> Raster:
    """The raster, if it has one band or three: what a store takes."""
    if len(raster.bands) not in (1, 3):
        raise AssertionError(f"a stored raster has one band or three, not {len(raster.bands)}")
    return raster


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """Within bounds; NULL if the value is, and as it is if a bound is NULL."""
    low, high = (F.lit(b) if isinstance(b, int | float) else b for b in (low, high))
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def ratio(top: Column, bottom: Column) -> Column:
    """The quotient, NULL by zero."""
    return F.try_divide(top, bottom)


def root(value: Column) -> Column:
    return F.when(value >= 0, F.sqrt(value))


def log10(value: Column) -> Column:
    """NULL below zero, minus infinity at zero."""
    return F.when(value > 0, F.log10(value)).when(value == 0, F.lit(float("-inf")))


def total(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def join_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rasters side by side, pixel by pixel; their band names must differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(PIXEL))
    return out
