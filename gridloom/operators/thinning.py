"""Thinning of dense points by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Resolution


def thin_points(points: DataFrame, size: Resolution, most: int, ratio: float | None = None) -> DataFrame:
    """At most ``most`` points of each pixel, the first by ``point_id``.

    With a positive ``ratio`` a tile with at most that many points a pixel is left as it
    is; so is one whose pixels are all within ``most`` anyway.  Pixels are positions
    rounded down, held to the grid.
    """
    if most < 1:
        raise ValueError(f"at least one point a pixel is kept, not {most}")
    cell = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    placed = points.select("*", cell("u", size.width).alias("__px"), cell("v", size.height).alias("__py"))
    order = Window.partitionBy("tile_id", "__px", "__py").orderBy("point_id")
    ranked = placed.select("*", F.row_number().over(order).alias("__rank"))
    if ratio is not None and ratio > 0:
        counts = points.groupBy("tile_id").agg(F.count("*").alias("__n"))
        ranked = ranked.join(counts, "tile_id").where((F.col("__rank") <= most) | (F.col("__n") <= ratio * size.width * size.height)).drop("__n")
    else:
        ranked = ranked.where(F.col("__rank") <= most)
    return ranked.drop("__px", "__py", "__rank")
