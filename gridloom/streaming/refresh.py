"""Keep stored rasters up to date while points arrive.

Arriving points are appended to a Parquet table, partitioned by tile; each micro-batch
then recomputes the rasters of the tiles it touched, and of no others, from all their
points.  A batch that is run again after a failure appends into its own folder, so
points are not counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import RasterEngine
from ..schema import Raster, Resolution
from ..sources.store import RasterStore


def refresh_tiles(
    points: DataFrame, touched: DataFrame, store: RasterStore, features: Sequence[str], resolution: Resolution | tuple[int, int], projection: Any, interpolation: Any
) -> None:
    """Recompute the features of the tiles in ``touched`` and replace them in the store."""
    some = points.join(touched.select("tile_id").distinct(), "tile_id", "left_semi")
    engine = RasterEngine(some, resolution, projection, interpolation)
    try:
        for name, raster in engine.generate(features).items():
            store.add(name, Raster(raster.df, raster.size, raster.bands), mode="tiles")
    finally:
        engine.close()


def follow_points(
    arriving: DataFrame, points_path: str, store: RasterStore, features: Sequence[str], resolution: Resolution | tuple[int, int], checkpoint: str,
    projection: Any = "spherical", interpolation: Any = "nearest_neighbor", trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Start a query that refreshes the store from a streaming point table."""

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{points_path}/batch={number}")
        points = spark.read.schema(df.schema).parquet(points_path)
        touched = spark.read.schema(df.schema).parquet(f"{points_path}/batch={number}")
        refresh_tiles(points.select(*df.columns), touched, store, features, resolution, projection, interpolation)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
