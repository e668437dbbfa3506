"""A durable store of named rasters: Parquet by feature and tile."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from types import MappingProxyType
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidKey
from ..schema import PIXEL, Raster, Resolution, storable

# Device names that file systems reserve.
_DEVICES = {"CON", "PRN", "AUX", "NUL"} | {f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)}


def validate_key(key: str) -> str:
    """The key, if it can be one part of a path anywhere: not empty, ``.`` or ``..``, without separators or colons, not a device, not ending in a dot or space."""
    if not isinstance(key, str) or not key or key in (".", "..") or re.search(r"[/\\:\x00-\x1f]", key) or key[-1] in ". " or key.split(".")[0].upper() in _DEVICES:
        raise InvalidKey(f"not a name to store under: {key!r}")
    return key


#: Pixels that go to one file of a stored raster.
FILE_PIXELS = 1 << 20


class RasterStore:
    """Rasters by name under one path, each a folder of tile partitions.

    A name is checked before anything is written, so that a refused one leaves what is
    there.  Adding replaces the tiles that are written.  ``untrack`` forgets a name and
    leaves its files; ``adopt`` takes up files that are there; ``purge`` deletes them.
    """

    def __init__(self, spark: SparkSession, path: str, resolution: Resolution | tuple[int, int]) -> None:
        self.spark, self.path, self.size = spark, path.rstrip("/"), Resolution.of(resolution)
        self._bands: dict[str, tuple[str, ...]] = {}

    def _place(self, name: str) -> str:
        return f"{self.path}/{quote(validate_key(name), safe='')}"

    def add(self, name: str, raster: Raster, mode: str = "overwrite") -> None:
        """Write a raster; ``mode`` tiles replaces only the tiles that the raster has."""
        place = self._place(name)
        raster = storable(raster)
        if raster.size != self.size:
            raise ValueError(f"the store holds rasters of {self.size}, not {raster.size}")
        # A large tile goes to several tasks and files, by bands of rows.
        band = F.floor(F.col("y") / max(1, FILE_PIXELS // self.size.width))
        writer = raster.df.select(*PIXEL, *raster.bands).repartition("tile_id", band).write.partitionBy("tile_id").mode("overwrite")
        if mode == "tiles":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(place)
        self._bands[name] = raster.bands

    def get(self, name: str) -> Raster:
        if name not in self._bands:
            raise KeyError(name)
        schema = "tile_id string, y int, x int, " + ", ".join(f"{b} double" for b in self._bands[name])
        return Raster(self.spark.read.schema(schema).parquet(self._place(name)).select(*PIXEL, *self._bands[name]), self.size, self._bands[name])

    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def adopt(self) -> list[str]:
        """Take up the rasters whose files are there; their names."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        for status in fs.listStatus(root):
            name = unquote(status.getPath().getName())
            if status.isDirectory() and name not in self._bands:
                columns = [c for c in self.spark.read.parquet(self._place(name)).columns if c not in PIXEL]
                self._bands[name] = tuple(columns)
        return sorted(self._bands)

    def untrack(self, name: str) -> None:
        del self._bands[name]

    def purge(self, names: Iterable[str] | None = None) -> None:
        for name in list(self._bands if names is None else names):
            fs, path = self._fs(self._place(name))
            fs.delete(path, True)
            self._bands.pop(name, None)

    def offload(self, features: str | Iterable[str] | None = None) -> None:
        """Let go of what Spark holds of these rasters (of all by default) in memory; they are on disk as soon as they are added.  Unknown names are an error."""
        for name in list(self._bands) if features is None else [features] if isinstance(features, str) else features:
            self.get(name).df.unpersist()

    def offload_image_data_to_disk(self, features: str | Iterable[str] | None = None) -> None:
        """Legacy alias of ``offload``."""
        self.offload(features)

    @property
    def rasters(self) -> Mapping[str, Raster]:
        """A read-only view of what is stored."""
        return MappingProxyType({name: self.get(name) for name in self._bands})

    def to_uint8(self, name: str, prepare=None) -> Raster:
        """The stored raster as an 8-bit image, after ``prepare`` if given, or the usual filling of gaps."""
        from ..functions.images import to_image

        raster = self.get(name)
        return to_image(raster) if prepare is None else prepare(raster)


def raster_rows(raster: Raster) -> DataFrame:
    """A raster as points ``tile_id, point_id, u, v, value``; pixels without a value are left out."""
    return raster.df.where(F.col(raster.single).isNotNull()).select(
        "tile_id", (F.col("y").cast("bigint") * raster.size.width + F.col("x")).alias("point_id"), F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), F.col(raster.single).alias("value")
    )
