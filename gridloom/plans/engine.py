"""The engine: points in, named rasters out, one lazy plan for all tiles and features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL, Raster, Resolution, storable
from ..sources.store import RasterStore, validate_key
from .grammar import FEATURES, INTERPOLATIONS, PROJECTIONS
from .planner import FeaturePlan
from .registry import FeatureRegistry


class RasterEngine:
    """Rasters of a point table, for one resolution, projection and interpolation.

    ``projection`` and ``interpolation`` are strategies, their keys, or (key, options).
    The projected points, the base rasters and whatever serves several features are
    persisted to memory and disk, as are the interpolation's weights, which serve later calls,
    too; ``close`` lets them go.  With a ``store`` every target
    is written there, and read from there by ``generate``.
    """

    def __init__(
        self, points: DataFrame, resolution: Resolution | tuple[int, int], projection: Any = "spherical", interpolation: Any = "nearest_neighbor",
        *, registry: FeatureRegistry = FEATURES, store: RasterStore | None = None, persist: bool = True,
    ) -> None:
        self.points, self.size = points, Resolution.of(resolution)
        self._projection, self.interpolation = PROJECTIONS.coerce(projection), INTERPOLATIONS.coerce(interpolation)
        self.store, self._persist = store, persist
        self.plan = FeaturePlan(registry, self._reuse)
        self._held: list[DataFrame] = []
        self._weights: DataFrame | None = None

    @property
    def projection(self) -> Any:
        return self._projection

    def _hold(self, df: DataFrame) -> DataFrame:
        if self._persist:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append(df)
        return df

    def _reuse(self, raster: Raster) -> Raster:
        return Raster(self._hold(raster.df), raster.size, raster.bands)

    def generate(self, features: Sequence[str]) -> dict[str, Raster]:
        """The rasters of these names, lazily; base attributes that are new go through one interpolation together."""
        self.plan.request(features)
        base = self.plan.base_features()
        if base:
            columns = {f"base_{k}": spec.column(self.points) for k, spec in enumerate(base.values())}
            valued = self.points.select("tile_id", "point_id", "x", "y", "z", *[c.cast("double").alias(n) for n, c in columns.items()])
            projected = self._projection.project(valued, self.size).select("tile_id", "point_id", "u", "v", *columns)
            if len(base) + len(features) > 2 or not self.interpolation.reads_once:
                projected = self._hold(projected)
            tiles = self.points.select("tile_id").distinct()
            if self._weights is None and (weights := self.interpolation.weights(projected.select("tile_id", "point_id", "u", "v"), self.size)) is not None:
                self._weights = self._hold(weights)
            rasters = self.interpolation.rasters(projected, list(columns), self.size, tiles, self._weights)
            if len(features) > 1 or len(base) > 1:
                rasters = self._hold(rasters)
            for column, name in zip(columns, base, strict=True):
                self.plan.submit(name, Raster(rasters.select(*PIXEL, F.col(column).alias("v")), self.size))
        out = {name: storable(raster) for name, raster in self.plan.targets().items()}
        if self.store is not None:
            for name, raster in out.items():
                self.store.add(name, raster)
            return {name: self.store.get(name) for name in out}
        return out

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()
        self._weights = None


class ImageKey(NamedTuple):
    tile_id: str
    feature: str


@dataclass(frozen=True)
class Tile:
    """One unit of a tiled run; ``options`` are projection options of its own, such as a field of view."""

    tile_id: str
    points: DataFrame
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TiledSettings:
    """Options of a tiled run, for ``TiledEngine(tiles, **settings.as_kwargs())``; those that are None are left out."""

    resolution: tuple[int, int] = (16, 12)
    projection: str = "spherical"
    interpolation: Any = "nearest_neighbor"
    projection_options: Mapping[str, Any] | None = None
    store_path: str | None = None

    def extend_store_path(self, folder: str) -> TiledSettings:
        """The same options with the store, if there is one, in a folder of its own."""
        validate_key(folder)
        return self if self.store_path is None else replace(self, store_path=f"{self.store_path.rstrip('/')}/{folder}")

    def as_kwargs(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if v is not None}


class TiledEngine:
    """Rasters of many tiles by the same plan: tiles of equal options are one point table, and share every job.

    Failures are those of the Spark job; nothing of a failed run is kept.  With a
    ``store_path`` rasters are written to a store there, and read from it.
    """

    def __init__(
        self, tiles: Iterable[Tile], resolution: Resolution | tuple[int, int], projection: str = "spherical", interpolation: Any = "nearest_neighbor",
        projection_options: Mapping[str, Any] | None = None, registry: FeatureRegistry = FEATURES, store_path: str | None = None,
    ) -> None:
        tiles = list(tiles)
        self.store = RasterStore(tiles[0].points.sparkSession, store_path, resolution) if store_path is not None and tiles else None
        ids = [t.tile_id for t in tiles]
        twice = sorted({i for i in ids if ids.count(i) > 1})
        if twice:
            raise ValueError(f"tile ids are given twice: {', '.join(twice)}")
        for i in ids:
            validate_key(i)
        common = dict(projection_options or {})
        groups: dict[str, tuple[dict[str, Any], list[Tile]]] = {}
        for tile in tiles:
            clash = sorted(common.keys() & tile.options.keys())
            if clash:
                raise TypeError(f"options are given both for the run and for tile {tile.tile_id}: {clash}")
            options = common | dict(tile.options)
            groups.setdefault(repr(sorted(options.items(), key=lambda kv: kv[0])), (options, []))[1].append(tile)
        self.engines = []
        for options, members in groups.values():
            points = reduce(DataFrame.unionByName, [t.points.withColumn("tile_id", F.lit(t.tile_id)) for t in members])
            self.engines.append(RasterEngine(points, resolution, (projection, options), interpolation, registry=registry))
        self.tile_ids = ids

    def rasters(self, features: Sequence[str]) -> dict[str, Raster]:
        """Each feature's raster over all tiles, the form to go on with at scale."""
        made = [e.generate(features) for e in self.engines]
        out = {f: Raster(reduce(DataFrame.unionByName, [m[f].df for m in made]), made[0][f].size, made[0][f].bands) for f in features}
        if self.store is None:
            return out
        for f, raster in out.items():
            self.store.add(f, raster)
        return {f: self.store.get(f) for f in out}

    def generate(self, features: Sequence[str]) -> dict[ImageKey, Raster]:
        """A lazy raster for each tile and feature; a failing feature fails the call."""
        whole = self.rasters(features)
        return {ImageKey(t, f): Raster(r.df.where(F.col("tile_id") == t), r.size, r.bands) for t in self.tile_ids for f, r in whole.items()}

    def close(self) -> None:
        for engine in self.engines:
            engine.close()
