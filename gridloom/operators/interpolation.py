"""From scattered values at ``u, v`` to dense rasters.

All base attributes of a run go through one interpolation: the weights, or the
nearest point, of a pixel are found once and serve every column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIXEL, Resolution, ratio
from .delaunay import delaunay_triangles, triangulate, weights_of
from .thinning import thin_points


def grid(tiles: DataFrame, size: Resolution) -> DataFrame:
    """All pixels of each tile of a one-column table, y and x counting from 0."""
    rows = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(size.height - 1))).alias("y"))
    return rows.select("tile_id", "y", F.explode(F.sequence(F.lit(0), F.lit(size.width - 1))).alias("x"))


class Interpolation:
    """``rasters`` gives ``tile_id, y, x`` and each value column, for every pixel of every tile of ``tiles``.

    ``weights`` gives what depends on the points' places alone, if there is such a thing; it can be
    kept and given to ``rasters`` again for other values of the same points.
    """

    #: Whether the plan of ``rasters`` reads the points in one place only.
    reads_once: ClassVar[bool] = False

    def weights(self, points: DataFrame, size: Resolution) -> DataFrame | None:
        return None

    def rasters(self, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Nearest(Interpolation):
    """The nearest point's values, the lowest point_id's of equals; NULL only in tiles without points.

    Points are in square cells of a few points each.  A pixel looks at the 3 x 3 cells
    around it; what it finds within a cell's side is certainly nearest.  The rest look
    again in cells of four times the side, until cells cover the grid.  Each round
    is an equi-join on (tile, cell); only pixels far from all points, in the last rounds, meet
    most of a tile's points.
    """

    reads_once: ClassVar[bool] = True

    def rasters(self, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        longest = max(size)
        # Projections keep positions on the grid, but frames need not: cells are for positions held to it.
        counts = points.groupBy("tile_id").agg(F.count("*").alias("n"))
        side = F.greatest(F.lit(1.0), F.ceil(F.sqrt(ratio(F.lit(2.0 * size.width * size.height), F.col("n")))).cast("double"))
        sides = counts.select("tile_id", side.alias("side"))
        kept = F.struct(*[F.col(c) for c in values], F.col("u"), F.col("v"), F.col("point_id"))
        with_sides = points.join(sides, "tile_id").select("tile_id", "side", kept.alias("p"))
        pixels = grid(tiles, size).join(sides, "tile_id", "left").select("*", F.lit(None).cast("double").alias("d2"), F.lit(None).cast("bigint").alias("id"), *[F.lit(None).cast("double").alias(c) for c in values])
        rounds = max(1, math.ceil(math.log(max(longest, 2), 4))) + 1
        for k in range(rounds):
            cell = F.col("side") * float(4**k)
            inside = lambda c, s, n: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(n)), c)) / s)
            placed = with_sides.select("tile_id", inside(F.col("p.u"), cell, size.width).alias("cx"), inside(F.col("p.v"), cell, size.height).alias("cy"), "p")
            done = F.col("d2").isNotNull() & (F.col("d2") <= (F.col("side") * float(4 ** (k - 1))) * (F.col("side") * float(4 ** (k - 1)))) if k else F.lit(False)
            around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
            nowhere = F.array(F.struct(F.lit(None).cast("int").alias("dx"), F.lit(None).cast("int").alias("dy")))
            asking = pixels.select("*", F.explode(F.when(done, nowhere).otherwise(around)).alias("o"))
            asking = asking.select("*", (F.floor(F.col("x") / cell) + F.col("o.dx")).alias("cx"), (F.floor(F.col("y") / cell) + F.col("o.dy")).alias("cy")).drop("o")
            met = asking.join(placed, ["tile_id", "cx", "cy"], "left")
            far = (F.col("p.u") - F.col("x")) * (F.col("p.u") - F.col("x")) + (F.col("p.v") - F.col("y")) * (F.col("p.v") - F.col("y"))
            best = met.groupBy(*PIXEL, "side", "d2", "id", *values).agg(F.min(F.when(F.col("p").isNotNull(), F.struct(far.alias("d2"), F.col("p.point_id").alias("id"), *[F.col(f"p.{c}").alias(c) for c in values]))).alias("m"))
            new = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(c)) if c in ("d2", "id") else F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c))
            pixels = best.select(*PIXEL, "side", *[new(c).alias(c) for c in ("d2", "id", *values)])
        return pixels.select(*PIXEL, *values)


def barycentric(triangles: DataFrame, points: DataFrame, size: Resolution) -> DataFrame:
    """``tile_id, y, x, a, b, c, wa, wb, wc`` of each pixel in a triangle; on an edge the first triangle by corners.

    A triangle meets only the pixels of its bounding box, which it generates itself, so
    no join of pixels and triangles is needed.
    """
    corner = points.select("tile_id", "point_id", "u", "v")
    wide = triangles
    for c in "abc":
        wide = wide.join(corner.select("tile_id", F.col("point_id").alias(c), F.col("u").alias(f"u{c}"), F.col("v").alias(f"v{c}")), ["tile_id", c])
    u, v = ([F.col(f"{n}{c}") for c in "abc"] for n in "uv")
    pad = 1e-9

    def span(columns: list[Column], n: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil(F.least(*columns) - pad).cast("int"))
        high = F.least(F.lit(n - 1), F.floor(F.greatest(*columns) + pad).cast("int"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    boxed = wide.select("*", F.explode(span(v, size.height)).alias("y")).select("*", F.explode(span(u, size.width)).alias("x"))
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    a, b, c, at = (u[0], v[0]), (u[1], v[1]), (u[2], v[2]), (F.col("x"), F.col("y"))
    whole = turn(a, b, c)
    weighed = boxed.select("tile_id", "y", "x", "a", "b", "c", ratio(turn(b, c, at), whole).alias("wa"), ratio(turn(c, a, at), whole).alias("wb"), ratio(turn(a, b, at), whole).alias("wc"))
    inside = weighed.where((F.col("wa") >= -pad) & (F.col("wb") >= -pad) & (F.col("wc") >= -pad))
    first = F.row_number().over(Window.partitionBy(*PIXEL).orderBy("a", "b", "c"))
    return inside.select("*", first.alias("k")).where("k = 1").drop("k")


def corners(points: DataFrame, size: Resolution, tiles: DataFrame) -> DataFrame:
    """For every pixel the ids ``a, b, c`` and places of its triangle's corners, and its distances ``da, db, dc`` from them.

    Outside the hull ids and places are NULL and distances infinite.
    """
    found = barycentric(delaunay_triangles(points), points, size).select(*PIXEL, "a", "b", "c")
    places = points.select("tile_id", "point_id", "u", "v")
    for c in "abc":
        found = found.join(places.select("tile_id", F.col("point_id").alias(c), F.col("u").alias(f"u{c}"), F.col("v").alias(f"v{c}")), ["tile_id", c])
    out = grid(tiles, size).join(found, list(PIXEL), "left")
    far = {c: F.sqrt((F.col(f"u{c}") - F.col("x")) * (F.col(f"u{c}") - F.col("x")) + (F.col(f"v{c}") - F.col("y")) * (F.col(f"v{c}") - F.col("y"))) for c in "abc"}
    return out.select(*PIXEL, "a", "b", "c", *[f"{n}{c}" for c in "abc" for n in "uv"], *[F.coalesce(d, F.lit(float("inf"))).alias(f"d{c}") for c, d in far.items()])


def shapes(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """Each triangle with its ``area`` and ``aspect``, the longest edge over the shortest."""
    corner = points.select("tile_id", "point_id", "u", "v")
    wide = triangles
    for c in "abc":
        wide = wide.join(corner.select("tile_id", F.col("point_id").alias(c), F.col("u").alias(f"u{c}"), F.col("v").alias(f"v{c}")), ["tile_id", c])
    edge = lambda p, q: F.sqrt((F.col(f"u{p}") - F.col(f"u{q}")) * (F.col(f"u{p}") - F.col(f"u{q}")) + (F.col(f"v{p}") - F.col(f"v{q}")) * (F.col(f"v{p}") - F.col(f"v{q}")))
    sides = wide.select("tile_id", "a", "b", "c", edge("a", "b").alias("e1"), edge("b", "c").alias("e2"), edge("c", "a").alias("e3"))
    e1, e2, e3 = (F.col(f"e{i}") for i in (1, 2, 3))
    half = (e1 + e2 + e3) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), half * (half - e1) * (half - e2) * (half - e3)))
    return sides.select("tile_id", "a", "b", "c", area.alias("area"), (F.greatest(e1, e2, e3) / F.greatest(F.least(e1, e2, e3), F.lit(2.220446049250313e-16))).alias("aspect"))


def cull(triangles: DataFrame, points: DataFrame, area_scale: float | None = 10.0, mad_factor: float = 6.0, fallback: float = 10.0) -> DataFrame:
    """The triangles that are neither much larger nor much longer than their tile's usual ones.

    Larger: ``area_scale`` times the median area or more.  Longer: an aspect beyond the
    median and ``mad_factor`` median absolute deviations, or, without deviation,
    ``fallback`` times the median.
    """
    shaped = shapes(triangles, points)
    middle = shaped.groupBy("tile_id").agg(F.median("area").alias("mid_area"), F.median("aspect").alias("mid"))
    off = shaped.join(middle, "tile_id")
    mad = off.groupBy("tile_id").agg(F.median(F.abs(F.col("aspect") - F.col("mid"))).alias("mad"))
    judged = off.join(mad, "tile_id")
    most = F.when(F.col("mad") > 0, F.col("mid") + mad_factor * F.col("mad")).otherwise(F.col("mid") * fallback)
    good = F.col("aspect") <= most
    if area_scale is not None:
        good = good & (F.col("area") < F.col("mid_area") * area_scale)
    return judged.where(good).select("tile_id", "a", "b", "c")


def weighted(weights: DataFrame, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, fill: float | None = None) -> DataFrame:
    """Sums of weight times value; a missing corner value makes the pixel missing; pixels without weights get ``fill``."""
    corners = weights.select(*PIXEL, F.explode(F.array(*[F.struct(F.col(c).alias("point_id"), F.col(f"w{c}").alias("w")) for c in "abc"])).alias("k")).select(*PIXEL, "k.*")
    met = corners.join(points.select("tile_id", "point_id", *values), ["tile_id", "point_id"])
    sums = met.groupBy(*PIXEL).agg(*[F.when(F.count(c) == 3, F.sum(F.col("w") * F.col(c))).alias(c) for c in values], F.lit(True).alias("__in"))
    out = grid(tiles, size).join(sums, list(PIXEL), "left")
    return out.select(*PIXEL, *[(F.when(F.col("__in").isNull(), F.lit(fill)).otherwise(F.col(c)) if fill is not None else F.col(c)).alias(c) for c in values])


@dataclass(frozen=True)
class Linear(Interpolation):
    """Barycentric on the Delaunay triangulation; missing exactly outside the hull."""

    def weights(self, points: DataFrame, size: Resolution) -> DataFrame:
        return barycentric(delaunay_triangles(points), points, size)

    def rasters(self, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        return weighted(self.weights(points, size) if weights is None else weights, points, values, size, tiles)


@dataclass(frozen=True)
class Delaunay(Interpolation):
    """Barycentric, after optional thinning, on the triangles that culling leaves."""

    enable_density_thinning: bool = False
    max_points_per_pixel: int = 4
    density_ratio_trigger: float | None = 4.0
    interior_culling: bool = True
    area_scale: float | None = 10.0
    aspect_ratio_mad_factor: float = 6.0
    aspect_ratio_fallback_scale: float = 10.0
    fill: float | None = None

    def __post_init__(self) -> None:
        if self.max_points_per_pixel < 1:
            raise ValueError("max_points_per_pixel is at least 1")
        if self.area_scale is not None and self.area_scale <= 0:
            raise ValueError("area_scale is positive or None")
        if self.aspect_ratio_mad_factor <= 0 or self.aspect_ratio_fallback_scale <= 0:
            raise ValueError("aspect ratio factors are positive")

    def weights(self, points: DataFrame, size: Resolution) -> DataFrame:
        if self.enable_density_thinning:
            points = thin_points(points, size, self.max_points_per_pixel, self.density_ratio_trigger)
        triangles = delaunay_triangles(points)
        if self.interior_culling:
            triangles = cull(triangles, points, self.area_scale, self.aspect_ratio_mad_factor, self.aspect_ratio_fallback_scale)
        return barycentric(triangles, points, size)

    def rasters(self, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        return weighted(self.weights(points, size) if weights is None else weights, points, values, size, tiles, self.fill)


def _gradients(points: np.ndarray, triangles: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Least-squares gradients at the vertices from their neighbours, nearer ones weighing more."""
    n = len(points)
    edges = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]])
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    d = points[edges[:, 1]] - points[edges[:, 0]]
    w = 1 / np.maximum((d**2).sum(axis=1), 1e-300)
    rise = values[edges[:, 1]] - values[edges[:, 0]]
    add = lambda x: np.bincount(edges[:, 0], weights=x, minlength=n)
    xx, xy, yy = add(w * d[:, 0] ** 2), add(w * d[:, 0] * d[:, 1]), add(w * d[:, 1] ** 2)
    xr, yr = add(w * d[:, 0] * rise), add(w * d[:, 1] * rise)
    det = xx * yy - xy * xy
    ok = det > 1e-12 * np.maximum(xx * yy, 1e-300)
    safe = np.where(ok, det, 1.0)
    return np.stack([np.where(ok, (yy * xr - xy * yr) / safe, 0.0), np.where(ok, (xx * yr - xy * xr) / safe, 0.0)], axis=1)


def clough_tocher(points: np.ndarray, triangles: np.ndarray, values: np.ndarray, slopes: np.ndarray, at: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The C1 cubic of each position's triangle, split at its centroid, with cross derivatives linear along its edges.

    ``of`` is each position's row in ``triangles``; there may be one triangle alone.
    Control values of the three cubics follow from the corner values and gradients, the
    edge condition, and smoothness across the inner edges.
    """
    triangles = np.atleast_2d(triangles)
    of = np.zeros(len(at), dtype=np.int64) if of is None else of
    corner, f, g = points[triangles], values[triangles], slopes[triangles]
    centre = corner.mean(axis=1)
    edge = lambda i, j: f[:, i] + (g[:, i] * (corner[:, j] - corner[:, i])).sum(axis=1) / 3
    inner = f + (g * (centre[:, None] - corner)).sum(axis=2) / 3
    across = np.empty_like(f)  # the middle value of the part that lies opposite corner k
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        along = corner[:, j] - corner[:, i]
        # The direction's barycentric parts in (corner i, corner j, centre); their sum is zero.
        system = np.ones((len(triangles), 3, 3))
        system[:, :2] = np.stack([corner[:, i], corner[:, j], centre], axis=2)
        normal = np.stack([-along[:, 1], along[:, 0], np.zeros(len(triangles))], axis=1)
        parts = np.linalg.solve(system, normal[:, :, None])[:, :, 0].T
        ends = parts[0] * (f[:, i] + edge(j, i)) + parts[1] * (edge(i, j) + f[:, j]) + parts[2] * (inner[:, i] + inner[:, j])
        across[:, k] = (ends / 2 - parts[0] * edge(i, j) - parts[1] * edge(j, i)) / parts[2]
    near = (np.roll(across, -1, axis=1) + np.roll(across, -2, axis=1) + inner) / 3
    middle = near.mean(axis=1)
    w = weights_of(points, triangles[of], at)
    out = np.empty(len(at))
    part = w.argmin(axis=1)
    for k in range(3):
        mine = np.flatnonzero(part == k)
        t = of[mine]
        i, j = (k + 1) % 3, (k + 2) % 3
        r, s, c = w[mine, i] - w[mine, k], w[mine, j] - w[mine, k], 3 * w[mine, k]
        out[mine] = (
            f[t, i] * r**3 + f[t, j] * s**3 + middle[t] * c**3 + 3 * edge(i, j)[t] * r**2 * s + 3 * edge(j, i)[t] * r * s**2 + 3 * inner[t, i] * r**2 * c
            + 3 * inner[t, j] * s**2 * c + 3 * near[t, i] * r * c**2 + 3 * near[t, j] * s * c**2 + 6 * across[t, k] * r * s * c
        )
    return out


#: Pixels of triangles' bounding boxes that are looked at together.
BOXED = 1 << 20


def covered(points: np.ndarray, triangles: np.ndarray, size: Resolution) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and row of the triangle, of all pixels in triangles, some triangles at a time."""
    p = points[triangles]
    low = np.maximum(np.ceil(p.min(axis=1) - 1e-9), 0).astype(np.int64)
    high = np.minimum(np.floor(p.max(axis=1) + 1e-9), [size.width - 1, size.height - 1]).astype(np.int64)
    wide, tall = np.maximum(high - low + 1, 0).T
    ends = np.cumsum(wide * tall)
    first = 0
    while first < len(triangles):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BOXED, side="right")))
        of = np.repeat(np.arange(first, last), (wide * tall)[first:last])
        place = np.arange(len(of)) + before - (ends - wide * tall)[of]
        x, y = low[of, 0] + place % np.maximum(wide[of], 1), low[of, 1] + place // np.maximum(wide[of], 1)
        inside = (weights_of(points, triangles[of], np.column_stack([x, y]).astype(float)) >= -1e-9).all(axis=1)
        yield x[inside], y[inside], of[inside]
        first = last


@dataclass(frozen=True)
class Cubic(Interpolation):
    """Clough-Tocher C1 cubics with estimated gradients, tile by tile; missing outside the hull."""

    def rasters(self, points: DataFrame, values: list[str], size: Resolution, tiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        columns = list(values)

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            name = pdf["tile_id"].iloc[0]
            pdf = pdf.sort_values("point_id").drop_duplicates(["u", "v"])
            p = pdf[["u", "v"]].to_numpy(dtype=float)
            triangles = triangulate(p)
            data = pdf[columns].to_numpy(dtype=float)
            out = np.full((size.height, size.width, len(columns)), np.nan)
            slopes = [_gradients(p, triangles, data[:, k]) for k in range(len(columns))]
            for x, y, of in covered(p, triangles, size):
                rows, of = np.unique(of, return_inverse=True)
                for k in range(len(columns)):
                    out[y, x, k] = clough_tocher(p, triangles[rows], data[:, k], slopes[k], np.column_stack([x, y]).astype(float), of)
            y, x = np.mgrid[: size.height, : size.width]
            frame = {"tile_id": name, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)}
            return pd.DataFrame(frame | {c: out[:, :, k].ravel() for k, c in enumerate(columns)})

        schema = "tile_id string, y int, x int, " + ", ".join(f"`{c}` double" for c in columns)
        made = points.select("tile_id", "point_id", "u", "v", *columns).groupBy("tile_id").applyInPandas(tile, schema)
        made = made.select(*PIXEL, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
        return grid(tiles, size).join(made, list(PIXEL), "left")
