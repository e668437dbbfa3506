"""Operators against NumPy and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from gridloom.functions import images
from gridloom.operators import rasters, red_relief, stencil
from gridloom.operators.delaunay import delaunay_triangles, triangulate, weights_of
from gridloom.operators.interpolation import Cubic, Delaunay, Linear, Nearest, clough_tocher
from gridloom.operators.projection import FieldOfView, Orthographic, Perspective, Spherical
from gridloom.operators.thinning import thin_points
from gridloom.schema import Raster, Resolution

from .conftest import array_of, raster_of

NAN = np.nan


def cloud(spark, xyz, tile="t"):
    rows = [(tile, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "tile_id string, point_id bigint, x double, y double, z double")


def placed(spark, uv, values):
    rows = [("t", i, float(u), float(v), float(w)) for i, ((u, v), w) in enumerate(zip(uv, values, strict=True))]
    return spark.createDataFrame(rows, "tile_id string, point_id bigint, u double, v double, value double")


def interpolated(spark, strategy, uv, values, size):
    points = placed(spark, uv, values)
    df = strategy.rasters(points, ["value"], size, points.select("tile_id").distinct())
    return array_of(Raster(df, size, ("value",)))


def test_projections(spark):
    r = np.random.default_rng(0)
    xyz = r.random((50, 3))
    size = Resolution(20, 10)
    got = {row["point_id"]: (row["u"], row["v"]) for row in Orthographic("xz").project(cloud(spark, xyz), size).collect()}
    a = xyz[:, [0, 2]]
    want = (a - a.min(axis=0)) / (a.max(axis=0) - a.min(axis=0)) * [19, 9]
    assert np.allclose([got[i] for i in range(50)], want)
    roi = Orthographic("xy", (0.25, 0.25, 0.75, 0.75)).project(cloud(spark, xyz), size)
    assert roi.count() == ((xyz[:, :2] >= 0.25) & (xyz[:, :2] <= 0.75)).all(axis=1).sum()
    assert Orthographic().project(cloud(spark, xyz).limit(0), size).count() == 0
    same = Orthographic().project(cloud(spark, [(1, 2, 3), (1, 5, 3)]), size).orderBy("point_id").collect()
    assert [(p["u"], p["v"]) for p in same] == [(0.0, 0.0), (0.0, 9.0)]
    with pytest.raises(ValueError):
        Orthographic("zz")


def test_spherical_round_trip(spark):
    fov = FieldOfView(-1.0, 1.0, 0.5, 1.5)
    values = np.full((5, 7), 3.0)
    values[2, 3] = NAN
    points = Spherical(fov).inverse(raster_of(spark, values))
    assert points.count() == 34
    back = Spherical(fov).project(points.selectExpr("tile_id", "y * 7 + x AS point_id", "px AS x", "py AS y", "pz AS z", "x AS col", "y AS row"), Resolution(7, 5)).collect()
    inner = [p for p in back]
    assert len(inner) >= 15 and all(abs(p["u"] - p["col"]) < 1e-9 and abs(p["v"] - p["row"]) < 1e-9 for p in inner)
    with pytest.raises(ValueError):
        Spherical().inverse(raster_of(spark, values))
    for call in (lambda: Spherical(FieldOfView(2, -2, 0.5, -0.5)).project(points, Resolution(2, 2)), lambda: Orthographic().inverse(raster_of(spark, values))):
        with pytest.raises(NotImplementedError):
            call()


def test_perspective(spark):
    camera = Perspective([[100, 0, 50], [0, 100, 50], [0, 0, 1]], np.eye(3), (1, -2, 10))
    got = camera.project(cloud(spark, [(0.5, 0.5, 5), (0, 0, -50)]), Resolution(200, 200)).collect()
    assert len(got) == 1 and got[0]["u"] == pytest.approx(100 * 1.5 / 15 + 50) and got[0]["v"] == pytest.approx(100 * -1.5 / 15 + 50)
    behind = Perspective([[100, 0, 50], [0, 100, 50], [0, 0, 1]], np.eye(3)).project(cloud(spark, [(0, 0, 5), (0, 0, -5)]), Resolution(100, 100))
    assert [p["point_id"] for p in behind.collect()] == [0]
    eye = np.eye(3)
    for error, args in ((TypeError, (eye, np.eye(2))), (ValueError, (eye, 2 * eye)), (ValueError, (eye, -eye)), (ValueError, (eye, eye, (1, 2))), (ValueError, (np.ones((3, 3)), eye))):
        with pytest.raises(error):
            Perspective(*args)


def spread_points():
    r = np.random.default_rng(1)
    yield from (r.random((n, 2)) for n in (3, 10, 60, 700))
    yield np.concatenate([r.random((150, 2)) * 1e-4, r.random((150, 2))])  # a tight cluster
    yield np.concatenate([np.stack([np.arange(40.0), np.zeros(40)], axis=1), [[3.3, 5.0]]])  # all but one on a line
    yield np.stack(np.meshgrid(np.arange(12.0), np.arange(9.0)), axis=-1).reshape(-1, 2)  # ties everywhere


def test_triangulation_is_delaunay():
    for p in spread_points():
        n = len(p)
        t = triangulate(p)
        a, b, c = (p[t[:, k]] for k in range(3))
        area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
        assert (area > 0).all()
        least = 1e-12 * np.abs(p).max() ** 4
        for k, (i, j, m) in enumerate(t):
            d = p[[i, j, m]][:, None] - p[None]
            s = (d**2).sum(axis=2)
            inside = s[0] * (d[1, :, 0] * d[2, :, 1] - d[1, :, 1] * d[2, :, 0]) - s[1] * (d[0, :, 0] * d[2, :, 1] - d[0, :, 1] * d[2, :, 0]) + s[2] * (d[0, :, 0] * d[1, :, 1] - d[0, :, 1] * d[1, :, 0])
            assert (inside <= least).all(), k
        edges = np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1)
        _, counts = np.unique(edges, axis=0, return_counts=True)
        hull = (counts == 1).sum()
        assert set(t.ravel().tolist()) == set(range(n))
        assert counts.max() <= 2 and len(t) == 2 * n - 2 - hull  # Euler's formula: a triangulation of the whole hull


def test_triangulation_of_grids_and_lines():
    x, y = np.meshgrid(np.arange(6.0), np.arange(5.0))
    p = np.column_stack([x.ravel(), y.ravel()])
    t = triangulate(p)
    a, b, c = (p[t[:, k]] for k in range(3))
    area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    assert area.sum() == pytest.approx(20.0) and (area > 0).all()
    assert len(triangulate(np.column_stack([np.arange(9.0), 2 * np.arange(9.0)]))) == 0 and len(triangulate(p[:2])) == 0


GRID_POINTS = [(float(x), float(y)) for y in range(0, 11) for x in range(0, 11)]


@pytest.mark.parametrize("strategy", [Linear(), Cubic(), Delaunay()])
def test_linear_fields_are_reproduced(spark, strategy):
    r = np.random.default_rng(2)
    uv = r.random((70, 2)) * [13, 9]
    uv[:4] = [(0, 0), (13, 0), (0, 9), (13, 9)]
    if isinstance(strategy, Delaunay):
        uv = np.array(GRID_POINTS)
    got = interpolated(spark, strategy, uv, 2 * uv[:, 0] + 3 * uv[:, 1] + 1, Resolution(11, 10))
    y, x = np.mgrid[:10, :11]
    assert np.nanmax(np.abs(got - (2 * x + 3 * y + 1))) < 1e-9 and not np.isnan(got).any()


def test_culling_leaves_holes_out(spark):
    uv = [p for p in GRID_POINTS if not (3 <= p[0] <= 7 and 3 <= p[1] <= 7)]
    values = [2 * u + 3 * v + 1 for u, v in uv]
    whole, culled = (interpolated(spark, s, uv, values, Resolution(11, 11)) for s in (Linear(), Delaunay(area_scale=3.0)))
    assert not np.isnan(whole).any() and np.isnan(culled[5, 5]) and not np.isnan(culled[0, 0])
    filled = interpolated(spark, Delaunay(area_scale=3.0, fill=-1.0), uv, values, Resolution(11, 11))
    assert filled[5, 5] == -1.0
    outside = interpolated(spark, Linear(), [(2, 2), (4, 2), (2, 4)], [1, 1, 1], Resolution(6, 6))
    assert np.isnan(outside[5, 5]) and outside[2, 2] == 1.0


def test_cubic_is_smooth_and_exact_at_points():
    r = np.random.default_rng(5)
    p, f = r.random((3, 2)), r.random(3)
    g = r.random((3, 2))
    t = np.array([0, 1, 2]) if triangulate(p)[0].tolist() in ([0, 1, 2], [1, 2, 0], [2, 0, 1]) else np.array([0, 2, 1])
    assert np.allclose(clough_tocher(p, t, f, g, p[t]), f[t])
    centre = p.mean(axis=0)
    for direction in ((1, 0), (0.3, 1)):  # both sides of the inner edges have the same slope
        d = np.array(direction) * 1e-5
        for k in range(3):
            at = centre + 0.5 * (p[k] - centre)
            values = clough_tocher(p, t, f, g, np.array([at - 2 * d, at - d, at, at + d, at + 2 * d]))
            assert abs((values[2] - values[1]) - (values[3] - values[2])) < 1e-8
    assert weights_of(p, t, p[t]).sum() == pytest.approx(3)


def test_nearest(spark):
    r = np.random.default_rng(3)
    for n, (w, h) in ((1, (9, 7)), (40, (23, 11)), (300, (12, 12))):
        uv = np.vstack([r.random((n, 2)) * [w - 1, h - 1] * (0.2 if n == 40 else 1)])
        got = interpolated(spark, Nearest(), uv, np.arange(n), Resolution(w, h))
        y, x = np.mgrid[:h, :w]
        d = (uv[:, 0] - x[..., None]) ** 2 + (uv[:, 1] - y[..., None]) ** 2
        assert (got == d.argmin(axis=2)).all()


def test_triangulation_of_many_points():
    r = np.random.default_rng(2)
    p = np.concatenate([r.random((10_000, 2)), 0.5 + 1e-4 * r.normal(size=(10_000, 2))])
    t = triangulate(p)
    a, b, c = (p[t[:, k]] for k in range(3))
    area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    assert (area > 0).all() and len(np.unique(t)) == len(p)
    assert 0.99 < area.sum() < 1


def test_openness_of_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    height = r.random((23, 31))
    height[4, 5] = height[22, 30] = NAN
    settings = red_relief.Settings(distance=5, directions=7)
    raster = raster_of(spark, height)
    one = {(p["y"], p["x"]): p for p in red_relief.pack(raster, settings).df.collect()}
    monkeypatch.setattr(red_relief, "BLOCK", 7)
    many = {(p["y"], p["x"]): p for p in red_relief.pack(raster, settings).df.collect()}
    assert one == many and len(one) == height.size
    for y, x in ((0, 0), (10, 13), (22, 29)):
        ups = []
        for ray in range(7):
            rises = [(height[y - dy, x - dx] - height[y, x]) / far for k, dy, dx, far in red_relief.rays(7, 5) if k == ray and 0 <= y - dy < 23 and 0 <= x - dx < 31]
            rises = [v for v in rises if not np.isnan(v)]
            ups += [90 - math.degrees(math.atan(max(rises)))] if rises else []
        assert math.isclose(one[y, x]["positive"], sum(ups) / len(ups), rel_tol=1e-12)
    assert one[4, 5]["positive"] is None


def test_delaunay_ties_and_duplicates(spark):
    points = placed(spark, [(0, 0), (4, 0), (0, 4), (0, 0), (4, 4)], range(5))
    assert {tuple(r)[1:] for r in delaunay_triangles(points).collect()} <= {(0, 1, 2), (1, 2, 4), (0, 1, 4), (0, 2, 4)}
    for bad in ({"max_points_per_pixel": 0}, {"area_scale": 0.0}, {"aspect_ratio_mad_factor": -1.0}):
        with pytest.raises(ValueError):
            Delaunay(**bad)


def test_thinning(spark):
    points = placed(spark, [(0.2, 0.3)] * 5 + [(2.5, 2.5)] + [(-3.0, 99.0)] * 2, range(8))
    kept = lambda *a: sorted(r["point_id"] for r in thin_points(points, Resolution(4, 4), *a).collect())
    assert kept(2) == [0, 1, 5, 6, 7] and kept(2, 0.5) == list(range(8)) and kept(2, 0.4) == [0, 1, 5, 6, 7] and kept(2, 0.0) == kept(2)
    with pytest.raises(ValueError):
        kept(0)


HOLES = np.random.default_rng(7).random((7, 9)) * 5
HOLES[2, 3] = HOLES[6, 8] = NAN


def test_gradient_and_sobel(spark):
    raster = raster_of(spark, HOLES)
    with np.errstate(invalid="ignore"):
        want = np.gradient(HOLES, 1.0)
    assert np.allclose(array_of(rasters.gradient(raster, "y", 1.0)), want[0], equal_nan=True)
    assert np.allclose(array_of(rasters.gradient(raster, "x", 1.0)), want[1], equal_nan=True)
    ramp = raster_of(spark, np.tile(np.arange(8.0), (8, 1)))
    assert np.allclose(array_of(rasters.gradient(ramp, "x")), 0.01)
    sobel = array_of(rasters.sobel(ramp, "x"))
    assert np.isnan(sobel[0]).all() and np.allclose(sobel[1:-1, 1:-1], 8.0)
    with pytest.raises(ValueError):
        rasters.gradient(raster_of(spark, [[1.0], [2.0]]), "x")


def test_percentiles(spark):
    raster = raster_of(spark, HOLES)
    lo, hi = np.nanpercentile(HOLES, [5, 95])
    assert np.allclose(array_of(rasters.normalized(raster, 5, 95)), np.clip((HOLES - lo) / (hi - lo), 0, 1), equal_nan=True)
    assert np.allclose(array_of(rasters.clip(raster, 5, 95)), np.clip(HOLES, lo, hi), equal_nan=True)
    assert (array_of(rasters.normalized(raster_of(spark, np.full((2, 2), 7.0)))) == 1.0).all()
    empty = raster_of(spark, np.full((2, 2), NAN))
    assert np.isnan(array_of(rasters.clip(empty, 1, 2))).all() and np.isnan(array_of(rasters.normalized(empty))).all()
    for call in (lambda: rasters.normalized(raster, 5, 5), lambda: rasters.clip(raster, 6, 5), lambda: rasters.clip(raster, -1, 5)):
        with pytest.raises(ValueError):
            call()
    assert array_of(rasters.clip(raster, 50, 50)).size == 63


def test_pointwise(spark):
    raster = raster_of(spark, [[-1.0, 0.0, 100.0, NAN]])
    assert np.allclose(array_of(rasters.logarithm(raster)), [[NAN, -np.inf, 2.0, NAN]], equal_nan=True)
    assert np.allclose(array_of(rasters.square_root(raster)), [[NAN, 0.0, 10.0, NAN]], equal_nan=True)
    assert np.allclose(array_of(rasters.average([raster, rasters.square(raster)])), [[0.0, 0.0, 5050.0, NAN]], equal_nan=True)
    assert np.allclose(array_of(rasters.norm([raster, raster])), [[math.sqrt(2), 0, math.sqrt(2) * 100, NAN]], equal_nan=True)
    three = raster.select({b: raster.df["v"] * k for k, b in enumerate(("r", "g", "b"), 1)})
    summed = rasters.add([raster, three])
    assert summed.bands == ("r", "g", "b") and np.allclose(array_of(summed, "b"), [[-4.0, 0.0, 400.0, NAN]], equal_nan=True)
    with pytest.raises(ValueError):
        rasters.add([raster])
    with pytest.raises(ValueError):
        rasters.hillshade(three)


def test_hillshade_turns_with_the_light(spark):
    ramp = raster_of(spark, np.tile(np.linspace(0, 10, 10), (10, 1)))
    assert array_of(rasters.hillshade(ramp, 0)).mean() > array_of(rasters.hillshade(ramp, 180)).mean()


def gaussian(a, sigma):
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if d == axis else (0, 0) for d in range(2)]
        wide = np.pad(a, pad, mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, wide)
    return a


@pytest.mark.parametrize("sigma", [0.7, 1.5, 4.0])
def test_smoothing(spark, sigma):
    raster = raster_of(spark, HOLES)
    ok = ~np.isnan(HOLES)
    want = gaussian(np.where(ok, HOLES, 0.0), sigma) / gaussian(ok.astype(float), sigma)
    got = stencil.smooth(raster.df, "v", sigma, raster.size)
    assert np.allclose(array_of(Raster(got, raster.size)), want)


def test_multigrad(spark):
    raster = raster_of(spark, HOLES)
    ok = ~np.isnan(HOLES)
    layers = []
    for sigma in (1.0, 2.0):
        g = np.gradient(gaussian(np.where(ok, HOLES, 0.0), sigma) / gaussian(ok.astype(float), sigma))
        layers.append(sigma * np.hypot(*g))
    assert np.allclose(array_of(rasters.multigrad(raster, [1.0, 2.0])), np.max(layers, axis=0))
    assert np.allclose(array_of(rasters.multigrad(raster, [1.0, 2.0], fuse="mean")), np.mean(layers, axis=0))
    empty = raster_of(spark, np.full((3, 3), NAN))
    assert np.isnan(array_of(rasters.multigrad(empty, [1.0]))).all() and (array_of(rasters.multigrad(empty, [1.0], fuse="sum")) == 0).all()
    masked = rasters.multigradocc(raster, [1.0], threshold=1.0, dilate=1, with_mask=True)
    edge = np.hypot(*np.gradient(np.where(ok, HOLES, 0.0))) >= 1.0
    wide = np.pad(edge, 1)
    grown = np.max([wide[1 + dy : 8 + dy, 1 + dx : 10 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0) | ~ok
    assert (array_of(masked, "mask") == grown).all() and np.isnan(array_of(masked, "v")[grown]).all()
    for bad in ({"sigmas": [0.0]}, {"sigmas": [1.0], "fuse": "stack"}, {"sigmas": [1.0], "axis": "z"}):
        with pytest.raises(ValueError):
            rasters.multigrad(raster, **bad)


def test_red_relief(spark):
    flat = red_relief.relief(raster_of(spark, np.zeros((9, 9))), red_relief.Settings(distance=4))
    assert (array_of(flat.slope) == 0).all() and np.allclose(array_of(flat.structure), 0) and array_of(flat.rgb, "r")[4, 4] == 0.5
    ridge = np.tile([0, 1, 2.5, 1, 0], (5, 1))
    for sign in (1, -1):
        structure = array_of(red_relief.relief(raster_of(spark, sign * ridge), red_relief.Settings(distance=3)).structure)
        assert sign * structure[2, 2] > 0
    broken = np.tile(np.where(np.arange(21) < 10, 0.2 * np.arange(21), 2 + np.arange(21) - 10.0), (11, 1))
    rgb = red_relief.relief(raster_of(spark, broken)).rgb
    assert array_of(rgb, "r")[5, 16] > array_of(rgb, "r")[5, 4] and (array_of(rgb, "g") == array_of(rgb, "b")).all()
    wall = np.zeros((5, 5))
    wall[:, 4], wall[2, 2] = 10, NAN
    parts = red_relief.relief(raster_of(spark, wall), red_relief.Settings(distance=1, directions=4))
    structure = array_of(parts.structure)
    assert np.isnan(structure[2, 2]) and np.allclose(structure[:, 0], 0) and np.isnan(array_of(parts.slope)[2, 1])
    for bad in ({"directions": 0}, {"distance": 0}, {"pixel": (0, 1)}, {"z": 0}, {"red": -1}):
        with pytest.raises(ValueError):
            red_relief.Settings(**bad).checked()
    with pytest.raises(ValueError, match="structure_clip"):
        red_relief.Settings(structure_clip=(5, 1)).checked()


def test_rays():
    assert len(red_relief.rays(8, 16)) == 4 * 16 + 4 * 11 and red_relief.rays(4, 2) == ((0, 0, 1, 1.0), (0, 0, 2, 2.0), (1, 1, 0, 1.0), (1, 2, 0, 2.0), (2, 0, -1, 1.0), (2, 0, -2, 2.0), (3, -1, 0, 1.0), (3, -2, 0, 2.0))


def test_images(spark):
    holes = raster_of(spark, [[1.0, NAN], [3.0, 4.0]])
    assert array_of(images.replace_missing(holes))[0, 1] == 4 and array_of(images.replace_missing(holes, "min"))[0, 1] == 1 and array_of(images.replace_missing(holes, -7.0))[0, 1] == -7
    assert 1 <= array_of(images.replace_missing(holes, "random", 3))[0, 1] <= 4
    for bad in (1, "mean"):
        with pytest.raises(ValueError):
            images.replace_missing(holes, bad)
    assert (array_of(images.to_image(raster_of(spark, np.full((4, 4), NAN)))) == 0).all()
    assert array_of(images.to_image(holes)).tolist() == [[0, 255], [170, 255]]
    assert array_of(images.to_image(raster_of(spark, [[0.0, 0.5, 1.0]]))).tolist() == [[0, 128, 255]]
    with pytest.raises(RuntimeError):
        images.to_image(holes, colormap="viridis")
    assert images.to_image(holes, colormap="gray").bands == ("r", "g", "b")
    three = holes.select({b: holes.df["v"] for b in "rgb"})
    assert np.allclose(array_of(images.to_gray(three)), [[1.0, NAN], [3.0, 4.0]], equal_nan=True)
    assert (array_of(images.to_gray(raster_of(spark, np.full((2, 2), 255.0)), full=255)) == 1).all()
    with pytest.raises(ValueError):
        images.to_gray(holes.select({"a": holes.df["v"], "b": holes.df["v"]}))


@pytest.mark.parametrize("side", [3, 5, 7])
def test_nan_convolution(spark, side):
    a = np.where(np.isnan(HOLES), NAN, HOLES)
    kernel = np.random.default_rng(side).random((side, side))
    h, w = a.shape
    want = np.full(a.shape, NAN)
    c = side // 2
    for y in range(h):
        for x in range(w):
            top = bottom = 0.0
            for i in range(side):
                for j in range(side):
                    yy, xx = y - (i - c), x - (j - c)
                    if 0 <= yy < h and 0 <= xx < w and not np.isnan(a[yy, xx]):
                        top, bottom = top + kernel[i, j] * a[yy, xx], bottom + kernel[i, j]
            want[y, x] = top / bottom if bottom else NAN
    assert np.allclose(array_of(images.nan_convolve(raster_of(spark, a), kernel.tolist())), want, equal_nan=True)
    assert np.allclose(array_of(images.nan_convolve(raster_of(spark, np.full((6, 6), 5e3)), np.ones((side, side)).tolist())), 5e3)


def test_kernel_wheel_and_dip(spark):
    kernel = np.array(images.gaussian_kernel(5, 1.0))
    assert kernel.sum() == pytest.approx(1) and kernel.argmax() == 12
    wheel = images.color_wheel()
    assert len(wheel) == 55 and wheel[0] == (255, 0, 0) and wheel[15] == (255, 255, 0) and wheel[21] == (0, 255, 0) and wheel[25] == (0, 255, 255) and wheel[36] == (0, 0, 255) and wheel[49] == (255, 0, 255)
    rows = {r["point_id"]: r for r in images.dip(cloud(spark, [(1, 0, 1), (0, 0, 2), (0, 0, 0), (0, -3, 0)])).collect()}
    assert rows[0]["dip_angle"] == pytest.approx(math.pi / 4) and rows[1]["dip_angle"] is None and rows[2]["dip_direction"] is None
    assert rows[3]["dip_angle"] == pytest.approx(0, abs=1e-7) and rows[3]["dip_direction"] == pytest.approx(-math.pi / 2)


def test_flow(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, -1.0, 0.0)], "i int, u double, v double")
    out = {r["i"]: (r["r"], r["g"], r["b"]) for r in images.flow_colors(df).collect()}
    assert out[0] == (255, 255, 255) and out[1] == (255, 0, 0) and out[2] == (191, 0, 0)
    with pytest.raises(AssertionError):
        images.flow_image(raster_of(spark, [[1.0]]))


def test_no_point_of_a_tight_cluster_is_lost():
    r = np.random.default_rng(6)
    for size in (1e-3, 1e-6, 1e-9):
        points = np.vstack([r.random((60, 2)) * size, [[1.0, 0.7]], [[-0.4, 1.0]]])
        found = triangulate(points)
        assert set(found.ravel().tolist()) == set(range(len(points)))
        a, b, c = (points[found[:, k]] for k in range(3))
        assert (((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) > 0).all()
