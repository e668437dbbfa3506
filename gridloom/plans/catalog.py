"""Registered queries of the raster engine, and their SQL twins for DuckDB.

The default input is the embeddings as points, ten tiles of 16 x 12 pixels, orthographic
onto x and y, nearest point.  Rasters called *holed* lack the pixels where
``(7 x + 3 y) % 11 = 0``, to see what operators do with missing values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import rasters, red_relief
from ..operators.delaunay import delaunay_triangles
from ..operators.interpolation import Cubic, Delaunay, Interpolation, Linear, Nearest, barycentric, corners, grid, shapes
from ..operators.projection import FieldOfView, Orthographic, Perspective, Projection, Spherical
from ..operators.thinning import thin_points
from ..schema import PIXEL, Raster, Resolution
from ..sources.points import embedding_points, event_points, order_points
from .engine import RasterEngine
from .grammar import enable_red_relief

Query = Callable[[SparkSession, str], DataFrame]
W, H = 16, 12
SIZE = Resolution(W, H)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _round(c: str | Column) -> Column:
    return F.round(c, 6)


def rounded(raster: Raster) -> DataFrame:
    return raster.df.select("tile_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[(_round(b) if dict(raster.df.dtypes)[b] == "double" else F.col(b)).alias(b) for b in raster.bands])


def engine(spark: SparkSession, sf_dir: str, interpolation: Interpolation | None = None, projection: Projection | None = None) -> RasterEngine:
    enable_red_relief()
    return RasterEngine(embedding_points(spark, sf_dir), SIZE, projection or Orthographic("xy"), interpolation or Nearest(), persist=False)


def feature(name: str, interpolation: Interpolation | None = None) -> Query:
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir, interpolation).generate([name])[name])


def holed(spark: SparkSession, sf_dir: str) -> Raster:
    raster = engine(spark, sf_dir).generate(["range"])["range"]
    return raster.select({"v": F.when((7 * F.col("x") + 3 * F.col("y")) % 11 != 0, F.col("v"))})


def on_holed(f: Callable[[Raster], Raster]) -> Query:
    return lambda spark, sf_dir: rounded(f(holed(spark, sf_dir)))


def add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


# What the SQL twins are made of.
PTS = (
    "pts AS (SELECT label::VARCHAR AS tile_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, "
    "embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS intensity FROM embeddings)"
)


def frame_sql(a: str, b: str, src: str = "pts", frame: Sequence[float] | None = None, w: int = W, h: int = H) -> str:
    """uv: the points of src with u, v."""
    bounds = f"SELECT tile_id, min({a}) AS a0, min({b}) AS b0, max({a}) AS a1, max({b}) AS b1 FROM {src} GROUP BY tile_id"
    if frame is not None:
        bounds = f"SELECT DISTINCT tile_id, {frame[0]!r}::DOUBLE AS a0, {frame[1]!r}::DOUBLE AS b0, {frame[2]!r}::DOUBLE AS a1, {frame[3]!r}::DOUBLE AS b1 FROM {src}"
    return (
        f"ext AS ({bounds}), uv AS (SELECT s.*, ({a} - a0) / CASE WHEN a1 = a0 THEN 1 ELSE a1 - a0 END * {w - 1} AS u, "
        f"({b} - b0) / CASE WHEN b1 = b0 THEN 1 ELSE b1 - b0 END * {h - 1} AS v FROM {src} s JOIN ext USING (tile_id))"
    )


GRID = f"grid AS (SELECT tile_id, t.y::INT AS y, s.x::INT AS x FROM (SELECT DISTINCT tile_id FROM pts) d, range({H}) t(y), range({W}) s(x))"
RANGE = "sqrt(p.x * p.x + p.y * p.y + p.z * p.z)"


def near_sql(value: str = RANGE) -> str:
    return (
        f"base AS (SELECT tile_id, y, x, v FROM (SELECT g.tile_id, g.y, g.x, {value} AS v, row_number() OVER (PARTITION BY g.tile_id, g.y, g.x "
        "ORDER BY (p.u - g.x) * (p.u - g.x) + (p.v - g.y) * (p.v - g.y), p.point_id) AS k FROM grid g JOIN uv p USING (tile_id)) WHERE k = 1)"
    )


BASE = f"{PTS}, {frame_sql('x', 'y')}, {GRID}, {near_sql()}"
HOLED = BASE.replace("base AS (", "whole AS (") + ", base AS (SELECT tile_id, y, x, CASE WHEN (7 * x + 3 * y) % 11 <> 0 THEN v END AS v FROM whole)"


def select_sql(value: str, source: str = "base", ctes: str = BASE, more: str = "") -> str:
    return f"WITH RECURSIVE {ctes}{more} SELECT tile_id, y, x, round({value}, 6) + 0.0 AS v FROM {source}"


def slope_sql(axis: str, spacing: float = 1.0, value: str = "v") -> str:
    """A derivative, as a window expression."""
    over = f"OVER (PARTITION BY tile_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"
    n = W if axis == "x" else H
    return (
        f"(CASE WHEN {axis} = 0 THEN (lead({value}) {over} - {value}) / {spacing!r} WHEN {axis} = {n - 1} THEN ({value} - lag({value}) {over}) / {spacing!r} "
        f"ELSE (lead({value}) {over} - lag({value}) {over}) / {2 * spacing!r} END)"
    )


# Projections.
def projected(projection: Projection) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return projection.project(embedding_points(spark, sf_dir), SIZE).select("tile_id", "point_id", _round("u").alias("u"), _round("v").alias("v"))

    return query


_UV = "SELECT tile_id, point_id, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM uv"
for _plane in ("xy", "yz", "xz"):
    add(f"proj_ortho_{_plane}", projected(Orthographic(_plane)), f"WITH {PTS}, {frame_sql(*_plane)} {_UV}")
ROI = (-0.1, -0.15, 0.12, 0.1)
add(
    "proj_ortho_roi", projected(Orthographic("xy", ROI)),
    f"WITH {PTS}, seen AS (SELECT * FROM pts WHERE x BETWEEN {ROI[0]} AND {ROI[2]} AND y BETWEEN {ROI[1]} AND {ROI[3]}), {frame_sql('x', 'y', 'seen', ROI)} {_UV}",
)
ANGLES = f"angles AS (SELECT *, atan2(y, x) AS hh, acos(z / sqrt(x * x + y * y + z * z)) AS vv FROM pts)"  # noqa: F541
add("proj_spherical", projected(Spherical()), f"WITH {PTS}, {ANGLES}, {frame_sql('hh', 'vv', 'angles')} {_UV}")
FOV = FieldOfView(-1.0, 1.5, 0.8, 2.2)
_FRAME = (FOV.left, FOV.top, FOV.right, FOV.bottom)
add(
    "proj_spherical_fov", projected(Spherical(FOV)),
    f"WITH {PTS}, {ANGLES}, seen AS (SELECT * FROM angles WHERE hh BETWEEN {FOV.left} AND {FOV.right} AND vv BETWEEN {FOV.top} AND {FOV.bottom}), {frame_sql('hh', 'vv', 'seen', _FRAME)} {_UV}",
)
K = ((20.0, 0.0, 8.0), (0.0, 18.0, 6.0), (0.0, 0.0, 1.0))
EYE = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
TURN = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))


def camera_sql(r: Sequence[Sequence[float]], t: Sequence[float]) -> str:
    row = lambda m, a: " + ".join(f"({c!r} * {n})" for c, n in zip(m, a, strict=True))
    camera = ", ".join(f"{row(r[i], 'xyz')} + {float(t[i])!r} AS c{i}" for i in range(3))
    return (
        f"WITH {PTS}, cam AS (SELECT *, {camera} FROM pts), img AS (SELECT *, ({row(K[0], ('c0', 'c1', 'c2'))}) / c2 AS u, ({row(K[1], ('c0', 'c1', 'c2'))}) / c2 AS v FROM cam WHERE c2 > 0), "
        f"uv AS (SELECT * FROM img WHERE u >= 0 AND u < {W} AND v >= 0 AND v < {H}) {_UV}"
    )


add("proj_perspective", projected(Perspective(K, EYE)), camera_sql(EYE, (0, 0, 0)))
add("proj_perspective_translated", projected(Perspective(K, TURN, (0.05, -0.1, 0.6))), camera_sql(TURN, (0.05, -0.1, 0.6)))


def inverse_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = holed(spark, sf_dir)
    return Spherical(FOV).inverse(raster).select(*PIXEL, *[_round(c).alias(c) for c in ("px", "py", "pz")])


_H = f"({FOV.left!r} + x * ({FOV.right - FOV.left!r} / {W - 1}))"
_V = f"({FOV.top!r} + y * ({FOV.bottom - FOV.top!r} / {H - 1}))"
add(
    "inverse_spherical", inverse_spherical,
    f"WITH {HOLED} SELECT tile_id, y, x, round(v * sin({_V}) * cos({_H}), 6) + 0.0 AS px, round(v * sin({_V}) * sin({_H}), 6) + 0.0 AS py, round(v * cos({_V}), 6) + 0.0 AS pz FROM base WHERE v IS NOT NULL",
)

# Interpolation.
add("nearest_range", feature("range"), select_sql("v"))
add("nearest_scalar_field", feature("scalar_field_intensity"), select_sql("v", ctes=BASE.replace(near_sql(), near_sql("p.intensity"))))
add("fallback_scalar_name", feature("intensity"), _SQL["nearest_scalar_field"])


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embedding_points(spark, sf_dir)
    valued = points.select("*", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("range"))
    return Orthographic("xy").project(valued, SIZE)


CIRCLE = (
    "((a.u-d.u)*(a.u-d.u)+(a.v-d.v)*(a.v-d.v)) * ((b.u-d.u)*(c.v-d.v)-(b.v-d.v)*(c.u-d.u)) - ((b.u-d.u)*(b.u-d.u)+(b.v-d.v)*(b.v-d.v)) * ((a.u-d.u)*(c.v-d.v)-(a.v-d.v)*(c.u-d.u)) "
    "+ ((c.u-d.u)*(c.u-d.u)+(c.v-d.v)*(c.v-d.v)) * ((a.u-d.u)*(b.v-d.v)-(a.v-d.v)*(b.u-d.u))"
)
TRI = (
    "trip AS (SELECT a.tile_id, a.point_id AS a, b.point_id AS b, c.point_id AS c, a.u AS ua, a.v AS va, b.u AS ub, b.v AS vb, c.u AS uc, c.v AS vc, "
    "(b.u-a.u)*(c.v-a.v)-(b.v-a.v)*(c.u-a.u) AS turn FROM uv a JOIN uv b ON a.tile_id = b.tile_id AND a.point_id < b.point_id JOIN uv c ON a.tile_id = c.tile_id AND b.point_id < c.point_id), "
    "tri AS (SELECT t.* FROM trip t WHERE abs(turn) > 1e-12 AND NOT EXISTS (SELECT 1 FROM uv d WHERE d.tile_id = t.tile_id AND d.point_id <> t.a AND d.point_id <> t.b AND d.point_id <> t.c AND sign(t.turn) * ("
    + CIRCLE.replace("a.u", "t.ua").replace("a.v", "t.va").replace("b.u", "t.ub").replace("b.v", "t.vb").replace("c.u", "t.uc").replace("c.v", "t.vc")
    + ") > 1e-10))"
)
UVS = f"{PTS}, {frame_sql('x', 'y')}"
add("delaunay_triangles", lambda spark, sf_dir: delaunay_triangles(placed(spark, sf_dir)), f"WITH {UVS}, {TRI} SELECT tile_id, a, b, c FROM tri")


def weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = placed(spark, sf_dir)
    out = barycentric(delaunay_triangles(points), points, SIZE)
    return out.select("tile_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "a", "b", "c", *[_round(c).alias(c) for c in ("wa", "wb", "wc")])


def bary_sql(triangles: str) -> str:
    turn = lambda p, q, r: f"(({q}u-{p}u)*({r}v-{p}v)-({q}v-{p}v)*({r}u-{p}u))"
    named = lambda p, q, r: turn(*[f"{k}_" for k in (p, q, r)])
    sql = (
        f"hit AS (SELECT g.tile_id, g.y, g.x, a, b, c, {named('b', 'c', 'g')} / turn AS wa, {named('c', 'a', 'g')} / turn AS wb, {named('a', 'b', 'g')} / turn AS wc FROM {triangles} t JOIN grid g USING (tile_id)), "
        "bary AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, y, x ORDER BY a, b, c) AS k FROM hit WHERE wa >= -1e-9 AND wb >= -1e-9 AND wc >= -1e-9) WHERE k = 1)"
    )
    for k in "abc":
        sql = sql.replace(f"{k}_u", f"t.u{k}").replace(f"{k}_v", f"t.v{k}")
    return sql.replace("g_u", "g.x").replace("g_v", "g.y")


add("barycentric_weights", weights_query, f"WITH {UVS}, {GRID}, {TRI}, {bary_sql('tri')} SELECT tile_id, y, x, a, b, c, round(wa, 6) + 0.0 AS wa, round(wb, 6) + 0.0 AS wb, round(wc, 6) + 0.0 AS wc FROM bary")


def corners_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = placed(spark, sf_dir)
    out = corners(points, SIZE, points.select("tile_id").distinct()).where("a IS NOT NULL")
    return out.select("tile_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "a", "b", "c", *[_round(f"d{c}").alias(f"d{c}") for c in "abc"])


add(
    "triangle_corners", corners_query,
    f"WITH {UVS}, {GRID}, {TRI}, {bary_sql('tri')} SELECT k.tile_id, k.y, k.x, k.a, k.b, k.c, round(sqrt((p.u - k.x) * (p.u - k.x) + (p.v - k.y) * (p.v - k.y)), 6) AS da, "
    "round(sqrt((q.u - k.x) * (q.u - k.x) + (q.v - k.y) * (q.v - k.y)), 6) AS db, round(sqrt((r.u - k.x) * (r.u - k.x) + (r.v - k.y) * (r.v - k.y)), 6) AS dc FROM bary k "
    "JOIN uv p ON p.tile_id = k.tile_id AND p.point_id = k.a JOIN uv q ON q.tile_id = k.tile_id AND q.point_id = k.b JOIN uv r ON r.tile_id = k.tile_id AND r.point_id = k.c",
)
VALUE = (
    "base AS (SELECT g.tile_id, g.y, g.x, wa * ra.r + wb * rb.r + wc * rc.r AS v FROM grid g LEFT JOIN bary USING (tile_id, y, x) "
    "LEFT JOIN val ra ON ra.tile_id = g.tile_id AND ra.point_id = a LEFT JOIN val rb ON rb.tile_id = g.tile_id AND rb.point_id = b LEFT JOIN val rc ON rc.tile_id = g.tile_id AND rc.point_id = c)"
)
VAL = f"val AS (SELECT tile_id, point_id, {RANGE} AS r FROM pts p)"
LINEAR = f"{UVS}, {GRID}, {TRI}, {bary_sql('tri')}, {VAL}, {VALUE}"
add("linear_range", feature("range", Linear()), select_sql("v", ctes=LINEAR))
EDGE = lambda p, q: f"sqrt((u{p}-u{q})*(u{p}-u{q})+(v{p}-v{q})*(v{p}-v{q}))"


def culled_sql(by_area: bool) -> str:
    area = "AND area < mid_area * 10.0" if by_area else ""
    return (
        f"{UVS}, {GRID}, {TRI}, sides AS (SELECT *, {EDGE('a', 'b')} AS e1, {EDGE('b', 'c')} AS e2, {EDGE('c', 'a')} AS e3 FROM tri), "
        "shape AS (SELECT *, sqrt(greatest(0.0, (e1+e2+e3)/2 * ((e1+e2+e3)/2-e1) * ((e1+e2+e3)/2-e2) * ((e1+e2+e3)/2-e3))) AS area, greatest(e1,e2,e3) / greatest(least(e1,e2,e3), 2.220446049250313e-16) AS aspect FROM sides), "
        "mid AS (SELECT tile_id, median(area) AS mid_area, median(aspect) AS mid FROM shape GROUP BY tile_id), "
        "dev AS (SELECT tile_id, median(abs(aspect - mid)) AS mad FROM shape JOIN mid USING (tile_id) GROUP BY tile_id), "
        f"good AS (SELECT s.* FROM shape s JOIN mid USING (tile_id) JOIN dev USING (tile_id) WHERE aspect <= CASE WHEN mad > 0 THEN mid + 6.0 * mad ELSE mid * 10.0 END {area}), "
        f"{bary_sql('good')}, {VAL}, {VALUE}"
    )


add("delaunay_culled", feature("range", Delaunay()), select_sql("v", ctes=culled_sql(True)))
add("delaunay_no_area_cull", feature("range", Delaunay(area_scale=None)), select_sql("v", ctes=culled_sql(False)))
add("cubic_range", feature("range", Cubic()))


def triangle_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = placed(spark, sf_dir)
    out = shapes(delaunay_triangles(points), points)
    return out.select("tile_id", "a", "b", "c", _round("area").alias("area"), F.round("aspect", 4).alias("aspect"))


add("triangle_shapes", triangle_shapes, f"WITH {culled_sql(True)} SELECT tile_id, a, b, c, round(area, 6) AS area, round(aspect, 4) AS aspect FROM shape")


def thin_query(source: Callable[[SparkSession, str], DataFrame], most: int, ratio: float | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = Orthographic("xy").project(source(spark, sf_dir), Resolution(32, 24))
        return thin_points(points, Resolution(32, 24), most, ratio).select("tile_id", "point_id")

    return query


def thin_sql(pts: str, most: int, keep: str = "") -> str:
    return (
        f"WITH pts AS ({pts}), {frame_sql('x', 'y', w=32, h=24)}, ranked AS (SELECT tile_id, point_id, row_number() OVER (PARTITION BY tile_id, greatest(0, least(31, floor(u))), greatest(0, least(23, floor(v))) "
        f"ORDER BY point_id) AS k, count(*) OVER (PARTITION BY tile_id) AS n FROM uv) SELECT tile_id, point_id FROM ranked WHERE k <= {most}{keep}"
    )


_ORD = "SELECT o_orderstatus AS tile_id, o_orderkey AS point_id, o_custkey::DOUBLE AS x, (o_orderdate::DATE - DATE '1992-01-01')::DOUBLE AS y, o_totalprice::DOUBLE AS z FROM orders"
_EVT = "SELECT event_type AS tile_id, event_id AS point_id, floor(epoch(ts))::DOUBLE AS x, user_id::DOUBLE AS y, value::DOUBLE AS z FROM events"
add("thin_points", thin_query(order_points, 4, None), thin_sql(_ORD, 4))
add("thin_points_ratio", thin_query(event_points, 2, 3.0), thin_sql(_EVT, 2, " OR n <= 3.0 * 32 * 24"))

# Derived rasters.
GX, GY = slope_sql("x"), slope_sql("y")
add("gradient_x_range", feature("gradient_x_range"), select_sql(slope_sql("x", 100.0)))
add("gradient_y_range_px1", feature("gradient_y_range_px1"), select_sql(GY))
add("gradient_x_linear", feature("gradient_x_range_px1", Linear()), select_sql(GX, ctes=LINEAR))
add("gradient_x_holed", on_holed(lambda r: rasters.gradient(r, "x", 1.0)), select_sql(GX, ctes=HOLED))


def sobel_sql(axis: str, ctes: str) -> str:
    one, two = ("x", "y") if axis == "x" else ("y", "x")
    cells = ", ".join(f"(({i}), ({j}), {i * (2 - abs(j))})" for i in (-1, 0, 1) for j in (-1, 0, 1))
    return (
        f"WITH {ctes}, k(di, dj, w) AS (VALUES {cells}), conv AS (SELECT b.tile_id, b.y, b.x, CASE WHEN count(n.v) = 9 THEN sum(w * n.v) END AS v FROM base b CROSS JOIN k "
        f"LEFT JOIN base n ON n.tile_id = b.tile_id AND n.{one} = b.{one} + di AND n.{two} = b.{two} + dj GROUP BY b.tile_id, b.y, b.x) SELECT tile_id, y, x, round(v, 6) + 0.0 AS v FROM conv"
    )


add("sobel_x_range", feature("sobel_x_range"), sobel_sql("x", BASE))
add("sobel_y_range", feature("sobel_y_range"), sobel_sql("y", BASE))
add("sobel_x_holed", on_holed(lambda r: rasters.sobel(r, "x")), sobel_sql("x", HOLED))


def percent_sql(low: float, high: float) -> str:
    return f", q AS (SELECT tile_id, quantile_cont(v, {low / 100}) AS lo, quantile_cont(v, {high / 100}) AS hi FROM base GROUP BY tile_id)"


_NORMAL = "CASE WHEN v IS NULL THEN NULL ELSE greatest(0.0, least(1.0, CASE WHEN hi <> lo THEN (v - lo) / (hi - lo) ELSE v END)) END"
_CLIP = "CASE WHEN v IS NULL THEN NULL ELSE greatest(lo, least(hi, v)) END"
_WITHQ = "base JOIN q USING (tile_id)"
add("normalized_range", feature("normalized_range"), select_sql(_NORMAL, _WITHQ, more=percent_sql(0, 100)))
add("normalized_range_5_95", feature("normalized_range_5_95"), select_sql(_NORMAL, _WITHQ, more=percent_sql(5, 95)))
add("normalized_holed", on_holed(lambda r: rasters.normalized(r, 10, 80)), select_sql(_NORMAL, _WITHQ, HOLED, percent_sql(10, 80)))
add("clip_range_5_95", feature("clip_range_5_95"), select_sql(_CLIP, _WITHQ, more=percent_sql(5, 95)))
add("log_range", feature("log_range"), select_sql("log10(v)"))
add("square_range", feature("square_range"), select_sql("v * v"))
add("sqrt_range", feature("sqrt_range"), select_sql("sqrt(v)"))
add("sqrt_scalar_negative", feature("sqrt_intensity"), select_sql("CASE WHEN v >= 0 THEN sqrt(v) END", ctes=BASE.replace(near_sql(), near_sql("p.intensity"))))
add("log_scalar_negative", feature("log_square_intensity"), select_sql("log10(v * v)", ctes=BASE.replace(near_sql(), near_sql("p.intensity"))))


def shade_sql(ctes: str = BASE, az: float = 315.0, alt: float = 45.0, z: float = 1.0) -> str:
    gy, gx = slope_sql("y", 1.0, "(v * " + repr(z) + ")"), slope_sql("x", 1.0, "(v * " + repr(z) + ")")
    shade = (
        f"sin(radians({alt!r})) * sin(pi() / 2 - atan(sqrt(gy * gy + gx * gx))) + cos(radians({alt!r})) * cos(pi() / 2 - atan(sqrt(gy * gy + gx * gx))) * cos(radians({az!r}) - atan2(-gy, gx))"
    )
    return select_sql(shade, "slopes", ctes, f", slopes AS (SELECT tile_id, y, x, {gy} AS gy, {gx} AS gx FROM base)")


add("hillshade", feature("hillshade"), shade_sql())
add("hillshade_range_0_30_2", feature("hillshade_range_0_30_2"), shade_sql(az=0.0, alt=30.0, z=2.0))
add("hillshade_linear", feature("hillshade_range_315_45", Linear()), shade_sql(LINEAR))
_TWO = f", two AS (SELECT tile_id, y, x, v, {slope_sql('x', 100.0)} AS gx, {slope_sql('y', 100.0)} AS gy FROM base)"
add("average_pair", feature("average_(range,gradient_x_range)"), select_sql("(v + gx) / 2", "two", more=_TWO))
add("sum_pair", feature("sum_(range,gradient_x_range)"), select_sql("v + gx", "two", more=_TWO))
add("norm_gradients", feature("norm_(gradient_x_range,gradient_y_range)"), select_sql("sqrt(gx * gx + gy * gy)", "two", more=_TWO))
add("average_nested", feature("average_(range,sum_(range,range),square_range)", Linear()), select_sql("(v + (v + v) + v * v) / 3", ctes=LINEAR))
add("normalized_clip_chain", feature("normalized_clip_range_5_95_0_100"), select_sql(
    "greatest(0.0, least(1.0, CASE WHEN h2 <> l2 THEN (c - l2) / (h2 - l2) ELSE c END))", "clipped JOIN q2 USING (tile_id)",
    more=percent_sql(5, 95) + f", clipped AS (SELECT tile_id, y, x, {_CLIP} AS c FROM {_WITHQ}), q2 AS (SELECT tile_id, min(c) AS l2, max(c) AS h2 FROM clipped GROUP BY tile_id)",
))
add("gradient_of_gradient", feature("gradient_x_gradient_y_range_px1"), select_sql(
    slope_sql("x", 1.0, "g"), "inner_", more=f", inner_ AS (SELECT tile_id, y, x, {slope_sql('y', 100.0)} AS g FROM base)"
))


def gauss_sql(source: str, name: str, sigma: float) -> str:
    """name: smoothed v and weight of source."""
    r = int(4 * sigma + 0.5)

    def mirror(c: str, n: int) -> str:
        p = f"(((({c} + k.j) % {2 * n}) + {2 * n}) % {2 * n})"
        return f"CASE WHEN {p} < {n} THEN {p} ELSE {2 * n - 1} - {p} END"

    return (
        f", {name}_k AS (SELECT j, w / sum(w) OVER () AS w FROM (SELECT j, exp(-0.5 * (j / {sigma!r}) * (j / {sigma!r})) AS w FROM range({-r}, {r + 1}) t(j))), "
        f"{name}_y AS (SELECT g.tile_id, g.y, g.x, sum(k.w * coalesce(b.v, 0.0)) AS s, sum(k.w * (b.v IS NOT NULL)::INT) AS m FROM {source} g CROSS JOIN {name}_k k JOIN {source} b ON b.tile_id = g.tile_id AND b.x = g.x AND b.y = {mirror('g.y', H)} GROUP BY ALL), "
        f"{name}_x AS (SELECT g.tile_id, g.y, g.x, sum(k.w * b.s) AS s, sum(k.w * b.m) AS m FROM {name}_y g CROSS JOIN {name}_k k JOIN {name}_y b ON b.tile_id = g.tile_id AND b.y = g.y AND b.x = {mirror('g.x', W)} GROUP BY ALL), "
        f"{name} AS (SELECT tile_id, y, x, CASE WHEN m > 1e-5 THEN s / m ELSE 0.0 END AS v, m FROM {name}_x)"
    )


def multi_sql(sigmas: Sequence[float], fuse: str, scaled: bool, axis: str | None, ctes: str) -> str:
    more, layers = "", []
    for k, sigma in enumerate(sigmas):
        more += gauss_sql("base", f"s{k}", sigma)
        part = slope_sql(axis) if axis else f"sqrt({GX} * {GX} + {GY} * {GY})"
        layers.append(f"SELECT tile_id, y, x, CASE WHEN m > 1e-5 THEN {part} * {sigma if scaled else 1.0!r} END AS v FROM s{k}")
    value = {"max": "max(v)", "mean": "avg(v)", "sum": "coalesce(sum(v), 0.0)"}[fuse]
    return f"WITH {ctes}{more}, layers AS ({' UNION ALL '.join(layers)}) SELECT tile_id, y, x, round({value}, 6) + 0.0 AS v FROM layers GROUP BY tile_id, y, x"


add("multigrad_max", feature("multigrad_range_1-2"), multi_sql([1.0, 2.0], "max", True, None, BASE))
add("multigrad_mean_raw", feature("multigrad_range_0.8-1.5_mean_raw"), multi_sql([0.8, 1.5], "mean", False, None, BASE))
add("multigrad_x_sum", feature("multigrad_x_range_1-3_sum"), multi_sql([1.0, 3.0], "sum", True, "x", BASE))
add("multigrad_holed", on_holed(lambda r: rasters.multigrad(r, [1.0, 2.0])), multi_sql([1.0, 2.0], "max", True, None, HOLED))


def occluded_sql(sigma: float, threshold: float, dilate: int, soft: float | None, ctes: str) -> str:
    filled = f", filled AS (SELECT tile_id, y, x, v AS kept, coalesce(v, 0.0) AS v FROM base), edge AS (SELECT tile_id, y, x, kept, sqrt({GX} * {GX} + {GY} * {GY}) >= {threshold!r} AS e FROM filled)"
    hidden = (
        f", occ AS (SELECT a.tile_id, a.y, a.x, any_value(a.kept) AS kept, bool_or(b.e) OR any_value(a.kept) IS NULL AS hid FROM edge a JOIN edge b ON a.tile_id = b.tile_id "
        f"AND abs(a.y - b.y) <= {dilate} AND abs(a.x - b.x) <= {dilate} GROUP BY a.tile_id, a.y, a.x), seen AS (SELECT tile_id, y, x, CASE WHEN NOT hid THEN kept END AS v FROM occ)"
    )
    part = f"sqrt({GX} * {GX} + {GY} * {GY}) * {sigma!r}"
    gate = "CASE WHEN NOT hid THEN part END" if soft is None else f"CASE WHEN hid THEN part * {soft!r} ELSE part END"
    return f"WITH {ctes}{filled}{hidden}{gauss_sql('seen', 's', sigma)}, parts AS (SELECT tile_id, y, x, m, {part} AS part FROM s) SELECT tile_id, y, x, round(CASE WHEN m > 1e-5 THEN {gate} END, 6) + 0.0 AS v FROM parts JOIN occ USING (tile_id, y, x)"


add("multigradocc_hard", feature("multigradocc_range_1_thresh0.08"), occluded_sql(1.0, 0.08, 1, None, BASE))
add("multigradocc_soft", feature("multigradocc_range_1.5_thresh0.1_dilate0_soft0.4"), occluded_sql(1.5, 0.1, 0, 0.4, BASE))
add("multigradocc_holed", on_holed(lambda r: rasters.multigradocc(r, [1.0], threshold=0.3, dilate=1)), occluded_sql(1.0, 0.3, 1, None, HOLED))

# Red relief.
def ray_values(directions: int, distance: int) -> str:
    """The distinct steps of each ray, as VALUES."""
    out = []
    for ray in range(directions):
        seen = []
        for step in range(1, distance + 1):
            place = (round(math.sin(2 * math.pi * ray / directions) * step), round(math.cos(2 * math.pi * ray / directions) * step))
            if place != (0, 0) and place not in seen:
                seen.append(place)
        out += [f"({ray}, ({dy}), ({dx}), sqrt(({dy * dy + dx * dx})::DOUBLE))" for dy, dx in seen]
    return ", ".join(out)


def relief_ctes(ctes: str, directions: int = 8, distance: int = 4, z: float = 1.0) -> str:
    return (
        f"{ctes}, rays(ray, dy, dx, far) AS (VALUES {ray_values(directions, distance)}), "
        f"sample AS (SELECT b.tile_id, b.y, b.x, ray, max(degrees(atan2((n.v - b.v) * {z!r}, far))) AS up, max(degrees(atan2((b.v - n.v) * {z!r}, far))) AS down FROM base b CROSS JOIN rays JOIN base n ON n.tile_id = b.tile_id "
        "AND n.y = b.y - dy AND n.x = b.x - dx WHERE b.v IS NOT NULL AND n.v IS NOT NULL GROUP BY b.tile_id, b.y, b.x, ray), "
        "opened AS (SELECT tile_id, y, x, avg(90.0 - up) AS positive, avg(90.0 - down) AS negative FROM sample GROUP BY tile_id, y, x), "
        "pack AS (SELECT b.tile_id, b.y, b.x, positive, negative, 0.5 * (positive - negative) AS structure FROM base b LEFT JOIN opened USING (tile_id, y, x)), "
        f"filled AS (SELECT tile_id, y, x, v AS kept, coalesce(v * {z!r}, 0.0) AS v FROM base), "
        f"steep AS (SELECT s.tile_id, s.y, s.x, CASE WHEN NOT EXISTS (SELECT 1 FROM filled n WHERE n.tile_id = s.tile_id AND n.kept IS NULL AND abs(n.y - s.y) + abs(n.x - s.x) <= 1) THEN sqrt(gx * gx + gy * gy) END AS slope FROM (SELECT tile_id, y, x, {GX} AS gx, {GY} AS gy FROM filled) s)"
    )


RELIEF = relief_ctes(BASE)
HOLED_RELIEF = relief_ctes(HOLED)
_SET = red_relief.Settings(distance=4)
add("rr_slope", feature("rrim_component_(slope,range,r4)"), f"WITH {RELIEF} SELECT tile_id, y, x, round(slope, 6) + 0.0 AS v FROM steep")
for _part in ("positive", "negative", "structure"):
    add(f"rr_{_part}", feature(f"rrim_component_({_part},range,r4)"), f"WITH {RELIEF} SELECT tile_id, y, x, round({_part}, 6) + 0.0 AS v FROM pack")
_PACK = "round(positive, 6) + 0.0 AS positive, round(negative, 6) + 0.0 AS negative, round(structure, 6) + 0.0 AS structure"
add("rr_pack", feature("rrim_pack_(range,r4,d8,z1)"), f"WITH {RELIEF} SELECT tile_id, y, x, {_PACK} FROM pack")
add("rr_pack_odd_directions", feature("rrim_pack_(range,r3,d5,z2)"), f"WITH {relief_ctes(BASE, 5, 3, 2.0)} SELECT tile_id, y, x, {_PACK} FROM pack")
add("rr_pack_holed", on_holed(lambda r: red_relief.pack(r, _SET)), f"WITH {HOLED_RELIEF} SELECT tile_id, y, x, {_PACK} FROM pack")
add("rr_slope_holed", on_holed(lambda r: red_relief.slope(r, _SET)), f"WITH {HOLED_RELIEF} SELECT tile_id, y, x, round(slope, 6) + 0.0 AS v FROM steep")


def composite_sql(ctes: str, red: float = 1.0) -> str:
    return (
        f"WITH {ctes}, qs AS (SELECT tile_id, quantile_cont(slope, 0.02) AS sl, quantile_cont(slope, 0.98) AS sh FROM steep GROUP BY tile_id), "
        "qo AS (SELECT tile_id, quantile_cont(structure, 0.02) AS ol, quantile_cont(structure, 0.98) AS oh FROM pack GROUP BY tile_id), "
        "norm AS (SELECT tile_id, y, x, CASE WHEN structure IS NULL THEN NULL WHEN oh > ol THEN greatest(0.0, least(1.0, (structure - ol) / (oh - ol))) ELSE 0.5 END AS g, "
        "CASE WHEN slope IS NULL THEN 0.0 WHEN sh > sl THEN greatest(0.0, least(1.0, (slope - sl) / (sh - sl))) ELSE 0.0 END AS s FROM pack JOIN steep USING (tile_id, y, x) JOIN qs USING (tile_id) JOIN qo USING (tile_id)) "
        f"SELECT tile_id, y, x, round(CASE WHEN g IS NOT NULL THEN greatest(0.0, least(1.0, g + {red!r} * s * (1.0 - g))) END, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(g, 6) + 0.0 AS b FROM norm"
    )


add("rr_rgb", feature("rrim_(range,r4)"), composite_sql(RELIEF))
add("rr_rgb_z4_red05", feature("rrim_(range,r4,z4,red0.5)"), composite_sql(relief_ctes(BASE, 8, 4, 4.0), 0.5))
add("rr_rgb_holed", on_holed(lambda r: red_relief.relief(r, _SET).rgb), composite_sql(HOLED_RELIEF))

# Images.
KERNEL = [[1.0, 2.0, 0.0], [0.5, 4.0, 1.0], [0.0, 1.0, 3.0]]


def convolve_sql(kernel: Sequence[Sequence[float]]) -> str:
    cells = ", ".join(f"(({i - len(kernel) // 2}), ({j - len(kernel[0]) // 2}), {w!r}::DOUBLE)" for i, row in enumerate(kernel) for j, w in enumerate(row))
    return (
        f"WITH {HOLED}, k(dy, dx, w) AS (VALUES {cells}), conv AS (SELECT b.tile_id, b.y, b.x, sum(w * n.v) FILTER (WHERE n.v IS NOT NULL) / nullif(sum(w) FILTER (WHERE n.v IS NOT NULL), 0) AS v FROM base b CROSS JOIN k "
        "LEFT JOIN base n ON n.tile_id = b.tile_id AND n.y = b.y - dy AND n.x = b.x - dx GROUP BY b.tile_id, b.y, b.x) SELECT tile_id, y, x, round(v, 6) + 0.0 AS v FROM conv"
    )


add("nanconv_3x3", on_holed(lambda r: images.nan_convolve(r, KERNEL)), convolve_sql(KERNEL))
add("nanconv_gaussian_5", on_holed(lambda r: images.nan_convolve(r, images.gaussian_kernel(5, 1.2))), convolve_sql([[math.exp(-((i - 2) ** 2 + (j - 2) ** 2) / (2 * 1.44)) for j in range(5)] for i in range(5)]))


def kernel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = images.gaussian_kernel(5, 1.0)
    rows = [(i, j, kernel[i][j]) for i in range(5) for j in range(5)]
    return spark.createDataFrame(rows, "i int, j int, w double").select("i", "j", F.round("w", 9).alias("w"))


add("gaussian_kernel_5", kernel_query, "SELECT i::INT AS i, j::INT AS j, round(w / sum(w) OVER (), 9) AS w FROM (SELECT i, j, exp(-0.5 * ((i - 2) * (i - 2) + (j - 2) * (j - 2))) AS w FROM range(5) a(i), range(5) b(j))")
for _policy, _value in (("max", "max(v) OVER (PARTITION BY tile_id)"), ("min", "min(v) OVER (PARTITION BY tile_id)"), (-7.0, "-7.0")):
    add(f"replace_nan_{_policy if isinstance(_policy, str) else 'literal'}", on_holed(lambda r, p=_policy: images.replace_missing(r, p)), select_sql(f"coalesce(v, {_value})", ctes=HOLED))


def rgb(spark: SparkSession, sf_dir: str) -> Raster:
    return engine(spark, sf_dir).generate(["rrim_(range,r4)"])["rrim_(range,r4)"]


_RGB = composite_sql(RELIEF).replace(" + 0.0 AS ", " AS ").replace("round(", "(").replace(", 6)", ")")
add("to_gray_rgb", lambda spark, sf_dir: rounded(images.to_gray(rgb(spark, sf_dir))), f"SELECT tile_id, y, x, round(0.299 * r + 0.587 * g + 0.114 * b, 6) + 0.0 AS v FROM ({_RGB})")
_STATS = "stats AS (SELECT tile_id, min(f) AS lo, max(f) AS hi FROM filled GROUP BY tile_id)"
_FILL = f"filled AS (SELECT tile_id, y, x, coalesce(v, max(v) OVER (PARTITION BY tile_id)) AS f FROM base), {_STATS}"
_BYTE = "SELECT tile_id, y, x, floor(CASE WHEN {stretch} THEN CASE WHEN hi > lo THEN (f - lo) / (hi - lo) ELSE 0.0 END ELSE f END * 255.0 + 0.5)::INT AS v FROM filled JOIN stats USING (tile_id)"
add("to_uint8", on_holed(images.to_image), f"WITH {HOLED}, {_FILL} " + _BYTE.format(stretch="lo < 0 OR hi > 1"))
add("to_uint8_normalized", on_holed(lambda r: images.to_image(r, normalize=True)), f"WITH {HOLED}, {_FILL} " + _BYTE.format(stretch="TRUE"))


def dip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.dip(embedding_points(spark, sf_dir)).select("tile_id", "point_id", _round("dip_angle").alias("dip_angle"), _round("dip_direction").alias("dip_direction"))


add(
    "dip_angles", dip_query,
    f"WITH {PTS}, unit AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM pts) SELECT tile_id, point_id, round(acos(least(1.0, ((x/n)*(x/n) + (y/n)*(y/n)) / sqrt((x/n)*(x/n) + (y/n)*(y/n)))), 6) + 0.0 AS dip_angle, round(atan2(y / n, x / n), 6) + 0.0 AS dip_direction FROM unit",
)


def flow(spark: SparkSession, sf_dir: str) -> Raster:
    made = engine(spark, sf_dir).generate(["gradient_x_range_px1", "gradient_y_range_px1"])
    both = made["gradient_x_range_px1"].df.withColumnRenamed("v", "u").join(made["gradient_y_range_px1"].df, list(PIXEL))
    return Raster(both, SIZE, ("u", "v"))


def colors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flow(spark, sf_dir)
    return images.flow_colors(f.df.select(*PIXEL, (F.col("u") * 4).alias("u"), (F.col("v") * 4).alias("v"))).select(*PIXEL, "r", "g", "b")


# The wheel from its arcs' lengths, in SQL: each arc one channel up or down.
WHEEL = (
    "arcs(a, first, n) AS (VALUES (0, 0, 15), (1, 15, 6), (2, 21, 4), (3, 25, 11), (4, 36, 13), (5, 49, 6)), "
    "steps AS (SELECT a, (first + k)::INT AS i, floor(255.0 * k / n) AS up FROM arcs, range(15) t(k) WHERE k < n), "
    "wheel AS (SELECT i, CASE a WHEN 0 THEN 255 WHEN 1 THEN 255 - up WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN up ELSE 255 END / 255.0 AS wr, "
    "CASE a WHEN 0 THEN up WHEN 1 THEN 255 WHEN 2 THEN 255 WHEN 3 THEN 255 - up ELSE 0 END / 255.0 AS wg, CASE a WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN up WHEN 3 THEN 255 WHEN 4 THEN 255 ELSE 255 - up END / 255.0 AS wb FROM steps)"
)


def colors_sql(source: str, ctes: str) -> str:
    mix = lambda c: f"((1 - p) * a.w{c} + p * b.w{c})"
    channel = lambda c: f"floor(255 * CASE WHEN far <= 1 THEN 1 - far * (1 - {mix(c)}) ELSE {mix(c)} * 0.75 END)::INT AS {c}"
    return (
        f"WITH {ctes}, {WHEEL}, polar AS (SELECT tile_id, y, x, sqrt(u * u + v * v) AS far, (atan2(-v, -u) / pi() + 1) / 2 * 54 AS fk FROM {source}), "
        f"cut AS (SELECT *, floor(fk)::INT AS k0, fk - floor(fk) AS p FROM polar) SELECT tile_id, y, x, {channel('r')}, {channel('g')}, {channel('b')} FROM cut JOIN wheel a ON a.i = k0 JOIN wheel b ON b.i = (k0 + 1) % 55"
    )


_FLOW = f"{BASE}, flow AS (SELECT tile_id, y, x, {GX} AS u, {GY} AS v FROM base)"
add("flow_colors", colors_query, colors_sql("scaled", f"{_FLOW}, scaled AS (SELECT tile_id, y, x, u * 4 AS u, v * 4 AS v FROM flow)"))


def flow_sql(most: str, clip: float | None = None) -> str:
    held = "u, v" if clip is None else f"greatest(0.0, least({clip!r}, u)) AS u, greatest(0.0, least({clip!r}, v)) AS v"
    return colors_sql(
        "unit",
        f"{_FLOW}, held AS (SELECT tile_id, y, x, {held} FROM flow), sized AS (SELECT *, sqrt(u * u + v * v) AS far FROM held), top AS (SELECT tile_id, {most} AS most FROM sized GROUP BY tile_id), "
        "unit AS (SELECT tile_id, y, x, u / (far + 1e-5) * least(1.0, far / most) AS u, v / (far + 1e-5) * least(1.0, far / most) AS v FROM sized JOIN top USING (tile_id))",
    )


add("flow_image", lambda spark, sf_dir: images.flow_image(flow(spark, sf_dir)).df, flow_sql("max(far)"))
add("flow_image_quantile", lambda spark, sf_dir: images.flow_image(flow(spark, sf_dir), quantile=0.9).df, flow_sql("quantile_cont(far, 0.9)"))
add("flow_image_clipped", lambda spark, sf_dir: images.flow_image(flow(spark, sf_dir), clip=0.05).df, flow_sql("max(far)", 0.05))


# Several features of one run.
def tiled_multi_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["range", "gradient_x_range", "hillshade_range_315_45"]
    made = engine(spark, sf_dir).generate(names)
    out = None
    for name in names:
        rows = rounded(made[name]).select(F.lit(name).alias("feature"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_SHADE = shade_sql()
add(
    "tiled_multi_feature", tiled_multi_feature,
    f"SELECT 'range' AS feature, * FROM ({select_sql('v')}) UNION ALL SELECT 'gradient_x_range', * FROM ({select_sql(slope_sql('x', 100.0))}) UNION ALL SELECT 'hillshade_range_315_45', * FROM ({_SHADE})",
)


def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(embedding_points(spark, sf_dir).select("tile_id").distinct(), SIZE)


add("pixel_grid", pixel_grid, f"WITH {PTS}, {GRID} SELECT tile_id, y, x FROM grid")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["hillshade"](spark, sf_dir)


