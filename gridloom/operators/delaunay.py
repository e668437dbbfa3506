"""Delaunay triangulation of one tile's points, and as a DataFrame operator.

Points are inserted one by one, in rounds of doubling size, each along a Hilbert curve, so
that the next point is a short walk away from the last one.  The triangles whose circumcircle
holds the new point are found from the one that the walk ends in, and give way to a fan:
about n log n steps for n points.  The outside is covered by triangles with a ghost
corner, one on each hull edge, so there is no artificial outer triangle to distort the hull.
Ties are decided by the order of insertion, which follows from the points alone.

What is a tie is relative to the size of the determinants' terms.  If a point would be lost
by that, or a triangle be flat, the tile is done again with exact signs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A determinant counts as zero up to this share of its terms.
TINY = 1e-13
#: Points of the first round of insertion.
FIRST = 64


class _Tie(ArithmeticError):
    """Signs within the tolerance don't suffice."""


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of a, b, c."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def triangulate(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise triangles of point indices; none if all points are on a line.  Points must differ."""
    n = len(points)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    # A power of two: the coordinates keep all their digits.
    p = np.ldexp(points, -int(np.frexp(max(float(np.abs(points - points.mean(axis=0)).max()), 1e-300))[1]))
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    turn = _turn(p[0], p[far], p)
    third = int(np.argmax(np.abs(turn)))
    if abs(turn[third]) <= 1e-12:
        return np.empty((0, 3), dtype=np.int64)
    first = (0, far, third) if turn[third] > 0 else (0, third, far)
    order = [k for k in insertion_order(p).tolist() if k not in first]
    try:
        return _inserted(p, first, order, exact=False)
    except _Tie:
        return _inserted(p, first, order, exact=True)


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """Places along the Hilbert curve of a square of 2^bits cells a side."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(bits - 1, -1, -1):
        right, upper = (x >> k) & 1, (y >> k) & 1
        out = (out << 2) | ((3 * right) ^ upper)
        flip = (upper == 0) & (right == 1)
        x, y = np.where(flip, ~x, x), np.where(flip, ~y, y)
        x, y = np.where(upper == 0, y, x), np.where(upper == 0, x, y)
    return out


def insertion_order(p: np.ndarray) -> np.ndarray:
    """All points: random rounds (of a fixed seed), each twice the one before, by place on the curve."""
    low = p.min(axis=0)
    cells = ((p - low) / max(float((p - low).max()), 1e-300) * 65535).astype(np.int64)
    shuffled = np.random.Generator(np.random.PCG64(len(p))).permutation(len(p))
    turn = np.zeros(len(p), dtype=np.int64)
    turn[shuffled] = np.frexp(np.arange(len(p)) // FIRST)[1]
    return np.lexsort((np.arange(len(p)), hilbert(cells[:, 0], cells[:, 1]), turn))


def _whole(p: np.ndarray) -> list[tuple[int, int]]:
    """The coordinates as integers of one scale, without any rounding."""
    ratios = [(float(x).as_integer_ratio(), float(y).as_integer_ratio()) for x, y in p]
    scale = max(max(x[1], y[1]) for x, y in ratios)  # denominators are powers of two
    return [(x[0] * (scale // x[1]), y[0] * (scale // y[1])) for x, y in ratios]


def _inserted(p: np.ndarray, first: tuple[int, int, int], order: list[int], exact: bool) -> np.ndarray:
    """The triangles after all points are inserted; without exact signs, _Tie if those within the tolerance don't suffice."""
    n = ghost = len(p)
    m = n + 1
    xs, ys = p[:, 0].tolist(), p[:, 1].tolist()
    whole = _whole(p) if exact else []
    #: The third corner of the triangle on the left of each edge, an edge (a, b) being a * m + b.
    apex: dict[int, int] = {}

    def put(a: int, b: int, c: int) -> None:
        apex[a * m + b], apex[b * m + c], apex[c * m + a] = c, a, b

    def side(a: int, b: int, q: int) -> int:
        """The sign of the turn a, b, q."""
        x, y = xs[q], ys[q]
        left, right = (xs[a] - x) * (ys[b] - y), (ys[a] - y) * (xs[b] - x)
        value, least = left - right, TINY * (abs(left) + abs(right))
        if value > least:
            return 1
        if value < -least:
            return -1
        if not exact:
            return 0
        (ax, ay), (bx, by), (x, y) = whole[a], whole[b], whole[q]
        value = (ax - x) * (by - y) - (ay - y) * (bx - x)
        return (value > 0) - (value < 0)

    def holds(a: int, b: int, c: int, q: int) -> bool:
        """Whether the circle of a, b, c holds q; a ghost triangle's is the half-plane outside its edge, and the edge."""
        if a == ghost:
            a, b, c = b, c, a
        elif b == ghost:
            a, b, c = c, a, b
        if c == ghost:
            sign = side(a, b, q)
            return sign > 0 or sign == 0 and (xs[a] - xs[q]) * (xs[b] - xs[q]) + (ys[a] - ys[q]) * (ys[b] - ys[q]) < 0
        x, y = xs[q], ys[q]
        ax, ay, bx, by, cx, cy = xs[a] - x, ys[a] - y, xs[b] - x, ys[b] - y, xs[c] - x, ys[c] - y
        s, t, u = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, cb, ca, ac, ab, ba = bx * cy, by * cx, cx * ay, cy * ax, ax * by, ay * bx
        value = s * (bc - cb) + t * (ca - ac) + u * (ab - ba)
        least = TINY * (s * (abs(bc) + abs(cb)) + t * (abs(ca) + abs(ac)) + u * (abs(ab) + abs(ba)))
        if value > least:
            return True
        if value < -least or not exact:
            return False
        x, y = whole[q]
        (ax, ay), (bx, by), (cx, cy) = ((whole[k][0] - x, whole[k][1] - y) for k in (a, b, c))
        return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    def walk(a: int, b: int, q: int) -> tuple[int, int]:
        """From the triangle left of (a, b) across edges that have q on the other side; an edge of the last triangle."""
        if side(a, b, q) < 0:
            a, b = b, a
        for _ in range(4 * n + 16):
            c = apex[a * m + b]
            if c == ghost:
                return a, b
            if side(b, c, q) < 0:
                a, b = c, b
            elif side(c, a, q) < 0:
                a, b = a, c
            else:
                return a, b
        raise _Tie

    a, b, c = first
    for corners in ((a, b, c), (b, a, ghost), (c, b, ghost), (a, c, ghost)):
        put(*corners)
    for q in order:
        a, b = walk(a, b, q)
        c = apex[a * m + b]
        if not holds(a, b, c, q):
            raise _Tie
        del apex[a * m + b], apex[b * m + c], apex[c * m + a]
        edges, rim = [(a, b), (b, c), (c, a)], []
        while edges:
            u, v = edges.pop()
            w = apex.get(v * m + u)
            if w is None:  # across it is a triangle that is gone
                continue
            if holds(v, u, w, q):
                del apex[v * m + u], apex[u * m + w], apex[w * m + v]
                edges += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            if u != ghost and v != ghost:
                if side(u, v, q) <= 0:
                    raise _Tie
                a, b = u, v
            put(u, v, q)
    found = [(e // m, e % m, c) for e, c in apex.items() if e // m < e % m and e // m < c and ghost not in (e % m, c)]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def weights_of(points: np.ndarray, triangle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The barycentric weights of positions in one triangle, or each in its own."""
    a, b, c = np.moveaxis(points[triangle], -2, 0)
    whole = _turn(a, b, c)
    wa, wb = _turn(b, c, at) / whole, _turn(c, a, at) / whole
    return np.stack([wa, wb, 1 - wa - wb], axis=-1)


TRIANGLES = "tile_id string, a bigint, b bigint, c bigint"


def _of_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("point_id").drop_duplicates(["u", "v"])
    ids = pdf["point_id"].to_numpy()
    found = np.sort(ids[triangulate(pdf[["u", "v"]].to_numpy(dtype=float))], axis=1)
    return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0] if len(pdf) else "", "a": found[:, 0], "b": found[:, 1], "c": found[:, 2]})


def delaunay_triangles(points: DataFrame) -> DataFrame:
    """``tile_id`` and the ids ``a < b < c`` of every triangle's corners; of points at one place the first counts.

    A triangulation is global to its tile, so a tile is the unit of work; tiles spread over the
    cluster, and 100,000 points of one tile take about ten seconds.
    """
    return points.select("tile_id", "point_id", "u", "v").groupBy("tile_id").applyInPandas(_of_tile, TRIANGLES)

