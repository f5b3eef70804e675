"""Geometry as column expressions: points are struct<x,y>, polylines and rings arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
#: WGS84 in a zone: semi-major axis, flattening, scale, false easting, false northing of the south.
_A, _F, _K0, _E0, _SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10_000_000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series to the fourth order.
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def utm(lon: Column, lat: Column, zone: int = 31, south: bool = False) -> Column:
    """Degrees to a zone, by Krüger's series to the fourth order."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return point(_E0 + _K0 * _RECT * east, _K0 * _RECT * north + _SOUTH * south)


def utm_inverse(x: Column, y: Column, zone: int = 31, south: bool = False) -> Column:
    """A zone to degrees: a point of x = longitude, y = latitude."""
    xi0, eta0 = (y - _SOUTH * south) / (_K0 * _RECT), (x - _E0) / (_K0 * _RECT)
    xi = xi0 - sum((b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    eta = eta0 - sum((b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return point((6 * zone - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi))


def utm31(lon: Column, lat: Column) -> Column:
    return utm(lon, lat, 31)


def utm31_inverse(x: Column, y: Column) -> Column:
    return utm_inverse(x, y, 31)


def utm_sql(lon: str, lat: str, source: str, zone: int = 31) -> str:
    """The same projection as SQL: the columns of ``source`` with ux, uy, as common table expressions u0 to u3."""
    e, k = 2 * math.sqrt(_N) / (1 + _N), _K0 * _RECT
    east = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
    north = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
    return f"""u0 AS (SELECT *, radians({lat}) AS phi, radians({lon} - {6 * zone - 183}) AS lam FROM {source}), u1 AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS th FROM u0),
      u2 AS (SELECT *, atan2(th, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + th * th)) AS eta FROM u1), u3 AS (SELECT *, {_E0!r} + {k!r} * (eta + {east}) AS ux, {k!r} * (xi + {north}) AS uy FROM u2)"""


def mercator(lon: Column, lat: Column) -> Column:
    """Degrees to the spherical web projection."""
    return point(_A * F.radians(lon), _A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))


def mercator_inverse(x: Column, y: Column) -> Column:
    """The spherical web projection to degrees: a point of x = longitude, y = latitude."""
    return point(F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_to_pixel(x: Column, y: Column, affine: tuple[float, ...]) -> Column:
    """(col, row) of a place under (a, b, c, d, e, f); truncates toward zero."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    col, row = (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det
    return F.struct(col.cast("int").alias("col"), row.cast("int").alias("row"))


def pixel_to_geo(col: Column, row: Column, affine: tuple[float, ...]) -> Column:
    a, b, c, d, e, f = affine
    return point(a * col + b * row + c, d * col + e * row + f)


def segment_lengths(pts: Column) -> Column:
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def length(pts: Column) -> Column:
    return F.aggregate(segment_lengths(pts), F.lit(0.0), lambda s, v: s + v)


def flatten_lines(parts: Column) -> Column:
    """A multi-line as one line: coordinates one after another."""
    return F.flatten(parts)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring, closed or not."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def bounds(pts: Column, margin: float = 0.0) -> Column:
    """Extent with ``margin`` times its larger side on all sides."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    m = margin * F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return F.struct((F.array_min(xs) - m).alias("minx"), (F.array_min(ys) - m).alias("miny"), (F.array_max(xs) + m).alias("maxx"), (F.array_max(ys) + m).alias("maxy"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring, by the crossings of a ray to the right; on the left and lower sides counts."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, nxt, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def strictly_inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring and not on its line."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def on(p, q):
        within = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return within & ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"]))

    return inside(x, y, ring) & ~F.exists(F.zip_with(ring, nxt, on), lambda c: c)


def any_vertex_within(pts: Column, minx, miny, maxx, maxy) -> Column:
    """Whether any vertex is strictly within a box."""
    return F.exists(pts, lambda p: (p["x"] > minx) & (p["x"] < maxx) & (p["y"] > miny) & (p["y"] < maxy))


def point_segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    d2 = dx * dx + dy * dy
    t = F.when(d2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / F.nullif(d2, F.lit(0.0)))))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def side_of_line(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 left, -1 right, 0 on the line."""
    return F.signum((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Angle of two vectors in radians, null for a zero vector."""
    d = F.nullif(F.hypot(ux, uy) * F.hypot(vx, vy), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / d)))


def line_intersection(p1, p2, q1, q2) -> Column:
    """Where the lines through two pairs of points meet and whether that is within both segments; null if parallel."""
    rx, ry, sx, sy = p2["x"] - p1["x"], p2["y"] - p1["y"], q2["x"] - q1["x"], q2["y"] - q1["y"]
    det = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = ((q1["x"] - p1["x"]) * sy - (q1["y"] - p1["y"]) * sx) / det, ((q1["x"] - p1["x"]) * ry - (q1["y"] - p1["y"]) * rx) / det
    return F.when(det.isNotNull(), F.struct((p1["x"] + t * rx).alias("x"), (p1["y"] + t * ry).alias("y"), (t.between(0, 1) & u.between(0, 1)).alias("within")))


def extend_segment(p: Column, q: Column, distance: float) -> Column:
    """A segment made longer by ``distance`` at both ends."""
    n = F.nullif(F.hypot(q["x"] - p["x"], q["y"] - p["y"]), F.lit(0.0))
    ux, uy = (q["x"] - p["x"]) / n * distance, (q["y"] - p["y"]) / n * distance
    return F.array(point(p["x"] - ux, p["y"] - uy), point(q["x"] + ux, q["y"] + uy))


def arc(x: Column, y: Column, radius: Column, start: Column, end: Column, steps: int = 100, extra: float = 0.05) -> Column:
    """Points on a circle from ``start`` to ``end`` (radians), ``extra`` beyond both."""
    sign = F.when(end >= start, 1.0).otherwise(-1.0)
    a, b = start - sign * extra, end + sign * extra
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: point(x + radius * F.cos(a + (b - a) * i / (steps - 1)), y + radius * F.sin(a + (b - a) * i / (steps - 1))))


def frame_of(p: Column, q: Column, r: Column) -> Column:
    """``r`` in the frame where p is the origin and q lies on the positive x axis."""
    a = F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    dx, dy = r["x"] - p["x"], r["y"] - p["y"]
    return point(dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a))
