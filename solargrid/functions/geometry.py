"""Geometry as columns: rings are array<array<struct<x, y>>>, boxes are four columns, points are lon and lat."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solargrid.schemas import POINT

#: WGS84: semi-major axis and flattening; metres in a degree for box sizes.
A, INVERSE_F = 6_378_137.0, 298.257223563
E2 = (2 - 1 / INVERSE_F) / INVERSE_F
E1 = math.sqrt(E2)
QP = 1 - (1 - E2) / (2 * E1) * math.log((1 - E1) / (1 + E1))
DEGREE_M = 111_320.0


def _q(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def equal_area(lon: Column, lat: Column, parallel: float = 30.0) -> tuple[Column, Column]:
    """Cylindrical equal-area metres (EPSG:6933)."""
    p = math.radians(parallel)
    k0 = math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    return F.radians(lon) * (A * k0), _q(lat) * (A / (2 * k0))




def _ring_sum(rings: Column, term) -> Column:
    """Sum of term(ax, ay, bx, by) over all edges of all rings."""
    pairs = F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: term(a["x"], a["y"], b["x"], b["y"]))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def geodesic_area_m2(rings: Column) -> Column:
    """Area on the ellipsoid by the equal-area projection's shoelace; holes subtract if wound the other way. 0 for null."""

    # Coordinates count from the first point, so that the products of a small polygon keep their digits.
    ox, oy = equal_area(F.get(F.get(rings, F.lit(0)), F.lit(0))["x"], F.get(F.get(rings, F.lit(0)), F.lit(0))["y"])

    def term(ax, ay, bx, by):
        (x1, y1), (x2, y2) = equal_area(ax, ay), equal_area(bx, by)
        return ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2

    return F.coalesce(F.abs(_ring_sum(rings, term)), F.lit(0.0))


def centroid(rings: Column) -> tuple[Column, Column]:
    """Shoelace centroid in degrees."""
    ox, oy = F.get(F.get(rings, F.lit(0)), F.lit(0))["x"], F.get(F.get(rings, F.lit(0)), F.lit(0))["y"]
    cross = lambda ax, ay, bx, by: (ax - ox) * (by - oy) - (bx - ox) * (ay - oy)
    area = _ring_sum(rings, cross)
    cx = _ring_sum(rings, lambda ax, ay, bx, by: (ax + bx - 2 * ox) * cross(ax, ay, bx, by))
    cy = _ring_sum(rings, lambda ax, ay, bx, by: (ay + by - 2 * oy) * cross(ax, ay, bx, by))
    return ox + cx / (3 * area), oy + cy / (3 * area)


def bounds(rings: Column) -> dict[str, Column]:
    xs, ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"]))), F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def contains_xy(rings: Column, x: Column, y: Column) -> Column:
    """Ray cast: inside if an odd number of edges lies to the right of the point."""
    crossings = _ring_sum(rings, lambda ax, ay, bx, by: F.when(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1.0).otherwise(0.0))
    return crossings % 2 == 1


def representative_point(rings: Column) -> tuple[Column, Column]:
    """A point inside: the middle of the widest span at mid height."""
    b = bounds(rings)
    mid = (b["ymin"] + b["ymax"]) / 2
    cross = F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, c: F.when((a["y"] > mid) != (c["y"] > mid), a["x"] + (mid - a["y"]) * (c["x"] - a["x"]) / (c["y"] - a["y"])))))
    xs = F.array_sort(F.array_compact(cross))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("x")))
    return F.array_max(spans)["x"], mid


def lon_metres(lat: Column) -> Column:
    """Metres in a degree of longitude."""
    return DEGREE_M * F.cos(F.radians(lat))


def box_rings(lon: Column, lat: Column, area: Column) -> Column:
    """A square of an area around a point, as rings."""
    h = half_sides(area, lat)
    corner = lambda i, j: F.struct((lon + i * h[0]).alias("x"), (lat + j * h[1]).alias("y"))
    return F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))


def half_sides(area: Column, lat: Column) -> tuple[Column, Column]:
    """Half the side of a square of an area at a latitude, in degrees of longitude and latitude."""
    return F.sqrt(area) / 2 / lon_metres(lat), F.sqrt(area) / 2 / DEGREE_M


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def utm_code(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32_600).otherwise(32_700) + F.floor((lon + 180) / 6).cast("int") + 1


def _krueger() -> tuple:
    n = 1 / (2 * INVERSE_F - 1)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    lat = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, forward, back, lat


def to_utm(lon: Column, lat: Column, code: Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series (millimetres within a zone)."""
    n, radius, forward, _, _ = _krueger()
    centre = (code % 100 - 1) * 6 - 177
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    d = F.radians(lon - centre)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    e, y = eta, xi
    for j, a in enumerate(forward, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * e, F.when(code >= 32_700, 1e7).otherwise(0.0) + 0.9996 * radius * y


def from_utm(east: Column, north: Column, code: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres."""
    _, radius, _, back, series = _krueger()
    xi = (north - F.when(code >= 32_700, 1e7).otherwise(0.0)) / (0.9996 * radius)
    eta = (east - 500_000) / (0.9996 * radius)
    x, e = xi, eta
    for j, b in enumerate(back, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(series, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (code % 100 - 1) * 6 - 177 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)


def cell(value: Column, origin: float, size: float = 0.1) -> Column:
    """Half-open cell number."""
    return F.floor((value - origin) / size).cast("int")


def cell_key(ix: Column, iy: Column) -> Column:
    return F.format_string("%04d_%04d", ix, iy)


def snapped_origin(origin: Column, anchor: Column, size: float = 0.1) -> Column:
    """The origin moved down to fall on the anchor's grid."""
    return anchor + F.floor((origin - anchor) / size) * size


def city_box(lon: Column, lat: Column, radius_km: float) -> dict[str, Column]:
    dy = F.lit(radius_km / 111.32)
    dx = dy / F.cos(F.radians(lat))
    return {"xmin": lon - dx, "ymin": lat - dy, "xmax": lon + dx, "ymax": lat + dy}


def chip_id(lon: Column, lat: Column) -> Column:
    return F.substring(F.sha1(F.format_string("%.5f_%.5f", lon, lat).cast("binary")), 1, 12)


def south_gap(axis: Column) -> Column:
    """Least circular distance of the two normals of an axis from south."""
    gap = lambda a: F.abs(F.pmod(a - 180 + 180, F.lit(360.0)) - 180)
    return F.least(gap(axis + 90), gap(axis + 270))


def _points(rings) -> np.ndarray:
    p = np.array([(q["x"], q["y"]) for q in rings[0]])
    return p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = np.unique(p, axis=0)
    half = []
    for points in (p, p[::-1]):
        chain: list = []
        for q in points:
            while len(chain) > 1 and np.cross(chain[-1] - chain[-2], q - chain[-2]) <= 0:
                chain.pop()
            chain.append(q)
        half += chain[:-1]
    return np.array(half)


@F.pandas_udf(T.DoubleType())
def long_axis_bearing(rings: pd.Series) -> pd.Series:
    """Bearing (0 to 180) of the longest side of the least rectangle around a polygon, by rotating over its hull."""
    out = []
    for r in rings:
        if r is None:
            out.append(None)
            continue
        h = _hull(_points(r))
        best = None
        for d in np.roll(h, -1, axis=0) - h:
            d = d / np.hypot(*d)
            u, v = h @ d, h @ np.array([-d[1], d[0]])
            w, k = np.ptp(u), np.ptp(v)
            if best is None or w * k < best[0]:
                best = (w * k, d if w >= k else np.array([-d[1], d[0]]))
        out.append(float(np.degrees(np.arctan2(best[1][0], best[1][1])) % 180))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(POINT))
def simplified(rings: pd.Series) -> pd.Series:
    """Douglas-Peucker on the outer ring with a tolerance of 0.03, three decimals."""
    out = []
    for r in rings:
        if r is None:
            out.append(None)
            continue
        p = np.array([(q["x"], q["y"]) for q in r[0]])
        keep = np.zeros(len(p), dtype=bool)
        keep[[0, -1]] = True
        stack = [(0, len(p) - 1)]
        while stack:
            i, j = stack.pop()
            if j < i + 2:
                continue
            d = p[j] - p[i]
            size = np.hypot(*d)
            away = np.abs(d[0] * (p[i + 1 : j, 1] - p[i, 1]) - d[1] * (p[i + 1 : j, 0] - p[i, 0])) / size if size else np.hypot(*(p[i + 1 : j] - p[i]).T)
            k = int(away.argmax())
            if away[k] > 0.03:
                keep[i + 1 + k] = True
                stack += [(i, i + 1 + k), (i + 1 + k, j)]
        out.append([{"x": round(float(x), 3), "y": round(float(y), 3)} for x, y in p[keep]])
    return pd.Series(out)
