"""Sun, view and reflectance geometry as columns. Angles are in degrees, azimuths clockwise from north."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str | float
Vector = tuple[Column, Column, Column]


def _c(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def unit_enu(zenith: ColumnLike, azimuth: ColumnLike) -> Vector:
    """East, north and up parts of a direction."""
    z, a = F.radians(_c(zenith)), F.radians(_c(azimuth))
    return F.sin(a) * F.sin(z), F.cos(a) * F.sin(z), F.cos(z)


def angles(v: Vector) -> tuple[Column, Column]:
    """Zenith and azimuth (0 to 360) of a vector whose up part is clipped to [-1, 1]."""
    e, n, u = v
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u)))), F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def bisector(sun: Vector, view: Vector) -> Vector:
    """The normal that mirrors sun into view."""
    s = [x + y for x, y in zip(sun, view, strict=True)]
    size = F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2])
    return tuple(x / size for x in s)


def required_orientation(sun_zen: ColumnLike, sun_az: ColumnLike, view_zen: ColumnLike, view_az: ColumnLike) -> tuple[Column, Column]:
    """Tilt and azimuth of the panel that would glint."""
    return angles(bisector(unit_enu(sun_zen, sun_az), unit_enu(view_zen, view_az)))


def misalignment(tilt: ColumnLike, azimuth: ColumnLike, sun: Vector, view: Vector) -> Column:
    """Angle between the sun's mirror image in a panel and the view."""
    n = unit_enu(tilt, azimuth)
    twice = 2 * dot(sun, n)
    mirrored = tuple(twice * x - s for x, s in zip(n, sun, strict=True))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(mirrored, view)))))


#: What `facing` returns: the panel that would glint, its normal (n), and the directions of sun (s) and view (v).
FACING = ("tilt", "az", "ne", "nn", "nu", "se", "sn", "su", "ve", "vn", "vu")


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in FACING]))
def facing(sun_zen: pa.Array, sun_az: pa.Array, view_zen: pa.Array, view_az: pa.Array) -> pa.Array:
    """required_orientation with all its directions, by the C library's functions, for a few distinct angles.

    Whole degrees put many scenes exactly at a tolerance, where the last digit decides. The JVM's sine and arc tangent differ
    from the C library's there.
    """

    def direction(zen: float, az: float) -> tuple[float, float, float]:
        z, a = math.radians(zen), math.radians(az)
        return math.sin(a) * math.sin(z), math.cos(a) * math.sin(z), math.cos(z)

    def one(sz, sa, vz, va):
        if None in (sz, sa, vz, va) or not all(map(math.isfinite, (sz, sa, vz, va))):
            return None
        sun, view = direction(sz, sa), direction(vz, va)
        e, n, u = (x + y for x, y in zip(sun, view, strict=True))
        size = math.sqrt(e * e + n * n + u * u)
        if size == 0:
            return None
        tilt, az = math.degrees(math.acos(max(-1.0, min(1.0, u / size)))), math.degrees(math.atan2(e, n))
        az -= 360.0 * math.floor(az / 360.0)
        return dict(zip(FACING, (tilt, az, *direction(tilt, az), *sun, *view), strict=True))

    rows = zip(*[c.to_pylist() for c in (sun_zen, sun_az, view_zen, view_az)], strict=True)
    return pa.array([one(*r) for r in rows], pa.struct([(n, pa.float64()) for n in FACING]))


def least_cosine(degrees: float) -> float:
    """The smallest cosine whose angle is at most so many degrees, to the last digit."""
    lo, hi = -1.0, 1.0
    if math.degrees(math.acos(lo)) <= degrees:
        return lo
    while math.nextafter(lo, hi) < hi:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if math.degrees(math.acos(mid)) <= degrees else (mid, hi)
    return hi


def reflectance(dn: ColumnLike, offset: float = 1000.0, scale: float = 10_000.0) -> Column:
    return F.greatest((_c(dn) - offset) / scale, F.lit(0.0))


def with_provider_offset(dn: ColumnLike, applied: ColumnLike) -> Column:
    """Digital numbers on one footing: providers that took the offset off get it back."""
    return _c(dn) + F.when(_c(applied), F.lit(1000)).otherwise(F.lit(0))


def ndvi(nir: ColumnLike, red: ColumnLike) -> Column:
    return (_c(nir) - _c(red)) / F.greatest(_c(nir) + _c(red), F.lit(1e-6))


def scene_ndvi(nir: ColumnLike, red: ColumnLike) -> Column:
    """Null where both bands are dark."""
    return F.when(_c(nir) + _c(red) > 0, ndvi(nir, red))


def circular_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180, F.lit(360.0)) - 180


def sun_position(lat: ColumnLike, lon: ColumnLike, time: ColumnLike) -> tuple[Column, Column]:
    """Zenith and azimuth of the sun by the low-precision almanac (about 0.01 degrees); time in UTC."""
    d = F.unix_micros(_c(time)) / F.lit(86_400e6) - F.lit(10_957.5)  # days from 2000-01-01 12:00
    anomaly = F.radians(F.pmod(357.529 + 0.98560028 * d, F.lit(360.0)))
    mean = F.pmod(280.459 + 0.98564736 * d, F.lit(360.0))
    longitude = F.radians(mean + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.00000036 * d)
    ascension = F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))
    declination = F.asin(F.sin(tilt) * F.sin(longitude))
    sidereal = F.pmod(18.697375 + 24.065709824279 * d, F.lit(24.0)) * 15
    hour = F.radians(sidereal + _c(lon)) - ascension
    phi = F.radians(_c(lat))
    up = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour)
    east = -F.cos(declination) * F.sin(hour)
    north = F.cos(phi) * F.sin(declination) - F.sin(phi) * F.cos(declination) * F.cos(hour)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))), F.pmod(F.degrees(F.atan2(east, north)), F.lit(2 * math.pi * 180 / math.pi))
