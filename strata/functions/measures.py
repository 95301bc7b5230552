"""Metres from degrees, as columns: universal transverse Mercator on WGS84 and areas and lengths on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The ellipsoid's axis and flattening, the scale on the middle meridian, the mean radius.
AXIS, FLATTENING, SCALE, RADIUS = 6378137.0, 1 / 298.257223563, 0.9996, 6371007.18

_N = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SERIES = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm_zone(lng: float) -> int:
    return min(60, max(1, int(math.floor((lng + 180) / 6)) + 1))


def utm(lng: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres, by the third-order series of the transverse Mercator projection (millimetres within
    a zone's width)."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lng - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_SERIES, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + SCALE * _A * x, (10_000_000 if south else 0) + SCALE * _A * y


def local_utm(layer: DataFrame) -> DataFrame:
    """A layer of points (or box centres) in degrees as points in metres, in the zone of the middle of its bounds. For
    distances between near cells; other columns stay."""
    row = layer.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()  # one row
    if row[0] is None:
        return layer
    x, y = utm((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, utm_zone((row[0] + row[1]) / 2), (row[2] + row[3]) / 2 < 0)
    return layer.withColumns({"minx": x, "maxx": x, "miny": y, "maxy": y})


def box_area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Square metres of a box of degrees on the sphere (within half a percent of the ellipsoid)."""
    return RADIUS**2 * F.radians(maxx - minx) * (F.sin(F.radians(maxy)) - F.sin(F.radians(miny)))


def distance(lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> Column:
    """Metres along the great circle."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(half(lat0, lat1) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half(lng0, lng1)))


def ring_area(ring: Column) -> Column:
    """Square metres of a ring of degrees on the sphere, its edges taken as straight in longitude and sine of latitude."""
    points = F.transform(ring, lambda p: F.struct(F.radians(p["x"]).alias("x"), F.sin(F.radians(p["y"])).alias("y")))
    from ..operators.polygons import area

    return RADIUS**2 * area(points)
