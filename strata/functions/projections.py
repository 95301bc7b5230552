"""Coordinate systems and their way to each other, on NumPy arrays and shape columns: longitude and latitude (EPSG:4326),
web mercator (EPSG:3857) and the UTM zones (EPSG:32601-32660 north, 32701-32760 south), all on WGS84."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import shapes as sh
from .measures import AXIS, FLATTENING, SCALE, utm_zone

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: The series of the transverse Mercator projection to and from the sphere, to the fourth power of n.
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
GEOGRAPHIC, MERCATOR = "EPSG:4326", "EPSG:3857"


def zone_of(crs: str) -> tuple[int, bool] | None:
    """(zone, south) of a UTM system, None for the two others."""
    code = crs.upper().removeprefix("EPSG:")
    if code in ("4326", "3857"):
        return None
    if len(code) == 5 and code.isdigit() and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return int(code[3:]), code[2] == "7"
    raise ValueError(f"unknown system {crs}: EPSG:4326, EPSG:3857 and the UTM zones are there")


def _series(xi: np.ndarray, eta: np.ndarray, terms: tuple, sign: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = xi.copy(), eta.copy()
    for j, a in enumerate(terms, 1):
        x += sign * a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        y += sign * a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return x, y


def from_degrees(lng: np.ndarray, lat: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    zone, lng, lat = zone_of(crs), np.asarray(lng, np.float64), np.asarray(lat, np.float64)
    if zone is None:
        return (lng, lat) if crs.upper() == GEOGRAPHIC else (AXIS * np.radians(lng), AXIS * np.arcsinh(np.tan(np.radians(lat))))
    phi, lam = np.radians(lat), np.radians((lng - (6 * zone[0] - 183) + 180) % 360 - 180)
    t = np.sinh(np.arcsinh(np.tan(phi)) - _E * np.arctanh(_E * np.sin(phi)))  # of the conformal latitude
    xi, eta = _series(np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam))), _TO, 1)
    return 500_000 + SCALE * _RADIUS * eta, (10_000_000 if zone[1] else 0) + SCALE * _RADIUS * xi


def to_degrees(x: np.ndarray, y: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    zone, x, y = zone_of(crs), np.asarray(x, np.float64), np.asarray(y, np.float64)
    if zone is None:
        return (x, y) if crs.upper() == GEOGRAPHIC else (np.degrees(x / AXIS), np.degrees(np.arctan(np.sinh(y / AXIS))))
    xi, eta = _series((y - (10_000_000 if zone[1] else 0)) / (SCALE * _RADIUS), (x - 500_000) / (SCALE * _RADIUS), _FROM, -1)
    goal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    t = goal.copy()
    for _ in range(4):  # Newton's steps from the conformal latitude's tangent to the latitude's; two reach the last digits
        root = np.hypot(1.0, t)
        shift = np.sinh(_E * np.arctanh(_E * t / root))
        now = t * np.hypot(1.0, shift) - shift * root
        t += (goal - now) / np.hypot(1.0, now) * (1 + (1 - _E**2) * t * t) / ((1 - _E**2) * root)
    lng = np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))) + 6 * zone[0] - 183
    return (lng + 180) % 360 - 180, np.degrees(np.arctan(t))


def moved(source: str, target: str):
    """A function of a shape column from one system to another."""
    zone_of(source), zone_of(target)

    @F.arrow_udf(sh.SHAPE)
    def move(shape: pa.Array) -> pa.Array:
        parts = shape.flatten()
        corners = parts.flatten()
        x, y = (np.asarray(corners.field(c).to_numpy(zero_copy_only=False), np.float64) for c in ("x", "y"))
        x, y = from_degrees(*to_degrees(x, y, source), target)
        counts = [pa.array(np.append(0, np.cumsum(sh._lengths(c))), pa.int32()) for c in (shape, parts)]
        inner = pa.ListArray.from_arrays(counts[1], pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
        return pa.ListArray.from_arrays(counts[0], inner, mask=shape.is_null())

    return move


def reprojected(layer: DataFrame, source: str, target: str) -> DataFrame:
    """The layer with its shapes and bounds in another system. Boxes become polygons of their four corners; points stay points."""
    if source.upper() == target.upper():
        return layer
    layer = sh.shaped(layer)
    own = F.col("shape") if "shape" in layer.columns else F.lit(None).cast(sh.SHAPE)
    dim = F.col("dim") if "shape" in layer.columns else sh.box_dim()
    bounds = ("minx", "miny", "maxx", "maxy")
    out = layer.withColumns({"dim": dim, "shape": moved(source, target)(F.coalesce(own, sh.box_shape()))})
    each = lambda c: F.flatten(F.transform("shape", lambda part: F.transform(part, lambda p: p[c])))
    out = out.withColumns({c: (F.array_min if c.startswith("min") else F.array_max)(each(c[-1])) for c in bounds})
    return out.withColumn("shape", F.when(F.col("dim") == 0, None).otherwise(F.col("shape")))


def local_zone(lng: float, lat: float) -> str:
    """The UTM zone of a place."""
    return f"EPSG:32{7 if lat < 0 else 6}{utm_zone(lng):02d}"


# --- the ellipsoid ----------------------------------------------------------------------------------------------------

_B = AXIS * (1 - FLATTENING)
_SECOND = _E**2 / (1 - _E**2)  # the second eccentricity, squared
_AUTHALIC = AXIS**2 / 2 + _B**2 / 2 * math.atanh(_E) / _E  # the squared radius of the sphere of equal area
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _inverse(lng0, lat0, lng1, lat1):
    """Vincenty's iteration for the geodesic between places: length, sine of the azimuth at the equator, the two arcs from there,
    longitude on the sphere, and reduced latitudes. Nearly antipodal places (over 178 degrees) do not settle: NaN."""
    u0, u1 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(v))) for v in (lat0, lat1))
    wide = np.radians((lng1 - lng0 + 180) % 360 - 180)
    lam = wide.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u1) * np.sin(lam), np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * np.cos(lam))
            cos_s = np.sin(u0) * np.sin(u1) + np.cos(u0) * np.cos(u1) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u0) * np.cos(u1) * np.sin(lam) / sin_s, 0.0)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 > 1e-15, cos_s - 2 * np.sin(u0) * np.sin(u1) / cos2, 0.0)
            c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            new = wide + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-13
            lam = new
            if settled.all():
                break
        k = cos2 * _SECOND
        a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        turn = b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        length = np.where(settled | (sin_s == 0), _B * a * (sigma - turn), np.nan)
    alpha = np.arctan2(np.cos(u1) * np.sin(lam), np.cos(u0) * np.sin(u1) - np.sin(u0) * np.cos(u1) * np.cos(lam))
    first = np.arctan2(np.sin(u0), np.cos(u0) * np.cos(alpha))
    return length, sin_a, first, first + sigma, lam, u0, u1


def geodesic_length(lng0, lat0, lng1, lat1) -> np.ndarray:
    """Metres along the ellipsoid."""
    return _inverse(*(np.asarray(v, np.float64) for v in (lng0, lat0, lng1, lat1)))[0]


def _below(lng0, lat0, lng1, lat1) -> np.ndarray:
    """Signed area between a geodesic and the equator: the spherical excess on the sphere of equal area and the integral of
    what the ellipsoid adds, by Gauss and Legendre."""
    _, sin_a, first, last, lam, u0, u1 = _inverse(lng0, lat0, lng1, lat1)
    with np.errstate(invalid="ignore"):
        excess = 2 * np.arctan2(np.tan(lam / 2) * (np.tan(u0 / 2) + np.tan(u1 / 2)), 1 + np.tan(u0 / 2) * np.tan(u1 / 2))
    cos_a = np.sqrt(np.maximum(0.0, 1 - sin_a**2))
    k2 = _SECOND * cos_a**2
    half = (last - first)[:, None] / 2
    sigma = (last + first)[:, None] / 2 + half * _NODES
    t = lambda x: x + np.sqrt(x) * np.sqrt(1 + x) * np.arcsinh(np.sqrt(x)) / np.where(x > 0, x, 1) + (x == 0)
    x = k2[:, None] * np.sin(sigma) ** 2
    gap = _SECOND - x
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(gap > 1e-12, (t(np.float64(_SECOND)) - t(x)) / gap, 0.0)
    inner = -(ratio * np.sin(sigma) / 2 * _WEIGHTS).sum(axis=1) * half[:, 0]
    return _AUTHALIC * excess + _E**2 * AXIS**2 * cos_a * sin_a * inner


def geodesic(s: sh.Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Square metres and metres of shapes in degrees, edges taken as geodesics: within 1e-9 of published values. Rings that
    run round a pole are completed by half the ellipsoid. Holes are rings that lie in an odd number of others."""
    length = np.bincount(s.row, geodesic_length(s.x0, s.y0, s.x1, s.y1), s.rows)[: s.rows] if len(s.row) else np.zeros(s.rows)
    area = np.zeros(s.rows)
    ring = s.dim[s.row] == 2
    if not ring.any():
        return area, length
    x0, y0, x1, y1, row = (v[ring] for v in (s.x0, s.y0, s.x1, s.y1, s.row))
    new = np.append(True, (x0[1:] != x1[:-1]) | (y0[1:] != y1[:-1]) | (row[1:] != row[:-1]))
    part = np.cumsum(new) - 1
    own = np.bincount(part, _below(x0, y0, x1, y1))
    turns = np.round(np.bincount(part, (x1 - x0 + 180) % 360 - 180) / 360)
    whole = 4 * math.pi * _AUTHALIC
    size = np.abs(np.where(turns != 0, whole / 2 - np.abs(own), own))
    head, rows = np.flatnonzero(new), row[new]
    # the depth of a ring: how many other rings of its row hold the middle of its first edge
    n = np.bincount(rows, minlength=s.rows)
    if (n > 1).any():
        mx, my = (x0[head] + x1[head]) / 2, (y0[head] + y1[head]) / 2
        one = sh.Shapes(s.rows, s.x, s.y, s.corner_row, x0, y0, x1, y1, row, s.dim)
        i, j = sh._met(rows, one.starts())
        apart = part[j] != i
        i, j = i[apart], j[apart]
        with np.errstate(divide="ignore", invalid="ignore"):
            below = ((x0[j] > mx[i]) != (x1[j] > mx[i])) & (y0[j] + (y1[j] - y0[j]) * ((mx[i] - x0[j]) / (x1[j] - x0[j])) < my[i])
        odd = np.bincount(i[below], minlength=len(head)) % 2 == 1
        size = np.where(odd, -size, size)
    return np.bincount(rows, size, s.rows)[: s.rows], length


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("area", "length")]))
def geodesic_measures(shape: pa.Array, dim: pa.Array) -> pa.Array:
    """(area, length) in metres of shapes in degrees."""
    area, length = geodesic(sh.flat(shape, dim))
    return pa.StructArray.from_arrays([pa.array(area), pa.array(length)], ["area", "length"])


#: Extents in metres up to which one zone serves a layer: east to west, south to north.
NARROW, TALL = 750_000.0, 2_000_000.0


def in_metres(layer: DataFrame, crs: str | None) -> DataFrame:
    """Sets area and length in metres: of degrees in the UTM zone of the layer's middle if it is small enough for one, else
    along the ellipsoid; other systems keep their own units."""
    if crs is None or crs.upper() != GEOGRAPHIC:
        return layer
    low_x, low_y, high_x, high_y = layer.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()  # one row
    if low_x is None:
        return layer.withColumns({"area": F.lit(0.0), "length": F.lit(0.0)})
    shape = F.coalesce("shape", sh.box_shape()) if "shape" in layer.columns else sh.box_shape()
    dim = F.coalesce("dim", sh.box_dim()) if "shape" in layer.columns else sh.box_dim()
    degree = math.radians(1) * AXIS
    if (high_x - low_x) * degree * math.cos(math.radians((low_y + high_y) / 2)) <= NARROW and (high_y - low_y) * degree <= TALL:
        found = sh.measures(moved(GEOGRAPHIC, local_zone((low_x + high_x) / 2, (low_y + high_y) / 2))(shape), dim)
    else:
        found = geodesic_measures(shape, dim)
    return layer.withColumn("_m", found).withColumns({"area": F.col("_m.area"), "length": F.col("_m.length")}).drop("_m")
