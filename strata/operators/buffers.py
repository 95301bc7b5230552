"""Buffers of points, lines and polygons: every edge becomes a band with round ends, and the union of all bands (and of the
polygon itself) is drawn anew from the pieces of their borders that no other band covers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import projections as pr
from . import mapping as mp
from . import shapes as sh
from .union import oriented

RESOLUTION = 8  # sides of a quarter circle


def _bands(s: sh.Shapes, distance: float, resolution: int):
    """(x0, y0, x1, y1, row, region) of the borders of all bands and polygons, the inner side on the left."""
    dx, dy = s.x1 - s.x0, s.y1 - s.y0
    angle = np.arctan2(dy, dx)
    steps = np.arange(2 * resolution + 1) * (math.pi / (2 * resolution))
    point = np.flatnonzero((s.dim == 0)[s.corner_row])  # a band without length: a circle
    px, py, qx, qy = np.append(s.x0, s.x[point]), np.append(s.y0, s.y[point]), np.append(s.x1, s.x[point]), np.append(s.y1, s.y[point])
    row, angle = np.append(s.row, s.corner_row[point]), np.append(angle, np.zeros(len(point)))
    far, back = angle[:, None] - math.pi / 2 + steps, angle[:, None] + math.pi / 2 + steps
    x = np.concatenate([qx[:, None] + distance * np.cos(far), px[:, None] + distance * np.cos(back)], axis=1)
    y = np.concatenate([qy[:, None] + distance * np.sin(far), py[:, None] + distance * np.sin(back)], axis=1)
    n = x.shape[1]
    region = np.repeat(np.arange(len(row)), n)
    out = [x.ravel(), y.ravel(), np.roll(x, -1, 1).ravel(), np.roll(y, -1, 1).ravel(), np.repeat(row, n), region]
    x0, y0, x1, y1 = oriented(s)
    own = (s.dim == 2)[s.row]
    return [np.concatenate([v, w]) for v, w in zip(out, (x0[own], y0[own], x1[own], y1[own], s.row[own], len(row) + s.row[own]))]


def _united(x0, y0, x1, y1, row, region, rows: int) -> list[list[np.ndarray]]:
    """The rings of the union of regions, for each row. All corners are set to a grid of 1e-9 of the row's extent."""
    extent = np.full(rows, 1e-300)
    for v in (x0, y0, x1, y1):
        np.maximum.at(extent, row, np.abs(v))
    size = np.zeros(rows)
    np.maximum.at(size, row, np.hypot(x1 - x0, y1 - y0))
    grid = np.maximum(extent * 1e-13, size * 1e-9)
    x0, y0, x1, y1 = (np.round(v / grid[row]) for v in (x0, y0, x1, y1))
    kept = (x0 != x1) | (y0 != y1)
    order = np.flatnonzero(kept)[np.lexsort((region[kept], row[kept]))]
    x0, y0, x1, y1, row, region = (v[order] for v in (x0, y0, x1, y1, row, region))
    fresh = np.append(True, region[1:] != region[:-1]) if len(region) else np.zeros(0, bool)
    region = np.cumsum(fresh) - 1
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(region))
    low = [np.minimum.reduceat(np.minimum(a, b), head) for a, b in ((x0, x1), (y0, y1))]
    high = [np.maximum.reduceat(np.maximum(a, b), head) for a, b in ((x0, x1), (y0, y1))]
    first = np.searchsorted(row[head], np.arange(rows + 1))  # regions of each row

    def near(x, y, at, pad=0.0):
        """(item, region) of the regions of its row whose bounds hold each point or box."""
        n = first[at + 1] - first[at]
        i, r = np.repeat(np.arange(len(at)), n), np.repeat(first[at], n) + sh._ramp(n)
        ok = (x[1][i] >= low[0][r] - pad) & (x[0][i] <= high[0][r] + pad) & (y[1][i] >= low[1][r] - pad) & (y[0][i] <= high[1][r] + pad)
        return i[ok], r[ok]

    i, r = near((np.minimum(x0, x1), np.maximum(x0, x1)), (np.minimum(y0, y1), np.maximum(y0, y1)), row, 1.0)
    later = r > region[i]
    i, r = i[later], r[later]
    n = tail[r] - head[r]
    i, j = np.repeat(i, n), np.repeat(head[r], n) + sh._ramp(n)
    rx, ry, sx, sy, qx, qy = x1[i] - x0[i], y1[i] - y0[i], x1[j] - x0[j], y1[j] - y0[j], x0[j] - x0[i], y0[j] - y0[i]
    turn, lr, ls = rx * sy - ry * sx, np.hypot(rx, ry), np.hypot(sx, sy)
    level = np.abs(turn) <= 1e-9 * lr * ls
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * sy - qy * sx) / turn, (qx * ry - qy * rx) / turn
    hit = ~level & (t >= -1 / lr) & (t <= 1 + 1 / lr) & (u >= -1 / ls) & (u <= 1 + 1 / ls)
    cx, cy = np.round(x0[i[hit]] + t[hit] * rx[hit]), np.round(y0[i[hit]] + t[hit] * ry[hit])
    edge, px, py = [i[hit], j[hit]], [cx, cx], [cy, cy]
    beside = level & (np.abs(qx * ry - qy * rx) <= 2 * lr)
    for a, b in ((i, j), (j, i)):  # sides that run along each other are cut at each other's ends
        for ex, ey in ((x0, y0), (x1, y1)):
            m = np.flatnonzero(beside)
            dx, dy = x1[a[m]] - x0[a[m]], y1[a[m]] - y0[a[m]]
            along = ((ex[b[m]] - x0[a[m]]) * dx + (ey[b[m]] - y0[a[m]]) * dy) / (dx * dx + dy * dy)
            m = m[(along > 0) & (along < 1)]
            edge.append(a[m])
            px.append(ex[b[m]])
            py.append(ey[b[m]])
    n = np.arange(len(row))
    edge, px, py = np.concatenate([n, n, *edge]), np.concatenate([x0, x1, *px]), np.concatenate([y0, y1, *py])
    order = np.lexsort(((px - x0[edge]) * (x1 - x0)[edge] + (py - y0[edge]) * (y1 - y0)[edge], edge))
    edge, px, py = edge[order], px[order], py[order]
    k = np.flatnonzero((edge[1:] == edge[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1])))
    edge, ax, ay, bx, by = edge[k], px[k], py[k], px[k + 1], py[k + 1]
    # the outer side of a piece, a little to its right, must lie in no other region
    run = np.hypot(bx - ax, by - ay)
    off = np.minimum(8.0, run / 8)
    mx, my = (ax + bx) / 2 + (by - ay) / run * off, (ay + by) / 2 - (bx - ax) / run * off
    i, r = near((mx, mx), (my, my), row[edge])
    other = r != region[edge[i]]
    i, r = i[other], r[other]
    n = tail[r] - head[r]
    pair, j = np.repeat(np.arange(len(i)), n), np.repeat(head[r], n) + sh._ramp(n)
    x, y = mx[i[pair]], my[i[pair]]
    with np.errstate(divide="ignore", invalid="ignore"):
        below = ((x0[j] > x) != (x1[j] > x)) & (y0[j] + (y1[j] - y0[j]) * ((x - x0[j]) / (x1[j] - x0[j])) < y)
    odd = np.bincount(pair[below], minlength=len(i)) % 2 == 1
    kept = np.bincount(i[odd], minlength=len(edge)) == 0
    pieces = np.unique(np.stack([row[edge], ax, ay, bx, by], 1)[kept], axis=0)
    return _stitched(pieces, grid, rows)


def _stitched(pieces: np.ndarray, grid: np.ndarray, rows: int) -> list[list[np.ndarray]]:
    """Rings from directed pieces (row, start, end): at each corner the one goes on that turns most to the left."""
    out: list[list[np.ndarray]] = [[] for _ in range(rows)]
    if not len(pieces):
        return out
    _, corner = np.unique(np.concatenate([pieces[:, [0, 1, 2]], pieces[:, [0, 3, 4]]]), axis=0, return_inverse=True)
    start, end = corner[: len(pieces)], corner[len(pieces) :]
    order = np.argsort(start, kind="stable")
    low, high = (np.searchsorted(start[order], end, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(pieces)), high - low)
    j = order[np.repeat(low, high - low) + sh._ramp(high - low)]
    d = pieces[:, 3:] - pieces[:, 1:3]
    turn = np.arctan2(d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0], (d[i] * d[j]).sum(1))
    best = np.lexsort((turn, i))
    follow = np.full(len(pieces), -1)
    follow[i[best]] = j[best]  # the last one of each piece, the largest turn, stays
    follow, seen = follow.tolist(), [False] * len(pieces)
    for k in range(len(pieces)):
        path, at = [], k
        while at >= 0 and not seen[at]:
            seen[at] = True
            path.append(at)
            at = follow[at]
        if len(path) > 2 and at == k:
            own = int(pieces[k, 0])
            out[own].append(pieces[path][:, 1:3] * grid[own])
    return out


def buffered_shape(distance: float, resolution: int = RESOLUTION):
    """A function of (shape, dim): the polygon of all places at most ``distance`` away."""

    @F.arrow_udf(sh.SHAPE)
    def run(shape: pa.Array, dim: pa.Array) -> pa.Array:
        s = sh.flat(shape, dim)
        found: list = []
        work, low = np.cumsum(np.diff(s.starts()) ** 2 * 8 + 64), 0
        while low < s.rows:
            high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + sh.PAIRS, "right")))
            found += _united(*_bands(s.some(low, high), distance, resolution), high - low) if (s.corner_row >= low).any() else [[]] * (high - low)
            low = high
        parts = [ring for rings in found for ring in rings]
        corners = np.concatenate([*parts, np.zeros((0, 2))])
        inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["x", "y"]))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32()), inner)

    return run


def buffered(layer: DataFrame, distance: float, crs: str | None = None, ring_only: bool = False, resolution: int = RESOLUTION) -> DataFrame:
    """The layer widened by ``distance`` with round joins, as polygons (or their borders as lines, with ``ring_only``). In
    degrees (EPSG:4326) the distance is metres, in the UTM zone of the layer's middle; else units of the system. Circles
    are polygons of 4 * ``resolution`` corners."""
    if distance <= 0:
        raise ValueError("the distance must be over 0")
    layer, zone = sh.shaped(layer), None
    if crs and crs.upper() == pr.GEOGRAPHIC:
        x0, y0, x1, y1 = layer.agg(*((F.min if c.startswith("min") else F.max)(c) for c in mp.BOX)).first()  # one row
        zone = pr.local_zone(((x0 or 0) + (x1 or 0)) / 2, ((y0 or 0) + (y1 or 0)) / 2)
        layer = pr.reprojected(layer, crs, zone)
    shape: Column = F.coalesce("shape", sh.box_shape()) if "shape" in layer.columns else sh.box_shape()
    dim = F.coalesce("dim", sh.box_dim()) if "shape" in layer.columns else sh.box_dim()
    ring = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1))).alias("rings") if ring_only else F.col("rings")
    out = layer.withColumn("rings", buffered_shape(distance, resolution)(shape, dim)).drop("shape", "dim", *mp.BOX)
    out = sh.shaped(out.withColumn("lines", ring).drop("rings") if ring_only else out)
    return pr.reprojected(out, zone, crs) if zone else out
