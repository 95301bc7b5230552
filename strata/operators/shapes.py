"""Lines and polygons of any number of parts, as a column ``shape``: an array of arrays of struct (x, y), with ``dim`` 2
for polygons, 1 for lines and 0 for points. A polygon's parts are its rings, closed or not: a place is inside if an odd
number of ring crossings lie below it, so holes and several parts need no order or direction. Rings must not cross.

Everything here works on Arrow batches as flat NumPy arrays of edges with the row they belong to; there is no loop over
rows. Areas are exact sums over slabs: between neighbouring x of corners and crossings no edges meet, so the common length
of a vertical cut is linear and its middle times the width is the area.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SHAPE = "array<array<struct<x:double,y:double>>>"
SLACK = 1e-12  # of the extent: what counts as on an edge
PAIRS = 1 << 21  # pairs of edges that are looked at together
GEOMETRIES = ("shape", "rings", "ring", "lines", "line")


# --- flat arrays ------------------------------------------------------------------------------------------------------


@dataclass
class Shapes:
    """A batch: corners by part by row. ``edges`` lead from a corner to the next; rings are closed."""

    rows: int
    x: np.ndarray
    y: np.ndarray
    corner_row: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    row: np.ndarray
    dim: np.ndarray

    def starts(self) -> np.ndarray:
        """Where the edges of each row begin, and where the last row's end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def some(self, low: int, high: int) -> "Shapes":
        c, e = np.searchsorted(self.corner_row, (low, high)), np.searchsorted(self.row, (low, high))
        return Shapes(high - low, self.x[c[0] : c[1]], self.y[c[0] : c[1]], self.corner_row[c[0] : c[1]] - low, *(v[e[0] : e[1]] for v in (self.x0, self.y0, self.x1, self.y1)), self.row[e[0] : e[1]] - low, self.dim[low:high])


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)


def flat(shape: pa.Array, dim: pa.Array) -> Shapes:
    """A column of shapes as flat arrays; null shapes have no corners."""
    dims = np.asarray(dim.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    per_row, parts = _lengths(shape), shape.flatten()
    per_part, corners = _lengths(parts), parts.flatten()
    x, y = (np.asarray(corners.field(c).to_numpy(zero_copy_only=False), np.float64) for c in ("x", "y"))
    part_row = np.repeat(np.arange(len(shape)), per_row)
    corner_row, last = np.repeat(part_row, per_part), np.cumsum(per_part) - 1
    nx = np.arange(1, len(x) + 1)
    full = per_part > 0
    nx[last[full]] = (last - per_part + 1)[full]
    leads = np.ones(len(x), bool)
    leads[last[full]] = dims[part_row[full]] == 2  # only rings go back to their first corner
    leads &= dims[corner_row] > 0
    at = np.flatnonzero(leads)
    x0, y0, x1, y1, row = x[at], y[at], x[nx[at]], y[nx[at]], corner_row[at]
    kept = (x0 != x1) | (y0 != y1)
    return Shapes(len(shape), x, y, corner_row, x0[kept], y0[kept], x1[kept], y1[kept], row[kept], dims)


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _met(row_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of items of A and edges of B of the same row."""
    n = starts_b[row_a + 1] - starts_b[row_a]
    return np.repeat(np.arange(len(row_a)), n), np.repeat(starts_b[row_a], n) + _ramp(n)


def _extent(*shapes: Shapes) -> np.ndarray:
    """The largest absolute coordinate of each row, the scale of rounding."""
    out = np.zeros(shapes[0].rows)
    for s in shapes:
        np.maximum.at(out, s.corner_row, np.maximum(np.abs(s.x), np.abs(s.y)))
    return out


# --- predicates -------------------------------------------------------------------------------------------------------


def inside(px: np.ndarray, py: np.ndarray, row: np.ndarray, s: Shapes, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points lie inside the polygon of their row, and whether on an edge (of a line, too)."""
    i, j = _met(row, s.starts())
    x, y, x0, y0, x1, y1 = px[i], py[i], s.x0[j], s.y0[j], s.x1[j], s.y1[j]
    dx, dy = x1 - x0, y1 - y0
    beside = np.abs(dx * (y - y0) - dy * (x - x0)) <= slack[row[i]] * np.hypot(dx, dy)
    along = (x - x0) * dx + (y - y0) * dy
    e = slack[row[i]] * np.hypot(dx, dy)
    on = beside & (along >= -e) & (along <= dx * dx + dy * dy + e)
    with np.errstate(divide="ignore", invalid="ignore"):
        below = ((x0 > x) != (x1 > x)) & (y0 + dy * ((x - x0) / dx) < y)
    n = len(px)
    odd = np.bincount(i[below], minlength=n) % 2 == 1
    return odd & (s.dim[row] == 2), np.bincount(i[on], minlength=n) > 0


def _near(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Edges of A, and their rows, whose boxes meet B's, widened by rounding."""
    kept = np.ones(len(a.row), bool)
    for low, high, at in ((np.minimum(a.x0, a.x1), np.maximum(a.x0, a.x1), b.x), (np.minimum(a.y0, a.y1), np.maximum(a.y0, a.y1), b.y)):
        least, most = np.full(b.rows, np.inf), np.full(b.rows, -np.inf)
        np.minimum.at(least, b.corner_row, at)
        np.maximum.at(most, b.corner_row, at)
        with np.errstate(invalid="ignore"):
            pad = 1e-9 * (np.abs(least) + np.abs(most))
            kept &= (high >= (least - pad)[a.row]) & (low <= (most + pad)[a.row])
    at = np.flatnonzero(kept)
    return at, a.row[at]


def crossings(a: Shapes, b: Shapes, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge of A, edge of B, place along A's edge from 0 to 1) where edges of a row meet, and rows with a contact, edges that
    run along each other included."""
    (ka, sub_a), (kb, sub_b) = _near(a, b), _near(b, a)  # edges that reach into the other's bounds
    i, j = _met(sub_a, np.searchsorted(sub_b, np.arange(b.rows + 1)))
    i, j = ka[i], kb[j]
    rx, ry, sx, sy = a.x1[i] - a.x0[i], a.y1[i] - a.y0[i], b.x1[j] - b.x0[j], b.y1[j] - b.y0[j]
    qx, qy = b.x0[j] - a.x0[i], b.y0[j] - a.y0[i]
    lr, ls, e = np.hypot(rx, ry), np.hypot(sx, sy), slack[a.row[i]]
    turn = rx * sy - ry * sx
    level = np.abs(turn) <= 1e-14 * lr * ls
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * sy - qy * sx) / turn, (qx * ry - qy * rx) / turn
    hit = ~level & (t >= -e / lr) & (t <= 1 + e / lr) & (u >= -e / ls) & (u <= 1 + e / ls)
    near = level & (np.abs(qx * ry - qy * rx) <= e * lr)
    begin = (qx * rx + qy * ry) / lr
    other = begin + (sx * rx + sy * ry) / lr
    run = near & (np.maximum(begin, other) >= -e) & (np.minimum(begin, other) <= lr + e)
    touched = np.zeros(a.rows, bool)
    touched[a.row[i[hit | run]]] = True
    return i[hit], j[hit], np.clip(t[hit], 0, 1), touched


# --- sums over slabs --------------------------------------------------------------------------------------------------


def _slabs(sides: list[Shapes], extra_x: np.ndarray, extra_row: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The slabs of each row between ``low`` and ``high``, and where edges pass them: (left, right, row) of slabs, then
    (slab, side, edge) sorted by slab and height at the middle, with that height."""
    xs = [np.clip(v, low[r], high[r]) for v, r in [(extra_x, extra_row), *((c, s.row) for s in sides for c in (np.minimum(s.x0, s.x1), np.maximum(s.x0, s.x1)))]]
    rows = np.concatenate([extra_row, *(s.row for s in sides for _ in "lh")])
    values = np.concatenate(xs)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    fresh = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])) if len(v) else np.zeros(0, bool)
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(fresh) - 1
    v, r = v[fresh], r[fresh]
    left, right = v[:-1], v[1:]
    at, found = len(extra_x), []
    for side, s in enumerate(sides):
        n = len(s.row)
        first, last = number[at : at + n], number[at + n : at + 2 * n]
        at += 2 * n
        edge = np.repeat(np.arange(n), last - first)
        slab = np.repeat(first, last - first) + _ramp(last - first)
        middle = (left[slab] + right[slab]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            height = s.y0[edge] + (s.y1[edge] - s.y0[edge]) * ((middle - s.x0[edge]) / (s.x1[edge] - s.x0[edge]))
        found.append((slab, np.full(len(slab), side), edge, height))
    slab, side, edge, height = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((height, slab))
    return left, right, r[:-1], slab[order], side[order], edge[order], height[order]


def _spans(s: Shapes) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(s.rows, np.inf), np.full(s.rows, -np.inf)
    np.minimum.at(low, s.corner_row, s.x)
    np.maximum.at(high, s.corner_row, s.x)
    return low, high


def common_area(a: Shapes, b: Shapes, found: tuple) -> np.ndarray:
    """Area of the intersection of the polygons of each row; ``found``: their crossings."""
    i, _, t, _ = found
    (la, ha), (lb, hb) = _spans(a), _spans(b)
    low, high = np.maximum(la, lb), np.minimum(ha, hb)
    high = np.maximum(low, high)
    cross = a.x0[i] + t * (a.x1[i] - a.x0[i])
    left, right, row, slab, side, _, height = _slabs([a, b], cross, a.row[i], low, high)
    both = (np.cumsum(side == 0) % 2 == 1) & (np.cumsum(side == 1) % 2 == 1)  # rings pass each slab an even number of times
    stretch = np.where(both[:-1], height[1:] - height[:-1], 0.0) if len(slab) else np.zeros(0)
    at = slab[:-1]
    return np.bincount(row[at], stretch * (right[at] - left[at]), a.rows)[: a.rows] if len(at) else np.zeros(a.rows)


@dataclass
class Measures:
    area: np.ndarray
    length: np.ndarray
    cx: np.ndarray
    cy: np.ndarray
    px: np.ndarray
    py: np.ndarray


def measured(s: Shapes) -> Measures:
    """Area, length (of polygons: of all rings), centroid, and a point that is always inside or on the line."""
    low, high = _spans(s)
    with np.errstate(invalid="ignore"):
        base_x = np.where(np.isfinite(low), low, 0.0)
    base_y = np.full(s.rows, np.inf)
    np.minimum.at(base_y, s.corner_row, s.y)
    base_y = np.where(np.isfinite(base_y), base_y, 0.0)
    own = lambda values, rows: np.bincount(rows, values, s.rows)[: s.rows]
    x0, x1, y0, y1 = s.x0 - base_x[s.row], s.x1 - base_x[s.row], s.y0 - base_y[s.row], s.y1 - base_y[s.row]
    run = np.hypot(x1 - x0, y1 - y0)
    length = own(run, s.row)
    area, mx, my = np.zeros(s.rows), np.zeros(s.rows), np.zeros(s.rows)
    px, py = np.full(s.rows, np.nan), np.full(s.rows, np.nan)
    flat_ = s.dim < 2
    ring = ~flat_[s.row]
    p = Shapes(s.rows, s.x, s.y, s.corner_row, x0[ring], y0[ring], x1[ring], y1[ring], s.row[ring], s.dim)
    left, right, row, slab, _, edge, height = _slabs([p], np.zeros(0), np.zeros(0, np.int64), np.zeros(s.rows), np.maximum(high - base_x, 0.0))
    if len(slab):
        k = np.arange(0, len(slab) - 1, 2)  # the edges below and above each inner stretch
        at, e, f = slab[k], edge[k], edge[k + 1]
        w, xl, xr = right[at] - left[at], left[at], right[at]
        y = lambda g, x: p.y0[g] + (p.y1[g] - p.y0[g]) * ((x - p.x0[g]) / (p.x1[g] - p.x0[g]))
        el, er, fl, fr, em, fm = y(e, xl), y(e, xr), y(f, xl), y(f, xr), height[k], height[k + 1]
        hl, hr = fl - el, fr - er
        r = row[at]
        area = own(w * (hl + hr) / 2, r)
        mx = own(w * (xl * (2 * hl + hr) + xr * (hl + 2 * hr)) / 6, r)
        my = own(w * ((fl**2 - el**2) + 4 * (fm**2 - em**2) + (fr**2 - er**2)) / 12, r)
        order = np.lexsort((-(fm - em), r))
        best = order[np.append(True, r[order][1:] != r[order][:-1])]
        px[r[best]], py[r[best]] = (xl[best] + xr[best]) / 2 + base_x[r[best]], (em[best] + fm[best]) / 2 + base_y[r[best]]
    line = flat_ | (area == 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = mx / area, my / area
        lx, ly = own(run * (x0 + x1) / 2, s.row) / length, own(run * (y0 + y1) / 2, s.row) / length
        n = own(np.ones(len(s.x)), s.corner_row)
        ax, ay = own(s.x - base_x[s.corner_row], s.corner_row) / n, own(s.y - base_y[s.corner_row], s.corner_row) / n
    cx, cy = (np.where(line, np.where(length > 0, p_, q), c) + b for c, p_, q, b in ((cx, lx, ax, base_x), (cy, ly, ay, base_y)))
    order = np.lexsort((-run, s.row))
    longest = order[np.append(True, s.row[order][1:] != s.row[order][:-1])] if len(order) else order
    longest = longest[np.isnan(px[s.row[longest]])]
    px[s.row[longest]], py[s.row[longest]] = (s.x0[longest] + s.x1[longest]) / 2, (s.y0[longest] + s.y1[longest]) / 2
    first = np.flatnonzero(np.append(True, s.corner_row[1:] != s.corner_row[:-1])) if len(s.x) else np.zeros(0, np.int64)
    first = first[np.isnan(px[s.corner_row[first]])]
    px[s.corner_row[first]], py[s.corner_row[first]] = s.x[first], s.y[first]
    return Measures(np.where(flat_, 0.0, area), length, cx, cy, px, py)


# --- pairs ------------------------------------------------------------------------------------------------------------


def inside_length(a: Shapes, b: Shapes, found: tuple, slack: np.ndarray) -> np.ndarray:
    """Length of the lines of A in the polygons of B (or along the lines of B): edges are cut at all crossings, and a piece
    counts if its middle is inside or on an edge."""
    i, _, t, _ = found
    n = len(a.row)
    where = np.concatenate([np.arange(n), np.arange(n), i])
    place = np.concatenate([np.zeros(n), np.ones(n), t])
    line = np.flatnonzero(b.dim[a.row] < 2)  # along lines, pieces also end where corners of B lie on the edge
    k, j = _met(a.row[line], np.searchsorted(b.corner_row, np.arange(b.rows + 1)))
    k = line[k]
    dx, dy = a.x1[k] - a.x0[k], a.y1[k] - a.y0[k]
    size = dx * dx + dy * dy
    along = ((b.x[j] - a.x0[k]) * dx + (b.y[j] - a.y0[k]) * dy) / size
    on = (np.abs((b.x[j] - a.x0[k]) * dy - (b.y[j] - a.y0[k]) * dx) <= slack[a.row[k]] * np.sqrt(size)) & (along > 0) & (along < 1)
    where, place = np.append(where, k[on]), np.append(place, along[on])
    order = np.lexsort((place, where))
    where, place = where[order], place[order]
    k = np.flatnonzero((where[1:] == where[:-1]) & (place[1:] > place[:-1]))
    edge, middle = where[k], (place[k] + place[k + 1]) / 2
    size = (place[k + 1] - place[k]) * np.hypot(a.x1[edge] - a.x0[edge], a.y1[edge] - a.y0[edge])
    into, on = inside(a.x0[edge] + middle * (a.x1[edge] - a.x0[edge]), a.y0[edge] + middle * (a.y1[edge] - a.y0[edge]), a.row[edge], b, slack)
    return np.bincount(a.row[edge], np.where(into | on, size, 0.0), a.rows)[: a.rows]


def _related(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray]:
    slack = SLACK * _extent(a, b)
    found = crossings(a, b, slack)
    meets, part = found[3].copy(), np.zeros(a.rows)
    rows = np.arange(a.rows)
    for p, q in ((a, b), (b, a)):  # no crossing: one may lie in the other, and points have no edges
        first = np.searchsorted(p.corner_row, rows)
        have = rows[(first < len(p.x)) & (np.append(p.corner_row, -1)[np.minimum(first, len(p.x))] == rows)]
        points = p.dim[p.corner_row] == 0
        at = np.concatenate([first[have], np.flatnonzero(points)])
        into, on = inside(p.x[at], p.y[at], p.corner_row[at], q, slack)
        meets[p.corner_row[at[into | on]]] = True
    point = (a.dim == 0) & (b.dim == 0)
    if point.any():
        i, j = _met(a.corner_row, np.searchsorted(b.corner_row, np.arange(b.rows + 1)))
        same = point[a.corner_row[i]] & (a.x[i] == b.x[j]) & (a.y[i] == b.y[j])
        meets[a.corner_row[i[same]]] = True
    if (areas := (a.dim == 2) & (b.dim == 2)).any():
        area = common_area(a, b, found)
        part = np.where(areas, area, part)
        meets |= areas & (area > 0)
    if (a.dim == 1).any():
        part = np.where((a.dim == 1) & (b.dim > 0), inside_length(a, b, found, slack), part)
    part = np.where((a.dim == 0) & meets, 1.0, part)
    return meets, np.where(meets, part, 0.0)


def related(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Whether the shapes of each row meet, contacts included, and how much of A lies in B: area for two polygons, length for
    lines, 1 for points. Rows are taken in portions, by pairs of edges."""
    work = np.cumsum(np.diff(a.starts()) * np.diff(b.starts()) + np.diff(a.starts()) + np.diff(b.starts()) + 8)
    meets, part, low = np.zeros(a.rows, bool), np.zeros(a.rows), 0
    while low < a.rows:
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + PAIRS, "right")))
        meets[low:high], part[low:high] = _related(a.some(low, high), b.some(low, high))
        low = high
    return meets, part


# --- columns ----------------------------------------------------------------------------------------------------------

_RELATION = T.StructType([T.StructField("meets", T.BooleanType()), T.StructField("part", T.DoubleType())])


@F.arrow_udf(_RELATION)
def relation(a: pa.Array, dim_a: pa.Array, b: pa.Array, dim_b: pa.Array) -> pa.Array:
    """(meets, part) of two shapes."""
    meets, part = related(flat(a, dim_a), flat(b, dim_b))
    return pa.StructArray.from_arrays([pa.array(meets), pa.array(part)], ["meets", "part"])


@F.arrow_udf(T.BooleanType())
def holds(shape: pa.Array, dim: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether a point lies in a polygon or on an edge."""
    s = flat(shape, dim)
    px, py = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in (x, y))
    slack = SLACK * np.maximum(_extent(s), np.maximum(np.abs(px), np.abs(py)))
    out = np.zeros(s.rows, bool)
    work, low = np.cumsum(np.diff(s.starts()) + 1), 0
    while low < s.rows:
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + PAIRS, "right")))
        into, on = inside(px[low:high], py[low:high], np.arange(high - low), s.some(low, high), slack[low:high])
        out[low:high] = into | on
        low = high
    return pa.array(out)


_MEASURES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("area", "length", "cx", "cy", "px", "py")])


@F.arrow_udf(_MEASURES)
def measures(shape: pa.Array, dim: pa.Array) -> pa.Array:
    """(area, length, cx, cy, px, py): px, py is a point inside; null for a shape without corners."""
    m = measured(flat(shape, dim))
    gone = np.isnan(m.px)
    return pa.StructArray.from_arrays([pa.array(np.nan_to_num(v), mask=gone) for v in (m.area, m.length, m.cx, m.cy, m.px, m.py)], ["area", "length", "cx", "cy", "px", "py"])


def box_shape(prefix: str = "") -> Column:
    """The shape of a box: a ring, a line between its corners if it has no area, or its point."""
    corner = lambda x, y: F.struct(F.col(prefix + x).alias("x"), F.col(prefix + y).alias("y"))
    low, high = corner("minx", "miny"), corner("maxx", "maxy")
    ring = F.array(F.array(low, corner("maxx", "miny"), high, corner("minx", "maxy")))
    dim = box_dim(prefix)
    return F.when(dim == 2, ring).when(dim == 1, F.array(F.array(low, high))).otherwise(F.array(F.array(low)))


def box_dim(prefix: str = "") -> Column:
    return ((F.col(f"{prefix}maxx") > F.col(f"{prefix}minx")).cast("int") + (F.col(f"{prefix}maxy") > F.col(f"{prefix}miny")).cast("int")).cast("int")


def shaped(layer: DataFrame) -> DataFrame:
    """The layer with ``shape`` and ``dim`` in place of its rings, ring, lines or line, and with bounds. A row where all of
    them are null is the box of its bounds and keeps a null shape; layers of boxes only are left as they are."""
    found = [c for c in GEOMETRIES if c in layer.columns]
    if not found or found == ["shape"]:
        return layer
    whole = F.coalesce(*(F.col(c) if c in ("shape", "rings", "lines") else F.when(F.col(c).isNotNull(), F.array(c)) for c in found))
    flat_ = [F.col(c).isNotNull() for c in found if c in ("line", "lines")]
    dim = F.when(flat_[0] if len(flat_) == 1 else flat_[0] | flat_[1], 1) if flat_ else F.lit(None)
    if "shape" in found:
        dim = F.coalesce(F.when(F.col("shape").isNotNull(), F.col("dim")), dim)
    out = layer.withColumns({"_shape": whole.cast(SHAPE), "_dim": F.when(whole.isNotNull(), F.coalesce(dim, F.lit(2))).cast("int")}).drop(*found, "dim")
    out = out.withColumnsRenamed({"_shape": "shape", "_dim": "dim"})
    if "minx" in layer.columns:
        return out.withColumn("dim", F.coalesce("dim", box_dim()))
    each = lambda c: F.flatten(F.transform("shape", lambda part: F.transform(part, lambda p: p[c])))
    return out.withColumns({f"{side}{c}": f(each(c)) for side, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"})
