"""A graph of levels (layers of boxes, points, lines or polygons) whose columns reach each other.

``Levels`` keeps metadata on the driver and one lazy DataFrame per level. ``propagate`` fills each column into the levels
that lack it: first up along child -> parent edges, then down, so that a child's values win over a parent's; at last,
nulls of a level that has the column are filled from its parents. Walking the graph looks at column names only; the one
kind of job it runs are null counts, one per visited level and parent.
"""

from __future__ import annotations

import warnings
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .functions import projections as pr
from .functions import strategies as st
from .operators import mapping as mp
from .operators import nearest as nr
from .operators import shapes as sh
from .operators.buffers import buffered
from .scratch import cut, numbered
from .sources import wkb
from .sources.store import kept_mapping

#: Columns that describe geometry and stay at their level.
GEOMETRY = ("id", *mp.BOX, "shape", "dim", "area", "length", "cx", "cy", "geometry_type")


def _listed(x: str | Iterable[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def measured(layer: DataFrame) -> DataFrame:
    """Adds area, length (of polygons: perimeter), centre and type where they are missing."""
    layer = sh.shaped(layer)
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    area, length, dim = w * h, F.when((w == 0) | (h == 0), w + h).otherwise(2 * (w + h)), sh.box_dim()
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    if "shape" in layer.columns:
        layer, box = layer.withColumn("_m", sh.measures("shape", "dim")), F.col("shape").isNull()
        area, length, cx, cy = (F.when(box, own).otherwise(F.col("_m")[c]) for c, own in (("area", area), ("length", length), ("cx", cx), ("cy", cy)))
        dim = F.col("dim")
    kind = F.when(dim == 2, "Polygon").when(dim == 1, "LineString").otherwise("Point")
    new = {"area": area, "length": length, "cx": cx, "cy": cy, "geometry_type": kind}
    return layer.withColumns({c: x for c, x in new.items() if c not in layer.columns}).drop("_m")


class Levels:
    """``size`` is the width of the finest grid bins of mappings, near the side of common boxes. ``crs``: the system of all
    coordinates; layers of other systems are brought into it, and in degrees (EPSG:4326) area and length are metres. Without
    one, coordinates are taken as they are. ``folder``: where mappings are kept under the geometry of both levels, so that the
    next session reads them; without one they are written out for this graph only."""

    def __init__(self, size: float, crs: str | None = None, folder: str | None = None) -> None:
        self.size = size
        self.folder = folder
        self.crs = crs
        self.geometry: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.measure: dict[str, str] = {}
        self.parents: dict[str, list[str]] = {}
        self.children: dict[str, list[str]] = {}
        self.native: dict[str, list[str]] = {}
        self.excluded: set[str] = set()
        self._strategies: dict[tuple[str | None, str | None], st.Strategy] = {}
        self._mappings: dict[tuple, DataFrame] = {}
        # what is known of tables that have not changed since: nulls of their columns, and fills that gave nothing
        self._counted: dict[str, tuple[DataFrame, dict[str, int]]] = {}
        self._idle: dict[tuple[str, str, str], tuple[DataFrame, DataFrame, st.Strategy]] = {}

    # --- registry -------------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        """Columns that propagate."""
        return [c for c in self.native if c not in self.excluded]

    def levels_of(self, column: str) -> list[str]:
        return [n for n, t in self.tables.items() if column in t.columns]

    def _resolve(self, column: str | None, level: str | None) -> st.Strategy | None:
        for key in ((column, level), (column, None), (None, level)):
            if key != (None, None) and key in self._strategies:
                return self._strategies[key]
        return None

    def strategy(self, column: str | None, level: str | None, strict: bool = True) -> st.Strategy | None:
        """The strategy of (column, level), else of the column, else of the level."""
        if found := self._resolve(column, level):
            return found
        text = f"no strategy for column {column} at level {level}: set one with set_strategy"
        if strict:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
        return None

    def set_strategy(self, column: str | None = None, strategy: st.Strategy | None = None, level: str | None = None, *, upward: st.Strategy | None = None, downward: st.Strategy | None = None, propagate: bool = True) -> None:
        """Sets the strategy of a column, a level or both. A change drops what was derived by the old one."""
        if strategy is None:
            if upward is None:
                raise ValueError("a strategy, or one for the way up, is needed")
            strategy = st.Composite(upward, downward)
        if column is None and level is None:
            raise ValueError("a column, a level or both are needed")
        if column is not None and column not in self.native:
            self.native[column] = self.levels_of(column)
        affected = [column] if column is not None else list(self.native)
        resolved = lambda: {(c, n): self._resolve(c, n) for c in affected for n in self.tables}
        before = resolved()
        self._strategies[column, level] = strategy
        after = resolved()
        self._drop_derived(c for c in affected if any(before[c, n] not in (None, after[c, n]) for n in self.tables))
        if propagate and self.tables and (column is None or self.native[column]):
            self.propagate()

    def exclude_column(self, column: str) -> None:
        """The column stays at its native levels only."""
        if column not in self.native:
            raise KeyError(column)
        self.excluded.add(column)
        self._drop_derived([column])
        self.propagate()

    def include_column(self, column: str) -> None:
        self.excluded.discard(column)
        self.propagate()

    def _drop_derived(self, columns: Iterable[str]) -> None:
        for c in columns:
            for name in self.levels_of(c):
                if name not in self.native[c]:
                    old, self.tables[name] = self.tables[name], self.tables[name].drop(c)
                    if name in self._counted and self._counted[name][0] is old:  # the other columns stay as they are
                        known = self._counted[name][1]
                        known.pop(c, None)
                        self._counted[name] = (self.tables[name], known)

    def link(self, name: str, parent: str | Iterable[str] | None = None, child: str | Iterable[str] | None = None) -> None:
        """Adds edges, at both ends; their order decides between several parents or children."""
        self.parents.setdefault(name, [])
        self.children.setdefault(name, [])
        for low, high in [(name, p) for p in _listed(parent)] + [(c, name) for c in _listed(child)]:
            for x in (low, high):
                self.parents.setdefault(x, [])
                self.children.setdefault(x, [])
            if high not in self.parents[low]:
                self.parents[low].append(high)
                self.children[high].append(low)

    # --- levels ---------------------------------------------------------------------------------------------------

    def add_level(self, name: str, layer: DataFrame, id_col: str = "id", strategies: st.Strategy | dict[str, st.Strategy] | None = None, parent=None, child=None, measure: str | None = None, crs: str | None = None) -> None:
        """Adds a layer (bounds or a shape, and attributes) as a level and propagates. ``crs``: the layer's own system. ``measure``: area or length; by default
        area if any row is a polygon. ``strategies``: of each attribute, or one for all of them; they hold at all levels. New
        edges drop derived values, as they may offer better sources; a level of the same name is replaced."""
        layer = self._prepared(layer, id_col, crs)
        attributes = [c for c in layer.columns if c not in GEOMETRY]
        if name in self.tables:
            for c in self.native:
                self.native[c] = [n for n in self.native[c] if n != name]
            self._drop_derived(list(self.native))
        self.geometry[name] = layer.select(*(c for c in layer.columns if c in GEOMETRY))
        self.tables[name] = layer.select("id", *attributes)
        self.measure[name] = measure or ("area" if layer.filter("geometry_type = 'Polygon'").take(1) else "length")
        self._mappings = {k: m for k, m in self._mappings.items() if name not in k[:2]}
        self.link(name)
        for c in attributes:
            given = strategies.get(c) if isinstance(strategies, dict) else strategies
            self.native.setdefault(c, [])
            if name not in self.native[c]:
                self.native[c].append(name)
            if given is not None:
                self._strategies[c, None] = given
        if parent or child:
            self.link(name, parent, child)
            self._drop_derived(self.columns)
        self.propagate()

    def _prepared(self, layer: DataFrame, id_col: str = "id", crs: str | None = None) -> DataFrame:
        if dict(layer.dtypes).get("geometry") == "binary":
            layer = wkb.decoded(layer)
        if id_col != "id":
            layer = layer.withColumnRenamed(id_col, "id")
        elif "id" not in layer.columns:
            layer = numbered(layer)
        if crs and self.crs:
            layer = pr.reprojected(layer, crs, self.crs)
        layer = pr.in_metres(measured(layer), self.crs)
        return cut(layer) if "shape" in layer.columns or self.crs else layer  # so that shapes are measured once

    def set_column(self, level: str, values: DataFrame, column: str) -> None:
        """Gives a level native values (id, column) and propagates them."""
        self.tables[level] = self.tables[level].drop(column).join(values.select("id", column), "id", "left")
        self.native.setdefault(column, [])
        if level not in self.native[column]:
            self.native[column].append(level)
        self._drop_derived([column])
        self.propagate()

    def level(self, name: str, columns: str | Iterable[str] | None = None) -> DataFrame:
        """Geometry with attributes, all or the named ones."""
        wanted = self.tables[name] if columns is None else self.tables[name].select("id", *(c for c in _listed(columns) if c != "id"))
        return self.geometry[name].join(wanted, "id")

    __getitem__ = level

    def bounds(self, name: str) -> DataFrame:
        return self.geometry[name].agg(*((F.min if c.startswith("min") else F.max)(c).alias(c) for c in mp.BOX))

    # --- propagation ----------------------------------------------------------------------------------------------

    def propagate(self) -> None:
        """Fills the columns into all levels that edges and strategies reach. Running it again changes nothing."""
        if not self.tables:
            return
        self._walk(upward=True)
        self._walk(upward=False)
        self._fill_nulls()
        for c in self.columns:
            if missing := [n for n in self.tables if c not in self.tables[n].columns]:
                warnings.warn(f"column {c} did not reach {', '.join(missing)}: set_strategy may be missing on the way", stacklevel=2)

    def _walk(self, upward: bool) -> None:
        queue = deque(self.tables)
        while queue:
            src = queue.popleft()
            for dst in (self.parents if upward else self.children)[src]:
                if dst not in self.tables:
                    continue
                have, at = set(self.tables[src].columns), set(self.tables[dst].columns)
                plans = {c: s for c in self.columns if c in have and c not in at and (s := self.strategy(c, src, strict=False))}
                if not plans:
                    continue
                new = self._edge(src, dst, plans, upward)
                self.tables[dst] = cut(self.tables[dst].join(new, "id", "left"))
                if dst not in queue:
                    queue.append(dst)

    def mapping(self, fine: str, coarse: str, strategy: st.Strategy, down: bool = False) -> DataFrame:
        """The mapping between two levels that a strategy asks for; made once and written out."""
        key = (fine, coarse, "near", strategy.k, strategy.power) if strategy.nearest and down else (fine, coarse, strategy.geoweighted, strategy.mode)
        if key not in self._mappings:
            low, high = self.geometry[fine], self.geometry[coarse]

            def made() -> DataFrame:
                if key[2] == "near":
                    return nr.knn_mapping(low, high, self.size, strategy.k, strategy.power, areas=True)
                return mp.id_mapping(low, high, self.size, strategy.geoweighted, strategy.mode)

            self._mappings[key] = kept_mapping(self.folder, f"{fine}-{coarse}", low, high, made, *key[2:]) if self.folder else cut(made())
        return self._mappings[key]

    def _edge(self, src: str, dst: str, plans: dict[str, st.Strategy], upward: bool) -> DataFrame:
        """id and the columns at dst. Columns whose strategies share a mapping are computed together."""
        groups: dict[tuple, dict[str, st.Strategy]] = {}
        for c, s in plans.items():
            groups.setdefault((s.nearest and not upward, s.geoweighted, s.mode, s.k, s.power), {})[c] = s
        out: DataFrame | None = None
        for same in groups.values():
            one = self._moved(src, dst, same, upward)
            out = one if out is None else out.join(one, "id", "full")
        return out

    def _moved(self, src: str, dst: str, plans: dict[str, st.Strategy], upward: bool, rescale: bool = True) -> DataFrame:
        first = next(iter(plans.values()))
        weights = [s.weight for s in plans.values() if s.weight]
        if lacking := [w for w in weights if w not in self.tables[src].columns]:
            raise KeyError(f"level {src} has no column {lacking[0]} to weigh by")
        data = self.tables[src].select("id", *dict.fromkeys([*plans, *weights]))
        fine, coarse = (src, dst) if upward else (dst, src)
        mapping = self.mapping(fine, coarse, first, down=not upward)
        if upward:
            return st.upscale_by(mapping, data, plans)
        down = st.downscale(mapping, data, plans)
        return st.rescale(down, data, [c for c, s in plans.items() if s.preserve_total]) if rescale else down

    def _fill_nulls(self) -> None:
        """Nulls of a column that a level has, from its parents, coarse levels first as they come."""
        queue = deque(self.tables)
        while queue:
            name = queue.popleft()
            parents = [p for p in self.parents[name] if p in self.tables]
            wanted = [c for c in self.columns if c in self.tables[name].columns and any(c in self.tables[p].columns for p in parents)]
            changed = False
            left = self._nulls(name, wanted)
            for p in parents:
                open_ = {c: s for c in wanted if left[c] and c in self.tables[p].columns and (s := self.strategy(c, p, strict=False)) and (not s.weight or s.weight in self.tables[p].columns)}
                now_is = lambda s: (self.tables[name], self.tables[p], s)  # noqa: E731, B023
                open_ = {c: s for c, s in open_.items() if not all(a is b for a, b in zip(self._idle.get((name, p, c), (None,) * 3), now_is(s)))}
                if not open_:
                    continue
                table = self.tables[name]
                for c, s in open_.items():
                    given = self._moved(p, name, {c: s}, upward=False, rescale=False).withColumnRenamed(c, "_given")
                    table = table.join(given, "id", "left").withColumn(c, F.coalesce(st.clean(F.col(c).cast("double")), "_given")).drop("_given")
                before, self.tables[name] = self.tables[name], cut(table)
                now = self._nulls(name, wanted)
                if any(now[c] < left[c] for c in open_):
                    left, changed = now, True
                else:
                    self.tables[name] = before
                    self._counted[name] = (before, left)
                    self._idle |= {(name, p, c): now_is(s) for c, s in open_.items()}
            if changed:
                queue.extend(c for c in self.children[name] if c in self.tables and c not in queue)

    def _nulls(self, name: str, columns: list[str]) -> dict[str, int]:
        """Nulls of each column: one job that returns one row, for the columns that are not counted yet."""
        table, known = self.tables[name], {}
        if name in self._counted and self._counted[name][0] is table:
            known = dict(self._counted[name][1])
        if new := [c for c in columns if c not in known]:
            numeric = {c for c, t in table.dtypes if t in ("double", "float")}
            row = table.agg(*(F.count(F.when(F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False)), 1)).alias(c) for c in new)).first()
            known |= {c: row[c] for c in new}
        self._counted[name] = (table, known)
        return {c: known[c] for c in columns}

    # --- data that is no level ------------------------------------------------------------------------------------

    def add_vector(self, layer: DataFrame, level: str, strategies: st.Strategy | dict[str, st.Strategy], columns: str | Iterable[str] | None = None, measure: str | None = None, upward: bool | None = None, buffer: float = 0.0, ring_only: bool = False, fill_null: float | dict[str, float] | None = 0.0, mode: str | None = None, crs: str | None = None) -> None:
        """Brings columns of a layer that is no level into one level, replacing them there, and propagates.

        Every row of the layer counts for itself, whatever its ``id``. ``upward``: whether the layer is the finer side; by
        default if its median measure is below the level's. ``buffer`` widens the coarse side by so many metres
        (units of the system, if it has no degrees), ``ring_only`` to the border of that. Values that nothing reaches become ``fill_null`` (None: they stay null).
        """
        layer = self._prepared(layer.drop("id"), crs=crs)
        names = _listed(columns) or [c for c in layer.columns if c not in GEOMETRY]
        plans = {c: strategies[c] if isinstance(strategies, dict) else strategies for c in names if not isinstance(strategies, dict) or c in strategies}
        measure = measure or ("area" if layer.filter("geometry_type = 'Polygon'").take(1) else "length")
        if upward is None:
            medians = [x.agg(F.median(measure)).first()[0] for x in (layer, self.geometry[level])]  # a row each
            upward = medians[0] < medians[1]
        level_geometry = self.geometry[level]
        if buffer > 0:
            if upward:
                level_geometry = buffered(level_geometry, buffer, self.crs, ring_only)
            else:
                layer = buffered(layer, buffer, self.crs, ring_only)
        fine, coarse = (layer, level_geometry) if upward else (level_geometry, layer)
        data = layer.select("id", *dict.fromkeys([*plans, *(s.weight for s in plans.values() if s.weight)]))
        out: DataFrame | None = None
        groups: dict[tuple, dict[str, st.Strategy]] = {}
        for c, s in plans.items():
            groups.setdefault((s.geoweighted, s.mode, s.nearest and not upward, s.k, s.power), {})[c] = s
        for (geoweighted, own, near, k, power), same in groups.items():
            mapping = nr.knn_mapping(fine, coarse, self.size, k, power, areas=True) if near else mp.id_mapping(fine, coarse, self.size, geoweighted, mode or own)
            one = st.upscale_by(mapping, data, same) if upward else st.downscale(mapping, data, same)
            out = one if out is None else out.join(one, "id", "full")
        out = out.select("id", *(st.clean(F.col(c).cast("double")).alias(c) for c in plans))
        table = self.tables[level].drop(*plans).join(out, "id", "left")
        fill = {c: fill_null for c in plans} if isinstance(fill_null, (int, float)) else fill_null or {}
        self.tables[level] = cut(table.fillna(fill) if fill else table)
        for c, s in plans.items():
            self.native.setdefault(c, [])
            if level not in self.native[c]:
                self.native[c].append(level)
            self._strategies[c, None] = s
        self._drop_derived(plans)
        self.propagate()

    def add_raster(self, pixels: DataFrame, transform, column: str, level: str, strategy: st.Strategy, upward: bool = True, nodata: float | None = None, crs: str | None = None) -> None:
        """Pixel centres (row, col, value) as points into a level."""
        from .operators.raster import pixel_points

        points = pixel_points(pixels, transform, nodata).withColumnRenamed("value", column)
        points = points.select("id", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"), column)
        self.add_vector(points, level, strategy, [column], measure="area", upward=upward, crs=crs)
