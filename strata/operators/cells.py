"""A cell grid in columns: quad-tree cells in web-mercator, addressed by (level, x, y) and held as one long.

A cell nests exactly in one parent, knows its centre, bounds and area, and has eight neighbours. Ids and shapes differ from
those of hexagonal grids; what such grids are used for here holds: assigning points, rolling up, halos and partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import shapes as sh

DEEPEST = 28
LIMIT = 85.0511287798066  # degrees of latitude at which the map is square
EARTH = 6_371_000.0  # metres


def tile_x(lng: Column, level: int | Column) -> Column:
    """Column of the tile (or cell) that holds a longitude."""
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.least(F.greatest(F.floor((lng + 180) / 360 * n), F.lit(0)), (n - 1).cast("long"))


def tile_y(lat: Column, level: int | Column) -> Column:
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    angle = F.radians(F.least(F.greatest(lat, F.lit(-LIMIT)), F.lit(LIMIT)))
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(angle) + 1 / F.cos(angle)) / math.pi) / 2 * n), F.lit(0)), (n - 1).cast("long"))


def make(level: int | Column, x: Column, y: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftleft(x.cast("long"), 28)).bitwiseOR(y.cast("long"))


def cell_of(lng: Column, lat: Column, level: int | Column) -> Column:
    return make(level, tile_x(lng, level), tile_y(lat, level))


def level_of(cell: Column) -> Column:
    return F.shiftright(cell, 56).cast("int")


def x_of(cell: Column) -> Column:
    return F.shiftright(cell, 28).bitwiseAND(F.lit((1 << 28) - 1))


def y_of(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << 28) - 1))


def parent(cell: Column, level: int | Column) -> Column:
    """The cell's ancestor at a level; the cell itself if the level is not above."""
    level = F.lit(level) if isinstance(level, int) else level
    down = level_of(cell) - level
    x, y = (F.call_function("shiftright", c, down) for c in (x_of(cell), y_of(cell)))
    return F.when(down > 0, make(level, x, y)).otherwise(cell)


def children(cell: Column, level: int) -> Column:
    """Array of the cell's descendants at a level."""
    side = F.pow(F.lit(2.0), F.lit(level) - level_of(cell)).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), side * side - 1)
    return F.transform(steps, lambda k: make(level, x_of(cell) * side + k % side, y_of(cell) * side + F.floor(k / side)))


def ring(cell: Column) -> Column:
    """Array of the up to eight neighbours (round the date line, not over the poles)."""
    n = F.pow(F.lit(2.0), level_of(cell)).cast("long")
    steps = F.array(*(F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    inside = F.filter(steps, lambda d: (y_of(cell) + d["y"]).between(F.lit(0), n - 1))
    return F.array_distinct(F.transform(inside, lambda d: make(level_of(cell), F.pmod(x_of(cell) + d["x"], n), y_of(cell) + d["y"])))


def _lng(x: Column, level: Column) -> Column:
    return x / F.pow(F.lit(2.0), level) * 360 - 180


def _lat(y: Column, level: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), level)))))


def centre(cell: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of the cell's square."""
    return _lng(x_of(cell) + 0.5, level_of(cell)), _lat(y_of(cell) + 0.5, level_of(cell))


def bounds(cell: Column) -> dict[str, Column]:
    x, y, z = x_of(cell), y_of(cell), level_of(cell)
    return {"minx": _lng(x, z), "miny": _lat(y + 1, z), "maxx": _lng(x + 1, z), "maxy": _lat(y, z)}


def area(cell: Column) -> Column:
    """Square metres on the sphere."""
    b = bounds(cell)
    return EARTH**2 * F.radians(b["maxx"] - b["minx"]) * (F.sin(F.radians(b["maxy"])) - F.sin(F.radians(b["miny"])))


def edge_metres(level: int, lat: float = 0.0) -> float:
    """Side of a cell of a level at a latitude."""
    return 2 * math.pi * EARTH / 2**level * math.cos(math.radians(lat))


def boxes(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """A layer of the cells: id (the cell) and bounds; other columns stay."""
    return cells.withColumns({"id": F.col(cell), **bounds(F.col(cell))}).drop(*([cell] if cell != "id" else []))


def cover(layer: DataFrame, level: int) -> DataFrame:
    """Distinct cells of a level whose centre lies in one of the layer's boxes or polygons. The rows of cells are exploded in
    two steps, columns of the grid first, so a wide box does not make one huge array."""
    layer = sh.shaped(layer)
    box = layer.filter("minx <= maxx and miny <= maxy")
    wide = box.withColumn("_x", F.explode(F.sequence(tile_x(F.col("minx"), level), tile_x(F.col("maxx"), level))))
    tall = wide.withColumn("_y", F.explode(F.sequence(tile_y(F.col("maxy"), level), tile_y(F.col("miny"), level)))).withColumn("cell", make(level, F.col("_x"), F.col("_y")))
    lng, lat = centre(F.col("cell"))
    inside = lng.between(F.col("minx"), F.col("maxx")) & lat.between(F.col("miny"), F.col("maxy"))
    found = tall.filter(inside)
    if "shape" in layer.columns:
        found = found.withColumn("_in", sh.holds("shape", "dim", lng, lat)).filter(F.col("shape").isNull() | F.col("_in"))
    return found.select("cell").distinct()


def roll_up(cells: DataFrame, level: int, values: list[str], how: str = "sum") -> DataFrame:
    """Values of cells summed up (or averaged) over their ancestors at a level."""
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return cells.groupBy(parent(F.col("cell"), level).alias("cell")).agg(*(agg(v).alias(v) for v in values))


def partition_by_ancestor(cells: DataFrame, level: int = 5) -> DataFrame:
    """Adds the tile that each cell belongs to, the key to write or compute by."""
    return cells.withColumn("tile", parent(F.col("cell"), level))


def chunk_keys(cells: DataFrame, most: int = 150_000, base: int = 4, deepest: int = 9) -> DataFrame:
    """Adds ``chunk``, the key res{level}_{cell}: the coarsest ancestor from ``base`` on with at most ``most`` rows, the one at
    ``deepest`` if there is none. Counts of the deepest ancestors are rolled up, so rows are shuffled for one join only."""
    finest = cells.groupBy(parent(F.col("cell"), deepest).alias("leaf")).agg(F.count("*").alias("n"))
    plan, chosen = finest, F.lit(None).cast("long")
    for level in range(deepest, base - 1, -1):
        own = parent(F.col("leaf"), level)
        counts = finest.groupBy(own.alias(f"_k{level}")).agg(F.sum("n").alias(f"_n{level}"))
        plan = plan.withColumn(f"_k{level}", own).join(counts, f"_k{level}")
        fits = (F.col(f"_n{level}") <= most) if level < deepest else F.lit(True)
        chosen = F.when(fits, F.col(f"_k{level}")).otherwise(chosen)
    key = F.concat(F.lit("res"), level_of(F.col("_at")).cast("string"), F.lit("_"), F.lower(F.hex("_at")))
    plan = plan.withColumn("_at", chosen).select(F.col("leaf").alias("_leaf"), key.alias("chunk"))
    return cells.withColumn("_leaf", parent(F.col("cell"), deepest)).join(plan, "_leaf").drop("_leaf")
