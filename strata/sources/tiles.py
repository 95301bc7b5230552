"""Map tiles: which features meet which tiles, tables of cells by tile, zoom ranges of levels, and value domains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..levels import Levels
from ..operators import cells as cl
from ..operators.shapes import shaped
from ..scratch import numbered

ZOOMS = (0, 25)


def feature_tiles(layer: DataFrame, zoom: int, buffer: float = 0.02) -> DataFrame:
    """The layer's rows for each tile (z, x, y) that their box meets; tiles are widened by a share of their side."""
    side = 360 / 2**zoom * buffer
    span = lambda low, high, tile, d: F.explode(F.sequence(tile(low - d, zoom), tile(high + d, zoom)))
    wide = layer.withColumn("x", span(F.col("minx"), F.col("maxx"), cl.tile_x, F.lit(side)))
    # the height of a tile shrinks towards the poles as the cosine of the latitude does
    low, high = F.col("miny"), F.col("maxy")
    d = side * F.cos(F.radians(F.least(F.abs(low), F.abs(high))))
    tall = wide.withColumn("y", F.explode(F.sequence(cl.tile_y(high + d, zoom), cl.tile_y(low - d, zoom))))
    return tall.withColumn("z", F.lit(zoom))


def prepared(layer: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with geometry, and the columns, numbers as float."""
    layer = shaped(layer)
    kept = [c for c in ("id", "minx", "miny", "maxx", "maxy", "shape", "dim") if c in layer.columns]
    numbers = {c for c, t in layer.dtypes if t in ("double", "bigint", "int", "decimal")}
    narrow = layer.select(*kept, *(F.col(c).cast("float").alias(c) if c in numbers else F.col(c) for c in columns))
    return narrow.filter("minx is not null and miny is not null and maxx >= minx and maxy >= miny")


def cell_tiles(cells: DataFrame, zooms: list[int], columns: list[str]) -> DataFrame:
    """z, x, y, entry: a JSON object per cell and tile that holds the cell's centre (NaN becomes null)."""
    lng, lat = cl.centre(F.col("cell"))
    numbers = {c for c, t in cells.dtypes if t in ("double", "float")}
    fields = [F.lower(F.hex("cell")).alias("cell"), *((F.when(~F.isnan(c), F.col(c)).alias(c) if c in numbers else F.col(c)) for c in columns)]
    placed = cells.withColumn("z", F.explode(F.array(*(F.lit(z) for z in zooms))))
    return placed.select("z", cl.tile_x(lng, F.col("z")).alias("x"), cl.tile_y(lat, F.col("z")).alias("y"), F.to_json(F.struct(*fields)).alias("entry"))


def write_cell_tiles(cells: DataFrame, folder: str, zooms: list[int], columns: list[str], rows_per_file: int = 500_000) -> None:
    """Folders z=/x=/y= of text files with a JSON object a line. Dense tiles are several files by several tasks."""
    entries = cell_tiles(cells, zooms, columns)
    counts = entries.groupBy("z", "x", "y").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    spread = entries.join(counts, ["z", "x", "y"]).withColumn("_salt", F.pmod(F.xxhash64("entry"), F.col("_files")))
    spread.repartition("z", "x", "y", "_salt").drop("_files", "_salt").write.mode("overwrite").partitionBy("z", "x", "y").text(folder)


def write_cells(cells: DataFrame, folder: str, columns: list[str]) -> None:
    """All cells as JSON objects, one a line, in one folder."""
    cell_tiles(cells, [0], columns).select("entry").write.mode("overwrite").text(folder)


def zoom_ranges(medians: dict[str, float], low: int = ZOOMS[0], high: int = ZOOMS[1]) -> dict[str, tuple[int, int]]:
    """Contiguous zooms for levels by median size, the coarsest from ``low`` on: borders lie midway between the sizes'
    logarithms and are scaled to the range, rounding half to even."""
    names = sorted(medians, key=lambda n: -medians[n])
    if not names:
        raise ValueError("no levels")
    count, logs = len(names), [math.log10(max(medians[n], 1e-12)) for n in names]
    middles = [(a + b) / 2 for a, b in zip(logs, logs[1:])]
    if count > 1 and logs[0] > logs[-1]:
        # the scale reaches as far beyond the outer sizes as the outer borders lie within
        top = 2 * logs[0] - middles[0]
        reach = top - (2 * logs[-1] - middles[-1])
        wished = [round(low + (top - m) / reach * (high - low)) for m in middles]
        # a level has one zoom at least: borders are raised to a running maximum that grows by one a level
        borders = [max(b - k for k, b in enumerate(wished[: i + 1])) + i for i in range(count - 1)]
        borders = [max(b, low + 1 + i) for i, b in enumerate(borders)]
        firsts = [low, *(b + 1 for b in borders)]
    else:  # equal sizes share evenly
        firsts = [round(low + (high - low) * i / count) for i in range(count)]
    lasts = [f - 1 for f in firsts[1:]] + [max(high, firsts[-1])]
    return dict(zip(names, zip(firsts, lasts)))


def median_sizes(levels: Levels, names: list[str] | None = None) -> dict[str, float]:
    """Median area or length of levels: one row each."""
    out = {}
    for n in names or list(levels.geometry):
        if n not in levels.geometry:
            raise ValueError(f"unknown level {n}")
        out[n] = levels.geometry[n].agg(F.median(levels.measure[n])).first()[0] or 1e-12
    return out


def domain(layer: DataFrame, column: str) -> DataFrame:
    """One row: least and greatest value, without nulls and NaN."""
    v = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return layer.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def categories(layer: DataFrame, column: str, palette: list[str]) -> DataFrame:
    """Different values of a column in order, each with a colour; the palette repeats."""
    found = layer.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    colours = F.array(*(F.lit(c) for c in palette))
    return numbered(found, "place", by="value").select("value", F.element_at(colours, (F.col("place") % len(palette) + 1).cast("int")).alias("colour"))
