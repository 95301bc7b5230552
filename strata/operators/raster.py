"""Rasters as DataFrames (row, col, value) with an affine transform, and their way to polygons, points and cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strategies import finite
from ..scratch import cut, dealt, is_few
from . import cells as cl
from . import mapping as mp
from . import shapes as sh


@dataclass(frozen=True)
class Affine:
    """x = a * col + b * row + c, y = d * col + e * row + f; (col, row) + 0.5 is a pixel's centre."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def xy(self, col: Column, row: Column) -> tuple[Column, Column]:
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the pixel that holds a point."""
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform cannot be inverted")
        dx, dy = x - self.c, y - self.f
        return F.floor((self.a * dy - self.d * dx) / det), F.floor((self.e * dx - self.b * dy) / det)

    def upright(self) -> None:
        if self.b or self.d:
            raise NotImplementedError("only axis-aligned transforms have pixels that are boxes")


def pixel_points(pixels: DataFrame, transform: Affine, nodata: float | None = None) -> DataFrame:
    """value, x, y and half-pixel bounds of the pixels with a finite value other than ``nodata``; id is their place."""
    x, y = transform.xy(F.col("col") + 0.5, F.col("row") + 0.5)
    half = abs(transform.a) / 2, abs(transform.e) / 2
    kept = pixels.withColumn("value", finite(F.col("value").cast("double"), nodata)).filter("value is not null")
    place = F.concat_ws(":", "row", "col")
    return kept.select(place.alias("id"), "value", x.alias("x"), y.alias("y"), (x - half[0]).alias("minx"), (y - half[1]).alias("miny"), (x + half[0]).alias("maxx"), (y + half[1]).alias("maxy"))


def window(pixels: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of half-open ranges of rows and columns."""
    for name, span in (("row", rows), ("col", cols)):
        if span is not None:
            pixels = pixels.filter((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    return pixels


def valid_totals(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """One row: sum, mean and count of the valid pixels."""
    v = finite(F.col("value").cast("double"), nodata)
    return pixels.agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def density_bounds(pixels: DataFrame, transform: Affine, nodata: float | None = None) -> DataFrame:
    """One row: least and greatest value per area unit."""
    v = finite(F.col("value").cast("double"), nodata) / abs(transform.a * transform.e)
    return pixels.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def to_polygons(pixels: DataFrame, transform: Affine, polygons: DataFrame, size: float, nodata: float | None = None) -> DataFrame:
    """id, value: each pixel is split over the polygons that it meets, by area. A pixel that meets one polygon goes there
    whole; shares of others are scaled so that nothing is lost; without common area a pixel that meets several is dropped.
    Polygons of one shape are met once and counted."""
    transform.upright()
    points = cut(pixel_points(pixels, transform, nodata).select("id", "value", *mp.BOX))
    polygons = sh.shaped(polygons)
    rows = polygons.select("id", F.struct(*(c for c in (*mp.BOX, "shape", "dim") if c in polygons.columns)).alias("key"))
    shapes = cut(rows.groupBy("key").agg(F.count("*").alias("times")).withColumn("dst_id", F.monotonically_increasing_id()))
    few = is_few(shapes)
    met = mp.related(points.select("id", *mp.BOX), shapes.select(F.col("dst_id").alias("id"), "key.*"), size)
    met = met.select("src_id", "dst_id", "part").join(dealt(shapes.select("dst_id", "times"), few), "dst_id")
    sums = met.groupBy("src_id").agg(F.sum("times").alias("n"), F.sum(F.col("part") * F.col("times")).alias("whole_part"))
    shares = met.join(sums, "src_id").filter("n = 1 or whole_part > 0")
    share = F.when(F.col("n") == 1, 1.0).otherwise(F.col("part") / F.col("whole_part"))
    valued = shares.withColumn("share", share).join(points.select(F.col("id").alias("src_id"), "value"), "src_id")
    values = valued.groupBy("dst_id").agg(F.sum(F.col("value") * F.col("share")).alias("value")).join(dealt(shapes.select("dst_id", "key"), few), "dst_id")
    return rows.join(dealt(values.select("key", "value"), few), "key").groupBy("id").agg(F.sum("value").alias("value"))


def to_cells(pixels: DataFrame, transform: Affine, level: int, size: float, nodata: float | None = None) -> DataFrame:
    """cell, value: the pixels split by area over the cells that they touch. One join over the whole raster: cells at the
    border of a partition need no halo."""
    box = pixel_points(pixels, transform, nodata)
    grid = cl.boxes(_touched(box, level))
    return to_polygons(pixels, transform, grid, size, nodata).withColumnRenamed("id", "cell")


def _touched(boxes: DataFrame, level: int) -> DataFrame:
    """Distinct cells that the boxes touch."""
    wide = boxes.withColumn("_x", F.explode(F.sequence(cl.tile_x(F.col("minx"), level), cl.tile_x(F.col("maxx"), level))))
    return wide.withColumn("_y", F.explode(F.sequence(cl.tile_y(F.col("maxy"), level), cl.tile_y(F.col("miny"), level)))).select(cl.make(level, F.col("_x"), F.col("_y")).alias("cell")).distinct()


def to_cells_tiled(pixels: DataFrame, transform: Affine, level: int, size: float, tile_level: int = 5, nodata: float | None = None) -> DataFrame:
    """As ``to_cells``, dealt by the cells' ancestors at ``tile_level``, with the tile as a column to write by."""
    if level <= tile_level:
        raise ValueError("cells must be finer than tiles")
    return cl.partition_by_ancestor(to_cells(pixels, transform, level, size, nodata), tile_level).repartition("tile")


def pixel_area(lat: Column, width: float, height: float, geographic: bool = True) -> Column:
    """Square metres of a pixel (equirectangular), or its plain area in a projected system."""
    if not geographic:
        return F.lit(abs(width * height))
    return F.abs(math.radians(width) * cl.EARTH * F.cos(F.radians(lat)) * math.radians(height) * cl.EARTH)


def _scaled(cells: DataFrame, goal: DataFrame, how: str) -> DataFrame:
    """Values times goal / (their own sum or mean); both are one row. Untouched where one of them is 0 or missing."""
    got = cells.agg((F.sum if how == "sum" else F.avg)("value").alias("_got"))
    both = cells.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(goal))
    fits = F.col("_got") > 0 if how == "sum" else F.col("_got") != 0
    return both.withColumn("value", F.when(fits & F.col("_goal").isNotNull(), F.col("value") * F.col("_goal") / F.col("_got")).otherwise(F.col("value"))).select(*cells.columns)


def points_to_cells(points: DataFrame, level: int, is_count: bool = True) -> DataFrame:
    """cell, value from points (lng, lat, value and, for counts, area in square metres).

    Counts: mean density of a cell's points times the cell's area, scaled so that the total holds. Rates: mean of a cell's
    points, scaled so that the mean over cells is the mean over points.
    """
    if is_count and "area" not in points.columns:
        raise ValueError("counts need the area of each point")
    valid = points.filter(finite("lng").isNotNull() & finite("lat").isNotNull() & finite("value").isNotNull())
    if is_count:
        valid = valid.filter(finite("area") > 0)
    placed = valid.withColumn("cell", cl.cell_of(F.col("lng"), F.col("lat"), level))
    each = F.avg(F.col("value") / F.col("area")) if is_count else F.avg("value")
    cells = placed.groupBy("cell").agg(each.alias("value"))
    if is_count:
        cells = cells.withColumn("value", F.col("value") * cl.area(F.col("cell")))
    return _scaled(cells, valid.agg((F.sum if is_count else F.avg)("value").alias("_goal")), "sum" if is_count else "mean")


def to_cells_nearest(pixels: DataFrame, transform: Affine, level: int, is_count: bool = True, geographic: bool = True, nodata: float | None = None) -> DataFrame:
    """Pixel centres (longitude, latitude) into the cells that hold them."""
    points = pixel_points(pixels, transform, nodata).select(F.col("x").alias("lng"), F.col("y").alias("lat"), "value", pixel_area(F.col("y"), transform.a, transform.e, geographic).alias("area"))
    return points_to_cells(points, level, is_count)


def cell_pixels(cells: DataFrame, transform: Affine, height: int, width: int) -> DataFrame:
    """cell, row, col of the pixel under each cell's centre; cells off the raster go."""
    row, col = transform.pixel(*cl.centre(F.col("cell")))
    return cells.select("cell", row.alias("row"), col.alias("col")).filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def apply_cell_pixels(mapping: DataFrame, pixels: DataFrame, nodata: float | None = None, level: int | None = None) -> DataFrame:
    """cell, value: the pixel's value for each cell that reads it (pixels wider than cells are read by several), summed up
    at ``level`` if one is given."""
    found = mapping.join(pixels.select("row", "col", finite(F.col("value").cast("double"), nodata).alias("value")), ["row", "col"]).filter("value is not null").select("cell", "value")
    return found if level is None else cl.roll_up(found, level, ["value"])


def to_cells_by_centre(pixels: DataFrame, transform: Affine, height: int, width: int, level: int, is_count: bool = True, geographic: bool = True, nodata: float | None = None) -> DataFrame:
    """The value under each cell's centre: as a density times the cell's area for counts, scaled to the raster's total, or
    as it is for rates, scaled to the raster's mean."""
    spark = pixels.sparkSession
    corner = [(transform.a * c + transform.b * r + transform.c, transform.d * c + transform.e * r + transform.f) for c in (0, width) for r in (0, height)]
    xs, ys = [p[0] for p in corner], [p[1] for p in corner]
    extent = spark.createDataFrame([(min(xs), min(ys), max(xs), max(ys))], "minx double, miny double, maxx double, maxy double")
    sampled = apply_cell_pixels(cell_pixels(cl.cover(extent, level), transform, height, width), pixels, nodata)
    totals = valid_totals(pixels, nodata)
    if not is_count:
        return _scaled(sampled, totals.select(F.col("mean").alias("_goal")), "mean")
    density = F.col("value") / pixel_area(cl.centre(F.col("cell"))[1], transform.a, transform.e, geographic)
    return _scaled(sampled.withColumn("value", density * cl.area(F.col("cell"))), totals.select(F.col("total").alias("_goal")), "sum")


def to_cells_auto(pixels: DataFrame, transform: Affine, height: int, width: int, level: int, is_count: bool = True, geographic: bool = True, nodata: float | None = None) -> DataFrame:
    """By centre where a cell's diagonal is under the pixels' side, else by the pixels in each cell."""
    lat = transform.f + transform.e * height / 2
    side = abs(transform.a), abs(transform.e)
    if geographic:
        side = math.radians(side[0]) * cl.EARTH * math.cos(math.radians(lat)), math.radians(side[1]) * cl.EARTH
    if cl.edge_metres(level, lat if geographic else 0.0) * math.sqrt(2) < sum(side) / 2:
        return to_cells_by_centre(pixels, transform, height, width, level, is_count, geographic, nodata)
    return to_cells_nearest(pixels, transform, level, is_count, geographic, nodata)
