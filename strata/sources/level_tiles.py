"""Tile archives of whole levels: one file, or one for each chunk where a level has many rows."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..levels import Levels
from ..operators import cells as cl
from ..scratch import cut
from . import archive, vector_tiles as vt
from .tiles import ZOOMS, median_sizes, prepared, zoom_ranges

MOST = 150_000  # rows of one archive


def _cleared(folder: str, name: str) -> None:
    """Makes the folder, and removes the archives that an earlier run wrote for this level."""
    system, root = archive._system(folder)
    system.create_dir(root)
    for f in system.get_file_info(fs.FileSelector(root)):
        if re.fullmatch(rf"{re.escape(name)}(__res\d+_[0-9a-f]+)?\.pmtiles", f.base_name):
            system.delete_file(f.path)


def write_level_tiles(layer: DataFrame, folder: str, name: str, zooms: list[int], columns: list[str], most: int = MOST, base: int = 4, deepest: int = 9) -> DataFrame:
    """Writes a layer in degrees as vector tiles in archives; returns path, chunk (null: the whole layer), rows, tiles.

    Up to ``most`` rows go to {name}.pmtiles. Others are dealt to chunks of at most ``most`` rows by the ancestors of their
    boxes' middles, ``base`` to ``deepest`` levels deep (a chunk of the deepest level may have more), and each chunk goes to
    {name}__{chunk}.pmtiles. Rows without geometry are left out; a layer without rows gives an archive without tiles.
    """
    spark, folder = layer.sparkSession, folder.rstrip("/")
    layer = prepared(layer, columns)
    _cleared(folder, name)
    made: list[tuple[str, str | None, int, int]] = []  # a row for each archive

    def write(rows: DataFrame, chunk: str | None, count: int) -> None:
        path = f"{folder}/{name}{f'__{chunk}' if chunk else ''}.pmtiles"
        found = archive.write_archive(vt.tiles(rows, zooms, columns, name), path, {"name": name})
        made.append((path, chunk, count, found["tiles"]))

    count = layer.count()
    if count <= most:
        write(layer, None, count)
    else:
        middle = cl.cell_of((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, max(deepest, 12))
        dealt = cut(cl.chunk_keys(layer.withColumn("cell", middle), most, base, deepest).drop("cell"))
        for r in dealt.groupBy("chunk").count().orderBy("chunk").collect():
            write(dealt.filter(F.col("chunk") == r["chunk"]).drop("chunk"), r["chunk"], r["count"])
    return spark.createDataFrame(made, "path string, chunk string, rows long, tiles long")


def write_graph_tiles(levels: Levels, folder: str, columns: dict[str, list[str]], zooms: dict[str, tuple[int, int]] | None = None, deepest_zoom: int = 14, most: int = MOST) -> DataFrame:
    """Archives of the named levels of a graph; returns level, path, chunk, rows, tiles. ``columns``: of each level. ``zooms``:
    first and last zoom of a level; by default those of the levels' median sizes, cut at ``deepest_zoom``."""
    zooms = zooms or zoom_ranges(median_sizes(levels, list(columns)), *ZOOMS)
    out: DataFrame | None = None
    for name, wanted in columns.items():
        low, high = (min(z, deepest_zoom) for z in zooms[name])
        one = write_level_tiles(levels.level(name, wanted), folder, name, list(range(low, high + 1)), wanted, most).withColumn("level", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no levels")
    return out.select("level", "path", "chunk", "rows", "tiles")
