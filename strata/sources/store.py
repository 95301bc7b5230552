"""Layers, mappings and cell tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import cells as cl
from ..operators.mapping import BOX
from ..operators.shapes import GEOMETRIES, shaped


def fingerprint(layer: DataFrame) -> str:
    """A key of a layer's geometry: count, bounds and an order-free sum over the rows' ids, boxes and shapes."""
    layer = shaped(layer)
    names = ["id", *BOX, *(["shape", "dim"] if "shape" in layer.columns else [])]
    mark = F.xxhash64(*names).cast("decimal(38,0)")
    row = layer.agg(F.count("*"), F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), F.sum(mark), F.bit_xor(F.xxhash64(*names, F.lit(1)))).first()  # one row
    return row_key(*row)


def row_key(*parts) -> str:
    from hashlib import sha256

    return sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def mapping_path(folder: str, name: str, key: str) -> str:
    return f"{folder.rstrip('/')}/{name}__{key}.parquet"


def save_mapping(mapping: DataFrame, folder: str, name: str, key: str) -> str:
    path = mapping_path(folder, name, key)
    mapping.write.mode("overwrite").parquet(path)
    return path


def load_mapping(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame | None:
    """The saved mapping; None if there is none."""
    path = mapping_path(folder, name, key)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(path)


def kept_mapping(folder: str, name: str, src: DataFrame, dst: DataFrame, build, *settings, force: bool = False) -> DataFrame:
    """The mapping that ``build()`` gives, saved under the geometry of both layers and the settings, and read from there
    the next time; ``force`` builds it anew."""
    spark = src.sparkSession
    key = row_key(fingerprint(src), fingerprint(dst), *settings)
    found = None if force else load_mapping(spark, folder, name, key)
    if found is None:
        save_mapping(build(), folder, name, key)
        found = load_mapping(spark, folder, name, key)
    return found


def write_tiles(cells: DataFrame, folder: str, level: int = 5, rows_per_file: int = 1_000_000) -> None:
    """One folder per ancestor tile (tile=...), with the cells' bounds. Rows are spread within a tile, so a dense tile is
    written by several tasks, one file each."""
    dealt = cl.partition_by_ancestor(cells, level).withColumns(cl.bounds(F.col("cell")))
    counts = dealt.groupBy("tile").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    spread = dealt.join(counts, "tile").withColumn("_salt", F.pmod(F.xxhash64("cell"), F.col("_files")))
    spread.repartition("tile", "_salt").drop("_files", "_salt").write.mode("overwrite").partitionBy("tile").parquet(folder)


def read_columns(spark: SparkSession, paths: str | list[str], columns: list[str], schema: StructType | None = None) -> DataFrame:
    """Only the named columns of Parquet files or folders; no path gives an empty table, its columns of the types in
    ``schema`` (else strings)."""
    if banned := {"geometry", *GEOMETRIES} & set(columns):
        raise ValueError(f"not a plain column: {sorted(banned)[0]}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        types = {f.name: f.dataType for f in schema or ()}
        return spark.createDataFrame([], StructType()).select(*(F.lit(None).cast(types.get(c, "string")).alias(c) for c in columns))
    return spark.read.parquet(*paths).select(*columns)
