"""The session's shared folder, and cutting a plan by a checkpoint there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A temporary folder only in local mode, where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="strata-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint, so that long chains of steps are not planned and run again and again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that may go to each task.
FEW = 20_000


def is_few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def dealt(df: DataFrame, few: bool) -> DataFrame:
    """A side of a join: few rows go to each task, otherwise both sides are dealt by the key. Spark would decide by the size of
    the files, which does not tell how many rows come from a row by ``explode``, and the driver holds what goes to each task."""
    return F.broadcast(df) if few else df.hint("merge")


def numbered(df: DataFrame, column: str = "id", by: str | None = None) -> DataFrame:
    """Adds whole numbers from 0 on without gaps, in the order of the column ``by``. Without one they follow from the rows alone
    (the order of two hashes of all columns), not from how the table is split; equal rows are interchangeable."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.col(by) if by else F.xxhash64(*df.columns, *(F.col(c).isNull() for c in df.columns))
    marks = df.withColumns({"_a": one, "_b": F.xxhash64(F.lit(1), *df.columns)})
    dealt = marks.repartitionByRange(parts, "_a", "_b").sortWithinPartitions("_a", "_b").withColumn("_place", F.monotonically_increasing_id())
    dealt = cut(dealt.drop("_a", "_b").withColumns({"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = 0
    heads = []  # a row for each partition
    for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        heads.append((r["_part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(heads, "_part long, _before long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
