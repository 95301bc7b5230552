"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strata.llm import mixing, near_join, packing, secrets, toxicity
from strata.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not reject, each judged by its own text; null and empty texts stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its smallest id, null last. Rows without words stay, each; rows of one
    id with different texts are told apart."""
    return near_join.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark; null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows of equal id, source and text share their copies evenly; the null source
    is a source, null and empty texts have no words and are taken by the same steps."""
    what, keys = ("doc_id", "source", "text"), ("_key_a", "_key_b")
    nulls = [F.col(c).isNull() for c in what]
    keyed = docs.withColumn(keys[0], F.xxhash64(*what, *nulls)).withColumn(keys[1], F.hash(*nulls, *what).cast("long"))
    mixed = mixing.mix(keyed, carry=keys)
    taken = stored(mixed.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"), "taken")
    discard(mixed)
    rows = keyed.join(taken, [*keys]).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    own = F.expr("cast(_copies div _rows + if(_place <= _copies % _rows, 1, 0) as int)")
    return rows.withColumn("_own", own).filter("_own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences into which all rows are cut, in the order of the curve; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("secrets", hide_secrets), ("mixing", mix_sources), ("packing", pack_documents)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
        last = docs
    return docs
