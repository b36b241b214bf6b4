"""A table as layers: a whole one below, and changed rows above it, merged when they are read.

A save of changes writes the changed rows alone, and a list of the layers that it lies on; readers
take the newest row of each key. ``compact`` makes one whole layer of them. Both are saves of
``versions``: seen whole or not at all, refused if another came in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

_LIST = "layer int, version string"


def _layers(spark: SparkSession, root: str, after: int) -> list[str]:
    """The versions that the entry lies on, the lowest first; the last is its own."""
    if not after:
        return []
    own = versions.named(spark, root, after)
    return [*(r.version for r in spark.read.schema(_LIST).parquet(f"{root}/{own}/layers").orderBy("layer").collect()), own]


def _save(root: str, name: str, rows: DataFrame, below: list[str], after: int) -> str:
    names = rows.sparkSession.createDataFrame(list(enumerate(below)), _LIST)
    return versions.save(root, after=after, **{name: rows, "layers": names})


def save_whole(root: str, name: str, rows: DataFrame) -> str:
    """A new lowest layer."""
    return _save(root, name, rows, [], versions.head(rows.sparkSession, root))


def save_changes(root: str, name: str, rows: DataFrame, after: int | None = None) -> str:
    """Changed and new rows, as a layer on what is there; after: the entry that they were made from."""
    spark = rows.sparkSession
    after = versions.head(spark, root) if after is None else after
    return _save(root, name, rows, _layers(spark, root, after), after)


def load(spark: SparkSession, root: str, name: str, key: str = "id") -> DataFrame:
    """The table: of each key the row of the highest layer that has it."""
    found = _layers(spark, root, versions.head(spark, root))
    if not found:
        raise ValueError(f"no table below {root}")
    out = spark.read.parquet(f"{root}/{found[0]}/{name}")
    if len(found) == 1:
        return out
    upper = None
    for i, version in enumerate(found[1:]):
        rows = spark.read.schema(out.schema).parquet(f"{root}/{version}/{name}").withColumn("__layer", F.lit(i))
        upper = rows if upper is None else upper.unionByName(rows)
    newest = upper.groupBy(key).agg(F.max_by(F.struct(*out.columns), "__layer").alias("row"))
    # the layers above are small beside the lowest, whose rows are read once and not gathered by key
    return out.join(newest.select(key), key, "left_anti").select(out.columns).unionByName(newest.select("row.*"))


def compact(spark: SparkSession, root: str, name: str, key: str = "id") -> str:
    """One whole layer in place of all."""
    after = versions.head(spark, root)
    return _save(root, name, load(spark, root, name, key), [], after)
