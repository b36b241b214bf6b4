"""Tables as they lie in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Larger tables are never dealt out: their files are cut into enough parts.
SMALL_BYTES = 256 << 20


def spread(spark: SparkSession, path: str) -> DataFrame:
    """A table; a small one whose files are cut into fewer parts than there are cores is dealt out row by row, by no key."""
    rows = spark.read.parquet(path)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
