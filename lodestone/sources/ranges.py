"""Byte ranges of files: listed without being read, and read from where they begin.

Files are listed by Spark; a range is read in a Python worker through Arrow's file systems, which
seek. Nothing but the range is read.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .scratch import written

#: What a task of many whole files reads at most, and what opening a file counts for beside its bytes.
TASK_BYTES = 16 << 20
OPEN_BYTES = 16 << 10
#: Rows of a listing that are passed on at once.
LISTED = 10_000


def listed(spark: SparkSession, root: str, pattern: str = "*.jsonl", skip: str = r"/subagents/") -> DataFrame:
    """(path, size, mtime_ms) of the files below ``root``, those under skipped folders aside; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(~F.col("path").rlike(skip)).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read(ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, start, size and more) with ``bytes``: what the file holds from ``start`` to ``size``; null for a file that is gone."""
    kind = StructType([*ranges.schema.fields, StructField("bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path, start, size = (row.column(n)[0].as_py() for n in ("path", "start", "size"))
                system, place = fs.FileSystem.from_uri(path)
                try:
                    with system.open_input_file(place) as f:
                        f.seek(start)
                        found = f.read(max(size - start, 0))
                except FileNotFoundError:
                    found = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([found], pa.binary())], names=[*row.schema.names, "bytes"])

    return ranges.mapInArrow(run, kind)


def tails(spark: SparkSession, root: str, most: int = 1 << 20, pattern: str = "*.jsonl", skip: str = r"/subagents/") -> DataFrame:
    """(path, line_no, value): the whole lines in the last ``most`` bytes of each file, numbered from the first of them.

    At most that many bytes of a file are read. The first line is left out where the range doesn't
    begin with the file, as it may be cut, inside a character too; empty lines are left out. Bytes
    that are no UTF-8 become the replacement character.
    """
    ranges = listed(spark, root, pattern, skip).withColumn("start", F.greatest(F.col("size") - most, F.lit(0)))
    lines = read(ranges).select("path", "start", F.posexplode(F.split(F.make_valid_utf8(F.col("bytes").cast("string")), "\n")).alias("line_no", "value"))
    return lines.where("(start = 0 or line_no > 0) and value <> ''").drop("start")


def reachable(root: str) -> bool:
    """Whether Arrow's file systems have the folder's; else only Spark reads it."""
    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def walked(spark: SparkSession, root: str, pattern: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(path, size) of the files of that name below ``root``, paths from there; folders directly below it that are left out aren't listed.

    Tasks list the folders, level by level, into tables: files never pass through the driver, and a
    folder is listed by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True))
                kept = [x for x in found if (fnmatch.fnmatchcase(x.base_name, pattern) if x.is_file else folder or x.base_name not in leave_out)]
                for i in range(0, len(kept), LISTED):
                    some = kept[i : i + LISTED]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.base_name}".lstrip("/") for x in some], pa.string()), pa.array([x.size if x.is_file else None for x in some], pa.int64())], names=["path", "size"])

    level, files = spark.createDataFrame([("",)], "folder string"), None
    while True:
        found = written(level.mapInArrow(run, "path string, size long"), "listing")
        here = found.where("size is not null")
        files = here if files is None else files.unionByName(here)
        level = found.where("size is null").select(F.col("path").alias("folder"))
        folders = level.count()
        if not folders:
            return files
        level = level.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism))


def whole(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes) of ``files`` (path, size) below ``root``, dealt out by their bytes, so that many small files are one task."""
    work = files.agg(F.sum(F.col("size") + OPEN_BYTES)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_file(f"{top}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "bytes"])

    return files.repartition(1 + work // TASK_BYTES).mapInArrow(run, "path string, bytes binary")
