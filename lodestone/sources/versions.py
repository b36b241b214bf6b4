"""Several tables saved as one: whole versions beside each other, and a log that names the current one.

A save writes every table below a new version's folder first. Then it takes the next number of a
log: a file of that name, made only if there is none. The newest entry names the version that
readers see, so they see all of a save or nothing of it, and an earlier version can be named again.
Of two savers that started from the same entry one takes the number, and the other is refused and
may build its save anew on what it then finds (``update``). Paths may be on any file system that
Spark reaches and that makes a file only where there is none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Conflict(Exception):
    """Another save came in between."""


def _at(spark: SparkSession, path: str):
    """(file system, path) in Spark's own classes."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _entries(spark: SparkSession, root: str) -> list[int]:
    fs, log = _at(spark, f"{root}/{LOG}")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(log) if x.getPath().getName().isdigit()) if fs.exists(log) else []


def named(spark: SparkSession, root: str, entry: int) -> str:
    """The version that an entry names."""
    return spark.read.text(f"{root}/{LOG}/{entry:020}", wholetext=True).first().value


def _point(spark: SparkSession, root: str, version: str, after: int) -> None:
    """Makes ``version`` the current one, as the entry behind ``after``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, temp = _at(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(version.encode()))
    out.close()
    _, entry = _at(spark, f"{root}/{LOG}/{after + 1:020}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails where the entry is already there
    try:
        if fs.exists(entry):
            raise Conflict(f"entry {after + 1} is taken")
        try:
            context.rename(temp, entry, options)
        except Exception as e:
            if fs.exists(entry):
                raise Conflict(f"entry {after + 1} is taken") from e
            raise
    finally:
        fs.delete(temp, False)


def head(spark: SparkSession, root: str) -> int:
    """The number of the newest entry; 0 before the first save."""
    return max(_entries(spark, root), default=0)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see; None before the first save."""
    at = head(spark, root)
    return named(spark, root, at) if at else None


def save(root: str, /, after: int | None = None, **tables: DataFrame) -> str:
    """Writes all ``tables`` as a new version and makes it the current one; if one of them fails, nothing changes.

    after: the entry that the tables were made from (None: the newest when the save starts). If
    another save has come after it, this one is refused with ``Conflict`` and leaves nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    after = head(spark, root) if after is None else after
    version = uuid.uuid4().hex
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/{version}/{name}")
        _point(spark, root, version, after)
    except Exception:
        fs, place = _at(spark, f"{root}/{version}")
        fs.delete(place, True)
        raise
    return version


def update(spark: SparkSession, root: str, change: Callable[[str | None], dict[str, DataFrame]], tries: int = 5) -> str:
    """Saves what ``change`` makes of the current version; where another save came in between, of that one again."""
    for left in reversed(range(tries)):
        after = head(spark, root)
        try:
            return save(root, after=after, **change(named(spark, root, after) if after else None))
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def retain(spark: SparkSession, root: str, entries: int) -> list[str]:
    """Deletes the versions that none of the newest ``entries`` names, and the older entries; which versions went.

    Only versions of older entries go: one that is still being saved has no entry yet.
    """
    if entries < 1:
        raise ValueError("the current version stays")
    found = _entries(spark, root)
    old, kept = found[:-entries], found[-entries:]
    names = {named(spark, root, x) for x in kept}
    gone = sorted({named(spark, root, x) for x in old} - names)
    for name in gone:
        fs, place = _at(spark, f"{root}/{name}")
        fs.delete(place, True)
    for x in old:
        fs, place = _at(spark, f"{root}/{LOG}/{x:020}")
        fs.delete(place, False)
    return gone


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of an earlier one."""
    return spark.read.parquet(f"{root}/{version or current(spark, root)}/{name}")


def roll_back(spark: SparkSession, root: str, version: str) -> None:
    """Makes an earlier version the current one again."""
    fs, place = _at(spark, f"{root}/{version}")
    if not fs.exists(place):
        raise ValueError(f"no version {version}")
    _point(spark, root, version, head(spark, root))
