"""Tables that live while a job does, in the folder that all machines share, and graph components over them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The database of bucketed tables, so that none shows up in the user's own.
DATABASE = "lodestone_scratch"

_OWN: dict[str, str] = {}
#: What to call to be rid of a table.
_TABLES: WeakKeyDictionary[DataFrame, Callable[[], None]] = WeakKeyDictionary()
#: For each open ``settled`` call, what is to be deleted at its end.
_OPEN: list[list[Callable[[], None]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; where it is unset, in local mode only, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
            _at_exit(spark, lambda: _delete(spark, _OWN[app]))
        at = _OWN[app]
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at_exit(spark: SparkSession, work: Callable[[], object]) -> None:
    def run() -> None:
        if spark.sparkContext._jsc is not None:
            work()

    atexit.register(run)


def _kept(spark: SparkSession, gone: Callable[[], None]) -> None:
    _at_exit(spark, gone)
    if _OPEN:
        _OPEN[-1].append(gone)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the driver ends, or the ``settled`` call around it."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _kept(spark, lambda: _delete(spark, path))
    return path


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in here takes its shuffle files along when it ends: nothing else reads them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = lambda: _delete(spark, path)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder in buckets of ``key``, as many as shuffle partitions: joins by the key don't deal it out again."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spark.sql(f"create database if not exists {DATABASE}")
    view = f"{DATABASE}.t{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(view)

    def gone() -> None:
        spark.sql(f"drop table if exists {view}")
        _delete(spark, path)

    _kept(spark, gone)
    out = spark.table(view)
    _TABLES[out] = gone
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes ``written`` and ``bucketed`` tables that nothing reads any more."""
    for t in tables:
        _TABLES.pop(t)()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that ``make`` returns, as a table; all tables made on the way are deleted once it is written."""
    mine: list[Callable[[], None]] = []
    _OPEN.append(mine)
    try:
        made = make()
        _OPEN.pop()
        out = written(made, name)
    except BaseException:
        if _OPEN and _OPEN[-1] is mine:
            _OPEN.pop()
        raise
    finally:
        for gone in mine:
            gone()
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (u, v): one row (node, root) for each linked node, root the smallest node.

    Large-star and small-star steps alternate until nothing changes. A node's smallest
    neighbour is a pre-aggregated minimum; its neighbours are dealt out again by a join,
    which can be split, so that a hub needs no single task. Each step is a written table.
    Nulls are ignored; an empty input gives an empty result.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, edges = edges, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return node.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
