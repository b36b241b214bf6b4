"""Shared pieces of the corpus operators: Arrow text access, hashes and filters, samples.

Nothing here knows a particular operator. Python code runs only inside ``mapInArrow``;
every joined, grouped or deduplicated set stays a DataFrame.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, components, discard, fresh_path, settled, shared_dir, written  # noqa: F401  for the operators

#: Texts are handled in slices of about this many bytes, so that a worker's arrays stay small.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The number of a row in a ``numbered`` table.
RID = "__rid"


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """Every row of ``docs`` under a number of its own, in buckets of that number: joins by it shuffle no texts.

    ``docs`` should be a table, so that a task that runs again numbers the same rows alike.
    Columns: the number, the text (null as empty), whether it was null, the other columns as one, and ``more``.
    """
    rest = [F.col(f"`{n}`") for n in docs.columns if n != "text"]
    text, null = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("__null")
    return bucketed(docs.select(F.monotonically_increasing_id().alias(RID), text, null, *([F.struct(*rest).alias("__rest")] if rest else []), *more), RID, "texts")


def restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """``numbered`` rows with the columns of ``docs`` again; changed: columns with new values."""
    of = {n: F.when(~F.col("__null"), F.col("text")).alias("text") if n == "text" else F.col(f"__rest.`{n}`") for n in docs.columns}
    return rows.select(*[changed[n].cast(docs.schema[n].dataType).alias(n) if n in changed else c for n, c in of.items()])


def labelled_sample(docs: DataFrame, known: DataFrame, sample: dict[int, int]) -> tuple[list[tuple[int, int, str]], dict[int, float]]:
    """At most ``sample[y]`` different rows (doc_id, label, text) of each class of ``known`` (doc_id, y), by hash over all of them.

    Also how many labelled rows each of a class stands for. Repeated rows are one.
    """
    of = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for y, n in of.items():
        part = F.when(F.col("y") == y, 1.1e6 * min(1.0, sample[y] / n)).otherwise(part)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part).distinct()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "y", "text"])
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text"))
    most = F.create_map(*[F.lit(x) for y in of for x in (y, sample[y])]) if of else F.create_map(F.lit(0), F.lit(0))
    found = [(r.doc_id, r.y, r.text) for r in rows.withColumn("place", place).where(F.col("place") <= max(sample.values())).where(F.col("place") <= most[F.col("y")]).collect()]
    got = Counter(y for _, y, _ in found)
    return found, {y: of[y] / got[y] for y in got}


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo ``n``; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets into them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Gives what a worker has freed back to the machine; workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of every text of a batch."""
    data, ends = utf8(batch.column(column))
    whole, at = data[ends[0] : ends[-1]].tobytes(), (ends - ends[0]).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index repeated, and the running number inside the repeat."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred."""
    h = h ^ (h >> np.uint64(32))
    h *= M2
    return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(M1), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (M1, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bytes of a key filter at most; past some 22 million keys it lets more others through.
FILTER_BYTES = 32 << 20


def key_filter(keys: DataFrame) -> tuple[int, bytes | None]:
    """A Bloom filter of the column ``key``: log2 of its bits, and a bitmap with three bits for each key (without a key none)."""
    n = keys.count()
    if not n:
        return 0, None
    log = min(max(16, (12 * n - 1).bit_length()), (8 * FILTER_BYTES).bit_length() - 1)
    parts = 1 << max(0, log - 20)  # parts of 2^20 bits, made by different tasks
    bits = F.array(*[F.shiftrightunsigned("key", i * 18).bitwiseAND(F.lit((1 << log) - 1)) for i in range(3)])
    spots = keys.select(F.explode(bits).alias("bit")).select(F.shiftright("bit", min(log, 20)).cast("int").alias("part"), F.col("bit").bitwiseAND(F.lit((1 << min(log, 20)) - 1)).cast("int").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = np.asarray(batch.column("part")), np.asarray(batch.column("bit"))
            for p in np.unique(part).tolist():
                maps.setdefault(p, np.zeros(1 << min(log, 20), np.uint8))[bit[part == p]] = 1
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()])], names=["part", "bits"])

    found = {r.part: bytes(r.bits) for r in spots.repartition(min(parts, 64), "part").mapInArrow(run, "part int, bits binary").collect()}
    empty = bytes((1 << min(log, 20)) // 8)
    return log, b"".join(found.get(p, empty) for p in range(parts))


def in_filter(bloom: tuple[int, bytes | None], key: np.ndarray) -> np.ndarray:
    """Which keys a filter holds, and perhaps some more."""
    log, raw = bloom
    if raw is None:
        return np.zeros(len(key), bool)
    bits, kept = np.frombuffer(raw, np.uint8), np.ones(len(key), bool)
    for i in range(3):
        bit = (key >> np.uint64(18 * i)) & np.uint64((1 << log) - 1)
        kept &= (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return kept


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its set) after the links a-b are added."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
