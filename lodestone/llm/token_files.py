"""Token ids as binary shards whose document boundaries are Elias-Fano encoded.

A shard is two files. ``.ids`` holds the ids of all its documents in a row, 2 bytes an id if
every id fits, else 4. ``.ef`` holds two Elias-Fano sequences: document ends and, from the
smallest, document ids. A sequence of n values up to u keeps floor(log2(u / n)) low bits of
each value in a packed array and the rest as a unary bit string of at most 2n bits, with the
position of every 256th one-bit; ``select`` finds value i from those, without a table of
64-bit offsets.

A task closes a shard after some ten thousand documents (``SHARD_DOCS``, ``SHARD_IDS``), so that what
it holds in memory doesn't grow with its share of the input. Rows are dealt out by ranges of (doc_id, text hash), so shards in order hold ascending ids and
equal ids may fall into several shards. File names carry the task attempt: only the shards
named by the returned manifest count, and a lost attempt leaves nothing that is read. The
files are in the folder the machines share and are written and read through Arrow's file
systems (file, hdfs, s3, gs).

Defined results: null and empty texts have the end id alone; null ids come first; repeated
rows are stored as often as they come; other columns are ignored; an empty table gives a
manifest without documents and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import fresh_path, record, slices, texts

MAGIC = b"LSIDS1\0\0"
SAMPLE = 256
#: Documents and ids after which a task closes a shard and opens the next.
SHARD_DOCS, SHARD_IDS = 1 << 16, 1 << 26


class EliasFano:
    """A non-decreasing sequence of integers from 0, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits and n:
            each = (values[:, None] >> np.arange(low_bits)) & 1
            low = np.packbits(each.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones // 8, (1 << (ones % 8)).astype(np.uint8))
        return cls(n, low_bits, low, high, ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value ``i``: the i-th one-bit from the nearest sample, and its low bits."""
        at = int(self.samples[i // SAMPLE])
        byte, need = at // 8, i % SAMPLE
        seen = int(np.bitwise_count(np.uint8(self.high[byte] & ((1 << (at % 8)) - 1))))
        need += seen
        while need >= (ones := int(np.bitwise_count(self.high[byte]))):
            need -= ones
            byte += 1
        bits = int(self.high[byte])
        for _ in range(need):
            bits &= bits - 1
        high = 8 * byte + (bits & -bits).bit_length() - 1 - i
        return high << self.low_bits | int(self._low(i, i + 1)[0])

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first = a * self.low_bits
        raw = np.unpackbits(self.low[first // 8 : -(-b * self.low_bits // 8)], bitorder="little")
        each = raw[first % 8 : first % 8 + (b - a) * self.low_bits].reshape(b - a, self.low_bits)
        return each.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def values(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b`` (exclusive)."""
        if b <= a:
            return np.zeros(0, np.int64)
        start, left = int(self.samples[a // SAMPLE]), a // SAMPLE * SAMPLE
        stop = int(self.samples[-(-b // SAMPLE)]) if -(-b // SAMPLE) < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(bits[start % 8 :])[a - left : b - left] + start
        return (ones - np.arange(a, b)) << self.low_bits | self._low(a, b)

    def dump(self) -> bytes:
        return struct.pack("<5Q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<5Q", data, at)
        at += 40
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


class Shard:
    """Reads one shard: the ids of any of its documents."""

    def __init__(self, path: str):
        self.fs, self.at = pyarrow.fs.FileSystem.from_uri(path)
        with self.fs.open_input_stream(f"{self.at}.ef") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        self.width, self.least, self.nulls = struct.unpack_from("<QqQ", data, 8)
        self.ends, at = EliasFano.load(data, 32)
        self.doc_ids, _ = EliasFano.load(data, at)

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        with self.fs.open_input_file(f"{self.at}.ids") as f:
            return np.frombuffer(f.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def documents(self, step: int = 4096) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
        """(doc ids, starts, ids as little-endian 32-bit) for all documents, in parts."""
        with self.fs.open_input_file(f"{self.at}.ids") as f:
            last = 0
            for a in range(0, len(self), step):
                b = min(a + step, len(self))
                ends = self.ends.values(a, b)
                starts = np.append(last, ends[:-1])
                flat = np.frombuffer(f.read_at(int(ends[-1] - last) * self.width, last * self.width), f"<u{self.width}").astype("<u4")
                cuts = (starts - last).tolist() + [len(flat)]
                ids = self.doc_ids.values(max(a - self.nulls, 0), max(b - self.nulls, 0)) + self.least
                yield [None] * (b - a - len(ids)) + ids.tolist(), starts, [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                last = int(ends[-1])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, vocabulary: int = 49_408, end_id: int = tokens.END_ID) -> list:
    """Writes the shards under ``path``; returns the manifest: (shard, file, n_docs, n_ids), one small row a shard."""
    tokenizer = tokenizer or tokens.default_path()
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    end = struct.pack("<I", end_id)
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    class Open:
        """A shard under way: its ids are written as they come, its boundaries at the end."""

        def __init__(self, nth: int):
            task = TaskContext.get()
            self.shard = task.partitionId() << 32 | nth
            self.name = f"{path}/shard-{task.partitionId():06d}-{nth:04d}-{task.taskAttemptId()}"
            self.fs, self.at = pyarrow.fs.FileSystem.from_uri(self.name)
            self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
            self.file = self.fs.open_output_stream(f"{self.at}.ids")
            self.lengths: list[np.ndarray] = []
            self.ids: list[pa.Array] = []
            self.docs = self.tokens = 0

        def add(self, ids: pa.Array, found: list[bytes]) -> None:
            self.lengths.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
            self.ids.append(ids)
            flat = np.frombuffer(b"".join(found), "<u4")
            if len(flat) and int(flat.max()) >= 1 << 8 * width:
                raise ValueError("an id does not fit the shard's width")
            self.file.write(flat.astype(f"<u{width}").tobytes())
            self.docs += len(found)
            self.tokens += len(flat)

        def close(self) -> pa.RecordBatch:
            self.file.close()
            ends = np.cumsum(np.concatenate(self.lengths)) if self.lengths else np.zeros(0, np.int64)
            doc_ids = pa.chunked_array(self.ids, pa.int64())
            known = doc_ids.drop_null().to_numpy()
            least = int(known[0]) if len(known) else 0
            with self.fs.open_output_stream(f"{self.at}.ef") as f:
                f.write(MAGIC + struct.pack("<QqQ", width, least, doc_ids.null_count) + EliasFano.of(ends).dump() + EliasFano.of(known - least).dump())
            return record(schema, [[self.shard], [self.name], [self.docs], [self.tokens]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = tokens.encoder(tokenizer).encode, 0
        shard = Open(nth)
        for batch in slices(batches, "text"):
            shard.add(batch.column("doc_id"), [x + end for x in encode(texts(batch))])
            if shard.docs >= SHARD_DOCS or shard.tokens >= SHARD_IDS:
                yield shard.close()
                nth += 1
                shard = Open(nth)
        yield shard.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return sorted(rows.select("doc_id", "text").mapInArrow(run, "shard long, file string, n_docs long, n_ids long").collect())


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards of a manifest."""
    base, rows = 0, []
    for _, file, n_docs, n_ids in manifest:
        if n_docs:
            rows.append((file, base))
        base += n_ids
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for ids, starts, found in Shard(row["file"]).documents():
                    yield record(schema, [ids, starts + row["base"], [len(x) // 4 for x in found], [zlib.crc32(x) for x in found]])

    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, fresh_path(spark, "token-ids"), tokenizer))
