"""Importance resampling of documents towards a target distribution of hashed features.

1. The sparse document-by-bucket count matrix of the corpus is written once, in CSR blocks: a
   row is a block of documents with their ids, row starts, buckets and counts. Blocks are small
   (``BLOCK_BYTES``, or one document), because Spark reads and hands over rows by their number: a
   task holds some thousand blocks at once, however large its part of the table is.
2. Column sums of the blocks, added up in each task before they are shuffled, are the corpus's
   distribution; those of the target table's matrix are the target's. Both have as many entries
   as there are buckets, whatever the tables' size.
3. A bucket's gain is its scaled log ratio; the product of each block with the gains, divided by
   the number of features, is a document's weight.
4. Gumbel noise from the document's id is added. Scores are integers within a fixed range (under
   200,000 different ones: a gain is at most 1000 ln of a ratio of 64-bit counts), so their
   counts, collected, give the least score drawn. Rows from that score on are sorted by ranges
   and numbered by task; only the number of rows of each range reaches the driver.

Equal scores of equal ids (repeated rows) are sorted by the place where they lie, so that no key
needs one task.

Defined results: null and empty texts, and texts without a word, have no feature and weight 0;
null ids draw as the empty id and are the largest among equal scores; repeated rows are drawn
each on their own, in the order in which they lie; an empty corpus gives no row and an empty
target a flat distribution; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, record, slices, texts, written

BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Features whose buckets a worker remembers; it starts anew when that many are known.
MEMO = 500_000
#: Bytes of texts that make a block, and about as many as a batch of blocks is made of.
BLOCK_BYTES, BATCH_BYTES = 4 << 10, 1 << 20

#: Upper-case letters in lower case, digits, lower-case letters and non-ASCII bytes as they are, all others blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = "doc_id array<long>, words array<int>, start array<int>, bucket array<int>, count array<int>"
_MEMO: dict[tuple[int, int], dict[bytes, int]] = {}


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def features(words: list[bytes], run: int = RUN) -> list[bytes]:
    """All runs of 1 to ``run`` words in a row."""
    out = list(words)
    for k in range(2, run + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _buckets(found: list[bytes], buckets: int, run: int) -> np.ndarray:
    memo = _MEMO.setdefault((buckets, run), {})
    new = set(found).difference(memo)
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = set(found)
    memo.update((f, zlib.crc32(f) % buckets) for f in new)
    return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))


def matrix(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """CSR blocks of the count matrix of ``docs`` (doc_id, text); the row i of a block has the entries start[i] to start[i + 1]."""
    schema = pa.schema([("doc_id", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))])

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        entries: list[np.ndarray] = []
        sizes, words, first, held = [], [], [0], 0
        for i, text in enumerate(texts(batch)):
            if held and held + len(text) > BLOCK_BYTES:
                first.append(i)
                held = 0
            held += len(text)
            found = words_of(text)
            words.append(len(found))
            bucket, count = np.unique(_buckets(features(found, run), buckets, run), return_counts=True)
            entries.append(np.stack((bucket, count)))
            sizes.append(len(bucket))
        flat = np.concatenate(entries, axis=1).astype(np.int32)
        row = np.append(first, len(sizes)).astype(np.int32)
        entry = np.append(0, np.cumsum(sizes)).astype(np.int32)
        start = np.concatenate([entry[a : b + 1] - entry[a] for a, b in zip(row, row[1:], strict=False)])
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([listed(row, batch.column("doc_id")), listed(row, np.array(words, np.int32)), listed(row + np.arange(len(row)), start), listed(entry[row], flat[0]), listed(entry[row], flat[1])], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            yield blocks(batch)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(go, _BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each column of a matrix: ``buckets`` numbers, added up by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, count = (np.asarray(batch.column(c).flatten()) for c in ("bucket", "count"))
            np.add.at(total, bucket, count.astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("bucket", "count").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the log ratio of its smoothed shares in target and corpus, rounded down."""
    whole, aim, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole + n) / ((s + 1.0) * (aim + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, times 1000 and rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, words, n_features, weight, score): the matrix times the gains, block by block."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.int32()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, words, start, bucket, count = (batch.column(c).flatten() for c in ("doc_id", "words", "start", "bucket", "count"))
            lengths = np.asarray(batch.column("start").value_lengths())
            size = np.delete(np.diff(np.asarray(start)), np.cumsum(lengths)[:-1] - 1)  # not from a block's end to the next one's start
            owner, _ = expand(size)
            count = np.asarray(count).astype(np.int64)
            total, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, owner, count * shared.value[np.asarray(bucket)])
            np.add.at(n, owner, count)
            weight = total // np.maximum(n, 1)
            drawn = np.fromiter((noise(d, seed) for d in ids.to_pylist()), np.int64, len(ids))
            yield record(schema, [ids, words, n, weight, weight + drawn])

    return blocks.mapInArrow(run, "doc_id long, words int, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, 3 .. for the drawn share of rows with enough words, null for the others."""
    enough = F.col("words") >= least_words
    counts = {r.score: r.n for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()}
    most = percent * sum(counts.values()) // 100
    least, above = None, 0
    for score in sorted(counts, reverse=True):
        if above >= most:
            break
        least, above = score, above + counts[score]
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none)
    chosen = enough & (F.col("score") >= least)
    n = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    inside = scored.where(chosen).withColumn("place", F.monotonically_increasing_id())
    # the number of a row in the sorted ranges: the range's number above bit 33, its own below
    placed = written(inside.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    before, rows = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        rows.append((r.part, before))
        before += r.n
    offsets = scored.sparkSession.createDataFrame(rows, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "place", "before")
    return scored.where(~chosen).withColumn("rank", none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``, drawn towards ``target`` (text)."""
    target = target.select(F.lit(None).alias("doc_id"), "text")
    blocks = written(matrix(docs, buckets, run), "count-blocks")
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, buckets, run), buckets))
    scored = written(scores(blocks, gain, seed), "scores")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


#: What ``resample`` returns for the documents and the benchmark, for DuckDB; crc32 goes bit by bit.
SQL = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 cells AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM texts) GROUP BY r, w),
 spelt AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM cells UNION SELECT w FROM aims)),
 bits AS (SELECT w, flatten(list_transform(range(0, length(x) // 2), lambda i: list_transform(range(0, 8), lambda b: (('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT >> b) & 1))) AS bits FROM spelt),
 hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, bits), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 10000 AS k FROM bits),
 ours AS (SELECT k, sum(c) AS s FROM cells JOIN hashed USING (w) GROUP BY k),
 theirs AS (SELECT k, count(*) AS t FROM aims JOIN hashed USING (w) GROUP BY k),
 gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM ours) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM theirs), 0) + 10000)::DOUBLE))) AS g FROM ours LEFT JOIN theirs USING (k)),
 sums AS (SELECT r, floor(sum(c * g) / sum(c))::BIGINT AS weight FROM cells JOIN hashed USING (w) JOIN gain USING (k) GROUP BY r),
 scored AS (SELECT r, doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM texts LEFT JOIN sums USING (r)),
 placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n >= 20)
SELECT doc_id, scored.n::BIGINT AS n_features, weight, score, CASE WHEN place <= placed.n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""
