"""Harmonic packing of token sequences, with free cuts.

What is left of a document after whole sequences falls into a class by its length: class k holds
lengths over ``capacity / (k + 1)`` up to ``capacity / k``, and a bin of class k holds k of them
uncut. Bins of a class are filled with their fixed count in the order of the documents. What they
leave empty is filled, exactly, by documents that are cut: those of bins that are not full, and as
many of the bins with most space as that takes. So a sequence needs no padding, and a document is
cut only if it is long or fills such space.

Workers pack on their own, slice by slice of texts; what is left of a slice, less than a sequence,
goes on with the next one, and at a worker's end to sequences of powers of two, which need no
padding. Only a table of the number of sequences by worker is shared.

Defined results: null and empty texts have the end id alone; null ids are kept; repeated rows
are packed as often as they come; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import expand, record, slices, texts, written

CAPACITY = 4096


class Packed(NamedTuple):
    """Pieces of items: which, where they begin in it, their length, sequence (-1: left for later) and offset there; and how many sequences."""

    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def harmonic(sizes: np.ndarray, capacity: int = CAPACITY, last: bool = True) -> Packed:
    """Packs items of some sizes. What is less than a sequence at the end is left for later, unless this is the last."""
    whole, rest = np.divmod(sizes, capacity)
    own, nth = expand(whole)
    parts = [(own, nth * capacity, np.full(len(own), capacity), np.arange(len(own)), np.zeros(len(own), np.int64))]
    sequences, base = len(own), whole * capacity
    # classes, and in each as many bins as its items fill
    left = np.flatnonzero(rest)
    order = np.argsort(capacity // rest[left], kind="stable")
    left = left[order]
    k = capacity // rest[left]
    first = np.searchsorted(k, k)
    place = np.arange(len(k)) - first
    full = place < (np.searchsorted(k, k, side="right") - first) // np.maximum(k, 1) * k
    binned, cut = left[full], left[~full]
    begins = np.flatnonzero(place[full] % np.maximum(k[full], 1) == 0)
    bin_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(binned))))
    held = np.bincount(bin_of, rest[binned], len(begins)).astype(np.int64)
    # bins with most space are dissolved until what is cut fills the space of the others
    roomy = np.argsort(held, kind="stable")
    filler = rest[cut].sum() + np.append(0, np.cumsum(held[roomy]))
    space = (capacity - held).sum() - np.append(0, np.cumsum(capacity - held[roomy]))
    stays = np.ones(len(begins), bool)
    stays[roomy[: int(np.argmax(filler >= space))]] = False
    number = sequences + np.cumsum(stays) - 1
    kept = stays[bin_of]
    before = np.cumsum(rest[binned]) - rest[binned]
    offset = before - before[begins][bin_of] if len(begins) else before
    items = binned[kept]
    parts.append((items, base[items], rest[items], number[bin_of[kept]], offset[kept]))
    sequences += int(stays.sum())
    # the others in a row, cut where the space of a bin ends
    cut = np.concatenate((cut, binned[~kept]))
    ends = np.cumsum(rest[cut])
    total = int(ends[-1]) if len(ends) else 0
    gap, at, where = (capacity - held)[stays], held[stays], number[stays]
    more = total - int(gap.sum())
    sizes_of = [capacity] * (more // capacity) + ([1 << b for b in reversed(range((more % capacity).bit_length())) if more % capacity >> b & 1] if last else [])
    slot = np.concatenate((gap, np.array(sizes_of, np.int64), [more % capacity] if not last else np.zeros(0, np.int64))).astype(np.int64)
    where = np.concatenate((where, sequences + np.arange(len(sizes_of)), [-1] if not last else []))
    at = np.concatenate((at, np.zeros(len(slot) - len(at), np.int64)))
    slot_end = np.cumsum(slot)
    edge = np.unique(np.concatenate(([0], ends, slot_end)))
    a, b = edge[:-1], edge[1:]
    of, to = np.searchsorted(ends, a, side="right"), np.searchsorted(slot_end, a, side="right")
    parts.append((cut[of], base[cut[of]] + a - (ends - rest[cut])[of], b - a, where[to], at[to] + a - (slot_end - slot)[to]))
    return Packed(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)), sequences + len(sizes_of))


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = tokens.END_ID, memo: int = tokens.MEMO_CHUNKS) -> DataFrame:
    """Every piece, with its worker and its sequence and offset among that worker's."""
    tokenizer, end = tokenizer or tokens.default_path(), struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("worker", pa.int32()), ("nth", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = tokens.encoder(tokenizer, memo).encode, TaskContext.get().partitionId()
        sequences = 0
        kept: list[tuple[int | None, int, bytes, int]] = []  # of the slice before: document, place in it, ids, its tokens

        def placed(items: list[tuple[int | None, int, bytes, int]], last: bool) -> pa.RecordBatch:
            nonlocal sequences, kept
            found = harmonic(np.array([len(x[2]) // 4 for x in items], np.int64), capacity, last)
            rows = []
            kept = []
            for i, start, n, sequence, offset in zip(*(x.tolist() for x in found[:5]), strict=True):
                doc, base, ids, size = items[i]
                part = ids[4 * start : 4 * (start + n)]
                if sequence < 0:
                    kept.append((doc, base + start, part, size))
                else:
                    rows.append((doc, base + start, n, zlib.crc32(part), size, worker, sequences + sequence, offset))
            sequences += found.sequences
            return record(schema, list(map(list, zip(*rows, strict=True))) if rows else [[]] * len(schema))

        for batch in slices(batches, "text"):
            whole = [ids + end for ids in encode(texts(batch))]
            yield placed([*kept, *((d, 0, ids, len(ids) // 4) for d, ids in zip(batch.column("doc_id").to_pylist(), whole, strict=True))], False)
        if kept:
            yield placed(kept, True)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, memo: int = tokens.MEMO_CHUNKS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    cut = written(pieces(docs, tokenizer, capacity, memo=memo), "pieces")
    counts = cut.groupBy("worker").agg((F.max("nth") + 1).alias("n"))
    # one row a worker
    first = counts.select("worker", (F.sum("n").over(Window.orderBy("worker")) - F.col("n")).alias("first"))
    return cut.join(F.broadcast(first), "worker").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), "offset")
