"""Exact removal of repeated substrings with sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any
document. Sharding: every string of that length has a least hash among its ``GRAM``-byte grams,
which depends on its bytes alone, so equal strings share it. The consecutive windows of a
document with the same least hash form one fragment (some 280 bytes), keyed by that hash.

1. The rows get numbers and are written once, in buckets of that number, so that no later step
   shuffles texts. Fragments are counted by key.
2. Keys seen once hold no repeat (a fragment in which its gram occurs again counts twice). The
   others go into a Bloom filter of bounded size (``FILTER_BYTES``), which lets most other
   fragments go before they are written; past that size it lets more through, and exact counts
   drop them.
3. Equal fragments become one kind with a count. Where all kinds of a key are counted twice, all
   their windows repeat. A key with more than ``HOT`` kinds (a common line in many contexts) is
   cut up further: its windows are keyed by longer grams, at last by all their bytes.
4. One text of each other kind is cut from its row, the kinds of a key come together in a shard,
   and the shard's suffix array (induced sorting) and permuted common prefixes show which windows
   occur twice. Counted copies repeat whole.
5. The windows' ranges go back to every row that holds the fragment, and their union is removed.

Counts are combined before each shuffle; the joins by key can be split when a key is hot; shards
are cut at keys once they hold ``SHARD_BYTES``, and a key holds ``HOT`` kinds at most. Kinds are
told apart by 128 bits of two independent hashes.

Defined results: null and empty texts keep no byte and lose none; texts shorter than ``length``
lose none; rows with the same id are separate documents, so that repeated rows repeat each
other; null ids are kept; other columns are ignored by ``digests`` and kept by ``cleaned``,
whatever their names but ``text``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, RID, discard, expand, in_filter, key_filter, mix, numbered, powers, record, release_memory, restored, slices, texts, utf8, written
from .suffix import common_prefixes, suffix_array

LENGTH = 200
#: Bytes of the grams that key windows, level by level; the last is a whole window.
GRAMS = (32, 128, 200)
SHARD_BYTES = 2 << 20
#: Different contents of a key above which its windows are keyed by longer grams.
HOT = 2048
#: The columns of placed fragments: pos is start << 16 | windows.
_PLACED = pa.schema([("key", pa.int64()), ("content", pa.int64()), (RID, pa.int64()), ("pos", pa.int64()), ("twice", pa.bool_())])
_KIND = f"key long, content long, {RID} long, pos long, twice boolean"
_SEPARATOR = 255  # in no UTF-8 text, and stays 255 when 1 is added to the others

#: Bits of a position in its gram's order.
_PLACE = np.uint64((1 << 24) - 1)
def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each position; size is a multiple of 8."""
    n = len(data) - size + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    h = np.full(n, np.uint64(size), np.uint64)
    for j in range(0, size, 8):
        h = (h ^ words[j : j + n]) * M1
        h ^= h >> np.uint64(31)
    return mix(h)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by running minima inside blocks."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def least_hashes(data: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0], both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The hash of the chosen gram of each window (least 40 bits, then leftmost), and (both) whether it occurs twice in there."""
    h, width = _grams(data, gram), length - gram + 1
    at = np.arange(len(h), dtype=np.uint64)
    high = h & ~_PLACE
    first = _sliding_least(high | (at & _PLACE), width) & _PLACE
    windows = at[: len(first)]
    chosen = h[(windows + ((first - windows) & _PLACE)).astype(np.int64)]
    if not both:
        return chosen, None
    last = _PLACE - (_sliding_least(high | ((_PLACE - at) & _PLACE), width) & _PLACE)
    return chosen, first != last


def _contents(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of at least 8 bytes: differences of a running polynomial of mixed 8-byte words."""
    digits = mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel() * M1)
    power, inverse = powers(len(digits))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digits * power, dtype=np.uint64)))
    return mix((total[start + size - 7] - total[start]) * inverse[start] ^ size.astype(np.uint64) * M2)


def fragments_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0], both: bool = False, within: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, start, windows, twice) of the fragments of one text: windows in a row with the same chosen gram.

    No fragment has more windows than a single gram can serve, so a longer run, in which the
    gram occurs again, is several fragments. twice (with both): the gram occurs again in one of
    the windows, so that the fragment may repeat itself. within: only these windows.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    chosen, again = least_hashes(data, length, gram, both)
    most = length - gram + 1
    cut = chosen[1:] != chosen[:-1]
    if within is not None:
        cut |= within[1:] != within[:-1]
    start = np.flatnonzero(np.append(True, cut))
    size = np.diff(np.append(start, len(chosen)))
    if within is not None:
        start, size = start[within[start]], size[within[start]]
        if not len(start):
            return np.zeros(0, np.uint64), start, size, np.zeros(0, bool)
    if size.max() > most:
        owner, nth = expand(-(-size // most))
        start, size = start[owner] + nth * most, np.minimum(size[owner] - nth * most, most)
    if not both:
        return chosen[start], start, size, np.zeros(len(start), bool)
    found = np.append(0, np.cumsum(again))
    return chosen[start], start, size, found[start + size] > found[start]


def _fragments(dealt: DataFrame, length: int, bloom: tuple[int, bytes | None] | None = None) -> DataFrame:
    """The fragments of all texts: their keys (twice that of one that may repeat itself), or, with a filter, those in it with their places."""
    full = bloom is not None
    shared = dealt.sparkSession.sparkContext.broadcast(bloom)
    kind = _PLACED if full else pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 17):  # whose arrays stay in a core's cache
            data, ends = utf8(batch.column("text"))
            raw, ends = data[ends[0] : ends[-1]], ends - ends[0]
            if len(raw) < length:
                continue
            # all texts of a slice at once: windows that end in their own text
            fits = np.flatnonzero(np.diff(ends) >= length)
            change = np.zeros(len(raw) + 1, np.int8)
            change[ends[fits]] += 1
            change[ends[fits + 1] - length + 1] -= 1
            within = np.cumsum(change[: len(raw) - length + 1]) > 0
            key, start, size, twice = fragments_of(raw, length, GRAMS[0], True, within)
            if not full:
                yield record(kind, [np.append(key, key[twice]).view(np.int64)])
                continue
            kept = in_filter(shared.value, key)
            key, start, size, twice = key[kept], start[kept], size[kept], twice[kept]
            if len(key):
                owner = np.searchsorted(ends, start, side="right") - 1
                content = _contents(raw, start, size + length - 1)
                yield record(kind, [key.view(np.int64), content.view(np.int64), np.asarray(batch.column(RID))[owner], start - ends[owner] << 16 | size, twice])

    return dealt.select(RID, "text").mapInArrow(run, _KIND if full else "key long")


def _refined(places: DataFrame, dealt: DataFrame, length: int, gram: int) -> DataFrame:
    """The windows of fragments (rid, pos) as fragments keyed by longer grams."""
    places = places.groupBy(RID).agg(F.collect_list("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            parts = []
            for text, rid, places in zip(texts(batch), batch.column(RID).to_pylist(), batch.column("places").to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                within = np.zeros(len(data) - length + 1, bool)
                for p in places:
                    within[p >> 16 : (p >> 16) + (p & 0xFFFF)] = True
                key, start, size, twice = fragments_of(data, length, gram, True, within)
                if len(key):
                    content = _contents(data, start, size + length - 1)
                    parts.append((key.view(np.int64), content.view(np.int64), np.full(len(key), rid), start << 16 | size, twice))
            if parts:
                yield record(_PLACED, [np.concatenate(x) for x in zip(*parts, strict=True)])

    return dealt.select(RID, "text").join(places, RID).select(RID, "text", "places").mapInArrow(run, _KIND)


def _kinds(found: DataFrame) -> DataFrame:
    """Each different fragment whose key is seen twice: how often it occurs, a place of it, how many kinds its key has, and whether all of them occur twice."""
    kinds = found.groupBy("key", "content").agg(F.count("*").alias("n"), F.max(F.col("twice").cast("int")).alias("twice"), F.min(F.struct(RID, "pos")).alias("rep"))
    kinds = written(kinds, "kinds")
    keys = written(kinds.groupBy("key").agg(F.count("*").alias("kinds"), (F.sum("n") + F.max("twice")).alias("seen"), F.min("n").alias("least")).where("seen > 1"), "keys")
    out = written(kinds.join(keys, "key").select("key", "content", "n", "rep", "kinds", (F.col("least") > 1).alias("copied")), "kinds")
    discard(kinds, keys)
    return out


def _cut_out(kinds: DataFrame, dealt: DataFrame, length: int) -> DataFrame:
    """(key, content, n, size, bytes): one text of each kind of fragment, from the document that stands for it."""
    wanted = kinds.groupBy(F.col(f"rep.{RID}").alias(RID)).agg(F.collect_list(F.struct("key", "content", "n", F.col("rep.pos").alias("pos"))).alias("cuts"))
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            cuts = batch.column("cuts")
            cut, owner = cuts.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(cuts))
            data, ends = utf8(batch.column("text"))
            pos = np.asarray(cut.field("pos"))
            size = pos & 0xFFFF
            at = (ends[owner] + (pos >> 16)).tolist()
            to = (ends[owner] + (pos >> 16) + size + length - 1).tolist()
            raw = data.tobytes()
            yield record(schema, [cut.field("key"), cut.field("content"), cut.field("n"), size.astype(np.int32), pa.array([raw[a:b] for a, b in zip(at, to, strict=True)], pa.binary())])

    return dealt.select(RID, "text").join(wanted, RID).select("text", "cuts").mapInArrow(run, "key long, content long, n long, size int, bytes binary")


def repeated_windows(fragments: list[bytes], counts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the concatenated fragments with a separator after each: True where a window of ``length`` bytes occurs twice."""
    ends = np.cumsum(np.fromiter(map(len, fragments), np.int64, len(fragments)) + 1)
    start = np.append(0, ends[:-1])
    raw = np.frombuffer(bytes([_SEPARATOR]).join(fragments) + bytes([_SEPARATOR]), np.uint8)
    text = np.append(np.where(raw == _SEPARATOR, _SEPARATOR, raw + 1).astype(np.uint8), np.uint8(0))
    order = suffix_array(text)
    long = common_prefixes(text, order)[order] >= length
    hit = np.zeros(len(text), bool)
    hit[order[long]] = True
    hit[order[:-1][long[1:]]] = True
    owner = np.repeat(np.arange(len(fragments)), np.diff(np.append(start, ends[-1])))
    inside = np.arange(len(raw)) - start[owner] < sizes[owner]
    return (hit[:-1] | (counts[owner] > 1)) & inside


def _ranges(shards: DataFrame, length: int) -> DataFrame:
    """(key, content, ranges): the ranges of repeated windows of each kind of fragment, start << 16 | length."""
    n = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = shards.repartition(n, "key").sortWithinPartitions("key")
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("ranges", pa.list_(pa.int32()))])

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        pieces = whole["bytes"].to_pylist()
        hit = repeated_windows(pieces, np.asarray(whole["n"]), np.asarray(whole["size"]), length)
        change = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        start = np.cumsum([0] + [len(p) + 1 for p in pieces])
        owner = np.searchsorted(start, a, side="right") - 1
        some, first = np.unique(owner, return_index=True)
        found = pa.ListArray.from_arrays(np.append(first, len(a)).astype(np.int32), ((a - start[owner]) << 16 | (b - a)).astype(np.int32))
        out = record(schema, [np.asarray(whole["key"])[some], np.asarray(whole["content"])[some], found])
        release_memory()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            at = 0
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column("bytes"))))
            cuts = np.flatnonzero(np.append(last is not None and key[0] != last, key[1:] != key[:-1])).tolist()
            for cut in cuts:
                if size + ends[cut] - ends[at] >= SHARD_BYTES:
                    if cut > at:
                        kept.append(batch.slice(at, cut - at))
                    yield solve(kept)
                    kept, size, at = [], 0, cut
            kept.append(batch.slice(at))
            size += int(ends[-1] - ends[at])
            last = key[-1]
        if kept:
            yield solve(kept)

    return rows.mapInArrow(run, "key long, content long, ranges array<int>")


def removals(dealt: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, spans): for each row with repeated windows their ranges of window starts, start << 16 | length, in order."""
    keys = written(_fragments(dealt, length).groupBy("key").agg(F.count("*").alias("seen")).where("seen > 1").select("key"), "keys")
    found = written(_fragments(dealt, length, key_filter(keys)), "fragments")
    discard(keys)
    places, solved = [], []
    for gram in [*GRAMS[1:], None]:
        kinds = _kinds(found)
        # where all kinds of a key are copied, so are all their windows
        copied = F.col("copied")
        hot = ~copied & (F.col("kinds") > HOT) if gram else F.lit(False)
        size = F.col("rep.pos").bitwiseAND(F.lit(0xFFFF)).cast("int")
        solved.append(kinds.where(copied).select("key", "content", F.array(size).alias("ranges")))
        solved.append(_ranges(_cut_out(kinds.where(~hot & ~copied), dealt, length), length))
        places.append(found.select("key", "content", RID, "pos"))
        # one key for more than HOT kinds: Spark sees the size of the written table and deals the fragments out only if it is large
        hot_keys = written(kinds.where(hot).select("key").distinct(), "hot-keys")
        if not gram or hot_keys.isEmpty():
            break
        found = written(_refined(found.join(hot_keys, "key").select(RID, "pos"), dealt, length, gram), "fragments")
    ranges = written(reduce(DataFrame.unionByName, solved), "ranges")
    start, r = F.shiftright("pos", 16), F.explode("ranges")
    spans = reduce(DataFrame.unionByName, places).join(ranges, ["key", "content"]).select(RID, start.alias("start"), r.alias("r"))
    span = F.shiftleft(F.col("start") + F.shiftright("r", 16), 16).bitwiseOR(F.col("r").bitwiseAND(F.lit(0xFFFF)))
    return spans.groupBy(RID).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges joined where they meet or overlap."""
    top = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > top[:-1])
    first = np.flatnonzero(new)
    return a[first], top[np.append(first[1:], len(a)) - 1]


def keep(text: bytes, spans: list[int] | None, length: int = LENGTH) -> tuple[list[bytes], int, int]:
    """The remaining stretches of a text, the bytes removed and the maximal removed runs."""
    if not spans:
        return [text], 0, 0
    found = np.array(spans, np.int64)
    a = found >> 16
    a, b = _union(a, a + (found & 0xFFFF) + length - 1)
    stays = [text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)]
    return stays, int((b - a).sum()), len(a)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist(), strict=True):
                stays, removed, runs = keep(text, spans, length)
                rows.append((len(text), removed, runs, hashlib.sha256(b"".join(stays)).hexdigest()))
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True))])

    dealt = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    rows = dealt.join(removals(dealt, length), RID, "left").select("__rest.doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the same columns, repeated bytes removed from its texts; a character that loses a byte goes whole.

    A null text stays null; ``n_chars``, where there is one, is the new text's.
    """
    dealt = numbered(docs)
    rows = dealt.join(removals(dealt, length), RID, "left").drop(RID)
    kind = rows.drop("spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            new = batch.column("text")
            spans = batch.column("spans")
            at = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                found = new.to_pylist()
                for i in at.tolist():
                    stays, _, _ = keep(found[i].encode(), spans[i].as_py(), length)
                    found[i] = b"".join(x.decode(errors="ignore").encode() for x in stays).decode()
                new = pa.array(found, new.type)
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in kind.names], names=kind.names)

    changed = {"n_chars": F.when(~F.col("__null"), F.length("text"))} if "n_chars" in docs.columns else {}
    return restored(rows.mapInArrow(run, kind), docs, **changed)


#: What ``digests`` returns, by every window of every text, for DuckDB.
SQL = """WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
 windows AS (SELECT r, i, b[i + 1:i + 200] AS w FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM texts WHERE octet_length(b) >= 200)),
 twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
 starts AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200 AS new FROM windows SEMI JOIN twice USING (w)),
 spans AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS n FROM starts) GROUP BY r, n),
 stays AS (SELECT r, a AS place, b[coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) + 1:a] AS piece FROM spans JOIN texts USING (r) UNION ALL SELECT r, 1000000000, b[max(e) + 1:octet_length(b)] FROM spans JOIN texts USING (r) GROUP BY r, b),
 kept AS (SELECT r, string_agg(hex(piece), '' ORDER BY place) AS h FROM stays GROUP BY r),
 sums AS (SELECT r, sum(e - a) AS n, count(*) AS k FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""
