"""Near-duplicate texts by 64-bit SimHash fingerprints and BK-trees.

Fingerprint: lower-cased (A-Z) words, shingles of ``width`` words, XXH64 with seed 42; a bit
is 1 if it is set in over half the hashes. Two fingerprints link at ``radius`` or fewer
differing bits.

Links: 64 bits fall into ``radius + j`` blocks. Fingerprints within the radius agree on j blocks
at least, so each choice of j blocks with its values is a bucket that is searched on its own: its
distinct fingerprints form a BK-tree whose children are keyed by their Hamming distance to the
parent, and a search follows only the edges whose key is within the radius of the distance just
measured. j is the least that leaves ``BUCKET`` fingerprints in a bucket on average: 1 up to some
two million (13 bits), 2 up to some five hundred million (21 bits), and so on, so that trees keep
their size and rows are sent to few buckets, whatever the table's size. A bucket over
``TREE_ROWS``, as counted in a hash sample, is cut into shard trees; they are not broadcast to all
workers, as together they grow with the input, but every member is sent to each of its bucket's,
so that a task's tree stays bounded.
Each task joins what it links and emits a spanning star, not pairs. Equal fingerprints are one
row from the start, with the smallest document id. Components come from the written star links.

Defined results: null and empty text, and text of white space only, have fingerprint 0 and
link like any other; null ids are kept, and count as larger than any id in a component's
smallest id; repeated rows are returned as often as they come; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, expand, join_labels, record, slices, texts, written

SEED, WIDTH, RADIUS = 42, 4, 4
#: Fingerprints in one BK-tree at most; larger buckets become several shard trees.
TREE_ROWS = 20_000
#: Fingerprints in a bucket on average, at most.
BUCKET = 256
#: One of so many fingerprints is counted to find large buckets.
SAMPLED = 16
#: (query, node) pairs followed at once.
FRONT = 1 << 18

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of every shingle of a text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: bits set in over half of them; 0 for no hash."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    # 255 hashes at most are summed in byte lanes, then the lanes of a document
    parts = -(-n // 255)
    owner, nth = expand(parts)
    first = np.cumsum(n) - n
    cuts = first[owner] + 255 * nth
    groups = np.cumsum(parts) - parts
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        over = 2 * sums > n[:, None]
        for byte in range(8):
            out[some] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            hashes = [shingle_hashes(t, width) for t in texts(batch)]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
            yield record(schema, [batch.column("doc_id"), majority(flat, counts).view(np.int64)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """One BK-tree for each group, over distinct fingerprints sorted by group; built level by level."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp = fp
        self.root_of, first = np.unique(group, return_index=True)
        self.root = first
        at = np.repeat(first, np.diff(np.append(first, len(group))))
        left = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        keys, nodes = [], []
        at = at[left]
        while len(left):
            key = at * 65 + np.bitwise_count(fp[left] ^ fp[at])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            new = np.append(True, key[1:] != key[:-1])
            child = left[new]
            keys.append(key[new])
            nodes.append(child)
            at = child[np.cumsum(new) - 1][~new]
            left = left[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], (np.concatenate(nodes) if nodes else key)[order]
        #: Edges that searches have followed, and those that they have left out.
        self.followed = self.skipped = 0

    def links(self, group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, in parts; a query searches the tree of its group."""
        tree = np.searchsorted(self.root_of, group)
        known = tree < len(self.root_of)
        known[known] = self.root_of[tree[known]] == group[known]
        ask = np.flatnonzero(known)
        stack = [(ask[a : a + FRONT // 16], self.root[tree[ask[a : a + FRONT // 16]]]) for a in range(0, len(ask), FRONT // 16)]
        while stack:
            q, v = stack.pop()
            d = np.bitwise_count(fp[q] ^ self.fp[v]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], v[near]
            low = np.searchsorted(self.key, v * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, v * 65 + np.minimum(d + radius, 64), side="right")
            own, nth = expand(high - low)
            self.followed += len(own)
            self.skipped += int((np.searchsorted(self.key, v * 65 + 64, side="right") - np.searchsorted(self.key, v * 65)).sum()) - len(own)
            q, v = q[own], self.node[low[own] + nth]
            stack += [(q[a : a + FRONT], v[a : a + FRONT]) for a in range(0, len(q), FRONT)]


def _bucket_links(group: np.ndarray, member: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, smallest fp of its set) among whole groups; ``member`` marks the rows that form the trees."""
    order = np.lexsort((fp, group))
    group, member, fp = group[order], member[order], fp[order]
    own = np.flatnonzero(member)
    forest = BKForest(group[own], fp[own])
    label = np.arange(len(fp))
    for q, v in forest.links(group, fp, radius):
        label = join_labels(label, q, own[v])
    moved = label != np.arange(len(fp))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def agreeing(n: int, radius: int = RADIUS) -> int:
    """On how many of ``radius + j`` blocks n fingerprints must agree, so that ``BUCKET`` share a bucket on average at most."""
    return next((j for j in range(1, 5) if n >> 64 * j // (radius + j) <= BUCKET), 5)


def links(distinct: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp``; their components are those of all pairs within the radius."""
    agree = agreeing(distinct.count(), radius)
    cuts = [round(64 * i / (radius + agree)) for i in range(radius + agree + 1)]
    value = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)]
    width = [b - a for a, b in itertools.pairwise(cuts)]
    choices = []
    for k, blocks in enumerate(itertools.combinations(range(radius + agree), agree)):
        key = F.lit(0).cast("long")
        for i in blocks:
            key = F.shiftleft(key, width[i]).bitwiseOR(value[i])
        choices.append(F.shiftleft(key, 16).bitwiseOR(F.lit(k)))
    bucket = F.array(*choices)
    rows = distinct.select("fp", F.explode(bucket).alias("bucket"))
    # buckets too large for one tree, by a sample: their number sets the cost and not the result
    thin = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).select(F.explode(bucket).alias("bucket"))
    large = thin.groupBy("bucket").agg(F.ceil(F.count("*") * SAMPLED / tree_rows).cast("int").alias("shards")).where("shards > 1")
    large = written(large, "large-buckets")
    rows = rows.join(large, "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    shard = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("shards")).cast("int")
    rows = rows.select("fp", "bucket", shard.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("tree"))
    rows = rows.select("fp", F.xxhash64("bucket", "tree").alias("bucket"), F.col("own").eqNullSafe(F.col("tree")).alias("member"))
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return record(schema, list(_bucket_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), radius)))

        for batch in batches:
            group = np.asarray(batch.column("bucket"))
            part = (group, batch.column("member").to_numpy(zero_copy_only=False), np.asarray(batch.column("fp")).view(np.uint64))
            if size >= tree_rows and len(group) and group[-1] != kept[-1][0][-1]:
                cut = int(np.argmax(group != kept[-1][0][-1]))
                kept.append(tuple(x[:cut] for x in part))
                yield done(kept)
                kept, size, part = [], 0, tuple(x[cut:] for x in part)
            kept.append(part)
            size += len(part[0])
        if size:
            yield done(kept)

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    marked = written(fingerprints(docs, width), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    distinct = written(marked.groupBy("fp").agg(least), "distinct")
    root = written(components(links(distinct, radius)).withColumnRenamed("node", "fp"), "roots")
    # only fingerprints whose component is not their own smallest id need a join
    first = distinct.join(root, "fp").groupBy("root").agg(F.min("least").alias("first"))
    moved = root.join(first, "root").select("fp", "first")
    # a table, so that the join below can be split where one fingerprint has very many documents
    own = written(distinct.join(moved, "fp", "left").select("fp", F.coalesce("first.doc_id", "least.doc_id").alias("component_id")), "components")
    return marked.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
