"""Near-duplicate texts by SimHash fingerprints and BK-trees, verified by exact shingle similarity.

The SimHash operator's form for a stage that drops near copies. Two texts link if the
fingerprints of their shingle sets (``WIDTH`` lower-cased words, XXH64) differ in at most
``RADIUS`` of 64 bits and the sets have a Jaccard similarity of at least 4/5; groups are the
connected components. (At that similarity about ten bits are expected to differ; fewer than one
pair in 10^5 differs in more than the radius.)

A radius that wide prunes nothing in one tree over all texts, so trees stand in buckets. Shingles
have one order, that of their hashes with the common ones last; sets of similarity 4/5 share a
shingle among the first n - ceil(4n/5) + 1 of each, so each of those is a bucket. In a small
bucket all pairs that its BK-tree finds are candidates. In a large one (a common shingle: a
group of copies, a shared line) each set is first paired with two centres, those with the fewest
rare shingles; when those links are known, the buckets that are one group by then are done, and
of the others only the sets outside the largest group search the shard trees for sets of other
groups. A set that has a common shingle among its first has all its rare ones there too, so sets
that share a rare one meet in its bucket; all others share no more than the smaller one's common
shingles, which keeps edited copies of one text apart without a look at each pair's sets.
Candidates are verified on their whole sets.

Which shingles are common is learned from a hash sample of texts and bounded; it decides the
cost, not the result. Copies of a set are one row. Rows are numbered and written once in buckets
of that number, so no later step shuffles texts. Sets are told apart by 64 bits of their hash.

Defined results: equal sets are one group, those of null, empty and blank texts too; null ids
count as larger than any id; of repeated rows one stays; other columns are kept, whatever their
names but ``text``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, components, discard, expand, numbered, record, restored, slices, texts, written
from .simhash import SEED, BKForest, majority, shingle_hashes

WIDTH, RADIUS = 5, 24
#: One of so many texts is looked at for common shingles; a shingle in so many of those is common; at most so many are kept.
SAMPLED, COMMON, MOST_COMMON = 8, 4, 200_000
#: Sets in a bucket whose pairs are all searched at once, at most; tasks that a common shingle's sets are dealt to.
SMALL, SALTS = 32, 64
#: Sets in a shard tree of a contested bucket.
PART = 1024
#: Pairs made at once, and set keys that a task remembers to skip copies.
PAIRS, MEMO = 1 << 18, 1 << 20


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 4/5 or more."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _keyed(dealt: DataFrame) -> DataFrame:
    """(rid, doc, key): a hash of each row's shingle set."""
    schema = pa.schema([(RID, pa.int64()), ("__doc", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield record(schema, [batch.column(RID), batch.column("__doc"), [set_key(shingle_set(t)) for t in texts(batch)]])

    return dealt.select(RID, "__doc", "text").mapInArrow(run, f"{RID} long, __doc long, key long")


def _common(dealt: DataFrame) -> np.ndarray:
    """Shingles of many sampled texts, sorted."""
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield record(schema, [np.concatenate([shingle_set(t) for t in texts(batch)]).view(np.int64)])

    thin = dealt.select("text").where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(SAMPLED)) == 0)
    counts = thin.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    return np.sort(np.asarray(found.column("shingle").combine_chunks()).view(np.uint64))


def _prefixes(dealt: DataFrame, common: np.ndarray) -> DataFrame:
    """(shingle, salt, key, fp, n, pos, most): the buckets of each set, its fingerprint and size, and the shingle's place.

    salt is 0 if the shingle isn't common; most: what the set can share with one that meets it here and in no bucket of a rare shingle.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("shingle", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("most", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        seen: set[int] = set()
        for batch in slices(batches, "text", 2 << 20):
            if len(seen) > MEMO:
                seen.clear()
            sets, keys = [], []
            for s in map(shingle_set, texts(batch)):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
            if not sets:
                continue
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            first, rare = n - (4 * n + 4) // 5 + 1, n.copy()
            fp = majority(np.concatenate(sets), n).view(np.int64)
            if len(common):
                for i, s in enumerate(sets):
                    often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    rare[i] -= often.sum()
                    sets[i] = np.concatenate((s[~often], s[often]))
            own, pos = expand(first)
            key = np.array(keys, np.int64)
            often = pos >= rare[own]
            salt, most = np.where(often, 1 + key[own] % SALTS, 0), np.where(often, (n - rare)[own], n[own])
            yield record(schema, [np.concatenate([s[:p] for s, p in zip(sets, first, strict=True)]).view(np.int64), salt.astype(np.int32), key[own], fp[own], n[own].astype(np.int32), pos.astype(np.int32), most.astype(np.int32)])

    return dealt.select("text").mapInArrow(run, "shingle long, salt int, key long, fp long, n int, pos int, most int")


def _can(n: np.ndarray, pos: np.ndarray, most: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes and places of a shared shingle leave room for a similarity of 4/5."""
    n, pos, most = n.astype(np.int64), pos.astype(np.int64), most.astype(np.int64)
    room = np.minimum(np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]), np.minimum(most[i], most[j]))
    return 9 * room >= 4 * (n[i] + n[j])


def searched(group: np.ndarray, fp: np.ndarray, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius in the same group, in parts: each i < j, or (asks) each row that asks with each other row that doesn't."""
    fp = fp.view(np.uint64)
    asks = np.ones(len(fp), bool) if (every := asks is None) else asks
    nodes = np.arange(len(fp)) if every else np.flatnonzero(~asks)
    if not len(nodes):
        return

    def packed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of (group, fingerprint), where each different one begins, and counts."""
        rows = rows[np.lexsort((fp[rows], group[rows]))]
        cut = np.flatnonzero(np.append(True, (group[rows][1:] != group[rows][:-1]) | (fp[rows][1:] != fp[rows][:-1])))
        return rows, cut, np.diff(np.append(cut, len(rows)))

    tree, tree_at, tree_n = packed(nodes)
    ask, ask_at, ask_n = (tree, tree_at, tree_n) if every else packed(np.flatnonzero(asks))
    if not len(ask):
        return
    forest = BKForest(group[tree[tree_at]], fp[tree[tree_at]])
    for q, v in forest.links(group[ask[ask_at]], fp[ask[ask_at]], RADIUS):
        if every:
            q, v = q[q <= v], v[q <= v]
        counts = ask_n[q] * tree_n[v]
        total, a = np.cumsum(counts), 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
            own, nth = expand(counts[a:b])
            x, y = q[a:b][own], v[a:b][own]
            i, j = ask[ask_at[x] + nth // tree_n[y]], tree[tree_at[y] + nth % tree_n[y]]
            if every:
                i, j = i[(x < y) | (i < j)], j[(x < y) | (i < j)]
            yield i, j
            a = b


def _pair(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(key[i], key[j]), np.maximum(key[i], key[j]))), axis=1)


def _met(prefixes: DataFrame) -> DataFrame:
    """Candidates of small buckets (kind 0: a and b) and the rows of large ones (kind 1: shingle, key, fp, n, pos, most)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("most", pa.int32())])

    def told(columns: list[np.ndarray], large: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, _, key, fp, n, pos, most = (c[large] for c in columns)
        if len(key):
            yield record(schema, [np.ones(len(key), np.int32), shingle, key, fp, n, pos, most])
        shingle, _, key, fp, n, pos, most = (c[~large] for c in columns)
        for i, j in searched(shingle, fp) if len(key) else ():
            good = _can(n, pos, most, i, j)
            u, v = _pair(key, i[good], j[good])
            none = np.zeros(len(u), np.int32)
            yield record(schema, [none, u, v, np.zeros(len(u), np.int64), none, none, none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the bucket that the last batch ended in; of one known to be large the last row only
        rest: list[np.ndarray] | None = None
        is_large = False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            shingle, salt, key = columns[:3]
            # sorted by bucket and key: equal sets meet as neighbours, one is enough
            one = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
            columns = [c[one] for c in columns]
            shingle, salt, key = columns[:3]
            bucket = np.cumsum(np.append(0, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])))
            large = (salt > 0) | (np.bincount(bucket)[bucket] > SMALL) | (is_large & (bucket == 0))
            is_large = bool(large[-1])
            last = bucket == bucket[-1]
            if is_large:
                last = np.arange(len(bucket)) == len(bucket) - 1
            rest = [c[last] for c in columns]
            yield from told([c[~last] for c in columns], large[~last])
        if rest is not None:
            yield from told(rest, np.full(len(rest[0]), is_large))

    n = max(int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = prefixes.repartition(n, "shingle", "salt").sortWithinPartitions("shingle", "salt", "key")
    return rows.mapInArrow(run, "kind int, a long, b long, fp long, n int, pos int, most int")


def _centred(rows: DataFrame) -> DataFrame:
    """Candidates (u, v): each set of a large bucket with two of those that have the fewest rare shingles."""
    rare = F.col("n") - F.col("most")
    rest = [F.col(c) for c in ("key", "fp", "n", "pos", "most")]
    centres = written(rows.groupBy("shingle").agg(F.min(F.struct(rare.alias("by"), *rest)).alias("low"), F.max(F.struct((-rare).alias("by"), *rest)).alias("high")), "centres")
    both = rows.join(centres, "shingle").select(*rest, F.explode(F.array("low", "high")).alias("c"))
    room = F.least(F.least("pos", "c.pos") + F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")), "most", "c.most")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= RADIUS) & (9 * room >= 4 * (F.col("n") + F.col("c.n")))
    return both.where(near & (F.col("key") != F.col("c.key"))).select(F.least("key", "c.key").alias("u"), F.greatest("key", "c.key").alias("v")).distinct()


def _apart(rows: DataFrame, tree_rows: int = PART) -> DataFrame:
    """Candidates (u, v) of different roots in large buckets; rows (shingle, key, fp, n, pos, most, root)."""
    rows = written(rows, "labelled")
    roots = rows.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    buckets = roots.groupBy("shingle").agg(F.sum("size").alias("all"), F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"))
    buckets = written(buckets.where("roots > 1").select("shingle", "main", F.ceil(F.col("all") / tree_rows).cast("int").alias("parts")), "buckets")
    rows = written(rows.join(buckets, "shingle").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "contested")
    every: Column = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    columns = ["shingle", "key", "fp", "n", "pos", "most", "root"]
    # each part of the sets that ask meets each part of the tree's
    asking = rows.where("root <> main").select(*columns, "own", every, F.lit(True).alias("asks"))
    asked = rows.select(*columns, F.col("own").alias("__own"), every, F.lit(False).alias("asks")).select(*columns, F.col("other").alias("own"), F.col("__own").alias("other"), "asks")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bucket, key, fp, n, pos, most, root, asks = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i, j in searched(bucket, fp, asks):
            good = (root[i] != root[j]) & _can(n, pos, most, i, j)
            u, v = _pair(key, i[good], j[good])
            yield record(schema, [u, v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if size >= tree_rows and len(part[0]) and part[0][-1] != kept[-1][0][-1]:
                cut = int(np.argmax(part[0] != kept[-1][0][-1]))
                kept.append([x[:cut] for x in part])
                yield from solve(kept)
                kept, size, part = [], 0, [x[cut:] for x in part]
            if len(part[0]):
                kept.append(part)
                size += len(part[0])
        if size:
            yield from solve(kept)

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bucket = F.xxhash64("shingle", "own", "other").alias("bucket")
    dealt = asking.unionByName(asked).select(bucket, "key", "fp", "n", "pos", "most", "root", "asks").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def _verified(dealt: DataFrame, least: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    kind = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield record(kind, [batch.column("key"), [shingle_set(t).view(np.int64) for t in texts(batch)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [similar(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64)) for i in range(batch.num_rows)]
            yield record(schema, [batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("u", "v")])

    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    wanted = least.join(keys, "key").select("key", F.col(f"least.{RID}").alias(RID))
    sets = written(dealt.select(RID, "text").join(wanted, RID).select("key", "text").mapInArrow(of_texts, "key long, shingles array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("y")), "v")
    links = written(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "similar")
    discard(sets)
    return links


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of similar texts, with the same columns: that of the smallest id."""
    dealt = numbered(docs, F.col("doc_id").cast("long").alias("__doc"))
    first = F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", RID)).alias("least")
    least = written(_keyed(dealt).groupBy("key").agg(first), "shingle-sets")
    met = written(_met(_prefixes(dealt, _common(dealt))), "met")
    rows = met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("key"), "fp", "n", "pos", "most")
    pairs = met.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(_centred(rows)).distinct()
    pairs = written(pairs, "pairs")
    links = _verified(dealt, least, pairs)
    root = written(components(links).withColumnRenamed("node", "key"), "roots")
    labelled = rows.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    more = written(_apart(labelled).join(pairs, ["u", "v"], "left_anti"), "pairs")
    discard(met, pairs)
    if not more.isEmpty():
        links = links.unionByName(_verified(dealt, least, more))
        root = written(components(links).withColumnRenamed("node", "key"), "roots")
    stays = least.join(root, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("least"))
    return restored(dealt.join(stays.select(F.col(f"least.{RID}").alias(RID)), RID, "left_semi"), docs)
