"""Exact near-duplicate rows by token overlap, inside (type, scope, project) blocks.

Rows of a block with the same tokens are one kind, and kinds are what is compared: k equal rows
cost k rows and not their pairs. ``near_duplicate_pairs`` is the one answer that spells pairs out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.scratch import bucketed, components, discard, written

#: Least 64-bit words of a kind's parity map; it has 8 bits a token at least, and words by a power of two.
MAPS = 4
#: Most words of maps, and most kinds, of a tile; a small table is cut finer, so that one block makes pairs of tiles for all cores.
TILE_WORDS, TILE_KINDS, TILES = 1 << 17, 4096, 32
#: Words of maps that the kernel compares at once, and pairs that it hands on at once.
STEP, OUT = 1 << 16, 1 << 16
#: A cell's maps are dealt out in so many ways to learn their tile, as a block can hold most rows.
DEALS = 64


class Kinds(NamedTuple):
    """members: (id, seq, block, kind) of every row, kinds by number; links: (x, y, similarity) of kinds at the threshold, x < y."""

    members: DataFrame
    links: DataFrame


def _overlap(threshold: float, n: Column, m: Column) -> Column:
    """How many tokens two sets of n and m must share at least."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)


def _maps(hashed: DataFrame) -> DataFrame:
    """(kind, block, n, width, map) of each list of ``hashed`` (kind, block, hashes): each token flips one bit of a map of ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("hashes").value_lengths()).astype(np.int64)
            if not len(n):
                continue
            word = np.asarray(batch.column("hashes").flatten()).view(np.uint64)
            width = np.maximum(MAPS, 1 << np.ceil(np.log2(np.maximum(n, 8) / 8)).astype(np.int64))
            ends = np.cumsum(width)
            flat, owner = np.zeros(ends[-1], np.uint64), np.repeat(np.arange(len(n)), n)
            at = (ends - width)[owner] + ((word >> np.uint64(6)) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
            np.bitwise_xor.at(flat, at, np.uint64(1) << (word & np.uint64(63)))
            offsets = np.concatenate([[0], ends * 8]).astype(np.int32)
            maps = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("block"), pa.array(n.astype(np.int32)), pa.array(width.astype(np.int32)), maps], names=["kind", "block", "n", "width", "map"])

    return hashed.mapInArrow(run, "kind long, block string, n int, width int, map binary")


def _tiles(maps: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Tiles (tile, of: kinds with their maps) of at most about so many words in buckets, and a table of the pairs (x, y, load) of tiles that may hold links.

    A tile's maps are of one block and width; a block's kinds of one width are a cell, dealt to its
    tiles by hash. Cells whose sizes are too far apart are no pair.
    """
    cell = maps.groupBy("block", "width").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.max("n").alias("most"))
    parts = F.greatest(F.ceil(F.col("kinds") * F.col("width") / words), F.ceil(F.col("kinds") / TILE_KINDS)).cast("int")
    cells = written(cell.withColumn("parts", parts).withColumn("cell", F.monotonically_increasing_id()), "cells")
    dealt = cells.select("block", "width", "cell", "parts", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    named = lambda c, i: F.concat_ws("/", c, i)
    own = maps.withColumn("deal", F.pmod(F.xxhash64("kind"), F.lit(DEALS)).cast("int")).join(dealt.hint("merge"), ["block", "width", "deal"])
    own = own.select(named("cell", F.pmod(F.hash("kind"), "parts")).alias("tile"), F.struct("kind", "n", "map").alias("one"))
    tiles = bucketed(own.groupBy("tile").agg(F.collect_list("one").alias("of")), "tile", "maps")
    a, b = cells.alias("a"), cells.alias("b")
    sized = (F.col("a.most") >= F.lit(threshold) * F.col("b.least") - 1e-9) & (F.col("b.most") >= F.lit(threshold) * F.col("a.least") - 1e-9)
    met = a.join(b.hint("merge"), (F.col("a.block") == F.col("b.block")) & (F.col("a.cell") <= F.col("b.cell")) & sized)
    load = sum(F.col(f"{s}.kinds") * F.col(f"{s}.width") / F.col(f"{s}.parts") for s in "ab")
    met = met.select(F.col("a.cell").alias("p"), F.col("b.cell").alias("q"), load.alias("load"), F.col("b.parts").alias("n"), F.explode(F.sequence(F.lit(0), F.col("a.parts") - 1)).alias("i"))
    met = met.select("p", "q", "load", "i", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("i")).otherwise(0), F.col("n") - 1)).alias("j"))
    # either end comes first, so that no tile is the second of all its pairs
    ends, turned = (named("p", "i"), named("q", "j")), F.pmod(F.xxhash64("p", "i", "q", "j"), F.lit(2)) == 0
    pairs = met.select(*(F.when(turned, u).otherwise(v).alias(k) for k, u, v in (("x", *ends), ("y", *ends[::-1]))), "load")
    pairs = written(pairs, "candidates")
    discard(cells)
    return tiles, pairs


def _flips(maps: np.ndarray, width: int) -> np.ndarray:
    """Parity maps (one a row) folded to ``width`` words, which is what maps of that width would be."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, width), axis=1)


def _near(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in p and q, each (kinds, sizes in order, maps), of pairs whose sizes and maps allow the threshold; in one tile each pair once.

    A quarter of each map is compared first, then all of it.
    """
    (_, n, small), (_, m, large) = p, q
    width = min(small.shape[1], large.shape[1])
    few = max(width // 4, min(MAPS, width))
    small, large = _flips(small, width), _flips(large, width)
    first, second = _flips(small, few), np.ascontiguousarray(_flips(large, few).T)
    kind = np.uint16 if few < 1024 else np.int32
    i = 0
    while i < len(n):
        lo = max(np.searchsorted(m, threshold * n[i] - 1e-6), i + 1 if same else 0)
        rows = max(STEP // (few * max(len(m) - lo, 1)), 1)
        hi = np.searchsorted(m, (n[min(i + rows, len(n)) - 1] + 1e-6) / threshold, "right")
        some, j = n[i : i + rows], m[lo:hi]
        if len(j):
            both = some[:, None] + j[None, :]
            most = both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
            differ = np.bitwise_count(first[i : i + rows, :, None] ^ second[None, :, lo:hi]).sum(axis=1, dtype=kind)
            fit = (differ <= most) & (some[:, None] >= threshold * j - 1e-9) & (j >= threshold * some[:, None] - 1e-9)
            if same:
                fit &= np.arange(i, i + len(some))[:, None] < np.arange(lo, hi)
            u, v = np.nonzero(fit)
            if few < width and len(u):
                kept = np.bitwise_count(small[i + u] ^ large[lo + v]).sum(axis=1, dtype=np.int32) <= most[u, v]
                u, v = u[kept], v[kept]
            if len(u):
                yield i + u, lo + v
        i += rows


def _close(pairs: DataFrame, threshold: float) -> DataFrame:
    """(x, y, n) for ``pairs`` (same, at_x, at_y) of tiles: kinds x < y whose sizes and maps allow the threshold, and the size of x."""

    def opened(tile: pa.ListScalar) -> tuple[np.ndarray, ...]:
        kind, n, maps = tile.values.flatten()
        kind, n = np.asarray(kind), np.asarray(n).astype(np.int64)
        order = np.argsort(n, kind="stable")
        return kind[order], n[order], np.frombuffer(b"".join(maps.to_pylist()), np.uint64).reshape(len(n), -1)[order]

    def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, n, m = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.where(a < b, n, m).astype(np.int32))], names=["x", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, x, y in zip(batch.column("same").to_pylist(), batch.column("at_x"), batch.column("at_y"), strict=True):
                p, q = sorted((opened(x), opened(y)), key=lambda t: len(t[0]))
                found, many = [], 0
                for u, v in _near(p, q, same, threshold):
                    found.append((p[0][u], q[0][v], p[1][u], q[1][v]))
                    many += len(u)
                    if many >= OUT:
                        yield out(found)
                        found, many = [], 0
                if found:
                    yield out(found)

    return pairs.mapInArrow(run, "x long, y long, n int")


def _in_rounds(pairs: DataFrame, load: Column, most: int, of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``of(pairs)`` as a table, made of so many parts of ``pairs`` (x, y and more), one after another, that the ``load`` of one is about ``most``.

    Pairs grow with the square of the kinds, and each takes a map or a list of tokens along: what a
    part moves is gone from disk before the next begins.
    """
    n = max(ceil((pairs.agg(F.sum(load)).first()[0] or 0) / max(most, 1)), 1)
    if n == 1:
        return written(of(pairs), name)
    parts = [written(of(pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(n)) == i)), f"{name}-part") for i in range(n)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = written(whole, name)
    discard(*parts)
    return whole


def kinds(memory: DataFrame, threshold: float = 0.8, statuses: tuple[str, ...] = ("active",)) -> Kinds:
    """The kinds of rows and the links between them, as tables: a Jaccard overlap of at least the threshold.

    A row's tokens are made once and written. All kinds of a block are compared, but by parity maps
    (each token flips one bit) of a few bits a token: a pair goes if its sizes are too far apart or
    if more bits differ than tokens may. Maps lie in tiles of bounded size, and a task compares the
    tiles of one pair after another, so that time alone grows with the pairs of kinds, by some
    nanoseconds each, and only what the maps leave, few more than the links, is ever a row. Tokens (which hold no
    blank) travel as one text a row. Tables that hold them are small on disk and large in memory:
    the joins that fetch them are never broadcast. Tiles and tokens lie in buckets and
    are fetched in rounds, each of which moves no more words than all kinds have tokens.
    """
    rows = memory.where(F.col("status").isin(*statuses) & F.col("id").isNotNull())
    block = F.to_json(F.struct("type", "scope", "project"))
    words = F.sort_array(fn.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))))
    # asked of the text, as a filter by ``words`` would make the tokens once more
    some = F.lower(F.concat_ws(" ", "title", "summary")).rlike("[a-z0-9_]{2}")
    rows = rows.where(some).select("id", "seq", block.alias("block"), F.array_join(words, " ").alias("words"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat_ws("\n", "block", "words").cast("binary"), 256)))
    tokens = written(rows, "tokens")
    numbered = written(tokens.groupBy("key").agg(F.first("block").alias("block"), F.first("words").alias("words")).withColumn("kind", F.monotonically_increasing_id()), "kind-words")
    members = written(tokens.join(numbered.select("key", "kind").hint("merge"), "key").select("id", "seq", "block", "kind"), "members")
    discard(tokens)
    own = bucketed(numbered.drop("key"), "kind", "kind-words")
    discard(numbered)
    # maps are made of hashes: a collision makes two lists more alike, and the lists themselves decide
    maps = written(_maps(own.select("kind", "block", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes"))), "maps")
    most, words = (x or 0 for x in maps.agg(F.sum("n"), F.sum("width")).first())
    tiles, met = _tiles(maps, max(min(TILE_WORDS, words // TILES), 1), threshold)
    discard(maps)
    tile = lambda k: tiles.select(F.col("tile").alias(k), F.col("of").alias(f"at_{k}")).hint("merge")

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.select("x", "y").join(tile("x"), "x").join(tile("y"), "y")
        return _close(both.select((F.col("x") == F.col("y")).alias("same"), "at_x", "at_y"), threshold)

    before, met = met, _in_rounds(met, F.col("load"), most, close, "close-candidates")
    discard(before, tiles)
    side = lambda k: own.select(F.col("kind").alias(k), F.struct("block", "words").alias(f"of_{k}")).hint("merge")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("x"), "x").join(side("y"), "y")
        both = both.select("x", "y", (F.col("of_x.block") == F.col("of_y.block")).alias("met"), F.split("of_x.words", " ").alias("p"), F.split("of_y.words", " ").alias("q"))
        common = F.size(F.array_intersect("p", "q"))
        share = common / (F.size("p") + F.size("q") - common)  # the block is no key of the join, which would deal the buckets out anew
        return both.select("x", "y", F.when(F.col("met"), share).alias("similarity")).where(F.col("similarity") >= threshold)

    links = _in_rounds(met, F.col("n"), most, linked, "kind-links")
    discard(own, met)
    return Kinds(members, links)


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, seq_a, seq_b, block, similarity): every pair of linked rows, those of one kind too; a < b by id, seq_a < seq_b."""
    kept = members.select("kind").distinct()
    same = kept.select(F.col("kind").alias("x"), F.col("kind").alias("y"), F.lit(1.0).alias("similarity"))
    member = lambda k, s: members.select(F.col("kind").alias(k), F.struct("id", "seq", "block").alias(s))
    pairs = links.unionByName(same).join(member("x", "p").hint("merge"), "x").join(member("y", "q").hint("merge"), "y")
    pairs = pairs.where((F.col("x") != F.col("y")) | (F.col("p.seq") < F.col("q.seq")))
    first, last = (F.when(F.col("p.seq") < F.col("q.seq"), F.col(u)).otherwise(F.col(v)) for u, v in (("p", "q"), ("q", "p")))
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), first["seq"].alias("seq_a"), last["seq"].alias("seq_b"), "p.block", "similarity")


def near_duplicate_pairs(memory: DataFrame, threshold: float = 0.8, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Every pair of rows of a block with a Jaccard overlap of at least the threshold, as ``pairs_of`` gives them."""
    return pairs_of(*kinds(memory, threshold, statuses))


def count_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row (n): how many rows ``pairs_of`` has, which are not made."""
    seqs = members.groupBy("kind", "seq").agg(F.count("*").alias("n"))
    of = seqs.groupBy("kind").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("seq").isNotNull(), F.col("n"))), F.lit(0)).alias("placed"), F.coalesce(F.sum(F.when(F.col("seq").isNotNull(), F.col("n") * F.col("n"))), F.lit(0)).alias("alike"))
    same = of.select(((F.col("placed") * F.col("placed") - F.col("alike")) / 2).cast("long").alias("n"))
    side = lambda k, n: of.select(F.col("kind").alias(k), F.col("n").alias(n)).hint("merge")
    met = links.join(side("x", "p"), "x").join(side("y", "q"), "y").select((F.col("p") * F.col("q")).alias("n"))
    return same.unionByName(met).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, class, kinds, links): the component of each kind, how many kinds it has and how many links between them. Both are tables."""
    root = components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))).select(F.col("node").alias("kind"), F.col("root").alias("class"))
    sizes = root.groupBy("class").agg(F.count("*").alias("kinds"))
    counts = links.join(root.hint("merge"), links["x"] == root["kind"]).groupBy("class").agg(F.count("*").alias("links"))
    linked = root.join(sizes.hint("merge"), "class").join(counts.hint("merge"), "class")
    own = members.select("kind").distinct().join(linked.hint("merge"), "kind", "left")
    return own.select("kind", F.coalesce("class", "kind").alias("class"), F.coalesce("kinds", F.lit(1)).alias("kinds"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_classes(memory: DataFrame, threshold: float = 0.8, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """(id, representative, copies, n_links, class_id) for each row with tokens; no pair of rows is made.

    representative: the smallest id with the same tokens, and copies how many rows have them;
    n_links: the other rows at the threshold; class_id: the smallest id reachable by links.
    """
    members, links = kinds(memory, threshold, statuses)
    of = written(members.groupBy("kind").agg(F.min("id").alias("representative"), F.count("*").alias("copies")), "kinds")
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    near = both.join(of.select(F.col("kind").alias("y"), F.col("copies").alias("others")).hint("merge"), "y").groupBy(F.col("x").alias("kind")).agg(F.sum("others").alias("others"))
    group = classes(members, links).select("kind", "class")
    least = group.join(of.hint("merge"), "kind").groupBy("class").agg(F.min("representative").alias("class_id"))
    kind = of.join(group.hint("merge"), "kind").join(least.hint("merge"), "class").join(near.hint("merge"), "kind", "left")
    kind = kind.select("kind", "representative", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "class_id")
    return members.select("id", "kind").join(kind.hint("merge"), "kind").drop("kind")
