"""Near-duplicate vectors by dual traversal of cover trees: exact threshold links.

Vectors with the same label and number of components are compared by cosine. On unit vectors
the threshold is a distance, and a cover tree nests balls whose radii halve from level to level
and whose centres are more than the radius apart. Two trees are descended together: a pair of
nodes goes when the distance of the centres less both covering radii exceeds the threshold's
distance, links as a whole when the distance and both radii stay below it, and the vectors of two
leaves are compared exactly, in double precision.

Equal vectors (128 bits of two hashes) are one kind with a count. A label whose kinds exceed one
cell (``CELL_BYTES``) gets a level of its own above the trees: at most ``PIVOTS`` pivots over all
labels, in proportion to their sizes, each kind in the cell of its nearest pivot, with the cell's
covering radius. Pairs of cells that the radii keep apart go before a row is copied; cells that
are still too large are cut by hash. What is left are groups of two cut cells at most, so that a
label of any size spreads over many tasks. A group emits for each kind its number of links and
one spanning link; pairs are never emitted. How much the radii part depends on the vectors:
random ones in many dimensions lie all equally far apart, and exact links then need every pair of
cells.

Defined results: a vector that is null, empty, zero, or holds null or a non-finite component,
or has a null label, links with nothing and is its own component; null ids are kept and are
never a component's smallest id unless all are null; repeated rows are separate vectors, which
link with each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, expand, join_labels, record, release_memory, written

COSINE = 0.93
#: Bytes of the vectors of a cell, about; pivots over all labels, and bytes of their vectors, at most.
CELL_BYTES = 4 << 20
PIVOTS, PIVOT_BYTES = 1024, 32 << 20
LEAF = 16
#: Centres looked for at once, and pairs of rows compared at once.
AHEAD, PAIRS = 64, 1 << 14
#: Room for rounding in the bounds; the comparison of two vectors has none.
SLACK = 1e-7


class CoverTree:
    """Nodes over unit rows: a centre, a covering radius, children, and the rows below as a range of ``order``."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.children: list[np.ndarray] = []
        self._centre: list[int] = []
        self._radius: list[float] = []
        self._range: list[tuple[int, int]] = []
        self._rows: list[np.ndarray] = []
        self._placed = 0
        rows = np.arange(len(unit))
        self._grow(0, rows, np.sqrt(np.maximum(2 - 2 * (unit @ unit[0]), 0)), 2.0)
        self.centre, self.radius, self.order = np.array(self._centre), np.array(self._radius), np.concatenate(self._rows)
        self.first, self.end = np.array(self._range).T
        self.leaf = np.fromiter((not len(c) for c in self.children), bool, len(self.children))

    def _grow(self, centre: int, rows: np.ndarray, far: np.ndarray, radius: float) -> int:
        """A node of ``rows`` within ``radius`` of the centre, split into balls of half of it."""
        node, start = len(self._centre), self._placed
        self._centre.append(centre)
        self._radius.append(float(far.max()))
        self._range.append((start, start + len(rows)))
        self.children.append(np.zeros(0, np.int64))
        half = radius / 2
        while len(rows) > LEAF and half > 0.02 and self._radius[node] <= half:
            half /= 2  # a level on which nothing parts
        if len(rows) <= LEAF or half <= 0.02:
            self._rows.append(rows)
            self._placed += len(rows)
            return node
        groups = []
        near = far <= half
        groups.append((centre, rows[near], far[near]))
        rows = rows[~near]
        while len(rows):
            # the distances of many rows at once; those among them that no earlier one covers are centres
            ahead = np.sqrt(np.maximum(2 - 2 * (self.unit[rows[:AHEAD]] @ self.unit[rows].T), 0))
            left = np.ones(len(rows), bool)
            for i in range(len(ahead)):
                if left[i]:
                    near = np.flatnonzero(left & (ahead[i] <= half))
                    groups.append((int(rows[i]), rows[near], ahead[i][near]))
                    left[near] = False
            rows = rows[left]
        self.children[node] = np.array([self._grow(c, r, f, half) for c, r, f in groups])
        return node


def _dual(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """What links, in parts: ("rows", rows of a, rows of b), or ("nodes", nodes of a, nodes of b), all of whose rows link.

    Of a tree with itself each pair comes once, and a node beside itself stands for its pairs of different rows.
    """
    reach, one = math.sqrt(2 - 2 * cosine), a is b
    work = [(0, 0)]
    while work:
        u, v = work.pop()
        below_u = a.children[u] if len(a.children[u]) else np.array([u])
        below_v = b.children[v] if len(b.children[v]) else np.array([v])
        centres = b.unit[b.centre[below_v]].T
        for at in range(0, len(below_u), 4 * AHEAD):
            nodes = below_u[at : at + 4 * AHEAD]
            far = np.sqrt(np.maximum(2 - 2 * (a.unit[a.centre[nodes]] @ centres), 0))
            covered = a.radius[nodes][:, None] + b.radius[below_v][None]
            near = far - covered <= reach + SLACK
            if one and u == v:
                near &= np.arange(at, at + len(nodes))[:, None] <= np.arange(len(below_v))
            i, j = np.nonzero(near)
            whole = far[i, j] + covered[i, j] <= reach - SLACK
            p, q = nodes[i], below_v[j]
            if whole.any():
                yield "nodes", p[whole], q[whole]
            p, q = p[~whole], q[~whole]
            leaf = a.leaf[p] & b.leaf[q]
            work += zip(p[~leaf].tolist(), q[~leaf].tolist(), strict=True)
            p, q = p[leaf], q[leaf]
            wide = b.end[q] - b.first[q]
            counts = (a.end[p] - a.first[p]) * wide
            total, x = np.cumsum(counts), 0
            while x < len(p):
                y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PAIRS, side="right")))
                own, nth = expand(counts[x:y])
                r = a.order[a.first[p[x:y]][own] + nth // wide[x:y][own]]
                s = b.order[b.first[q[x:y]][own] + nth % wide[x:y][own]]
                good = np.einsum("ij,ij->i", a.unit[r], b.unit[s]) >= cosine
                if one:
                    good &= (p[x:y] != q[x:y])[own] | (r < s)
                yield "rows", r[good], s[good]
                x = y


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def group_links(unit: np.ndarray, side: np.ndarray, count: np.ndarray, cosine: float, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, weighted by the other's count; smallest row of its set) among rows of one cell (alone) or between two."""
    links, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(first) or not (alone or len(second)):
        return links, label
    a = CoverTree(unit[first])
    b, other = (a, first) if alone else (CoverTree(unit[second]), second)
    trees = [(a, first), (b, other)]
    # rows that link as whole nodes: sums over ranges of each tree's order
    weight = [np.append(0, np.cumsum(count[rows[t.order]])) for t, rows in trees]
    added = [np.zeros(len(rows) + 1, np.int64) for _, rows in trees]
    less, joined = np.zeros(len(first) + 1, np.int64), [set(), set()]
    for kind, x, y in _dual(a, b, cosine):
        if kind == "rows":
            p, q = first[x], other[y]
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            label = join_labels(label, p, q)
            continue
        own = (x == y) if alone else np.zeros(len(x), bool)
        for k, (t, n, w, wide) in enumerate(((a, x, b, y), (b, y, a, x))):
            some = ~own if k else np.ones(len(n), bool)  # a node beside itself counts once
            sums = weight[1 - k][w.end[wide[some]]] - weight[1 - k][w.first[wide[some]]]
            np.add.at(added[k], t.first[n[some]], sums)
            np.add.at(added[k], t.end[n[some]], -sums)
        np.add.at(less, a.first[x[own]], 1)
        np.add.at(less, a.end[x[own]], -1)
        ends = []
        for k, ((t, rows), n) in enumerate(zip(trees, (x, y), strict=True)):
            new = [i for i in np.unique(n).tolist() if i not in joined[k]]
            joined[k].update(new)
            spans = [rows[t.order[t.first[i] : t.end[i]]] for i in new]
            if spans:
                label = join_labels(label, np.concatenate([r[:-1] for r in spans]), np.concatenate([r[1:] for r in spans]))
            ends.append(rows[t.order[t.first[n]]])
        label = join_labels(label, *ends)
    for k, (t, rows) in enumerate(trees):
        np.add.at(links, rows[t.order], np.cumsum(added[k][:-1]))
    links[first[a.order]] -= np.cumsum(less[:-1]) * count[first[a.order]]
    return links, label


def _hashed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, h1, h2, v): h1 and h2 name a vector that can link; both are null for one that can't."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    h = [F.when(good, F.xxhash64("v", *[F.lit(i)] * i)).alias(f"h{i + 1}") for i in range(2)]
    return rows.select("vec_id", "label", *h, "v")


def _kinds(rows: DataFrame) -> DataFrame:
    """(kid, label, width, h1, h2, v, n, least): each different vector that can link."""
    kinds = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return written(kinds.withColumns({"kid": F.monotonically_increasing_id(), "width": F.size("v")}), "kinds")


def _pivots(kinds: DataFrame, sizes: DataFrame, cell_bytes: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of the largest labels (label, width) with more than one cell, in proportion to their bytes."""
    large = [(r.label, r.width, r.n, r.n * r.width * 8) for r in sizes.orderBy(F.desc(F.col("n") * F.col("width")), "label", "width").limit(PIVOTS).collect()]
    large = [x for x in large if x[3] > cell_bytes]
    whole = sum(x[3] for x in large)
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max((x[1] for x in large), default=1))))
    wanted = {(x[0], x[1]): min(-(-x[3] // cell_bytes), most * x[3] // whole) for x in large}
    wanted = {k: n for k, n in wanted.items() if n > 1}
    if not wanted:
        return {}
    size = {(x[0], x[1]): x[2] for x in large}
    share = kinds.sparkSession.createDataFrame([(*k, min(1.0, 2 * n / size[k])) for k, n in wanted.items()], kinds.select("label", "width", F.lit(0.0).alias("share")).schema)
    picked = F.pmod(F.xxhash64("h1", F.lit(1)), F.lit(1_000_000)) < F.col("share") * 1e6
    found: dict[tuple, list] = {}
    for r in kinds.join(F.broadcast(share), ["label", "width"]).where(picked).select("label", "width", "h1", "v").collect():
        found.setdefault((r.label, r.width), []).append((r.h1, r.v))
    return {k: _unit(np.array([v for _, v in sorted(rows)[: wanted[k]]], float)) for k, rows in found.items() if len(rows) > 1}


def _in_cells(kinds: DataFrame, pivots: dict[tuple, np.ndarray]) -> DataFrame:
    """``kinds`` with the cell of the nearest pivot and the distance to it; one cell where a label has no pivots."""
    shared = kinds.sparkSession.sparkContext.broadcast(pivots)
    kind = T.StructType([*kinds.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                if key in pivots:
                    of.setdefault(key, []).append(i)
            for key, at in of.items():
                rows = _unit(batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                d = 2 - 2 * (rows @ pivots[key].T)
                cell[at] = d.argmin(1)
                far[at] = np.sqrt(np.maximum(d.min(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[f.name for f in kind])

    if not pivots:
        return kinds.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
    return written(kinds.mapInArrow(run, kind), "cells")


def _near_cells(cells: DataFrame, pivots: dict[tuple, np.ndarray], cosine: float) -> DataFrame:
    """(label, width, a, b): pairs of cells, a <= b, that the covering radii don't keep apart; every cell beside itself."""
    own = cells.select("label", "width", F.col("cell").alias("a"), F.col("cell").alias("b"))
    if not pivots:
        return own
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    with_pivots = cells.sparkSession.createDataFrame([*pivots], cells.select("label", "width").schema)
    radius: dict[tuple, dict[int, float]] = {}
    for r in cells.join(F.broadcast(with_pivots), ["label", "width"]).select("label", "width", "cell", "radius").collect():  # one row a pivot
        radius.setdefault((r.label, r.width), {})[r.cell] = r.radius
    parts = []
    for key, of in radius.items():
        cell = np.array(sorted(of))
        r = np.array([of[c] for c in cell])
        far = np.sqrt(np.maximum(2 - 2 * (pivots[key][cell] @ pivots[key][cell].T), 0))
        i, j = np.nonzero(np.triu(far - r[:, None] - r[None] <= reach, 1))
        parts += [(*key, int(a), int(b)) for a, b in zip(cell[i], cell[j], strict=True)]
    return own.unionByName(cells.sparkSession.createDataFrame(parts, own.schema)) if parts else own


def _links(kinds: DataFrame, cosine: float, cell_bytes: int) -> DataFrame:
    """(kid, links, root) for each kind that links in a group of cells."""
    sizes = kinds.groupBy("label", "width").agg(F.count("*").alias("n"))
    pivots = _pivots(kinds, sizes, cell_bytes)
    rows = _in_cells(kinds, pivots)
    cells = written(rows.groupBy("label", "width", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") * F.col("width") * 8 / cell_bytes).cast("int").alias("parts")), "cell-sizes")
    near = _near_cells(cells, pivots, cosine)
    part = lambda c, out: cells.select("label", "width", F.col("cell").alias(c), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(out))
    groups = near.join(part("a", "x"), ["label", "width", "a"]).join(part("b", "y"), ["label", "width", "b"]).where("a < b or x <= y")
    rows = rows.join(cells.select("label", "width", "cell", "parts"), ["label", "width", "cell"]).withColumn("part", F.pmod(F.xxhash64("kid"), F.col("parts")).cast("int"))
    rows = rows.select("label", "width", "cell", "part", "kid", "n", "v")
    by = ["label", "width", "a", "b", "x", "y"]
    first = rows.withColumnsRenamed({"cell": "a", "part": "x"}).join(groups, ["label", "width", "a", "x"]).withColumn("side", F.lit(0))
    second = rows.withColumnsRenamed({"cell": "b", "part": "y"}).join(groups.where("a < b or x < y"), ["label", "width", "b", "y"]).withColumn("side", F.lit(1))
    both = first.unionByName(second)
    n = max(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = pa.schema([("kid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        vectors = whole["v"].combine_chunks() if isinstance(whole["v"], pa.ChunkedArray) else whole["v"]
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        unit = _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1))
        kid = np.asarray(whole["kid"])
        one = whole.slice(0, 1).to_pylist()[0]
        links, label = group_links(unit, np.asarray(whole["side"]), np.asarray(whole["n"]), cosine, (one["a"], one["x"]) == (one["b"], one["y"]))
        some = np.flatnonzero(links)
        return record(schema, [kid[some], links[some], kid[label[some]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
            cuts = [i for i, (x, y) in enumerate(zip([last, *keys], keys, strict=False)) if x != y and (i or last is not None)]
            at = 0
            for cut in cuts:
                if cut > at:
                    kept.append(batch.slice(at, cut - at))
                yield solve(kept)
                kept, at = [], cut
            kept.append(batch.slice(at))
            last = keys[-1]
        if kept:
            yield solve(kept)
        release_memory()

    return both.select(*by, "side", "kid", "n", "v").repartition(n, *by).sortWithinPartitions(*by).mapInArrow(run, "kid long, links long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding, label)."""
    rows = _hashed(embeddings)
    kinds = _kinds(rows)
    found = written(_links(kinds, cosine, cell_bytes), "links")
    roots = components(found.select(F.col("kid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "kid")
    counted = found.groupBy("kid").agg(F.sum("links").alias("links"))
    about = kinds.drop("v").join(counted, "kid", "left").join(roots, "kid", "left").withColumn("root", F.coalesce("root", "kid"))
    about = written(about.select("label", "h1", "h2", "n", "least", "root", F.coalesce("links", F.lit(0)).alias("links")), "about")
    least = about.groupBy("root").agg(F.min("least").alias("component"))
    about = written(about.join(least, "root").select("label", "h1", "h2", "n", "links", "component"), "about")
    # narrow rows on both sides: the join can be split where one vector is very frequent
    out = rows.drop("v").join(about, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same by every pair of a label and a walk along the links, for DuckDB.
SQL = f"""WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 good AS (SELECT * FROM rows WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT a.r AS u, b.r AS w FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
 reach AS (SELECT r AS s, r AS t FROM rows UNION SELECT reach.s, links.w FROM reach JOIN links ON links.u = reach.t),
 least AS (SELECT s, min(o.vec_id) AS component FROM reach JOIN rows o ON o.r = t GROUP BY s),
 counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(component, vec_id) AS kept
FROM rows LEFT JOIN least ON least.s = rows.r LEFT JOIN counts ON counts.u = rows.r"""
