"""Removal of repeated word spans by a compacted de Bruijn graph.

A window is ``window`` words in a row inside one document. A word goes if a window over it also
starts in a document with a smaller id. The windows are the graph's edges, each from the words
without its last to the words without its first.

1. The rows get numbers and are written once, in buckets of that number, so that no later step
   shuffles texts. The windows of a document in a row that share their least ``GRAM``-word hash
   form a fragment (some five windows); fragments are counted by that key, and keys of a single
   document go: exactly, after a bounded Bloom filter has spared most of them from being written.
2. Equal fragments become one kind with its first and last document. A key with one kind gives
   one compound edge, read where it first stands in its first document; the windows of other kinds
   become edges of their own. Equal edges meet in a pre-aggregated minimum; those of a single
   document go.
3. Edges and the counts of edges that end and start at their nodes are joined: a path runs on
   where one edge ends and one starts. An edge's first place is the colour of a path, and edges of
   one colour lie in a row in the first document, so paths are compacted along its coordinates.
4. Each kind's stretches of a path are joined back to the fragments of later documents, and
   stretches in a row become spans with source coordinates: a range of words here, the same range
   there.
5. Two fingerprints of words other than those used before, read at both ends of each source range,
   must equal those of the span's own words, else the span stays. The union of the rest is removed.

Counts are combined before each shuffle; joins by key can be split where a key is hot; nothing is
gathered but the ranges of one document. Fragments and windows of a key are told apart by 64 bits
beside the key's 64.

Defined results: null and empty texts have no word; texts of fewer words than a window lose none;
rows with the same id, and those with null ids, are not earlier than one another, and null ids
count as the largest id; repeats inside one document stay; other columns are ignored by
``digests`` and kept by ``cleaned``, whatever their names but ``text``; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, discard, expand, key_filter, in_filter, mix, numbered, powers, record, restored, slices, texts, written

WINDOW = 13
#: Words of the grams that key windows.
GRAM = 4
#: The document id of rows without one.
LAST = (1 << 63) - 1
#: Bytes of texts handled at once, so that a slice's arrays stay in a core's cache.
SLICE = 1 << 17

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _letters(salt: int) -> np.ndarray:
    """A 64-bit number for each byte."""
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(256 * salt + 1)) * _STEP)


_LETTERS = [_letters(i) for i in range(3)]


class Words:
    """The words of some texts: 64-bit hashes, and the document and place of each."""

    def __init__(self, raw: list[bytes], salt: int = 0):
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
        start, end = edge[::2], edge[1::2]
        power, inverse = powers(len(data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[salt][data] * power, dtype=np.uint64)))
        self.hash = mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64) * _STEP)
        self.owner = np.searchsorted(ends, start, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(raw) + 1))
        self.place = np.arange(len(start)) - self.first[self.owner]


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` hashes in a row."""
    n = max(len(h) - size + 1, 0)
    out = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + n]) * _STEP
        out ^= out >> np.uint64(31)
    return mix(out)


def gram_windows(window: int, gram: int = GRAM) -> int:
    """How many windows in a row one gram can serve."""
    return window - gram + 1


def fragments_of(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, content) of the fragments of some texts: windows in a row of one text with the same least gram."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, width = _runs(words.hash, gram), gram_windows(window, gram)
    least = grams[:n].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + n], out=least)
    inside = words.owner[:n] == words.owner[window - 1 :]
    start = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (words.owner[1:n] != words.owner[: n - 1])))
    size = np.diff(np.append(start, n))
    start, size = start[inside[start]], size[inside[start]]
    # where the gram comes again, a run is longer than one gram can serve
    owner, nth = expand(-(-size // width))
    start, size = start[owner] + nth * width, np.minimum(size[owner] - nth * width, width)
    power, inverse = powers(len(words.hash))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hash * power, dtype=np.uint64)))
    content = mix((total[start + size + window - 1] - total[start]) * inverse[start] ^ size.astype(np.uint64))
    return least[start], start, size, content


def _keys(dealt: DataFrame, window: int) -> DataFrame:
    """(key, doc) of every fragment."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = Words(texts(batch))
            key, start, _, _ = fragments_of(words, window)
            if len(key):
                yield record(schema, [key.view(np.int64), np.asarray(batch.column("doc"))[words.owner[start]]])

    return dealt.select("doc", "text").mapInArrow(run, "key long, doc long")


def _found(dealt: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """The fragments whose key may be in ``keys``; place is that of the first window in its text, times 256, plus the number of windows."""
    shared = dealt.sparkSession.sparkContext.broadcast(key_filter(keys))
    names = ("key", "content", "doc", "rid", "place")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = Words(texts(batch))
            key, start, size, content = fragments_of(words, window)
            kept = np.flatnonzero(in_filter(shared.value, key))
            if len(kept):
                at = words.owner[start[kept]]
                yield record(schema, [key[kept].view(np.int64), content[kept].view(np.int64), np.asarray(batch.column("doc"))[at], np.asarray(batch.column(RID))[at], words.place[start[kept]] << 8 | size[kept]])

    return dealt.select("doc", RID, "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _kinds(found: DataFrame) -> DataFrame:
    """Each different fragment of a key of several documents: its first document, a row of that, its last document, and whether its key has others."""
    kinds = written(found.groupBy("key", "content").agg(F.min_by("rid", "doc").alias("rid"), F.min("doc").alias("doc"), F.max("doc").alias("last")), "kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("doc").alias("least"), F.max("last").alias("most")).where("least < most")
    out = written(kinds.join(keys.select("key", (F.col("kinds") > 1).alias("several")), "key"), "kinds")
    discard(kinds)
    return out


_EDGE = ("key", "content", "edge", "u", "v", "doc", "last", "rid", "pos")


def _edges(kinds: DataFrame, dealt: DataFrame, window: int, known: tuple[int, bytes | None] | None) -> DataFrame:
    """The edges of each kind, read where it first stands in its row: one for each window, or a compound one where its key has no other kind.

    With a filter: those of its windows' edges that it holds, and all compound ones. Columns: key,
    content, edge (its hash), u and v (hashes of its two nodes), doc, last, rid, pos, step (the
    edge's place in the kind), windows, several (it is a window of a key with other kinds).
    """
    wanted = kinds.groupBy(F.col("rid").alias(RID)).agg(F.collect_list(F.struct("key", "content", "doc", "last", "several")).alias("cuts"))  # as many as the row has windows, at most
    shared = dealt.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([*[(n, pa.int64()) for n in _EDGE], ("step", pa.int32()), ("windows", pa.int32()), ("several", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = Words(texts(batch))
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            key, content, doc, last = (np.asarray(flat.field(n)) for n in ("key", "content", "doc", "last"))
            several = flat.field("several").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cuts))
            at, size = _first_places(words, window, text, key, content)
            one, step = expand(np.where(several, size, 1))
            size, several, at = np.where(several, 1, size)[one], several[one], at[one] + step
            nodes, edges = _runs(words.hash, window - 1), _runs(words.hash, window)
            edge = np.where(several, edges[at].view(np.int64), content[one])
            columns = [key[one], content[one], edge, nodes[at].view(np.int64), nodes[at + size].view(np.int64), doc[one], last[one], np.asarray(batch.column(RID))[text[one]], words.place[at], step.astype(np.int32), size.astype(np.int32), several]
            if shared.value is not None:
                kept = ~several | in_filter(shared.value, edge.view(np.uint64))
                columns = [c[kept] for c in columns]
            yield record(schema, columns)

    kind = ", ".join(f"{n} long" for n in _EDGE) + ", step int, windows int, several boolean"
    return dealt.select(RID, "text").join(wanted, RID).select(RID, "text", "cuts").mapInArrow(run, kind)


def _first_places(words: Words, window: int, text: np.ndarray, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window and the number of windows of the fragments (text, key, content)."""
    k, start, size, c = fragments_of(words, window)
    some = np.flatnonzero(np.isin(k.view(np.int64), key))[::-1]  # the first place of equal fragments is put in last
    known = dict(zip(zip(words.owner[start[some]].tolist(), k[some].view(np.int64).tolist(), c[some].view(np.int64).tolist(), strict=True), some.tolist(), strict=True))
    at = np.array([known[x] for x in zip(text.tolist(), key.tolist(), content.tolist(), strict=True)], np.int64)
    return start[at], size[at]


def compacted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v, rid, pos, windows and more) with ``path``: the place of the first edge of the nonbranching path each lies on.

    A path runs on over a node at which one edge ends and one starts, if they lie in a row in their source.
    """
    ends = edges.select(F.col("v").alias("u"), F.lit(1).alias("ending"), F.lit(0).alias("starting"))
    both = ends.unionByName(edges.select("u", F.lit(0).alias("ending"), F.lit(1).alias("starting")))
    through = both.groupBy("u").agg(F.sum("ending").alias("ending"), F.sum("starting").alias("starting")).where("ending = 1 and starting = 1").select("u", F.lit(True).alias("through"))
    along = Window.partitionBy("rid").orderBy("pos")
    runs_on = F.col("through").isNotNull() & (F.lag(F.col("pos") + F.col("windows")).over(along) == F.col("pos"))
    rows = edges.join(through, "u", "left").withColumn("begins", F.when(F.coalesce(runs_on, F.lit(False)), F.lit(None)).otherwise(F.col("pos")))
    return rows.withColumn("path", F.max("begins").over(along)).drop("through", "begins")


def graph(dealt: DataFrame, kinds: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The edges of several documents, kind by kind, and once each with the source and the path they lie on."""
    alike = _edges(kinds.where("several"), dealt, window, None).groupBy("key", "edge").agg(F.min("doc").alias("least"), F.max("last").alias("most"))
    shared = written(alike.where("least < most").select("key", "edge", "least"), "shared-edges")
    rows = _edges(kinds, dealt, window, key_filter(shared.select(F.col("edge").alias("key"))))
    cut = written(rows.join(shared, ["key", "edge"], "left").where("not several or least is not null").drop("last"), "edges")
    discard(shared)
    first = cut.where("not several or doc = least").groupBy("key", "edge", "several").agg(F.min(F.struct("doc", "rid", "pos")).alias("at"), *[F.min(n).alias(n) for n in ("u", "v", "windows")])
    return cut, written(compacted(first.select("key", "edge", "several", "u", "v", "windows", "at.*")), "paths")


def _stretches(cut: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, content, source_doc, source, path, shift, a, b): the windows a to b - 1 of a kind lie on a path, ``shift`` words on in its source."""
    on = paths.select("key", "edge", "several", "windows", F.col("doc").alias("source_doc"), F.col("rid").alias("source"), "path", F.col("pos").alias("there"))
    rows = cut.where("several").select("key", "edge", "content", "step").join(on.where("several"), ["key", "edge"])
    shift = F.col("there") - F.col("step")
    # two windows of a kind on one shift of a source enclose words that are the source's own: so are the windows between them
    split = rows.groupBy("key", "content", "source_doc", "source", "path", shift.alias("shift")).agg(F.min("step").alias("a"), (F.max("step") + 1).alias("b"))
    whole = on.where("not several").select("key", F.col("edge").alias("content"), "source_doc", "source", "path", F.col("there").alias("shift"), F.lit(0).alias("a"), F.col("windows").alias("b"))
    return split.unionByName(whole)


def _spans(found: DataFrame, stretches: DataFrame) -> DataFrame:
    """(rid, source, shift, a, b): the words a to b - 1 + window of a row are those ``shift`` words on in the source, an earlier document."""
    rows = found.join(stretches, ["key", "content"]).where("source_doc < doc")
    pos = F.shiftright("place", 8)
    rows = rows.select("rid", "source", "path", (F.col("shift") - pos).alias("shift"), (pos + F.col("a")).alias("a"), (pos + F.col("b")).alias("b"))
    same = Window.partitionBy("rid", "source", "path", "shift").orderBy("a", "b")
    past = F.max("b").over(same.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(past >= F.col("a"), 0).otherwise(1)).withColumn("nth", F.sum("new").over(same))
    return rows.groupBy("rid", "source", "path", "shift", "nth").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("path", "nth")


def _fingerprints(words: Words, other: Words, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of two polynomials over the words of a text."""
    part = slice(words.first[text], words.first[text + 1])
    power, _ = powers(part.stop - part.start)
    zero = np.zeros(1, np.uint64)
    return tuple(np.concatenate((zero, np.cumsum(x.hash[part] * power, dtype=np.uint64))) for x in (words, other))


def _between(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprints of ranges of words, whatever stands before them."""
    _, inverse = powers(len(sums[0]))
    return np.stack([(x[b] - x[a]) * inverse[a] for x in sums])


def _verified(spans: DataFrame, dealt: DataFrame, window: int) -> DataFrame:
    """``spans`` with the running fingerprints of their source before and after the range they stand for."""
    ends = spans.select("source", F.explode(F.array(F.col("a") + F.col("shift"), F.col("b") + F.col("shift") + window - 1)).alias("point")).distinct()
    wanted = ends.groupBy(F.col("source").alias(RID)).agg(F.collect_list("point").alias("points"))  # as many as the row has words, at most
    schema = pa.schema([("source", pa.int64()), ("point", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raw = texts(batch)
            words, other, points = Words(raw, 1), Words(raw, 2), batch.column("points")
            parts = []
            for i, rid in enumerate(batch.column(RID).to_pylist()):
                sums, at = _fingerprints(words, other, i), np.asarray(points[i].values)
                parts.append((np.full(len(at), rid), at, *(x[at].view(np.int64) for x in sums)))
            yield record(schema, [np.concatenate(x) for x in zip(*parts, strict=True)])

    read = written(dealt.select(RID, "text").join(wanted, RID).select(RID, "text", "points").mapInArrow(run, "source long, point long, one long, two long"), "fingerprints")

    rows = spans.withColumn("before", F.col("a") + F.col("shift")).withColumn("after", F.col("b") + F.col("shift") + window - 1)
    for name in ("before", "after"):
        rows = rows.join(read.select("source", F.col("point").alias(name), F.struct("one", "two").alias(f"f_{name}")), ["source", name])
    return rows


def removals(dealt: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, spans): for each row with repeated windows their ranges of words (a, b) with what must be their fingerprints."""
    if not 0 < gram_windows(window) < 256:
        raise ValueError(f"a window has {GRAM} to {GRAM + 254} words")
    keys = written(_keys(dealt, window).groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key"), "keys")
    found = written(_found(dealt, keys, window), "fragments")
    discard(keys)
    kinds = _kinds(found)
    cut, paths = graph(dealt, kinds, window)
    discard(kinds)
    stretches = written(_stretches(cut, paths), "stretches")
    discard(cut, paths)
    spans = written(_spans(found, stretches), "spans")
    discard(found, stretches)
    rows = _verified(spans, dealt, window)
    span = F.struct("a", (F.col("b") + window - 1).alias("b"), F.col("before").alias("from"), "f_before", "f_after")
    return rows.groupBy(F.col("rid").alias(RID)).agg(F.collect_list(span).alias("spans"))


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """The words of each row, and which of them stay (None: all)."""
    spans = batch.column("spans")
    marked = spans.is_valid().to_numpy(zero_copy_only=False)
    for i, text in enumerate(texts(batch)):
        found = text.split()
        if not marked[i]:
            yield found, None
            continue
        c = spans[i].values
        a, b, start = (np.asarray(c.field(n)) for n in ("a", "b", "from"))
        there = np.stack([np.asarray(c.field("f_after").field(n)).view(np.uint64) - np.asarray(c.field("f_before").field(n)).view(np.uint64) for n in ("one", "two")])
        _, inverse = powers(int(start.max()) + 1)
        sums = _fingerprints(Words([text], 1), Words([text], 2), 0)
        true = (there * inverse[start] == _between(sums, a, b)).all(0)
        gone = np.zeros(len(found) + 1, np.int64)
        np.add.at(gone, a[true], 1)
        np.add.at(gone, b[true], -1)
        yield found, np.cumsum(gone[:-1]) == 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for found, stays in _kept(batch):
                left = found if stays is None else list(compress(found, stays.tolist()))
                rows.append((len(found), len(found) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True))])

    dealt = _numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    rows = dealt.join(removals(dealt, window), RID, "left").select("__rest.doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"))


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns; a text that loses words has the others left, with one space between them.

    A null text stays null; ``n_chars``, where there is one, is the new text's.
    """
    dealt = _numbered(docs)
    rows = dealt.join(removals(dealt, window), RID, "left").drop(RID, "doc")
    kind = rows.drop("spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            new = batch.column("text").to_pylist()
            for i, (found, stays) in enumerate(_kept(batch)):
                if stays is not None and not stays.all():
                    new[i] = b" ".join(compress(found, stays.tolist())).decode()
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else batch.column(n) for n in kind.names], names=kind.names)

    changed = {"n_chars": F.when(~F.col("__null"), F.length("text"))} if "n_chars" in docs.columns else {}
    return restored(rows.mapInArrow(run, kind), docs, **changed)


#: What ``digests`` returns, by every window of every text, for DuckDB.
SQL = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 windows AS (SELECT r, d, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, d, w, unnest(range(1, len(w) - 11)) AS i FROM texts WHERE len(w) >= 13)),
 first AS (SELECT s, min(d) AS m FROM windows GROUP BY s HAVING min(d) < max(d)),
 gone AS (SELECT DISTINCT r, i + j AS p FROM windows JOIN first USING (s), range(0, 13) t(j) WHERE m < d),
 words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM texts),
 kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""
