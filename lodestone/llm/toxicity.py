"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and the first 4 letters of longer words, lower-cased. All terms of a bounded,
class-stratified sample of labelled rows count, by TF-IDF times how far the share of toxic rows
among those with the term (``PRIOR`` rows of the sample's share added) is from the sample's
share, which doesn't depend on the sample's size; examples are vectors of unit length over them.
The examples form an inverted index over blocks of ``BLOCK`` consecutive ones, with the largest
weight of each term in each block. Postings of the ``COLUMNS`` most frequent terms are kept as
columns of their blocks, those of all others as lists. A query's lists and the block maxima bound
each block; the ``FIRST`` most promising blocks are scored, and then only those whose bound
reaches the k-th best, for ``BATCH`` queries at a time. The best are scored again in double
precision over all their terms: the k nearest examples are exact. Neighbours vote with
their cosine squared, weighted back to the classes' true shares; the vote is calibrated by a
monotone table (pool adjacent violators) of leave-one-out votes of the examples. The evidence is
the ids and cosines of the nearest examples. (Weights and terms were chosen by cross-validation
inside the rows that are learned from.)

The index is bounded (``SAMPLE`` rows) and broadcast; every text is scored whole.

Defined results: a text without a known term (null, empty) scores the calibrated share of
toxic rows among examples without one; ties between cosines go to the smaller example id;
labels of null ids or null values are not learned from; repeated rows are scored as often as
they come and learned from once; other columns are ignored; an empty table gives an empty result; without labels of
both classes the score is 0.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, record, slices

#: Labelled rows of each class in the index, at most; rows added to a term's own.
SAMPLE = {1: 1500, 0: 3000}
PRIOR = 4.0
BLOCK = 32
#: Terms whose postings are columns; blocks of a query that are scored at once; queries at a time.
COLUMNS, FIRST, BATCH = 512, 16, 128
#: Room for the rounding of 32-bit sums.
SLACK = 1e-5
NEIGHBOURS = 15
THRESHOLD = 0.3
MEMO = 400_000

_WORD = re.compile(r"\w+")
Row = tuple[np.ndarray, np.ndarray]


def chunk_terms(chunk: str) -> list[str]:
    """Terms of a run without white space: words, and the first four letters of longer words."""
    out = []
    for w in _WORD.findall(chunk):
        out.append(w)
        if len(w) > 4:
            out.append(f"{w[:4]}*")
    return out


class Terms:
    """Known terms of texts by number, chunk by chunk with a bounded memo."""

    def __init__(self, number: dict[str, int]):
        self.number, self.memo = number, {}

    def count(self, text: str) -> Row:
        """The known terms of a text and how often each stands in it."""
        memo, chunks = self.memo, text.lower().split()
        if len(memo) > MEMO:
            memo.clear()
        number = self.number
        for c in set(chunks).difference(memo):
            memo[c] = tuple(number[t] for t in chunk_terms(c) if t in number)
        return np.unique(np.fromiter(itertools.chain.from_iterable(map(memo.__getitem__, chunks)), np.int64), return_counts=True)


class Index:
    """Inverted index of unit TF-IDF examples with block maxima."""

    def __init__(self, number: dict[str, int], idf: np.ndarray, ids: np.ndarray, label: np.ndarray, rows: list[Row], vote: dict[int, float]):
        self.number, self.idf, self.ids, self.label = number, idf, ids, label
        self.vote = np.array([vote[int(y)] for y in label])
        n, t = len(ids), len(number)
        self.blocks = max(1, -(-n // BLOCK))
        # by example
        self.rows = np.cumsum([0, *(len(term) for term, _ in rows)])
        self.term = np.concatenate([term for term, _ in rows]).astype(np.int32)
        self.of_row = np.concatenate([self.unit(r) for r in rows])
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.rows))
        # columns of the most frequent terms by block, and their maxima
        seen = np.bincount(self.term, minlength=t)
        often = np.argsort(-seen, kind="stable")[:COLUMNS]
        self.column = np.full(t, -1, np.int32)
        self.column[often] = np.arange(len(often))
        dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        held = self.column[self.term] >= 0
        dense[owner[held], self.column[self.term[held]]] = self.of_row[held]
        self.dense = dense.reshape(self.blocks, BLOCK, len(often))
        self.most = self.dense.max(1)
        # lists of the others
        order = np.flatnonzero(~held)
        order = order[np.argsort(self.term[order], kind="stable")]
        self.owner, self.weight = owner[order], self.of_row[order].astype(np.float32)
        self.begin = np.searchsorted(self.term[order], np.arange(t + 1))
        self.asked, self.steps = np.zeros(t), np.arange(n * 64, dtype=np.int32)
        self.scored = self.bounded = 0
        self.cuts, self.values = np.zeros(0), np.zeros(1)

    def unit(self, row: Row) -> np.ndarray:
        """TF-IDF weights of unit length."""
        term, n = row
        w = (1 + np.log(n)) * self.idf[term]
        return w / math.sqrt(float(w @ w)) if w.any() else w

    def _ranges(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places of ranges, one after the other."""
        ends = n.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        if total > len(self.steps):
            self.steps = np.arange(2 * total, dtype=np.int32)
        return np.repeat((start - ends + n).astype(np.int32), n) + self.steps[:total]

    def _whole(self, found: np.ndarray, term: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The cosines of some examples, each over all its terms."""
        self.asked[term] = q
        n = self.rows[found + 1] - self.rows[found]
        at = self._ranges(self.rows[found], n)
        part = np.cumsum(np.append(0.0, self.of_row[at] * self.asked[self.term[at]]))
        self.asked[term] = 0
        ends = n.cumsum()
        return part[ends] - part[ends - n]

    def nearest(self, rows: list[Row], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine (over 0), best first, and the cosines; without: an example for each to leave out."""
        size, wide = self.blocks * BLOCK, self.dense.shape[2]
        listed, asked = np.zeros((len(rows), size), np.float32), np.zeros((len(rows), wide), np.float32)
        units = [self.unit(r) for r in rows]
        for i, ((term, _), q) in enumerate(zip(rows, units, strict=True)):
            column = self.column[term]
            held = column >= 0
            asked[i, column[held]] = q[held]
            rare = term[~held]
            start = self.begin[rare]
            n = self.begin[rare + 1] - start
            place = self._ranges(start, n)
            listed[i] = np.bincount(self.owner[place], weights=self.weight[place] * np.repeat(q[~held].astype(np.float32), n), minlength=size)
            if without is not None:
                listed[i, without[i]] = -9.0
        bound = asked @ self.most.T + listed.reshape(len(rows), self.blocks, BLOCK).max(2)
        total = np.full((len(rows), size), -1.0, np.float32)

        def score(blocks: np.ndarray) -> np.ndarray:
            """Scores the chosen blocks of each query; the k-th best of each so far."""
            for b in np.flatnonzero(blocks.any(0)).tolist():
                at, span = np.flatnonzero(blocks[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                total[at, span] = listed[at, span] + asked[at] @ self.dense[b].T
            return np.partition(total, size - k, axis=1)[:, size - k] if size > k else np.full(len(rows), -1.0)

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        least = score(first)
        rest = ~first & (bound >= least[:, None] - SLACK)
        least = score(rest)
        self.scored += int(first.sum() + rest.sum())
        self.bounded += bound.size
        out = []
        for i, ((term, _), q) in enumerate(zip(rows, units, strict=True)):
            found = np.flatnonzero(total[i] >= max(least[i] - SLACK, 1e-7))
            cosine = self._whole(found, term, q)
            found, cosine = found[cosine > 1e-12], cosine[cosine > 1e-12]
            best = np.lexsort((self.ids[found], -np.round(cosine, 12)))[:k]
            out.append((found[best], cosine[best]))
        return out

    def votes(self, best: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**2 * self.vote[best]
        return float(w @ self.label[best] / w.sum()) if w.any() else -1.0

    def calibrate(self, raw: np.ndarray) -> None:
        """Pools raw votes of the examples until the share of the label rises with the vote."""
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for i in order:
            blocks.append([self.vote[i] * self.label[i], self.vote[i], raw[i]])
            while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
                a, b, c = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, c]
        self.cuts = np.array([b[2] for b in blocks])
        self.values = np.array([b[0] / b[1] for b in blocks])

    def score(self, raw: float) -> float:
        return float(self.values[min(np.searchsorted(self.cuts, raw), len(self.values) - 1)]) if len(self.cuts) else 0.0


def fit(sample: list[tuple[int, int, str]], share: dict[int, float]) -> Index | None:
    """An index of (doc_id, label, text) rows; share: the true number of rows that each sampled row of a class stands for."""
    sample = sorted(set(sample))
    size = Counter(y for _, y, _ in sample)
    if len(size) < 2:
        return None
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for _, y, text in sample:
        chunks = set(text.lower().split())
        seen[y].update({t for c in chunks for t in chunk_terms(c)})
    n, base = len(sample), size[1] / len(sample)
    number = {t: i for i, t in enumerate(sorted(seen[0] | seen[1]))}
    toxic, clean = (np.fromiter((seen[y][t] for t in number), float, len(number)) for y in (1, 0))
    lean = (toxic + PRIOR * base) / (toxic + clean + PRIOR) - base
    idf = np.log(1 + n / (toxic + clean)) * np.abs(lean)
    seen.clear()
    counter = Terms(number)
    rows = [counter.count(text) for _, _, text in sample]
    index = Index(number, idf, np.array([i for i, _, _ in sample]), np.array([float(y) for _, y, _ in sample]), rows, share)
    raw = [index.votes(*found) for a in range(0, len(rows), BATCH) for found in index.nearest(rows[a : a + BATCH], without=list(range(a, min(a + BATCH, len(rows)))))]
    index.calibrate(np.array(raw))
    return index


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = None, sample: dict[int, int] | None = None) -> Index | None:
    """The index of a bounded sample of the labelled rows; fold (n, r): rows with crc32(doc_id) mod n = r are left out."""
    sample = sample or SAMPLE
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("y"))
    if fold:
        known = known.where(crc_mod("doc_id", fold[0]) != fold[1])
    rows, share = labelled_sample(docs, known, sample)
    return fit(rows, share)


def score(docs: DataFrame, index: Index | None, threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence) for each row; evidence: the nearest examples with their label and cosine."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        counter, none = Terms(index.number if index else {}), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            different, known = list(dict.fromkeys(texts)), {}
            for a in range(0, len(different), BATCH):
                part = different[a : a + BATCH]
                for text, (best, cosine) in zip(part, index.nearest([counter.count(t) for t in part]) if index else [(none, none)] * len(part), strict=True):
                    value = index.score(index.votes(best, cosine)) if index else 0.0
                    known[text] = value, int(value >= threshold), [{"doc_id": int(index.ids[b]), "toxic": int(index.label[b]), "cosine": float(c)} for b, c in zip(best[:evidence], cosine[:evidence], strict=True)]
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*[known[t] for t in texts], strict=True))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence); labels of the held-out fold (crc32(doc_id) mod 4 = 2) are not seen."""
    found = score(docs, learn(docs, labels, fold=(4, 2)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "evidence")
