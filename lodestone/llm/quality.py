"""Quality rules: exact text statistics and a calibrated n-gram classifier.

The base statistics follow the words of a text (runs of anything but ASCII white space). The
verdict is logistic regression over hashed word and character n-grams: words, word pairs and
byte n-grams of 3 and 4 bytes, each family as shares of its total, so that a score is a mean of
weights and long texts need no cut. It is fitted by gradient steps on labelled quality rows and
Platt-calibrated on a held-out part of them, then applied in Arrow batches with a fixed
threshold.

The model is fitted on a bounded sample, ``SAMPLE`` labelled rows of each class at most, by hash
over all of them. Every text is scored whole.

Defined results: null text has no word, so ``base_failed``; repeated rows are scored as often as
they come; other columns are ignored; an empty table gives an empty result; without labels of
both classes the probability is 1 and the base rules decide alone. A document with several
labels counts once for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, record, slices, texts

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 1500
BITS = 16
THRESHOLD = 0.5
MIN_WORDS = 50
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_STARTS = bytes(range(0x80, 0xC0))
_MIX = np.uint32(2_654_435_761)
FAMILIES = 4


def _repeats(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 3:
        return 0
    base = int(ids.max()) + 1
    pair = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:  # three numbers don't fit 63 bits: the pairs get numbers first
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * base + ids[2:]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[inverse] >= 2
    if not twice.any():
        return 0
    word = np.zeros(len(ids), bool)
    for i in range(3):
        word[i : len(ids) - 2 + i] |= twice
    return int(word.sum())


def statistics(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a text; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).translate(None, _NOT_STARTS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    return words, (len(words), chars, len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeats(ids))


class Hasher:
    """Feature numbers of texts: word ids by a bounded memo, byte n-grams by shifts."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = zlib.crc32(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint32, len(words))

    def features(self, text: bytes, words: list[bytes]) -> list[np.ndarray]:
        """Hashed features of each family, already in the family's own part of the weights."""
        shift = np.uint32(32 - BITS)
        w = self.words(words)
        raw = np.frombuffer(text, np.uint8).astype(np.uint32)
        three = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) if len(raw) > 2 else raw[:0]
        four = three[:-1] << np.uint32(8) | raw[3:] if len(raw) > 3 else raw[:0]
        pair = (w[:-1] * np.uint32(31) ^ w[1:]) if len(w) > 1 else w[:0]
        return [((x * _MIX) >> shift).astype(np.int64) + (i << BITS) for i, x in enumerate((w, pair, three, four))]


class Model:
    def __init__(self, weights: np.ndarray, scale: float, bias: float):
        self.weights, self.scale, self.bias = weights, scale, bias

    def margin(self, features: list[np.ndarray]) -> float:
        return sum(float(self.weights[f].mean()) for f in features if len(f))

    def probability(self, features: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(features) + self.bias, -40, 40))))


def fit(sample: list[tuple[int, bytes]], rounds: int = 60) -> Model | None:
    """Logistic regression on (label, text) rows; a fifth of them calibrates the margins."""
    sample = sorted(set(sample), key=lambda r: (zlib.crc32(r[1]), r))
    if len({y for y, _ in sample}) < 2:
        return None
    hasher = Hasher()
    columns, shares, counts = [], [], []
    for _, text in sample:
        found, share = [], []
        for f in hasher.features(text, text.split()):
            column, n = np.unique(f, return_counts=True)
            found.append(column.astype(np.int32))
            share.append((n / max(len(f), 1)).astype(np.float32))
        columns.append(np.concatenate(found))
        shares.append(np.concatenate(share))
        counts.append(len(columns[-1]))
    column, share, starts = np.concatenate(columns), np.concatenate(shares), np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(sample)), counts)
    label = np.array([y for y, _ in sample], float)
    learn = np.arange(len(sample)) % 5 != 0
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) * len(label)
    size = FAMILIES << BITS
    w, squares, bias = np.zeros(size), np.full(size, 1e-8), 0.0
    for _ in range(rounds):
        margin = np.add.reduceat(w[column] * share, starts) + bias
        slope = np.where(learn, weight * (1 / (1 + np.exp(-margin)) - label), 0)
        step = np.bincount(column, weights=slope[owner] * share, minlength=size)
        squares += step * step
        w -= 0.5 * step / np.sqrt(squares)
        bias -= 0.5 * slope.mean()
    margin = np.add.reduceat(w[column] * share, starts)
    a, b = 1.0, bias
    test = ~learn if len({*label[~learn]}) == 2 else learn
    for _ in range(400):  # Platt's two parameters, smoothed targets
        p = 1 / (1 + np.exp(-np.clip(a * margin[test] + b, -40, 40)))
        gap = weight[test] * (p - np.where(label[test] == 1, 0.99, 0.01))
        a, b = a - 0.2 * (gap * margin[test]).mean(), b - 0.2 * gap.mean()
    return Model(w.astype(np.float32), float(a), float(b))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    rows, _ = labelled_sample(docs.where("text is not null"), known, {0: sample, 1: sample})
    return fit([(y, text.encode()) for _, y, text in rows])


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics, probability and verdict for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher()
        for batch in slices(batches, "text"):
            rows = []
            for text in texts(batch):
                words, found = statistics(text)
                failed = found[0] < MIN_WORDS or 100 * found[4] > 50 * found[0]
                p = 1.0 if model is None else model.probability(hasher.features(text, words))
                rows.append((*found, failed, not failed and p >= threshold, p))
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True))])

    kind = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(docs, labels))


#: The statistics and base rules alone, for DuckDB.
BASE_SQL = r"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
 grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) > 2)),
 again AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM worded LEFT JOIN again USING (r)"""
