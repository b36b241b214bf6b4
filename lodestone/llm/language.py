"""Language identification by string kernels.

The kernel of two texts is the blended spectrum kernel over presence: how many of the hashed
byte n-grams (n = 1 to 4, ASCII and Latin letters lower-cased) occur in both, over the root of
the product of how many occur in each. Landmark texts (Nystroem) stand for the kernel's
feature space, and one-versus-rest kernel ridge regression is solved there. A batch is scored
by two matrix products: presence rows by landmarks, kernel rows by weights.

Presence saturates as a text grows, so a text is cut into equal windows of ``WINDOW`` bytes at
most, which cover it whole (an n-gram belongs to the window it begins in); its kernel with a
landmark, the first window of a text, is the mean over its windows.

The model is fitted on a bounded sample, ``PER_LANGUAGE`` texts of each language at most, taken
by hash over all learnable rows; its size doesn't depend on the input. Every text is scored
whole.

Defined results: null text and text without a letter give ``und`` with score 0; rows with a
null lang are not learned from; repeated rows are scored as often as they come; other columns
are ignored; an empty table gives an empty result; without a row to learn from every text is
``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, expand, slices, texts, utf8

#: Most texts of a language that are learned from, and the landmarks among them.
PER_LANGUAGE, LANDMARKS = 240, 40
FEATURES = 8192
#: Bytes in a window at most, and windows held as presence rows at once.
WINDOW, WINDOWS = 8192, 512
ORDERS = (1, 2, 3, 4)
RIDGE, SHARPNESS = 1e-2, 4.0
UNKNOWN = "und"

_MIX = np.uint32(2_654_435_761)


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of texts begin and end (n + 1 places), and how many each text has."""
    size = np.diff(ends)
    counts = np.maximum(1, -(-size // WINDOW))
    own, nth = expand(counts)
    return np.append(ends[:-1][own] + size[own] * nth // counts[own], ends[-1]), counts


def presence(data: np.ndarray, ends: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """One float32 row for each text or window: 1 where an n-gram that begins in it hashes; after: where the text of each ends."""
    n = len(ends) - 1
    out = np.zeros((n, FEATURES), np.float32)
    after = ends[1:] if after is None else after
    most = max(ORDERS) - 1
    raw = data[ends[0] : min(ends[-1] + most, after[-1])] if n else data[:0]
    lower = raw | (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    led = np.append(ends[0] > 0 and data[ends[0] - 1] == 0xC3, raw[:-1] == 0xC3) if len(raw) else np.zeros(0, bool)
    lower |= (led & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)).view(np.uint8) << 5
    size = np.diff(ends)
    row = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, size)
    left = np.repeat(after - ends[0], size) - np.arange(len(row))
    code, flat = np.zeros(len(raw), np.uint32), out.ravel()
    wide = lower.astype(np.uint32)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    for order in range(1, max(ORDERS) + 1):
        step = wide[order - 1 :]
        code = (code[: len(step)] << np.uint32(8)) | step
        if order in ORDERS:
            m = min(len(step), len(row))
            at = row[:m] + (((code[:m] ^ np.uint32(order * 0x9E37)) * _MIX) >> shift)
            flat[at[left[:m] >= order]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(1), 1))[None]
        return (rows @ self.landmarks.T) / size

    def of_texts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kernel of each text with the landmarks: the mean over its windows."""
        at, counts = windows(ends)
        after = np.repeat(ends[1:], counts)
        out = np.zeros((len(counts), len(self.landmarks)))
        own = np.repeat(np.arange(len(counts)), counts)
        for a in range(0, len(own), WINDOWS):
            b = min(a + WINDOWS, len(own))
            np.add.at(out, own[a:b], self.kernel(presence(data, at[a : b + 1], after[a:b])))
        return (out / counts[:, None]).astype(np.float32)

    def probabilities(self, kernel: np.ndarray) -> np.ndarray:
        raw = SHARPNESS * (kernel @ self.weights + self.bias)
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(sample: list[tuple[str, bytes]]) -> Model:
    """One-versus-rest kernel ridge regression on (language, text) rows, through landmarks."""
    sample = sorted(sample)
    languages = sorted({x for x, _ in sample})
    ends = np.concatenate(([0], np.cumsum([len(t) for _, t in sample])))
    data = np.frombuffer(b"".join(t for _, t in sample), np.uint8)
    of = np.array([languages.index(x) for x, _ in sample])
    marks = np.concatenate([np.flatnonzero(of == i)[:LANDMARKS] for i in range(len(languages))])
    at, counts = windows(ends)
    first = np.cumsum(counts) - counts
    landmarks = np.concatenate([presence(data, at[first[i] : first[i] + 2], ends[i + 1 : i + 2]) for i in marks])
    model = Model(languages, landmarks, np.zeros(0), np.zeros(0))
    among = model.kernel(landmarks).astype(float)
    value, vector = np.linalg.eigh(among)
    some = value > 1e-6 * value.max()
    root = vector[:, some] / np.sqrt(value[some])
    phi = model.of_texts(data, ends).astype(float) @ root
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(of, minlength=len(languages))[of] * len(of) / len(languages)
    bias = (weight[:, None] * target).sum(0) / weight.sum()
    gram = phi.T @ (weight[:, None] * phi) + RIDGE * len(of) / 100 * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (weight[:, None] * (target - bias)))
    model.weights, model.bias = (root @ solved).astype(np.float32), bias.astype(np.float32)
    return model


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the rows outside the held-out fold, from a sample bounded for each language."""
    known = docs.where("lang is not null and text is not null and length(text) > 0").where(crc_mod("doc_id", 5) != 0)
    counts = known.groupBy("lang").agg(F.count("*").alias("of"))
    order = F.xxhash64("doc_id", "text")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.least(F.lit(1_000_000.0), 3e6 * per_language / F.col("of"))
    # one row a language, of which the model holds weights too
    thin = known.join(F.broadcast(counts), "lang").where(share).select("lang", "text", order.alias("h"))
    first = thin.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("nth") <= per_language)
    sample = [(r.lang, r.text.encode()) for r in first.select("lang", "text").collect()]
    return fit(sample) if sample else None


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def score(docs: DataFrame, model: Model | None, keep: str = "doc_id") -> DataFrame:
    """(kept column, lang_pred, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(keep).alias("kept"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            pred, sure = np.full(n, UNKNOWN, object), np.zeros(n)
            some = np.fromiter((has_letter(t) for t in texts(batch)), bool, n)
            if model is not None and some.any():
                p = model.probabilities(model.of_texts(*utf8(batch.column("text"))))
                best = p.argmax(1)
                pred[some] = np.array(model.languages, object)[best[some]]
                sure[some] = p[np.arange(n), best][some]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(pred, pa.string()), pa.array(sure)], names=["kept", "lang_pred", "score"])

    return rows.mapInArrow(run, kind).withColumnRenamed("kept", keep)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is told with some confidence; a null lang becomes the one told."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    found = score(docs.select(whole.alias("row"), "text"), model, keep="row")
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[lang if n == "lang" else F.col(f"row.`{n}`") for n in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); the rows whose crc32(doc_id) mod 5 is 0 are not learned from."""
    found = score(docs, learn(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
