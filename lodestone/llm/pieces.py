"""Unigram encoding and decoding with a vocabulary of pieces.

A text is a run of pieces, and the run with the largest sum of log scores wins (Viterbi). The
pieces are in a double-array trie, two integer arrays in which the child of a node by a byte is
one addition and one comparison away. Blanks are markers; one marker is put before a text that
isn't empty. A character that is no piece falls back to its UTF-8 bytes at the smallest log
score less ``UNKNOWN``, and decoding puts bytes together, turns markers into blanks and drops
the first.

No piece holds a blank after another character, or a line feed, so a text is cut before each
run of blanks and around line feeds and the parts are encoded on their own, with a bounded memo.
(A vocabulary for which that doesn't hold is encoded whole.)

The log scores of a unigram file are used as they are. A file of merge ranks, whose scores are
minus the rank, gets Zipf-Mandelbrot log probabilities of the ranks, -ln(Z (rank + 2.7)).

Defined results: null and empty texts have no piece; a marker character in a text is read as a
blank, which is the one case where decoding differs from the text; equal sums go to the longest
last piece; repeated rows are encoded as often as they come; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, slices, texts

MARKER = "▁".encode()
UNKNOWN = 10.0
MEMO = 500_000
#: A text that every normaliser but the identity would change.
PROBE = "  a  \uff21 \ufb01\u00bd e\u0301\tb "
_PARTS = re.compile(rb" *[^ \n]+|\n| +")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """A trie as two arrays: the child of node s by byte c is base[s] + c + 1 if check of it is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.base, self.check, self.value = [0], [0], [-1]
        self._taken = bytearray(1)
        self._from = 0
        work = [(0, 0, len(keys), 0)]
        while work:
            node, a, b, depth = work.pop()
            if len(keys[order[a]]) == depth if a < b else False:
                self.value[node] = values[order[a]]
                a += 1
            if a == b:
                continue
            cuts, last = [], -1
            for i in range(a, b):
                c = keys[order[i]][depth]
                if c != last:
                    cuts.append((c, i))
                    last = c
            base = self._place([c for c, _ in cuts])
            self.base[node] = base
            for (c, i), (_, j) in zip(cuts, [*cuts[1:], (0, b)], strict=True):
                child = base + c + 1
                self.check[child] = node
                work.append((child, i, j, depth + 1))
        del self._taken
        self.check[0] = -1

    def _place(self, bytes_: list[int]) -> int:
        """The first base from a moving start whose slots are free; the start moves on past crowded stretches."""
        taken, tried, base = self._taken, 0, self._from
        low, high = bytes_[0] + 1, bytes_[-1] + 1
        while True:
            if base + high >= len(taken):
                taken.extend(bytes(base + 1024 - len(taken) + high))
            if not taken[base + low] and not any(taken[base + c + 1] for c in bytes_):
                break
            base += 1
            tried += 1
            if tried > 64:
                self._from = base - 32
                tried = 0
        grow = base + 257 - len(self.base)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-1] * grow
            self.value += [-1] * grow
        for c in bytes_:
            taken[base + c + 1] = 1
        return base

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that starts at ``at``, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for i in range(at, len(text)):
            child = base[node] + text[i] + 1
            if child >= len(check) or check[child] != node:
                return
            node = child
            if value[node] >= 0:
                yield i + 1, value[node]


class Vocabulary:
    """Pieces with log scores, their trie, and the byte pieces."""

    def __init__(self, pieces: list[bytes], scores: list[float], of_bytes: list[int], ids: list[int]):
        """``pieces`` and ``scores`` by id; ``ids``: the pieces that texts can hold; of_bytes: ids of the 256 bytes."""
        self.pieces = [p.replace(MARKER, b" ") for p in pieces]
        self.scores, self.of_bytes = scores, of_bytes
        self.least = min(scores[i] for i in ids) - UNKNOWN
        self.trie = DoubleArray([self.pieces[i] for i in ids], ids)
        for i, b in enumerate(of_bytes):
            self.pieces[b] = bytes([i])
        self.parted = not any(b" " in self.pieces[i].lstrip(b" ") or b"\n" in self.pieces[i] for i in ids)
        self.memo: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != f"▁{PROBE}".replace(" ", "▁"):
            raise ValueError("the model changes texts before it encodes them: only models without normalisation are supported")
        n = model.get_piece_size()
        ids = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        raw = [model.get_score(i) for i in range(n)]
        if all(s == int(s) for s in raw):
            order = {i: r for r, i in enumerate(ids)}
            z = sum(1 / (r + 2.7) for r in range(len(ids)))
            raw = [-math.log(z * (order[i] + 2.7)) if i in order else 0.0 for i in range(n)]
        return cls([model.id_to_piece(i).encode() for i in range(n)], raw, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], ids)

    def best(self, part: bytes) -> list[int]:
        """Ids of the best run of pieces for a part whose blanks are markers."""
        n, scores, least = len(part), self.scores, self.least
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        top, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        top[0] = 0.0
        at = 0
        while at < n:
            head = part[at]
            step = at + (1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4)
            here, single, node, end = top[at], False, 0, at
            while end < n:  # the trie's prefixes, shortest first
                child = base[node] + part[end] + 1
                if check[child] != node:
                    break
                node = child
                end += 1
                i = value[node]
                if i >= 0:
                    total = here + scores[i]
                    if total > top[end]:
                        top[end], back[end] = total, (at, i)
                    if end == step:
                        single = True
            if not single and here + least > top[step]:
                top[step], back[step] = here + least, (at, -1)
            at = step
        out: list[int] = []
        while n:
            at, i = back[n]
            out += [i] if i >= 0 else [self.of_bytes[b] for b in reversed(part[at:n])]
            n = at
        return out[::-1]

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        text = b" " + text.replace(MARKER, b" ")
        parts = _PARTS.findall(text) if self.parted else [text]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for p in set(parts).difference(memo):
            memo[p] = np.array(self.best(p), "<u4").tobytes()
        return b"".join(map(memo.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; broken byte runs become replacement characters."""
        raw = b"".join(map(self.pieces.__getitem__, ids.tolist()))[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This worker's vocabulary of a file, kept between tasks."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.load(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row's whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(words.encode(t), "<i4") for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            found = [words.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_sha256, exact) of each whole text, encoded and decoded again."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        byte = np.zeros(len(words.pieces), bool)
        byte[words.of_bytes] = True
        for batch in slices(batches, "text"):
            rows = []
            for text in texts(batch):
                raw = words.encode(text)
                ids = np.frombuffer(raw, "<u4")
                back = words.decode(ids)
                rows.append((len(ids), int(byte[ids].sum()), zlib.crc32(raw), hashlib.sha256(back).hexdigest(), back == text))
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True))])

    kind = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
