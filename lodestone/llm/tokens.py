"""Token ids of whole texts by a tokenizer file, chunk by chunk with a bounded memo.

The tokenizer's rules never look across ASCII white space (lower-casing, NFC and the word
pattern all stop there), so the ids of a text are those of its white-space-separated chunks
in a row. Known chunks come from the memo. New ones of letters alone go to the library many to
a line and are told apart by the tokens that end a word; a new chunk of letters before marks
is the ids of both; all others go to the library one by one. A text that holds a special
token's string, in whatever case, goes to the library whole and as it is. A-Z are lower-cased first unless a combining mark
(U+0300 to U+036F) is near, which could compose with one case only.
"""

from __future__ import annotations

import os

import numpy as np

#: Words on a line for the library.
LINE = 256
#: Chunks kept by one worker; the memo starts anew when it is full.
MEMO_CHUNKS = 1_000_000
END_ID = 2
MARKS = b".,;:!?%$&*#|"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, most: int = MEMO_CHUNKS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many to a line; one by one where a line's word ends don't match."""
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        out: list[bytes] = []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(line) or cuts[-1] != 4 * len(ids):
                out += self._whole([w.encode() for w in line])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _learn(self, new: set[bytes]) -> None:
        memo = self.memo
        plain: dict[bytes, str] = {}
        marked, rest = [], []
        for chunk in new:
            head = chunk.rstrip(MARKS)
            word = head.decode()
            if not word.isalpha():
                rest.append(chunk)
                continue
            if len(head) < len(chunk):
                marked.append((chunk, head, chunk[len(head) :]))
            if head not in memo:
                plain[head] = word
        rest += {tail for *_, tail in marked}.difference(memo, rest)
        memo.update(zip(plain, self._letters(list(plain.values())), strict=True))
        memo.update(zip(rest, self._whole(rest), strict=True))
        memo.update((chunk, memo[head] + memo[tail]) for chunk, head, tail in marked)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if b"<|" in t and any(s in t.lower() for s in self.special)}
        chunks = [[] if i in odd else (t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for i, t in enumerate(texts)]
        new = set().union(*chunks).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set().union(*chunks)
        if new:
            self._learn(new)
        get = self.memo.__getitem__
        out = [b"".join(map(get, c)) for c in chunks]
        for i in odd:
            out[i] = self._whole([texts[i]])[0]
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, most: int = MEMO_CHUNKS) -> ChunkEncoder:
    """This worker's encoder of a file, kept between tasks, with a memo of at most so many chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
