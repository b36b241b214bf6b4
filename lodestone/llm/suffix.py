"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

``suffix_array`` types the suffixes, sorts the leftmost-smaller (LMS) substrings by one induced
pass, names them, solves the string of names by recursion where names repeat, and induces the
order of all suffixes from that of the LMS suffixes. A bucket of equal first characters is one
array step (and one more for each character of a run), so the work is linear in the text. Names
of the recursion are written as two digits, which keeps the number of buckets near the root of
the number of names; it ends where all names differ. Positions are 32-bit: a text must be
shorter than 2^31.

``common_prefixes`` computes the permuted array: the common prefix of each suffix, in text order,
with the suffix before it in the array. Only irreducible entries (those whose preceding
characters differ) are compared, eight bytes at a time; the others follow by subtraction.
"""

from __future__ import annotations

import numpy as np



def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    step = text[1:].astype(np.int32) - text[:-1]
    known = np.append(step != 0, True)
    at = np.arange(len(text), dtype=np.int32)
    nearest = np.minimum.accumulate(np.where(known, at, np.int32(len(text)))[::-1])[::-1]
    return np.append(step > 0, True)[nearest]


class _Buckets:
    """The suffix array under construction, its buckets, and the order's two induced scans."""

    def __init__(self, text: np.ndarray):
        self.text = text
        self.small = _types(text)
        self.count = np.bincount(text)
        self.chars = np.flatnonzero(self.count)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        # whether the suffix one before each is larger, or smaller, than its next; neither at the start
        self.larger_before = np.append(False, ~self.small[:-1])
        self.smaller_before = np.append(False, self.small[:-1])
        self.lms = np.flatnonzero(self.small & self.larger_before).astype(np.int32)
        # characters that stand twice in a row, by the type of the first
        twice = text[1:] == text[:-1]
        self.larger_runs = np.bincount(text[1:][twice & self.larger_before[1:]], minlength=len(self.count)) > 0
        self.smaller_runs = np.bincount(text[1:][twice & self.smaller_before[1:]], minlength=len(self.count)) > 0

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, given the LMS suffixes in order (or in any order, to sort LMS substrings)."""
        text, larger_before, smaller_before = self.text, self.larger_before, self.smaller_before
        out, steps, buckets = np.full(len(text), -1, np.int32), np.arange(len(text), dtype=np.int32), len(self.count)
        first = text[lms]
        order = np.argsort(first, kind="stable")
        sown = np.split(lms[order], np.cumsum(np.bincount(first, minlength=buckets))[:-1])
        head, tail = self.start.copy(), self.end.copy()

        def larger(source: np.ndarray) -> None:
            """Places the suffixes one before ``source`` that are larger than their next, from the heads of their buckets."""
            prior = source[larger_before[source]] - 1
            if not len(prior):
                return
            first = text[prior]
            n = np.bincount(first, minlength=buckets)
            out[np.repeat(head - n.cumsum() + n, n) + steps[: len(prior)]] = prior[first.argsort(kind="stable")]
            np.add(head, n, out=head)

        def smaller(source: np.ndarray) -> None:
            """Places those that are smaller, from the tails."""
            prior = source[smaller_before[source]] - 1
            if not len(prior):
                return
            first = text[prior]
            n = np.bincount(first, minlength=buckets)
            out[np.repeat(tail - 1 + n.cumsum() - n, n) - steps[: len(prior)]] = prior[first.argsort(kind="stable")]
            np.subtract(tail, n, out=tail)

        chars, start, end = self.chars.tolist(), self.start.tolist(), self.end.tolist()
        larger_runs, smaller_runs = self.larger_runs.tolist(), self.smaller_runs.tolist()
        for c in chars:
            done = start[c]
            while larger_runs[c] and done < head[c]:
                part = out[done : head[c]]
                done = int(head[c])
                larger(part)
            larger(np.concatenate((out[done : head[c]], sown[c])))
        larger_end = head.tolist()
        for c in chars[::-1]:
            done = end[c]
            while smaller_runs[c] and done > tail[c]:
                part = out[tail[c] : done][::-1]
                done = int(tail[c])
                smaller(part)
            smaller(np.concatenate((out[tail[c] : done][::-1], out[start[c] : larger_end[c]][::-1])))
        out[0] = len(text) - 1  # the end of the text is smaller than anything
        return out


def _same_substring(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    same = size_a == size_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        differ = text[a[live] + k] != text[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ]
        live = live[size_a[live] > k]
    return same


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose last entry is 0 and all others are larger."""
    if len(text) == 1:
        return np.zeros(1, np.int32)
    buckets = _Buckets(text)
    lms = buckets.lms
    order = buckets.induce(lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    size = np.ones(len(text), np.int32)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    new = np.append(True, ~_same_substring(text, ranked[1:], ranked[:-1], size[ranked[1:]], size[ranked[:-1]]))
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(lms):
        of = np.zeros(len(text), np.int32)
        of[ranked] = name
        names = of[lms]
        top = int(name[-1]) + 1
        del of, order, size
        if top <= 512:
            ranked = lms[suffix_array(names.astype(np.uint16))]
        else:
            base = int(np.ceil(np.sqrt(top)))
            pairs = np.stack((names // base + 1, names % base + 1), 1).ravel()
            deeper = suffix_array(np.append(pairs, 0).astype(np.uint16))
            deeper = deeper[1:]
            ranked = lms[deeper[deeper % 2 == 0] // 2]
    return buckets.induce(ranked)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in text order, its common prefix with the suffix before it in the array (0 for the first); ``text`` is bytes."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    eight = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(16, np.uint8)), 8)
    at = np.arange(n, dtype=np.int32)
    irreducible = np.append(True, text[:-1] != text[before[1:] - 1]) | (before <= 0)
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(irreducible & (before >= 0))
    reach = np.zeros(len(live), np.int32)
    a, b, slot = live, before[live], np.arange(len(live))
    done = 0
    while len(a):
        gap = (eight[np.minimum(a + done, n)] ^ eight[np.minimum(b + done, n)]).view("<u8").ravel()
        ends = gap != 0
        low = gap[ends] & (~gap[ends] + np.uint64(1))
        reach[slot[ends]] = done + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        a, b, slot = a[~ends], b[~ends], slot[~ends]
        done += 8
    out[live] = reach
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(out[last] - (at - last), 0)
