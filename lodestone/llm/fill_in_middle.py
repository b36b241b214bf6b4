"""Fill-in-the-middle rearrangement of texts by ropes, and its inverse.

A text is cut into units: a word with the white space before it, and white space at the end.
Its rope is a binary tree whose leaves hold some units each and cache their unit and code-point
counts, and whose inner nodes cache the sums. Two unit ranks, drawn from the document's id, split
the tree into prefix, middle and suffix; the subtrees are joined anew between sentinel leaves.
The inverse takes nothing but the output and its form: it makes a rope of the output, splits it at
the code-point ranks of the sentinels and joins the parts in their first order.

A split walks one path down and shares all other subtrees; a document sees two splits and a few
joins, so a tree stays as deep as it was built, but for a constant. Rows are independent: nothing
is shuffled, and a task holds one slice of texts.

Defined results: null and empty texts are plain, with no unit; white space alone is one unit;
a text that holds a sentinel is plain; null ids draw as the empty id; repeated rows come out as
often as they come; other columns, whatever their names, are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, slices

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf.
LEAF = 128

_UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
_LEAF = re.compile(rf"(?>{_UNIT.pattern}){{1,{LEAF}}}+")


class Rope(NamedTuple):
    """A leaf (with text) or an inner node (with two children), and the counts below it."""

    units: int
    chars: int
    text: str | None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, "")


def join(*parts: Rope) -> Rope:
    """The parts in a row; empty ones add no node."""
    out = EMPTY
    for p in parts:
        if not p.chars:
            continue
        out = Rope(out.units + p.units, out.chars + p.chars, None, out, p) if out.chars else p
    return out


def rope(text: str) -> Rope:
    """The balanced rope of a text."""
    level = [Rope(LEAF, len(x), x) for x in _LEAF.findall(text)]
    if not level:
        return EMPTY
    level[-1] = _leaf(level[-1].text)
    while len(level) > 1:
        level = [join(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def _leaf(text: str) -> Rope:
    return Rope(len(_UNIT.findall(text)), len(text), text)


def split(tree: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first ``rank`` units (or chars) of a rope, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= getattr(tree, by):
        return tree, EMPTY
    if tree.text is None:
        first = getattr(tree.left, by)
        if rank <= first:
            a, b = split(tree.left, rank, by)
            return a, join(b, tree.right)
        a, b = split(tree.right, rank - first, by)
        return join(tree.left, a), b
    at = rank
    if by == "units":
        at = 0
        for _ in range(rank):
            at = _UNIT.match(tree.text, at).end()
    return _leaf(tree.text[:at]), _leaf(tree.text[at:])


def flat(tree: Rope) -> str:
    """The text of a rope."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if x.text is None:
            stack += (x.right, x.left)
        else:
            out.append(x.text)
    return "".join(out)


def _sentinel(text: str) -> Rope:
    return Rope(0, len(text), text)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit draws of a document: the first groups of the hex sha256 of ``seed:doc_id``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def rearrange(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    tree = rope(text)
    n = tree.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(tree, high)
    prefix, middle = split(head, low)
    p, s, m = map(_sentinel, (PREFIX, SUFFIX, MIDDLE))
    form = "spm" if h4 % 100 < spm else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, flat(out)


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` made an output from. Raises for a form or an output that it can't have made."""
    if form == "plain":
        return output
    first, second = {"spm": (SUFFIX, PREFIX), "psm": (PREFIX, SUFFIX)}[form]
    # a sentinel can't begin inside another, and texts with one are plain: the first place of each is its own
    b = output.index(second, len(first))
    c = output.index(MIDDLE, b + len(second))
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} begins with {first}")
    head, tail = split(rope(output), c, "chars")
    one, two = split(head, b, "chars")
    (_, one), (_, two), (_, middle) = split(one, len(first), "chars"), split(two, len(second), "chars"), split(tail, len(MIDDLE), "chars")
    return flat(join(two, middle, one) if form == "spm" else join(one, middle, two))


def rearranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of those with the suffix first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [rearrange(t or "", d, seed, rate, spm) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield record(schema, [batch.column("doc_id"), *map(list, zip(*made, strict=True))])

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` of ``rearranged`` with the column ``text``, made from ``output`` and ``form`` alone."""
    kind = rows.drop("text").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            made = [restore(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "text"])

    return rows.drop("text").mapInArrow(run, kind)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row."""
    rows = restored(rearranged(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


#: What ``digests`` returns, for DuckDB.
SQL = r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
 drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM texts),
 parts AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts"""
