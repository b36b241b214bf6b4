"""Fill-in-middle, resampling and word-graph removal against plain Python, on small tables and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SF, docs, listed, odd, rows  # noqa: F401

from lodestone.llm import debruijn, fill_in_middle, resampling
from lodestone.llm.common import table, written

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MORE = [(20, "<P> inside"), (21, " \t\n"), (22, "word"), (23, " lead and trail \n"), (24, "ä\u3000b \x0bc\x1fd"), (25, "a<S"), (26, "日本語 テキスト " * 300)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11 -------------------------------------------------------------------------------------
def plain_middle(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle(spark, docs, rows, odd):  # noqa: F811
    more = spark.createDataFrame(MORE + [(100 + i, t) for i in range(40) for _, t in MORE], "doc_id long, text string")
    for df, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD]), (more, MORE + [(100 + i, t) for i in range(40) for _, t in MORE])):
        assert listed(fill_in_middle.digests(df)) == sorted((plain_middle(*x) for x in texts), key=str)
    assert fill_in_middle.digests(docs.limit(0)).count() == 0
    assert {r.form for r in fill_in_middle.rearranged(docs).collect()} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("seed", range(20))
def test_ropes_split_anywhere(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "é", "日", " ", "\n", "bcd "]) for _ in range(r.choice([0, 1, 9, 4000])))
    tree, units = fill_in_middle.rope(text), UNIT.findall(text)
    assert (tree.units, tree.chars, fill_in_middle.flat(tree)) == (len(units), len(text), text)
    for _ in range(20):
        at = r.randint(0, len(units))
        a, b = fill_in_middle.split(tree, at)
        assert (fill_in_middle.flat(a), fill_in_middle.flat(b), a.units, b.units) == ("".join(units[:at]), "".join(units[at:]), at, len(units) - at)
        at = r.randint(0, len(text))
        a, b = fill_in_middle.split(tree, at, "chars")
        assert (fill_in_middle.flat(a), fill_in_middle.flat(b), a.chars) == (text[:at], text[at:], at)

    def depth(x):
        return 0 if x.text is not None else 1 + max(depth(x.left), depth(x.right))

    assert depth(tree) <= max(1, len(units)).bit_length()


def test_outputs_that_nothing_makes_are_refused():
    for output, form in (("abc", "spm"), ("<S>a<P>b", "spm"), ("<P>a<M>b<S>c", "psm")):
        with pytest.raises(ValueError):
            fill_in_middle.restore(output, form)


# op12 -------------------------------------------------------------------------------------
def plain_resampled(texts, target, percent=10, run=1, buckets=10_000, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda w: [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    ours, theirs = collections.Counter(), collections.Counter()
    for _, t in texts:
        ours.update(map(bucket, features(words(t))))
    for t in target:
        theirs.update(map(bucket, features(words(t))))
    s, t = sum(ours.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1.0) * (s + buckets) / ((ours[b] + 1.0) * (t + buckets))))
    out = []
    for place, (doc, text) in enumerate(texts):
        found = features(words(text))
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha(f"2024:{'' if doc is None else doc}")[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)), place])
    drawn = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[6]))
    for rank, x in enumerate(drawn[: percent * len(drawn) // 100]):
        x[4] = rank + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("run", [1, 2])
def test_resampling(spark, docs, rows, odd, run):  # noqa: F811
    goal = table(spark, SF, "benchmark")
    aims = [r.text for r in goal.collect()]
    for df, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD])):
        assert listed(resampling.resample(df, goal, run=run)) == plain_resampled(texts, aims, run=run)
        assert listed(resampling.resample(df, goal.limit(0), percent=60, least_words=1, run=run)) == plain_resampled(texts, [], 60, run, least=1)
    assert resampling.resample(docs.limit(0), goal).count() == 0


def test_many_alike_rows_are_ranked_once_each(spark):
    texts = [(7, "one two three " * 9)] * 600 + [(i, f"alpha beta {i} " * 9) for i in range(600)] + [(None, "x " * 30)] * 50
    got = resampling.resample(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), spark.createDataFrame([("one two",)], "text string"), percent=50).collect()
    ranked = sorted((r.rank, -r.score) for r in got if r.rank)
    assert [x for x, _ in ranked] == list(range(1, 626)) and [s for _, s in ranked] == sorted(s for _, s in ranked)
    assert sorted(-r.score for r in got)[:625] == [s for _, s in ranked]


def test_blocks_are_the_count_matrix(spark, docs, rows):  # noqa: F811
    blocks = written(resampling.matrix(docs), "blocks")
    sums = resampling.column_sums(blocks)
    want = collections.Counter(zlib.crc32(w) % 10_000 for _, t in rows for w in resampling.words_of((t or "").encode()))
    assert {int(b): int(sums[b]) for b in np.flatnonzero(sums)} == dict(want)
    for b in blocks.collect():
        assert b.start[-1] == len(b.bucket) == len(b["count"]) and len(b.start) == len(b.doc_id) + 1


def test_a_task_holds_few_bytes_of_the_matrix_at_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(300))) for i in range(2000)], "doc_id long, text string").coalesce(1)
    blocks = resampling.matrix(docs).select(F.size("doc_id").alias("n"), (4 * (F.size("bucket") + F.size("count"))).alias("bytes")).collect()
    assert sum(b.n for b in blocks) == 2000 and max(b.bytes for b in blocks) < 16 << 10  # 10,000 rows go to a worker at once
    long = spark.createDataFrame([(1, "a " * 9000), (2, "b"), (3, None)], "doc_id long, text string").coalesce(1)
    assert [(list(b.doc_id), list(b.start)) for b in resampling.matrix(long).collect()] == [([1], [0, 1]), ([2, 3], [0, 1, 1])]


# op13 -------------------------------------------------------------------------------------
def plain_words_kept(texts, n=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    order = [math.inf if d is None else d for d, _ in texts]
    least = {}
    for d, w in zip(order, words, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, math.inf), d)
    out = []
    for (doc, _), d, w in zip(texts, order, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 17, 300])
def test_word_graph(spark, docs, rows, odd, slice_bytes, monkeypatch):  # noqa: F811
    monkeypatch.setattr(debruijn, "SLICE", slice_bytes)
    for df, texts in ((docs, rows), (odd, [(r[0], r[1]) for r in ODD])):
        assert listed(debruijn.digests(df)) == plain_words_kept(texts)
    assert debruijn.digests(docs.limit(0)).count() == 0
    cleaned = debruijn.cleaned(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ODD)


@pytest.mark.parametrize("seed", range(2))
def test_word_graph_of_branching_passages(spark, seed):
    """Passages cut, spliced, repeated and periodic, in rows of alike and missing ids."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [r.choices(words, k=r.choice([14, 40, 200])) for _ in range(6)] + [["a"] * 60, ["a", "b", "c"] * 20]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(base)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts += r.choice([p, p[a:b], p[:b] + ["odd"] + p[b:]]) + r.choice([[], r.choices(words, k=5)])
        texts.append((r.choice([None, *range(60)]), r.choice([" ", "\n", " \t"]).join(parts)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert listed(debruijn.digests(df)) == plain_words_kept(texts)
    kept = {(x.doc_id, hashlib.sha256(" ".join((x.text or "").split()).encode()).hexdigest()) for x in debruijn.cleaned(df).collect()}
    assert kept == {(d, h) for d, *_, h in plain_words_kept(texts)}


def test_paths_end_where_edges_branch(spark):
    edges = [(1, 2, 7, 0, 1), (2, 3, 7, 1, 1), (3, 4, 7, 2, 1), (3, 5, 8, 3, 1), (4, 6, 7, 3, 4), (6, 9, 7, 9, 1)]
    got = debruijn.compacted(spark.createDataFrame(edges, "u long, v long, rid long, pos long, windows int"))
    assert {(r.u, r.v): r.path for r in got.collect()} == {(1, 2): 0, (2, 3): 0, (3, 4): 2, (3, 5): 3, (4, 6): 2, (6, 9): 9}


def test_spans_that_their_source_does_not_hold_stay(spark, monkeypatch):
    """If hashes of different words met, the fingerprints of the source's words would tell."""
    monkeypatch.setattr(debruijn, "_runs", lambda h, size: np.full(max(len(h) - size + 1, 0), 5, np.uint64))
    texts = [(1, " ".join(f"x{i}" for i in range(13))), (2, " ".join(f"y{i}" for i in range(13))), (3, " ".join(f"x{i}" for i in range(13)))]
    got = {r.doc_id: r.n_removed for r in debruijn.digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == 0 and got[2] == 0
