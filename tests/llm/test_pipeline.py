"""The corpus pipeline on small tables, stage by stage."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import near_copies, pii
from lodestone.llm.common import table, written
from lodestone.sources import scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, seen, SF), name)
        assert out.columns == columns and out.schema == docs.schema, name
        if name == "language":
            assert out.count() == seen.where("text rlike '\\\\p{L}'").count()
        if name == "repeated_passages":
            assert out.count() == seen.count()
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) for r in out.collect())
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count()


def test_odd_rows_and_empty_tables(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (None, None, None, None, None), (2, "", None, "x", 0), (3, "Zoë " * 9000, "fr", None, 1)]
    for df, kept in ((spark.createDataFrame(rows, schema), {1, 3}), (spark.createDataFrame([], schema), set())):
        for name, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, SF), name)
            if name == "near_duplicates":
                assert sorted(r.doc_id for r in df.collect()) == sorted(kept)
        pieces = df.collect()
        assert {r.doc_id for r in pieces} == kept and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
        assert {r.doc_id: r.doc_tokens for r in pieces} == {i: sum(r.length for r in pieces if r.doc_id == i) for i in kept}


def test_run_equals_its_stages_and_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """The rows of the stages one after another; of what was written on the way, the result alone is left."""
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    pieces = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length"), F.min("start")).collect()))
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = corpus_pipeline.run(spark, SF)
    assert pieces(got) == pieces(docs)
    assert [p.name.rpartition("-")[0] for p in (tmp_path / "lodestone").iterdir()] == ["pipeline-packing"]
    assert not spark.sql("show tables").where("tableName like 'lodestone%'").count()


def plain_groups(rows):
    """Components of all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y)):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


@pytest.mark.parametrize("common", [4, 1])
def test_near_copies_are_all_found(spark, common, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "SAMPLED", 8 if common > 1 else 1)
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=r.choice((3, 5, 9, 60, 300))))) for i in range(60)]
    for i in range(120):
        copy = r.choice(rows)[1].split()
        for _ in range(r.choice((0, 1, 2, 4, 6))):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((100 + i, " ".join(copy[r.choice((0, 0, 5)) if len(copy) > 9 else 0 :])))
    rows += [(900, ""), (901, None), (902, " \n"), (None, rows[70][1]), (7, rows[7][1])]
    least = {}
    for (i, _), g in zip(rows, plain_groups(rows), strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.one_of_each(spark, df, SF).collect()) == sorted(least.values())


def test_planted_near_copies_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(x) for x in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    kept = {x.doc_id for x in corpus_pipeline.one_of_each(spark, docs, SF).collect()}
    assert kept == {rows[g][0] for g in plain_groups(rows)} and len({643, 770} & kept) < 2
