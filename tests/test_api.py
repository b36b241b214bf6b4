"""Commands that refuse, and those whose answers are more than one frame."""

import pytest
from pyspark.sql import functions as F
from test_semantics import NOW, memory

from lodestone import api
from lodestone.operators import pages
from lodestone.operators.ranking import Query


def with_order(rows):
    return rows.withColumn("order", F.col("seq"))


def test_writes_refuse_leaks_and_gated_rows(spark):
    store = memory(spark, dict(id="a"), dict(id="p", status="pinned"))
    with pytest.raises(ValueError, match="home path"):
        api.memory_write(store, with_order(memory(spark, dict(id="b", title="see /home/ann/x"))), NOW)
    with pytest.raises(ValueError, match="review"):
        api.memory_write(store, with_order(memory(spark, dict(id="b"), dict(id="c", type="core"))), NOW)
    with pytest.raises(ValueError, match="review"):
        api.memory_write(store, with_order(memory(spark, dict(id="b", supersedes="p"))), NOW)
    got = {r.id: r.status for r in api.memory_write(store, with_order(memory(spark, dict(id="b", supersedes="a"))), NOW).collect()}
    assert got == {"a": "superseded", "p": "pinned", "b": "active"}
    proposed = api.memory_propose(store, with_order(memory(spark, dict(id="b"), dict(id="c", type="core"), dict(id="p")))).collect()
    assert {r.target_key for r in proposed} == {"c", "p"}


def test_archived_rows_keep_their_state(spark):
    store = memory(spark, dict(id="a", status="archived", archived_reason="expired", updated_at="2026-06-10"))
    row = api.memory_write(store, with_order(memory(spark, dict(id="a", title="new", updated_at="2026-01-01"))), NOW).first()
    assert (row.status, row.archived_reason, row.title, row.updated_at) == ("archived", "expired", "new", "2026-06-10")


def test_recall_without_a_project(spark):
    rows = memory(spark, dict(id="a", scope="project:beta", project="beta", title="vim"), dict(id="z", status="archived", archived_reason="expired", title="vim"))
    usage = spark.createDataFrame([], "id string, n double, last_access string")
    hits, cold = api.recall(rows, usage, Query("vim", None, NOW), resolved=False)
    assert [r.id for r in hits.collect()] == ["a"] and cold.count() == 0
    hits, cold = api.recall(rows, usage, Query("vim", "alpha", NOW))
    assert hits.count() == 0 and [r.id for r in cold.collect()] == ["z"]


def test_unknown_kinds_do_not_filter(spark):
    kind = "id string, kind string, scope string, project string, question string, answer_summary string, tags array<string>, updated_at string"
    qa = spark.createDataFrame([("1", "decision", "global", None, "how", "so", ["x"], NOW), ("2", "compound", "global", None, "how", "so", ["x"], NOW)], kind)
    assert api.qa_query(qa, Query("how", None, NOW), "no-such").count() == 2 and api.qa_query(qa, Query("how", None, NOW), "decision").count() == 1


def test_question_scopes(spark):
    items = spark.createDataFrame([("project: a b", "q"), ("project:ok ", "q\n x"), ("team", "q"), ("user", "q")], "scope string, question string").withColumn("answer_summary", F.lit("a"))
    got = {r.scope: (r.project, r.defect) for r in pages.qa_writes(items, NOW).collect()}
    assert got["project:ok"] == ("ok", None) and got["project:a b"][1] and got["team"][1] and got["user"] == (None, None)


def test_skips_keep_their_first_time(spark):
    skips = spark.createDataFrame([("s", "old", "2026-01-01")], "session_id string, reason string, at string")
    new = spark.createDataFrame([("s", "", 1), ("t", "why", 2)], "session_id string, reason string, order int")
    got = {r.session_id: (r.reason, r.at, r.added) for r in api.skip_write(skips, new, NOW).collect()}
    assert got == {"s": ("old", "2026-01-01", False), "t": ("why", NOW, True)}
