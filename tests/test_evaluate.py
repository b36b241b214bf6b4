"""Texts that hold queries, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate


@pytest.mark.parametrize("shard", [2 << 20, 40])
def test_containing_equals_all_pairs(spark, shard, monkeypatch):
    monkeypatch.setattr(evaluate, "SHARD_BYTES", shard)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abAB é", k=r.randint(1, 4)))
    rows = [(i % 50, r.choice([None, "", " ".join(word() for _ in range(r.randint(1, 30)))])) for i in range(120)]
    asked = [(i, r.choice([None, "", word(), word() + " " + word()])) for i in range(60)]
    got = evaluate.containing(spark.createDataFrame(rows, "id int, t string"), ["id"], F.col("t"), spark.createDataFrame(asked, "query_id int, q string"))
    assert sorted((x.id, x.query_id, x.q) for x in got.collect()) == sorted((i, j, q) for i, t in rows for j, q in asked if t is not None and q is not None and q.lower() in t.lower())


def test_plans_have_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "a b c")], "id int, t string")
    got = evaluate.containing(rows, ["id"], F.col("t"), spark.createDataFrame([(1, "b")], "query_id int, q string"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Generate" not in plan and "Cartesian" not in plan
