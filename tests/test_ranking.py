"""Many queries at once, against all pairs of queries and rows."""

import random

import pytest
from test_semantics import NOW, memory

from lodestone.operators import ranking


def rows_of(seed, n=150, common="zz"):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [dict(id=f"m{i:04}", title=" ".join([common, *r.choices(words, weights=[1 / (j + 1) for j in range(40)], k=r.randint(0, 9))]), scope=r.choice(["global", "user", "project:a", "project:b"]), importance=float(r.randint(-1, 5)), status=r.choice(["active", "pinned"]), access_count=float(r.randint(0, 9)), updated_at=f"2026-0{r.randint(1, 6)}-01") for i in range(n)]


def asked_of(seed, n=25):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(["zz", "none", *[f"w{j}" for j in range(40)]], k=r.choice([0, 1, 1, 2, 5, 9]))), r.choice(["a", "b", "c", None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("few", [1, 256])
def test_batch_top_equals_single_queries(spark, seed, few):
    rows, asked = memory(spark, *rows_of(seed)), asked_of(seed)
    got = {}
    for x in ranking.batch_top(rows, spark.createDataFrame(asked, "query_id int, q string, project string"), NOW, seed=few).collect():
        got.setdefault(x.query_id, []).append((x.place, x.id, x.keyword_hits, x.score))
    whole = [x.asDict() for x in ranking.rank(ranking.eligible(rows, ranking.Query("", None, NOW)), ranking.Query("", None, NOW)).collect()]
    for i, q, project in asked:
        words = set(q.split())
        scored = []
        for x in whole:
            if x["scope"] not in ("global", "user", f"project:{project}"):
                continue
            hits = len(words & set(f"{x['title']} {x['summary']}".split()))
            scored.append((-(5 * hits + (4 if x["scope"] == f"project:{project}" else 2) + x["score"] - x["scope_points"]), x["id"], hits))
        assert sorted(got.get(i, [])) == [(n + 1, d, h, -s) for n, (s, d, h) in enumerate(sorted(scored)[:5])]


def test_a_word_in_every_row_joins_few_rows(spark):
    """Queries that hold a word of all 4,000 rows are scored against a bounded part of them."""
    r = random.Random(1)
    rows = memory(spark, *[dict(id=f"m{i:05}", title=f"zz t{i % 500} u{i % 40}", scope="global", importance=float(i % 4), access_count=float(r.randint(0, 5))) for i in range(4000)])
    asked = spark.createDataFrame([(i, f"zz t{i}", "a") for i in range(100)] + [(100 + i, "zz", "a") for i in range(50)], "query_id int, q string, project string")
    counts = []
    keep = ranking._hits

    def counted(pairs, *more):
        counts.append(pairs.count())
        return keep(pairs, *more)

    ranking._hits = counted
    try:
        assert ranking.batch_top(rows, asked, NOW).count() == 150 * 5
    finally:
        ranking._hits = keep
    assert sum(counts) < 150 * 4000 / 20
