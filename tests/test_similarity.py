"""Near-duplicate kinds, classes and archival against plain Python over all pairs."""

import random
from math import ceil

import pytest
from pyspark.sql import functions as F
from test_semantics import NOW, memory

from lodestone.operators import archive, lint, merge, similarity
from lodestone.sources import scratch


def tokens(r):
    return frozenset(f"{r['title']} {r['summary']}".split())


def block(r):
    return r["type"], r["scope"], r["project"]


def close(a, b, threshold):
    x, y = tokens(a), tokens(b)
    return block(a) == block(b) and bool(x) and len(x & y) >= threshold * len(x | y) - 1e-9


def some_rows(seed, n=90, kinds=9, **more):
    r = random.Random(seed)
    texts = [" ".join(f"w{i}" for i in sorted(r.sample(range(14), r.randint(8, 12)))) for _ in range(kinds)]
    rows = []
    for i in range(n):
        row = dict(id=f"m{r.randrange(10**6):06d}{i}", title=r.choice(texts), summary="", type=r.choice(["semantic", "semantic", "core"]), scope="project:alpha", project=r.choice(["alpha", None]), importance=float(r.randint(0, 3)), updated_at=f"2026-0{r.randint(1, 6)}-0{r.randint(1, 9)}", status=r.choice(["active", "active", "active", "pinned"]), valid_to=r.choice([None, None, None, "2026-01-01"]), access_count=1.0)
        rows.append({**row, **{k: r.choice(v) for k, v in more.items()}})
    return rows


def folded(rows, threshold=0.8):
    """Rules (expiry is the only one that these rows meet), then pairs one after another."""
    may = lambda r: r["type"] != "core" and r["status"] not in ("pinned", "archived")
    rules = {r["id"]: "expired" for r in rows if may(r) and r["valid_to"]}
    chosen = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x["importance"] is None or y["importance"] is None or not close(x, y, threshold):
                continue
            a, b = sorted((x, y), key=lambda r: r["id"])
            if a["importance"] == b["importance"] and "soon" in (a["updated_at"], b["updated_at"]):
                continue
            lower = a["importance"] < b["importance"] if a["importance"] != b["importance"] else a["updated_at"] <= b["updated_at"]
            loser, winner = (a, b) if lower else (b, a)
            if may(loser) and winner["id"] not in rules and winner["id"] not in chosen:
                chosen[loser["id"]] = f"near-duplicate-of:{winner['id']}"
    return rules | chosen


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("shape", ["copies", "mixed", "undated"])
def test_archive_plan_equals_the_fold(spark, seed, shape):
    rows = {"copies": lambda: some_rows(seed, 80, 2), "mixed": lambda: some_rows(seed), "undated": lambda: some_rows(seed, 60, 3, updated_at=["soon", "2026-02-01", "2026-03-01"], importance=[0.0, 1.0, None])}[shape]()
    got = {r.id: r.reason for r in archive.plan(memory(spark, *rows), NOW).collect()}
    assert got == folded(rows)


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_all_pairs(spark, seed):
    rows = some_rows(seed, status=["active"])
    near = {r["id"]: {o["id"] for o in rows if o is not r and close(r, o, 0.8)} for r in rows}
    label = {r["id"]: r["id"] for r in rows}
    while True:
        new = {i: min([label[i], *(label[j] for j in near[i])]) for i in near}
        if new == label:
            break
        label = new
    same = {r["id"]: [o["id"] for o in rows if block(o) == block(r) and tokens(o) == tokens(r)] for r in rows}
    got = {(r.id, r.representative, r.copies, r.n_links, r.class_id) for r in similarity.near_duplicate_classes(memory(spark, *rows)).collect()}
    assert got == {(i, min(same[i]), len(same[i]), len(near[i]), label[i]) for i in near}
    assert similarity.near_duplicate_classes(memory(spark, *rows).limit(0)).count() == 0


def test_half_of_all_rows_alike(spark):
    """10,000 equal rows cost 10,000 rows of classes, and no task of their archival holds them all."""
    base = memory(spark, dict(id="x", title="one two three four five", summary="six seven eight"))
    rows = base.drop("id", "seq", "importance", "status", "title").crossJoin(spark.range(0, 20_000, 1, 8).select(F.col("id").alias("seq")))
    rows = rows.withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("seq").cast("string"), 6, "0"))).withColumn("importance", (F.col("seq") * 7919 % 5).cast("double"))
    rows = rows.withColumn("status", F.when(F.col("seq") % 1000 == 14, "pinned").otherwise("active")).withColumn("title", F.when(F.col("seq") % 2 == 0, "one two three four five").otherwise(F.concat(F.lit("a b c d e f g h i "), F.col("seq").cast("string"), F.lit(" y"), F.col("seq").cast("string"))))
    found = similarity.near_duplicate_classes(rows, statuses=("active", "pinned")).where("copies > 1")
    assert found.count() == 10_000 and found.select("n_links").distinct().collect() == [(9999,)]
    sizes = []
    keep = archive.written

    def seen(df, name):
        out = keep(df, name)
        if name == "ranges":
            sizes.append([r.n for r in out.groupBy("__part").agg(F.count("*").alias("n")).collect()])
        return out

    archive.written = seen
    try:
        got = archive.plan(rows, NOW).collect()
    finally:
        archive.written = keep
    assert len(got) == 10_000 - 20 - 1 and len(sizes) == 2
    assert all(max(x) <= 3 * sorted(x)[len(x) // 2] for x in sizes)


def test_pairs_are_counted_without_being_made(spark):
    rows = memory(spark, *some_rows(5, n=120))
    found = similarity.kinds(rows, 0.6)
    assert similarity.count_pairs(*found).first().n == similarity.pairs_of(*found).count() > 0
    odd = found.members.withColumn("seq", F.when(F.col("seq") % 5 > 1, F.col("seq") % 3))
    assert similarity.count_pairs(odd, found.links).first().n == similarity.pairs_of(odd, found.links).count()


def test_no_token_list_is_broadcast(spark, monkeypatch):
    plans = []
    kept = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or kept(df, name))
    similarity.kinds(memory(spark, *some_rows(6)), 0.6)
    assert {"candidates", "close-candidates", "kind-links"} <= {n for n, _ in plans} and not [n for n, p in plans if "Broadcast" in p]


def test_tokens_are_fetched_for_few_pairs_that_are_none(spark, monkeypatch):
    """Long rows fill a small parity map: the wide one decides before tokens are shuffled."""
    r = random.Random(7)
    common = [f"c{i}" for i in range(700)]
    rows = [dict(id=f"m{i}", title=" ".join(r.sample(common, 250)), summary="", type="semantic", scope="user", project=None, status="active") for i in range(60)]
    rows += [{**rows[i], "id": f"n{i}", "summary": "one more word"} for i in range(5)]
    tables = {}
    kept = similarity.written

    def counted(df, name):
        out = kept(df, name)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "written", counted)
    links = similarity.kinds(memory(spark, *rows), 0.6).links
    assert links.count() == 5 == tables["close-candidates"] < tables["candidates"]


def test_candidates_are_fetched_in_rounds(spark, monkeypatch):
    """Pairs grow with the square of the rows: no round moves more words of maps or tokens than all rows have."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(700)]
    rows = [dict(id=f"m{i:03d}", title=" ".join(r.sample(common, 300)), summary="", type="semantic", scope="user", project=None, status="active") for i in range(80)]
    rows += [{**rows[i // 6], "id": f"n{i:03d}", "summary": f"more{i % 6}"} for i in range(120)]
    plans, loads = [], {}
    kept = similarity.written

    def seen(df, name):
        if name.startswith(("close-candidates", "kind-links")):
            loads.setdefault(name.removesuffix("-part"), []).append(name)
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(similarity, "written", seen)
    links = similarity.kinds(memory(spark, *rows), 0.6).links
    assert links.count() == sum(close(a, b, 0.6) for i, a in enumerate(rows) for b in rows[:i])
    assert len(loads["close-candidates"]) > 3 and len(loads["kind-links"]) > 2
    # maps and tokens lie in buckets: only the pairs are dealt out, by x and by y
    assert all(p.count("Exchange hashpartitioning") == 2 for n, p in plans if n.endswith("-part"))


def test_lint_counts_are_made_check_by_check(spark):
    """The last plan reads counts and no rows: all checks in one plan took the driver more memory than all else."""
    rows = memory(spark, *some_rows(3, 40, 3, valid_to=[None, "2026-01-01", "soon"], supersedes=[None, "gone"], source_sessions=[[], ["s1"]]))
    pages = spark.createDataFrame([("e1", "global", None, ["gone"], ["e2"]), ("e2", "project:b", "a", [], ["e1"])], "id string, scope string, project string, source_memory_ids array<string>, related_entities array<string>")
    sessions = spark.createDataFrame([("s2",)], "session_id string")
    got = lint.report_counts(rows, pages, pages, sessions, NOW)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert got.first() == lint.counts(lint.report(rows, pages, pages, sessions, NOW)).first()


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Tables of ids and of references are small on disk: by their size there Spark would send them to the driver."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (archive, similarity):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: real(seen(df), name))
    rows = memory(spark, *some_rows(5))
    seen(archive.plan(rows, NOW))
    members, links = similarity.kinds(rows)
    seen(similarity.count_pairs(members, links))
    ids = scratch.written(rows.select("id"), "ids")
    seen(merge.dangling(rows, "supersedes", ids))
    seen(merge.stale_provenance(rows, ids.select(F.col("id").alias("session_id"))))
    assert not [p for p in plans if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs_that_maps_refuse_are_never_rows(spark, monkeypatch, threshold):
    """Kinds of one block meet in tiles: what is written is pairs of tiles and few more pairs of kinds than are links."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(900)]
    lists = [r.sample(common, 300) for _ in range(200)]
    for n in (1, 2, 5, 31, 33, 64, 100, 130, 260, 410):  # sizes around the steps of a map's width, and links on both sides of the threshold
        base = r.sample(common, n)
        lists += [base[: ceil(n * r.uniform(0.5, 1))] + [f"d{n}{i}{k}" for k in range(r.randrange(max(n // 3, 1)))] for i in range(12)]
    rows = [dict(id=f"m{i:03d}", title=" ".join(x), summary="", type="semantic", scope="user", project=None, status="active") for i, x in enumerate(lists)]
    tables = {}
    kept = similarity.written

    def counted(df, name):
        out = kept(df, name)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "written", counted)
    found = similarity.kinds(memory(spark, *rows), threshold)
    n = len({tokens(x) for x in rows})
    assert found.members.select("kind").distinct().count() == n
    sets = list({tokens(x): x for x in rows}.values())
    assert found.links.count() == sum(close(a, b, threshold) for i, a in enumerate(sets) for b in sets[:i]) > 20
    assert tables["candidates"] < 1500 < n * (n - 1) // 20 and tables["close-candidates"] < 2 * found.links.count()


def test_tokens_of_a_row_are_made_once(spark, monkeypatch):
    """No filter makes the tokens again: that they are some is asked of the text."""
    plans = {}
    kept = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and kept(df, name))
    rows = [dict(id=f"m{i}", title=x, summary="", type="semantic", scope="user", project=None, status="active") for i, x in enumerate(["a b c", "", "..", "Ab", "Kb", "é1", "_x"])]
    assert {r.id for r in similarity.kinds(memory(spark, *rows), 0.6).members.collect()} == {"m3", "m4", "m6"}
    assert plans["tokens"].count("regexp_extract_all") == 1
