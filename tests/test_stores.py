"""Saves of two writers, retention, and byte ranges of files."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from test_semantics import memory

from lodestone.operators import archive
from lodestone.sources import layers, ranges, stores, transcripts, versions
from lodestone.streaming import ingest


def test_the_second_of_two_savers_is_refused(spark, tmp_path):
    root, rows = f"file://{tmp_path}", spark.range(3).toDF("id")
    versions.save(root, a=rows)
    at = versions.head(spark, root)
    first = versions.save(root, after=at, a=rows.limit(1))
    with pytest.raises(versions.Conflict):
        versions.save(root, after=at, a=rows.limit(2))
    assert versions.current(spark, root) == first and versions.load(spark, root, "a").count() == 1
    assert len([p for p in tmp_path.iterdir() if p.name != versions.LOG]) == 2


def test_updates_at_once_are_all_kept(spark, tmp_path):
    root = f"file://{tmp_path}"
    versions.save(root, a=spark.createDataFrame([], "id long"))

    def add(i):
        versions.update(spark, root, lambda v: {"a": versions.load(spark, root, "a", v).union(spark.createDataFrame([(i,)], "id long"))}, tries=20)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.id for r in versions.load(spark, root, "a").collect()) == [0, 1, 2, 3] and versions.head(spark, root) == 5


def test_retention(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = [versions.save(root, a=spark.range(i + 1).toDF("id")) for i in range(4)]
    versions.roll_back(spark, root, made[0])
    assert sorted(versions.retain(spark, root, 2)) == sorted(made[1:3]) and versions.current(spark, root) == made[0]
    assert versions.load(spark, root, "a").count() == 1 and versions.load(spark, root, "a", made[3]).count() == 4
    with pytest.raises(ValueError, match="current"):
        versions.retain(spark, root, 0)


def test_tails_read_no_more_than_they_may(spark, tmp_path):
    texts = {"a": "one\ntwo\nthree\n", "b": "x" * 5000 + "\nlast é\n\nend", "c": "", "d": "y" * 3000, "e": "k\n" * 10}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    got = {}
    for r in ranges.tails(spark, str(tmp_path), 20).collect():
        got.setdefault(r.path[-7:-6], []).append((r.line_no, r.value))
    want = {}
    for name, text in texts.items():
        raw = text.encode()
        lines = raw[-20:].decode(errors="replace").split("\n")
        want[name] = [x for x in lines[1 if len(raw) > 20 else 0 :] if x]
    assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == {k: v for k, v in want.items() if v}
    files = ranges.listed(spark, str(tmp_path)).withColumn("start", F.greatest(F.col("size") - 20, F.lit(0)))
    assert max(len(r.bytes) for r in ranges.read(files).collect()) == 20
    (tmp_path / "a.jsonl").unlink()
    assert [r.bytes for r in ranges.read(spark.createDataFrame([(f"file://{tmp_path}/a.jsonl", 0, 9)], "path string, start long, size long")).collect()] == [None]


def test_appended_lines_are_all_that_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 500)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = lambda i, **more: json.dumps({"type": "user" if i % 2 else "assistant", "message": {"content": f"a text of some length, number {i} é"}, **more}) + "\n"
    clock = iter(range(1_700_000_000, 1_800_000_000, 10))

    def put(name, text, mode="w"):
        with open(src / name, mode) as f:
            f.write(text)
        at = next(clock)
        os.utime(src / name, (at, at))

    def step():
        got = ingest.follow(spark, str(src), transcripts.parse_lines, transcripts.line_head, out)
        names = ["session_id", "cwd", "started_at", "ended_at", "pos", "role", "text"]
        whole = transcripts.parse_lines(transcripts.read_lines(spark, str(src))).select(names)
        assert sorted(map(str, ingest.followed(spark, out, transcripts.line_settled).select(names).collect())) == sorted(map(str, whole.collect()))
        return got

    put("a.jsonl", "".join(line(i, timestamp=f"t{i:03}") for i in range(60)))
    put("b.jsonl", line(0, sessionId="s", cwd="/w"))
    size = sum(p.stat().st_size for p in src.iterdir())
    assert step() == (2, size)
    assert step() == (0, 0)
    more = line(61, timestamp="t999", sessionId="late")
    put("a.jsonl", more, "a")
    n, read = step()
    assert n == 1 and read <= ingest.ANCHOR + len(more.encode())
    put("a.jsonl", '{"type":"summary"}\n', "a")
    put("b.jsonl", line(5, cwd="/else") + line(6), "a")
    put("c.jsonl", line(7))
    assert step()[0] == 3
    put("a.jsonl", line(9, timestamp="t5"))
    put("b.jsonl", "x" * 9000 + "\n" + line(3))
    assert step()[0] == 2
    put("b.jsonl", line(8)[:-1], "a")
    assert ingest.follow(spark, str(src), transcripts.parse_lines, transcripts.line_head, out)[0] == 1
    put("b.jsonl", "\n", "a")
    assert step()[0] == 1


def test_small_tables_are_dealt_out_evenly(spark, tmp_path):
    """Half of the rows have one id, and it makes no difference."""
    from lodestone.sources.tables import spread

    path = f"file://{tmp_path}/t.parquet"
    spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "repeat('x', 50) as text").coalesce(1).write.parquet(path)
    rows = spread(spark, path)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 1.1 * min(sizes)
    assert "hashpartitioning" not in rows._jdf.queryExecution().toString()


def test_changes_are_written_alone_and_merged_when_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    store = memory(spark, *[dict(id=f"m{i:03}", title=f"t{i}", source_files=[f"f{i}"]) for i in range(200)])
    layers.save_whole(root, "memory", store)
    want = store
    for turn in range(3):
        items = memory(spark, *[dict(id=f"m{i:03}", title=f"new {turn}", seq=i, source_files=["g"], supersedes="m007" if i == 190 + turn else None) for i in range(190 + turn, 200 + turn)]).withColumn("order", F.col("seq"))
        now = f"2026-07-0{turn + 1}"
        version = layers.save_changes(root, "memory", archive.upsert_changes(layers.load(spark, root, "memory"), items, now))
        assert spark.read.parquet(f"{root}/{version}/memory").count() == 11  # ten, and the one that is superseded
        want = archive.upsert(want, items, now)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(layers.load(spark, root, "memory")) == rows(want.select(store.columns))
    at = versions.head(spark, root)
    layers.compact(spark, root, "memory")
    assert rows(layers.load(spark, root, "memory")) == rows(want.select(store.columns))
    with pytest.raises(versions.Conflict):
        layers.save_changes(root, "memory", store.limit(1), after=at)


def test_tails_that_begin_inside_a_character(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("ééééé\nlast é".encode() + b"\n\xff x\n")
    for most in range(5, 20):
        data = (tmp_path / "a.jsonl").read_bytes()
        want = [x.decode(errors="replace") for x in data[-most:].split(b"\n")[most < len(data) :] if x]
        assert [r.value for r in ranges.tails(spark, str(tmp_path), most).orderBy("line_no").collect()] == want


def test_files_are_folded_one_after_another(spark):
    rows = [(f"/l/{i}", n, json.dumps(x)) for i in range(40) for n, x in enumerate([{"type": "session_meta", "payload": {"id": f"s{i}", "cwd": "/w"}}, *[{"type": "event_msg", "payload": {"type": "user_message", "message": f"text {i} {k}"}} for k in range(7)]])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        lines = spark.createDataFrame(rows, "path string, line_no int, value string").repartition(6, "value")
        made = transcripts.parse_rollouts(lines)
        assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
        assert sorted((r.path, r.session_id, r.pos, r.text) for r in made.collect()) == sorted((f"/l/{i}", f"s{i}", k, f"text {i} {k}") for i in range(40) for k in range(7))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_small_documents_are_few_tasks(spark, tmp_path):
    """Documents are listed and read by tasks, by their bytes; names that Spark's reader hides count as well."""
    for i in range(300):
        at = tmp_path / ["semantic", "_primer", "semantic/_old"][i % 3] / f"{i % 4}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{'_' if i % 2 else ''}d {i}%.md").write_text(f"text {i}é\n")
    (tmp_path / "semantic" / "x.txt").write_text("none")
    (tmp_path / "empty.md").write_text("")
    rows = stores.read_markdown(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() == 1
    want = {(f"{['semantic', '', 'semantic/_old'][i % 3]}/{i % 4}/{'_' if i % 2 else ''}d {i}%.md", f"text {i}é\n") for i in range(300) if i % 3 != 1}
    assert {tuple(r) for r in rows.collect()} == want | {("empty.md", "")}
