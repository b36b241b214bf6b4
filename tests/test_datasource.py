"""The registered source of transcripts."""

import json
import os

from lodestone.sources import datasource


def put(root, name, text, at):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (at, at))


def test_lines_by_ranges_and_pruned_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    texts = {(tool, f"p{i}/f{i}.jsonl"): "".join(f"{tool}{i} line {k} é{'x' * (k * 7 % 50)}\n" for k in range(40 * i)) + ("end" if i == 2 else "") for tool in ("one", "two") for i in range(4)}
    for (tool, name), text in texts.items():
        put(a if tool == "one" else b, name, text, 1_700_000_000 + 100 * int(name[1]))
    put(a, "subagents/f.jsonl", "no\n", 1_700_000_000)
    put(a, "notes.txt", "no\n", 1_700_000_000)
    roots = json.dumps({"one": f"file://{a}", "two": f"file://{b}"})
    spark.dataSource.register(datasource.Transcripts)
    load = lambda size: spark.read.format("lodestone_transcripts").option("roots", roots).option("rangeBytes", size).load()
    want = sorted((tool, name, line) for (tool, name), text in texts.items() for line in text.split("\n") if line)
    for size in (37, 1000, 1 << 20):
        got = load(size).collect()
        assert sorted((r.tool, "/".join(r.path.split("/")[-2:]), r.value) for r in got) == want
    assert len({(r.path, r.at) for r in got}) == len(got)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda: spark.read.format("lodestone_transcripts").option("roots", roots).option("prune", "true").load()
    try:
        rows = load().where("tool = 'two' and mtime_ms >= 1700000200000 and value like '%line 1 %'")
        assert sorted(r.value.split(" é")[0] for r in rows.collect()) == ["two2 line 1", "two3 line 1"]
        assert rows.rdd.getNumPartitions() == 2
        assert load().where("tool in ('one', 'none')").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_that_it_takes_and_leaves():
    reader = datasource.Pruning({"roots": "{}"})
    left = list(reader.pushFilters([datasource.EqualTo(("tool",), "x"), datasource.EqualTo(("value",), "x"), datasource.LessThan(("mtime_ms",), 5)]))
    assert [f.attribute for f in left] == [("value",)] and len(reader.filters) == 2 and reader.partitions() == []


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(600):
        put(tmp_path, f"f{i}.jsonl", f"line {i}\nend\n" * (1 + i % 3), 1_700_000_000)
    parts = datasource.Reader({"roots": json.dumps({"any": f"file://{tmp_path}"}), "rangeBytes": "16"}).partitions()
    ranges = [r for p in parts for r in p.ranges]
    assert len(ranges) > 600 and len(parts) <= 2 * datasource.TASKS and ranges == sorted(ranges, key=lambda r: (r.path, r.start))
    spark.dataSource.register(datasource.Transcripts)
    got = spark.read.format("lodestone_transcripts").option("roots", json.dumps({"any": f"file://{tmp_path}"})).option("rangeBytes", 16).load().collect()
    assert sorted(r.value for r in got) == sorted(v for i in range(600) for v in [f"line {i}", "end"] * (1 + i % 3))
