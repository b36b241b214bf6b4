"""Registered queries of the commands and of the readers, over files that they write first, each beside its SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators.ranking import Query as Asked
from ..sources import datasource, layers, ranges, stores, transcripts, versions
from ..sources.scratch import fresh_path
from ..streaming import ingest
from .proxies import NOW, view, with_views
from .queries import _ELIG, _PARTS, ASKED, Query, _lambdas
from .queries import ORACLES as BASE
from .session_queries import _KEPT, _TEXT, _documents, _talk

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = (with_views(*views) if views else "") + _lambdas(sql)
        return f

    return add


def _mem(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "MEM")


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share; it goes when the driver ends."""
    return fresh_path(spark, "files")


def _files(rows: DataFrame, name: Column, order: str, value: Column, folder: str) -> str:
    """Writes one text file (``name``.txt) for each ``name``, with the values in order; returns ``folder``.

    Each task writes its files where they belong: a writer of Spark's would make a folder for each
    file, and the driver would move and list them one by one.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("value")))), lambda x: x["value"])
    whole = rows.groupBy(name.alias("file")).agg(F.array_join(lines, "\n").alias("value"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if (parent := f"{place}/{file}".rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{place}/{file}.txt") as f:
                    f.write(f"{text}\n".encode())
            yield batch.slice(0, 0).select(["file"])

    whole.mapInArrow(put, "file string").write.format("noop").mode("overwrite").save()
    return folder


# Readers --------------------------------------------------------------------------------
@query("SRC01_02_line_files", f"SELECT 's-' || conv_id AS session_id, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_KEPT} AND conv_id % 6 <> 0")
def src02(spark, d):
    """Files below a folder are found and read; those below a left-out folder aren't."""
    c = F.col("conv_id").cast("string")
    value = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"s-'), c, F.lit('","cwd":"/work/x","message":'), F.to_json(F.struct(F.col("text").alias("content"))), F.lit("}"))
    name = F.concat(F.when(F.col("conv_id") % 6 == 0, F.lit("subagents-")).otherwise(F.lit("talk-")), c)
    root = _files(_talk(spark, d), name, "turn", value, _folder(spark))
    lines = transcripts.read_log(spark, root, "*.txt", skip="/subagents-")
    return transcripts.parse_lines(lines).select("session_id", "role", "text")


@query("SRC01_registered_source", "SELECT CAST(conv_id AS VARCHAR) AS talk, count(*) AS n, sum(length(replace(text, chr(10), ' '))) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def src01_source(spark, d):
    """The lines of files that the registered source finds and reads in ranges."""
    root = _files(_talk(spark, d), F.concat(F.lit("talk-"), F.col("conv_id").cast("string")), "turn", F.replace("text", F.lit("\n"), F.lit(" ")), _folder(spark))
    spark.dataSource.register(datasource.Transcripts)
    rows = spark.read.format("lodestone_transcripts").option("roots", json.dumps({"any": root})).option("pattern", "*.txt").option("rangeBytes", 4096).load()
    return rows.groupBy(F.regexp_extract("path", r"talk-(\d+)\.txt", 1).alias("talk")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


@query("JN13_followed_files", f"SELECT 's-' || conv_id AS session_id, turn AS pos, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_KEPT}")
def jn13_followed(spark, d):
    """Files are followed: read once, and not again while they stay as they are."""
    c = F.col("conv_id").cast("string")
    value = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"s-'), c, F.lit('","message":'), F.to_json(F.struct(F.col("text").alias("content"))), F.lit("}"))
    root, out = _files(_talk(spark, d), F.concat(F.lit("talk-"), c), "turn", value, _folder(spark)), _folder(spark)
    for _ in range(2):
        ingest.follow(spark, root, transcripts.parse_lines, transcripts.line_head, out, "*.txt")
    return ingest.followed(spark, out, transcripts.line_settled).select("session_id", F.col("pos").cast("long").alias("pos"), "role", "text")


@query("SRC13_rollout_files", f"SELECT 'r' || conv_id AS session_id, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_TEXT} <> ''")
def src13(spark, d):
    c = F.col("conv_id").cast("string")
    rows = _talk(spark, d).where("role in ('user', 'assistant')")
    said = F.concat(F.lit('{"type":"event_msg","payload":{"type":"'), F.when(F.col("role") == "user", "user_message").otherwise("agent_message"), F.lit('",'), F.to_json(F.struct(F.col("text").alias("message"))).substr(F.lit(2), F.lit(1 << 30)), F.lit("}"))
    meta = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("int").alias("turn"), F.concat(F.lit('{"type":"session_meta","payload":{"id":"r'), c, F.lit('","cwd":"/work/x"}}')).alias("value"))
    both = rows.select("conv_id", F.col("turn").cast("int").alias("turn"), said.alias("value")).unionByName(meta)
    root = _files(both, F.concat(F.lit("rollout-"), c), "turn", F.col("value"), _folder(spark))
    return transcripts.parse_rollouts(transcripts.read_lines(spark, root, "*.txt")).select("session_id", "role", "text")


@query("SRC36_tail", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (text <> '') AS n FROM (SELECT conv_id, text, row_number() OVER w AS nth, sum(octet_length(encode(text)) + 1) OVER w - octet_length(encode(text)) AS begins, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id) AS size FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE size <= 1500 OR begins - 1 > size - 1500 GROUP BY conv_id HAVING count(*) FILTER (text <> '') > 0")
def src36(spark, d):
    """The last 1500 bytes of each file: the line that the range begins in is left out."""
    value = F.replace("text", F.lit("\n"), F.lit(" "))
    root = _files(_talk(spark, d), F.concat(F.lit("talk-"), F.col("conv_id").cast("string")), "turn", value, _folder(spark))
    rows = ranges.tails(spark, root, 1500, "*.txt")
    return rows.groupBy(F.regexp_extract("path", r"talk-(\d+)\.txt", 1).alias("session_id")).agg(F.count("*").alias("n"))


@query("SRC29_markdown_files", "SELECT id, status, coalesce(trust, 'unknown') AS trust FROM mem WHERE type <> 'core'", "MEM")
def src29(spark, d):
    """Documents below the folders of the types; those of a left-out folder aren't read."""
    docs = stores.memory_markdown(_documents(spark, d)).select("id", "md")
    folder = _folder(spark)
    part = F.split_part("id", F.lit("/"), F.lit(1))
    below = F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(256))), 2, "0")  # so that no folder holds them all
    _files(docs, F.concat_ws("/", F.when(part == "core", "_primer").otherwise(part), below, F.replace("id", F.lit("/"), F.lit("~"))), "id", F.col("md"), folder)
    rows = stores.read_markdown(spark, folder, pattern="*.txt")
    return stores.memory_documents(rows).select("id", "status", "trust")


# Stores ---------------------------------------------------------------------------------
@query("SNK01_save", "SELECT id, CASE WHEN seq % 2 = 0 THEN 'second' ELSE title END AS title, seq % 3 = 0 AS skipped FROM mem", "MEM")
def snk01(spark, d):
    """Two tables are saved together, a failed save leaves both, and the last good version is read."""
    mem = _mem(spark, d)
    root = _folder(spark)
    skips = mem.select("id", (F.col("seq") % 3 == 0).alias("skipped"))
    versions.save(root, memory=mem.select("id", "title"), skips=skips.limit(0))
    versions.save(root, memory=mem.select("id", F.when(F.col("seq") % 2 == 0, F.lit("second")).otherwise(F.col("title")).alias("title")), skips=skips)
    try:
        versions.save(root, memory=mem.select("id", F.lit("third").alias("title")), skips=skips.select("id", F.raise_error(F.lit("no")).alias("skipped")))
    except Exception:  # noqa: BLE001  the failure is the point: what was there stays
        pass
    return versions.load(spark, root, "memory").join(versions.load(spark, root, "skips"), "id")


@query("LCY14_roll_back", "SELECT id, title FROM mem", "MEM")
def lcy14(spark, d):
    mem, root = _mem(spark, d).select("id", "title"), _folder(spark)
    first = versions.save(root, memory=mem)
    versions.save(root, memory=mem.withColumn("title", F.lit("x")))
    versions.roll_back(spark, root, first)
    return versions.load(spark, root, "memory")


@query("LCY05_layers", "SELECT id, CASE WHEN seq % 10 = 4 THEN 'second' ELSE title END AS title FROM mem", "MEM")
def lcy05_layers(spark, d):
    """Changed rows are written alone, and merged where they are read."""
    mem, root = _mem(spark, d), _folder(spark)
    layers.save_whole(root, "memory", mem.select("id", "title"))
    layers.save_changes(root, "memory", mem.where("seq % 10 = 4").select("id", F.lit("second").alias("title")))
    return layers.load(spark, root, "memory")


@query("LCY10_primers_touched", "SELECT DISTINCT scope FROM mem WHERE seq % 97 = 0", "MEM")
def lcy10(spark, d):
    mem = _mem(spark, d)
    return api.primers_touched(mem, mem.withColumn("title", F.when(F.col("seq") % 97 == 0, F.lit("new")).otherwise(F.col("title"))))


@query("LCY15_archive_counts", "SELECT count(*) FILTER (seq % 5 = 4) AS malformed, (SELECT count(*) FROM mem l JOIN overlay o ON o.id = l.id WHERE l.seq % 5 <> 4 AND CASE WHEN try_cast(o.updated_at AS DATE) IS NULL THEN true WHEN try_cast(o.updated_at AS DATE) <> try_cast(l.updated_at AS DATE) THEN try_cast(o.updated_at AS DATE) > try_cast(l.updated_at AS DATE) ELSE l.status IS DISTINCT FROM o.status END) AS in_conflict, count(*) FILTER (status = 'superseded') AS archived FROM mem", "MEM", "OVERLAY")
def lcy15(spark, d):
    mem = _mem(spark, d)
    return api.archive_counts(mem, view(spark, d, "OVERLAY"), mem.where("status = 'superseded'"), mem.where("seq % 5 = 4").select("id"), ["status"])


# Commands -------------------------------------------------------------------------------
@query("API05_memory_write", "SELECT id, title FROM (SELECT id, CASE WHEN seq % 10 = 4 AND type NOT IN ('core', 'procedural') AND status NOT IN ('pinned', 'archived', 'superseded') THEN 'rewritten' ELSE title END AS title FROM mem)", "MEM")
def api05(spark, d):
    mem = _mem(spark, d)
    items = mem.where("seq % 10 = 4 and type not in ('core', 'procedural') and status not in ('pinned', 'archived', 'superseded')")
    items = items.withColumns({"title": F.lit("rewritten"), "summary": F.lit("plain"), "entities": F.array(F.lit("e")), "supersedes": F.lit(None).cast("string"), "order": F.col("seq"), "updated_at": F.lit(NOW)})
    return api.memory_write(mem, items, NOW).select("id", "title")


@query("API06_memory_index", "SELECT id, type, status FROM mem WHERE seq % 5 <> 2", "MEM")
def api06(spark, d):
    docs = stores.memory_markdown(_documents(spark, d)).join(_mem(spark, d).select("id", "seq"), "id")
    md = F.when(F.col("seq") % 5 == 2, F.lit("# no head")).otherwise(F.col("md"))
    return api.memory_index(docs.select(F.col("id").alias("path"), md.alias("md")), NOW)[0].select("id", "type", "status")


@query("API07_skip_write", "SELECT session_id, 'asked' AS reason, conv_id % 7 <> 0 AS added FROM sessions WHERE conv_id % 7 IN (0, 1)", "SESSIONS")
def api07(spark, d):
    rows = view(spark, d, "SESSIONS")
    new = rows.where("conv_id % 7 in (0, 1)").select("session_id", F.lit("asked").alias("reason"), F.col("conv_id").alias("order"))
    return api.skip_write(view(spark, d, "SKIPS"), new, NOW).select("session_id", "reason", "added")


@query("API08_conflicts", "SELECT id, CASE WHEN status = 'superseded' THEN 'superseded' WHEN supersedes IS NOT NULL THEN 'supersedes-other' ELSE 'time-bounded' END AS why FROM mem WHERE status <> 'archived' AND (status = 'superseded' OR supersedes IS NOT NULL OR valid_to IS NOT NULL)", "MEM")
def api08(spark, d):
    return api.memory_query(_mem(spark, d), view(spark, d, "USAGE"), ASKED)[1].select("id", "why")


QUERIES["API09_memory_primer"] = lambda spark, d: api.memory_primer(_mem(spark, d), "src2", NOW)
ORACLES["API09_memory_primer"] = BASE["PRM02_primer_text"]
#: A query without words about a project is answered by its primer too.
QUERIES["RNK14_overview"] = lambda spark, d: api.overview(_mem(spark, d), Asked("  ", "src2", NOW))
ORACLES["RNK14_overview"] = BASE["PRM02_primer_text"]
ORACLES["RNK14_with_words"] = f"SELECT false AS asked, primer FROM ({BASE['PRM02_primer_text']}) UNION ALL SELECT true, ''"


def _rnk14(spark, d):
    """The primer stands in for an answer where nothing is asked, and only there."""
    answer = lambda text: api.overview(_mem(spark, d), Asked(text, "src2", NOW)).select(F.lit(bool(text.strip())).alias("asked"), "primer")
    return answer(" ").unionByName(answer("the"))


QUERIES["RNK14_with_words"] = _rnk14


@query("API11_entity_query", "SELECT id, kind FROM entity WHERE kind = 'api' AND (scope = 'global' OR scope = 'project:src2')", "ENTITY")
def api11(spark, d):
    return api.entity_query(view(spark, d, "ENTITY"), Asked("x", "src2", NOW), "api").select("id", "kind")


@query("API12_qa_query", f"SELECT id, CAST(5 * length(list_intersect(['the', 'onre'], list_filter(list_distinct(regexp_split_to_array(lower(concat_ws(' ', question, answer_summary, array_to_string(tags, ' '))), '[^a-z0-9_]+')), x -> length(x) > 1))) + CASE WHEN scope = 'project:src2' THEN 4 ELSE 2 END + CASE WHEN date_diff('day', CAST(updated_at AS DATE), DATE '{NOW}') < 0 THEN 0 WHEN date_diff('day', CAST(updated_at AS DATE), DATE '{NOW}') <= 7 THEN 2 WHEN date_diff('day', CAST(updated_at AS DATE), DATE '{NOW}') <= 30 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM qa WHERE kind = 'decision' AND scope IN ('global', 'user', 'project:src2')", "QA")
def api12(spark, d):
    return api.qa_query(view(spark, d, "QA"), Asked("the onre", "src2", NOW), "decision").select("id", "score")


@query("API13_memory_lint", BASE["LNT_report"])
def api13(spark, d):
    rows = api.memory_lint(_mem(spark, d), view(spark, d, "ENTITY"), view(spark, d, "QA"), view(spark, d, "SESSIONS"), NOW)
    return rows.select("check", "severity", "layer", "id", F.array_join("refs", " ").alias("refs"))


@query("API15_propose", "SELECT arg_max(m.id, m.seq) AS id, coalesce(m.supersedes, m.id) AS target FROM mem m LEFT JOIN mem t ON t.id = m.supersedes WHERE m.type IN ('core', 'procedural') OR m.status = 'pinned' OR coalesce(t.type IN ('core', 'procedural') OR t.status = 'pinned', false) GROUP BY 2", "MEM")
def api15(spark, d):
    mem = _mem(spark, d)
    rows = api.memory_propose(mem, mem.withColumn("order", F.col("seq")))
    return rows.select("id", F.col("target_key").alias("target"))


@query("API15_diff_and_reject", "SELECT id AS target_key, title AS before FROM mem WHERE seq % 3 = 1 AND title <> 'proposed'", "MEM")
def api15b(spark, d):
    mem = _mem(spark, d)
    queue = mem.where("seq % 3 = 1").withColumn("target_key", F.col("id")).withColumn("title", F.lit("proposed"))
    rows = api.memory_diff(api.memory_reject(queue, "nothing"), mem, ["title"])
    return rows.where("size(changes) > 0").select(F.col("id").alias("target_key"), F.get_json_object(F.to_json(F.array(F.element_at("changes", 1)["before"])), "$[0]").alias("before"))


def api16(spark, d):
    return api.recall(_mem(spark, d), view(spark, d, "USAGE").limit(0), ASKED, limit=10)[0].select("id", "place", "score")


QUERIES["API16_recall"] = api16
ORACLES["API16_recall"] = with_views("MEM").rstrip() + "," + _lambdas(_PARTS) + " SELECT id, place, score FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id COLLATE en) AS place FROM scored WHERE " + _ELIG + ") WHERE place <= 10"


@query("API18_orchestrate", "SELECT 'project' AS mode, 'src3' AS project, count(*) AS scanned, count(*) FILTER (project = 'src3' AND conv_id % 3 = 0) AS imported, count(*) FILTER (project = 'src3' AND conv_id % 3 <> 0) AS unchanged, count(*) FILTER (project = 'root') AS pseudo, count(*) FILTER (project NOT IN ('src3', 'root')) AS other, CAST(0 AS BIGINT) AS empty, 'run-prepare-then-digest' AS next_step FROM sessions", "SESSIONS")
def api18(spark, d):
    rows = view(spark, d, "SESSIONS")
    return api.orchestrate(rows, rows.where("conv_id % 3 <> 0"), "src3")
