"""Registered queries of pages, commands and the smaller functions, each beside its SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import text as fn
from ..operators import archive, lint, merge, pages, ranking
from ..sources import stores, transcripts
from .proxies import NOW, view, with_views
from .queries import _EXPIRED, ASKED, COLD, Query, _lambdas, plan_sql
from .queries import ORACLES as BASE

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (with_views(*views) if views else "") + _lambdas(sql)
        return f

    return add


def _mem(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "MEM")


@query("FN02_finite", "SELECT id, CASE seq % 4 WHEN 0 THEN importance WHEN 1 THEN 7.0 WHEN 2 THEN 7.0 ELSE 7.0 END AS n FROM mem", "MEM")
def fn02(spark, d):
    r = F.col("seq") % 4
    x = F.when(r == 0, F.col("importance")).when(r == 1, F.lit(float("nan"))).when(r == 2, F.lit(float("inf")))
    return _mem(spark, d).select("id", fn.finite(x, 7.0).alias("n"))


@query("FN03_arrays", "SELECT id, CASE WHEN seq % 2 = 0 THEN len(entities) ELSE 0 END AS n FROM mem", "MEM")
def fn03(spark, d):
    return _mem(spark, d).select("id", F.size(fn.as_array(F.when(F.col("seq") % 2 == 0, F.col("entities")))).cast("long").alias("n"))


@query("FN04_archived", "SELECT id FROM mem WHERE status = 'archived'", "MEM")
def fn04(spark, d):
    return ranking.score_archived(_mem(spark, d), ASKED).select("id")


@query("FN05_eligible_types", f"SELECT id FROM mem WHERE status NOT IN ('superseded', 'archived') AND NOT {_EXPIRED} AND (scope IN ('global', 'user') OR scope = 'project:src5') AND type = 'semantic'", "MEM")
def fn05(spark, d):
    return ranking.eligible(_mem(spark, d), ranking.Query("", "src5", NOW, type="semantic")).select("id")


@query("FN20_content_hits", "SELECT id FROM mem WHERE list_contains(source_files, 'src/f1.py')", "MEM")
def fn20(spark, d):
    return ranking.rank(_mem(spark, d), ranking.Query("", None, NOW, ["src/f1.py"])).where(ranking.is_content_hit()).select("id")


@query("FN23_list_fields", "SELECT id, len(entities) AS n, CASE WHEN seq % 3 = 0 THEN 0 ELSE 2 END AS fixed FROM (SELECT id, seq, list_filter(list_transform(string_split(replace(array_to_string(entities, ','), ';', ''), ','), e -> trim(e)), e -> e <> '') AS entities FROM mem)", "MEM")
def fn23(spark, d):
    written = F.concat(F.lit("["), F.replace(F.array_join("entities", ", "), F.lit(";"), F.lit("")), F.lit("]"))
    fixed = F.when(F.col("seq") % 3 == 0, F.lit("null")).otherwise(F.lit('["a", "b"]'))
    return _mem(spark, d).select("id", F.size(stores.list_field(written)).cast("long").alias("n"), F.size(stores.json_list_field(fixed)).cast("long").alias("fixed"))


@query("FN24_legacy_trust", "SELECT id, CASE WHEN len(source_sessions) + len(source_commits) > 0 AND (scope IN ('global', 'user') OR project IS NOT NULL) THEN 'trusted' ELSE 'unknown' END AS trust FROM mem", "MEM")
def fn24(spark, d):
    from .session_queries import _documents

    docs = stores.memory_markdown(_documents(spark, d)).select(F.col("id").alias("path"), F.regexp_replace("md", r"\ntrust: [a-z]+", "").alias("md"))
    return stores.memory_documents(docs).select("id", "trust")


@query("FN38_command_texts", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'ls -l' WHEN 1 THEN 'git \"a b\"' ELSE 'echo ' || turn END AS command FROM conversations WHERE role = 'assistant'")
def fn38(spark, d):
    t = F.col("turn")
    given = F.when(t % 3 == 0, F.lit('{"command":["bash","-lc","ls -l"]}')).when(t % 3 == 1, F.lit('{"cmd":["git","a b"]}')).otherwise(F.concat(F.lit('{"command":"echo '), t.cast("string"), F.lit('"}')))
    body = F.concat(F.lit('{"type":"response_item","payload":{"type":"function_call","name":"exec_command","call_id":"c'), t.cast("string"), F.lit('","arguments":'), F.substr(F.to_json(F.array(given)), F.lit(2), F.length(F.to_json(F.array(given))) - 2), F.lit("}}"))
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'")
    meta = rows.select("conv_id").distinct().select(F.concat(F.lit("/l/"), F.col("conv_id").cast("string")).alias("path"), F.lit(-1).alias("line_no"), F.lit('{"type":"session_meta","payload":{"id":"s"}}').alias("value"))
    lines = rows.select(F.concat(F.lit("/l/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line_no"), body.alias("value")).unionByName(meta.withColumn("line_no", F.col("line_no").cast("int")), allowMissingColumns=True)
    got = transcripts.parse_rollouts(lines)
    return got.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("conv_id"), F.substr(F.element_at("blocks", 1)["id"], F.lit(2)).cast("long").alias("turn"), F.element_at("blocks", 1)["command"].alias("command"))


@query("FN45_changed_fields", "SELECT id, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS n FROM mem", "MEM")
def fn45(spark, d):
    mem = _mem(spark, d)
    new = mem.withColumn("target_key", F.col("id")).withColumn("importance", F.when(F.col("seq") % 2 == 0, F.lit(99.0)).otherwise(F.col("importance")))
    return archive.changed_fields(new, mem, ["importance", "title"]).select("id", F.size("changes").cast("long").alias("n"))


@query("FN46_unchanged", "SELECT session_id, conv_id % 3 <> 0 AS same FROM sessions", "SESSIONS")
def fn46(spark, d):
    rows = view(spark, d, "SESSIONS")
    fresh = merge.changed_sessions(rows, rows.where("conv_id % 3 <> 0")).select("session_id", F.lit(False).alias("same"))
    return rows.select("session_id").join(fresh, "session_id", "left").select("session_id", F.coalesce("same", F.lit(True)).alias("same"))


@query("FN48_clean_pages", "SELECT id, regexp_replace(question, '[\\x00-\\x1F\\x{7F}-\\x{9F}]', ' ', 'g') AS question, len(tags) AS n FROM qa", "QA")
def fn48(spark, d):
    return pages.clean(view(spark, d, "QA"), ["tags"]).select("id", "question", F.size("tags").cast("long").alias("n"))


_LOOKUPS = [("src3", "/x"), ("nowhere", "/work/src3"), ("nowhere", "/none"), ("src4", "/work/src5"), ("root", "/work/src1")]


@query("JN14_resolve_project", f"SELECT slug, cwd, (SELECT arg_min(project, CASE WHEN project = slug THEN '0' ELSE '1' END || project) FROM sessions WHERE project = slug OR project_raw = cwd) AS project FROM (VALUES {', '.join(map(repr, _LOOKUPS))}) AS t(slug, cwd)", "SESSIONS")
def jn14(spark, d):
    found = [merge.resolve_project(view(spark, d, "SESSIONS"), *x).select(F.lit(x[0]).alias("slug"), F.lit(x[1]).alias("cwd"), "project") for x in _LOOKUPS]
    return reduce(DataFrame.unionByName, found)


@query("JN15_proposals", "SELECT m.id, CASE WHEN t.id IS NULL THEN 'null' ELSE t.status END AS before FROM mem m LEFT JOIN mem t ON t.id = m.supersedes WHERE m.supersedes IS NOT NULL AND CASE WHEN t.id IS NULL THEN 'null' ELSE t.status END <> m.status", "MEM")
def jn15(spark, d):
    mem = _mem(spark, d)
    rows = archive.changed_fields(mem.where("supersedes is not null").withColumn("target_key", F.col("supersedes")), mem, ["status"])
    return rows.where("size(changes) > 0").select("id", F.element_at("changes", 1)["before"].alias("before"))


@query("RNK13_hints", "SELECT id, '  ' || id || '  (' || archived_reason || ')  — ' || CASE WHEN length(c) > 120 THEN substr(c, 1, 119) || '…' ELSE c END || CASE WHEN coalesce(trust, 'unknown') = 'trusted' THEN '' ELSE ' (untrusted)' END || '  — memory-unarchive ''' || id || ''' to restore' AS line FROM (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS c FROM mem WHERE status = 'archived')", "MEM")
def rnk13(spark, d):
    return pages.hints(_mem(spark, d).where("status = 'archived'").withColumn("source", F.lit("local")))


@query("RNK13_next_step", "SELECT 'No ACTIVE memory matched, but archived entries did — see coldStorage — archived on device dev1; restore it there (memory-unarchive is local-only).' AS step")
def rnk13b(spark, d):
    return pages.next_step(_mem(spark, d).where("status = 'archived' and seq % 3 = 1").withColumn("source", F.lit("overlay")))


ORACLES["RNK09_unresolved"] = f"SELECT true AS resolved, count(*) AS n FROM ({BASE['RNK08_cold_pass']}) UNION ALL SELECT false, 0"


def _rnk09(spark, d):
    """Cold rows are counted where the project is known, and there are none where it isn't."""
    cold = lambda known: api.recall(_mem(spark, d), view(spark, d, "USAGE").limit(0), COLD, resolved=known)[1].agg(F.count("*").alias("n")).select(F.lit(known).alias("resolved"), "n")
    return cold(True).unionByName(cold(False))


QUERIES["RNK09_unresolved"] = _rnk09


@query("LNT17_human", f"SELECT '[warning] expired ' || id || ': active memory expired at validTo=' || valid_to || ' (now {NOW})' AS line FROM mem WHERE status = 'active' AND {_EXPIRED}", "MEM")
def lnt17(spark, d):
    return lint.human(lint.expired(_mem(spark, d), NOW)).select("line")


@query("LNT15_corrupt_index", "SELECT 'corrupt-index' AS \"check\", id AS layer, CASE seq % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'unknown version' WHEN 3 THEN 'entries is not an object' END AS detail FROM mem WHERE seq % 5 IN (1, 2, 3)", "MEM")
def lnt15(spark, d):
    r, entry = F.col("seq") % 5, F.concat(F.lit('{"a":'), F.to_json(F.struct("id", "title")), F.lit("}"))
    document = F.when(r == 0, F.concat(F.lit('{"version":1,"entries":'), entry, F.lit("}"))).when(r == 1, F.concat(F.lit('{"version":1,"entries":'), entry)).when(r == 2, F.concat(F.lit('{"version":2,"entries":'), entry, F.lit("}"))).when(r == 3, F.concat(F.lit('{"version":1,"entries":['), entry, F.lit("]}")))
    rows = _mem(spark, d).select(F.col("id").alias("layer"), stores.load_state(document).alias("s")).select("layer", "s.*")
    return lint.corrupt(rows).select("check", "layer", "detail")


@query("LCY06_07_review", "SELECT m.id, m.type IN ('core', 'procedural') OR m.status = 'pinned' OR coalesce(t.type IN ('core', 'procedural') OR t.status = 'pinned', false) AS gated FROM mem m LEFT JOIN mem t ON t.id = m.supersedes", "MEM")
def lcy06(spark, d):
    mem = _mem(spark, d)
    return archive.gate(mem, mem).select("id", "gated")


@query("LCY09_approve", "SELECT id, CASE WHEN seq = 7 THEN 'approved' ELSE title END AS title FROM mem", "MEM")
def lcy09(spark, d):
    mem = _mem(spark, d)
    queue = mem.where("seq in (7, 8)").withColumn("title", F.lit("approved")).withColumn("order", F.col("seq")).withColumn("supersedes", F.lit(None).cast("string")).withColumn("target_key", F.col("seq").cast("string"))
    return api.memory_approve(mem, queue, "7", NOW)[0].select("id", "title")


_ASKED = "trim(regexp_replace(regexp_replace(question, '[\\x00-\\x1F\\x{7F}-\\x{9F}]', ' ', 'g'), '[\\s\\x{00A0}\\x{FEFF}]+', ' ', 'g'))"


@query("LCY11_qa_write", f"SELECT DISTINCT scope, CASE WHEN starts_with(scope, 'project:') THEN substr(scope, 9) END AS project, {_ASKED} AS question, 'qa/' || CASE WHEN starts_with(scope, 'project:') THEN substr(scope, 9) ELSE '_global' END AS folder FROM qa", "QA")
def lcy11(spark, d):
    rows = pages.qa_writes(view(spark, d, "QA"), NOW).where("defect is null")
    return rows.select("scope", "project", "question", F.regexp_extract("id", "^(qa/[^/]+)/", 1).alias("folder")).distinct()


@query("LCY11_entity_write", "SELECT id, CASE WHEN p % 2 = 0 THEN 'new' ELSE title END AS title FROM (SELECT *, CAST(string_split(id, '/')[-1] AS BIGINT) AS p FROM entity)", "ENTITY")
def lcy11b(spark, d):
    rows = view(spark, d, "ENTITY")
    items = rows.withColumn("order", F.substring_index("id", "/", -1).cast("long")).where("order % 2 = 0").withColumn("title", F.lit("new"))
    return api.entity_write(rows, items, NOW).select("id", "title")


@query("SNK06_07_pages", "SELECT id, scope, project, lower(kind) AS kind, len(tags) AS n_tags, related_entities[1] AS first_entity FROM qa", "QA")
def snk07(spark, d):
    plain, quoted, lists = ["id", "scope", "kind", "updated_at"], ["project", "question", "answer_summary"], ["tags", "source_memory_ids", "related_entities"]
    rows = view(spark, d, "QA").withColumns({c: fn.collapsed(F.col(c)) for c in ("question", "answer_summary")}).withColumn("body", F.lit("b"))
    docs = pages.markdown(rows, plain, quoted, lists, "question").select(F.col("id").alias("path"), "md")
    return pages.parse(docs, plain, quoted, lists).select("id", "scope", "project", "kind", F.size("tags").cast("long").alias("n_tags"), F.element_at("related_entities", 1).alias("first_entity"))


@query("SNK10_payload", "SELECT id, title, importance FROM mem WHERE status = 'archived'", "MEM")
def snk10(spark, d):
    lines = api.payload(_mem(spark, d).where("status = 'archived'").select("id", "title", "importance"))
    return lines.select(F.from_json("value", "id string, title string, importance double").alias("v")).select("v.*")


@query("SRC06_prefer_state_logs", "SELECT session_id, conv_id % 3 = 0 AS state FROM sessions", "SESSIONS")
def src06(spark, d):
    rows = view(spark, d, "SESSIONS").withColumn("workspace", F.col("project"))
    pick = lambda of, state: of.select("workspace", "session_id", F.lit(state).alias("state"))
    return transcripts.prefer_state_logs(pick(rows.where("conv_id % 3 = 0"), True), pick(rows, False)).select("session_id", "state")


@query("SRC07_workspaces", "SELECT session_id, '/work/a b+c/' || conv_id AS folder FROM sessions", "SESSIONS")
def src07(spark, d):
    doc = F.concat(F.lit('{"folder":"file:///work/a%20b+c/'), F.col("conv_id").cast("string"), F.lit('"}'))
    return view(spark, d, "SESSIONS").select("session_id", transcripts.workspace_path(doc).alias("folder"))


@query("SRC35_proposals", "SELECT 'p' || seq AS proposal_id, id AS target_key FROM mem WHERE seq % 2 = 0", "MEM")
def src35(spark, d):
    doc = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"proposalId":"p'), F.col("seq").cast("string"), F.lit('","targetKey":"'), "id", F.lit('"}'))).otherwise("{")
    return stores.proposals(_mem(spark, d).select(F.col("id").alias("name"), doc.alias("value"))).select("proposal_id", "target_key")


@query("API_memory_query", "SELECT count(*) AS n FROM mem WHERE status <> 'archived' AND (status = 'superseded' OR supersedes IS NOT NULL OR valid_to IS NOT NULL)", "MEM")
def api_query(spark, d):
    return api.memory_query(_mem(spark, d), view(spark, d, "USAGE"), ASKED)[1].agg(F.count("*").alias("n"))


@query("API_prepare", "SELECT session_id, 0.1 AS insight FROM sessions WHERE project = 'src3' AND conv_id % 7 <> 0 AND NOT list_contains((SELECT list(DISTINCT s) FROM (SELECT unnest(source_sessions) AS s FROM mem WHERE type = 'episodic')), session_id)", "SESSIONS", "MEM")
def api_prepare(spark, d):
    rows = view(spark, d, "SESSIONS").withColumn("body", F.lit("## User\n\nfix it\n"))
    return api.prepare(rows, _mem(spark, d), view(spark, d, "SKIPS"), "src3").select("session_id", "signals.insight")


_DAY = "try_cast({x} AS DATE)"
_CLASH = f"""safe AS MATERIALIZED (SELECT l.* FROM mem l LEFT JOIN overlay o ON o.id = l.id WHERE NOT CASE WHEN o.id IS NULL THEN false WHEN {_DAY.format(x='o.updated_at')} IS NULL OR {_DAY.format(x='l.updated_at')} IS NULL THEN true
 WHEN {_DAY.format(x='o.updated_at')} <> {_DAY.format(x='l.updated_at')} THEN {_DAY.format(x='o.updated_at')} > {_DAY.format(x='l.updated_at')} ELSE l.status IS DISTINCT FROM o.status OR l.title IS DISTINCT FROM o.title END), """
ORACLES["API_memory_archive"] = _lambdas(with_views("MEM", "OVERLAY", "USAGE", "SESSIONS").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _CLASH + plan_sql("safe"))


@query("API_memory_archive")
def api_archive(spark, d):
    return api.memory_archive(_mem(spark, d), view(spark, d, "OVERLAY"), view(spark, d, "USAGE"), view(spark, d, "SESSIONS"), NOW, ["status", "title"])


@query("FN40_paths_to_projects", "SELECT path, CASE k WHEN 0 THEN 'work-src' || c WHEN 1 THEN 'lib-x' ELSE NULL END AS slug FROM (SELECT DISTINCT conv_id AS c, conv_id % 4 AS k, CASE conv_id % 4 WHEN 0 THEN '/work/src' || conv_id || '/a/b.py' WHEN 1 THEN '/w/lib/x/f' || conv_id WHEN 2 THEN '/usr/lib/f' || conv_id ELSE '/home/ann/f' || conv_id END AS path FROM conversations)")
def fn40(spark, d):
    c = F.col("conv_id").cast("string")
    k = F.col("conv_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/work/src"), c, F.lit("/a/b.py"))).when(k == 1, F.concat(F.lit("/w/lib/x/f"), c)).when(k == 2, F.concat(F.lit("/usr/lib/f"), c)).otherwise(F.concat(F.lit("/home/ann/f"), c))
    talk = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    roots = talk.where(k == 0).select(F.concat(F.lit("/work/src"), c).alias("root")).union(talk.limit(1).select(F.lit("/work")))
    return merge.projects_of_paths(talk.select(path.alias("path")), roots)


@query("FN44_snapshots", "SELECT id, substr('{\"id\":\"' || id || '\",\"type\":\"' || type || '\"}', 1, 120) AS shot FROM mem", "MEM")
def fn44(spark, d):
    return _mem(spark, d).select("id", stores.snapshot(F.struct("id", "type")).alias("shot"))


@query("SRC32_session_index", "SELECT 'claude:' || session_id AS key, 'raw/' || project || '/x.md' AS \"relativePath\", mtime_ms AS \"sourceMtimeMs\" FROM sessions WHERE conv_id % 5 <> 0", "SESSIONS")
def src32(spark, d):
    version = F.when(F.col("conv_id") % 5 == 0, "2").otherwise("1")
    doc = F.concat(F.lit('{"version":'), version, F.lit(',"entries":{"claude:'), "session_id", F.lit('":{"sessionId":"'), "session_id", F.lit('","relativePath":"raw\\\\'), "project", F.lit('\\\\x.md","sourceMtimeMs":'), F.col("mtime_ms").cast("string"), F.lit("}}}"))
    return stores.session_rows(view(spark, d, "SESSIONS").select(doc.alias("value"))).select("key", "relativePath", "sourceMtimeMs")


@query("SRC33_skip_ledger", "SELECT session_id, reason, \"at\" FROM skips", "SKIPS")
def src33(spark, d):
    doc = F.concat(F.lit('{"version":1,"sessions":{"'), "session_id", F.lit('":{"reason":"'), "reason", F.lit('","at":"'), "at", F.lit('"}}}'))
    rows = view(spark, d, "SKIPS").select(doc.alias("value"))
    return stores.skip_rows(rows.union(rows.limit(1).select(F.lit('{"version":1,"sessions":[]}'))))


@query("AGG14_gate_count", f"SELECT count(*) AS n FROM mem WHERE status NOT IN ('superseded', 'archived') AND NOT {_EXPIRED} AND (scope IN ('global', 'user') OR scope = 'project:src2') AND list_contains(source_files, 'src/f1.py')", "MEM")
def agg14(spark, d):
    return ranking.score_memories(_mem(spark, d), ranking.Query("", "src2", NOW, ["src/f1.py"])).agg(F.count_if(ranking.is_content_hit()).alias("n"))


@query("AGG08_tools", "SELECT 'Edit' AS name, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS n FROM conversations UNION ALL SELECT 'Bash', count(*) FILTER (role = 'assistant' AND turn % 4 = 1) FROM conversations")
def agg08(spark, d):
    from ..operators import digest
    from .session_queries import messages

    rows = digest.manifest(messages(spark, d)).select(F.explode("tools_used").alias("name", "n"))
    return rows.groupBy("name").agg(F.sum("n").alias("n"))
