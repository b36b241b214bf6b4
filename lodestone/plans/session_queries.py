"""Registered queries over transcripts, digests, documents and evidence, each beside its SQL for DuckDB.

Transcript files are built as lines from the conversations table, so that what a parser must
give back is known from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import aggregates, digest, evidence, merge
from ..sources import stores, transcripts
from ..sources.tables import spread
from .proxies import NOW, view, with_views
from .queries import Query, _lambdas

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (with_views(*views) if views else "") + _lambdas(sql)
        return f

    return add


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


#: Conversations as messages, with tool blocks on some of the assistant's turns.
def messages(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id").cast("string")
    none = F.lit(None).cast("string")
    block = lambda kind, **of: F.struct(F.lit(kind).alias("type"), *[of.get(n, none).alias(n) for n in ("text", "name", "input", "id", "path", "command", "patch")])
    edit = block("tool_use", name=F.lit("Edit"), path=F.concat(F.lit("/work/src"), c, F.lit("/f"), (t % 4).cast("string"), F.lit(".py")))
    commit = block("tool_use", name=F.lit("Bash"), command=F.concat(F.lit('git commit -m "turn '), t.cast("string"), F.lit('"')))
    some = F.when((F.col("role") == "assistant") & (t % 4 == 1), F.array(edit, commit)).when((F.col("role") == "assistant") & (t % 4 == 3), F.array(edit)).otherwise(F.array().cast(f"array<{transcripts.BLOCK}>"))
    return _talk(spark, d).select(c.alias("session_id"), t.cast("int").alias("pos"), "role", "text", none.alias("ts"), some.cast(f"array<{transcripts.BLOCK}>").alias("blocks"))


# Scalar functions of sessions ------------------------------------------------------------
def _rendered(spark, d):
    md = F.concat(F.lit("# t\n\n## User _(now)_\n\n"), "text", F.lit("\n\n## Assistant\n\nbecause the design\n\n## User\n\nfix the bug"))
    return _talk(spark, d).select("conv_id", "turn", md.alias("md"))


_MD = "(SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS first FROM conversations)"


@query("FN33_user_sections", f"SELECT conv_id, turn, first || '|fix the bug' AS texts FROM {_MD}")
def fn33(spark, d):
    return _rendered(spark, d).select("conv_id", "turn", F.array_join(fn.user_sections(F.col("md")), "|").alias("texts"))


def _signal_sql() -> str:
    hits = [f"list_sum(list_transform([{', '.join(repr(w) for w in words)}], w -> CASE WHEN contains(low, w) THEN 1 ELSE 0 END))" for words in fn.SIGNAL_WORDS.values()]
    kinds = " + ".join(f"CASE WHEN {h} > 0 THEN 1 ELSE 0 END" for h in hits)
    total = " + ".join(hits)
    return f"SELECT conv_id, turn, substr(trim(regexp_replace(first, '\\s+', ' ', 'g')), 1, 80) AS title, CAST(round(CASE WHEN {kinds} < 2 THEN 0.1 ELSE least(1.0, ({kinds}) / 5 * 0.4 + ({total}) / 15 * 0.3 + 0.3 * length(raw) / length(md)) END, 9) AS DOUBLE) AS insight FROM (SELECT *, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS low FROM (SELECT conv_id, turn, first, first || ' fix the bug' AS raw, '# t' || chr(10) || chr(10) || '## User _(now)_' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Assistant' || chr(10) || chr(10) || 'because the design' || chr(10) || chr(10) || '## User' || chr(10) || chr(10) || 'fix the bug' AS md FROM {_MD}))"


@query("FN35_signals", _signal_sql())
def fn35(spark, d):
    return _rendered(spark, d).select("conv_id", "turn", fn.session_signals(F.col("md")).alias("s")).select("conv_id", "turn", "s.title", F.round("s.insight", 9).alias("insight"))


@query("FN34_own_sessions", "SELECT conv_id, turn, conv_id % 3 = 0 AS own FROM conversations")
def fn34(spark, d):
    x = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("/lodestone "), "text")).otherwise(F.col("text"))
    return _talk(spark, d).select("conv_id", "turn", fn.is_own_session(x).alias("own"))


@query("FN37_commits", "SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'v1.' || turn ELSE CASE turn % 4 WHEN 2 THEN NULL ELSE '' END END AS sha, CASE turn % 4 WHEN 0 THEN 'turn ' || turn WHEN 1 THEN 'head ' || turn WHEN 3 THEN 'tag v1.' || turn END AS msg FROM conversations")
def fn37(spark, d):
    t = F.col("turn").cast("string")
    cmd = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("cd x && git commit -a -m 'turn "), t, F.lit("'"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("git commit -m \"$(cat <<'EOF'\nhead "), t, F.lit('\n\nbody\nEOF\n)"'))).when(F.col("turn") % 4 == 2, F.lit("git status")).otherwise(F.concat(F.lit("git tag v1."), t))
    return _talk(spark, d).select("conv_id", "turn", fn.commit_of(cmd).alias("c")).select("conv_id", "turn", "c.sha", "c.msg")


@query("FN39_patch_paths", "SELECT conv_id, turn, 'a/' || conv_id || '.py b/' || turn || '.py' AS paths FROM conversations")
def fn39(spark, d):
    patch = F.concat(F.lit("*** Begin\n*** Update File: a/"), F.col("conv_id").cast("string"), F.lit(".py\n@@\n-x\n*** Move to: b/"), F.col("turn").cast("string"), F.lit(".py\n*** End"))
    return _talk(spark, d).select("conv_id", "turn", F.array_join(fn.patch_paths(patch), " ").alias("paths"))


@query("FN41_command_paths", "SELECT conv_id, turn, '/work/a' || conv_id || '.py' AS paths FROM conversations")
def fn41(spark, d):
    cmd = F.concat(F.lit("cat /work/a"), F.col("conv_id").cast("string"), F.lit(".py && curl https://x.org/p/q /t"))
    return _talk(spark, d).select("conv_id", "turn", F.array_join(F.filter(fn.command_paths(cmd), lambda p: ~p.startswith("//")), " ").alias("paths"))


@query("FN18_display", "SELECT conv_id, turn, CASE WHEN length(c) > 120 THEN substr(c, 1, 119) || '…' ELSE c END AS shown FROM (SELECT conv_id, turn, trim(regexp_replace('a ' || text, '\\s+', ' ', 'g')) AS c FROM conversations)")
def fn18(spark, d):
    x = F.concat(F.lit("\x1b[31ma\x1b[0m\x07 \x1b]0;title\x07"), "text")
    return _talk(spark, d).select("conv_id", "turn", fn.for_display(x).alias("shown"))


@query("FN19_restore", "SELECT id, CASE WHEN seq % 3 = 0 THEN 'memory-unarchive ''' || id || ''' to restore' WHEN seq % 3 = 1 THEN 'archived on device ' || origin_device || '; restore it there' ELSE 'origin unknown; restore it on the device that archived it' END AS hint FROM mem", "MEM")
def fn19(spark, d):
    source = F.when(F.col("seq") % 3 == 0, "local").when(F.col("seq") % 3 == 1, "overlay")
    return view(spark, d, "MEM").select("id", fn.restore_instruction(F.col("id"), source, F.col("origin_device")).alias("hint"))


@query("FN42_branch_names", "SELECT session_id, 'My-Host.' || conv_id AS branch FROM sessions", "SESSIONS")
def fn42(spark, d):
    return view(spark, d, "SESSIONS").select("session_id", fn.branch_name(F.concat(F.lit("-My Host.."), F.col("conv_id").cast("string"), F.lit(".lock"))).alias("branch"))


# Digests --------------------------------------------------------------------------------
@query("AGG07_manifest", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS edits, count(DISTINCT turn % 4) FILTER (role = 'assistant' AND turn % 2 = 1) AS files, count(*) FILTER (role = 'assistant' AND turn % 4 = 1) AS commits FROM conversations GROUP BY conv_id")
def agg07(spark, d):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    rows = digest.manifest(messages(spark, d))
    return rows.select("session_id", "user_turns", "assistant_turns", F.coalesce(F.try_element_at("tools_used", F.lit("Edit")), F.lit(0)).cast("long").alias("edits"), size("files_touched").alias("files"), size("commits").alias("commits"))


@query("AGG09_contents", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number AS BIGINT) AS turn, markers FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_number, CASE WHEN role = 'user' AND length(text) >= 50 THEN '🧑' WHEN role = 'assistant' AND turn % 4 = 1 THEN '💾✏️' WHEN role = 'assistant' AND turn % 4 = 3 THEN '✏️' WHEN role = 'assistant' AND length(text) >= 200 THEN '🤖' ELSE '' END AS markers FROM conversations) WHERE markers <> ''")
def agg09(spark, d):
    return digest.contents(messages(spark, d)).select("session_id", F.col("turn").cast("long").alias("turn"), "markers")


@query("AGG10_infer_project", "SELECT session_id, CASE WHEN n >= 5 AND top * 1.0 / n >= 0.7 THEN 'work-src' || session_id END AS project, n AS total_hits FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n, greatest(count(*) FILTER (turn % 5 <> 0), count(*) FILTER (turn % 5 = 0)) AS top FROM conversations GROUP BY conv_id)")
def agg10(spark, d):
    path = F.when(F.col("turn") % 5 == 0, F.lit("/data/other")).otherwise(F.concat(F.lit("/work/src"), F.col("conv_id").cast("string")))
    hits = _talk(spark, d).select(F.col("conv_id").cast("string").alias("session_id"), fn.project_slug_of_path(path).alias("slug"), F.col("turn").alias("pos"))
    return aggregates.infer_project(hits).select("session_id", "project", "total_hits")


_BLOCKS = """said AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, text, role = 'assistant' AND turn % 4 = 1 AS commits, role = 'assistant' AND turn % 4 IN (1, 3) AS edits,
  '### 🔧 tool_use: Edit' || chr(10) || chr(10) || '```json' || chr(10) || '/work/src' || conv_id || '/f' || turn % 4 || '.py' || chr(10) || '```' AS edit,
  '### 🔧 tool_use: Bash' || chr(10) || chr(10) || '```json' || chr(10) || 'git commit -m "turn ' || turn || '"' || chr(10) || '```' AS tool FROM conversations),
 blocks AS (SELECT *, '## ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || chr(10) || chr(10) || body AS block FROM (SELECT *, CASE WHEN commits THEN edit || chr(10) || chr(10) || tool WHEN edits THEN edit ELSE text END AS body FROM said) WHERE trim(body) <> ''),
 placed AS (SELECT *, 1 + coalesce(sum(len(string_split(block, chr(10))) + 1) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM blocks),
 marked AS (SELECT *, CASE WHEN role = 'user' AND length(text) >= 50 THEN '🧑' ELSE '' END || CASE WHEN commits THEN '💾' ELSE '' END || CASE WHEN edits THEN '✏️' ELSE '' END || CASE WHEN role = 'assistant' AND length(text) >= 200 AND NOT edits THEN '🤖' ELSE '' END AS markers, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM placed),
 table_rows AS (SELECT session_id, turn, '| ' || turn || ' | — | ' || markers || ' | ' || replace(CASE WHEN length(flat) > 100 THEN substr(flat, 1, 99) || '…' ELSE flat END, '|', chr(92) || '|') || ' | →L' || CAST(line AS BIGINT) || ' |' AS cell FROM marked WHERE markers <> ''),
 toc AS (SELECT session_id, '# Table of Contents' || chr(10) || chr(10) || '| # | Time | Marker | Preview | Line |' || chr(10) || '|---|------|--------|---------|------|' || chr(10) || string_agg(cell, chr(10) ORDER BY turn) AS toc FROM table_rows GROUP BY session_id),
 bodies AS (SELECT session_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS body FROM blocks GROUP BY session_id)"""


@query("SNK02_render", f"WITH {_BLOCKS} SELECT session_id, concat_ws(chr(10) || chr(10), toc, body) AS markdown FROM bodies LEFT JOIN toc USING (session_id)")
def snk02(spark, d):
    return digest.render(messages(spark, d))


_BYTES = "octet_length(encode(text))"
_KB = f"(({_BYTES} * 20 + 1024) // 2048) // 10 || '.' || (({_BYTES} * 20 + 1024) // 2048) % 10"
_LINES = "string_split(text, chr(10))"


@query("SNK04_shortened", f"""SELECT doc_id, CASE WHEN {_BYTES} <= 20480 THEN text WHEN len({_LINES}) <= 50 THEN substr(text, 1, 4000) || chr(10) || chr(10) || '[... truncated: ' || {_KB} || ' KB total, showing first 4000 + last 1000 chars ...]' || chr(10) || chr(10) || right(text, 1000)
 ELSE array_to_string({_LINES}[:30], chr(10)) || chr(10) || chr(10) || '[... truncated: ' || {_KB} || ' KB output, omitting ' || (len({_LINES}) - 40) || ' middle lines ...]' || chr(10) || chr(10) || array_to_string({_LINES}[-10:], chr(10)) END AS shown FROM documents""")
def snk04(spark, d):
    return spread(spark, f"{d}/documents.parquet").select("doc_id", fn.shortened(F.col("text")).alias("shown"))


@query("SNK05_yaml", "SELECT id, CASE WHEN regexp_full_match(title, '[A-Za-z0-9_\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F} -]+') AND title = trim(title, ' ') THEN title ELSE '''' || replace(title, '''', '''''') || '''' END AS quoted FROM mem", "MEM")
def snk05(spark, d):
    return view(spark, d, "MEM").select("id", fn.quoted_for_yaml(F.col("title")).alias("quoted"))


@query("SNK08_paths", "SELECT session_id, 'raw_sessions/claude/' || project || '/' || ended_at || '/talk__' || session_id || '.md' AS path FROM sessions", "SESSIONS")
def snk08(spark, d):
    return view(spark, d, "SESSIONS").select("session_id", digest.path_of(F.lit("claude"), F.col("project"), F.col("ended_at"), F.lit("talk"), F.col("session_id")).alias("path"))


@query("SNK09_superseded_renders", "SELECT 'old/' || session_id AS path FROM sessions WHERE conv_id % 4 = 0", "SESSIONS")
def snk09(spark, d):
    rows = view(spark, d, "SESSIONS")
    index = rows.select("session_id", F.concat(F.lit("old/"), "session_id").alias("path"))
    return merge.superseded_renders(index, rows.where("conv_id % 4 = 0").select("session_id", F.concat(F.lit("new/"), "session_id").alias("path")))


# Documents and indexes -------------------------------------------------------------------
def _documents(spark, d):
    mem = view(spark, d, "MEM")
    flat = F.trim(F.regexp_replace(fn.control_free(F.col("title")), ":", ";"))
    rows = mem.select("id", "type", "scope", "project", flat.alias("title"), F.lit("s").alias("summary"), "status", "confidence", "importance", F.lit("2026-01-01").alias("createdAt"), F.col("updated_at").alias("updatedAt"), F.lit(None).cast("string").alias("validFrom"), F.col("valid_to").alias("validTo"), "supersedes", F.col("origin_device").alias("originDevice"), F.lit(None).cast("string").alias("archivedAt"), F.col("archived_reason").alias("archivedReason"), F.col("source_sessions").alias("sourceSessions"), F.col("source_commits").alias("sourceCommits"), F.col("source_files").alias("sourceFiles"), F.array().cast("array<string>").alias("entities"), F.coalesce("trust", F.lit("unknown")).alias("trust"), F.lit("the body").alias("body"), "seq")
    return rows


@query("FN26_documents", "SELECT id, type, scope, project, status, confidence, importance, updated_at, valid_to, supersedes, array_to_string(source_sessions, ' ') AS sources, coalesce(trust, 'unknown') AS trust FROM mem", "MEM")
def fn26(spark, d):
    docs = stores.memory_markdown(_documents(spark, d)).select(F.col("id").alias("path"), "md")
    return stores.memory_documents(docs).select("id", "type", "scope", "project", "status", "confidence", "importance", F.col("updatedAt").alias("updated_at"), F.col("validTo").alias("valid_to"), "supersedes", F.array_join("sourceSessions", " ").alias("sources"), "trust")


@query("FN25_frontmatter", "SELECT id, seq % 3 = 0 AS readable FROM mem", "MEM")
def fn25(spark, d):
    docs = stores.memory_markdown(_documents(spark, d)).join(view(spark, d, "MEM").select("id", "seq"), "id")
    twice = F.regexp_replace("md", "(?m)^type: .*$", "$0\n$0")
    closed = F.regexp_replace("md", "\n---\n\n#", "\n---\nmore\n---\n\n#")
    md = F.when(F.col("seq") % 3 == 0, F.col("md")).when(F.col("seq") % 3 == 1, twice).otherwise(closed)
    return docs.select("id", stores.frontmatter(md).isNotNull().alias("readable"))


@query("FN27_LCY13_rebuild", "SELECT count(*) FILTER (seq % 5 <> 2) AS indexed, count(*) FILTER (seq % 5 = 1) AS healed, count(*) FILTER (seq % 5 = 2) AS skipped FROM mem", "MEM")
def lcy13(spark, d):
    docs = stores.memory_markdown(_documents(spark, d)).join(view(spark, d, "MEM").select("id", "seq"), "id")
    md = F.when(F.col("seq") % 5 == 1, F.regexp_replace("md", "(?m)^importance: .*$", "importance: undefined")).when(F.col("seq") % 5 == 2, F.lit("# no head")).otherwise(F.col("md"))
    return stores.rebuild(docs.select(F.col("id").alias("path"), md.alias("md")), NOW)[1]


@query("FN49_bodies", "SELECT id, 'the body' AS body FROM mem", "MEM")
def fn49(spark, d):
    return stores.memory_markdown(_documents(spark, d)).select("id", stores.body_of(F.col("md")).alias("body"))


@query("FN50_set_field", "SELECT id, 'pinned' AS status, 'x' AS added FROM mem", "MEM")
def fn50(spark, d):
    md = stores.set_field(stores.set_field(F.col("md"), "status", "pinned"), "extra", "x")
    return stores.memory_markdown(_documents(spark, d)).select("id", stores.frontmatter(md).alias("fm")).select("id", F.col("fm")["status"].alias("status"), F.col("fm")["extra"].alias("added"))


def _index(spark, d):
    entry = F.to_json(F.struct("id", "type", "scope", "status", "title", "summary", "importance", F.col("source_sessions").alias("sourceSessions"), F.col("source_files").alias("sourceFiles"), F.col("source_commits").alias("sourceCommits"), "entities"))
    bad = F.regexp_replace(entry, r'"importance":[0-9.]+', '"importance":"3"')
    entry = F.when(F.col("seq") % 7 == 3, bad).otherwise(entry)
    rows = view(spark, d, "MEM").select(F.concat(F.lit('{"version":1,"entries":{'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(":"), entry, F.lit("}}")).alias("value"), "seq")
    return rows


@query("SRC30_31_index", "SELECT id, type, CASE WHEN seq % 7 = 3 THEN NULL ELSE importance END AS importance, len(source_sessions) AS n_sessions FROM mem", "MEM")
def src30(spark, d):
    return stores.memory_rows(stores.entries(_index(spark, d))).select("id", "type", "importance", F.size("sourceSessions").cast("long").alias("n_sessions"))


@query("FN47_rewrite_defect", "SELECT id AS key, CASE WHEN seq % 4 = 1 THEN 'status' END AS defect FROM mem", "MEM")
def fn47(spark, d):
    broken = _index(spark, d)
    value = F.when(F.col("seq") % 4 == 1, F.regexp_replace("value", '"status":"[a-z]+"', '"status":5')).otherwise(F.col("value"))
    return stores.rewrite_defect(stores.memory_rows(stores.entries(broken.select(value.alias("value")))))


@query("SRC34_usage", "SELECT id, greatest(floor(n) - 3, 0) AS n FROM usage", "USAGE")
def src34(spark, d):
    rows = view(spark, d, "USAGE")
    doc = F.concat(F.lit("{"), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(':{"count":'), (F.col("n") - 2.5).cast("string"), F.lit('},"bad":{"count":"3"}}'))
    return stores.usage_rows(rows.select(doc.alias("value"))).select("id", "n")


# Transcripts ----------------------------------------------------------------------------
def _lines(rows: DataFrame, value) -> DataFrame:
    return rows.select(F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.col("turn").alias("line_no"), value.alias("value"))


_KEPT = "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10"
_TEXT = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("SRC03_05_line_logs", f"SELECT 's-' || conv_id AS session_id, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND turn % 9 <> 8 AND {_KEPT}")
def src03(spark, d):
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("<system-reminder>x</system-reminder>"), "text").alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))))
    value = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"s-'), F.col("conv_id").cast("string"), F.lit('","cwd":"/work/x","isMeta":'), F.when(F.col("turn") % 9 == 8, "true").otherwise("false"), F.lit(',"timestamp":"2026-01-01T00:00:00Z","message":'), content, F.lit("}"))
    return transcripts.parse_lines(_lines(_talk(spark, d), value)).select("session_id", "role", "text")


@query("SRC09_11_state_logs", f"SELECT 'c' || conv_id AS session_id, 'Talk ' || conv_id AS title, {_TEXT} AS text FROM conversations WHERE {_KEPT}")
def src09(spark, d):
    text = F.to_json(F.struct(F.struct("text").alias("message"))).substr(F.lit(1), F.lit(1 << 30))
    c = F.col("conv_id").cast("string")
    seed = F.concat(F.lit('{"kind":0,"v":{"sessionId":"c'), c, F.lit('","customTitle":"old","requests":['), text, F.lit("]}}"))
    add = F.concat(F.lit('{"kind":2,"k":["requests"],"v":['), text, F.lit("]}"))
    rows = _talk(spark, d)
    last = rows.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("value", F.concat(F.lit('{"kind":1,"k":["customTitle"],"v":" Talk '), c, F.lit('"}')))
    lines = _lines(rows, F.when(F.col("turn") == 0, seed).otherwise(add)).unionByName(_lines(last, F.col("value")))
    return transcripts.parse_state_logs(lines).select("session_id", "title", "text")


@query("SRC12_event_logs", f"SELECT 'e' || conv_id AS session_id, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_KEPT}")
def src12(spark, d):
    rows = _talk(spark, d)
    c = F.col("conv_id").cast("string")
    value = F.concat(F.lit('{"type":"'), "role", F.lit('.message","data":'), F.to_json(F.struct(F.col("text").alias("content"))), F.lit("}"))
    start = rows.where("turn = 0").withColumn("turn", F.lit(-1)).withColumn("value", F.concat(F.lit('{"type":"session.start","data":{"sessionId":"e'), c, F.lit('"}}')))
    return transcripts.parse_event_logs(_lines(rows, value).unionByName(_lines(start, F.col("value")))).select("session_id", "role", "text")


@query("SRC15_27_rollouts", f"SELECT 'r' || conv_id AS session_id, role, {_TEXT} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_TEXT} <> '' AND conv_id % 5 <> 0")
def src15(spark, d):
    rows = _talk(spark, d)
    c = F.col("conv_id").cast("string")
    shown = F.concat(F.lit('{"type":"event_msg","payload":{"type":"'), F.when(F.col("role") == "user", "user_message").otherwise("agent_message"), F.lit('",'), F.to_json(F.struct(F.col("text").alias("message"))).substr(F.lit(2), F.lit(1 << 30)), F.lit("}"))
    reply = F.concat(F.lit('{"type":"response_item","payload":{"type":"message","role":"'), "role", F.lit('","content":'), F.to_json(F.array(F.struct("text"))), F.lit("}}"))
    talk = rows.where("role in ('user', 'assistant')")
    meta = rows.where("turn = 0").withColumn("value", F.concat(F.lit('{"type":"session_meta","payload":{"id":"r'), c, F.lit('","cwd":"/work/x","originator":"'), F.when(F.col("conv_id") % 5 == 0, "codex_exec").otherwise("cli"), F.lit('"}}')))
    two = _lines(talk.withColumn("turn", F.col("turn") * 2 + 1), shown).unionByName(_lines(talk.withColumn("turn", F.col("turn") * 2 + 2), reply))
    return transcripts.parse_rollouts(two.unionByName(_lines(meta, F.col("value")))).select("session_id", "role", "text")


@query("SRC14_titles", "SELECT CAST(conv_id AS VARCHAR) AS session_id, 'title ' || max(turn) AS title FROM conversations GROUP BY conv_id")
def src14(spark, d):
    value = F.concat(F.lit('{"id":"'), F.col("conv_id").cast("string"), F.lit('","thread_name":"title '), F.col("turn").cast("string"), F.lit('"}'))
    return transcripts.title_map(_lines(_talk(spark, d), value))


@query("SRC26_rollout_texts", f"SELECT 'r' || conv_id AS session_id, {_TEXT} AS text FROM conversations WHERE role = 'user' AND turn % 5 IN (0, 2, 4) AND {_TEXT} <> ''")
def src26(spark, d):
    """Injected parts go; a text that still opens with one isn't the user's."""
    t = F.col("turn") % 5
    text = F.when(t == 0, F.concat(F.lit("<personality_spec>be kind</personality_spec>\n<token_budget n=\"1\">9</token_budget>"), "text")).when(t == 1, F.concat(F.lit(" <goal_context>left open "), "text")).when(t == 2, F.concat(F.lit("<external_note id=\"1\">x\ny</external_note>"), "text", F.lit("<external_end/>"))).when(t == 3, F.concat(F.lit("<external_open "), "text")).otherwise(F.col("text"))
    rows = _talk(spark, d).where("role = 'user'")
    said = F.concat(F.lit('{"type":"event_msg","payload":{"type":"user_message",'), F.to_json(F.struct(text.alias("message"))).substr(F.lit(2), F.lit(1 << 30)), F.lit("}"))
    meta = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("turn"), F.concat(F.lit('{"type":"session_meta","payload":{"id":"r'), F.col("conv_id").cast("string"), F.lit('","cwd":"/work/x"}}')).alias("value"))
    return transcripts.parse_rollouts(_lines(rows, said).unionByName(_lines(meta, F.col("value")))).select("session_id", "text")


@query("SRC27_sessions", "SELECT conv_id || '-aaaa-' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS session_id, substr(lpad(CAST(conv_id AS VARCHAR), 9, '0'), 2) AS short_id, CASE conv_id % 4 WHEN 0 THEN 'talk ' || conv_id WHEN 1 THEN 'asked ' || conv_id ELSE 'asked ' || conv_id END AS display_name FROM (SELECT DISTINCT conv_id FROM conversations)")
def src27(spark, d):
    """Short ids are the end of the id; titles of the map count once cleaned, else the first text does."""
    c = F.col("conv_id").cast("string")
    sid = F.concat(c, F.lit("-aaaa-"), F.lpad(c, 9, "0"))
    rows = _talk(spark, d).select("conv_id").distinct()
    row = lambda n, value: rows.select("conv_id", F.lit(n).alias("turn"), value.alias("value"))
    lines = row(0, F.concat(F.lit('{"type":"session_meta","payload":{"id":"'), sid, F.lit('","cwd":"/work/x"}}'))).unionByName(row(1, F.concat(F.lit('{"type":"event_msg","payload":{"type":"user_message","message":"asked '), c, F.lit('"}}'))))
    title = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("<skill>s</skill> talk "), c)).when(F.col("conv_id") % 4 == 1, F.lit("<odd tag")).when(F.col("conv_id") % 4 == 2, F.lit("Base directory for this skill: /x")).otherwise(F.lit("<goal_context x"))
    titles = transcripts.title_map(_lines(row(0, F.to_json(F.struct(sid.alias("id"), title.alias("thread_name")))), F.col("value")))
    return transcripts.sessions_of(transcripts.parse_rollouts(_lines(lines, F.col("value"))), titles, rollouts=True).select("session_id", "short_id", "display_name")


@query("SRC18_one_file", "SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN 'a/' ELSE 'b/' END || session_id AS path FROM sessions", "SESSIONS")
def src18(spark, d):
    rows = view(spark, d, "SESSIONS")
    a = rows.select("session_id", F.concat(F.lit("a/"), "session_id").alias("path"), (F.col("conv_id") % 4 == 0).alias("active"), F.lit(1.0).alias("mtime_ms"))
    b = rows.select("session_id", F.concat(F.lit("b/"), "session_id").alias("path"), F.lit(False).alias("active"), F.when(F.col("conv_id") % 2 == 0, 1.0).otherwise(2.0).alias("mtime_ms"))
    return transcripts.one_file_per_session(a.unionByName(b)).select("session_id", "path")


# Evidence -------------------------------------------------------------------------------
#: Shell texts around a number n, whether they succeeded, and whether they surely changed files.
_COMMANDS = [
    ("git commit -m 'a {n}'", True, True), ("git commit --dry-run -m x{n}", True, False), ("cd x{n} && git commit -m x", True, True), ("cd x && git commit -m x{n}; ls", True, False),
    ("cat > f{n}.txt <<EOF\nhi\nEOF\n", True, True), ("cat {n} > /dev/null", True, False), ("echo {n} | cat > f", True, False), ("sed -i s/a/{n}/ f", True, True), ("sed s/a/{n}/ f", True, False),
    ("python3 -c \"open('f{n}', 'w').write('x')\"", True, True), ("python3 - <<'E'\nfrom pathlib import Path\nPath('f{n}').write_text('x')\nE\n", True, True), ("python3 -c \"def f{n}():\n  open('f','w')\"", True, False),
    ("if test {n}; then git commit -m x; fi", True, False), ("git commit -m {n} &", True, False), ("false || git commit -m {n}", True, False), ("exit {n}; git commit -m x", True, False), ("git commit -m {n}", False, True), ("ls {n}; git commit -m x", False, False), ("echo {n}", True, False),
    ("git commit -m --help -F {n}", True, True), ("git commit -m {n} -- --dry-run", True, True), ("git --verbose commit -m {n}", True, False), ("git -C commit{n}", True, False), ("echo \"$(a \"b {n}(c\")\"; git commit -m x", True, True), ("echo $(a (b {n})); git commit -m x", True, True), ("git commit -m $(date {n})", True, False), ("sed -i -z s/a/{n}/ f", True, False), ("cat f{n} 2>g", True, False),
    ("A={n}\ncat > f", True, True), ("set -euo pipefail\ncat >> f{n}", True, True), ("set -o vi; cat > f{n}", True, False), ("make {n} && cat > f && git commit -m x", True, True), ("make {n} && cat > f | tee g", True, False), ("make {n} || true; make && git commit -m x;", True, True), ("python3 - <<E\nopen('$f{n}', 'w')\nE", True, False), ("python3 -c \"with open('{n}', mode='a') as f: pass\"", True, True),
    ("sed -i '' -e s/a/{n}/ f", True, True), ("sed -i -- s/a/{n}/ f", True, False), ("cat > 'f{n}", True, False), ("f{n}() { cat > x; }", True, False), ("exec make {n}; cat > f", True, False), ("git -C /w{n} --no-pager commit -am x", True, True), ("cat {n} >&2", True, False), ("# {n}\ngit commit -m x", True, True), ("cat > f{n} && ls", False, True), ("python{n} -c \"open('f', 'w')\"", True, False),
]


def _made(spark, d: str, shapes: list[tuple[str, bool, bool]]) -> DataFrame:
    """(conv_id, turn, command, ok): a shell text for each row of the conversations, the shapes in turn."""
    n = F.concat(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    text, ok = F.lit(None).cast("string"), F.lit(True)
    at = (F.col("conv_id") + F.col("turn")) % len(shapes)
    for i, (made, good, _) in enumerate(shapes):
        text, ok = F.when(at == i, F.replace(F.lit(made), F.lit("{n}"), n)).otherwise(text), F.when(at == i, F.lit(good)).otherwise(ok)
    return _talk(spark, d).select("conv_id", "turn", text.alias("command"), ok.alias("ok"))


def _known(shapes: list[tuple[str, bool, bool]]) -> str:
    return f"CASE (conv_id + turn) % {len(shapes)} " + " ".join(f"WHEN {i} THEN {str(m).lower()}" for i, (*_, m) in enumerate(shapes)) + " END"


@query("EVD06_08_shell", f"SELECT conv_id, turn, {_known(_COMMANDS)} AS mutation FROM conversations")
def evd06(spark, d):
    rows = _made(spark, d, _COMMANDS)
    return rows.join(evidence.shell_evidence(rows), ["command", "ok"]).select("conv_id", "turn", "mutation")


#: Shell texts around a number n, whether each changes files, and the text for DuckDB.
_MADE = [
    ("git commit -m 'turn {n}'", True), ("git commit --dry-run -m 'turn {n}'", False), ("cd /w/{n} && git -C a commit -F note{n}", True), ("git --odd{n} commit -m x", False),
    ("cat > f{n} <<'E'\nline {n}\nE", True), ("cat f{n} 2> g", False), ("sed -i 's/a/{n}/' f", True), ("sed 's/a/{n}/' f", False), ("python3 -c \"open('f{n}', 'w')\"", True), ("python3 -c \"if {n}: open('f', 'w')\"", False),
    ("echo \"$(a {n} \"(\")\"; git commit -m {n}", True), ("echo {n} | git commit -F -", False), ("false || git commit -m {n}", False),
]


@query("EVD07_made_commands", f"SELECT conv_id, turn, CASE turn % {len(_MADE)} " + " ".join(f"WHEN {i} THEN {str(m).lower()}" for i, (_, m) in enumerate(_MADE)) + " END AS mutation FROM conversations")
def evd07(spark, d):
    n = F.concat(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    text = F.lit(None).cast("string")
    for i, (made, _) in enumerate(_MADE):
        text = F.when(F.col("turn") % len(_MADE) == i, F.replace(F.lit(made), F.lit("{n}"), n)).otherwise(text)
    rows = _talk(spark, d).select("conv_id", "turn", text.alias("command"), F.lit(True).alias("ok"))
    return rows.join(evidence.shell_evidence(rows), ["command", "ok"]).select("conv_id", "turn", "mutation")


#: What a session did after its last request (call and result, by name of the field), and whether the gate blocks.
_REPORT = '{"paths":["m.md"],"written":1,"superseded":0}'
_TURNS: list[tuple[dict, dict, bool]] = [
    ({"name": "Edit"}, {"error": False}, True),
    ({"name": "Bash", "command": "git commit -m x"}, {"error": False, "exit_code": 0}, True),
    ({"name": "Skill", "skill": "x:x-retro"}, {"error": False}, False),
    ({"name": "Edit"}, {"error": True}, False),
    ({"name": "Bash", "command": "git commit -m x"}, {"error": False, "exit_code": 1}, True),
    ({"name": "Bash", "command": "make; git commit -m x"}, {"error": False, "exit_code": 1}, False),
    ({"name": "Write"}, {"error": False, "denied": True}, False),
    ({"name": "Write"}, {"error": True, "output": "The user doesn't want to proceed"}, False),
    ({"name": "Bash", "command": "git commit -m x", "background": True}, {"error": False}, False),
    ({"name": "Bash", "command": "git commit -m x", "background": True}, {"error": False, "exit_code": 0}, True),
    ({"name": "Bash", "command": "make", "committed": True}, {"error": False, "committed": True}, True),
    ({"name": "Read"}, {"error": False}, False),
    ({"name": "NotebookEdit"}, {"error": False, "interrupted": True}, False),
    ({"name": "MultiEdit"}, {"error": False}, True),
]
#: What it did besides a file that it changed; the gate stays open where that is a capture, or one that was refused.
_BESIDES: list[tuple[dict, dict, bool]] = [
    ({"name": "Read"}, {"error": False}, True),
    ({"name": "Bash", "command": "lodestone memory-write --input x"}, {"error": False, "exit_code": 0, "output": _REPORT}, False),
    ({"name": "Bash", "command": "lodestone memory-write --input x"}, {"error": False, "exit_code": 0, "output": '{"paths":["m.md"],"written":0,"superseded":0}'}, True),
    ({"name": "Bash", "command": "lodestone memory-write --input x"}, {"error": False, "exit_code": 0, "output": "done"}, True),
    ({"name": "Bash", "command": "echo lodestone memory-write"}, {"error": False, "exit_code": 0, "output": _REPORT}, True),
    ({"name": "Bash", "command": "lodestone memory-propose --input x"}, {"error": False, "exit_code": 0, "output": '{"paths":["p.md"],"proposed":1,"targetKeys":["k"],"proposedEntryIds":["e"]}'}, False),
    ({"name": "Bash", "command": "lodestone memory-propose --input x"}, {"error": False, "exit_code": 0, "output": '{"paths":["p.md"],"proposed":1,"targetKeys":[""],"proposedEntryIds":["e"]}'}, True),
    ({"name": "Bash", "command": "lodestone memory-write --input x"}, {"error": True, "denied": True}, False),
    ({"name": "Skill", "skill": "a-retro"}, {"error": False}, False),
    ({"name": "Skill", "skill": "a-retro"}, {"error": True}, True),
    ({"name": "Skill", "skill": "a-retro"}, {"interrupted": True}, False),
    ({"name": "Skill", "skill": "retro-x"}, {"error": False}, True),
]
_ROW = {"call_id": "string", "name": "string", "command": "string", "skill": "string", "error": "boolean", "interrupted": "boolean", "denied": "boolean", "output": "string", "committed": "boolean", "exit_code": "int", "background": "boolean"}


def _gated(spark, d: str, turns: list[tuple[dict, dict, bool]], more: tuple[dict, dict] | None = None) -> DataFrame:
    """Rows of a session for each conversation: an edit, a request, and then one of ``turns`` (and ``more``)."""

    def row(idx: int, kind: str, of: dict):
        return F.struct(F.lit(idx).alias("idx"), F.lit(kind).alias("kind"), *[F.lit(of.get(n)).cast(t).alias(n) for n, t in _ROW.items()])

    def calls(at: int, turn: tuple[dict, dict]):
        return [row(at, "call", {"call_id": str(at), **turn[0]}), row(at + 1, "result", {"call_id": str(at), **turn[1]})]

    before = [*calls(0, ({"name": "Edit"}, {"error": False})), row(2, "user", {})]
    rows = None
    for i, (call, result, _) in enumerate(turns):
        one = F.array(*before, *calls(3, (call, result)), *(calls(5, more) if more else []))
        rows = one if rows is None else F.when(F.col("conv_id") % len(turns) == i, one).otherwise(rows)
    talk = _talk(spark, d).select("conv_id").distinct()
    return evidence.decide(talk.select(F.col("conv_id").cast("string").alias("session_id"), F.inline(rows)))


def _blocks(turns: list[tuple[dict, dict, bool]]) -> str:
    return f"SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE conv_id % {len(turns)} " + " ".join(f"WHEN {i} THEN {str(b).lower()}" for i, (*_, b) in enumerate(turns)) + " END AS block FROM (SELECT DISTINCT conv_id FROM conversations)"


@query("EVD01_05_gate", _blocks(_TURNS))
def evd05(spark, d):
    return _gated(spark, d, _TURNS)


@query("API10_retro_gate", _blocks(_BESIDES))
def api10(spark, d):
    return _gated(spark, d, _BESIDES, ({"name": "Edit"}, {"error": False}))
