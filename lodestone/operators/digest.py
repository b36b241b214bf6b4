"""Mechanical facts of sessions: manifests, tables of contents, rendered transcripts.

Messages are rows (session_id, pos, role, text, ts, blocks), blocks an array of
STRUCT<type, text, name, path, command, patch>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

# Fixed values
FILE_TOOLS = ["Read", "Edit", "Write", "MultiEdit", "NotebookEdit"]
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit", "apply_patch"]
SHELL_TOOLS = ["Bash", "exec", "exec_command", "local_shell"]
NOTEWORTHY = r"\bgit\s+(commit|tag)\b"
FILES, COMMITS, DECISIONS = 200, 100, 20


def _uses(blocks: str = "blocks") -> Column:
    return F.filter(F.coalesce(blocks, F.array()), lambda b: b.type == "tool_use")


def _first_seen(rows: DataFrame, value: str, most: int, name: str) -> DataFrame:
    """The first ``most`` distinct values of each session, as first seen."""
    once = rows.groupBy("session_id", value).agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    kept = once.withColumn("n", place).where(F.col("n") <= most)
    return kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(name))


def _first_rows(rows: DataFrame, most: int, fields: list[str], name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    kept = rows.withColumn("n", place).where(F.col("n") <= most)
    return kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("row")))), lambda x: x.row).alias(name))


def manifest(messages: DataFrame) -> DataFrame:
    """Turn counts, tool histogram, files, commits and candidate decisions of each session (line: the message's number)."""
    turns = messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
    uses = messages.select("session_id", "pos", F.posexplode(_uses()).alias("nth", "b")).select("session_id", F.col("pos").alias("line"), F.struct("pos", "nth").alias("at"), "b.*")
    tools = uses.groupBy("session_id", "name").agg(F.count("*").cast("int").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tools_used"))
    paths = F.when(F.col("name").isin(*FILE_TOOLS), F.array_compact(F.array("path"))).when(F.col("name") == "apply_patch", fn.patch_paths(F.col("patch")))
    files = uses.select("session_id", F.col("at").alias("use"), F.posexplode(paths).alias("k", "file")).select("session_id", F.struct("use", "k").alias("at"), "file")
    commits = uses.where(F.col("name").isin(*SHELL_TOOLS)).withColumn("c", fn.commit_of(F.col("command"))).where("c is not null").select("session_id", "at", "line", "c.sha", "c.msg")
    decisions = messages.where((F.col("role") == "user") & F.col("text").rlike(fn.DECISION)).select("session_id", F.col("pos").alias("at"), F.col("pos").alias("line"), fn.preview(F.col("text"), 100).alias("preview"))
    out = turns.join(tools, "session_id", "left").join(_first_seen(files, "file", FILES, "files_touched"), "session_id", "left")
    out = out.join(_first_rows(commits, COMMITS, ["sha", "msg", "line"], "commits"), "session_id", "left")
    return out.join(_first_rows(decisions, DECISIONS, ["line", "preview"], "candidate_decisions"), "session_id", "left")


def contents(messages: DataFrame) -> DataFrame:
    """Noteworthy turns with their markers and a preview."""
    uses = _uses()
    edit = F.exists(uses, lambda b: b["name"].isin(*EDIT_TOOLS))
    commit = F.exists(uses, lambda b: b["name"].isin(*SHELL_TOOLS) & fn.holds(b.command.rlike(NOTEWORTHY)))
    user, assistant, n = F.col("role") == "user", F.col("role") == "assistant", F.length(F.coalesce("text", F.lit("")))
    marks = F.concat(F.when(user & (n >= 50), "🧑").otherwise(""), F.when(assistant & commit, "💾").otherwise(""), F.when(assistant & edit, "✏️").otherwise(""), F.when(assistant & (n >= 200) & ~edit & ~commit, "🤖").otherwise(""))
    action = lambda b: F.when(b["name"].isin(*EDIT_TOOLS), F.concat_ws(" ", b["name"], F.coalesce(b.path, F.try_element_at(fn.patch_paths(b.patch), F.lit(1))))).when(b["name"].isin(*SHELL_TOOLS), F.trim(F.split_part(b.command, F.lit("\n"), F.lit(1))))
    done = F.array_join(F.slice(F.array_compact(F.transform(uses, action)), 1, 2), " · ")
    shown = F.when(n > 0, fn.preview(F.col("text"), 100)).otherwise(fn.preview(done, 100))
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return messages.withColumn("turn", turn).withColumn("markers", marks).withColumn("preview", shown).where("markers <> ''").select("session_id", "turn", F.coalesce("ts", F.lit("")).alias("ts"), "markers", "preview", F.col("pos").alias("line"))


def blocks_of(messages: DataFrame) -> DataFrame:
    """Each message's Markdown: a heading, then its blocks or text; empty ones go."""
    quoted = lambda t: F.concat(F.lit("> 💭 _thinking_\n"), F.array_join(F.transform(F.split(t, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
    tool = lambda b: F.concat(F.lit("### 🔧 tool_use: "), b["name"], F.lit("\n\n```json\n"), fn.shortened(F.coalesce(b.command, b.patch, b.path, F.lit("{}")), "input"), F.lit("\n```"))
    result = lambda b: F.concat(F.lit("### ✅ tool_result\n\n```\n"), fn.shortened(F.coalesce(b.text, F.lit(""))), F.lit("\n```"))
    one = lambda b: F.when(b.type == "thinking", quoted(b.text)).when((b.type == "text") & (F.trim(b.text) != ""), b.text).when(b.type == "tool_use", tool(b)).when(b.type == "tool_result", result(b))
    body = F.when(F.size("blocks") > 0, F.array_join(F.array_compact(F.transform("blocks", one)), "\n\n")).otherwise(F.coalesce("text", F.lit("")))
    heading = F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise(F.col("role")), F.when(F.col("ts").isNotNull(), F.concat(F.lit(" _("), "ts", F.lit(")_"))).otherwise(""))
    return messages.withColumn("body", body).where(F.trim("body") != "").withColumn("block", F.concat(heading, F.lit("\n\n"), "body")).drop("body")


def render(messages: DataFrame) -> DataFrame:
    """(session_id, markdown): whole transcripts, headed by counts and a table of contents with line numbers."""
    rows = blocks_of(messages)
    lines = F.size(F.split("block", "\n")) + 1
    w = Window.partitionBy("session_id").orderBy("pos")
    rows = rows.withColumn("line", F.coalesce(F.sum(lines).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    body = rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x.block), "\n\n").alias("body"))
    toc = contents(messages).drop("line").join(rows.select("session_id", F.col("pos"), "line").withColumn("turn", F.row_number().over(w)), ["session_id", "turn"])
    cell = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), F.coalesce(F.nullif(F.substring("ts", 6, 11), F.lit("")), F.lit("—")), F.lit(" | "), "markers", F.lit(" | "), F.replace("preview", F.lit("|"), F.lit("\\|")), F.lit(" | →L"), F.col("line").cast("string"), F.lit(" |"))
    table = toc.groupBy("session_id").agg(F.concat(F.lit("# Table of Contents\n\n| # | Time | Marker | Preview | Line |\n|---|------|--------|---------|------|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))), lambda x: x.cell), "\n")).alias("toc"))
    return body.join(table, "session_id", "left").select("session_id", F.concat_ws("\n\n", "toc", "body").alias("markdown"))


def path_of(tool: Column, project: Column, day: Column, slug: Column, short: Column) -> Column:
    """Where a rendered session is stored."""
    safe = lambda x: F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")
    return F.concat_ws("/", F.lit("raw_sessions"), tool, project, day, F.concat(slug, F.lit("__"), safe(short), F.lit(".md")))
