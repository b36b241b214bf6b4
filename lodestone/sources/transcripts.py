"""Transcript readers: line logs of three chat tools to rows of messages and sessions.

Readers give lines (path, line_no, value); parsers take such lines, whatever their origin.
Messages: tool, path, session_id, pos, role, text, reasoning, ts, blocks. The line tool with
self-contained lines is parsed with built-in functions; the two whose files are logs of edits
or hold the same turn twice are folded file by file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn

BLOCK = "struct<type: string, text: string, name: string, input: string, id: string, path: string, command: string, patch: string>"
MESSAGE = f"path string, session_id string, title string, cwd string, started_at string, ended_at string, pos int, role string, text string, reasoning string, ts string, blocks array<{BLOCK}>"

# Fixed values
LINE_TAGS = ["system-reminder", "local-command-caveat", "local-command-stdout", "command-message", "command-name", "command-args", "task-notification"]
ROLLOUT_TAGS = [
    *LINE_TAGS, "environment_context", "permissions", "turn_aborted", "subagent_notification", "recommended-plugin", "in-app-browser-context", "codex_internal_context", "goal_context", "user_shell_command", "recommended_plugins", "skill", "bash-input", "bash-stdout", "bash-stderr", "model_switch", "personality_spec", "token_budget",
]
LEADING_TAGS = ["environment_context", "permissions", "turn_aborted", "subagent_notification", "codex_internal_context", "goal_context", "user_shell_command"]
SHELLS = {"sh", "bash", "zsh", "fish", "pwsh", "powershell", "powershell.exe", "cmd", "cmd.exe"}
CALLS = {"function_call", "custom_tool_call", "local_shell_call", "tool_search_call", "web_search_call"}
OUTPUTS = {"function_call_output", "custom_tool_call_output", "tool_search_output"}
EPOCH = "1970-01-01T00:00:00.000Z"


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", skip: str = r"/subagents/") -> DataFrame:
    """(path, line_no, mtime_ms, value): the lines of all files below ``root``, those under skipped folders aside."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.sha2(F.col("value").cast("binary"), 256).alias("sha"), "value")
    files = files.where(~F.col("path").rlike(skip) & (F.length("value") > 0))
    return files.select("path", "mtime_ms", "sha", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def read_log(spark: SparkSession, root: str, pattern: str = "*.jsonl", skip: str = r"/subagents/") -> DataFrame:
    """(path, line_no, mtime_ms, value): as ``read_lines``, for logs whose lines stand alone.

    Files are read in splits and by the line, so that no row holds a file; lines are numbered by
    where their split begins and their order in it. There is no hash of the whole file.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"), "value")
    line = F.row_number().over(Window.partitionBy("path").orderBy("at", "nth")) - 1
    return rows.where(~F.col("path").rlike(skip)).select("path", line.alias("line_no"), "mtime_ms", "value")


def clean_line_text(x: Column) -> Column:
    """Message text without injected parts; short rests and error notices become empty."""
    s = F.coalesce(x, F.lit(""))
    for tag in LINE_TAGS:
        s = F.regexp_replace(s, f"(?s)<{tag}>.*?</{tag}>", "")
    s = F.regexp_replace(s, r"\[Request interrupted by user[^\]]*\]", "")
    s = F.regexp_replace(s, r"(?s)(^|\n)Base directory for this skill:.*?(?=\n---\n|\z)", "")
    trimmed = F.regexp_replace(s, r"^\s+|\s+\z", "")
    return F.when(s.rlike(r"^\s*API Error:\s") | (F.length(trimmed) < 10), F.lit("")).otherwise(trimmed)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Messages of the tool whose lines stand alone: bad lines and meta rows are left out."""
    j = lambda p: F.get_json_object("value", p)
    rows = lines.select("path", "line_no", j("$.type").alias("kind"), j("$.sessionId").alias("sid"), j("$.cwd").alias("cwd"), j("$.isMeta").alias("meta"), j("$.timestamp").alias("ts"), j("$.message.content").alias("content"))
    file = Window.partitionBy("path")
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("line_no"))).over(file)
    rows = rows.withColumn("session_id", F.coalesce(first("sid"), F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1))).withColumn("cwd", F.coalesce(first("cwd"), F.lit("")))
    rows = rows.where(F.col("kind").isin("user", "assistant") & ~fn.holds(F.col("meta") == "true"))
    stamp = lambda f: F.coalesce(f("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).over(file), F.lit(EPOCH))
    rows = rows.withColumn("started_at", stamp(F.min_by)).withColumn("ended_at", stamp(F.max_by))
    part = "array<struct<type: string, text: string, thinking: string, name: string, input: string, id: string, content: string, tool_use_id: string>>"
    parts = F.when(F.startswith("content", F.lit("[")), F.from_json("content", part)).otherwise(F.array().cast(part))
    plain = F.when(~F.startswith("content", F.lit("[")) & ~F.startswith("content", F.lit("{")), F.col("content"))
    nested = lambda c: F.when(F.startswith(c, F.lit("[")), F.array_join(F.transform(F.from_json(c, "array<struct<text: string>>"), lambda x: F.coalesce(x.text, F.lit(""))), "")).otherwise(F.coalesce(c, F.lit("")))
    field = lambda x, p: F.get_json_object(x.input, p)
    none = F.lit(None).cast("string")
    block = lambda x: F.struct(x.type.alias("type"), F.when(x.type == "text", x.text).when(x.type == "thinking", x.thinking).when(x.type == "tool_result", nested(x.content)).alias("text"), x["name"].alias("name"), F.when(x.type == "tool_use", F.coalesce(x.input, F.lit("{}"))).alias("input"), F.coalesce(x.id, x.tool_use_id).alias("id"), field(x, "$.file_path").alias("path"), F.coalesce(field(x, "$.command"), field(x, "$.cmd")).alias("command"), field(x, "$.patch").alias("patch"))
    good = lambda x: ((x.type == "text") & x.text.isNotNull()) | ((x.type == "thinking") & (x.thinking != "")) | ((x.type == "tool_use") & x["name"].isNotNull()) | (x.type == "tool_result")
    single = F.array(F.struct(F.lit("text").alias("type"), plain.alias("text"), *[none.alias(n) for n in ("name", "input", "id", "path", "command", "patch")]))
    rows = rows.withColumn("blocks", F.when(plain.isNotNull(), single).otherwise(F.transform(F.filter(F.coalesce(parts, F.array().cast(part)), lambda x: fn.holds(good(x))), block)))
    joined = lambda t: F.array_join(F.transform(F.filter("blocks", lambda b: b.type == t), lambda b: b.text), "\n")
    rows = rows.withColumn("text", clean_line_text(joined("text"))).withColumn("reasoning", clean_line_text(joined("thinking")))
    tools = F.exists("blocks", lambda b: b.type.isin("tool_use", "tool_result"))
    rows = rows.where((F.col("text") != "") | (F.col("reasoning") != "") | tools)
    return rows.select("path", "session_id", F.lit("").alias("title"), "cwd", "started_at", "ended_at", F.col("line_no").cast("int").alias("pos"), F.col("kind").alias("role"), "text", "reasoning", "ts", "blocks")


def line_head(lines: DataFrame) -> DataFrame:
    """(path, value): one line a file that says what its lines say of the whole file; heads of earlier lines count as lines."""
    j = lambda p: F.get_json_object("value", p)
    rows = lines.select("path", "line_no", j("$.sessionId").alias("sid"), j("$.cwd").alias("cwd"), j("$.timestamp").alias("ts"), F.coalesce(j("$.lastTimestamp"), j("$.timestamp")).alias("end"))
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("line_no")))
    found = rows.groupBy("path").agg(first("sid").alias("sid"), first("cwd").alias("cwd"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("ts"), F.max_by("end", F.when(F.col("end").isNotNull(), F.col("line_no"))).alias("end"))
    return found.select("path", F.to_json(F.struct(F.lit("head").alias("type"), F.col("sid").alias("sessionId"), "cwd", F.col("ts").alias("timestamp"), F.col("end").alias("lastTimestamp"))).alias("value"))


def line_settled(rows: DataFrame) -> DataFrame:
    """Messages with what the ``head`` of their file says of it."""
    j = lambda p: F.get_json_object("head", p)
    session = F.coalesce(j("$.sessionId"), F.regexp_extract("path", r"([^/]+?)(?:\.jsonl)?$", 1))
    return rows.withColumns({"session_id": session, "cwd": F.coalesce(j("$.cwd"), F.lit("")), "started_at": F.coalesce(j("$.timestamp"), F.lit(EPOCH)), "ended_at": F.coalesce(j("$.lastTimestamp"), F.lit(EPOCH))})


def _clean(text: str, tags: list[str]) -> str:
    for tag in tags:
        text = re.sub(rf"<{tag}>.*?</{tag}>", "", text, flags=re.S)
    text = re.sub(r"\[Request interrupted by user[^\]]*\]", "", text)
    text = re.sub(r"(^|\n)Base directory for this skill:.*?(?=\n---\n|\Z)", "", text, flags=re.S)
    return "" if re.match(r"\s*API Error:\s", text) or len(text.strip()) < 10 else text.strip()


def _loads(line: str) -> object:
    try:
        return json.loads(line)
    except ValueError:
        return None


def _iso(ms: object) -> str | None:
    return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z") if isinstance(ms, int | float) and not isinstance(ms, bool) else None


def _block(kind: str, text: str | None = None, name: str | None = None, given: object = None, id_: str | None = None) -> dict:
    of = given if isinstance(given, dict) else {}
    read = lambda k: of[k] if isinstance(of.get(k), str) else None
    return {"type": kind, "text": text, "name": name, "input": None if given is None else json.dumps(given, ensure_ascii=False, sort_keys=True), "id": id_, "path": read("file_path"), "command": command_text(of.get("command")) or command_text(of.get("cmd")), "patch": read("patch")}


def command_text(value: object) -> str | None:
    """A shell text, or that of an argument list; what a shell is told to run is the text itself."""
    if isinstance(value, str):
        return value
    parts = [p for p in value if isinstance(p, str)] if isinstance(value, list) else []
    if not parts:
        return None
    if re.split(r"[/\\]", parts[0])[-1].lower() in SHELLS:
        flag = next((i for i, p in enumerate(parts[1:], 1) if re.fullmatch(r"-[a-z]*c[a-z]*|--?command|/c", p, re.I)), len(parts))
        if flag + 1 < len(parts) and parts[flag + 1]:
            return parts[flag + 1]
    return " ".join(p if re.fullmatch(r"[A-Za-z0-9_./:@%+=,-]+", p) else json.dumps(p, ensure_ascii=False) for p in parts)


def _frame(path: str, session: str, title: str, cwd: str, stamps: list[str], messages: list[dict]) -> pd.DataFrame:
    first, last = (stamps[0], stamps[-1]) if stamps else (EPOCH, EPOCH)
    rows = [{"path": path, "session_id": session, "title": title, "cwd": cwd, "started_at": first, "ended_at": last, "pos": i, "role": m["role"], "text": m.get("text", ""), "reasoning": m.get("reasoning", ""), "ts": m.get("ts"), "blocks": m.get("blocks", [])} for i, m in enumerate(messages)]
    return pd.DataFrame(rows, columns=["path", "session_id", "title", "cwd", "started_at", "ended_at", "pos", "role", "text", "reasoning", "ts", "blocks"], dtype=object)


# State logs -----------------------------------------------------------------------------

def _set_deep(turns: list, keys: list, value: object) -> None:
    """Sets turns[k0][k1].. = value, growing lists and making what is missing."""
    at: object = turns
    for key, following in zip(keys, [*keys[1:], None], strict=True):
        if isinstance(at, list) and isinstance(key, int):
            at.extend({} if at is turns else None for _ in range(key + 1 - len(at)))
        elif not isinstance(at, dict):
            return
        if following is None:
            at[key] = value
            return
        below = at[key] if isinstance(at, list) else at.get(key)
        if below is None:
            below = [] if isinstance(following, int) and at is not turns else {}
            at[key] = below
        at = below


def replay(records: list) -> tuple[str, str, list]:
    """(session id, title, turns) after the edits of a state log."""
    session, title, turns = "", "", []
    for r in records:
        if not isinstance(r, dict):
            continue
        kind, keys, value = r.get("kind"), r.get("k"), r.get("v")
        if kind == 0 and isinstance(value, dict):
            session = value["sessionId"] if isinstance(value.get("sessionId"), str) and value["sessionId"] else session
            title = value["customTitle"].strip() if isinstance(value.get("customTitle"), str) else title
            turns += value["requests"] if isinstance(value.get("requests"), list) else []
        elif kind == 1 and keys == ["customTitle"]:
            title = value.strip() if isinstance(value, str) else ""
        elif kind == 2 and isinstance(keys, list) and keys[:1] == ["requests"]:
            if len(keys) == 1 and isinstance(value, list):
                turns += value
            elif len(keys) > 1 and isinstance(keys[1], int):
                _set_deep(turns, keys[1:], value)
    return session, title, turns


def _reply(parts: list) -> tuple[list[dict], str, str]:
    blocks: list[dict] = []
    for p in parts:
        if not isinstance(p, dict):
            continue
        kind, value = p.get("kind"), lambda k, p=p: (p.get(k) or {}).get("value") if isinstance(p.get(k), dict) else None
        if kind == "markdownContent" and isinstance(value("content"), str) and value("content"):
            blocks.append(_block("text", value("content")))
        elif kind == "thinking" and isinstance(p.get("value"), str) and p["value"]:
            blocks.append(_block("thinking", p["value"]))
        elif kind == "toolInvocationSerialized":
            blocks.append(_block("tool_use", name=p["toolId"] if isinstance(p.get("toolId"), str) else "tool", given=p.get("toolSpecificData") or {}, id_=p.get("toolCallId") if isinstance(p.get("toolCallId"), str) else None))
            label = next((v for v in (value("pastTenseMessage"), value("invocationMessage")) if isinstance(v, str) and v), "")
            if label:
                blocks.append(_block("tool_result", label))
    of = lambda kind: _clean("\n".join(b["text"] for b in blocks if b["type"] == kind), LINE_TAGS)
    return blocks, of("text"), of("thinking")


def _requests(turns: list) -> tuple[list[str], list[dict]]:
    stamps, messages = [], []
    for turn in turns:
        if not isinstance(turn, dict) or not turn:
            continue
        ts = _iso(turn.get("timestamp"))
        stamps += [ts] if ts else []
        asked = (turn.get("message") or {}).get("text") if isinstance(turn.get("message"), dict) else None
        if isinstance(asked, str) and (text := _clean(asked, LINE_TAGS)):
            messages.append({"role": "user", "text": text, "ts": ts})
        blocks, text, reasoning = _reply(turn.get("response") if isinstance(turn.get("response"), list) else [])
        if blocks or text or reasoning:
            messages.append({"role": "assistant", "text": text, "reasoning": reasoning, "ts": ts, "blocks": blocks})
    return stamps, messages


def _stem(path: str) -> str:
    return re.sub(r"\.jsonl?$", "", path.rsplit("/", 1)[-1])


def _by_file(lines: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The messages that ``fold`` makes of the lines of each file, in order; files follow one another in a task, and none is a group of Spark's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last: object = object()
        for pdf in batches:
            paths, done, at = pdf["path"].tolist(), [], 0
            for i, path in enumerate(paths):
                if path != last:
                    held += [pdf.iloc[at:i]] if i > at else []
                    done += [fold(pd.concat(held))] if held else []
                    held, at, last = [], i, path
            held += [pdf.iloc[at:]] if paths else []
            if done:
                yield pd.concat(done)
        if held:
            yield fold(pd.concat(held))

    return lines.select("path", "line_no", "value").repartition("path").sortWithinPartitions("path", "line_no").mapInPandas(run, MESSAGE)


def parse_state_logs(lines: DataFrame) -> DataFrame:
    """Messages of state logs and of single-document logs (an object with ``requests``), file by file."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        path = str(pdf["path"].iloc[0])
        whole = _loads("\n".join(pdf["value"]))
        if isinstance(whole, dict) and isinstance(whole.get("requests"), list) and "kind" not in whole:
            title = whole["customTitle"].strip() if isinstance(whole.get("customTitle"), str) else ""
            session, turns = _stem(path), whole["requests"]
        else:
            session, title, turns = replay([_loads(x) for x in pdf["value"] if x.strip()])
        stamps, messages = _requests(turns)
        return _frame(path, session or _stem(path), title, "", stamps, messages)

    return _by_file(lines, fold)


def parse_event_logs(lines: DataFrame) -> DataFrame:
    """Messages of event transcripts: session starts, user and assistant messages; tool events are left out."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        path, session, stamps, messages = str(pdf["path"].iloc[0]), "", [], []
        for record in map(_loads, pdf.sort_values("line_no")["value"]):
            if not isinstance(record, dict):
                continue
            data = record.get("data") if isinstance(record.get("data"), dict) else {}
            text = lambda k, data=data: data[k] if isinstance(data.get(k), str) else ""
            ts = record["timestamp"] if isinstance(record.get("timestamp"), str) else None
            stamps += [ts] if ts else []
            if record.get("type") == "session.start":
                session = text("sessionId") or session
            elif record.get("type") in ("user.message", "assistant.message"):
                role = record["type"].split(".")[0]
                m = {"role": role, "text": _clean(text("content"), LINE_TAGS), "reasoning": _clean(text("reasoningText"), LINE_TAGS) if role == "assistant" else "", "ts": ts}
                messages += [m] if m["text"] or m["reasoning"] else []
        return _frame(path, session or _stem(path), "", "", stamps, messages)

    return _by_file(lines, fold)


def prefer_state_logs(chats: DataFrame, events: DataFrame) -> DataFrame:
    """Event transcripts only of sessions of a workspace that have no state log (workspace, session_id, ..)."""
    return chats.unionByName(events.join(chats.select("workspace", "session_id").distinct(), ["workspace", "session_id"], "left_anti"))


def workspace_path(document: Column) -> Column:
    """The folder that a workspace document names."""
    uri = F.coalesce(F.get_json_object(document, "$.folder"), F.get_json_object(document, "$.workspace"), F.lit(""))
    plain = F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B"))
    return F.when(F.startswith(uri, F.lit("file://")), F.url_decode(plain)).otherwise(uri)


# Rollouts -------------------------------------------------------------------------------

#: What is cut from a rollout's text, in order; both engines of regular expressions read them alike.
_ROLLOUT_CUTS = [
    *[rf"(?is)<{tag}\b[^>]*>.*?</{tag}>" for tag in ROLLOUT_TAGS],
    r"(?is)<(external_[A-Za-z0-9_:-]+)\b[^>]*>.*?</\1>",
    r"(?i)<external_[A-Za-z0-9_:-]+\b[^>]*/>",
    r"(?is)\A# AGENTS\.md instructions[^\n]*\r?\n\s*\r?\n<INSTRUCTIONS>.*?</INSTRUCTIONS>\s*",
    r"(?s)\A# AGENTS\.md instructions[^\n]*\r?\n.*?(?:\r?\n){2}",
]
#: A text that still begins so is not the user's.
_ROLLOUT_LEFT = rf"(?i)\A\s*(?:# AGENTS\.md instructions|<(?:{'|'.join(LEADING_TAGS)}|external_[A-Za-z0-9_:-]+)\b)"


def clean_rollout_text(text: str) -> str:
    for cut in _ROLLOUT_CUTS:
        text = re.sub(cut, "", text)
    return "" if re.match(_ROLLOUT_LEFT, text) else text.strip()


def rollout_title(x: Column) -> Column:
    """A title from the log of titles without injected parts; null where nothing usable is left."""
    for cut in _ROLLOUT_CUTS:
        x = F.regexp_replace(x, cut, "")
    kept = F.regexp_replace(x, r"\A\s+|\s+\z", "")
    return F.when(~x.rlike(_ROLLOUT_LEFT) & (kept != "") & ~kept.rlike(r"(?i)\A(?:<|Base directory for this skill:)"), kept)


def flat_text(value: object) -> str:
    """Texts of nested content, one a line."""
    if isinstance(value, str):
        return value
    out = []
    for part in value if isinstance(value, list) else []:
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, dict):
            below = part["text"] if isinstance(part.get("text"), str) else flat_text(part.get("content"))
            out += [below] if below or isinstance(part.get("text"), str) else []
    return "\n".join(out)


def flat_output(value: object) -> str:
    if isinstance(value, list) and value and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "".join(p["text"] for p in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, indent=2, ensure_ascii=False)


def tool_name(name: str) -> str:
    head, _, rest = name.partition("__")
    return name if head != "mcp" or not rest else ".".join(rest.split("__", 1))


def signature(name: str, given: object) -> str:
    """What makes two tool calls the same: the shell text, the patch, or the input with sorted keys."""
    name = tool_name(name)
    of = given if isinstance(given, dict) else {}
    if name in ("exec", "exec_command", "local_shell"):
        command = given if isinstance(given, str) else command_text(of.get("command")) or command_text(of.get("cmd"))
        return f"shell:{command.strip()}" if command else f"shell:{json.dumps(given, sort_keys=True)}"
    if name == "apply_patch" and isinstance(of.get("patch"), str):
        return f"apply_patch:{' '.join(of['patch'].split())}"
    return f"{name}:{json.dumps(given, sort_keys=True)}"


def is_child(header: dict) -> bool:
    """A session that another one started, or that ran without a person."""
    word = re.compile(r"subagent|guardian[_-]?review", re.I)

    def marked(value: object) -> bool:
        if isinstance(value, dict):
            return any(word.search(k) or "thread_spawn" in k.lower() or marked(v) for k, v in value.items())
        return any(map(marked, value)) if isinstance(value, list) else isinstance(value, str) and bool(word.search(value))

    source = header.get("source")
    alone = str(header.get("originator", "")).lower() == "codex_exec" or (isinstance(source, str) and source.lower() == "exec")
    return alone or bool(header.get("parent_thread_id")) or marked(source) or marked(header.get("thread_source"))


def pair_off(wanted: list[dict], offered: list[dict], same) -> dict[int, int]:
    """For each wanted item the first offered one that is the same and not taken."""
    taken: dict[int, int] = {}
    for i, w in enumerate(wanted):
        j = next((j for j, o in enumerate(offered) if j not in taken.values() and same(w, o)), None)
        if j is not None:
            taken[i] = j
    return taken


def _given(value: object) -> object:
    parsed = _loads(value) if isinstance(value, str) else value
    return value if parsed is None and isinstance(value, str) else {} if parsed is None else parsed


def fold_rollout(records: list[tuple[int, dict]]) -> tuple[dict | None, list[str], list[dict]]:
    """(header, times, messages) of a rollout: both lanes of each turn as one, tools once."""
    string = lambda v: v if isinstance(v, str) else ""
    header, stamps = None, []
    shown, replies, thought, thought_shown, tools, events = [], [], [], [], [], []
    spans: dict[str, dict] = {}
    for at, r in records:
        body = r["payload"] if isinstance(r.get("payload"), dict) else {}
        kind, ts = string(body.get("type")), r["timestamp"] if isinstance(r.get("timestamp"), str) else None
        stamps += [ts] if ts else []
        base = {"at": at, "ts": ts, "id": string(body.get("id"))}
        if r["type"] == "session_meta" and header is None and (string(body.get("id")) or string(body.get("session_id"))):
            header = {**body, "id": string(body.get("id")) or string(body.get("session_id")), "timestamp": string(body.get("timestamp")) or ts}
        elif r["type"] == "response_item" and kind == "message" and body.get("role") in ("user", "assistant"):
            content = body.get("content")
            about = body.get("internal_chat_message_metadata_passthrough") or body.get("metadata") or {}
            kinds = about.get("content_item_kinds") if isinstance(about, dict) else None
            if body["role"] == "user" and kinds and isinstance(content, list):
                content = [c for c, k in zip(content, kinds, strict=False) if k == "user.text"]
            text = clean_rollout_text(flat_text(content))
            replies += [{**base, "role": body["role"], "text": text}] if text else []
        elif (r["type"] == "response_item" and kind == "reasoning") or (r["type"] == "event_msg" and kind == "item_completed" and (body.get("item") or {}).get("type") == "Reasoning"):
            own = body if kind == "reasoning" else body["item"]
            text = clean_rollout_text("\n".join(filter(None, (flat_text(own.get("summary") or own.get("summary_text")), flat_text(own.get("content") or own.get("raw_content"))))))
            (thought if kind == "reasoning" else thought_shown).extend([{**base, "id": string(own.get("id")), "role": "assistant", "reasoning": text, "blocks": [_block("thinking", text)]}] if text else [])
        elif r["type"] == "response_item" and (kind in CALLS or kind in OUTPUTS or kind == "image_generation_call"):
            call = string(body.get("call_id")) or string(body.get("id")) or f"{kind}:{at}"
            span = spans.setdefault(call, {"from": at, "to": at, "signature": None, "out": False, "seen": set()})
            span["to"] = at
            if kind not in OUTPUTS and "call" not in span["seen"]:
                name = "image_generation" if kind == "image_generation_call" else tool_name(string(body.get("name"))) or {"local_shell_call": "local_shell", "web_search_call": "web_search", "tool_search_call": "tool_search"}.get(kind, "tool")
                given = _given(body.get("arguments", body.get("input", body.get("action"))))
                span["signature"] = signature(name, given)
                span["seen"].add("call")
                tools.append({**base, "role": "assistant", "blocks": [_block("tool_use", name=name, given=given, id_=call)]})
            if (kind in OUTPUTS or (kind == "image_generation_call" and body.get("result"))) and "out" not in span["seen"]:
                text = flat_output(body.get("output", body.get("result", body.get("tools"))))
                span["seen"].add("out")
                span["out"] = bool(text)
                tools.append({**base, "role": "user", "blocks": [_block("tool_result", text, id_=call)]})
        elif r["type"] == "event_msg" and kind in ("user_message", "agent_message"):
            text = clean_rollout_text(string(body.get("message")))
            shown += [{**base, "role": "user" if kind == "user_message" else "assistant", "text": text}] if text else []
        elif r["type"] == "event_msg" and kind == "item_completed" and isinstance(body.get("item"), dict):
            item = body["item"]
            if item.get("type") in ("UserMessage", "AgentMessage"):
                text = clean_rollout_text(flat_text(item.get("content")))
                shown += [{**base, "id": string(item.get("id")), "role": "user" if item["type"] == "UserMessage" else "assistant", "text": text}] if text else []
            elif item.get("type") in ("CommandExecution", "McpToolCall"):
                shell = item["type"] == "CommandExecution"
                name = "exec_command" if shell else f"{string(item.get('server'))}.{string(item.get('tool'))}"
                given = {"command": item.get("command")} if shell else _given(item.get("arguments"))
                text = flat_output(item.get("aggregated_output") if shell else (item.get("result") or {}).get("content") if isinstance(item.get("result"), dict) else item.get("result"))
                events.append({**base, "id": string(item.get("id")), "signature": signature(name, given), "use": _block("tool_use", name=name, given=given, id_=string(item.get("id")) or None), "result": text})
    squeezed = lambda m: " ".join(m["text"].split())
    by_id = lambda a, b: bool(a["id"]) and a["id"] == b["id"]
    near = lambda a, b: abs(a["at"] - b["at"]) <= 3
    met = pair_off(replies, shown, lambda a, b: a["role"] == b["role"] and (by_id(a, b) or (near(a, b) and squeezed(a) == squeezed(b))))
    told = pair_off(thought, thought_shown, lambda a, b: by_id(a, b) or (near(a, b) and a["reasoning"] == b["reasoning"]))
    out = shown + [m for i, m in enumerate(replies) if i not in met] + thought + [m for i, m in enumerate(thought_shown) if i not in told.values()] + tools
    ranges = [dict(s, call=c) for c, s in spans.items()]
    mirrored = pair_off(events, ranges, lambda e, s: bool(e["id"]) and s["signature"] == e["signature"] and s["from"] - 1 <= e["at"] <= s["to"] + 1)
    for i, e in enumerate(events):
        span = ranges[mirrored[i]] if i in mirrored else None
        blocks = [] if span else [e["use"]]
        if e["result"] and not (span and span["out"]):
            blocks.append(_block("tool_result", e["result"], id_=span["call"] if span else e["id"] or None))
        out += [{**e, "role": "assistant", "blocks": blocks}] if blocks else []
    order = sorted(range(len(out)), key=lambda i: (out[i]["at"], i))
    return header, stamps, [out[i] for i in order]


def parse_rollouts(lines: DataFrame) -> DataFrame:
    """Messages of rollouts, file by file; files without a header or of child sessions give none."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        path = str(pdf["path"].iloc[0])
        filled = [x for x in pdf.sort_values("line_no")["value"] if x.strip()]
        records = [(i, r) for i, r in enumerate(map(_loads, filled), 1) if isinstance(r, dict) and isinstance(r.get("type"), str)]
        header, stamps, messages = fold_rollout(records)
        if header is None or is_child(header):
            return _frame(path, "", "", "", [], [])
        first = [header["timestamp"]] if header.get("timestamp") else []
        return _frame(path, header["id"], "", header.get("cwd") or "", [*first, *sorted(stamps)] if first else sorted(stamps), messages)

    return _by_file(lines, fold)


def one_file_per_session(files: DataFrame) -> DataFrame:
    """The best file (session_id, path, active, mtime_ms) of each session: active, then newer, then by path."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("active"), F.desc("mtime_ms"), "path"))
    return files.withColumn("n", place).where("n = 1").drop("n")


def title_map(lines: DataFrame) -> DataFrame:
    """(session_id, title): the last title of each id in an append-only log; malformed rows are left out."""
    rows = lines.select(F.get_json_object("value", "$.id").alias("session_id"), F.get_json_object("value", "$.thread_name").alias("title"), "line_no").where("session_id is not null and title is not null")
    return rows.groupBy("session_id").agg(F.max_by("title", "line_no").alias("title"))


def sessions_of(messages: DataFrame, titles: DataFrame | None = None, rollouts: bool = False) -> DataFrame:
    """One row for each session: its title from the log, the title map, the first user text or the id; its project and times.

    Rollouts are named by the end of their id without dashes, and their titles in the map are cleaned.
    """
    first = F.min_by("text", F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("pos")))
    rows = messages.groupBy("path", "session_id").agg(F.first("title").alias("own"), F.first("cwd").alias("cwd"), F.first("started_at").alias("started_at"), F.first("ended_at").alias("ended_at"), first.alias("asked"), F.count("*").alias("turns"))
    rows = rows.join(titles, "session_id", "left") if titles is not None else rows.withColumn("title", F.lit(None).cast("string"))
    short = F.coalesce(F.nullif(F.right(F.replace("session_id", F.lit("-")), F.lit(8)), F.lit("")), F.lit("untitled")) if rollouts else F.substring("session_id", 1, 8)
    listed = rollout_title(F.col("title")) if rollouts else F.nullif("title", F.lit(""))
    title = F.coalesce(F.nullif("own", F.lit("")), listed, "asked", short)
    return rows.select("path", "session_id", short.alias("short_id"), fn.project_slug_of_path(F.col("cwd")).alias("project"), F.col("cwd").alias("project_raw"), "started_at", "ended_at", "turns", fn.slug_and_display(title).alias("s")).select("*", F.col("s.slug").alias("name_slug"), F.col("s.display").alias("display_name")).drop("s")
