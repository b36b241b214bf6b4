"""Deterministic stand-ins for memory, question, entity and session tables, made from the driver's tables.

Each is one SQL text for both engines; ``spark`` and ``duck`` fill in the few spellings that
differ. The operators never see these definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread

NOW = "2026-06-12"

_TYPE = "CASE {d} % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'core' END"


def _type(d: str) -> str:
    return _TYPE.replace("{d}", d)


_MEM = f"""
SELECT doc_id AS seq, {_type("doc_id")} || '/' || CASE WHEN doc_id % 10 < 2 THEN '_global' ELSE source END || '/' || lpad(CAST(doc_id AS string), 9, '0') AS id,
  {_type("doc_id")} AS type,
  CASE WHEN doc_id % 10 = 0 THEN 'global' WHEN doc_id % 10 = 1 THEN 'user' ELSE 'project:' || source END AS scope,
  CASE WHEN doc_id % 10 < 2 THEN NULL ELSE source END AS project,
  substr(text, 1, 80) AS title, substr(text, 81) AS summary,
  CASE doc_id % 11 WHEN 0 THEN 'archived' WHEN 1 THEN 'superseded' WHEN 2 THEN 'pinned' ELSE 'active' END AS status,
  CAST(doc_id % 6 AS double) AS importance, CAST(doc_id % 10 AS double) / 10 AS confidence,
  '2026-' || lpad(CAST(1 + doc_id % 6 AS string), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS string), 2, '0') AS updated_at,
  CASE WHEN doc_id % 9 = 0 THEN '2026-0' || CAST(1 + doc_id % 8 AS string) || '-15' WHEN doc_id % 101 = 5 THEN 'soon' END AS valid_to,
  CASE WHEN doc_id % 13 = 0 THEN {_type("(doc_id - 1)")} || '/' || CASE WHEN (doc_id - 1) % 10 < 2 THEN '_global' ELSE source END || '/' || lpad(CAST(doc_id - 1 AS string), 9, '0') END AS supersedes,
  CASE WHEN text IS NOT NULL THEN WORDS(split(lower(text), ' ')) END AS entities,
  CASE WHEN doc_id % 5 = 4 THEN NOTHING ELSE LIST('session-' || lpad(CAST(doc_id % 970 AS string), 4, '0'), 'sess' || CAST(doc_id % 7 AS string)) END AS source_sessions,
  CASE WHEN doc_id % 3 = 0 THEN LIST('src/f' || CAST(doc_id % 17 AS string) || '.py', 'src/f' || CAST(doc_id % 5 AS string) || '.py') ELSE NOTHING END AS source_files,
  CASE WHEN doc_id % 8 = 0 THEN LIST('c' || CAST(doc_id % 29 AS string)) ELSE NOTHING END AS source_commits,
  CASE doc_id % 5 WHEN 0 THEN 'untrusted' WHEN 1 THEN NULL ELSE 'trusted' END AS trust,
  CAST(doc_id % 7 AS double) AS access_count,
  CASE WHEN doc_id % 11 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'expired' ELSE 'superseded-cleanup' END END AS archived_reason,
  'dev' || CAST(doc_id % 3 AS string) AS origin_device
FROM documents
"""

_OVERLAY = """
SELECT id, title, status, importance, origin_device,
  CASE WHEN seq % 41 = 3 THEN 'unreadable' ELSE '2026-' || substr(updated_at, 6, 3) || lpad(CAST(1 + (seq + seq % 5 + 26) % 28 AS string), 2, '0') || CASE WHEN seq % 2 = 0 THEN 'T23:00:00Z' ELSE '' END END AS updated_at
FROM (MEM) WHERE seq % 3 = 0
UNION ALL SELECT id || '-sib', title, status, importance, origin_device, updated_at FROM (MEM) WHERE seq % 50 = 7
"""

_USAGE = "SELECT m.id, CAST(count(*) AS double) AS n, max('2026-06-' || lpad(CAST(1 + e.event_id % 28 AS string), 2, '0')) AS last_access FROM (MEM) m JOIN (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS seq FROM events) e ON e.seq = m.seq GROUP BY m.id"

_SESSIONS = """
SELECT 'session-' || lpad(CAST(conv_id % 300 AS string), 4, '0') || '-' || CAST(conv_id AS string) AS session_id,
  CASE WHEN conv_id % 37 = 0 THEN 'root' ELSE 'src' || CAST(conv_id % 20 AS string) END AS project, '/work/src' || CAST(conv_id % 20 AS string) AS project_raw,
  '2026-05-' || lpad(CAST(1 + conv_id % 28 AS string), 2, '0') AS ended_at, count(*) AS turns,
  CAST(conv_id % 1000 AS double) AS mtime_ms, CAST(conv_id AS string) AS sha, conv_id
FROM conversations GROUP BY conv_id
"""

_SKIPS = "SELECT session_id, 'noise' AS reason, ended_at AS at FROM (SESSIONS) WHERE conv_id % 7 = 0"

_ENTITY = """
SELECT 'entity/' || CASE WHEN p_partkey % 3 = 0 THEN '_global' ELSE 'src' || CAST(p_partkey % 20 AS string) END || '/' || CAST(p_partkey AS string) AS id,
  CASE p_partkey % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'symbol' WHEN 2 THEN 'api' WHEN 3 THEN 'concept' ELSE 'person' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'global' ELSE 'project:src' || CAST(p_partkey % 20 AS string) END AS scope,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'src' || CAST(p_partkey % 20 AS string) END AS project,
  p_name AS title, LIST(p_brand) AS aliases, LIST('entity/_global/' || CAST(p_partkey + 1 AS string)) AS related_entities,
  LIST('semantic/_global/' || lpad(CAST(p_partkey * 10 AS string), 9, '0')) AS source_memory_ids,
  '2026-06-' || lpad(CAST(1 + p_partkey % 28 AS string), 2, '0') AS updated_at
FROM part
"""

_QA = """
SELECT 'qa/' || CASE WHEN conv_id % 4 = 0 THEN '_global' ELSE 'src' || CAST(conv_id % 20 AS string) END || '/' || CAST(conv_id AS string) || '-' || CAST(turn AS string) AS id,
  CASE WHEN conv_id % 4 = 0 THEN 'global' ELSE 'project:src' || CAST(conv_id % 20 AS string) END AS scope,
  CASE WHEN conv_id % 4 = 0 AND conv_id % 8 <> 0 THEN NULL ELSE 'src' || CAST(conv_id % 20 AS string) END AS project,
  substr(text, 1, 120) AS question, substr(text, 121) AS answer_summary, LIST(role) AS tags,
  LIST('semantic/_global/' || lpad(CAST(conv_id * 20 AS string), 9, '0')) AS source_memory_ids, LIST('entity/_global/' || CAST(conv_id AS string)) AS related_entities,
  CASE conv_id % 4 WHEN 0 THEN 'compound' WHEN 1 THEN 'troubleshooting' WHEN 2 THEN 'decision' ELSE 'operational' END AS kind,
  '2026-0' || CAST(5 + conv_id % 2 AS string) || '-' || lpad(CAST(1 + turn % 28 AS string), 2, '0') AS updated_at
FROM conversations WHERE role = 'user'
"""

_QUERIES = "SELECT item_id AS query_id, lower(text) AS q, 'src' || CAST(item_id % 20 AS string) AS project FROM benchmark"

VIEWS = {"MEM": _MEM, "OVERLAY": _OVERLAY, "USAGE": _USAGE, "SESSIONS": _SESSIONS, "SKIPS": _SKIPS, "ENTITY": _ENTITY, "QA": _QA, "QUERIES": _QUERIES}
TABLES = ("documents", "events", "conversations", "part", "benchmark", "pages")


def _filled(sql: str) -> str:
    for name in VIEWS:
        if f"({name})" in sql:
            sql = sql.replace(f"({name})", f"({_filled(VIEWS[name])})")
    return sql


def _words(sql: str, spark: bool) -> str:
    """The first, middle and last word of a list of words."""
    words = "split(lower(text), ' ')" if spark else "string_split(lower(text), ' ')"
    n, at = (f"size({words})", "element_at({w}, {i})") if spark else (f"len({words})", "({w})[{i}]")
    found = ", ".join(at.format(w=words, i=i) for i in ("1", f"CAST(({n} + 1) {'div' if spark else '//'} 2 AS int)", n))
    return sql.replace("WORDS(split(lower(text), ' '))", f"LIST({found})")


def duck(name: str) -> str:
    """The view as SQL for DuckDB."""
    sql = _words(_filled(VIEWS[name]), False)
    return sql.replace("LIST(", "list_value(").replace("NOTHING", "CAST([] AS VARCHAR[])").replace("AS string)", "AS VARCHAR)")


def with_views(*names: str) -> str:
    """A WITH clause that names the views in lower case."""
    return "WITH " + ", ".join(f"{n.lower()} AS ({duck(n)})" for n in names) + " "


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables of a folder."""
    sql = _words(_filled(VIEWS[name]), True).replace("LIST(", "array(").replace("NOTHING", "CAST(array() AS array<string>)")
    used = {}
    for t in TABLES:
        for word in (f"FROM {t}", f"JOIN {t}"):
            if word in sql:
                sql = sql.replace(word, word.replace(t, f"{{{t}}}"))
                path = f"{sf_dir}/{t}.parquet"
                used[t] = spread(spark, path) if t == "documents" else spark.read.parquet(path)
                if t == "events":
                    used[t] = used[t].hint("merge")  # numbers are small on disk, and there would be millions to broadcast
    return spark.sql(sql, **used)
