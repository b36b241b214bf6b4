"""Question and entity pages: writes, documents, and hints about archived hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.stores import frontmatter, json_list_field

QA_LISTS = ["tags", "sources", "source_memory_ids", "source_sessions", "related_entities"]
ENTITY_LISTS = ["aliases", "source_memory_ids", "source_sessions", "source_files", "related_entities"]
#: Field names of documents by column.
FIELDS = {"answer_summary": "answerSummary", "source_memory_ids": "sourceMemoryIds", "source_sessions": "sourceSessions", "source_files": "sourceFiles", "related_entities": "relatedEntities", "created_at": "createdAt", "updated_at": "updatedAt"}
_LINE = lambda x: fn.control_free(x)


def _day(x: Column, today: str) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), x).otherwise(F.lit(today))


def clean(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows without control characters; absent lists are empty."""
    texts = {f.name: _LINE(F.col(f.name)) for f in rows.schema if f.dataType.typeName() == "string"}
    return rows.withColumns(texts | {c: F.transform(fn.as_array(F.col(c)), _LINE) for c in lists})


def qa_writes(items: DataFrame, today: str) -> DataFrame:
    """Question rows ready to be stored, with a ``defect`` where the scope isn't valid; the id follows from scope and question."""
    scope = F.trim("scope")
    slug = F.trim(F.regexp_replace(scope, "^project:", ""))
    of_project = F.startswith(scope, F.lit("project:"))
    safe = slug.rlike("^[A-Za-z0-9._-]+$") & ~slug.contains("..") & (slug != ".")
    defect = F.when(of_project & ~safe, "invalid project slug").when(~of_project & ~scope.isin("global", "user"), "invalid scope")
    rows = clean(items, [c for c in QA_LISTS if c in items.columns])
    rows = rows.withColumn("defect", defect).withColumn("project", F.when(of_project, slug)).withColumn("scope", F.when(of_project, F.concat(F.lit("project:"), slug)).otherwise(scope))
    rows = rows.withColumns({c: fn.collapsed(fn.control_free(F.coalesce(c, F.lit("")))) for c in ("question", "answer_summary")} | {c: _day(F.col(c), today) for c in ("created_at", "updated_at") if c in rows.columns})
    return rows.withColumn("id", F.concat(F.lit("qa/"), F.coalesce("project", F.lit("_global")), F.lit("/"), fn.question_slug(F.col("question")))).withColumn("path", F.concat(F.lit("memory/"), "id", F.lit(".md")))


def entity_writes(items: DataFrame, today: str) -> DataFrame:
    rows = clean(items, [c for c in ENTITY_LISTS if c in items.columns])
    defect = F.when(~fn.is_safe_id(F.col("id")), "unsafe id")
    return rows.withColumns({c: _day(F.col(c), today) for c in ("created_at", "updated_at") if c in rows.columns}).withColumn("defect", defect).withColumn("path", F.concat(F.lit("memory/entities/"), F.coalesce("project", F.lit("_global")), F.lit("/"), fn.last_segment(F.col("id")), F.lit(".md")))


def put(store: DataFrame, items: DataFrame) -> DataFrame:
    """The store with the last item (by ``order``) of each id in place of its row."""
    names = [c for c in store.columns if c != "id"]
    last = items.groupBy("id").agg(F.max_by(F.struct(*names), "order").alias("new"))
    both = store.select("id", F.struct(*names).alias("old")).join(last, "id", "full")
    return both.select("id", F.coalesce("new", "old").alias("row")).select("id", "row.*")


def markdown(rows: DataFrame, plain: list[str], quoted: list[str], lists: list[str], heading: str) -> DataFrame:
    """(id, md): fields in order, quoted ones and lists as JSON, then heading and body."""
    name = lambda c: FIELDS.get(c, c)
    as_json = lambda x: F.substr(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    line = {c: F.concat(F.lit(f"{name(c)}: "), F.coalesce(_LINE(F.col(c)), F.lit("null"))) for c in plain}
    line |= {c: F.concat(F.lit(f"{name(c)}: "), F.coalesce(as_json(_LINE(F.col(c))), F.lit("null"))) for c in quoted}
    line |= {c: F.concat(F.lit(f"{name(c)}: "), F.to_json(fn.as_array(F.col(c)))) for c in lists}
    order = [c for c in rows.columns if c in line]
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+|\n+$", "")
    return rows.select("id", F.concat(F.lit("---\n"), F.concat_ws("\n", *[line[c] for c in order]), F.lit("\n---\n\n# "), _LINE(F.col(heading)), F.lit("\n\n"), body, F.lit("\n")).alias("md"))


def parse(docs: DataFrame, plain: list[str], quoted: list[str], lists: list[str]) -> DataFrame:
    """Rows of page documents (path, md); those without an id go."""
    fm = F.col("fm")
    rows = docs.withColumn("fm", frontmatter(F.col("md"))).where("fm['id'] <> ''")
    name = lambda c: FIELDS.get(c, c)
    scalar = lambda c: F.when(~F.trim(fm[name(c)]).isin("null", "undefined", ""), fm[name(c)])
    unquoted = lambda c: F.coalesce(F.try_element_at(F.from_json(F.concat(F.lit("["), fm[name(c)], F.lit("]")), "array<string>"), F.lit(1)), scalar(c))
    return rows.select("path", *[scalar(c).alias(c) for c in plain], *[unquoted(c).alias(c) for c in quoted], *[json_list_field(fm[name(c)]).alias(c) for c in lists])


def hints(cold: DataFrame) -> DataFrame:
    """A line for each archived hit (id, title, archived_reason, source, origin_device, trust)."""
    shown = F.when(fn.is_safe_id(F.col("id")), F.col("id")).otherwise(fn.inert_id(F.col("id")))
    flag = F.when(F.coalesce("trust", F.lit("unknown")) != "trusted", F.lit(" (untrusted)")).otherwise(F.lit(""))
    line = F.concat(F.lit("  "), shown, F.lit("  ("), fn.for_display(F.coalesce("archived_reason", F.lit("null"))), F.lit(")  — "), fn.for_display(F.col("title")), flag, F.lit("  — "), fn.restore_instruction(F.col("id"), F.col("source"), F.col("origin_device")))
    return cold.select("id", line.alias("line"))


def next_step(cold: DataFrame) -> DataFrame:
    """One row (step): what to do when only archived rows answered; empty without one."""
    head = "No ACTIVE memory matched, but archived entries did — see coldStorage"
    local, away = F.col("source") == "local", F.col("source") == "overlay"
    device = F.max(F.when(away, F.nullif("origin_device", F.lit(""))))
    devices = F.count_distinct(F.when(away, F.coalesce(F.nullif("origin_device", F.lit("")), F.lit("\0"))))
    n, n_local, n_away, unsafe = F.count("*"), F.count_if(fn.holds(local)), F.count_if(fn.holds(away)), F.count_if(fn.holds(local) & ~fn.is_safe_id(F.col("id")))
    one = (devices == 1) & device.isNotNull() & (fn.for_display(device) != "(unprintable)")
    tail = F.when(one, F.concat(F.lit("archived on device "), fn.for_display(device), F.lit("; restore it there"))).otherwise("each is archived on another device; restore it there")
    step = (
        F.when(n == 0, "")
        .when(unsafe > 0, f"{head} — restore each hit from its own cold-storage hint. At least one archived id is unsafe to use in a command, so restore that one by hand.")
        .when(n_local == n, f"{head} (memory-unarchive '<id>' to restore).")
        .when(n_local > 0, f"{head}; each hit carries its own restore path (local hits: memory-unarchive '<id>'; the rest: restore on their origin device).")
        .when(n_away == n, F.concat(F.lit(f"{head} — "), tail, F.lit(" (memory-unarchive is local-only).")))
        .otherwise(f"{head} — restore each on the device that archived it (memory-unarchive is local-only).")
    )
    return cold.agg(step.alias("step"))
