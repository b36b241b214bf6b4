"""The commands of the store, each an answer as a DataFrame.

Frames come in, frames go out; where files are kept is the caller's matter. ``payload`` turns an
answer into lines of JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import aggregates, archive, evidence, lint, merge, pages, primer, ranking
from .sources import stores

KINDS = {"memory": fn.MEMORY_TYPES, "qa": ["compound", "troubleshooting", "decision", "operational"], "entity": ["file", "symbol", "api", "concept", "person"]}


def list_projects(sessions: DataFrame, memory: DataFrame, skips: DataFrame) -> DataFrame:
    return aggregates.project_order(aggregates.project_stats(sessions, memory, merge.consumed(memory, skips)))


def status(sessions: DataFrame, memory: DataFrame, skips: DataFrame, overlay: DataFrame, entities: DataFrame, qa: DataFrame) -> DataFrame:
    stats = aggregates.project_stats(sessions, memory, merge.consumed(memory, skips))
    return aggregates.status(stats, merge.overlay(memory, overlay), entities.agg(F.count("*").alias("entities")), qa.agg(F.count("*").alias("qa")))


def prepare(sessions: DataFrame, memory: DataFrame, skips: DataFrame, project: str | None = None) -> DataFrame:
    """New sessions (with ``body``) in order of their end, with what they seem worth."""
    rows = aggregates.prepare_funnel(sessions, merge.consumed(memory, skips), project).where("reason = 'new'")
    return rows.withColumn("signals", fn.session_signals(F.col("body"))).drop("body").orderBy("ended_at")


def orchestrate(found: DataFrame, index: DataFrame, project: str | None = None) -> DataFrame:
    """One row: what an import of the sessions found takes over, and what comes next; project None: all of them."""
    of = aggregates.funnel_counts(aggregates.import_funnel(found, index, project))
    count = lambda reason: F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("n"))), F.lit(0))
    counts = [count(r).alias(n) for r, n in (("imported", "imported"), ("unchanged", "unchanged"), ("pseudo-project", "pseudo"), ("other-project", "other"), ("empty", "empty"))]
    step = "run-fanout-then-finalize" if project is None else "run-prepare-then-digest"
    return of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), *counts).select(F.lit("global" if project is None else "project").alias("mode"), F.lit(project).cast("string").alias("project"), "*", F.lit(step).alias("next_step"))


def recall(memory: DataFrame, usage: DataFrame, q: ranking.Query, limit: int = 25, everything: bool = False, resolved: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, cold hits). Without a resolved project the whole store is scored and cold storage stays closed."""
    rows = merge.with_usage(memory, usage)
    scored = ranking.score_memories(rows, q)
    hits = scored if everything else ranking.top(scored, limit)
    cold = ranking.cold_pass(rows, q)
    return hits, cold if resolved else cold.limit(0)


def overview(memory: DataFrame, q: ranking.Query) -> DataFrame:
    """One row (primer): the primer of the project that is asked about without words, else an empty text."""
    rows = primer.render(memory, q.project or "", q.now)
    return rows if q.project and not q.text.strip() else rows.select(F.lit("").alias("primer"))


def memory_query(memory: DataFrame, usage: DataFrame, q: ranking.Query) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layered hits, conflicts, cold hits); an unknown type is no filter, and without a text the primer's order stands in."""
    q = q if q.type in KINDS["memory"] else ranking.Query(q.text, q.project, q.now, q.files, q.commits)
    rows = merge.with_usage(memory, usage)
    cold = ranking.cold_pass(rows, q)
    return ranking.layer(ranking.score_memories(rows, q)), ranking.conflicts(rows), cold if q.project else cold.limit(0)


def memory_primer(memory: DataFrame, project: str, now: str) -> DataFrame:
    return primer.render(memory, project, now)


def qa_query(qa: DataFrame, q: ranking.Query, kind: str | None = None) -> DataFrame:
    rows = qa.where(F.col("kind") == kind) if kind in KINDS["qa"] else qa
    return ranking.score_qa(rows, q).select("id", "question", "answer_summary", "kind", "project", "score", "why")


def entity_query(entities: DataFrame, q: ranking.Query, kind: str | None = None) -> DataFrame:
    rows = entities.where(F.col("kind") == kind) if kind in KINDS["entity"] else entities
    return ranking.score_entities(rows, q)


def memory_lint(memory: DataFrame, entities: DataFrame, qa: DataFrame, sessions: DataFrame | None, now: str, project: str | None = None) -> DataFrame:
    return lint.report(memory, entities, qa, sessions, now, project)


def memory_archive(memory: DataFrame, overlay: DataFrame, usage: DataFrame, sessions: DataFrame | None, now: str, compared: list[str] | None = None) -> DataFrame:
    """(id, reason) of the rows to archive; those that another device has newer stay."""
    clash = merge.overlay_conflicts(memory, overlay, compared).where("conflict").select("id")
    return archive.plan(memory.join(clash, "id", "left_anti"), now, usage, sessions)


def archive_counts(memory: DataFrame, overlay: DataFrame, chosen: DataFrame, malformed: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """One row: rows archived, and rows left out because they are malformed (id) or another device has them newer."""
    clash = merge.overlay_conflicts(memory.join(malformed, "id", "left_anti"), overlay, compared)
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    return one(chosen, "archived").join(one(malformed, "malformed")).join(one(clash.where("conflict"), "in_conflict"))  # frames of one row


def primers_touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scope): the scopes whose primers a write changes; a global or user row touches every project's."""
    columns = [c for c in before.columns if c != "id"]
    both = before.select("id", F.struct(*columns).alias("old")).join(after.select("id", F.struct(*columns).alias("new")), "id", "full").where("not old <=> new")
    return both.select(F.explode(F.array("old.scope", "new.scope")).alias("scope")).where("scope is not null").distinct()


def memory_write(store: DataFrame, items: DataFrame, now: str, proposed: bool = False) -> DataFrame:
    """The store after a batch, which is refused whole if a row leaks or needs review (proposed: only rows that do pass)."""
    body = F.concat_ws("\n", "title", "summary", *[F.array_join(c, "\n") for c in ("source_files", "entities")])
    if items.where(fn.has_blocking_leak(body)).limit(1).count():
        raise ValueError("a row holds a home path or a secret")
    if not proposed and archive.gate(items, store).where("gated").limit(1).count():
        raise ValueError("a row needs review: propose it")
    return archive.upsert(store, items, now)


def memory_propose(store: DataFrame, items: DataFrame) -> DataFrame:
    """Proposals of the rows that need review, the last of each target."""
    rows = archive.gate(items, store).where("gated").join(items.select("id", "order"), "id")
    return archive.keep_last(rows, "target_key")


def memory_diff(proposals: DataFrame, store: DataFrame, fields: list[str]) -> DataFrame:
    return archive.changed_fields(proposals, store, fields)


def memory_approve(store: DataFrame, proposals: DataFrame, target_key: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(store, queue) after one proposal is applied."""
    return archive.upsert(store, proposals.where(F.col("target_key") == target_key).drop("target_key"), now), memory_reject(proposals, target_key)


def memory_reject(proposals: DataFrame, target_key: str) -> DataFrame:
    return proposals.where(F.col("target_key") != target_key)


def skip_write(skips: DataFrame, new: DataFrame, at: str) -> DataFrame:
    return archive.merge_skips(skips, new, at)


def qa_write(store: DataFrame, items: DataFrame, today: str) -> DataFrame:
    return pages.put(store, pages.qa_writes(items, today).where("defect is null"))


def entity_write(store: DataFrame, items: DataFrame, today: str) -> DataFrame:
    return pages.put(store, pages.entity_writes(items, today).where("defect is null"))


def memory_index(documents: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    return stores.rebuild(documents, today)


def retro_gate(rows: DataFrame) -> DataFrame:
    return evidence.decide(rows)


def payload(answer: DataFrame) -> DataFrame:
    """An answer as lines of JSON."""
    return answer.select(F.to_json(F.struct("*")).alias("value"))
