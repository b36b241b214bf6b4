"""Health checks of the store: one frame of findings (check, severity, layer, id, detail, refs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.scratch import written
from .merge import dangling, stale_provenance
from .similarity import count_pairs, kinds, near_duplicate_pairs


def in_scope(project: str | None) -> Column:
    """Rows of the project, and global and user rows; malformed scopes only without a project."""
    return fn.in_scope(F.col("scope"), project)


def finding(rows: DataFrame, check: str, severity: str, layer: str, detail: Column, refs: Column | None = None) -> DataFrame:
    refs = F.array().cast("array<string>") if refs is None else refs
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(layer).alias("layer"), "id", detail.alias("detail"), refs.alias("refs"))


def malformed_dates(memory: DataFrame) -> DataFrame:
    rows = memory.where((F.col("status") == "active") & F.col("valid_to").isNotNull() & fn.calendar_date(F.col("valid_to")).isNull())
    return finding(rows, "malformed-date", "warning", "memory", F.concat(F.lit('unparseable validTo="'), "valid_to", F.lit('"')))


def expired(memory: DataFrame, now: str) -> DataFrame:
    rows = memory.where((F.col("status") == "active") & (fn.calendar_date(F.col("valid_to")) <= now))
    return finding(rows, "expired", "warning", "memory", F.concat(F.lit("active memory expired at validTo="), "valid_to", F.lit(f" (now {now})")))


def dangling_supersedes(memory: DataFrame, whole: DataFrame) -> DataFrame:
    return finding(dangling(memory, "supersedes", whole), "dangling-supersedes", "error", "memory", F.lit("supersedes a memory not in the index"), F.array("ref"))


def superseded_conflicts(memory: DataFrame, whole: DataFrame) -> DataFrame:
    target = whole.where("status = 'active'").select(F.col("id").alias("supersedes")).hint("merge")
    rows = memory.join(target, "supersedes", "left_semi")
    return finding(rows, "superseded-conflict", "error", "memory", F.concat(F.lit("supersedes "), "supersedes", F.lit(" but that target is still status=active")), F.array("supersedes"))


def _sourced(memory: DataFrame) -> DataFrame:
    return memory.where(~fn.holds(F.col("type") == "core") & ~fn.holds(F.col("status") == "pinned"))


def missing_provenance(memory: DataFrame) -> DataFrame:
    none = (F.size("source_sessions") == 0) & (F.size("source_commits") == 0) & (F.size("source_files") == 0)
    return finding(_sourced(memory).where(none), "missing-provenance", "warning", "memory", F.lit("no sourceSessions/sourceCommits/sourceFiles — origin not traceable"))


def stale(memory: DataFrame, sessions: DataFrame) -> DataFrame:
    rows = _sourced(memory)
    rows = rows.join(stale_provenance(rows, sessions).hint("merge"), "id", "left_semi")
    return finding(rows, "stale-provenance", "warning", "memory", F.concat(F.lit("all "), F.size("source_sessions").cast("string"), F.lit(" sourceSessions absent from the spool index — evidence gone")), F.col("source_sessions"))


def leaky(memory: DataFrame) -> DataFrame:
    rows = memory.select("id", F.explode(fn.leaks(F.concat_ws("\n", "title", "summary"))).alias("hit"))
    return finding(rows, "leaky-content", "warning", "memory", F.concat("hit.kind", F.lit(' in title/summary: "'), "hit.sample", F.lit('"')))


def malformed_updates(memory: DataFrame) -> DataFrame:
    rows = memory.where((F.col("status") == "active") & (F.col("type") == "episodic") & fn.epoch_ms(F.col("updated_at")).isNull())
    return finding(rows, "malformed-date", "warning", "memory", F.concat(F.lit('unparseable updatedAt="'), "updated_at", F.lit('"')))


def malformed_entries(memory: DataFrame) -> DataFrame:
    """Rows without the source lists that the checks read, in the order they read them."""
    none = F.col("source_sessions").isNull() | ((F.size("source_sessions") == 0) & (F.col("source_commits").isNull() | ((F.size("source_commits") == 0) & F.col("source_files").isNull())))
    return finding(_sourced(memory).where(none), "malformed-entry", "error", "memory", F.lit("entry has unexpected field types and was skipped"))


def duplicates(memory: DataFrame, threshold: float = 0.6) -> DataFrame:
    pairs = near_duplicate_pairs(memory, threshold).withColumnRenamed("a", "id")
    return finding(pairs, "duplicate-like", "info", "memory", F.concat(F.lit("near-duplicate of "), "b", F.format_string(" (overlap %.2f)", "similarity")), F.array("id", "b"))


def dangling_refs(rows: DataFrame, layer: str, memory: DataFrame, entities: DataFrame) -> DataFrame:
    a = finding(dangling(rows, "source_memory_ids", memory), f"{layer}-dangling-sourceMemoryId", "warning", layer, F.lit("sourceMemoryId not in memory index"), F.array("ref"))
    return a.unionByName(finding(dangling(rows, "related_entities", entities), f"{layer}-unknown-relatedEntity", "warning", layer, F.lit("relatedEntity not in entity index"), F.array("ref")))


def scope_leaks(qa: DataFrame) -> DataFrame:
    implied = F.when(F.startswith("scope", F.lit("project:")), F.substr("scope", F.lit(9)))
    rows = qa.where(~implied.eqNullSafe(F.col("project")))
    show = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))
    return finding(rows, "qa-scope-leak", "error", "qa", F.concat(F.lit("scope="), "scope", F.lit(" implies project="), show(implied), F.lit(" but stored project="), show(F.col("project"))))


def promotion_clusters(memory: DataFrame, least: int = 2) -> DataFrame:
    """Episodes of a project that share an entity, each set of ids once."""
    rows = memory.where("status = 'active' and type = 'episodic'").select("id", F.coalesce("project", F.lit("_global")).alias("project"), F.explode("entities").alias("entity"))
    sets = rows.groupBy("project", F.lower("entity").alias("entity")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") >= least)
    sets = sets.select("ids").distinct().withColumn("id", F.element_at("ids", 1))
    return finding(sets, "promotion-candidate", "info", "memory", F.concat(F.size("ids").cast("string"), F.lit(" episodic entries share an entity — consider promoting a stable fact to semantic/procedural (agent decides)")), F.col("ids"))


def corrupt(states: DataFrame) -> DataFrame:
    """A finding for each index (layer, state, reason) that can't be read."""
    rows = states.where("state = 'corrupt'").withColumn("id", F.concat(F.lit("index."), "layer"))
    return rows.select(F.lit("corrupt-index").alias("check"), F.lit("error").alias("severity"), "layer", "id", F.col("reason").alias("detail"), F.array().cast("array<string>").alias("refs"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scoped(memory: DataFrame, entities: DataFrame, qa: DataFrame, sessions: DataFrame | None, now: str, project: str | None) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of memory in scope, and all checks but that for near-duplicates."""
    own, ents, qas = memory.where(in_scope(project)), entities.where(in_scope(project)), qa.where(in_scope(project))
    parts = [malformed_dates(own), expired(own, now), dangling_supersedes(own, memory), superseded_conflicts(own, memory), missing_provenance(own), leaky(own), malformed_updates(own), malformed_entries(own), dangling_refs(ents, "entity", memory, entities), dangling_refs(qas, "qa", memory, entities), scope_leaks(qas), promotion_clusters(own)]
    return own, parts + ([stale(own, sessions)] if sessions is not None else [])


def report(memory: DataFrame, entities: DataFrame, qa: DataFrame, sessions: DataFrame | None, now: str, project: str | None = None) -> DataFrame:
    """All issues and suggestions; references are looked up in the whole tables.

    Each check is a table of its own, made before the next: a plan of all of them at once takes the
    driver more memory than all else does.
    """
    own, parts = _scoped(memory, entities, qa, sessions, now, project)
    return _union([*[written(p, "findings") for p in parts], duplicates(own)])


def report_counts(memory: DataFrame, entities: DataFrame, qa: DataFrame, sessions: DataFrame | None, now: str, project: str | None = None, threshold: float = 0.6) -> DataFrame:
    """``counts`` of the report, check by check; pairs of near-duplicates are counted by kinds and not made."""
    own, parts = _scoped(memory, entities, qa, sessions, now, project)
    counted = [written(counts(p), "counts") for p in parts]
    pairs = count_pairs(*kinds(own, threshold)).select(F.col("n").alias("issues"), F.lit(0).cast("long").alias("suggestions"))
    return _union([*counted, pairs]).agg(F.sum("issues").alias("issues"), F.sum("suggestions").alias("suggestions"))


def counts(findings: DataFrame) -> DataFrame:
    suggestion = F.col("check") == "promotion-candidate"
    return findings.agg(F.count_if(~suggestion).alias("issues"), F.count_if(suggestion).alias("suggestions"))


def fixes(findings: DataFrame, now: str) -> DataFrame:
    """A proposal to retire each expired row."""
    rows = findings.where("check = 'expired'")
    return rows.select(F.col("id").alias("target_key"), fn.flat_key(F.col("id")).alias("proposal_id"), F.lit("update").alias("action"), F.col("detail").alias("rationale"), F.lit(now).alias("created_at"))


def human(findings: DataFrame) -> DataFrame:
    """One line for each finding."""
    return findings.select("check", "id", F.concat(F.lit("["), "severity", F.lit("] "), "check", F.lit(" "), "id", F.lit(": "), "detail").alias("line"))
