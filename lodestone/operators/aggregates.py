"""Rollups and funnels over sessions and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn


def project_stats(sessions: DataFrame, memory: DataFrame, consumed: DataFrame) -> DataFrame:
    """Totals of each real project over both tables."""
    seen = sessions.where(fn.is_real_project(F.col("project"))).join(consumed.select("session_id", F.lit(1).alias("used")), "session_id", "left")
    s = seen.groupBy("project").agg(F.count("*").alias("total_sessions"), F.count("used").alias("consumed_sessions"))
    typed = memory.where(fn.is_real_project(F.col("project")) & F.col("type").isin(*fn.MEMORY_TYPES))
    m = typed.groupBy("project").agg(F.count("*").alias("memories"), F.count_if(F.col("type") == "episodic").alias("episodes"), F.max("updated_at").alias("last_touched_at"))
    both = s.join(m, "project", "full").fillna(0, ["total_sessions", "consumed_sessions", "memories", "episodes"])
    return both.withColumn("pending_sessions", F.col("total_sessions") - F.col("consumed_sessions"))


def project_order(stats: DataFrame) -> DataFrame:
    """Most pending first, then by name."""
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pending_sessions"), F.collate("project", "UNICODE"))))


def status(stats: DataFrame, merged: DataFrame, n_entities: DataFrame, n_qa: DataFrame) -> DataFrame:
    """One row of totals over projects, layers and devices; counts are one-row frames."""
    total, digested = F.sum("total_sessions"), F.sum("consumed_sessions")
    sums = stats.agg(F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(digested, F.lit(0)).alias("digested"), F.coalesce(F.sum("pending_sessions"), F.lit(0)).alias("pending"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"))
    sums = sums.withColumn("coverage_pct", F.when(F.col("total") > 0, F.floor(100 * F.col("digested") / F.col("total") + 0.5)).otherwise(0).cast("long"))
    devices = merged.agg(F.count("*").alias("merged"), F.count_if("sibling_only").alias("sibling_only"))
    return sums.crossJoin(devices).crossJoin(n_entities).crossJoin(n_qa).withColumn("local", F.col("merged") - F.col("sibling_only"))  # four one-row frames


def first_reason(ladder: list[tuple[str, Column]], last: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(fn.holds(ladder[0][1]), ladder[0][0])
    for name, condition in ladder[1:]:
        out = out.when(fn.holds(condition), name)
    return out.otherwise(last)


def prepare_funnel(sessions: DataFrame, consumed: DataFrame, project: str | None) -> DataFrame:
    """Each session with the first reason to leave it out, or ``new``."""
    rows = sessions.join(consumed.select("session_id", F.lit(True).alias("used")), "session_id", "left")
    other = F.lit(False) if project is None else F.col("project") != project
    reason = first_reason([("digested", F.col("used")), ("pseudo-project", ~fn.is_real_project(F.col("project"))), ("other-project", other), ("missing", F.col("body").isNull()), ("meta", fn.is_own_session(F.try_element_at(fn.user_sections(F.col("body")), F.lit(1))))], "new")
    return rows.withColumn("reason", reason).drop("used")


def import_funnel(found: DataFrame, index: DataFrame, project: str | None = None) -> DataFrame:
    """Each discovered session with the first reason to skip it, or ``imported``."""
    have = index.select("session_id", "mtime_ms", "sha", F.lit(True).alias("same"))
    rows = found.join(have, ["session_id", "mtime_ms", "sha"], "left")
    other = F.lit(False) if project is None else F.col("project") != project
    reason = first_reason([("pseudo-project", ~fn.is_real_project(F.col("project"))), ("other-project", other), ("unchanged", F.col("same")), ("empty", F.col("turns") == 0)], "imported")
    return rows.withColumn("reason", reason).drop("same")


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("reason").agg(F.count("*").alias("n"))


def existing_episodes(memory: DataFrame) -> DataFrame:
    """Ids of the active episodes of each project, sorted."""
    return memory.where("status = 'active' and type = 'episodic'").groupBy(F.coalesce("project", F.lit("_global")).alias("project")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def infer_project(hits: DataFrame, least: int = 5, share: float = 0.7) -> DataFrame:
    """The project that most paths (session_id, slug, pos) of a session belong to; the first seen wins a tie."""
    per = hits.where("slug is not null").groupBy("session_id", "slug").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = per.groupBy("session_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("slug", "n"), F.struct("n", -F.col("first"))).alias("top"))
    confidence = F.when(F.col("total") < least, 0.0).otherwise(F.col("top.n") / F.col("total"))
    return top.select("session_id", F.when((F.col("total") >= least) & (confidence >= share), F.col("top.slug")).alias("project"), confidence.alias("confidence"), F.col("total").alias("total_hits"))
