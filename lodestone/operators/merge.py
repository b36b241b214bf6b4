"""Joins of the memory store: other devices, usage, consumed and known sessions, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn


def overlay(local: DataFrame, other: DataFrame) -> DataFrame:
    """Both stores by id; the later UTC day wins, the local row a tie, an unreadable stamp never."""
    names = [c for c in local.columns if c in other.columns]
    a = local.select("id", F.struct(*names).alias("here"))
    b = other.select("id", F.struct(*names).alias("there"))
    both = a.join(b, "id", "full")
    mine, theirs = fn.calendar_date(F.col("here.updated_at")), fn.calendar_date(F.col("there.updated_at"))
    away = F.col("here").isNull() | (F.col("there").isNotNull() & theirs.isNotNull() & (mine.isNull() | (theirs > mine)))
    picked = both.select(F.when(away, F.col("there")).otherwise(F.col("here")).alias("row"), F.when(away, "overlay").otherwise("local").alias("source"), F.col("here").isNull().alias("sibling_only"))
    return picked.select("row.*", "source", "sibling_only")


def with_usage(memory: DataFrame, usage: DataFrame) -> DataFrame:
    """Access counts of the usage records; rows without one keep their own."""
    seen = usage.select("id", F.greatest(F.floor("n"), F.lit(0)).cast("double").alias("seen"), "last_access")
    joined = memory.drop("last_access").join(seen, "id", "left")
    return joined.withColumn("access_count", F.coalesce("seen", "access_count")).drop("seen")


def consumed(memory: DataFrame, skips: DataFrame) -> DataFrame:
    """Session ids that episodes cite or that are skipped."""
    cited = memory.where("type = 'episodic'").select(F.explode("source_sessions").alias("session_id"))
    return cited.union(skips.select("session_id")).distinct()


def dangling(rows: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """(id, ref): references of a text or array column to ids that aren't there."""
    ref = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    return rows.select("id", ref.alias("ref")).where("ref is not null").join(targets.select(F.col("id").alias("ref")).distinct().hint("merge"), "ref", "left_anti").select("id", "ref")


def known_sessions(cited: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct cited ids that name a session: the same id, or one the start of the other with eight characters or more.

    The starts of each side's ids are exploded and joined to the other side's whole ids, so that
    ids which begin alike don't meet under one key.
    """
    ids = cited.select("session_id").distinct()
    known = sessions.select(F.col("session_id").alias("known")).distinct().hint("merge")
    starts = lambda x: F.explode(F.transform(F.sequence(F.lit(8), F.length(x)), lambda n: F.left(x, n)))
    exact = ids.join(known, ids.session_id == known.known, "left_semi")
    longer = ids.where(F.length("session_id") > 8).select("session_id", starts(F.col("session_id")).alias("start"))
    shorter = known.where(F.length("known") > 8).select(starts(F.col("known")).alias("start")).distinct().hint("merge")
    near = longer.join(known, longer.start == known.known, "left_semi").select("session_id")
    far = ids.where(F.length("session_id") >= 8).join(shorter, F.col("session_id") == F.col("start"), "left_semi")
    return exact.union(near).union(far).distinct()


def stale_provenance(memory: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ids of rows that cite sessions of which none is known."""
    cited = memory.select("id", F.explode("source_sessions").alias("session_id"))
    known = known_sessions(cited, sessions).withColumn("known", F.lit(1)).hint("merge")
    return cited.join(known, "session_id", "left").groupBy("id").agg(F.max("known").alias("known")).where("known is null").select("id")


def changed_sessions(found: DataFrame, index: DataFrame) -> DataFrame:
    """Sessions whose (key, time, hash) the index doesn't have."""
    key = ["session_id", "mtime_ms", "sha"]
    same = [found[k].eqNullSafe(index[k]) for k in key]
    return found.join(index, same[0] & same[1] & same[2], "left_anti")


#: What makes two copies of a memory row the same.
CONTENT = ["status", "title", "summary", "importance", "confidence", "created_at", "valid_to", "valid_from", "supersedes", "archived_reason", "archived_at", "type", "scope", "project", "trust", "entities", "body"]


def overlay_conflicts(local: DataFrame, other: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """(id, conflict): the other device has a later day, or the same day with other contents.

    A copy that is there but has no readable day, on either side, is a conflict; so is a null body,
    which could not be compared. compared: columns; all of ``CONTENT`` that a side has by default,
    null where the other side lacks the column.
    """
    compared = compared or [c for c in CONTENT if c in local.columns or c in other.columns]
    side = lambda df: df.select("id", "updated_at", *[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in compared], F.lit(True).alias("there"))
    both = side(local).alias("a").join(side(other).alias("b"), "id", "left")
    mine, theirs = fn.calendar_date(F.col("a.updated_at")), fn.calendar_date(F.col("b.updated_at"))
    differs = F.lit(False)
    for c in compared:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "trust":
            x, y = (F.coalesce(v, F.lit("unknown")) for v in (x, y))
        elif c == "entities":
            x, y = (F.array_sort(F.coalesce(v.cast("array<string>"), F.array().cast("array<string>"))) for v in (x, y))
        differs = differs | ~x.eqNullSafe(y)
        if c == "body":
            differs = differs | x.isNull()
    conflict = F.when(F.col("b.there").isNull(), False).when(mine.isNull() | theirs.isNull(), True).when(theirs != mine, theirs > mine).otherwise(differs)
    return both.select("id", conflict.alias("conflict"))


def entity_lookup(memory: DataFrame, name: str) -> DataFrame:
    """Rows that name an entity (in any case) or hold the name in their title."""
    low = name.lower()
    return memory.where(F.exists("entities", lambda e: F.lower(e) == low) | F.contains(F.lower("title"), F.lit(low)))


def matched_entities(entities: DataFrame, name: str) -> DataFrame:
    low = name.lower()
    return entities.where((F.lower("title") == low) | F.exists("aliases", lambda e: F.lower(e) == low) | F.endswith(F.lower("id"), F.lit(f"/{low}")))


def resolve_project(index: DataFrame, slug: str, cwd: str) -> DataFrame:
    """One row (project): the slug if a session has it, else the project of the newest session of the folder."""
    rank = F.when(F.col("project") == slug, 0).when(F.col("project_raw") == cwd, 1)
    return index.withColumn("rank", rank).where("rank is not null").agg(F.min_by("project", F.struct("rank", "project")).alias("project"))


def superseded_renders(index: DataFrame, written: DataFrame) -> DataFrame:
    """Old paths of rewritten sessions (session_id, path) that no current row refers to."""
    old = index.alias("o").join(written.alias("n"), "session_id").where("o.path <> n.path").select(F.col("o.path").alias("path"))
    current = index.join(written.select("session_id"), "session_id", "left_anti").select("path").union(written.select("path"))
    return old.distinct().join(current.distinct(), "path", "left_anti")


def projects_of_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, slug): of the longest root (root) above each absolute path, else of its folder; system folders and homes have none.

    A path's folders are exploded and joined to the roots, so that the prefix match is a hash join.
    """
    rows = paths.where(F.startswith("path", F.lit("/"))).select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    best = rows.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    system = folder.rlike("^(/tmp/|/private/tmp/|/etc|/usr|/var|/System|/opt)") | (folder == "")
    own = fn.project_slug_of_path(folder)
    slug = F.when(F.col("root").isNotNull(), fn.project_slug_of_path(F.col("root"))).when(~system & ~own.isin("home", "root"), own)
    return rows.join(best, "path", "left").select("path", slug.alias("slug"))
