"""Archival planning and the lifecycle of memory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.scratch import written
from .merge import stale_provenance, with_usage
from .similarity import classes, kinds, pairs_of


def rule_reasons(memory: DataFrame, now: str, usage: DataFrame | None = None, sessions: DataFrame | None = None, episodic_days: int = 90, unused_days: int = 60, unused_importance: float = 2.0) -> DataFrame:
    """(id, reason): the first rule that archives each row, by itself."""
    rows = memory.where(~fn.holds(F.col("type") == "core") & ~fn.holds(F.col("status").isin("pinned", "archived")))
    if usage is not None:
        rows = with_usage(rows, usage)
    stale = F.lit(False)
    if sessions is not None:
        rows = rows.join(stale_provenance(rows, sessions).withColumn("stale", F.lit(True)).hint("merge"), "id", "left")
        stale = F.coalesce("stale", F.lit(False))
    age = fn.days_between(F.lit(now), F.col("updated_at"))
    unused = F.col("type").isin("semantic", "procedural") & (F.coalesce("access_count", F.lit(0.0)) == 0) & (F.col("importance") <= unused_importance) & (age > unused_days)
    reason = (
        F.when(F.col("status") == "superseded", "superseded-cleanup")
        .when(fn.expired(F.col("valid_to"), F.lit(now)), "expired")
        .when((F.col("type") == "episodic") & (age > episodic_days), f"stale-episodic:>{episodic_days}d")
        .when(stale, "stale-provenance")
        .when(unused, "unused-low-value")
    )
    return rows.select("id", reason.alias("reason")).where("reason is not null")


def running(rows: DataFrame, group: str, order: list[Column], **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values``, its maximum over the rows before in the order of their group (nulls are left out).

    Rows are sorted in ranges, so that a group of any size is dealt to many tasks; what the ranges
    before hold of a group is a table of one row for each range and group.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    at = rows.withColumns({f"__{k}": v for k, v in values.items()}).repartitionByRange(n, F.col(group), *order)
    at = written(at.withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = at.withColumns({f"__in_{k}": F.max(f"__{k}").over(before) for k in values})
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(group, "__part").agg(*[F.max(f"__{k}").alias(k) for k in values])
    parts = parts.select(group, "__part", *[F.max(k).over(earlier).alias(f"__by_{k}") for k in values])
    return inside.join(parts.hint("merge"), [group, "__part"]).select(*rows.columns, *[F.greatest(f"__in_{k}", f"__by_{k}").alias(k) for k in values])


def _cliques(rows: DataFrame) -> DataFrame:
    """(id, winner) of rows (group, id, seq, importance, ms, may_go, gone) whose groups hold nothing but near-duplicates of one another.

    The pairs of such a group need not be made. Let the best row be the one of most importance, then
    the newest, then of the largest id; a row that a rule archives wins no pair, and a pinned row
    loses none. In the order of their rows, pairs before the best row remove all that precedes it
    and every later row falls to it. So the last pair that a row loses is with the last better row,
    if the best one comes after it, and else with the best; pinned rows stay to the end and count
    wherever they lie, and a pinned row before has removed whatever it is better than by then.
    """
    better = [F.col("importance").desc(), F.col("ms").desc(), F.col("id").desc()]
    worth = F.struct("importance", "ms", "id")
    place = F.struct("seq", "id")
    wins, stays = ~F.col("gone"), ~F.col("may_go")
    rows = running(rows, "group", better, loose=F.when(wins & ~stays, place), pinned=F.when(wins & stays, place))
    rows = written(running(rows, "group", [F.col("seq")], held=F.when(wins & stays, F.struct("importance", "ms", "id", "loose"))), "placed")
    best = rows.where(wins).groupBy("group").agg(F.max_by(place, worth).alias("best"), F.max(worth).alias("worth"))
    rows = rows.where("may_go").join(best.hint("merge"), "group").where(F.col("worth") > worth)
    above = F.when(F.struct("held.importance", "held.ms", "held.id") > worth, F.col("held.loose")).otherwise(F.col("loose"))
    winner = F.when(F.col("best.seq") > F.col("seq"), F.greatest(above, "pinned")).otherwise(F.greatest("pinned", "best"))
    return rows.select("id", winner["id"].alias("winner"))


def _rounds(pairs: DataFrame) -> DataFrame:
    """(id, winner) after pairs (loser, winner, at) in the order ``at``: one counts unless its winner has lost a pair that counts before.

    Rounds decide all pairs side by side: one falls if its winner has lost an earlier pair that
    counts, and counts if no earlier undecided pair could still remove its winner. The first
    undecided pair is decided in each round, so the rounds end; each is a written table.
    """
    open_pairs = written(pairs, "pairs")
    counted = None
    while not open_pairs.isEmpty():
        may = open_pairs.groupBy(F.col("loser").alias("winner")).agg(F.min("at").alias("may"))
        rows = open_pairs.join(may.hint("merge"), "winner", "left")
        if counted is None:
            rows = rows.withColumn("lost", F.lit(None).cast(open_pairs.schema["at"].dataType))
        else:
            rows = rows.join(counted.groupBy(F.col("loser").alias("winner")).agg(F.min("at").alias("lost")).hint("merge"), "winner", "left")
        falls = F.col("lost") < F.col("at")
        counts = ~F.coalesce(falls, F.lit(False)) & F.coalesce(F.col("may") > F.col("at"), F.lit(True))
        rows = written(rows.select("loser", "winner", "at", F.when(falls, F.lit(False)).when(counts, F.lit(True)).alias("counts")), "pairs")
        done = rows.where("counts").drop("counts")
        open_pairs, counted = rows.where("counts is null").drop("counts"), done if counted is None else counted.unionByName(done)
    if counted is None:
        return pairs.select(F.col("loser").alias("id"), "winner").limit(0)
    return counted.groupBy(F.col("loser").alias("id")).agg(F.max_by("winner", "at").alias("winner"))


def plan(memory: DataFrame, now: str, usage: DataFrame | None = None, sessions: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """(id, reason): rules, then near-duplicates, of which the less important or older row goes.

    A pair counts only while its winner stays, so pairs are decided in the order of their rows.
    Groups in which all rows are near-duplicates of one another, copies above all, need no pairs;
    the pairs of other groups, and of groups with a row without a date, are decided in rounds.
    Tables of ids and groups grow with the rows and are several times smaller on disk than in
    memory, so no join broadcasts them by their size on disk.
    """
    rules = written(rule_reasons(memory, now, usage, sessions), "rules")
    members, links = kinds(memory, threshold, ("active", "pinned"))
    about = memory.select("id", F.when(~F.isnan("importance"), F.col("importance")).alias("importance"), fn.epoch_ms(F.col("updated_at")).alias("ms"), (~fn.holds(F.col("type") == "core") & ~fn.holds(F.col("status").isin("pinned", "archived"))).alias("may_go"))
    about = about.where("importance is not null").join(rules.select("id", F.lit(True).alias("gone")).hint("merge"), "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    group = classes(members, links).select("kind", F.col("class").alias("group"), (F.col("links") == F.col("kinds") * (F.col("kinds") - 1) / 2).alias("whole"))
    rows = written(members.join(group.hint("merge"), "kind").join(about.hint("merge"), "id"), "grouped")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole"), F.bool_and(F.col("ms").isNotNull()).alias("dated"), F.bool_or("may_go").alias("may")).where("n > 1 and may")
    sizes = written(sizes.select("group", (F.col("whole") & F.col("dated")).alias("whole")), "groups")
    rows = written(rows.drop("whole").join(sizes.hint("merge"), "group"), "grouped")
    found = _cliques(rows.where("whole").select("group", "id", "seq", "importance", "ms", "may_go", "gone"))
    rest = rows.where("not whole")
    if not rest.isEmpty():
        side = lambda x: rest.select(F.col("id").alias(x), F.struct("importance", "ms", "may_go", "gone").alias(f"of_{x}")).hint("merge")
        met = pairs_of(rest.select("id", "seq", "block", "kind"), links).join(side("a"), "a").join(side("b"), "b")
        a, b = F.col("of_a"), F.col("of_b")
        met = met.where((a["importance"] != b["importance"]) | (a["ms"].isNotNull() & b["ms"].isNotNull()))
        a_loses = F.when(a["importance"] != b["importance"], a["importance"] < b["importance"]).otherwise(a["ms"] <= b["ms"])
        pick = lambda yes, no: F.when(a_loses, yes).otherwise(no)
        met = met.where(pick(a["may_go"], b["may_go"]) & ~pick(b["gone"], a["gone"]))
        found = found.unionByName(_rounds(met.select(pick(F.col("a"), F.col("b")).alias("loser"), pick(F.col("b"), F.col("a")).alias("winner"), F.struct("seq_a", "seq_b").alias("at"))))
    near = found.select("id", F.concat(F.lit("near-duplicate-of:"), "winner").alias("near"))
    return rules.join(near, "id", "full").select("id", F.coalesce("near", "reason").alias("reason"))


def apply_plan(memory: DataFrame, chosen: DataFrame, now: str) -> DataFrame:
    """``memory`` with the chosen rows archived."""
    joined = memory.drop("archived_reason", "archived_at").join(chosen.select("id", F.col("reason").alias("archived_reason")), "id", "left")
    gone = F.col("archived_reason").isNotNull()
    old = memory.select("id", F.col("archived_reason").alias("had"))
    out = joined.join(old, "id", "left").withColumn("status", F.when(gone, "archived").otherwise(F.col("status")))
    return out.withColumn("archived_at", F.when(gone, F.lit(now))).withColumn("archived_reason", F.coalesce("archived_reason", "had")).drop("had")


def unarchive(memory: DataFrame, now: str, ids: DataFrame | None = None) -> DataFrame:
    """Archived rows brought back: superseded if that is why they went, else active without an end that has passed."""
    rows = memory.where("status = 'archived'")
    rows = rows if ids is None else rows.join(ids, "id", "left_semi")
    status = F.when(F.col("archived_reason") == "superseded-cleanup", "superseded").otherwise("active")
    passed = (status == "active") & fn.expired(F.col("valid_to"), F.lit(now))
    return rows.withColumn("valid_to", F.when(~passed, F.col("valid_to"))).withColumn("status", status).withColumn("archived_reason", F.lit(None).cast("string"))


def upsert(store: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """The store after a batch of writes (seq gives their order), later ones seeing earlier ones.

    The last write of an id gives its fields; source lists are united in order; an archived row
    keeps its state and its stamp never falls; a row that a write supersedes becomes superseded,
    and an archived one is marked for cleanup.
    """
    lists = ["source_sessions", "source_files", "source_commits"]
    fields = [c for c in store.columns if c not in ("id", *lists)]
    last = items.groupBy("id").agg(F.max_by(F.struct(*fields, "order"), "order").alias("new"), *[F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", F.col(c).alias("x")))), lambda s: s.x))).alias(f"add_{c}") for c in lists])
    flips = items.where("length(supersedes) > 0").groupBy(F.col("supersedes").alias("id")).agg(F.max("order").alias("flipped"))
    both = store.select("id", F.struct(*fields).alias("old"), *lists).join(last, "id", "full").join(flips, "id", "left")
    kept = F.col("old.status") == "archived"
    value = {}
    for c in fields:
        value[c] = F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    stamped = F.greatest(F.coalesce("old.updated_at", F.lit("")), F.coalesce("new.updated_at", F.lit(now)))
    value["updated_at"] = F.when(F.col("new").isNull(), F.col("old.updated_at")).when(fn.holds(kept), stamped).otherwise(F.coalesce("new.updated_at", F.lit(now)))
    status = F.when(fn.holds(kept) | F.col("new").isNull(), F.col("old.status")).otherwise(F.coalesce("new.status", F.lit("active")))
    after = F.col("flipped").isNotNull() & (F.col("new").isNull() | (F.col("flipped") >= F.col("new.order")))
    value["archived_reason"] = F.when(after & fn.holds(kept), F.lit("superseded-cleanup")).otherwise(F.when(fn.holds(kept), F.col("old.archived_reason")).otherwise(value["archived_reason"]))
    value["status"] = F.when(after & ~fn.holds(status == "archived"), "superseded").otherwise(status)
    empty = F.array().cast("array<string>")
    united = [F.array_distinct(F.concat(F.coalesce(c, empty), F.coalesce(f"add_{c}", empty))).alias(c) for c in lists]
    return both.select("id", *[value[c].alias(c) for c in fields], *united)


def upsert_changes(store: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """The rows of ``upsert`` that a batch of writes makes or changes: those that it names, and those that it supersedes."""
    touched = items.select("id").union(items.where("length(supersedes) > 0").select("supersedes")).distinct()
    return upsert(store.join(touched, "id", "left_semi"), items, now)


def keep_last(items: DataFrame, key: str, order: str = "order") -> DataFrame:
    """The last item of each key."""
    names = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("row")).select(key, "row.*")


def gate(items: DataFrame, store: DataFrame) -> DataFrame:
    """Each write with its target, its action and whether it needs review."""
    live = store.select("id", F.struct("type", "status", F.coalesce("trust", F.lit("unknown")).alias("trust")).alias("prior"))
    target = store.select(F.col("id").alias("sup"), F.struct("type", "status").alias("target"))
    rows = items.withColumn("sup", fn.supersedes_id(F.col("supersedes"))).join(live, "id", "left").join(target, "sup", "left")
    lifted = fn.holds((F.coalesce("trust", F.lit("unknown")) == "trusted") & (F.col("prior.trust") != "trusted"))
    gated = fn.is_gated(F.col("type"), F.col("status")) | fn.is_gated(F.col("prior.type"), F.col("prior.status")) | fn.is_gated(F.col("target.type"), F.col("target.status")) | lifted
    action = F.when(F.col("target").isNotNull(), "replace").when(F.col("prior").isNotNull(), "update").otherwise("create")
    return rows.select("id", F.coalesce("sup", "id").alias("target_key"), action.alias("action"), lifted.alias("trust_elevation"), gated.alias("gated"))


def merge_skips(skips: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Skips (session_id, reason, at) with new ones: the first time stays, a reason changes only to a non-empty one."""
    reason = F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, 200)
    add = new.groupBy("session_id").agg(F.max_by(reason, "order").alias("more"))
    both = skips.join(add, "session_id", "full")
    return both.select("session_id", F.coalesce(F.when(F.col("more") != "", F.col("more")), "reason", F.lit("")).alias("reason"), F.coalesce("at", F.lit(at)).alias("at"), F.col("at").isNull().alias("added"))


def changed_fields(proposed: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """(id, changes): fields whose texts differ between a proposal and its live row."""
    both = proposed.alias("p").join(live.alias("l"), F.col("p.target_key") == F.col("l.id"), "left")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("null"))
    rows = [F.when(text("p", c) != text("l", c), F.struct(F.lit(c).alias("field"), text("l", c).alias("before"), text("p", c).alias("after"))) for c in fields]
    return both.select(F.col("p.id").alias("id"), F.array_compact(F.array(*rows)).alias("changes"))
