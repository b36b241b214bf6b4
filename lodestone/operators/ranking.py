"""Ranked lexical recall over memory, question and entity rows, and the cold-storage valve."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.scratch import written


@dataclass(frozen=True)
class Query:
    """What is asked: free text, a project (None: all), a day, and files and commits at hand."""

    text: str
    project: str | None
    now: str
    files: list[str] = field(default_factory=list)
    commits: list[str] = field(default_factory=list)
    type: str | None = None

    def tokens(self) -> Column:
        return fn.tokens(F.lit(self.text))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _repeats(column: str, wanted: list[str]) -> Column:
    """How many entries, repeats included, are among the wanted."""
    return F.size(F.filter(fn.as_array(F.col(column)), lambda x: F.array_contains(_strings(wanted), x))) if wanted else F.lit(0)


def eligible(memory: DataFrame, q: Query) -> DataFrame:
    """Rows that are live, unexpired, of the type and in scope."""
    live = ~fn.holds(F.col("status").isin("superseded", "archived")) & ~fn.expired(F.col("valid_to"), F.lit(q.now))
    typed = F.lit(True) if q.type is None else F.col("type") == q.type
    return memory.where(live & typed & fn.in_scope(F.col("scope"), q.project))


def memory_parts(words: Column, project: Column, now: Column, files: list[str], commits: list[str]) -> dict[str, Column]:
    """The parts of a memory row's score, by name."""
    body = F.concat_ws(" ", "title", "summary", F.array_join(fn.as_array(F.col("entities")), " "))
    scope = F.when(fn.holds(F.col("scope") == F.concat(F.lit("project:"), project)), 4).when(F.col("scope").isin("global", "user"), 2).otherwise(0)
    return {
        "keyword_hits": F.size(F.array_intersect(words, fn.tokens(body))),
        "scope_points": scope,
        "pinned_points": F.when(F.col("status") == "pinned", 3).otherwise(0),
        "file_hits": _repeats("source_files", files),
        "commit_hits": _repeats("source_commits", commits),
        "recency_points": fn.recency(F.col("updated_at"), now),
        "importance_value": fn.finite(F.col("importance")),
        "usage_points": F.least(fn.finite(F.col("access_count")), F.lit(5.0)) * 0.5,
    }


def _scored(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    c = F.col
    score = 5 * c("keyword_hits") + c("scope_points") + c("pinned_points") + 3 * c("file_hits") + 3 * c("commit_hits") + c("recency_points") + F.least(c("importance_value"), F.lit(3.0)) + c("usage_points")
    shown = F.regexp_replace(c("importance_value").cast("string"), r"\.0$", "")
    why = F.concat_ws(
        " ",
        F.when(c("keyword_hits") > 0, F.concat(F.lit("keyword×"), c("keyword_hits"))),
        F.when(c("scope_points") == 4, F.lit("scope:project")).when(c("scope_points") == 2, F.concat(F.lit("scope:"), c("scope"))),
        F.when(c("pinned_points") > 0, F.lit("pinned")),
        F.when(c("file_hits") > 0, F.concat(F.lit("file×"), c("file_hits"))),
        F.when(c("commit_hits") > 0, F.concat(F.lit("commit×"), c("commit_hits"))),
        F.when(c("importance_value") >= 3, F.concat(F.lit("importance:"), shown)),
    )
    out = rows.where(c("id").isNotNull()).withColumns(parts)
    return out.withColumn("score", score.cast("double")).withColumn("why", F.when(why == "", F.lit("scope-eligible")).otherwise(why))


def rank(memory: DataFrame, q: Query) -> DataFrame:
    """``memory`` with the score's parts, the score and its reasons; rows without an id go."""
    project = F.lit(q.project).cast("string")
    return _scored(memory, memory_parts(q.tokens(), project, F.lit(q.now), q.files, q.commits))


def score_memories(memory: DataFrame, q: Query) -> DataFrame:
    return rank(eligible(memory, q), q)


def score_archived(memory: DataFrame, q: Query) -> DataFrame:
    return rank(memory.where(F.col("status") == "archived"), q)


def ordered(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.collate("id", "UNICODE"))


def top(scored: DataFrame, k: int = 25) -> DataFrame:
    """The k best rows with their place."""
    best = ordered(scored).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.collate("id", "UNICODE"))))


def is_content_hit() -> Column:
    return F.col("keyword_hits") + F.col("file_hits") + F.col("commit_hits") > 0


def cold_pass(memory: DataFrame, q: Query, floor: int = 3, most: int = 3, least_score: float = 2.0) -> DataFrame:
    """Archived rows that answer a query which fewer than ``floor`` live rows answer."""
    if not q.text.strip():
        return score_archived(memory, q).limit(0)
    strong = score_memories(memory, q).where(is_content_hit() & (F.col("score") >= least_score)).limit(floor)
    gate = strong.agg((F.count("*") < floor).alias("open"))
    typed = F.lit(True) if q.type is None else F.col("type") == q.type
    hits = score_archived(memory, q).where(fn.in_scope(F.col("scope"), q.project) & typed & is_content_hit() & (F.col("score") >= least_score))
    hits = hits.where(~fn.holds(F.col("archived_reason") == "superseded-cleanup"))
    return top(hits, most).crossJoin(F.broadcast(gate)).where("open").drop("open")  # one row against three


def layer(scored: DataFrame) -> DataFrame:
    """The part of an answer that a row belongs to."""
    trusted = F.coalesce("trust", F.lit("unknown")) == "trusted"
    part = F.when(F.col("type") == "core", "core").when(F.col("type") == "procedural", "procedures").when((F.col("type") == "semantic") & trusted, "semantic").when(F.col("type") == "semantic", "untrusted_semantic").otherwise("episodes")
    return scored.withColumn("layer", part)


def conflicts(memory: DataFrame) -> DataFrame:
    """Live rows that stand against others, whatever their scope."""
    rows = memory.where(~fn.holds(F.col("status") == "archived") & ((F.col("status") == "superseded") | F.col("supersedes").isNotNull() | F.col("valid_to").isNotNull()))
    why = F.when(F.col("status") == "superseded", "superseded").when(F.col("supersedes").isNotNull(), "supersedes-other").otherwise("time-bounded")
    return rows.withColumn("why", why).withColumn("score", F.lit(0.0))


def usage_bump(scored: DataFrame, usage: DataFrame, now: str, k: int = 5) -> DataFrame:
    """Usage (id, n, last_access) after the k best content hits are counted once more."""
    hit = ordered(scored.where(is_content_hit())).limit(k).select("id").distinct()
    both = usage.join(hit.withColumn("hit", F.lit(True)), "id", "full")
    return both.select("id", (F.coalesce("n", F.lit(0.0)) + F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("n"), F.when(F.col("hit"), F.lit(now)).otherwise(F.col("last_access")).alias("last_access"))


def score_named(rows: DataFrame, q: Query, columns: list[str], word: str) -> DataFrame:
    """Question and entity rows: token overlap over ``columns``, scope and recency (nothing for days ahead)."""
    texts = [F.array_join(fn.as_array(F.col(c)), " ") if rows.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns]
    hits = F.size(F.array_intersect(q.tokens(), fn.tokens(F.concat_ws(" ", *texts))))
    own = fn.holds(F.col("scope") == F.concat(F.lit("project:"), F.lit(q.project).cast("string")))
    scope = F.when(own, 4).when(F.col("scope").isin("global", "user"), 2).otherwise(0)
    out = rows.where(fn.in_scope(F.col("scope"), q.project)).withColumn("hits", hits).withColumn("scope_points", scope)
    score = 5 * F.col("hits") + F.col("scope_points") + fn.recency(F.col("updated_at"), F.lit(q.now), future=0.0)
    why = F.concat_ws(" ", F.when(F.col("hits") > 0, F.concat(F.lit(f"{word}×"), "hits")), F.when(F.col("scope_points") == 4, F.lit("scope:project")).when(F.col("scope_points") == 2, F.concat(F.lit("scope:"), "scope")))
    return out.withColumn("score", score.cast("double")).withColumn("why", F.when(why == "", F.lit("scope-eligible")).otherwise(why))


def score_qa(rows: DataFrame, q: Query) -> DataFrame:
    return score_named(rows, q, ["question", "answer_summary", "tags"], "text")


def score_entities(rows: DataFrame, q: Query) -> DataFrame:
    return score_named(rows, q, ["title", "aliases", "related_entities"], "name")


#: Postings of the largest block that a query reads to find its first k good rows.
SEED = 256


def _hits(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, scope, rest, keyword_hits) of distinct (query_id, id): the words they share, counted once."""
    both = pairs.join(rows, "id").join(asked.select("query_id", "asked"), "query_id")
    return both.select("query_id", "id", "scope", "rest", F.coalesce(F.size(F.array_intersect("asked", "words")), F.lit(0)).alias("keyword_hits"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.collate("id", "UNICODE")))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def batch_top(memory: DataFrame, queries: DataFrame, now: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """The k best rows for each of many queries (query_id, q, project), exactly.

    What a row scores without a query's words and project (rest) orders the postings of a word in a
    scope: a block holds those of one step of rest. A query takes its words rarest first. Rows
    that are best without any word, and the first blocks of its rarest words (of ``seed`` postings
    at most, until there are some for k rows), give each query a score that its k best rows reach
    at least. A row whose rarest word is the i-th of n shares n - i + 1 words at most, so of the
    i-th word only blocks are read that this and their rest can bring up to that score; blocks are
    chosen by their counts, before any posting is joined. Of a query's last word, with which a row
    shares nothing else, the k best postings of each scope do.
    """
    base = eligible(memory, Query("", None, now))
    fixed = memory_parts(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(now), [], [])
    flat = base.where("id is not null").withColumns({n: c for n, c in fixed.items() if n not in ("keyword_hits", "scope_points")})
    body = F.concat_ws(" ", "title", "summary", F.array_join(fn.as_array(F.col("entities")), " "))
    rows = flat.select("id", "scope", (F.col("pinned_points") + F.col("recency_points") + F.least("importance_value", F.lit(3.0)) + F.col("usage_points")).alias("rest"), fn.tokens(body).alias("words"))
    rows = written(rows, "ranked-rows")
    said = queries.select("query_id", "project", F.explode_outer(fn.tokens(F.col("q"))).alias("word"))
    # words go by numbers from here on
    words = written(said.select("word").where("word is not null").distinct().withColumn("w", F.monotonically_increasing_id()), "words")
    asked = written(said.join(words, "word", "left").groupBy("query_id", "project").agg(F.collect_list("w").alias("asked")), "asked")
    reach = asked.select("query_id", F.inline(F.array(*[F.struct(scope.alias("scope"), F.lit(points).alias("points")) for scope, points in ((F.lit("global"), 2), (F.lit("user"), 2), (F.concat(F.lit("project:"), "project"), 4))]))).where("scope is not null")
    # postings of the words that are asked for, in blocks
    step = F.floor(F.col("rest") * 2).cast("int").alias("step")
    postings = written(rows.select("id", "scope", step, "rest", F.explode("words").alias("word")).join(words, "word").drop("word").withColumnRenamed("w", "word"), "postings")
    rows = rows.drop("words").join(postings.groupBy("id").agg(F.collect_list("word").alias("words")), "id", "left")  # as many as the row has
    blocks = written(postings.groupBy("scope", "word", "step").agg(F.count("*").alias("n")), "blocks")
    # a query's words in the order of how many rows in its scopes have them
    mine = reach.join(asked.select("query_id", F.explode("asked").alias("word")), "query_id").join(blocks, ["scope", "word"])
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("df", "word"))
    mine = mine.withColumn("df", F.sum("n").over(Window.partitionBy("query_id", "word"))).withColumn("rank", rank)
    mine = written(mine.withColumn("left", F.max("rank").over(Window.partitionBy("query_id")) - F.col("rank")), "asked-blocks")
    # rows that are the best of a scope without a word, and the first postings
    spare = rows.drop("words").withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("rest"), F.collate("id", "UNICODE")))).where(F.col("nth") <= k)
    others = reach.join(spare, "scope").select("query_id", "id")
    read = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank", F.desc("step"), "scope"))
    first = mine.where(F.col("n") <= seed).withColumn("read", read - F.col("n")).where(F.col("read") < 8 * k)
    seeds = first.join(postings, ["scope", "word", "step"]).select("query_id", "id")
    last = mine.where(F.col("left") == 0).select("scope", "word").distinct()
    ends = postings.join(last, ["scope", "word"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("scope", "word").orderBy(F.desc("rest"), F.collate("id", "UNICODE")))).where(F.col("nth") <= k)
    ends = mine.where(F.col("left") == 0).select("query_id", "scope", "word").distinct().join(ends, ["scope", "word"]).select("query_id", "id")
    score = (5 * F.col("keyword_hits") + F.col("points") + F.col("rest")).cast("double")
    known = _hits(others.unionByName(seeds).unionByName(ends).distinct(), rows, asked).join(reach, ["query_id", "scope"]).withColumn("score", score)
    known = written(known.select("query_id", "id", "keyword_hits", "score"), "first-answers")
    floor = _best(known, k).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    # the blocks that can still hold one of the k best
    most = 5 * (F.col("left") + 1) + F.col("points") + (F.col("step") + 1) / 2
    need = mine.where("left > 0").join(floor, "query_id", "left").where(F.col("least").isNull() | (most >= F.col("least")))
    more = need.select("query_id", "scope", "word", "step").join(postings, ["scope", "word", "step"]).select("query_id", "id").distinct()
    more = more.join(known.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rest = _hits(more, rows, asked).join(reach, ["query_id", "scope"]).withColumn("score", score).select("query_id", "id", "keyword_hits", "score")
    return _best(known.unionByName(rest), k).select("query_id", "id", F.col("keyword_hits").cast("long").alias("keyword_hits"), "score", "place")
