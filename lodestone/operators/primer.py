"""The primer: what a project's sessions should know from the start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn

SECTIONS = {"core": "Core rules", "semantic": "Project facts", "procedural": "Procedures & gotchas"}


def ranked(memory: DataFrame, project: str, now: str) -> DataFrame:
    """Rows of the primer with their place in their section and its size."""
    trusted = (F.col("type") != "semantic") | (F.coalesce("trust", F.lit("unknown")) == "trusted")
    live = ~fn.holds(F.col("status").isin("superseded", "archived")) & ~fn.expired(F.col("valid_to"), F.lit(now))
    scope = fn.holds(F.col("scope").isin("global", "user")) | fn.holds(F.col("project") == project)
    rows = memory.where(F.col("type").isin(*SECTIONS) & live & scope & trusted)
    order = [F.desc(fn.finite(F.col("importance"))), F.desc(fn.finite(F.col("confidence"), 0.5)), F.desc("updated_at"), F.collate("title", "UNICODE")]
    place = F.row_number().over(Window.partitionBy("type").orderBy(*order, "id"))
    return rows.withColumn("place", place).withColumn("of", F.count("*").over(Window.partitionBy("type")))


def render(memory: DataFrame, project: str, now: str, most: int = 12) -> DataFrame:
    """One row (primer): the sections as Markdown, empty without a row."""
    rows = ranked(memory, project, now).where(F.col("place") <= most)
    mark = F.when(F.col("confidence") < 0.5, F.lit(" _(tentative)_")).otherwise(F.lit(""))
    line = F.concat(F.lit("- **"), "title", F.lit("**"), mark, F.lit(" — "), "summary")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x.line), "\n")
    hidden = F.max("of") - F.count("*")
    footer = F.when(hidden > 0, F.concat(F.lit("\n- _…and "), hidden.cast("string"), F.lit(" more_"))).otherwise(F.lit(""))
    name = F.coalesce(*[F.when(F.col("type") == t, F.lit(n)) for t, n in SECTIONS.items()])
    parts = rows.groupBy("type").agg(lines.alias("lines"), footer.alias("footer"))
    parts = parts.select(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("type")).alias("nth"), F.concat(F.lit("## "), name, F.lit("\n\n"), "lines", "footer", F.lit("\n")).alias("part"))
    head = f"# Project memory: {project}\n\n> Auto-generated primer. The agent should treat this as already-known project context.\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda x: x.part), "\n")
    return parts.agg(F.when(F.count("*") == 0, F.lit("")).otherwise(F.concat(F.lit(head + "\n"), body)).alias("primer"))
