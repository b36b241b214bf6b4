"""Retrieval metrics of ranked answers against gold and excluded ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of queries in one automaton; more queries make more automata, each of which reads the texts once.
SHARD_BYTES = 2 << 20

_AUTOMATA: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """This worker's automaton of some strings, kept for its next task; one at a time."""
    if words not in _AUTOMATA:
        _AUTOMATA.clear()
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, w)
        found.make_automaton()
        _AUTOMATA[words] = found
    return _AUTOMATA[words]


def _held(texts: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``texts`` without ``__text``, once for each of ``words`` that stands in it, named in ``__asked``."""
    shared = texts.sparkSession.sparkContext.broadcast(tuple(w for w in words if w))
    always = [w for w in words if not w]  # stands in every text
    kind = texts.drop("__text").schema.add("__asked", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(shared.value) if shared.value else None
        for batch in batches:
            rows, asked = [], []
            for i, text in enumerate(batch.column("__text").to_pylist()):
                if text is None:
                    continue
                here = [*({w for _, w in found.iter(text)} if found else ()), *always]
                rows += [i] * len(here)
                asked += here
            of = batch.drop_columns(["__text"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(asked, pa.string())], names=[*of.schema.names, "__asked"])

    return texts.mapInArrow(run, kind)


def containing(rows: DataFrame, keys: list[str], text: Column, queries: DataFrame, q: str = "q") -> DataFrame:
    """The ``keys`` of ``rows`` beside each of ``queries`` whose ``q`` stands in the row's ``text``, in any case.

    An Aho-Corasick automaton of the different queries runs once over each text, in Arrow batches;
    queries over ``SHARD_BYTES`` are cut into shards by hash, each with an automaton of its own.
    Null texts hold nothing, null queries stand nowhere, and an empty query stands in every text.
    """
    low = F.lower(F.col(q).cast("string"))
    asked = queries.select(low.alias("__asked")).where("__asked is not null").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("__asked") + 1), F.lit(0))).first()[0]
    shards = -(-size // SHARD_BYTES) or 1
    parts = []
    for shard in range(shards):
        words = asked.where(F.pmod(F.xxhash64("__asked"), F.lit(shards)) == shard).collect()  # SHARD_BYTES on average
        parts.append(_held(rows.select(*keys, F.lower(text).alias("__text")), tuple(sorted(w[0] for w in words))))
    return reduce(DataFrame.unionByName, parts).join(queries.withColumn("__asked", low), "__asked").drop("__asked")


def case_results(cases: DataFrame, answers: DataFrame, gold: DataFrame, excluded: DataFrame, k: int = 5) -> DataFrame:
    """One row for each case (case_id, category, abstain).

    answers: (case_id, id, place, content_hit), places 1, 2, 3 ..; gold and excluded: (case_id, id).
    Ids are never gathered in one row: a case with very many gold ids is counted, not listed.
    """
    top = F.col("place") <= k
    marked = answers.join(gold.select("case_id", "id").distinct().withColumn("gold", F.lit(True)), ["case_id", "id"], "left").join(excluded.select("case_id", "id").distinct().withColumn("excluded", F.lit(True)), ["case_id", "id"], "left")
    good = F.col("gold").isNotNull()
    of = marked.groupBy("case_id").agg(
        F.count_if(top).alias("n_top"),
        F.count_if(top & good).alias("n_good"),
        F.count_distinct(F.when(top & good, F.col("id"))).alias("n_found"),
        F.min(F.when(good, F.col("place"))).alias("first"),
        F.count_if(top & F.col("excluded").isNotNull()).alias("n_excluded"),
        F.coalesce(F.bool_or(F.when(top, F.col("content_hit"))), F.lit(False)).alias("answered"),
    )
    wanted = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    rows = cases.join(wanted, "case_id", "left").join(of, "case_id", "left")
    part = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    rows = rows.withColumn("recall", part("n_found", "n_gold")).withColumn("precision", part("n_good", "n_top")).withColumn("mrr", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    rows = rows.withColumn("gold_hit", F.col("recall") > 0).withColumn("exclusion_ok", F.coalesce("n_excluded", F.lit(0)) == 0).withColumn("abstain_ok", ~F.col("abstain") | ~F.coalesce("answered", F.lit(False)))
    return rows.withColumn("passed", F.when(F.col("abstain"), F.col("abstain_ok") & F.col("exclusion_ok")).otherwise(F.col("gold_hit") & F.col("exclusion_ok"))).drop("n_gold", "n_top", "n_good", "n_found", "first", "n_excluded", "answered")


def report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals and means; abstention cases are out of the means and have their own accuracy (1 without one)."""
    scored = ~F.col("abstain")
    mean = lambda c: F.coalesce(F.avg(F.when(scored, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    accuracy = F.coalesce(F.avg(F.when(F.col("abstain"), F.col("abstain_ok").cast("double"))), F.lit(1.0))
    return results.groupBy(*(by or [])).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(scored).alias("scored"), mean("recall"), mean("precision"), mean("mrr"), accuracy.alias("abstention_accuracy"))
