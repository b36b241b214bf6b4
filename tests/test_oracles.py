"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        return
    found = duck.sql(catalog.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_row_order_and_partitions_do_not_matter(spark):
    from lodestone.operators import ranking
    from lodestone.plans.proxies import view
    from lodestone.plans.queries import ASKED

    mem = view(spark, SF, "MEM")
    a = ranking.score_memories(mem, ASKED).select("id", "score").collect()
    b = ranking.score_memories(mem.orderBy("title").repartition(7), ASKED).select("id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
