"""The stand-in tables use all rows of the driver's tables."""

from lodestone.plans.proxies import view


def test_every_memory_row_can_be_used(spark, tmp_path):
    docs = spark.range(1500).selectExpr("id as doc_id", "'some text' as text", "'src1' as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3000).selectExpr("id as event_id").write.parquet(f"{tmp_path}/events.parquet")
    rows = view(spark, str(tmp_path), "USAGE").collect()
    assert len(rows) == 1500 and {r.n for r in rows} == {2.0}


def test_event_numbers_are_not_broadcast(spark, tmp_path):
    spark.range(1500).selectExpr("id as doc_id", "'some text' as text", "'src1' as source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3000).selectExpr("id as event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert "BroadcastHashJoin" not in view(spark, str(tmp_path), "USAGE")._jdf.queryExecution().executedPlan().toString()
