"""Alerts are worked out once, and no one task sorts all acknowledged ids."""

import pytest
from pyspark.sql import functions as F

from smeltery.operators import alerts, workload
from smeltery.plans import monitoring_queries
from smeltery.sources.adapter import TestTables
from smeltery.streaming import jobs


@pytest.fixture
def t(spark):
    return TestTables(spark, "/root/testdata/sf0.001")


def test_acknowledged_ids_meet_alerts_in_tasks_of_a_given_number(spark, t):
    plan = monitoring_queries._active(t)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join LeftAnti") < plan.count("RepartitionByExpression [alert_id")


def test_incidents_read_their_alerts_once(spark, t):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ident(n):
        seen.add(1)
        return f"a_{n:03d}"

    text = lambda value: F.lit(value).cast("string")
    rows = spark.range(90).select(
        ident("id").alias("alert_id"),
        F.when(F.col("id") % 3 == 0, "slow_query").otherwise("etl_failure").alias("type"),
        text("high").alias("severity"),
        text("title").alias("title"),
        text("message").alias("message"),
        text(None).alias("layer"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name"),
        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("occurred_at"),
        text("active").alias("status"),
    )
    got = alerts.incidents_sync(monitoring_queries._old_incidents(t).where("false"), rows, "2024-01-31 00:05:00")
    found = {r.alert_type: (r.alert_count, r.affected_tables) for r in got.collect()}
    assert found == {"slow_query": (30, "t0, t3, t6, t9, t12"), "etl_failure": (60, "t1, t2, t4, t5, t7")}
    assert seen.value == 90


def test_counter_state_has_a_row_per_bucket_not_per_statement(spark, t, tmp_path):
    rows = t("counter_snapshots")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema)
    running = jobs.stream_counter_deltas(stream, str(tmp_path / "check"), str(tmp_path / "out"), workload.counter_deltas, buckets=2)
    running.awaitTermination()
    assert max(o["numRowsTotal"] for p in running.recentProgress for o in p["stateOperators"]) == 2 < rows.select("queryid").distinct().count()
    got, want = jobs.read_batches(spark, str(tmp_path / "out" / "deltas")), workload.counter_deltas(rows)
    assert got.select(want.columns).exceptAll(want).count() == 0 and want.count() == got.count()
