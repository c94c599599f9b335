"""Stored tables, the pipeline over them, streams in several batches, models on disk."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from smeltery.operators import marts, ml, workload
from smeltery.operators.monitoring import run_states
from smeltery.operators.silver import BRONZE
from smeltery.plans import catalog, stream_queries
from smeltery.plans.dashboard import analytics_dashboard, home_dashboard, monitoring_dashboard
from smeltery.plans.pipeline import TRACKED, Load
from smeltery.sources.adapter import TestTables
from smeltery.sources.activity_log import activity_log_parse, bad_line_count
from smeltery.sources.tables import Warehouse, truncate_layer
from smeltery.operators import reports
from smeltery.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return TestTables(spark, SF_DIR)


def test_versions_and_partitions(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    assert wh.overwrite("gold", "a", spark.range(3)) == 3
    old = wh.read("gold", "a")
    wh.overwrite("gold", "a", old.select((F.col("id") + 10).alias("id")))
    assert wh.append("gold", "a", spark.range(1)) == 1
    assert sorted(r.id for r in wh.read("gold", "a").collect()) == [0, 10, 11, 12]
    assert sorted(r.id for r in old.collect()) == [0, 1, 2]
    days = spark.createDataFrame([(20240101, 1), (20240102, 2)], "date_key int, n int")
    wh.overwrite("gold", "agg_daily_sales", days)
    assert wh.overwrite_partitions("gold", "agg_daily_sales", spark.createDataFrame([(20240102, 9)], "date_key int, n int")) == 1
    assert {(r.date_key, r.n) for r in wh.read("gold", "agg_daily_sales").collect()} == {(20240101, 1), (20240102, 9)}
    assert wh.append("gold", "agg_daily_sales", days.limit(0)) == 0
    assert truncate_layer(wh, "gold") == ["agg_daily_sales"]
    assert wh.read("gold", "agg_daily_sales").count() == 0
    assert reports.stored_bytes(spark, wh.paths("gold", "a")).first()["bytes"] > 0
    with pytest.raises(LookupError):
        wh.read("gold", "nothing")
    with pytest.raises(ValueError):
        wh.overwrite_partitions("gold", "a", spark.range(1))


def test_a_write_that_stops_half_way(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    wh.overwrite("gold", "a", spark.range(5))
    wh.overwrite("gold", "fact_sales", spark.range(6).selectExpr("id", "CAST(id % 3 AS INT) AS order_date_key"))
    reader = wh.read("gold", "a")
    broken = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("id")).alias("id"))
    for table, rows in (("a", broken), ("fact_sales", broken.selectExpr("id", "CAST(id % 3 AS INT) AS order_date_key"))):
        for write in (wh.append, wh.overwrite, *([wh.overwrite_partitions] if table != "a" else [])):
            before = wh.read("gold", table).count()
            with pytest.raises(Exception, match="stopped"):
                write("gold", table, rows)
            assert wh.read("gold", table).count() == before
    assert wh.append("gold", "a", spark.range(1)) == 1 and wh.overwrite("gold", "a", wh.read("gold", "a")) == 6
    assert wh.read("gold", "a").count() == 6 and reader.count() == 5


def test_replaced_days_keep_the_rest(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    day = lambda rows: spark.createDataFrame(rows, "date_key int, n int")
    wh.overwrite("gold", "agg_daily_sales", day([(1, 1), (2, 2), (None, 3)]))
    wh.append("gold", "agg_daily_sales", day([(2, 4), (3, 5)]))
    wh.overwrite_partitions("gold", "agg_daily_sales", day([(2, 6)]))
    read = wh.read("gold", "agg_daily_sales")
    assert {(r.date_key, r.n) for r in read.collect()} == {(1, 1), (2, 6), (3, 5), (None, 3)}
    wh.overwrite_partitions("gold", "agg_daily_sales", day([(None, 7)]))
    assert {(r.date_key, r.n) for r in wh.read("gold", "agg_daily_sales").collect()} == {(1, 1), (2, 6), (3, 5), (None, 7)}
    assert "PartitionFilters: [isnotnull(date_key" in plan(read.where("date_key = 3"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_read_their_days_only(spark, t, tmp_path):
    """Sales by day, the 30-day report and query performance on stored tables: the scan gets partition filters."""
    wh = Warehouse(spark, str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        wh.overwrite("gold", "fact_sales", t("gold_fact_sales").where("order_date_key >= 20010601"))
        wh.overwrite("gold", "dim_date", t("gold_dim_date"))
        wh.overwrite("monitoring", "query_logs", t("query_logs"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    sales, dates = wh.read("gold", "fact_sales"), wh.read("gold", "dim_date")
    daily = reports.sales_daily(sales, "2001-08-01", 10)
    assert "PartitionFilters: [isnotnull(order_date_key" in plan(daily)
    report = reports.orders_report(sales, dates, "2001-08-01", 10)
    assert "dynamicpruning" in plan(report).split("PartitionFilters: [")[1].split("]")[0]
    assert report.collect() == reports.orders_report(t("gold_fact_sales"), t("gold_dim_date"), "2001-08-01", 10).collect()
    days = F.col("log_date").between(F.lit(dt.date(2024, 1, 10)), F.lit(dt.date(2024, 1, 12)))
    logs = wh.read("monitoring", "query_logs", days)
    assert logs.columns == t("query_logs").columns
    fast = workload.query_performance(logs, "2024-01-10", "2024-01-13", limit=None)
    assert "PartitionFilters: [isnotnull(log_date" in plan(fast)
    whole = workload.query_performance(t("query_logs"), "2024-01-10", "2024-01-13", limit=None)
    assert sorted(map(str, fast.collect())) == sorted(map(str, whole.select(fast.columns).collect()))


def test_lookup_reaches_the_scan(spark, t):
    plan = reports.lookup_by_key(t("orders"), "o_orderkey", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan


def test_pipeline_loads_once(spark, t, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        _loads_once(spark, t, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _loads_once(spark, t, tmp_path):
    wh = Warehouse(spark, str(tmp_path))
    recent = t("bronze_orders").where("order_date >= DATE'2001-07-01' OR order_date IS NULL")
    lines = t("bronze_order_item").join(recent.select("order_id").distinct(), "order_id", "left_semi")
    for name in BRONZE:
        rows = {"orders": recent, "order_item": lines.select(t("bronze_order_item").columns)}.get(name, t(f"bronze_{name}"))
        wh.overwrite("bronze", name, rows)
    first = Load(wh, "2001-08-02 06:00:00").run()
    assert first["silver"]["orders"] > 0 and first["gold"]["fact_sales"] == first["silver"]["order_item"]
    orders = wh.read("silver", "orders")
    assert orders.select("order_key").distinct().count() == orders.count() == orders.agg(F.max("order_key")).first()[0]
    bosses = wh.read("silver", "employee").where("manager_employee_key IS NOT NULL")
    assert bosses.join(wh.read("silver", "employee").select(F.col("employee_key").alias("manager_employee_key")), "manager_employee_key", "left_anti").count() == 0
    extra = t("bronze_country").limit(1).withColumn("country_id", F.lit(900))
    wh.append("bronze", "country", extra)
    second = Load(wh, "2001-08-03 06:00:00")
    assert second.transform_all() == {**{k: 0 for k in first["silver"]}, "country": 1}
    assert wh.read("silver", "country").where("country_id = 900").first()["country_key"] == first["silver"]["country"] + 1
    assert second.validate().where("has_duplicates").count() == 0
    events = wh.read("monitoring", "job_runs")
    done = 2 * len(first["silver"]) + len(first["gold"])
    assert events.where("status = 'completed'").count() == events.where("status = 'running'").count() == done
    states = run_states(events)
    assert states.count() == states.where("status = 'completed'").count() == done
    assert states.agg(F.sum("records_processed")).first()[0] == sum(first["silver"].values()) + sum(first["gold"].values()) + 1
    _next_day(spark, wh, first)
    _waiting_rows(spark, wh)
    _lost_driver(spark, wh)


def _read_files(df):
    return sorted({r[0].split("/v=")[1] for r in df.select(F.input_file_name()).distinct().collect() if r[0]})


def _bronze_rows(wh, order_id, customer_id, day, lines):
    orders, items = wh.read("bronze", "orders"), wh.read("bronze", "order_item")
    as_is = lambda df, given: df.limit(1).select(*[F.lit(given[c]).cast(df.schema[c].dataType).alias(c) if c in given else F.col(c) for c in df.columns])
    stamp = {"_load_timestamp": "2024-01-03 08:00:00"}
    product = wh.read("silver", "product").first()["product_id"]
    one = as_is(orders.where("order_id IS NOT NULL"), stamp | {"order_id": order_id, "customer_id": customer_id, "order_date": day, "promotion_code": None})
    many = [as_is(items.where("order_id IS NOT NULL"), stamp | {"order_item_id": order_id * 10 + i, "order_id": order_id, "product_id": product}) for i in range(lines)]
    return one, many


DAILY = ("orders", "order_item", "fact_sales", "fact_orders", "agg_daily_sales", "dim_customer_history", "fact_customer_version")


def _next_day(spark, wh, first):
    """One new order two days later: only the folders of its day change, in silver and in gold."""
    customer = wh.read("silver", "customer").first()["customer_id"]
    Load(wh, "2001-08-03 07:00:00", only=DAILY).aggregate_all()
    one, lines = _bronze_rows(wh, 8_000_001, customer, "2002-01-05", 2)
    tables = [("silver", "orders"), ("silver", "order_item"), ("gold", "fact_sales"), ("gold", "fact_orders"), ("gold", "agg_daily_sales")]
    before = {x: _read_files(wh.read(*x)) for x in tables}
    wh.append("bronze", "orders", one)
    for line in lines:
        wh.append("bronze", "order_item", line)
    load = Load(wh, "2002-01-05 06:00:00", only=DAILY)
    fresh, _, day = load._arrived("orders")
    assert day == "2024-01-03" and "PartitionFilters: [((cast(_load_date" in plan(fresh) or "_load_date" in plan(fresh).split("PartitionFilters: [")[1].split("]")[0]
    silver = load.transform_all()
    assert (silver["orders"], silver["order_item"]) == (1, 2) and load.changed_days() == ["2002-01-05"]
    gold = load.aggregate_all()
    assert (gold["fact_sales"], gold["fact_orders"], gold["agg_daily_sales"]) == (2, 1, 1) and load.changed_days() == []
    for table in tables:
        fresh_files = set(_read_files(wh.read(*table))) - set(before[table])
        assert set(before[table]) <= set(_read_files(wh.read(*table)))
        assert fresh_files and all("20020105" in f.replace("-", "") for f in fresh_files)
    whole = Load(wh, "2002-01-05 07:00:00", whole_history=True, only=DAILY).run()
    assert whole["silver"]["orders"] == whole["silver"]["order_item"] == whole["gold"]["fact_sales"] == 0
    assert Load(wh, "2002-01-05 08:00:00", only=DAILY).changed_days() == []


def _waiting_rows(spark, wh):
    """An order of an unknown customer and its line wait; they are loaded when the customer comes, from another ingest day on."""
    one, lines = _bronze_rows(wh, 8_000_002, 1_999_999_999, "2002-01-06", 1)
    wh.append("bronze", "orders", one)
    wh.append("bronze", "order_item", lines[0])
    silver = Load(wh, "2002-01-06 06:00:00", only=DAILY).transform_all()
    assert (silver["orders"], silver["order_item"]) == (0, 0)
    assert wh.read("pending", "orders").where("order_id = 8000002").count() == 1 and wh.read("pending", "order_item").where("order_id = 8000002").count() == 1
    model = wh.read("silver", "customer").limit(1)
    wh.append("silver", "customer", model.withColumn("customer_id", F.lit(1_999_999_999)).withColumn("customer_key", F.lit(777_777)))
    late, _ = _bronze_rows(wh, 8_000_003, 1_999_999_999, "2002-01-07", 0)
    wh.append("bronze", "orders", late.withColumn("_load_timestamp", F.lit("2024-01-05 01:00:00").cast(late.schema["_load_timestamp"].dataType)))
    load = Load(wh, "2002-01-07 06:00:00", only=DAILY)
    silver = load.transform_all()
    assert (silver["orders"], silver["order_item"]) == (2, 1) and load.changed_days() == ["2002-01-06", "2002-01-07"]
    assert wh.read("pending", "orders").where("order_id >= 8000002").count() == 0
    # a line of an order from an earlier load looks beyond the changed days
    load.aggregate_all()
    _, more = _bronze_rows(wh, 8_000_001, 1, "2002-01-05", 4)
    wh.append("bronze", "order_item", more[3].withColumn("_load_timestamp", F.lit("2024-01-05 02:00:00").cast("timestamp_ntz").cast(more[3].schema["_load_timestamp"].dataType)))
    load = Load(wh, "2002-01-08 06:00:00", only=DAILY)
    assert load.transform_all()["order_item"] == 1 and load.changed_days() == ["2002-01-05"]
    assert load.aggregate_all()["fact_sales"] == 1


def _lost_driver(spark, wh):
    """A load that stops behind silver leaves a start row and its days; the next one brings gold up to date."""
    one, lines = _bronze_rows(wh, 8_000_004, wh.read("silver", "customer").first()["customer_id"], "2002-02-01", 1)
    stamp = F.lit("2024-02-01 00:00:00")
    wh.append("bronze", "orders", one.withColumn("_load_timestamp", stamp.cast(one.schema["_load_timestamp"].dataType)))
    wh.append("bronze", "order_item", lines[0].withColumn("_load_timestamp", stamp.cast(lines[0].schema["_load_timestamp"].dataType)))
    stopped = Load(wh, "2002-02-01 06:00:00", only=DAILY)
    stopped.transform_all()

    def lost():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        stopped._step("gold", "fact_sales", lost)
    with pytest.raises(RuntimeError):
        stopped._step("gold", "fact_sales", lambda: (_ for _ in ()).throw(RuntimeError("long " * 400)))
    states = run_states(wh.read("monitoring", "job_runs")).where(F.col("run_id") == stopped.run_id)
    assert states.where("status = 'running' AND completed_at IS NULL AND table_name = 'fact_sales'").count() == 1
    assert states.where("status = 'failed'").first()["error_message"] == "long " * 400
    again = Load(wh, "2002-02-01 07:00:00", only=DAILY).run()
    assert again["silver"]["orders"] == 0 and (again["gold"]["fact_orders"], again["gold"]["fact_sales"]) == (1, 1)


def test_a_changed_customer_has_two_versions(spark):
    """Lines from before a change keep the first version, later ones take the second; the day of the change is the second's."""
    row = lambda who, bracket: spark.createDataFrame([(who, bracket, "INDIVIDUAL")], "customer_id int, income_bracket string, customer_type string")
    none = F.lit(None).cast("timestamp_ntz")
    empty = row(1, "LOW").limit(0).select("*", none.alias("valid_from"), none.alias("valid_to"), F.lit(True).alias("is_current"))
    first = marts.scd2_merge(empty, row(1, "LOW").unionByName(row(2, "HIGH")), "customer_id", TRACKED, "2001-08-02 06:00:00")
    again = marts.scd2_merge(first, row(1, "LOW").unionByName(row(2, "HIGH")), "customer_id", TRACKED, "2001-09-01 06:00:00")
    second = marts.scd2_merge(again, row(1, "PREMIUM").unionByName(row(2, "HIGH")), "customer_id", TRACKED, "2002-03-01 06:00:00")
    assert again.count() == 2 and second.count() == 3
    days = ["1999-01-01", "2001-08-02", "2002-02-28", "2002-03-01", "2003-07-01"]
    sales = spark.createDataFrame([(i, who, d) for who in (1, 2, 3) for i, d in enumerate(days)], "line int, customer_id int, sold string")
    got = marts.version_at(sales, second, "customer_id", "sold", ["income_bracket", "valid_from"])
    assert got.count() == 15
    brackets = {w: [r.income_bracket for r in got.where(F.col("customer_id") == w).orderBy("line").collect()] for w in (1, 2, 3)}
    assert brackets == {1: ["LOW"] * 3 + ["PREMIUM"] * 2, 2: ["HIGH"] * 5, 3: [None] * 5}
    assert "SortMergeJoin" in plan(got) or "HashJoin" in plan(got)
    assert marts.version_at(sales.limit(0), second, "customer_id", "sold", ["income_bracket"]).collect() == []


def test_dashboards(spark, t):
    layers = {"gold": {n: t(f"gold_{n}") for n in ("fact_sales", "fact_orders", "dim_product", "dim_customer")}}
    alerts = spark.createDataFrame([("high",)], "severity string")
    parts = home_dashboard(layers, alerts, t("table_stats"), "2001-08-01")
    parts |= monitoring_dashboard(t("job_runs"), t("etl_jobs"), t("table_stats"), "2024-01-31 00:00:00")
    parts |= analytics_dashboard(t("query_logs"), "2024-01-30")
    assert all(df.count() > 0 for df in parts.values())
    catalog = reports.table_catalog(spark, layers)
    assert reports.catalog_search(catalog, "FACT").first()["tables"] == 2
    assert reports.pick_columns(t("silver_orders"))["date"] == ["order_date"]


def _in_turns(spark, t, tmp_path, name, order):
    """The table as two files, the later rows first, read one file per batch."""
    folder = str(tmp_path / "in")
    cut = t(name).agg(F.percentile_approx(order, 0.5)).first()[0] if name == "orders" else dt.datetime(2024, 1, 15)
    parts = [t(name).where(F.col(order) >= F.lit(cut)), t(name).where(F.col(order) < F.lit(cut))]
    return folder, parts


def test_late_fact_rows_are_kept(spark, t, tmp_path):
    folder, parts = _in_turns(spark, t, tmp_path, "orders", "o_orderkey")
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, t("orders").schema)
        jobs.stream_fact_incremental(stream, str(tmp_path / "check"), str(tmp_path / "out"), ["o_orderkey"], F.trunc("o_orderdate", "MM")).awaitTermination()
    out = jobs.read_batches(spark, str(tmp_path / "out"))
    assert out.count() == t("orders").count() == out.select("o_orderkey").distinct().count()


def test_a_batch_reads_its_own_days_only(spark, tmp_path):
    """Rows read from what is stored do not grow with the batches, a repeated row stays out, and a replayed batch changes nothing."""
    root = str(tmp_path / "out")
    rows = lambda day, low, n: spark.range(low, low + n).selectExpr("id", f"DATE'2024-01-{day:02d}' AS day")
    for batch in range(6):
        fresh = rows(batch + 1, 100 * batch, 20).unionByName(rows(1, 0, 5)) if batch in (2, 5) else rows(batch + 1, 100 * batch, 20)
        jobs._by_day(jobs._new_rows(fresh, root, ["id"], F.col("day"), batch), root, batch)
    for batch in (4, 5):
        days = [dt.date(2024, 1, batch + 1)]
        have = jobs._days_before(spark, root, days, batch, spark.range(0).selectExpr("id", "DATE'2024-01-01' AS day").schema)
        assert have is None or have.count() == 0
    first_day = jobs._days_before(spark, root, [dt.date(2024, 1, 1), None], 5, spark.range(0).selectExpr("id", "DATE'2024-01-01' AS day").schema)
    assert first_day.count() == 20 and all("_day=2024-01-01" in f for f in first_day.inputFiles())
    assert jobs.read_batches(spark, root).count() == 120
    jobs._by_day(jobs._new_rows(rows(6, 500, 20).unionByName(rows(1, 0, 5)), root, ["id"], F.col("day"), 5), root, 5)
    assert jobs.read_batches(spark, root).count() == 120


def test_counter_state_carries_over(spark, t, tmp_path):
    folder = str(tmp_path / "in")
    source = t("counter_snapshots")
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (source.where(F.col("seen_at") < split), source.where(F.col("seen_at") >= split)):
        part.write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, source.schema)
        jobs.stream_counter_deltas(stream, str(tmp_path / "check"), str(tmp_path / "out"), workload.counter_deltas).awaitTermination()
    got = jobs.read_batches(spark, str(tmp_path / "out" / "deltas"))
    want = workload.counter_deltas(source)
    assert got.select(want.columns).exceptAll(want).count() == 0 and want.count() == got.count()


def test_keyed_counters_of_one_hot_statement(spark, tmp_path, monkeypatch):
    """All rows under one statement: its history is reduced to one row a batch before it reaches the keyed state."""
    events = pq.read_table(f"{SF_DIR}/events.parquet")
    at = events.schema.get_field_index("user_id")
    events = events.set_column(at, events.schema.field(at), pa.array([7] * len(events), events.schema.field(at).type))
    pq.write_table(events, tmp_path / "events.parquet")
    progress, finish = [], stream_queries._finish
    monkeypatch.setattr(stream_queries, "_finish", lambda running: (finish(running), progress.extend(running.recentProgress)))
    got = catalog.all_queries()["stream_keyed_counter_deltas"](spark, str(tmp_path))
    kept = [p for p in progress if p["stateOperators"]]
    assert sum(p["numInputRows"] for p in kept) == 1 and max(o["numRowsTotal"] for p in kept for o in p["stateOperators"]) == 1
    plain = TestTables(spark, str(tmp_path))("counter_snapshots").select("queryid", "snapshot_id", "seen_at", *workload.COUNTERS)
    rows, want = sorted(plain.collect(), key=lambda r: (r.seen_at, r.snapshot_id)), []
    for before, row in zip([None, *rows], rows):
        grown = [max(0.0, float(row[c]) - float(before[c] if before else 0)) for c in workload.COUNTERS]
        if grown[workload.COUNTERS.index("calls")] > 0:
            want.append((row.queryid, row.snapshot_id, row.seen_at, *grown))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_log_file(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text('{"timestamp": "1", "event_type": "system"}\nnope\n{"timestamp": "2", "event_type": "click"}\n')
    assert [r.timestamp for r in activity_log_parse(spark, str(path), 1).collect()] == ["2"]
    assert tuple(bad_line_count(spark, str(path)).first()) == (3, 1)


def test_forest_flags_the_outliers(spark):
    odd = F.col("id") % 50 == 7
    far = lambda plain, factor: F.when(odd, 1000.0 * factor + F.col("id")).otherwise(plain.cast("double"))
    rows = spark.range(2000).select(
        F.col("id").alias("log_id"),
        far(F.col("id") * 37 % 101, 90).alias("mean_exec_time_ms"),
        far(F.col("id") % 13, 1).alias("calls"),
        far(F.col("id") % 17, 3).alias("rows_affected"),
        far(F.col("id") % 19, 5).alias("shared_blks_hit"),
        far(F.col("id") % 23, 7).alias("shared_blks_read"),
    )
    features = ml.anomaly_features(rows)
    scores = ml.score_isolation_forest(ml.fit_isolation_forest(features, trees=30), features)
    flagged = ml.flag_anomalies(scores)
    assert 0.05 < flagged.where("is_anomaly").count() / 2000 < 0.15
    assert flagged.where("is_anomaly AND log_id % 50 = 7").count() == 40


def test_model_round_trip_and_centroids(spark, t, tmp_path):
    features = ml.time_features(t("query_logs"))
    model = ml.fit_query_time(features, "random_forest", trees=5, depth=4)
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    a, b = (ml.score_query_time(m, features).orderBy("log_id").limit(20).collect() for m in (model, again))
    assert a == b
    assert ml.cross_validate(features, "random_forest", trees=3, depth=2, folds=2) > 0
    points = spark.createDataFrame([([0.0, 0.1],), ([5.0, 5.0],), ([2.0, 2.0],)], "v array<double>")
    got = [r.cluster for r in ml.assign_to_centroids(points, "v", {0: [0.0, 0.0], 1: [5.0, 5.1]}, 0.5).collect()]
    assert got == [0, 1, -1]
    wide = t("query_logs").select(*[(F.col("log_id") % (i + 2)).cast("double").alias(f"f{i}") for i in range(12)])
    reduced = ml.fit_clusters(wide, [f"f{i}" for i in range(12)], 3, starts=2, components=10)
    assert ml.assign_clusters(reduced, wide).select("cluster").distinct().count() == 3
