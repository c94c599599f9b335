"""Hand-made rows for the cleaning rules and the golden numbers."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import Row, functions as F

from smeltery.functions import exprs
from smeltery.functions.keyed import latest_per_key, previous_in_key
from smeltery.operators import gold, layout, quality, silver, storage, workload
from smeltery.sources import tables
from smeltery.sources.activity_log import parse_lines

RUN_TS = "2024-03-01 12:00:00"


def one(df):
    return df.collect()[0]


def test_blank_and_empty_differ(spark):
    df = spark.createDataFrame([("  ",), ("",), (None,), (" a ",)], "x string")
    got = df.select(exprs.blank_to("x", "D").alias("b"), exprs.empty_to("x", "D").alias("e")).collect()
    assert [tuple(r) for r in got] == [("D", "  "), ("D", "D"), ("D", "D"), ("a", " a ")]


def test_tolerant_parsers(spark):
    df = spark.createDataFrame([("20240229", "1,234.5"), ("2024-02-30", "x"), ("2024-01-05T10:00", "$3"), ("7", "1.5E7")], "d string, n string")
    got = df.select(exprs.tolerant_date("d").alias("d"), exprs.tolerant_number("n").alias("n")).collect()
    assert [r.d for r in got] == [dt.date(2024, 2, 29), None, dt.date(2024, 1, 5), None]
    assert [r.n for r in got] == [1234.5, 0.0, 3.0, 15_000_000.0]


def test_tolerant_list(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("c",), (" ",), (None,)], "x string")
    assert [r.x for r in df.select(exprs.tolerant_list("x").alias("x")).collect()] == [["a", "b"], ["c"], None, None]


def test_newest_row_wins_and_undated_goes_last(spark):
    t = dt.datetime
    rows = [(1, "old", t(2024, 1, 1)), (1, "new", t(2024, 1, 2)), (1, "undated", None), (2, "only", None)]
    df = spark.createDataFrame(rows, "k int, v string, _load_timestamp timestamp")
    assert {r.k: r.v for r in latest_per_key(df, ["k"]).collect()} == {1: "new", 2: "only"}


def test_key_zero_counts_as_missing_for_phones(spark):
    phones = spark.createDataFrame(
        [(1, 0, None, None, None, 0, None), (2, 5, 9, " 12 ", "+33 ", 4, None)],
        "phone_number_id int, persons_person_id int, locations_location_id int, phone_number string, country_code string, phone_type_id int, _load_timestamp timestamp",
    )
    person = spark.createDataFrame([(0, 100), (5, 105)], "person_id int, person_key long")
    place = spark.createDataFrame([(9, 209)], "location_id int, location_key long")
    got = {r.phone_id: r for r in silver.silver_phone_number(phones, None, RUN_TS, person, place).collect()}
    assert got[1].person_key is None and got[1].phone_type == "MOBILE" and got[1].full_phone_number == "+1 0000000000"
    assert got[2].person_key == 105 and got[2].full_phone_number == "+33 12" and got[2].phone_type == "FAX"


def test_order_item_rules(spark):
    when = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame(
        [(1, 10, 7, D("2.50"), D("3.00"), when), (2, 10, 7, D("-4.00"), D("2.00"), when), (3, 11, 7, D("1.00"), None, when), (4, 99, 7, D("1.00"), D("1.00"), when)],
        "order_item_id long, order_id long, product_id int, unit_price decimal(12,2), quantity decimal(10,2), _load_timestamp timestamp",
    )
    bronze = spark.createDataFrame(
        [(10, 1, 0, None, None, None, None, None, " P1 ", when), (11, 1, 0, None, None, None, None, None, "   ", when)],
        "order_id long, customer_id int, sales_rep_id int, order_date date, order_code string, order_status string, order_total decimal(15,2), order_currency string, promotion_code string, _load_timestamp timestamp",
    )
    orders = spark.createDataFrame([(10, 110), (11, 111)], "order_id long, order_key long")
    product = spark.createDataFrame([(7, 70)], "product_id int, product_key long")
    got = {r.order_item_id: r for r in silver.silver_order_item(items, None, RUN_TS, bronze, orders, product).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].line_total, got[1].discount_amount, got[1].net_amount) == (D("7.50"), D("0.75"), D("6.75"))
    assert (got[2].unit_price, got[2].discount_amount) == (D("0.00"), D("0.00"))
    assert got[3].quantity == D("0.00")


def test_usage_first_match_wins(spark):
    df = spark.createDataFrame([("Home office",), ("back OFFICE",), ("shipment",), ("bill me",), (None,)], "u string")
    got = [r.k for r in df.select(silver.usage_type(F.col("u")).alias("k")).collect()]
    assert got == ["HOME", "WORK", "SHIPPING", "BILLING", "OTHER"]


def test_tenure_and_ages_floor(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), dt.date(2000, 12, 30)), (dt.date(2000, 1, 1), dt.date(1999, 12, 31))], "a date, b date")
    assert [r.y for r in df.select(exprs.whole_years(F.col("a"), F.col("b")).alias("y")).collect()] == [0, -1]


def test_valid_rows_golden(spark):
    df = spark.createDataFrame([("ORD001", D("100.50")), ("ORD002", D("-50.00")), ("", D("10.00"))], "order_id string, total_amount decimal(15,2)")
    assert quality.valid_rows(df, "total_amount", "order_id").count() == 1


def test_incremental_golden(spark):
    raw = spark.createDataFrame([("ORD001",), ("ORD002",)], "order_id string")
    first = tables.insert_ignore(None, raw.limit(1), ["order_id"])
    assert first.count() == 1
    assert first.unionByName(tables.insert_ignore(first, raw, ["order_id"])).count() == 2


def test_daily_sum_golden(spark):
    day = dt.date(2024, 1, 15)
    orders = spark.createDataFrame([(i, i, day, i, True) for i in (1, 2, 3)], "order_key long, order_id long, order_date date, customer_key long, is_valid boolean")
    items = spark.createDataFrame(
        [(1, D("100.50")), (2, D("200.00")), (3, D("150.75"))], "order_key long, net_amount decimal(15,2)"
    ).select("*", F.lit(1).cast("decimal(10,2)").alias("quantity"), F.col("net_amount").alias("line_total"), F.lit(0).cast("decimal(12,2)").alias("discount_amount"), F.lit(True).alias("is_valid"))
    row = one(gold.agg_daily_sales(orders, items))
    assert (row.date_key, row.total_orders, row.net_revenue) == (20240115, 3, D("451.25"))
    assert row.avg_order_value == D("150.42")


def test_composite_distinct_counts_null_parts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    assert one(quality.duplicate_count(df, ["a", "b"])).duplicates == 1


def test_snapshot_steps_agree_with_silver(spark):
    inv = spark.createDataFrame(
        [(1, 1, 1, 10, 5, 5, True), (2, 2, 1, 0, 0, 0, True), (3, 3, 1, 4, 4, 0, False), (4, 1, 1, 90, 3, 87, True)],
        "inventory_id int, product_key long, warehouse_key long, quantity_on_hand int, quantity_available int, quantity_reserved int, is_valid boolean",
    )
    product = spark.createDataFrame([(1, D("2.00"), True), (2, D("1.00"), False)], "product_key long, list_price decimal(12,2), is_valid boolean")
    layer = {"inventory": inv, "product": product}
    cold = gold.fact_inventory_snapshot(layer, None, "2024-01-01")
    warm = gold.fact_inventory_snapshot(layer, cold.withColumn("days_of_supply", F.lit(9)), "2024-01-02")
    plain = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert plain(cold) == plain(warm)
    assert plain(cold)[0][2:] == (90, 3, 87, 30, "LOW_STOCK", D("180.00"))


def test_seconds_run_of_lifetime_append_keeps_old_rows(spark):
    customer = spark.createDataFrame([(1, True), (2, True)], "customer_key long, is_valid boolean")
    orders = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), 1)], "order_key long, order_id long, order_date date, customer_key long")
    items = spark.createDataFrame([(1, D("1.00"), D("600.00"), D("0.00"), D("600.00"))], "order_key long, quantity decimal(10,2), line_total decimal(15,2), discount_amount decimal(12,2), net_amount decimal(15,2)")
    rows = {r.customer_key: r for r in gold.agg_customer_lifetime(customer, orders, items, "2024-01-20").collect()}
    assert (rows[1].rfm_recency_score, rows[1].rfm_frequency_score, rows[1].rfm_monetary_score) == (5, 1, 2)
    assert rows[1].rfm_segment == "New Customers" and rows[2].rfm_segment == "Lost" and rows[2].customer_tenure_days == 0
    have = customer.where("customer_key = 1")
    assert [r.customer_key for r in gold.agg_customer_lifetime(customer, orders, items, "2024-01-20", have).collect()] == [2]


def test_reconciled_mean(spark):
    df = spark.createDataFrame([(1.0, 1000.0, 10), (90.0, 1000.0, 10), (None, 10.0, 1), (1.0, 10.0, 0)], "m double, t double, c int")
    got = [r.v for r in df.select(workload.reconciled_mean(F.col("m"), F.col("t"), F.col("c")).alias("v")).collect()]
    assert got == [100.0, 90.0, None, 1.0]


def test_before_after_golden(spark):
    oltp = ([10, 12, 11, 13, 9, 14, 10, 12, 11, 13], [5, 6, 5, 7, 4, 6, 5, 6, 5, 6])
    rows = [("oltp", v, D(x)) for v, xs in zip(("baseline", "optimized"), oltp) for x in xs]
    df = spark.createDataFrame(rows, "scenario string, variant string, latency_ms decimal(12,3)")
    assert one(workload.before_after(df)).p50_reduction_pct > 40


def test_fingerprint(spark):
    df = spark.createDataFrame([("SELECT  *\n FROM t1 WHERE a = 'x 1' AND b=42",)], "q string")
    assert one(df.select(workload.fingerprint(F.col("q")).alias("t"))).t == "SELECT * FROM t1 WHERE a = '?' AND b=?"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT * FROM silver.orders o WHERE o.order_date = 1", {("silver.orders", "order_date")}),
        ("select * from orders where customer_id = 3", {("silver.orders", "customer_id")}),
        ("SELECT 1 FROM gold.fact_sales WHERE silver.orders.order_date > 5", {("silver.orders", "order_date"), ("gold.fact_sales", "order_date")}),
        ("SELECT a FROM x JOIN silver.product p ON 1=1 WHERE p.sku = 2", {("silver.x", "sku"), ("silver.product", "sku")}),
        ("", set()),
    ],
)
def test_pairs(spark, text, expected):
    df = layout.with_cluster_pairs(spark.createDataFrame([(text,)], "query_text string"))
    assert {(p["table"], p["column"]) for p in one(df)._pairs} == expected


def test_merge_first_wins(spark):
    live = spark.createDataFrame([("a", 1)], "k string, v int")
    old = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, layout.merge_first_wins([live, old], ["k"]).collect())) == [("a", 1), ("b", 2)]


def test_log_lines(spark):
    good = '{"timestamp": "t2", "event_type": "route_change", "page": "/a", "details": {"search": "q=1"}}'
    lines = ["# c", "", "t1\te1\tclick\tapp\t/x\ts\t" + '{"timestamp": "t1", "event_id": "e1", "event_type": "click", "summary": "s"}', good, "{bad", "a\tb"]
    got = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.parse_error for r in got] == [False, False, True, True]
    assert got[0].event_id == "e1" and got[1].summary == "Navigation → /a with query q=1"


def test_log_lines_keep_long_texts(spark):
    message, broken = " ".join(f"w{i}" for i in range(400)), "{broken " + "x" * 900
    lines = spark.createDataFrame([('{"event_type": "click", "message": "' + message + '"}',), (broken,)], "value string")
    readable, other = parse_lines(lines).collect()
    assert readable.summary == message and other.raw_preview == broken
    readable, other = parse_lines(lines, summary_chars=500, preview_chars=400).collect()
    assert readable.summary == message[:500] and other.raw_preview == broken[:400]


def test_growth_line_never_below_zero(spark):
    trends = spark.createDataFrame([("bronze", 10, 100, 5.0, 0.0)], "layer string, current_size long, total_operations long, daily_growth double, growth_rate_percent double")
    points = {r.day: r.projected_size for r in storage.growth_points(trends, "2024-01-05", 4).collect()}
    assert points == {dt.date(2024, 1, 5): 10.0, dt.date(2024, 1, 4): 5.0, dt.date(2024, 1, 3): 0.0, dt.date(2024, 1, 2): 0.0, dt.date(2024, 1, 1): 0.0}


def test_previous_in_key_matches_plain_lag(spark):
    from pyspark.sql import Window as W

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0, cast((id * 7919) % 900000 as decimal(18,6)))").alias("ts"),
        F.col("id").alias("v"),
    )
    got = previous_in_key(df, ["k"], ["ts", "v"], F.to_date("ts"), ["v"])
    plain = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("ts", "v")))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_upsert_rules(spark):
    target = spark.createDataFrame([Row(k=1, low=5, name="a"), Row(k=2, low=1, name="b")])
    source = spark.createDataFrame([(1, 3, None), (3, 7, "c")], "k long, low long, name string")
    got = {r.k: (r.low, r.name) for r in tables.upsert(target, source, ["k"], {"low": "least", "name": "coalesce"}).collect()}
    assert got == {1: (3, "a"), 2: (1, "b"), 3: (7, "c")}
