"""Report queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.operators import gold, reports
from smeltery.plans.gold_queries import AS_OF, _gold_for_facts, silver_layer
from smeltery.plans.registry import query, sql_table

_TODAY = f"DATE '{AS_OF}'"
AS_OF_TS = "2024-01-31 00:00:00"

_LAYERS = {
    "bronze": ("bronze_orders", "bronze_order_item", "bronze_customer", "bronze_product"),
    "silver": ("silver_orders", "silver_order_item", "silver_customer", "silver_product"),
    "gold": ("gold_fact_sales", "gold_fact_orders", "gold_dim_customer", "gold_dim_product"),
}


def _layers(t):
    return {layer: {n: t(n) for n in names} for layer, names in _LAYERS.items()}


@query(
    "warehouse_summary",
    "SELECT layer, table_count, total_rows, COALESCE(b, 0)::BIGINT AS total_bytes FROM (SELECT layer, COUNT(*) AS table_count, SUM(n)::BIGINT AS total_rows FROM ("
    + " UNION ALL ".join(f"SELECT '{l}' AS layer, COUNT(*) AS n FROM {n}" for l, ns in _LAYERS.items() for n in ns)
    + ") GROUP BY layer) LEFT JOIN (SELECT layer, SUM(bytes) AS b FROM table_stats GROUP BY 1) USING (layer)",
)
def _summary(t):
    return reports.warehouse_summary(_layers(t), t("table_stats").select("layer", "bytes"))


@query(
    "layer_row_count",
    "SELECT ((SELECT COUNT(*) FROM bronze_orders) + (SELECT COUNT(*) FROM bronze_order_item) + (SELECT COUNT(*) FROM bronze_customer) + (SELECT COUNT(*) FROM bronze_product))::BIGINT AS total_rows",
)
def _layer_rows(t):
    return reports.layer_row_count(_layers(t)["bronze"])


@query(
    "table_stats_of",
    "SELECT COUNT(*) AS row_count, 6 AS column_count, MAX(ts) AS newest FROM events",
)
def _table_stats(t):
    return reports.table_stats_of(t("events"), "ts")


@query(
    "table_preview",
    "SELECT *, (SELECT COUNT(*) FROM customer) AS total_rows FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100)",
)
def _preview(t):
    return reports.table_preview(t("customer"), ["c_custkey"], 50, 100)


@query("profile_head", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _head(t):
    return reports.profile_head(t("orders"))


@query("row_count", "SELECT COUNT(*) AS row_count FROM lineitem")
def _rows(t):
    return reports.row_count(t("lineitem"))


@query(
    "sales_totals",
    "SELECT COUNT(*) AS total_sales, SUM(net_amount)::DOUBLE AS revenue, SUM(net_amount)::DOUBLE / COUNT(net_amount) AS avg_sale, SUM(quantity)::DOUBLE AS total_quantity FROM gold_fact_sales",
)
def _totals(t):
    return reports.sales_totals(t("gold_fact_sales"))


_DAILY = "SELECT STRFTIME(STRPTIME(order_date_key::VARCHAR, '%Y%m%d'), '%Y-%m-%d') AS date, COUNT(*) AS sales_count, SUM(net_amount)::DOUBLE AS revenue FROM gold_fact_sales WHERE order_date_key <= 20010801 {} GROUP BY order_date_key"
sql_table("daily_all", _DAILY.format(""))


@query("sales_daily", _DAILY.format("AND order_date_key >= 20010602"))
def _daily(t):
    return reports.sales_daily(t("gold_fact_sales"), AS_OF, 60)


@query("sales_daily_all", "SELECT * FROM daily_all")
def _daily_all(t):
    return reports.sales_daily(t("gold_fact_sales"), AS_OF, 0)


_TOP = """SELECT COALESCE(p.product_name, 'Unknown') AS product_name, COUNT(*) AS sales_count, SUM(f.net_amount)::DOUBLE AS revenue, SUM(f.quantity)::DOUBLE AS quantity_sold
    FROM gold_fact_sales f LEFT JOIN gold_dim_product p ON p.product_key = f.product_key GROUP BY p.product_name
    ORDER BY SUM(f.net_amount) DESC NULLS LAST, p.product_name NULLS LAST LIMIT 20"""


@query("top_products", _TOP)
def _top_products(t):
    return reports.top_products(t("gold_fact_sales"), t("gold_dim_product"))


@query("top_products_from_silver", _TOP)
def _top_from_silver(t):
    """The sales fact built from silver, then ranked: the whole slice in one plan."""
    sales = gold.fact_sales(silver_layer(t), _gold_for_facts(t))
    return reports.top_products(sales, t("gold_dim_product"))


@query(
    "customer_stats",
    """SELECT COUNT(DISTINCT customer_key) AS unique_customers, COUNT(*) AS total_orders, SUM(net_amount)::DOUBLE AS total_revenue,
       (SELECT COUNT(*) FROM gold_dim_customer) AS total_customers FROM gold_fact_orders""",
)
def _customer_stats(t):
    return reports.customer_stats(t("gold_dim_customer"), t("gold_fact_orders"))


@query(
    "sales_monthly",
    """SELECT SUBSTR(date, 1, 7) AS month_key, SUM(sales_count)::DOUBLE AS sales, SUM(CAST(revenue AS DECIMAL(18,2)))::DOUBLE AS revenue FROM daily_all GROUP BY 1
       UNION ALL SELECT STRFTIME(m, '%Y-%m'), 0, 0 FROM (SELECT UNNEST(generate_series(DATE_TRUNC('month', MAX(date)::DATE) + INTERVAL 1 MONTH, TIMESTAMP '2001-11-01', INTERVAL 1 MONTH)) AS m FROM daily_all)""",
)
def _monthly(t):
    return reports.sales_monthly(reports.sales_daily(t("gold_fact_sales"), AS_OF, 0), "2001-11-15")


@query(
    "sales_current_month_daily",
    """SELECT STRFTIME(d, '%Y-%m-%d') AS day_key, COALESCE(sales_count, 0)::DOUBLE AS sales, COALESCE(revenue, 0)::DOUBLE AS revenue
       FROM (SELECT UNNEST(generate_series(TIMESTAMP '2001-08-01', TIMESTAMP '2001-08-31', INTERVAL 1 DAY)) AS d) LEFT JOIN daily_all ON date = STRFTIME(d, '%Y-%m-%d')""",
)
def _month_days(t):
    return reports.sales_current_month_daily(reports.sales_daily(t("gold_fact_sales"), AS_OF, 0), AS_OF)


@query(
    "export_daily_sales",
    'SELECT date::DATE AS "Date", sales_count::DOUBLE AS "Orders", revenue AS "Revenue" FROM daily_all',
)
def _export(t):
    return reports.export_daily_sales(reports.sales_daily(t("gold_fact_sales"), AS_OF, 0))


_RECENT = f"FROM gold_fact_sales f LEFT JOIN gold_dim_date d ON d.date_key = f.order_date_key WHERE d.full_date >= {_TODAY} - 30"


@query(
    "orders_report",
    f"""SELECT 'orders_count' AS metric, COUNT(*)::DOUBLE AS value {_RECENT} UNION ALL SELECT 'sales_amount', COALESCE(SUM(f.net_amount), 0)::DOUBLE {_RECENT}
        UNION ALL SELECT 'units_sold', COALESCE(SUM(f.quantity), 0)::DOUBLE {_RECENT}""",
)
def _orders_report(t):
    return reports.orders_report(t("gold_fact_sales"), t("gold_dim_date"), AS_OF)


@query(
    "orders_trend",
    f"SELECT d.full_date, SUM(f.net_amount)::DOUBLE AS net_amount {_RECENT} GROUP BY d.full_date ORDER BY d.full_date DESC LIMIT 90",
)
def _orders_trend(t):
    return reports.orders_trend(t("gold_fact_sales"), t("gold_dim_date"), AS_OF)


@query(
    "top_products_30d",
    f"""SELECT COALESCE(p.product_name, 'Unknown') AS product_name, SUM(f.net_amount)::DOUBLE AS revenue FROM gold_fact_sales f
        LEFT JOIN gold_dim_product p ON p.product_key = f.product_key LEFT JOIN gold_dim_date d ON d.date_key = f.order_date_key
        WHERE d.full_date >= {_TODAY} - 30 GROUP BY p.product_name ORDER BY SUM(f.net_amount) DESC NULLS LAST, p.product_name NULLS LAST LIMIT 20""",
)
def _top30(t):
    return reports.top_products_recent(t("gold_fact_sales"), t("gold_dim_product"), t("gold_dim_date"), AS_OF)


@query(
    "income_bracket_revenue",
    f"""SELECT c.income_bracket, COUNT(DISTINCT o.order_key)::BIGINT AS order_count, SUM(o.order_total)::DOUBLE AS total_revenue,
        SUM(o.order_total)::DOUBLE / COUNT(*) AS avg_order_value FROM silver_customer c JOIN silver_orders o USING (customer_key)
        WHERE o.order_date >= {_TODAY} - 30 GROUP BY 1""",
)
def _income(t):
    return reports.income_bracket_revenue(t("silver_customer"), t("silver_orders"), AS_OF)


@query(
    "category_sales",
    f"""SELECT p.category_name, COUNT(DISTINCT (i.order_item_id, p.product_key))::BIGINT AS items_sold, SUM(i.line_total)::DOUBLE AS revenue, SUM(i.unit_price)::DOUBLE / COUNT(i.unit_price) AS avg_price
        FROM silver_product p JOIN silver_order_item i USING (product_key) JOIN silver_orders o USING (order_key) WHERE o.order_date >= {_TODAY} - 7 GROUP BY 1""",
)
def _category(t):
    return reports.category_sales(t("silver_product"), t("silver_order_item"), t("silver_orders"), AS_OF)


@query(
    "weekly_orders",
    f"""SELECT DATE_TRUNC('week', order_date)::DATE AS week, COUNT(DISTINCT order_key) AS orders, SUM(order_total)::DOUBLE AS revenue, COUNT(DISTINCT customer_key) AS customers
        FROM silver_orders WHERE order_date >= {_TODAY} - 90 GROUP BY 1""",
)
def _weekly(t):
    return reports.weekly_orders(t("silver_orders"), AS_OF)


@query(
    "recent_orders_items",
    f"""SELECT o.order_id, o.order_date, o.order_total::DOUBLE AS order_total, COUNT(i.order_item_id) AS item_count FROM silver_orders o JOIN silver_customer c USING (customer_key)
        LEFT JOIN silver_order_item i ON i.order_key = o.order_key WHERE o.order_date >= {_TODAY} - 7 GROUP BY ALL ORDER BY o.order_date DESC, o.order_id LIMIT 100""",
)
def _recent_items(t):
    return reports.recent_orders_items(t("silver_orders"), t("silver_customer"), t("silver_order_item"), AS_OF)


@query(
    "products_of_category",
    """SELECT p.product_key, p.product_name, p.category_name, SUM(i.quantity)::DOUBLE AS total_quantity, SUM(i.line_total)::DOUBLE AS total_sales
       FROM silver_product p JOIN silver_order_item i USING (product_key) WHERE p.category_name = 'Brand#7' GROUP BY ALL ORDER BY total_quantity DESC, product_key LIMIT 50""",
)
def _of_category(t):
    return reports.products_of_category(t("silver_product"), t("silver_order_item"), "Brand#7")


@query("lookup_customer", "SELECT * FROM customer WHERE c_custkey = 77")
def _lookup_customer(t):
    return reports.lookup_by_key(t("customer"), "c_custkey", 77)


@query("lookup_product", "SELECT * FROM part WHERE p_partkey = 77")
def _lookup_product(t):
    return reports.lookup_by_key(t("part"), "p_partkey", 77)


@query("lookup_order", "SELECT * FROM orders WHERE o_orderkey = 777")
def _lookup_order(t):
    return reports.lookup_by_key(t("orders"), "o_orderkey", 777)


@query(
    "sales_by_category",
    "SELECT p.category_name, SUM(f.quantity)::DOUBLE AS quantity FROM gold_fact_sales f JOIN gold_dim_product p USING (product_key) WHERE f.net_amount > 0 GROUP BY 1 ORDER BY SUM(f.quantity) DESC NULLS LAST, 1 LIMIT 200",
)
def _by_category(t):
    return reports.sales_by_category(t("gold_fact_sales"), t("gold_dim_product"))


@query(
    "sales_by_state",
    "SELECT c.state_province, COUNT(*) AS sales_count FROM gold_fact_sales f JOIN gold_dim_customer c USING (customer_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
)
def _by_state(t):
    return reports.sales_by_state(t("gold_fact_sales"), t("gold_dim_customer"))


@query(
    "sales_by_date_key",
    "SELECT order_date_key, SUM(net_amount)::DOUBLE AS net_amount FROM gold_fact_sales GROUP BY 1 ORDER BY 1 DESC LIMIT 200",
)
def _by_key(t):
    return reports.sales_by_date_key(t("gold_fact_sales"))


@query(
    "top_sales_lines",
    "SELECT f.order_item_id, f.net_amount::DOUBLE AS net_amount, f.quantity::DOUBLE AS quantity FROM gold_fact_sales f JOIN gold_dim_product p USING (product_key) ORDER BY f.net_amount DESC NULLS LAST, f.order_item_id, f.product_key LIMIT 5000",
)
def _top_lines(t):
    return reports.top_sales_lines(t("gold_fact_sales"), t("gold_dim_product"))


@query(
    "latest_sales_lines",
    """SELECT f.order_item_id, f.net_amount::DOUBLE AS net_amount, f.order_date_key FROM gold_fact_sales f JOIN gold_dim_product p USING (product_key)
       JOIN gold_dim_customer c USING (customer_key) WHERE f.quantity BETWEEN 1 AND 100 ORDER BY f.order_date_key DESC NULLS LAST, f.order_item_id, f.net_amount LIMIT 3000""",
)
def _latest_lines(t):
    return reports.latest_sales_lines(t("gold_fact_sales"), t("gold_dim_product"), t("gold_dim_customer"))


@query(
    "order_status_distribution",
    "SELECT order_status, COUNT(*) AS n FROM silver_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80",
)
def _statuses(t):
    return reports.value_counts(t("silver_orders"), "order_status", 80)


@query(
    "customer_type_distribution",
    "SELECT customer_type, COUNT(*) AS n FROM silver_customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60",
)
def _types(t):
    return reports.value_counts(t("silver_customer"), "customer_type", 60)


@query(
    "top_value_orders",
    f"SELECT order_id, customer_key, order_date, order_total::DOUBLE AS order_total FROM silver_orders WHERE order_date >= {_TODAY} - 180 ORDER BY silver_orders.order_total DESC NULLS LAST, order_id LIMIT 4000",
)
def _top_orders(t):
    return reports.top_value_orders(t("silver_orders").select("order_id", "customer_key", "order_date", "order_total"), AS_OF)


@query(
    "quantity_per_order",
    "SELECT o.order_id, SUM(i.quantity)::DOUBLE AS quantity FROM silver_order_item i JOIN silver_orders o USING (order_key) GROUP BY 1 ORDER BY SUM(i.quantity) DESC NULLS LAST, 1 LIMIT 500",
)
def _per_order(t):
    return reports.quantity_per_order(t("silver_orders"), t("silver_order_item"))


@query(
    "price_range",
    "SELECT COUNT(*) AS products, MIN(list_price)::DOUBLE AS min_price, MAX(list_price)::DOUBLE AS max_price FROM gold_dim_product",
)
def _prices(t):
    return reports.price_range(t("gold_dim_product"))


@query(
    "on_hand_per_product",
    "SELECT product_key, SUM(quantity_on_hand)::BIGINT AS on_hand FROM gold_inventory_snapshots GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 400",
)
def _on_hand(t):
    return reports.on_hand_per_product(t("gold_inventory_snapshots"))


_DAYS = (3, 7, 14, 30, 60, 90)
_HOURS = (6, 12, 24, 48, 72, 168)


@query(
    "trailing_day_counts",
    " UNION ALL ".join(
        f"SELECT {d} AS days, COUNT(*) AS row_count FROM silver_orders WHERE order_date >= {_TODAY} - {d}" for d in _DAYS
    ),
)
def _day_counts(t):
    return reports.trailing_day_counts(t("silver_orders"), "order_date", AS_OF, _DAYS)


@query(
    "trailing_hour_counts",
    " UNION ALL ".join(
        f"SELECT {h} AS hours, COUNT(*) AS row_count FROM events WHERE ts >= TIMESTAMP '{AS_OF_TS}' - INTERVAL {h} HOUR"
        for h in _HOURS
    ),
)
def _hour_counts(t):
    return reports.trailing_hour_counts(t("events"), "ts", AS_OF_TS, _HOURS)


@query(
    "hourly_event_histogram",
    f"SELECT DATE_TRUNC('hour', ts) AS bucket, COUNT(*) AS events FROM events WHERE ts >= TIMESTAMP '{AS_OF_TS}' - INTERVAL 168 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 240",
)
def _hourly(t):
    return reports.event_histogram(t("events"), "ts", "hour", AS_OF_TS, 168, 240)


@query(
    "daily_event_histogram",
    f"SELECT DATE_TRUNC('day', ts)::TIMESTAMP AS bucket, COUNT(*) AS events FROM events WHERE ts >= TIMESTAMP '{AS_OF_TS}' - INTERVAL 2160 HOUR GROUP BY 1 ORDER BY 1 DESC LIMIT 180",
)
def _daily_events(t):
    return reports.event_histogram(t("events"), "ts", "day", AS_OF_TS, 2160, 180)


@query(
    "top_customers_by_sales",
    "SELECT customer_key, SUM(net_amount)::DOUBLE AS total FROM gold_fact_sales WHERE customer_key IS NOT NULL GROUP BY 1 ORDER BY SUM(net_amount) DESC NULLS LAST, 1 LIMIT 250",
)
def _top_customers(t):
    return reports.top_by_key(t("gold_fact_sales"), "customer_key", "net_amount", 250)


@query(
    "top_products_by_quantity",
    "SELECT product_key, SUM(quantity)::DOUBLE AS total FROM gold_fact_sales WHERE product_key IS NOT NULL GROUP BY 1 ORDER BY SUM(quantity) DESC NULLS LAST, 1 LIMIT 250",
)
def _top_quantities(t):
    return reports.top_by_key(t("gold_fact_sales"), "product_key", "quantity", 250)


@query(
    "top_customers_by_orders",
    "SELECT customer_key, COUNT(*) AS total FROM silver_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 120",
)
def _top_counts(t):
    return reports.top_by_key(t("silver_orders"), "customer_key", "customer_key", 120, how="count")


@query(
    "rows_near_max_key",
    "SELECT COUNT(*) AS row_count FROM gold_fact_sales WHERE order_date_key >= (SELECT MAX(order_date_key) - 60 FROM gold_fact_sales)",
)
def _near_max(t):
    return reports.rows_near_max_key(t("gold_fact_sales"), 60)


@query(
    "first_customer_row",
    "SELECT customer_id, customer_type FROM silver_customer WHERE customer_id = (SELECT MIN(customer_id) FROM silver_customer)",
)
def _first_customer(t):
    return reports.first_customer_row(t("silver_customer").select("customer_id", "customer_type"))


@query(
    "products_in_category",
    "SELECT product_id, product_name, list_price::DOUBLE AS list_price FROM silver_product WHERE category_name = 'Brand#7' AND is_valid ORDER BY product_id LIMIT 50",
)
def _in_category(t):
    return reports.products_in_category(t("silver_product"), "Brand#7").select("product_id", "product_name", "list_price")


@query(
    "orders_with_customer",
    f"""SELECT o.order_id, c.customer_type, o.order_date, o.order_total::DOUBLE AS order_total FROM silver_orders o JOIN silver_customer c USING (customer_key)
        WHERE o.order_date >= {_TODAY} - 7 ORDER BY o.order_date DESC, o.order_id LIMIT 100""",
)
def _with_customer(t):
    return reports.orders_with_customer(t("silver_orders"), t("silver_customer"), AS_OF)


@query(
    "daily_order_summary",
    f"SELECT order_date AS day, COUNT(*) AS order_count, SUM(order_total)::DOUBLE AS total_revenue FROM silver_orders WHERE order_date >= {_TODAY} - 30 GROUP BY 1",
)
def _daily_summary(t):
    return reports.daily_order_summary(t("silver_orders"), AS_OF)


@query(
    "segment_orders",
    f"""SELECT c.customer_type AS segment, COUNT(*)::BIGINT AS order_count, SUM(o.order_total)::DOUBLE AS revenue, SUM(o.order_total)::DOUBLE / COUNT(*) AS avg_order_value
        FROM silver_orders o JOIN silver_customer c USING (customer_key) WHERE o.order_date >= {_TODAY} - 30 GROUP BY 1""",
)
def _segments(t):
    return reports.segment_orders(t("silver_orders"), t("silver_customer"), "customer_type", AS_OF)


sql_table("by_day", "SELECT order_date, SUM(order_total) AS metric FROM silver_orders GROUP BY 1")
sql_table("by_code", "SELECT customer_key, SUM(order_total) AS metric FROM silver_orders GROUP BY 1")


@query(
    "cumulative_metric",
    "SELECT order_date, metric::DOUBLE AS metric, (SUM(metric) OVER (ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS cumulative_metric FROM by_day",
)
def _cumulative(t):
    return reports.cumulative_metric(t("silver_orders"), "order_date", "order_total")


@query(
    "change_over_time",
    "SELECT order_date, metric::DOUBLE AS metric, (LAG(metric) OVER (ORDER BY order_date))::DOUBLE AS previous_metric FROM by_day",
)
def _change(t):
    return reports.change_over_time(t("silver_orders"), "order_date", "order_total")


@query("magnitude_by_group", "SELECT customer_key, metric::DOUBLE AS magnitude FROM by_code")
def _magnitude(t):
    return reports.magnitude_by_group(t("silver_orders"), "customer_key", "order_total")


@query(
    "ranked_groups",
    "SELECT customer_key, metric::DOUBLE AS metric, (DENSE_RANK() OVER (ORDER BY m2 DESC))::INTEGER AS metric_rank FROM (SELECT *, metric AS m2 FROM (SELECT customer_key, COUNT(*)::BIGINT AS metric FROM (SELECT customer_key FROM silver_orders) GROUP BY 1))",
)
def _ranked(t):
    return reports.ranked_groups(t("silver_orders").withColumn("one", F.lit(1).cast("decimal(10,0)")), "customer_key", "one")


@query(
    "part_to_whole",
    "SELECT customer_key, metric::DOUBLE AS metric, metric::DOUBLE / (SELECT SUM(metric)::DOUBLE FROM by_code) AS share FROM by_code",
)
def _share(t):
    return reports.part_to_whole(t("silver_orders"), "customer_key", "order_total")


@query(
    "quartile_segments",
    "SELECT customer_key, metric::DOUBLE AS metric, (NTILE(4) OVER (ORDER BY by_code.metric DESC, customer_key))::INTEGER AS segment FROM by_code",
)
def _quartiles(t):
    return reports.quartile_segments(t("silver_orders"), "customer_key", "order_total")


@query(
    "fk_hit_counts",
    "SELECT i.product_key AS src_key, COUNT(*) AS hit_count FROM silver_order_item i JOIN gold_dim_product p ON p.product_key = i.product_key GROUP BY 1",
)
def _hits(t):
    return reports.fk_hit_counts(t("silver_order_item"), t("gold_dim_product"), ("product_key", "product_key"))


@query(
    "fk_join_profile",
    "SELECT a.sales_rep_key AS src_key, COUNT(*) AS row_count, COUNT(DISTINCT a.sales_rep_key) AS distinct_src_keys FROM silver_orders a JOIN silver_employee b ON b.employee_key = a.sales_rep_key GROUP BY 1",
)
def _join_profile(t):
    return reports.fk_join_profile(t("silver_orders"), t("silver_employee"), ("sales_rep_key", "employee_key"))


@query(
    "fk_unmatched_profile",
    """SELECT a.customer_key AS src_key, SUM(CASE WHEN b.customer_key IS NULL THEN 1 ELSE 0 END)::BIGINT AS unmatched_rows, COUNT(*) AS scanned_rows
       FROM silver_orders a LEFT JOIN gold_dim_customer b ON b.customer_key = a.customer_key GROUP BY 1""",
)
def _unmatched(t):
    return reports.fk_unmatched_profile(t("silver_orders"), t("gold_dim_customer"), ("customer_key", "customer_key"))


@query(
    "fk_chain_profile",
    """SELECT COUNT(*)::BIGINT AS joined_rows, SUM(CASE WHEN c.customer_key IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_in_third_table, COUNT(DISTINCT a.order_key) AS distinct_left_keys
       FROM silver_order_item a JOIN silver_orders b ON b.order_key = a.order_key LEFT JOIN gold_dim_customer c ON c.customer_key = b.customer_key""",
)
def _chain(t):
    return reports.fk_chain_profile(
        t("silver_order_item"),
        t("silver_orders"),
        t("gold_dim_customer"),
        ("order_key", "order_key"),
        ("customer_key", "customer_key"),
    )


@query(
    "group_page",
    """SELECT customer_key, SUM(net_amount)::DOUBLE AS total, COUNT(*) AS rows_in_group, (SELECT COUNT(DISTINCT customer_key) FROM gold_fact_sales) AS group_count,
       CEIL((SELECT COUNT(DISTINCT customer_key) FROM gold_fact_sales) / 25)::INTEGER AS page_count
       FROM gold_fact_sales GROUP BY 1 ORDER BY SUM(net_amount) DESC NULLS LAST, 1 LIMIT 25 OFFSET 50""",
)
def _page(t):
    return reports.group_page(t("gold_fact_sales"), "customer_key", "net_amount", 2, 25)
