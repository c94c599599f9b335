"""Mart queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.operators import marts
from smeltery.plans.gold_queries import AS_OF, half_up
from smeltery.plans.registry import query, sql_table

_TODAY = f"DATE '{AS_OF}'"


@query(
    "cohort_analysis",
    f"""WITH f AS (SELECT customer_key, DATE_TRUNC('month', MIN(order_date))::DATE AS cohort_month FROM silver_orders GROUP BY 1), sz AS (SELECT cohort_month, COUNT(*) AS customers FROM f GROUP BY 1),
        c AS (SELECT f.cohort_month, DATEDIFF('month', f.cohort_month, o.order_date)::INTEGER AS period_number, COUNT(DISTINCT o.customer_key) AS active_customers, SUM(o.order_total) AS revenue, COUNT(DISTINCT o.order_id)::BIGINT AS orders
              FROM silver_orders o JOIN f USING (customer_key) GROUP BY ALL)
        SELECT cohort_month, period_number, customers, active_customers, active_customers::DOUBLE / customers::DOUBLE AS retention_rate, revenue::DOUBLE AS revenue,
          (SUM(revenue) OVER w)::DOUBLE AS cumulative_revenue, {half_up('(revenue * 100)::HUGEINT', 'orders')}::DOUBLE AS average_order_value, orders, (SUM(orders) OVER w)::BIGINT AS cumulative_orders
        FROM c JOIN sz USING (cohort_month) WINDOW w AS (PARTITION BY cohort_month ORDER BY period_number)""",
)
def _cohort(t):
    return marts.cohort_analysis(t("silver_orders"))


def _rate(a, b):
    return f"CASE WHEN {b} > 0 THEN LEAST(1.0::DOUBLE, {a}::DOUBLE / {b}::DOUBLE) ELSE 0.0::DOUBLE END"


@query(
    "conversion_funnel",
    f"""WITH e AS (SELECT session_id, COUNT(*) FILTER (WHERE event_type = 'page_view') AS v, MAX((event_type = 'add_to_cart')::INT) AS c, MAX((event_type = 'checkout')::INT) AS k, MAX((event_type = 'purchase')::INT) AS p FROM clickstream GROUP BY 1),
        g AS (SELECT session_date AS date_key, channel, COUNT(DISTINCT user_id) AS visitors, SUM(v)::BIGINT AS page_views, COUNT(DISTINCT CASE WHEN c = 1 THEN user_id END) AS add_to_carts,
              COUNT(DISTINCT CASE WHEN k = 1 THEN user_id END) AS checkouts, COUNT(DISTINCT CASE WHEN p = 1 THEN user_id END) AS purchases,
              SUM((EPOCH_US(end_time) - EPOCH_US(start_time)) // 1000000) AS secs, COUNT(*) AS n, COUNT(*) FILTER (WHERE page_count = 1) AS b FROM web_sessions JOIN e USING (session_id) GROUP BY ALL)
        SELECT date_key, channel, visitors, page_views, add_to_carts, checkouts, purchases, {_rate('purchases', 'visitors')} AS conversion_rate,
          CASE WHEN add_to_carts > 0 THEN 1.0::DOUBLE ELSE 0 END - {_rate('purchases', 'add_to_carts')} AS cart_abandonment_rate, {_rate('add_to_carts', 'visitors')} AS visitors_to_cart_rate,
          {_rate('checkouts', 'add_to_carts')} AS cart_to_checkout_rate, {_rate('purchases', 'checkouts')} AS checkout_to_purchase_rate, (secs // n)::INTEGER AS average_session_duration_seconds, {_rate('b', 'n')} AS bounce_rate FROM g""",
)
def _funnel(t):
    return marts.conversion_funnel(t("clickstream"), t("web_sessions"))


@query(
    "customer_360",
    f"""WITH s AS (SELECT o.customer_key, COUNT(DISTINCT o.order_id) AS n, COALESCE(SUM(i.net), 0) AS ltv, MIN(order_date) AS fd, MAX(order_date) AS ld, ARG_MAX(order_total, (order_date, order_id)) AS lo
          FROM silver_orders o LEFT JOIN (SELECT order_key, SUM(net_amount) AS net FROM silver_order_item GROUP BY 1) i USING (order_key) GROUP BY 1),
        f AS (SELECT customer_key, category_name FROM (SELECT o.customer_key, p.category_name, SUM(i.net_amount) AS net FROM silver_order_item i JOIN silver_orders o USING (order_key) JOIN silver_product p USING (product_key) GROUP BY ALL)
              QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_key ORDER BY net DESC, category_name DESC) = 1),
        r AS (SELECT customer_key, COUNT(*) AS k, SUM(rating)::DOUBLE / COUNT(*) AS a FROM raw_reviews WHERE rating BETWEEN 1 AND 5 GROUP BY 1)
        SELECT c.customer_key, c.customer_id, COALESCE(ltv, 0)::DOUBLE AS lifetime_value, COALESCE(n, 0) AS total_orders, CASE WHEN n > 0 THEN {half_up('(ltv * 100)::HUGEINT', 'n')} END::DOUBLE AS average_order_value,
          CASE WHEN n > 0 THEN (n * 30)::DOUBLE / GREATEST({_TODAY} - fd, 1)::DOUBLE ELSE 0 END AS purchase_frequency, ({_TODAY} - ld)::INTEGER AS days_since_last_purchase, ({_TODAY} - fd)::INTEGER AS days_since_first_purchase,
          CASE WHEN COALESCE(n, 0) = 0 THEN 'INACTIVE' WHEN n >= 20 THEN 'VIP' WHEN n >= 5 THEN 'REGULAR' ELSE 'NEW' END AS customer_segment, COALESCE(LEAST(1.0::DOUBLE, ({_TODAY} - ld) / 365.0::DOUBLE), 1.0::DOUBLE) AS churn_risk_score,
          f.category_name AS favorite_category, COALESCE(r.k, 0) AS total_reviews, r.a AS average_rating, fd AS first_purchase_date, ld AS last_purchase_date, lo::DOUBLE AS last_order_amount
        FROM silver_customer c LEFT JOIN s USING (customer_key) LEFT JOIN f USING (customer_key) LEFT JOIN r USING (customer_key)""",
)
def _c360(t):
    return marts.customer_360(
        t("silver_customer"), t("silver_orders"), t("silver_order_item"), t("silver_product"), t("raw_reviews"), AS_OF
    )


@query(
    "daily_sales_summary",
    f"""WITH f AS (SELECT customer_key, MIN(order_date) AS fd FROM silver_orders GROUP BY 1),
        i AS (SELECT order_key, SUM(net_amount) AS net, SUM(quantity) AS q, SUM(discount_amount) AS off FROM silver_order_item GROUP BY 1),
        d AS (SELECT order_date, COUNT(DISTINCT order_id)::BIGINT AS n, COALESCE(SUM(net), 0) AS rev, COALESCE(SUM(q), 0) AS q, COUNT(DISTINCT customer_key) AS u, COUNT(DISTINCT CASE WHEN order_date = fd THEN customer_key END) AS nw, COALESCE(SUM(off), 0) AS off
              FROM silver_orders JOIN f USING (customer_key) LEFT JOIN i USING (order_key) GROUP BY 1),
        p AS (SELECT order_date, product_key, category_name, SUM(net_amount) AS net FROM silver_order_item JOIN silver_orders USING (order_key) JOIN silver_product USING (product_key) GROUP BY ALL),
        bp AS (SELECT order_date, product_key FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY order_date ORDER BY net DESC, product_key) = 1),
        bc AS (SELECT order_date, category_name, net FROM (SELECT order_date, category_name, SUM(net) AS net FROM p GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY order_date ORDER BY net DESC, category_name DESC) = 1)
        SELECT order_date AS date_key, n AS total_orders, rev::DOUBLE AS total_revenue, q::DOUBLE AS total_items_sold, {half_up('(rev * 100)::HUGEINT', 'n')}::DOUBLE AS average_order_value, u AS unique_customers, nw AS new_customers, u - nw AS returning_customers,
          bc.category_name AS top_category, bp.product_key AS top_product_key, bc.net::DOUBLE AS top_category_revenue, q::DOUBLE / n::DOUBLE AS average_items_per_order, off::DOUBLE AS total_discount_amount
        FROM d LEFT JOIN bp USING (order_date) LEFT JOIN bc USING (order_date)""",
)
def _daily(t):
    return marts.daily_sales_summary(t("silver_orders"), t("silver_order_item"), t("silver_product"))


sql_table(
    "stock_levels",
    """WITH d AS (SELECT product_key, warehouse_key, movement_date AS snapshot_date, SUM(CASE WHEN movement_type = 'OUT' THEN -ABS(quantity) ELSE quantity END)::BIGINT AS net_change FROM stock_movements GROUP BY ALL)
       SELECT product_key, warehouse_key, snapshot_date, net_change, (SUM(net_change) OVER w)::BIGINT AS quantity_on_hand, LEAD(snapshot_date) OVER (PARTITION BY product_key, warehouse_key ORDER BY snapshot_date) - 1 AS holds_until
       FROM d WINDOW w AS (PARTITION BY product_key, warehouse_key ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)


@query("inventory_daily_levels", "SELECT * FROM stock_levels")
def _levels(t):
    return marts.inventory_snapshots(t("stock_movements"))


@query(
    "inventory_health",
    f"""WITH s AS (SELECT product_key, warehouse_key, ARG_MAX(quantity_on_hand, snapshot_date) AS cur, COUNT(*) FILTER (WHERE quantity_on_hand <= 0) AS so FROM stock_levels GROUP BY ALL),
        o AS (SELECT product_key, warehouse_key, SUM(ABS(quantity))::BIGINT AS q FROM stock_movements WHERE movement_type = 'OUT' AND movement_date > {_TODAY} - 90 AND movement_date <= {_TODAY} GROUP BY ALL),
        j AS (SELECT s.*, COALESCE(q, 0) AS q FROM s LEFT JOIN o USING (product_key, warehouse_key)),
        k AS (SELECT *, CEIL(q * 3 / 90.0::DOUBLE)::BIGINT AS sf, CEIL(q * 7 / 90.0::DOUBLE)::BIGINT AS ld, CEIL(q * 30 / 90.0::DOUBLE)::BIGINT AS mo FROM j)
        SELECT product_key, warehouse_key, cur AS current_stock, CASE WHEN q > 0 THEN GREATEST(0, FLOOR(cur * 90 / q::DOUBLE)::BIGINT) END AS days_of_supply, so AS stockout_frequency, cur > (mo + sf) * 2 AS overstock_flag, cur < ld + sf AS understock_flag,
          ld + sf AS reorder_point, sf AS safety_stock, mo + sf AS optimal_stock_level, q / 90.0::DOUBLE AS average_daily_demand, CASE WHEN cur > 0 THEN q::DOUBLE / cur END AS stock_velocity, {_TODAY} AS snapshot_date FROM k""",
)
def _health(t):
    return marts.inventory_health(t("stock_movements"), AS_OF)


def _hits(words):
    return f"LEN(list_filter(regexp_split_to_array(LOWER(COALESCE(review_text, '')), '[^a-z]+'), lambda w: w IN ({', '.join(repr(w) for w in words)})))"


sql_table(
    "clean_reviews",
    f"""SELECT review_id, product_key, customer_key, rating, NULLIF(TRIM(review_text), '') AS review_text, CASE WHEN g + b <> 0 THEN (g - b)::DOUBLE / (g + b)::DOUBLE ELSE 0 END::DOUBLE AS sentiment_score,
        COALESCE(verified_purchase, FALSE) AS is_verified_purchase, review_date FROM (SELECT *, {_hits(marts.POSITIVE)} AS g, {_hits(marts.NEGATIVE)} AS b FROM raw_reviews WHERE rating BETWEEN 1 AND 5)""",
)


@query("product_reviews", "SELECT * FROM clean_reviews")
def _reviews(t):
    return marts.product_reviews(t("raw_reviews"))


_STARS = ", ".join(f"COALESCE(s{k}, 0) AS total_reviews_{k}_star" for k in range(5, 0, -1))
_COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE rating = {k}) AS s{k}" for k in range(5, 0, -1))


@query(
    "product_performance",
    f"""WITH s AS (SELECT product_key, SUM(quantity) AS u, SUM(net_amount) AS r, MAX(order_date) AS ld FROM silver_order_item JOIN silver_orders USING (order_key) GROUP BY 1),
        v AS (SELECT product_key, COUNT(*) AS k, SUM(rating)::DOUBLE / COUNT(*) AS a, SUM(ROUND(sentiment_score, 6)::DECIMAL(18,6))::DOUBLE / COUNT(*) AS se, {_COUNTS} FROM clean_reviews GROUP BY 1),
        h AS (SELECT product_key, SUM(quantity_on_hand)::BIGINT AS oh FROM silver_inventory GROUP BY 1),
        q AS (SELECT (l_partkey + 1)::BIGINT AS product_key, SUM(l_quantity::DECIMAL(10,2)) AS rt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT p.product_key, p.product_id, p.product_name, p.category_name AS category, COALESCE(u, 0)::DOUBLE AS total_units_sold, COALESCE(r, 0)::DOUBLE AS total_revenue, v.a AS average_rating, COALESCE(v.k, 0) AS review_count,
          CASE WHEN oh <> 0 THEN COALESCE(u, 0)::DOUBLE / oh::DOUBLE END AS inventory_turnover,
          CASE WHEN u <> 0 THEN COALESCE(rt, 0)::DOUBLE / u::DOUBLE END AS return_rate, ({_TODAY} - ld)::INTEGER AS days_since_last_sale,
          (ROW_NUMBER() OVER (PARTITION BY p.category_name ORDER BY COALESCE(r, 0) DESC, p.product_key))::INTEGER AS category_rank, {_STARS}, se AS average_sentiment_score
        FROM silver_product p LEFT JOIN s USING (product_key) LEFT JOIN v USING (product_key) LEFT JOIN h USING (product_key) LEFT JOIN q USING (product_key)""",
)
def _performance(t):
    returned = t("lineitem").where("l_returnflag = 'R'")
    returns = returned.select((F.col("l_partkey") + 1).alias("product_key"), F.col("l_quantity").cast("decimal(10,2)").alias("quantity"))
    return marts.product_performance(
        t("silver_orders"), t("silver_order_item"), t("silver_product"), marts.product_reviews(t("raw_reviews")), t("silver_inventory"), returns, AS_OF
    )


@query(
    "user_events",
    r"""SELECT event_id, session_id, user_id, event_type,
        CASE WHEN page_url IS NULL THEN 'unknown' WHEN pth LIKE '/product%' THEN 'product' WHEN pth LIKE '/cart%' THEN 'cart' WHEN pth LIKE '/checkout%' THEN 'checkout' WHEN pth IN ('', '/') THEN 'home' ELSE 'other' END AS page_category, page_url,
        CASE WHEN referrer IS NULL THEN 'direct' WHEN hst = 'shop.example' THEN 'internal' WHEN regexp_matches(hst, 'google|bing|duckduckgo|yahoo') THEN 'search' WHEN regexp_matches(hst, 'facebook|instagram|twitter|tiktok|pinterest') THEN 'social' ELSE 'referral' END AS referrer_category,
        referrer AS referrer_url, CASE WHEN json_valid(device_info) THEN json_extract_string(device_info, '$.device_type') ELSE 'unknown' END AS device_type, CASE WHEN json_valid(device_info) THEN json_extract_string(device_info, '$.browser') END AS browser,
        CASE WHEN json_valid(device_info) THEN json_extract_string(device_info, '$.os') END AS operating_system, event_timestamp
        FROM (SELECT *, regexp_extract(page_url, '^https?://[^/]+([^?]*)', 1) AS pth, regexp_extract(referrer, '^https?://([^/]+)', 1) AS hst FROM clickstream)""",
)
def _events(t):
    return marts.user_events(t("clickstream"))


sql_table(
    "dashboard",
    f"""WITH s AS (SELECT DATE_TRUNC('hour', event_timestamp) AS h, COUNT(*) FILTER (WHERE event_type = 'purchase') AS o, COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN value END), 0) AS rev, COUNT(DISTINCT user_id) AS au,
          COUNT(*) FILTER (WHERE event_type = 'page_view') AS pv, COUNT(DISTINCT CASE WHEN event_type = 'page_view' THEN user_id END) AS uv, COUNT(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS b, COUNT(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN user_id END) AS c
          FROM clickstream GROUP BY 1),
        p AS (SELECT h, pid, v FROM (SELECT DATE_TRUNC('hour', event_timestamp) AS h, TRY_CAST(NULLIF(regexp_extract(page_url, '/product/([0-9]+)', 1), '') AS BIGINT) AS pid, SUM(value) AS v FROM clickstream GROUP BY ALL) WHERE pid IS NOT NULL
              QUALIFY ROW_NUMBER() OVER (PARTITION BY h ORDER BY v DESC, pid DESC) = 1),
        k AS (SELECT h, category_name, SUM(value) AS kv FROM (SELECT DATE_TRUNC('hour', event_timestamp) AS h, TRY_CAST(NULLIF(regexp_extract(page_url, '/product/([0-9]+)', 1), '') AS BIGINT) AS product_id, value FROM clickstream) JOIN silver_product USING (product_id)
              GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY h ORDER BY kv DESC, category_name DESC) = 1)
        SELECT h::DATE AS metric_date, HOUR(h)::INTEGER AS metric_hour, o AS orders_today, rev::DOUBLE AS revenue_today, au AS active_users, CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE 0 END - {_rate('b', 'c')} AS cart_abandonment_rate, pid AS top_product_id, v::DOUBLE AS top_product_value, category_name AS top_category, kv::DOUBLE AS top_category_revenue,
          CASE WHEN o > 0 THEN {half_up('(rev * 100)::HUGEINT', 'o')} END::DOUBLE AS average_order_value, {_rate('b', 'au')} AS conversion_rate, pv AS page_views, uv AS unique_visitors FROM s LEFT JOIN p USING (h) LEFT JOIN k USING (h)""",
)


@query("real_time_dashboard", "SELECT * FROM dashboard")
def _dashboard(t):
    return marts.real_time_dashboard(t("clickstream"), t("silver_product"))


_RUN = "TIMESTAMP '2001-08-02 00:00:00'"
_OLD = "TIMESTAMP '2000-01-01 00:00:00'"


sql_table(
    "customer_history",
    f"""WITH cur AS (SELECT customer_id, CASE WHEN customer_id % 5 = 0 THEN 'LOW' ELSE income_bracket END AS income_bracket, customer_type, {_OLD} AS valid_from, NULL::TIMESTAMP AS valid_to, TRUE AS is_current FROM silver_customer WHERE customer_since IS NOT NULL
          UNION ALL SELECT customer_id, 'NONE', customer_type, {_OLD} - INTERVAL 1 YEAR, {_OLD}, FALSE FROM silver_customer WHERE customer_since IS NOT NULL),
        inc AS (SELECT customer_id, income_bracket, customer_type FROM silver_customer WHERE is_valid),
        ch AS (SELECT c.customer_id FROM cur c JOIN inc i USING (customer_id) WHERE c.is_current AND (c.income_bracket, c.customer_type) IS DISTINCT FROM (i.income_bracket, i.customer_type))
        SELECT customer_id, income_bracket, customer_type, valid_from, CASE WHEN is_current AND customer_id IN (SELECT customer_id FROM ch) THEN {_RUN} ELSE valid_to END AS valid_to, is_current AND customer_id NOT IN (SELECT customer_id FROM ch) AS is_current FROM cur
        UNION ALL SELECT customer_id, income_bracket, customer_type, {_RUN}, NULL, TRUE FROM inc WHERE customer_id IN (SELECT customer_id FROM ch) OR customer_id NOT IN (SELECT customer_id FROM cur WHERE is_current)""",
)


@query("scd2_merge", "SELECT * FROM customer_history")
def _scd2(t):
    c = t("silver_customer")
    held = c.where("customer_since IS NOT NULL")
    old = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    bracket = F.when(F.col("customer_id") % 5 == 0, "LOW").otherwise(F.col("income_bracket"))
    now = held.select(
        "customer_id", bracket.alias("income_bracket"), "customer_type", old.alias("valid_from"), none.alias("valid_to"), F.lit(True).alias("is_current")
    )
    before = held.select(
        "customer_id",
        F.lit("NONE").alias("income_bracket"),
        "customer_type",
        F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"),
        old.alias("valid_to"),
        F.lit(False).alias("is_current"),
    )
    incoming = c.where("is_valid").select("customer_id", "income_bracket", "customer_type")
    return marts.scd2_merge(now.unionByName(before), incoming, "customer_id", ["income_bracket", "customer_type"], "2001-08-02 00:00:00")


@query(
    "customer_version_of_orders",
    """WITH v AS (SELECT *, valid_from = MIN(valid_from) OVER (PARTITION BY customer_id) AS oldest FROM customer_history)
       SELECT o.order_id, o.order_date, o.customer_key AS customer_id, v.income_bracket, v.valid_from FROM silver_orders o LEFT JOIN v ON v.customer_id = o.customer_key
         AND (v.oldest OR o.order_date >= v.valid_from::DATE) AND (v.valid_to IS NULL OR o.order_date < v.valid_to::DATE) WHERE o.order_date IS NOT NULL""",
)
def _version_of_orders(t):
    orders = t("silver_orders").where("order_date IS NOT NULL").select("order_id", "order_date", F.col("customer_key").alias("customer_id"))
    return marts.version_at(orders, _scd2(t), "customer_id", "order_date", ["income_bracket", "valid_from"])
