"""Silver to gold queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.functions.ordered import with_surrogate_key
from smeltery.operators import gold
from smeltery.plans.registry import query, sql_table

AS_OF = "2001-08-01"
_TODAY = f"DATE '{AS_OF}'"
_CURRENT = "TRUE AS is_current, {} AS effective_date, DATE '9999-12-31' AS expiration_date"
_SILVER = (
    "customer",
    "person",
    "customer_employee",
    "customer_company",
    "person_location",
    "location",
    "country",
    "product",
    "employee",
    "employment_jobs",
    "restricted_info",
    "warehouse",
    "orders",
    "order_item",
    "inventory",
)


class _Layer(dict):
    """Silver or gold tables of the test folder, looked up when an operator asks."""

    def __init__(self, tables, prefix):
        super().__init__()
        self._tables, self._prefix = tables, prefix

    def __missing__(self, name):
        return self._tables(f"{self._prefix}_{name}")


def silver_layer(t):
    return _Layer(t, "silver")


def gold_layer(t):
    return _Layer(t, "gold")


def half_up(cents: str, count: str) -> str:
    """SQL: cents / count as money, halves rounded up; cents and count are whole numbers."""
    return f"(((2 * ({cents}) + ({count})) // (2 * ({count}))) / 100.0)"


_DATE_ATTRS = """(YEAR(d) * 10000 + MONTH(d) * 100 + DAY(d))::INTEGER AS date_key, d AS full_date, ISODOW(d)::INTEGER AS day_of_week,
    DAYNAME(d) AS day_name, DAY(d)::INTEGER AS day_of_month, DAYOFYEAR(d)::INTEGER AS day_of_year, WEEKOFYEAR(d)::INTEGER AS week_of_year,
    MONTH(d)::INTEGER AS month_number, MONTHNAME(d) AS month_name, SUBSTR(MONTHNAME(d), 1, 3) AS month_short_name,
    QUARTER(d)::INTEGER AS quarter_number, 'Q' || QUARTER(d) AS quarter_name, YEAR(d)::INTEGER AS year_number, ISODOW(d) >= 6 AS is_weekend,
    FALSE AS is_holiday, '' AS holiday_name, YEAR(d)::INTEGER AS fiscal_year, QUARTER(d)::INTEGER AS fiscal_quarter, MONTH(d)::INTEGER AS fiscal_month"""


@query(
    "dim_date",
    f"""SELECT {_DATE_ATTRS} FROM (SELECT UNNEST(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d
        FROM (SELECT MIN(order_date) AS lo, MAX(order_date) AS hi FROM silver_orders))""",
)
def _dim_date(t):
    return gold.dim_date(t("silver_orders"), AS_OF)


@query(
    "dim_date_fill_gaps",
    f"""SELECT {_DATE_ATTRS} FROM (SELECT DISTINCT order_date AS d FROM silver_orders WHERE order_date NOT IN
        (SELECT order_date FROM silver_orders WHERE order_status = 'COMPLETED'))""",
)
def _gaps(t):
    have = t("silver_orders").where("order_status = 'COMPLETED'").selectExpr("order_date AS full_date").distinct()
    return gold.dim_date_fill_gaps(have, t("silver_orders"))


def _b(column: str, default: str) -> str:
    return f"COALESCE(NULLIF(TRIM({column}), ''), {default})"


_PRIMARY = "(SELECT person_key, ARG_MIN(location_key, person_location_key) AS location_key FROM silver_person_location WHERE is_primary GROUP BY person_key)"
_FULL = "COALESCE(NULLIF(TRIM(p.full_name), ''), TRIM(COALESCE(p.first_name, 'Unknown') || ' ' || COALESCE(p.last_name, 'Unknown')))"


@query(
    "dim_customer",
    f"""SELECT c.customer_key, c.customer_id, {_b('p.first_name', "'Unknown'")} AS first_name, {_b('p.last_name', "'Unknown'")} AS last_name,
        {_FULL} AS full_name, {_b('p.gender', "'U'")} AS gender, {_b('cc.company_name', "'Individual'")} AS company_name,
        COALESCE(cc.credit_limit, 0)::DOUBLE AS company_credit_limit, {_b('c.customer_type', "'RETAIL'")} AS customer_type,
        COALESCE(c.income_level, 0) AS income_level, {_b('c.income_bracket', "'UNKNOWN'")} AS income_bracket,
        COALESCE(c.account_manager_id, 0) AS account_manager_id,
        CASE WHEN COALESCE(c.account_manager_id, 0) = 0 THEN 'Unassigned' ELSE 'Manager ' || c.account_manager_id END AS account_manager_name,
        {_b('loc.city', "'—'")} AS city, {_b('loc.state_province', "'—'")} AS state_province, {_b('co.country_name', "'—'")} AS country_name,
        {_b('loc.postal_code', "'00000'")} AS postal_code, {_b('c.income_bracket', "'STANDARD'")} AS customer_segment,
        {_b('c.income_bracket', "'STANDARD'")} AS lifetime_value_tier, {_CURRENT.format(f'COALESCE(c.customer_since, {_TODAY})')}
        FROM silver_customer c LEFT JOIN silver_person p ON c.person_key = p.person_key
        LEFT JOIN silver_customer_employee ce ON c.customer_employee_key = ce.customer_employee_key
        LEFT JOIN silver_customer_company cc ON ce.company_key = cc.company_key
        LEFT JOIN {_PRIMARY} pl ON p.person_key = pl.person_key LEFT JOIN silver_location loc ON pl.location_key = loc.location_key
        LEFT JOIN silver_country co ON loc.country_key = co.country_key WHERE c.is_valid""",
)
def _dim_customer(t):
    return gold.dim_customer(silver_layer(t), None, AS_OF)


@query(
    "dim_product",
    f"""SELECT product_key, product_id, {_b('product_name', "'Product ' || product_id")} AS product_name, {_b('description', "'No description'")} AS description,
        COALESCE(category_id, 0) AS category_id, {_b('category_name', "'General'")} AS category_name, weight_class, weight_class_description,
        warranty_period_months, list_price::DOUBLE AS list_price, minimum_price::DOUBLE AS minimum_price, price_currency,
        profit_margin::DOUBLE AS profit_margin, profit_margin_pct::DOUBLE AS profit_margin_pct, {_b('product_status', "'Active'")} AS product_status,
        LOWER(TRIM(product_status)) = 'active' AS is_active, supplier_id, {_CURRENT.format(_TODAY)} FROM silver_product WHERE is_valid""",
)
def _dim_product(t):
    return gold.dim_product(silver_layer(t), None, AS_OF)


@query(
    "dim_employee",
    f"""SELECT e.employee_key, e.employee_id, {_b('p.first_name', "'Unknown'")} AS first_name, {_b('p.last_name', "'Unknown'")} AS last_name,
        {_FULL} AS full_name, {_b('j.job_title', "'Staff'")} AS job_title, 'General' AS department,
        COALESCE(r.hire_date, e.start_date, {_TODAY}) AS hire_date, COALESCE(e.start_date, {_TODAY}) AS start_date,
        COALESCE(e.end_date, DATE '9999-12-31') AS end_date, e.tenure_years, e.is_active, {_b('e.employment_status', "'ACTIVE'")} AS employment_status,
        e.salary::DOUBLE AS salary, COALESCE(e.commission_percent, 0)::DOUBLE AS commission_percent,
        e.manager_employee_key AS manager_employee_id, {_b('mp.full_name', "'N/A'")} AS manager_name, {_b('loc.city', "'—'")} AS city,
        {_b('co.country_name', "'—'")} AS country_name, {_CURRENT.format(f'COALESCE(e.start_date, {_TODAY})')}
        FROM silver_employee e LEFT JOIN silver_person p ON e.person_key = p.person_key
        LEFT JOIN silver_employment_jobs j ON e.job_key = j.job_key LEFT JOIN silver_restricted_info r ON p.person_key = r.person_key
        LEFT JOIN silver_employee m ON e.manager_employee_key = m.employee_key LEFT JOIN silver_person mp ON m.person_key = mp.person_key
        LEFT JOIN {_PRIMARY} pl ON p.person_key = pl.person_key LEFT JOIN silver_location loc ON pl.location_key = loc.location_key
        LEFT JOIN silver_country co ON loc.country_key = co.country_key WHERE e.is_valid""",
)
def _dim_employee(t):
    return gold.dim_employee(silver_layer(t), None, AS_OF)


@query(
    "dim_location",
    f"""SELECT l.location_key, l.location_id, {_b('l.address_line_1', "'—'")} AS address_line_1, {_b('l.city', "'—'")} AS city,
        {_b('l.state_province', "'—'")} AS state_province, {_b('l.district', "'—'")} AS district, {_b('l.postal_code', "'00000'")} AS postal_code,
        COALESCE(c.country_id, 0) AS country_id, {_b('c.country_name', "'Unknown'")} AS country_name, {_b('c.country_code', "'UNK'")} AS country_code,
        {_b('c.currency_code', "'USD'")} AS currency_code, {_b('c.country_name', "'General'")} AS region, '—' AS sub_region,
        {_b('l.location_type', "'OTHER'")} AS location_type, {_CURRENT.format(_TODAY)}
        FROM silver_location l LEFT JOIN silver_country c ON l.country_key = c.country_key WHERE l.is_valid""",
)
def _dim_location(t):
    return gold.dim_location(silver_layer(t), None, AS_OF)


@query(
    "dim_warehouse",
    f"""SELECT w.warehouse_key, w.warehouse_id, {_b('w.warehouse_name', "'Warehouse ' || w.warehouse_id")} AS warehouse_name, w.location_key,
        {_b('l.city', "'—'")} AS city, {_b('l.state_province', "'—'")} AS state_province, {_b('c.country_name', "'—'")} AS country_name,
        {_b('l.state_province', "'—'")} AS warehouse_region, {_CURRENT.format(_TODAY)}
        FROM silver_warehouse w LEFT JOIN silver_location l ON w.location_key = l.location_key
        LEFT JOIN silver_country c ON l.country_key = c.country_key
        WHERE w.is_valid AND (w.location_key IS NULL OR w.location_key IN (SELECT location_key FROM silver_location WHERE is_valid))""",
)
def _dim_warehouse(t):
    layer = silver_layer(t)
    return gold.dim_warehouse(layer, gold.dim_location(layer, None, AS_OF), None, AS_OF)


@query(
    "dim_promotion",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY promotion_code) AS promotion_key, * FROM (
        SELECT '' AS promotion_code, 'No promotion' AS promotion_name, 'NONE' AS promotion_type, 0::DOUBLE AS discount_percent,
               0::DOUBLE AS discount_amount, DATE '1970-01-01' AS start_date, DATE '9999-12-31' AS end_date, TRUE AS is_active
        UNION ALL SELECT DISTINCT promotion_code, promotion_code, 'DISCOUNT', 10::DOUBLE, 0::DOUBLE, {_TODAY} - 365, {_TODAY} + 365, TRUE
        FROM silver_orders WHERE TRIM(promotion_code) <> '')""",
)
def _dim_promotion(t):
    return with_surrogate_key(gold.dim_promotion(t("silver_orders"), None, AS_OF), "promotion_key", ["promotion_code"])


sql_table(
    "expected_fact_sales",
    """SELECT (YEAR(o.order_date) * 10000 + MONTH(o.order_date) * 100 + DAY(o.order_date))::INTEGER AS order_date_key, o.customer_key,
       i.product_key, o.sales_rep_key AS employee_key,
       COALESCE(b.location_key, (SELECT MIN(location_key) FROM silver_location WHERE is_valid)) AS location_key, dp.promotion_key, o.order_id,
       i.order_item_id, COALESCE(NULLIF(TRIM(o.order_code), ''), 'ORD-' || o.order_id) AS order_code, i.quantity::DOUBLE AS quantity,
       i.unit_price::DOUBLE AS unit_price, i.discount_amount::DOUBLE AS discount_amount, i.line_total::DOUBLE AS gross_amount,
       i.net_amount::DOUBLE AS net_amount, ROUND(i.line_total * 0.65, 2)::DOUBLE AS cost_amount,
       ROUND(i.net_amount - i.line_total * 0.65, 2)::DOUBLE AS profit_amount, o.order_status, o.order_status_category
       FROM silver_orders o JOIN silver_order_item i ON o.order_key = i.order_key
       LEFT JOIN silver_customer c ON c.customer_key = o.customer_key
       LEFT JOIN (SELECT person_key, location_key FROM silver_person_location
                  QUALIFY ROW_NUMBER() OVER (PARTITION BY person_key ORDER BY is_primary DESC NULLS LAST, person_location_key) = 1) b
         ON b.person_key = c.person_key
       LEFT JOIN gold_dim_promotion dp ON dp.promotion_code = COALESCE(NULLIF(TRIM(o.promotion_code), ''), '')
       WHERE o.is_valid AND i.is_valid AND o.order_date IS NOT NULL""",
)


def _gold_for_facts(t):
    return {
        "dim_promotion": t("gold_dim_promotion"),
        "dim_location": t("silver_location").where("is_valid"),
        "dim_customer": t("gold_dim_customer"),
    }


@query("fact_sales", "SELECT * FROM expected_fact_sales")
def _fact_sales(t):
    return gold.fact_sales(silver_layer(t), _gold_for_facts(t))


_LOADED = "SELECT order_id, order_item_id FROM gold_fact_sales WHERE order_date_key < 20010101"


@query(
    "fact_sales_append",
    f"""SELECT * FROM expected_fact_sales e WHERE NOT EXISTS (SELECT 1 FROM ({_LOADED}) l
        WHERE l.order_id = e.order_id AND l.order_item_id = e.order_item_id)""",
)
def _fact_sales_append(t):
    loaded = t("gold_fact_sales").where("order_date_key < 20010101")
    return gold.fact_sales(silver_layer(t), _gold_for_facts(t), loaded, mode="append")


@query(
    "fact_sales_watermark",
    f"""SELECT * FROM expected_fact_sales e WHERE order_id > (SELECT MAX(order_id) FROM gold_fact_sales WHERE order_date_key < 19950401)
        AND NOT EXISTS (SELECT 1 FROM (SELECT order_id, order_item_id FROM gold_fact_sales WHERE order_date_key < 19950401) l
        WHERE l.order_id = e.order_id AND l.order_item_id = e.order_item_id)""",
)
def _fact_sales_watermark(t):
    loaded = t("gold_fact_sales").where("order_date_key < 19950401")
    return gold.fact_sales(silver_layer(t), _gold_for_facts(t), loaded, mode="append", watermark=True)


@query(
    "fact_orders",
    """SELECT (YEAR(o.order_date) * 10000 + MONTH(o.order_date) * 100 + DAY(o.order_date))::INTEGER AS order_date_key, o.customer_key,
       o.sales_rep_key AS employee_key, dp.promotion_key, o.order_id, COALESCE(NULLIF(TRIM(o.order_code), ''), 'ORD-' || o.order_id) AS order_code,
       COALESCE(SUM(i.quantity), 0)::DOUBLE AS total_quantity, COUNT(i.order_item_id)::INTEGER AS total_items,
       COUNT(DISTINCT i.product_key)::INTEGER AS distinct_products, COALESCE(SUM(i.line_total), 0)::DOUBLE AS gross_amount,
       COALESCE(SUM(i.discount_amount), 0)::DOUBLE AS discount_amount, COALESCE(SUM(i.net_amount), 0)::DOUBLE AS net_amount,
       o.order_status, o.order_status_category, o.order_currency, NULLIF(TRIM(o.promotion_code), '') IS NOT NULL AS has_promotion
       FROM silver_orders o JOIN gold_dim_customer dc ON dc.customer_key = o.customer_key
       LEFT JOIN silver_order_item i ON i.order_key = o.order_key AND i.is_valid
       LEFT JOIN gold_dim_promotion dp ON dp.promotion_code = COALESCE(NULLIF(TRIM(o.promotion_code), ''), '')
       WHERE o.is_valid AND o.order_date IS NOT NULL
       GROUP BY o.order_date, o.customer_key, o.sales_rep_key, dp.promotion_key, o.order_id, o.order_code, o.order_status,
                o.order_status_category, o.order_currency, o.promotion_code""",
)
def _fact_orders(t):
    return gold.fact_orders(silver_layer(t), _gold_for_facts(t))


_SUPPLY = """CASE WHEN quantity_available <= 0 THEN 0 ELSE LEAST(999, GREATEST(0, quantity_on_hand // quantity_available)) END"""
sql_table(
    "silver_stock_now",
    f"""SELECT i.product_key, i.warehouse_key, quantity_on_hand, quantity_available, quantity_reserved, ({_SUPPLY})::INTEGER AS days_of_supply,
        CASE WHEN quantity_available <= 0 THEN 'OUT_OF_STOCK' WHEN quantity_available < 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS stock_status,
        ROUND(quantity_on_hand * COALESCE(p.list_price, 0), 2)::DOUBLE AS inventory_value
        FROM silver_inventory i LEFT JOIN silver_product p ON p.product_key = i.product_key AND p.is_valid WHERE i.is_valid""",
)


@query("inventory_snapshot", "SELECT 20010801 AS snapshot_date_key, * FROM silver_stock_now")
def _snapshot(t):
    return gold.fact_inventory_snapshot(silver_layer(t), t("gold_inventory_snapshots"), "2001-08-01")


@query("inventory_snapshot_cold_start", "SELECT 20010801 AS snapshot_date_key, * FROM silver_stock_now")
def _snapshot_cold(t):
    return gold.fact_inventory_snapshot(silver_layer(t), None, "2001-08-01")


@query(
    "previous_snapshot_key",
    "SELECT MAX(snapshot_date_key) AS previous_key FROM gold_inventory_snapshots WHERE snapshot_date_key < 20010801",
)
def _previous_key(t):
    snaps = t("gold_inventory_snapshots")
    return t.spark.range(1).select(gold.previous_snapshot_key(snaps, 20010801).alias("previous_key"))


sql_table(
    "expected_daily",
    f"""SELECT (YEAR(order_date) * 10000 + MONTH(order_date) * 100 + DAY(order_date))::INTEGER AS date_key, total_orders, total_customers,
        items::DOUBLE AS total_items_sold, gross::DOUBLE AS gross_revenue, off::DOUBLE AS discount_given, net::DOUBLE AS net_revenue,
        {half_up('(net * 100)::HUGEINT', 'total_orders')}::DOUBLE AS avg_order_value
        FROM (SELECT order_date, COUNT(DISTINCT o.order_id) AS total_orders, COUNT(DISTINCT o.customer_key) AS total_customers,
              COALESCE(SUM(i.quantity), 0) AS items, COALESCE(SUM(i.line_total), 0) AS gross, COALESCE(SUM(i.discount_amount), 0) AS off,
              COALESCE(SUM(i.net_amount), 0) AS net
              FROM silver_orders o LEFT JOIN silver_order_item i ON i.order_key = o.order_key AND i.is_valid WHERE o.is_valid GROUP BY order_date)""",
)


@query("agg_daily_sales", "SELECT * FROM expected_daily")
def _daily(t):
    return gold.agg_daily_sales(t("silver_orders"), t("silver_order_item"))


@query(
    "agg_daily_sales_missing_dates",
    "SELECT * FROM expected_daily WHERE date_key NOT IN (SELECT date_key FROM gold_dim_date WHERE full_date < DATE '2001-01-01')",
)
def _daily_missing(t):
    have = t("gold_dim_date").where("full_date < DATE'2001-01-01'")
    return gold.agg_daily_sales(t("silver_orders"), t("silver_order_item"), existing=have)


@query(
    "daily_sales_trend",
    """SELECT date_key, net_revenue, prev AS prev_day_revenue, CASE WHEN prev <> 0 THEN (net_revenue - prev) / prev * 100 END AS revenue_change_pct
       FROM (SELECT date_key, net_revenue, LAG(net_revenue) OVER (ORDER BY date_key) AS prev FROM expected_daily)""",
)
def _trend(t):
    return gold.daily_sales_trend(gold.agg_daily_sales(t("silver_orders"), t("silver_order_item")))


@query(
    "agg_customer_lifetime",
    f"""WITH s AS (SELECT c.customer_key, MIN(o.order_date) AS first_order_date, MAX(o.order_date) AS last_order_date,
              COUNT(DISTINCT o.order_id) AS total_orders, COALESCE(SUM(i.quantity), 0) AS items, COALESCE(SUM(i.line_total), 0) AS gross,
              COALESCE(SUM(i.net_amount), 0) AS net
            FROM silver_customer c LEFT JOIN silver_orders o ON o.customer_key = c.customer_key
            LEFT JOIN silver_order_item i ON i.order_key = o.order_key WHERE c.is_valid GROUP BY c.customer_key),
        q AS (SELECT *, CASE WHEN {_TODAY} - last_order_date <= 30 THEN 5 WHEN {_TODAY} - last_order_date <= 60 THEN 4
                   WHEN {_TODAY} - last_order_date <= 90 THEN 3 WHEN {_TODAY} - last_order_date <= 180 THEN 2 ELSE 1 END AS r,
              CASE WHEN total_orders >= 20 THEN 5 WHEN total_orders >= 10 THEN 4 WHEN total_orders >= 5 THEN 3 WHEN total_orders >= 2 THEN 2 ELSE 1 END AS f,
              CASE WHEN net >= 10000 THEN 5 WHEN net >= 5000 THEN 4 WHEN net >= 2000 THEN 3 WHEN net >= 500 THEN 2 ELSE 1 END AS m FROM s)
        SELECT customer_key, first_order_date, last_order_date,
          CASE WHEN first_order_date IS NOT NULL THEN ({_TODAY} - first_order_date)::INTEGER ELSE 0 END AS customer_tenure_days, total_orders,
          items::DOUBLE AS total_items_purchased, gross::DOUBLE AS lifetime_gross_value, net::DOUBLE AS lifetime_net_value,
          CASE WHEN total_orders > 0 THEN {half_up('(net * 100)::HUGEINT', 'total_orders')} ELSE 0 END::DOUBLE AS avg_order_value,
          CASE WHEN total_orders > 1 THEN (last_order_date - first_order_date) // (total_orders - 1) END AS avg_order_frequency_days,
          r AS rfm_recency_score, f AS rfm_frequency_score, m AS rfm_monetary_score,
          CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Loyal Customers'
               WHEN r >= 2 AND f >= 2 THEN 'Potential Loyalists' WHEN r >= 3 AND f <= 2 THEN 'New Customers' WHEN r <= 2 AND f >= 3 THEN 'At Risk'
               WHEN r <= 2 AND f <= 2 AND m >= 3 THEN 'Cannot Lose Them' WHEN r <= 2 AND f <= 2 AND m <= 2 THEN 'Lost' ELSE 'Need Attention' END AS rfm_segment,
          CASE WHEN net >= 10000 THEN 'PLATINUM' WHEN net >= 5000 THEN 'GOLD' WHEN net >= 2000 THEN 'SILVER' ELSE 'BRONZE' END AS customer_tier FROM q""",
)
def _lifetime(t):
    return gold.agg_customer_lifetime(t("silver_customer"), t("silver_orders"), t("silver_order_item"), AS_OF)


@query(
    "agg_monthly_product_sales",
    f"""WITH m AS (SELECT YEAR(o.order_date)::INTEGER AS year_number, MONTH(o.order_date)::INTEGER AS month_number, COALESCE(p.category_name, 'Unknown') AS category_name,
            SUM(i.quantity) AS q, COUNT(DISTINCT o.order_id) AS total_orders, SUM(i.line_total) AS gross, SUM(i.net_amount) AS net
          FROM silver_orders o JOIN silver_order_item i ON i.order_key = o.order_key JOIN silver_product p ON p.product_key = i.product_key
          WHERE p.is_valid GROUP BY ALL)
        SELECT year_number, month_number, category_name, q::DOUBLE AS total_quantity_sold, total_orders, gross::DOUBLE AS gross_revenue,
          net::DOUBLE AS net_revenue, CASE WHEN q > 0 THEN {half_up('(gross * 100)::HUGEINT', 'q::BIGINT')} ELSE 0 END::DOUBLE AS avg_unit_price,
          (ROW_NUMBER() OVER (PARTITION BY year_number, month_number ORDER BY net DESC, category_name))::INTEGER AS category_rank FROM m""",
)
def _monthly(t):
    return gold.agg_monthly_product_sales(t("silver_orders"), t("silver_order_item"), t("silver_product"))


sql_table(
    "expected_reps",
    """WITH m AS (SELECT o.sales_rep_key AS employee_key, YEAR(o.order_date)::INTEGER AS year_number, MONTH(o.order_date)::INTEGER AS month_number,
            COUNT(DISTINCT o.order_id) AS total_orders, COUNT(DISTINCT o.customer_key) AS total_customers_served,
            COUNT(DISTINCT CASE WHEN o.order_date = f.first_date THEN o.customer_key END) AS new_customers_acquired,
            COALESCE(SUM(i.line_total), 0) AS gross, COALESCE(SUM(i.net_amount), 0) AS net
          FROM silver_orders o LEFT JOIN silver_order_item i ON i.order_key = o.order_key
          JOIN (SELECT customer_key, MIN(order_date) AS first_date FROM silver_orders GROUP BY customer_key) f ON f.customer_key = o.customer_key
          WHERE o.is_valid AND o.sales_rep_key IS NOT NULL GROUP BY ALL)
       SELECT m.employee_key, year_number, month_number, total_orders, total_customers_served, new_customers_acquired, gross::DOUBLE AS gross_sales,
         net::DOUBLE AS net_sales, ROUND(COALESCE(net::DECIMAL(18,2) * e.commission_percent * 0.01, 0), 2)::DOUBLE AS total_commission,
         (ROW_NUMBER() OVER (PARTITION BY year_number, month_number ORDER BY net DESC, m.employee_key))::INTEGER AS sales_rank
       FROM m LEFT JOIN silver_employee e ON e.employee_key = m.employee_key""",
)


@query("agg_sales_rep_performance", "SELECT * FROM expected_reps")
def _reps(t):
    return gold.agg_sales_rep_performance(t("silver_orders"), t("silver_order_item"), t("silver_employee"))


@query(
    "rep_quota_attainment",
    """WITH q AS (SELECT sales_rep_key AS employee_key, YEAR(order_date)::INTEGER AS year_number, MONTH(order_date)::INTEGER AS month_number,
            SUM(order_total)::DOUBLE AS sales_quota FROM silver_orders WHERE order_status = 'PROCESSING' GROUP BY ALL)
       SELECT r.employee_key, r.year_number, r.month_number, r.net_sales, q.sales_quota,
              CASE WHEN q.sales_quota <> 0 THEN r.net_sales / q.sales_quota * 100 END AS quota_attainment_pct
       FROM expected_reps r LEFT JOIN q USING (employee_key, year_number, month_number)""",
)
def _quota(t):
    quotas = (
        t("silver_orders")
        .where("order_status = 'PROCESSING'")
        .groupBy(
            F.col("sales_rep_key").alias("employee_key"),
            F.year("order_date").alias("year_number"),
            F.month("order_date").alias("month_number"),
        )
        .agg(F.sum("order_total").alias("sales_quota"))
    )
    reps = gold.agg_sales_rep_performance(t("silver_orders"), t("silver_order_item"), t("silver_employee"))
    return gold.rep_quota_attainment(reps, quotas)
