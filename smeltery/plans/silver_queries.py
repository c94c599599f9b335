"""Bronze to silver queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.functions.ordered import with_surrogate_key
from smeltery.operators import silver
from smeltery.plans.registry import query, sql_table

RUN_TS = "2001-08-02 06:00:00"
_TODAY = "DATE '2001-08-02'"
_STAMP = f"TRUE AS is_valid, TIMESTAMP '{RUN_TS}' AS valid_from, DATE '9999-12-31' AS valid_to, TIMESTAMP '{RUN_TS}' AS _etl_timestamp"
_SHORT_STAMP = f"TRUE AS is_valid, TIMESTAMP '{RUN_TS}' AS _etl_timestamp"


def _newest_sql(table: str, source: str | None = None) -> str:
    keys, payload = silver.BRONZE[table]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("_load_timestamp", *payload))
    return (
        f"SELECT {', '.join(keys + payload)} FROM {source or 'bronze_' + table} "
        f"QUALIFY ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) = 1"
    )


for _table in silver.BRONZE:
    sql_table(f"newest_{_table}", _newest_sql(_table))
sql_table(
    "newest_known_employment",
    _newest_sql("employment", "(SELECT * FROM bronze_employment WHERE person_id IN (SELECT person_id FROM silver_person))"),
)
sql_table(
    "newest_known_customer",
    _newest_sql("customer", "(SELECT * FROM bronze_customer WHERE person_id IN (SELECT person_id FROM silver_person))"),
)
sql_table(
    "newest_known_orders",
    _newest_sql("orders", "(SELECT * FROM bronze_orders WHERE customer_id IN (SELECT customer_id FROM silver_customer))"),
)
sql_table(
    "newest_known_item",
    _newest_sql(
        "order_item",
        "(SELECT * FROM bronze_order_item WHERE order_id IN (SELECT order_id FROM silver_orders) "
        "AND product_id IN (SELECT product_id FROM silver_product))",
    ),
)


def _blank(column: str, default: str) -> str:
    return f"COALESCE(NULLIF(TRIM({column}), ''), {default})"


def _empty(column: str, default: str) -> str:
    return f"COALESCE(NULLIF({column}, ''), {default})"


@query(
    "silver_country",
    f"""SELECT country_id, {_empty('country_name', "'Unknown'")} AS country_name,
        {_empty('country_code', "'XXX'")} AS country_code,
        COALESCE(nat_lang_code, 1033) AS national_language_code,
        {_empty('currency_code', "'USD'")} AS currency_code, {_STAMP} FROM newest_country""",
)
def _country(t):
    return silver.silver_country(t("bronze_country"), None, RUN_TS)


_A1, _CITY = _blank("address_line_1", "'Address pending'"), _blank("city", "'Unknown'")
_ST, _PC = _blank("state", "'NA'"), _blank("postal_code", "'00000'")


@query(
    "silver_location",
    f"""SELECT location_id, country_key, {_A1} AS address_line_1, {_blank('address_line_2', "'—'")} AS address_line_2,
        {_CITY} AS city, {_ST} AS state_province, {_blank('district', "'—'")} AS district, {_PC} AS postal_code,
        'TYPE_' || COALESCE(location_type_code, 0) AS location_type,
        {_blank('description', "'No description'")} AS description,
        {_blank('shipping_notes', "'No shipping notes'")} AS shipping_notes,
        CONCAT_WS(', ', {_A1}, NULLIF(TRIM(address_line_2), ''), {_CITY}, {_ST}, {_PC}) AS full_address, {_STAMP}
        FROM newest_location LEFT JOIN (SELECT country_id, country_key FROM silver_country) c USING (country_id)""",
)
def _location(t):
    return silver.silver_location(t("bronze_location"), None, RUN_TS, t("silver_country"))


@query(
    "silver_warehouse",
    f"""SELECT warehouse_id, location_key, COALESCE(NULLIF(TRIM(warehouse_name), ''), 'Warehouse ' || warehouse_id) AS warehouse_name,
        {_STAMP} FROM newest_warehouse LEFT JOIN (SELECT location_id, location_key FROM silver_location) l USING (location_id)""",
)
def _warehouse(t):
    return silver.silver_warehouse(t("bronze_warehouse"), None, RUN_TS, t("silver_location"))


@query(
    "silver_product",
    f"""WITH p AS (SELECT *, COALESCE(list_price, 0)::DECIMAL(12,2) AS lp, COALESCE(minimum_price, 0)::DECIMAL(12,2) AS mp FROM newest_product),
        c AS (SELECT *, (lp * 100)::BIGINT AS lc, (mp * 100)::BIGINT AS mc FROM p)
        SELECT product_id, {_empty('product_name', "'Unknown Product'")} AS product_name,
        {_blank('description', "'No description available'")} AS description, COALESCE(category, 0) AS category_id,
        COALESCE('Category_' || category, 'Uncategorized') AS category_name, COALESCE(weight_class, 1) AS weight_class,
        CASE weight_class WHEN 1 THEN 'Light' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Heavy' WHEN 4 THEN 'Very Heavy'
             WHEN 5 THEN 'Extra Heavy' ELSE 'Standard' END AS weight_class_description,
        COALESCE(warranty_period, 0) AS warranty_period_months, COALESCE(supplier_id, 0) AS supplier_id,
        TRIM({_empty('status', "'ACTIVE'")}) AS product_status, lp::DOUBLE AS list_price, mp::DOUBLE AS minimum_price,
        {_empty('price_currency', "'USD'")} AS price_currency,
        COALESCE(NULLIF(TRIM(catalog_url), ''), 'https://catalog.local/product/' || product_id) AS catalog_url,
        (lp - mp)::DOUBLE AS profit_margin,
        CASE WHEN lc > 0 THEN ((2 * (lc - mc) * 10000 + lc) // (2 * lc)) / 100.0 ELSE 0 END::DOUBLE AS profit_margin_pct, {_STAMP}
        FROM c""",
)
def _product(t):
    return silver.silver_product(t("bronze_product"), None, RUN_TS)


@query(
    "silver_inventory",
    f"""SELECT inventory_id, product_key, warehouse_key, COALESCE(quantity_on_hand, 0) AS quantity_on_hand,
        COALESCE(quantity_available, 0) AS quantity_available,
        COALESCE(quantity_on_hand, 0) - COALESCE(quantity_available, 0) AS quantity_reserved, {_TODAY} AS last_stock_date, {_SHORT_STAMP}
        FROM newest_inventory JOIN (SELECT product_id, product_key FROM silver_product) USING (product_id)
        JOIN (SELECT warehouse_id, warehouse_key FROM silver_warehouse) USING (warehouse_id)""",
)
def _inventory(t):
    return silver.silver_inventory(t("bronze_inventory"), None, RUN_TS, t("silver_product"), t("silver_warehouse"))


_FN, _LN = _blank("first_name", "'Unknown'"), _blank("last_name", "'Unknown'")
_FULL = f"CONCAT_WS(' ', {_FN}, NULLIF(TRIM(middle_names), ''), {_LN})"


@query(
    "silver_person",
    f"""SELECT person_id, {_FN} AS first_name, {_LN} AS last_name, {_blank('middle_names', "'—'")} AS middle_names,
        {_blank('nickname', "'—'")} AS nickname, {_FULL} AS full_name, {_blank('nickname', _FULL)} AS display_name,
        COALESCE(nat_lang_code, 1033) AS national_language_code, COALESCE(culture_code, 1033) AS culture_code,
        TRIM({_empty('gender', "'Unspecified'")}) AS gender, {_STAMP} FROM newest_person""",
)
def _person(t):
    return silver.silver_person(t("bronze_person"), None, RUN_TS)


@query(
    "silver_restricted_info",
    f"""SELECT person_key, date_of_birth, date_of_death,
        FLOOR((COALESCE(date_of_death, {_TODAY}) - date_of_birth) / 365.0)::INTEGER AS age, date_of_death IS NOT NULL AS is_deceased,
        CASE WHEN government_id <> '' THEN sha256(government_id) END AS government_id_hash,
        CASE WHEN passport_id <> '' THEN sha256(passport_id) END AS passport_id_hash, hire_date,
        FLOOR(({_TODAY} - hire_date) / 365.0)::INTEGER AS years_of_service, seniority_code,
        CASE WHEN COALESCE(seniority_code, 0) = 0 THEN NULL WHEN seniority_code = 1 THEN 'JUNIOR' WHEN seniority_code = 2 THEN 'MID'
             WHEN seniority_code = 3 THEN 'SENIOR' WHEN seniority_code = 4 THEN 'LEAD' WHEN seniority_code = 5 THEN 'EXECUTIVE'
             ELSE 'UNKNOWN' END AS seniority_level, {_SHORT_STAMP}
        FROM newest_restricted_info JOIN (SELECT person_id, person_key FROM silver_person) USING (person_id)""",
)
def _restricted(t):
    out = silver.silver_restricted_info(t("bronze_restricted_info"), None, RUN_TS, t("silver_person"))
    # Shown as hex text, as the SQL side prints its hashes.
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("government_id_hash", "passport_id_hash")})


_KIND = """CASE WHEN UPPER(COALESCE(location_usage, '')) LIKE '%HOME%' THEN 'HOME'
    WHEN UPPER(COALESCE(location_usage, '')) LIKE '%WORK%' OR UPPER(COALESCE(location_usage, '')) LIKE '%OFFICE%' THEN 'WORK'
    WHEN UPPER(COALESCE(location_usage, '')) LIKE '%SHIP%' THEN 'SHIPPING'
    WHEN UPPER(COALESCE(location_usage, '')) LIKE '%BILL%' THEN 'BILLING' ELSE 'OTHER' END"""


@query(
    "silver_person_location",
    f"""SELECT person_key, location_key, {_blank('sub_address', "'—'")} AS sub_address,
        {_blank('location_usage', _KIND)} AS location_usage, {_KIND} AS location_usage_type, {_blank('notes', "'—'")} AS notes,
        FALSE AS is_primary, {_STAMP}
        FROM newest_person_location JOIN silver_person ON persons_person_id = person_id
        JOIN silver_location ON locations_location_id = location_id""",
)
def _person_location(t):
    return silver.silver_person_location(
        t("bronze_person_location"), None, RUN_TS, t("silver_person"), t("silver_location")
    )


@query(
    "silver_phone_number",
    f"""SELECT phone_number_id AS phone_id, p.person_key, l.location_key,
        TRIM({_empty('phone_number', "'0000000000'")}) AS phone_number,
        TRIM({_empty('country_code', "'+1'")}) AS country_code,
        TRIM(TRIM({_empty('country_code', "'+1'")}) || ' ' || TRIM({_empty('phone_number', "'0000000000'")})) AS full_phone_number,
        CASE WHEN COALESCE(phone_type_id, 0) = 0 OR phone_type_id = 1 THEN 'MOBILE' WHEN phone_type_id = 2 THEN 'HOME'
             WHEN phone_type_id = 3 THEN 'WORK' WHEN phone_type_id = 4 THEN 'FAX' ELSE 'OTHER' END AS phone_type,
        FALSE AS is_primary, {_STAMP}
        FROM newest_phone_number n
        LEFT JOIN (SELECT person_id, person_key FROM silver_person WHERE person_id <> 0) p ON p.person_id = n.persons_person_id
        LEFT JOIN (SELECT location_id, location_key FROM silver_location WHERE location_id <> 0) l ON l.location_id = n.locations_location_id""",
)
def _phone(t):
    return silver.silver_phone_number(t("bronze_phone_number"), None, RUN_TS, t("silver_person"), t("silver_location"))


@query(
    "silver_customer_company",
    f"""SELECT company_id, {_empty('company_name', "'Unknown Company'")} AS company_name,
        COALESCE(company_credit_limit, 0)::DOUBLE AS credit_limit,
        {_empty('credit_limit_currency', "'USD'")} AS credit_limit_currency,
        CASE WHEN company_credit_limit >= 1000000 THEN 'PLATINUM' WHEN company_credit_limit >= 500000 THEN 'GOLD'
             WHEN company_credit_limit >= 100000 THEN 'SILVER' ELSE 'BRONZE' END AS credit_tier, {_STAMP}
        FROM newest_customer_company""",
)
def _company(t):
    return silver.silver_customer_company(t("bronze_customer_company"), None, RUN_TS)


@query(
    "silver_customer_employee",
    f"""SELECT customer_employee_id, company_key,
        COALESCE(NULLIF(TRIM(badge_number), ''), printf('BADGE-%06d', customer_employee_id)) AS badge_number,
        {_blank('job_title', "'Representative'")} AS job_title, {_blank('department', "'General'")} AS department,
        COALESCE(credit_limit, 0)::DOUBLE AS credit_limit,
        {_empty('credit_limit_currency', "'USD'")} AS credit_limit_currency, {_STAMP}
        FROM newest_customer_employee LEFT JOIN (SELECT company_id, company_key FROM silver_customer_company) USING (company_id)""",
)
def _customer_employee(t):
    return silver.silver_customer_employee(
        t("bronze_customer_employee"), None, RUN_TS, t("silver_customer_company")
    )


@query(
    "silver_employment_jobs",
    f"""SELECT hr_job_id, country_key, {_empty('job_title', "'Unknown Job'")} AS job_title, COALESCE(min_salary, 0)::DOUBLE AS min_salary,
        COALESCE(max_salary, 0)::DOUBLE AS max_salary, (COALESCE(max_salary, 0) - COALESCE(min_salary, 0))::DOUBLE AS salary_range,
        ROUND((COALESCE(min_salary, 0) + COALESCE(max_salary, 0)) * 0.5, 2)::DOUBLE AS mid_point_salary, {_STAMP}
        FROM newest_employment_jobs
        LEFT JOIN (SELECT country_id, country_key FROM silver_country) c ON c.country_id = countries_country_id""",
)
def _jobs(t):
    return silver.silver_employment_jobs(t("bronze_employment_jobs"), None, RUN_TS, t("silver_country"))


@query(
    "silver_employee",
    f"""SELECT e.employee_id, p.person_key, j.job_key, m.employee_key AS manager_employee_key,
        COALESCE(e.start_date, {_TODAY}) AS start_date, e.end_date,
        (COALESCE(e.end_date, {_TODAY}) - COALESCE(e.start_date, {_TODAY}))::INTEGER AS tenure_days,
        FLOOR((COALESCE(e.end_date, {_TODAY}) - COALESCE(e.start_date, {_TODAY})) / 365.0)::INTEGER AS tenure_years,
        e.end_date IS NULL OR e.end_date > {_TODAY} AS is_active, COALESCE(e.salary, 0)::DOUBLE AS salary,
        e.commission_percent::DOUBLE AS commission_percent,
        ROUND(COALESCE(e.salary, 0)::DECIMAL(12,2) * (100 + COALESCE(e.commission_percent, 0))::DECIMAL(6,2) * 0.01, 2)::DOUBLE AS total_compensation,
        UPPER(COALESCE(NULLIF(e.employment_status, ''), 'ACTIVE')) AS employment_status, {_STAMP}
        FROM newest_known_employment e JOIN silver_person p USING (person_id)
        LEFT JOIN silver_employment_jobs j ON j.hr_job_id = e.hr_job_id
        LEFT JOIN (SELECT employee_id, employee_key FROM silver_employee WHERE employee_id <> 0) m ON m.employee_id = e.manager_employee_id""",
)
def _employee(t):
    return silver.silver_employee(
        t("bronze_employment"), None, RUN_TS, t("silver_person"), t("silver_employment_jobs"), t("silver_employee")
    )


@query(
    "silver_customer",
    f"""SELECT c.customer_id, p.person_key, e.customer_employee_key, COALESCE(c.accountmgr_id, 0) AS account_manager_id,
        COALESCE(c.income_level, 0) AS income_level,
        CASE WHEN c.income_level >= 8 THEN 'PREMIUM' WHEN c.income_level >= 5 THEN 'HIGH' WHEN c.income_level >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS income_bracket,
        CASE WHEN COALESCE(c.customer_employee_id, 0) <> 0 THEN 'CORPORATE' ELSE 'INDIVIDUAL' END AS customer_type,
        {_TODAY} AS customer_since, {_STAMP}
        FROM newest_known_customer c JOIN silver_person p USING (person_id)
        LEFT JOIN (SELECT customer_employee_id, customer_employee_key FROM silver_customer_employee WHERE customer_employee_id <> 0) e
          ON e.customer_employee_id = c.customer_employee_id""",
)
def _customer(t):
    return silver.silver_customer(
        t("bronze_customer"), None, RUN_TS, t("silver_person"), t("silver_customer_employee")
    )


_STATUS = _empty("o.order_status", "'PENDING'")


@query(
    "silver_orders",
    f"""SELECT o.order_id, c.customer_key, e.employee_key AS sales_rep_key, COALESCE(o.order_date, {_TODAY}) AS order_date,
        COALESCE(NULLIF(TRIM(o.order_code), ''), printf('ORD-%010d', o.order_id)) AS order_code,
        UPPER({_STATUS}) AS order_status,
        CASE WHEN UPPER({_STATUS}) IN ('PENDING', 'PROCESSING') THEN 'PROCESSING'
             WHEN UPPER({_STATUS}) IN ('SHIPPED', 'DELIVERED', 'COMPLETED') THEN 'COMPLETED'
             WHEN UPPER({_STATUS}) IN ('CANCELLED', 'CANCELED') THEN 'CANCELLED' ELSE 'PENDING' END AS order_status_category,
        COALESCE(o.order_total, 0)::DOUBLE AS order_total, {_empty('o.order_currency', "'USD'")} AS order_currency,
        {_blank('o.promotion_code', "''")} AS promotion_code, {_blank('o.promotion_code', "''")} <> '' AS has_promotion, {_SHORT_STAMP}
        FROM newest_known_orders o JOIN (SELECT customer_id, customer_key FROM silver_customer) c USING (customer_id)
        LEFT JOIN (SELECT employee_id, employee_key FROM silver_employee WHERE employee_id <> 0) e ON e.employee_id = o.sales_rep_id""",
)
def _orders(t):
    return silver.silver_orders(t("bronze_orders"), None, RUN_TS, t("silver_customer"), t("silver_employee"))


@query(
    "silver_order_item",
    f"""WITH i AS (
          SELECT n.order_item_id, o.order_key, p.product_key, GREATEST(COALESCE(n.unit_price, 0), 0)::DECIMAL(12,2) AS price,
                 GREATEST(COALESCE(n.quantity, 0), 0)::DECIMAL(10,2) AS qty, COALESCE(TRIM(b.promotion_code), '') <> '' AS promoted
          FROM newest_known_item n JOIN silver_orders o USING (order_id) JOIN newest_orders b USING (order_id)
          JOIN silver_product p USING (product_id)),
        d AS (SELECT *, ROUND(price * qty, 2) AS total,
                 LEAST(CASE WHEN promoted THEN ROUND(price * qty * 0.10, 2) ELSE 0 END, ROUND(price * qty, 2)) AS discount FROM i)
        SELECT order_item_id, order_key, product_key, price::DOUBLE AS unit_price, qty::DOUBLE AS quantity, total::DOUBLE AS line_total,
               discount::DOUBLE AS discount_amount, ROUND(price * qty - discount, 2)::DOUBLE AS net_amount, {_SHORT_STAMP} FROM d""",
)
def _order_item(t):
    return silver.silver_order_item(
        t("bronze_order_item"), None, RUN_TS, t("bronze_orders"), t("silver_orders"), t("silver_product")
    )


_BRONZE_NAMES = {s: b for s, b, _, _ in silver.STEPS}
# Silver holds what was loaded through the end of 2000; later orders and their lines wait.
sql_table("loaded_orders", "SELECT * FROM silver_orders WHERE order_date < DATE '2001-01-01'")
sql_table("loaded_items", "SELECT * FROM silver_order_item WHERE order_key IN (SELECT order_key FROM loaded_orders)")
sql_table("loaded_phone", "SELECT customer_id AS phone_id FROM silver_customer WHERE customer_since IS NOT NULL")


def _pending_sql() -> str:
    simple = {
        "countries": ("bronze_country", "country_id", "silver_country"),
        "locations": ("bronze_location", "location_id", "silver_location"),
        "warehouses": ("bronze_warehouse", "warehouse_id", "silver_warehouse"),
        "products": ("bronze_product", "product_id", "silver_product"),
        "inventory": ("bronze_inventory", "inventory_id", "silver_inventory"),
        "persons": ("bronze_person", "person_id", "silver_person"),
        "customer_companies": ("bronze_customer_company", "company_id", "silver_customer_company"),
        "customer_employees": ("bronze_customer_employee", "customer_employee_id", "silver_customer_employee"),
        "employment_jobs": ("bronze_employment_jobs", "hr_job_id", "silver_employment_jobs"),
    }
    parts = [
        f"SELECT '{step}' AS step, COUNT(DISTINCT {key})::BIGINT AS pending FROM {source} b WHERE NOT EXISTS (SELECT 1 FROM {target} s WHERE s.{key} = b.{key})"
        for step, (source, key, target) in simple.items()
    ]
    parts += [
        "SELECT 'phone_numbers', COUNT(DISTINCT phone_number_id)::BIGINT FROM bronze_phone_number b WHERE NOT EXISTS (SELECT 1 FROM loaded_phone s WHERE s.phone_id = b.phone_number_id)",
        "SELECT 'restricted_info', COUNT(DISTINCT b.person_id)::BIGINT FROM bronze_restricted_info b JOIN silver_person p USING (person_id) WHERE p.person_key NOT IN (SELECT person_key FROM silver_restricted_info)",
        "SELECT 'person_locations', COUNT(DISTINCT (p.person_key, l.location_key))::BIGINT FROM bronze_person_location b JOIN silver_person p ON p.person_id = b.persons_person_id JOIN silver_location l ON l.location_id = b.locations_location_id WHERE NOT EXISTS (SELECT 1 FROM silver_person_location s WHERE s.person_key = p.person_key AND s.location_key = l.location_key)",
        "SELECT 'employees', COUNT(DISTINCT employee_id)::BIGINT FROM bronze_employment b WHERE person_id IN (SELECT person_id FROM silver_person) AND employee_id NOT IN (SELECT employee_id FROM silver_employee)",
        "SELECT 'customers', COUNT(DISTINCT customer_id)::BIGINT FROM bronze_customer b WHERE person_id IN (SELECT person_id FROM silver_person) AND customer_id NOT IN (SELECT customer_id FROM silver_customer)",
        "SELECT 'orders', COUNT(DISTINCT order_id)::BIGINT FROM bronze_orders b WHERE customer_id IN (SELECT customer_id FROM silver_customer) AND order_id NOT IN (SELECT order_id FROM loaded_orders)",
        "SELECT 'order_items', COUNT(DISTINCT order_item_id)::BIGINT FROM bronze_order_item b WHERE order_id IN (SELECT order_id FROM loaded_orders) AND product_id IN (SELECT product_id FROM silver_product) AND order_item_id NOT IN (SELECT order_item_id FROM loaded_items)",
    ]
    return "\nUNION ALL\n".join(parts)


@query("pending_counts", _pending_sql())
def _pending(t):
    bronze = {b: t(f"bronze_{b}") for _, b, _, _ in silver.STEPS}
    loaded = {s: t(f"silver_{s}") for _, _, s, _ in silver.STEPS if s not in ("orders", "order_item", "phone_number")}
    loaded["orders"] = t("silver_orders").where("order_date < DATE'2001-01-01'")
    loaded["order_item"] = t("silver_order_item").join(loaded["orders"], "order_key", "left_semi")
    loaded["phone_number"] = t("silver_customer").where("customer_since IS NOT NULL").selectExpr("customer_id AS phone_id")
    return silver.pending_counts(bronze, loaded)


@query(
    "silver_orders_incremental",
    f"""SELECT order_id, customer_id FROM newest_known_orders WHERE order_id NOT IN (SELECT order_id FROM loaded_orders)""",
)
def _orders_incremental(t):
    loaded = t("silver_orders").where("order_date < DATE'2001-01-01'")
    rows = silver.silver_orders(t("bronze_orders"), loaded, RUN_TS, t("silver_customer"), t("silver_employee"))
    return rows.select("order_id", rows["customer_key"].cast("int").alias("customer_id"))


@query(
    "order_total_rollup",
    """SELECT o.order_id, o.customer_id, COALESCE(s.total, o.order_total)::DOUBLE AS order_total FROM newest_orders o
       LEFT JOIN (SELECT order_id, ROUND(SUM(unit_price * quantity), 2) AS total FROM bronze_order_item GROUP BY order_id) s USING (order_id)""",
)
def _rollup(t):
    orders = silver.newest(t("bronze_orders"), "orders").select("order_id", "customer_id", "order_total")
    return silver.order_total_rollup(orders, t("bronze_order_item"))


@query(
    "dedupe_keep_first",
    """SELECT person_location_key, person_key, location_key, is_primary FROM silver_person_location
       WHERE person_location_key IN (SELECT MIN(person_location_key) FROM silver_person_location GROUP BY person_key, location_key)""",
)
def _dedupe(t):
    return silver.dedupe_keep_first(
        t("silver_person_location"), ["person_key", "location_key"], "person_location_key"
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, COUNT(*)::BIGINT AS copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
)
def _duplicates(t):
    return silver.duplicate_keys(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "surrogate_keys",
    """SELECT 1000 + ROW_NUMBER() OVER (ORDER BY o_orderkey) AS order_key, o_orderkey, o_custkey FROM orders""",
)
def _surrogate(t):
    return with_surrogate_key(t("orders").select("o_orderkey", "o_custkey"), "order_key", ["o_orderkey"], start=1000)
