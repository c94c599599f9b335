"""Warehouse input tables derived from the TPC-H-like test tables.

Each entry is SQL text that Spark and DuckDB read alike, so the same inputs feed a Spark
operator and the SQL it is checked against. ``{name}`` refers to a raw table or to
another entry. Natural keys are shifted by one because 0 means "missing" in the rules.
Bronze entries carry several versions of some keys, blank and NULL values and foreign
keys that resolve to nothing; silver entries are clean with surrogate key = natural key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _versions(body: str, table: str, key: str) -> str:
    """Current, older and undated versions of a row; ``$v`` marks text that differs."""
    parts = []
    for mark, when, stamp in (
        ("", None, "TIMESTAMP '2024-01-02 00:00:00'"),
        (" (old)", f"{key} % 3 = 0", "TIMESTAMP '2024-01-01 00:00:00'"),
        (" (undated)", f"{key} % 4 = 1", "CAST(NULL AS TIMESTAMP)"),
    ):
        where = f" WHERE {when}" if when else ""
        parts.append(f"SELECT {body.replace('$v', mark)}, {stamp} AS _load_timestamp FROM {{{table}}}{where}")
    return "\nUNION ALL\n".join(parts)


_NAMES = {
    # bronze ------------------------------------------------------------------------
    "bronze_country": _versions(
        """CAST(n_nationkey + 1 AS INT) AS country_id,
        CASE WHEN n_nationkey % 7 = 3 THEN '' ELSE CONCAT(n_name, '$v') END AS country_name,
        CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS country_code,
        CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(1000 + n_nationkey AS INT) END AS nat_lang_code,
        CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'EUR' END AS currency_code""",
        "nation",
        "n_nationkey",
    ),
    "bronze_location": _versions(
        """CAST(s_suppkey + 1 AS INT) AS location_id,
        CASE WHEN s_suppkey % 11 = 0 THEN 999 ELSE CAST(s_nationkey + 1 AS INT) END AS country_id,
        CASE WHEN s_suppkey % 4 = 0 THEN '  ' ELSE CONCAT(' ', s_name, ' street$v') END AS address_line_1,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Floor 2' END AS address_line_2,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CONCAT('City ', CAST(s_nationkey AS STRING)) END AS city,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CONCAT('State ', CAST(s_nationkey % 7 AS STRING)) END AS state,
        CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'North' END AS district,
        CASE WHEN s_suppkey % 8 = 0 THEN ' ' ELSE CAST(10000 + s_suppkey AS STRING) END AS postal_code,
        CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 4 AS INT) END AS location_type_code,
        CASE WHEN s_suppkey % 2 = 1 THEN '' ELSE 'Depot' END AS description,
        CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'Ring twice' END AS shipping_notes""",
        "supplier",
        "s_suppkey",
    ),
    "bronze_warehouse": _versions(
        """CAST(n_nationkey + 1 AS INT) AS warehouse_id,
        CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE CAST(n_nationkey * 5 + 1 AS INT) END AS location_id,
        CASE WHEN n_nationkey % 3 = 0 THEN '  ' ELSE CONCAT(n_name, ' hub$v') END AS warehouse_name""",
        "nation",
        "n_nationkey",
    ),
    "bronze_product": _versions(
        """CAST(p_partkey + 1 AS INT) AS product_id,
        CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CONCAT(p_name, '$v') END AS product_name,
        CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_type END AS description,
        CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(SUBSTR(p_brand, 7, 4) AS INT) END AS category,
        CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size % 7 AS INT) END AS weight_class,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS warranty_period,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 10 + 1 AS INT) END AS supplier_id,
        CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN ' active '
             ELSE 'DISCONTINUED-BY-SUPPLIER' END AS status,
        CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS list_price,
        CAST(FLOOR(p_retailprice * 80) / 100 AS DECIMAL(12,2)) AS minimum_price,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'EURO' END AS price_currency,
        CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CONCAT('https://shop.example/', CAST(p_partkey AS STRING))
             END AS catalog_url""",
        "part",
        "p_partkey",
    ),
    "bronze_inventory": _versions(
        """CAST(p_partkey + 1 AS INT) AS inventory_id,
        CASE WHEN p_partkey % 29 = 0 THEN 2000000000 ELSE CAST(p_partkey + 1 AS INT) END AS product_id,
        CAST(p_partkey % 30 + 1 AS INT) AS warehouse_id,
        CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE CAST(p_size * 3 AS INT) END AS quantity_on_hand,
        CAST(p_size * 3 - p_partkey % 20 AS INT) AS quantity_available""",
        "part",
        "p_partkey",
    ),
    "bronze_person": _versions(
        """CAST(c_custkey * 2 + 1 AS INT) AS person_id,
        CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE CONCAT('First', CAST(c_custkey AS STRING), '$v') END AS first_name,
        CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE ' Last ' END AS last_name,
        CASE WHEN c_custkey % 3 = 0 THEN 'Mid' ELSE '' END AS middle_names,
        CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE NULL END AS nickname,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS INT) END AS nat_lang_code,
        CAST(NULL AS INT) AS culture_code,
        CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN ' F ' ELSE 'M' END AS gender""",
        "customer",
        "c_custkey",
    )
    + "\nUNION ALL\n"
    + _versions(
        """CAST(s_suppkey * 2 + 2 AS INT) AS person_id, CONCAT('Rep', CAST(s_suppkey AS STRING), '$v') AS first_name,
        s_name AS last_name, CAST(NULL AS STRING) AS middle_names, CAST(NULL AS STRING) AS nickname,
        CAST(s_nationkey AS INT) AS nat_lang_code, CAST(1040 AS INT) AS culture_code,
        CAST(NULL AS STRING) AS gender""",
        "supplier",
        "s_suppkey",
    ),
    "bronze_restricted_info": _versions(
        """CAST(s_suppkey * 2 + 2 AS INT) AS person_id,
        CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE DATE '1960-01-01' + CAST(s_suppkey % 9000 AS INT) END AS date_of_birth,
        CASE WHEN s_suppkey % 20 = 3 THEN DATE '1999-05-05' ELSE CAST(NULL AS DATE) END AS date_of_death,
        CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE CONCAT('GOV', CAST(s_suppkey AS STRING), '$v') END AS government_id,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CONCAT('PASS', CAST(s_suppkey AS STRING)) END AS passport_id,
        CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE DATE '1990-01-01' + CAST(s_suppkey % 3000 AS INT) END AS hire_date,
        CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(s_suppkey % 8 AS INT) END AS seniority_code""",
        "supplier",
        "s_suppkey",
    ),
    "bronze_person_location": _versions(
        """CASE WHEN c_custkey % 31 = 0 THEN 2000000001 ELSE CAST(c_custkey * 2 + 1 AS INT) END AS persons_person_id,
        CAST(c_custkey % 110 + 1 AS INT) AS locations_location_id,
        CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE CONCAT('Unit ', CAST(c_custkey % 9 AS STRING), '$v') END AS sub_address,
        CASE WHEN c_custkey % 6 = 0 THEN 'Home address' WHEN c_custkey % 6 = 1 THEN 'office'
             WHEN c_custkey % 6 = 2 THEN 'Ship to' WHEN c_custkey % 6 = 3 THEN 'bill payer'
             WHEN c_custkey % 6 = 4 THEN NULL ELSE 'summer' END AS location_usage,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'leave at door' END AS notes""",
        "customer",
        "c_custkey",
    ),
    "bronze_phone_number": _versions(
        """CAST(c_custkey + 1 AS INT) AS phone_number_id,
        CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE CAST(c_custkey * 2 + 1 AS INT) END AS persons_person_id,
        CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_custkey % 110 + 1 AS INT) END AS locations_location_id,
        CASE WHEN c_custkey % 14 = 0 THEN '' ELSE CONCAT(' 555-', CAST(c_custkey AS STRING), '$v') END AS phone_number,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '+44' END AS country_code,
        CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST(c_custkey % 8 AS INT) END AS phone_type_id""",
        "customer",
        "c_custkey",
    ),
    "bronze_customer_company": _versions(
        """CAST(s_suppkey + 1 AS INT) AS company_id,
        CASE WHEN s_suppkey % 12 = 0 THEN '' ELSE CONCAT(s_name, ' Ltd$v') END AS company_name,
        CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(FLOOR(s_acctbal * 150) AS DECIMAL(15,2)) END AS company_credit_limit,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'EURO' END AS credit_limit_currency""",
        "supplier",
        "s_suppkey",
    ),
    "bronze_customer_employee": _versions(
        """CAST(c_custkey + 1 AS INT) AS customer_employee_id, CAST(c_custkey % 120 + 1 AS INT) AS company_id,
        CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE CONCAT('B', CAST(c_custkey AS STRING), '$v') END AS badge_number,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Buyer' END AS job_title,
        CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS department,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS credit_limit,
        CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'USDX' END AS credit_limit_currency""",
        "customer",
        "c_custkey",
    ),
    "bronze_employment_jobs": _versions(
        """CAST(n_nationkey + 1 AS INT) AS hr_job_id,
        CASE WHEN n_nationkey % 8 = 0 THEN 777 ELSE CAST(n_nationkey + 1 AS INT) END AS countries_country_id,
        CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE CONCAT('Job ', n_name, '$v') END AS job_title,
        CAST(20000 + n_nationkey * 101 AS DECIMAL(12,2)) AS min_salary,
        CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE CAST(40000 + n_nationkey * 202 AS DECIMAL(12,2)) END AS max_salary""",
        "nation",
        "n_nationkey",
    ),
    "bronze_employment": _versions(
        """CAST(s_suppkey + 1 AS INT) AS employee_id,
        CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE CAST(s_suppkey * 2 + 2 AS INT) END AS person_id,
        CAST(s_suppkey % 30 + 1 AS INT) AS hr_job_id,
        CAST(FLOOR(s_suppkey / 10) AS INT) AS manager_employee_id,
        CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey % 2000 AS INT) END AS start_date,
        CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-06-30' ELSE CAST(NULL AS DATE) END AS end_date,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_acctbal AS DECIMAL(12,2)) END AS salary,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey % 10 + 0.5 AS DECIMAL(5,2)) END AS commission_percent,
        CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'on_leave$v' END AS employment_status""",
        "supplier",
        "s_suppkey",
    ),
    "bronze_customer": _versions(
        """CAST(c_custkey + 1 AS INT) AS customer_id,
        CASE WHEN c_custkey % 17 = 3 THEN NULL WHEN c_custkey % 19 = 4 THEN 2000000002
             ELSE CAST(c_custkey * 2 + 1 AS INT) END AS person_id,
        CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey + 1 AS INT)
             WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE NULL END AS customer_employee_id,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 12 AS INT) END AS accountmgr_id,
        CASE WHEN c_custkey % 18 = 0 THEN NULL ELSE CAST(FLOOR((c_acctbal + 1000) / 1000) AS INT) END AS income_level""",
        "customer",
        "c_custkey",
    ),
    "bronze_orders": _versions(
        """CAST(o_orderkey + 1 AS BIGINT) AS order_id, CAST(o_custkey + 1 AS INT) AS customer_id,
        CAST(o_orderkey % 97 AS INT) AS sales_rep_id,
        CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
        CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE CONCAT('SO', CAST(o_orderkey AS STRING), '$v') END AS order_code,
        CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'canceled'
             WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'on hold'
             WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderstatus = 'F' THEN 'Completed'
             WHEN o_orderkey % 2 = 0 THEN '' ELSE 'shipped' END AS order_status,
        CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS order_total,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'EURO' END AS order_currency,
        CASE WHEN o_orderpriority = '1-URGENT' THEN ' URGENT10 ' WHEN o_orderpriority = '2-HIGH' THEN '   '
             ELSE NULL END AS promotion_code""",
        "orders",
        "o_orderkey",
    ),
    "bronze_order_item": """
        SELECT CAST((l_orderkey + 1) * 8 + l_linenumber AS BIGINT) AS order_item_id,
               CASE WHEN l_orderkey % 203 = 0 THEN NULL ELSE CAST(l_orderkey + 1 AS BIGINT) END AS order_id,
               CAST(l_partkey + 1 AS INT) AS product_id,
               CASE WHEN l_discount > 0.09 THEN CAST(-5.25 AS DECIMAL(12,2))
                    ELSE CAST(FLOOR(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(12,2)) END AS unit_price,
               CASE WHEN l_tax > 0.075 THEN NULL ELSE CAST(l_quantity AS DECIMAL(10,2)) END AS quantity,
               l_shipdate AS _load_timestamp
        FROM {lineitem}""",
    # silver ------------------------------------------------------------------------
    "silver_country": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS country_key, CAST(n_nationkey + 1 AS INT) AS country_id,
               n_name AS country_name, SUBSTR(n_name, 1, 3) AS country_code, 'USD' AS currency_code,
               n_nationkey % 50 <> 49 AS is_valid
        FROM {nation}""",
    "silver_location": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS location_key, CAST(s_suppkey + 1 AS INT) AS location_id,
               CASE WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(s_nationkey + 1 AS BIGINT) END AS country_key,
               CONCAT(s_name, ' street') AS address_line_1,
               CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE CONCAT('City ', CAST(s_nationkey AS STRING)) END AS city,
               CONCAT('State ', CAST(s_nationkey % 7 AS STRING)) AS state_province, CAST(NULL AS STRING) AS district,
               CAST(10000 + s_suppkey AS STRING) AS postal_code,
               CONCAT('TYPE_', CAST(s_suppkey % 4 AS STRING)) AS location_type, s_suppkey % 50 <> 7 AS is_valid
        FROM {supplier}""",
    "silver_warehouse": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS warehouse_key, CAST(n_nationkey + 1 AS INT) AS warehouse_id,
               CASE WHEN n_nationkey % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(n_nationkey * 5 + 1 AS BIGINT) END AS location_key,
               CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE CONCAT(n_name, ' hub') END AS warehouse_name,
               TRUE AS is_valid
        FROM {nation}""",
    "silver_product": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS product_key, CAST(p_partkey + 1 AS INT) AS product_id,
               CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_name END AS product_name, p_type AS description,
               CAST(SUBSTR(p_brand, 7, 4) AS INT) AS category_id, p_brand AS category_name,
               CAST(p_size % 5 + 1 AS INT) AS weight_class, 'Standard' AS weight_class_description,
               CAST(p_size AS INT) AS warranty_period_months, CAST(p_partkey % 10 + 1 AS INT) AS supplier_id,
               CASE WHEN p_partkey % 5 = 1 THEN ' Active ' ELSE 'RETIRED' END AS product_status,
               CAST(p_retailprice AS DECIMAL(12,2)) AS list_price,
               CAST(FLOOR(p_retailprice * 80) / 100 AS DECIMAL(12,2)) AS minimum_price, 'USD' AS price_currency,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) - CAST(FLOOR(p_retailprice * 80) / 100 AS DECIMAL(12,2))
                    AS DECIMAL(12,2)) AS profit_margin,
               CAST(20.00 AS DECIMAL(5,2)) AS profit_margin_pct, p_partkey % 50 <> 7 AS is_valid
        FROM {part}""",
    "silver_inventory": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS inventory_key, CAST(p_partkey + 1 AS INT) AS inventory_id,
               CAST(p_partkey + 1 AS BIGINT) AS product_key, CAST(p_partkey % 25 + 1 AS BIGINT) AS warehouse_key,
               CAST(p_size * 3 AS INT) AS quantity_on_hand, CAST(p_size * 3 - p_partkey % 20 AS INT) AS quantity_available,
               CAST(p_partkey % 20 AS INT) AS quantity_reserved, p_partkey % 50 <> 11 AS is_valid
        FROM {part}""",
    "silver_person": """
        SELECT CAST(c_custkey * 2 + 1 AS BIGINT) AS person_key, CAST(c_custkey * 2 + 1 AS INT) AS person_id,
               CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE CONCAT('First', CAST(c_custkey AS STRING)) END AS first_name,
               'Last' AS last_name,
               CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS full_name,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'F' END AS gender
        FROM {customer}
        UNION ALL
        SELECT CAST(s_suppkey * 2 + 2 AS BIGINT), CAST(s_suppkey * 2 + 2 AS INT), 'Rep', s_name, s_name, 'M'
        FROM {supplier}""",
    "silver_restricted_info": """
        SELECT CAST(s_suppkey * 2 + 2 AS BIGINT) AS person_key, DATE '1994-03-01' + CAST(s_suppkey % 900 AS INT) AS hire_date
        FROM {supplier} WHERE s_acctbal > 0""",
    "silver_person_location": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS person_location_key, CAST(c_custkey * 2 + 1 AS BIGINT) AS person_key,
               CAST(c_custkey % 10 + 1 AS BIGINT) AS location_key, c_custkey % 6 = 0 AS is_primary
        FROM {customer} WHERE c_acctbal >= 0
        UNION ALL
        SELECT CAST(1000000000 + c_custkey AS BIGINT), CAST(c_custkey * 2 + 1 AS BIGINT),
               CAST(c_custkey % 9 + 1 AS BIGINT), c_custkey % 12 = 3
        FROM {customer}""",
    "silver_customer_company": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS company_key, CAST(s_suppkey + 1 AS INT) AS company_id,
               CONCAT(s_name, ' Ltd') AS company_name, CAST(FLOOR(s_acctbal * 150) AS DECIMAL(15,2)) AS credit_limit
        FROM {supplier}""",
    "silver_customer_employee": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS customer_employee_key, CAST(c_custkey + 1 AS INT) AS customer_employee_id,
               CAST(c_custkey % 120 + 1 AS BIGINT) AS company_key
        FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    "silver_customer": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS customer_key, CAST(c_custkey + 1 AS INT) AS customer_id,
               CAST(c_custkey * 2 + 1 AS BIGINT) AS person_key,
               CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey + 1 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS customer_employee_key,
               CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS INT) ELSE CAST(c_custkey % 12 AS INT) END AS account_manager_id,
               CAST(FLOOR((c_acctbal + 1000) / 1000) AS INT) AS income_level,
               CASE WHEN c_acctbal >= 7000 THEN 'PREMIUM' WHEN c_acctbal >= 4000 THEN 'HIGH'
                    WHEN c_acctbal >= 2000 THEN 'MEDIUM' ELSE 'LOW' END AS income_bracket,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'CORPORATE' ELSE 'INDIVIDUAL' END AS customer_type,
               CASE WHEN c_custkey % 10 = 0 THEN CAST(NULL AS DATE) ELSE DATE '1996-01-01' END AS customer_since,
               c_custkey % 50 <> 7 AS is_valid
        FROM {customer}""",
    "silver_employment_jobs": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS job_key, CAST(n_nationkey + 1 AS INT) AS hr_job_id,
               CONCAT('Job ', n_name) AS job_title
        FROM {nation}""",
    "silver_employee": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS employee_key, CAST(s_suppkey + 1 AS INT) AS employee_id,
               CAST(s_suppkey * 2 + 2 AS BIGINT) AS person_key,
               CASE WHEN s_suppkey % 30 < 25 THEN CAST(s_suppkey % 30 + 1 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS job_key,
               CASE WHEN s_suppkey < 10 THEN CAST(NULL AS BIGINT) ELSE CAST(FLOOR(s_suppkey / 10) AS BIGINT) END AS manager_employee_key,
               DATE '1995-01-01' + CAST(s_suppkey % 2000 AS INT) AS start_date,
               CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-06-30' ELSE CAST(NULL AS DATE) END AS end_date,
               CAST(6 AS INT) AS tenure_years, s_suppkey % 5 <> 0 AS is_active, 'ACTIVE' AS employment_status,
               CAST(s_acctbal AS DECIMAL(12,2)) AS salary,
               CASE WHEN s_suppkey % 6 = 0 THEN CAST(NULL AS DECIMAL(5,2)) ELSE CAST(s_suppkey % 10 + 0.5 AS DECIMAL(5,2)) END AS commission_percent,
               s_suppkey % 50 <> 7 AS is_valid
        FROM {supplier}""",
    "silver_orders": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS order_key, CAST(o_orderkey + 1 AS BIGINT) AS order_id,
               CAST(o_custkey + 1 AS BIGINT) AS customer_key,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(o_orderkey % 97 AS BIGINT) END AS sales_rep_key,
               CAST(o_orderdate AS DATE) AS order_date,
               CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE CONCAT('SO', CAST(o_orderkey AS STRING)) END AS order_code,
               CASE WHEN o_orderstatus = 'O' THEN 'PROCESSING' WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'PENDING' END AS order_status,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'PROCESSING' END AS order_status_category,
               CAST(o_totalprice AS DECIMAL(15,2)) AS order_total, 'USD' AS order_currency,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT10' WHEN o_orderpriority = '2-HIGH' THEN 'HIGH5'
                    ELSE '' END AS promotion_code,
               o_orderkey % 50 <> 7 AS is_valid
        FROM {orders}""",
    "silver_order_item": """
        SELECT order_item_id, order_key, product_key, unit_price, quantity, line_total, discount_amount,
               CAST(line_total - discount_amount AS DECIMAL(15,2)) AS net_amount, is_valid
        FROM (
            SELECT CAST(((l_orderkey + 1) * 8 + l_linenumber) * 1000000000 + l_partkey * 50
                        + CAST(l_quantity AS BIGINT) - 1 AS BIGINT) AS order_item_id,
                   CAST(l_orderkey + 1 AS BIGINT) AS order_key, CAST(l_partkey + 1 AS BIGINT) AS product_key,
                   CAST(FLOOR(l_extendedprice / l_quantity * 100) / 100 AS DECIMAL(12,2)) AS unit_price,
                   CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
                   CAST(l_extendedprice AS DECIMAL(15,2)) AS line_total,
                   CAST(FLOOR(l_extendedprice * l_discount * 100) / 100 AS DECIMAL(12,2)) AS discount_amount,
                   l_linenumber <> 7 AS is_valid
            FROM {lineitem}
        ) x""",
    # gold, as a report finds it stored ---------------------------------------------------
    "gold_dim_promotion": """
        SELECT DISTINCT promotion_code,
               CAST(CASE promotion_code WHEN '' THEN 1 WHEN 'HIGH5' THEN 2 ELSE 3 END AS BIGINT) AS promotion_key
        FROM {silver_orders}""",
    "gold_dim_product": """
        SELECT product_key, product_id, CASE WHEN product_id % 40 = 0 THEN CAST(NULL AS STRING) ELSE CONCAT(product_name, ' ', CAST(category_id AS STRING)) END AS product_name,
               category_name, list_price
        FROM {silver_product} WHERE is_valid""",
    "gold_dim_customer": """
        SELECT customer_key, customer_id, income_bracket, customer_type,
               CONCAT('State ', CAST(customer_id % 7 AS STRING)) AS state_province
        FROM {silver_customer} WHERE is_valid""",
    "gold_dim_date": """
        SELECT DISTINCT CAST(YEAR(order_date) * 10000 + MONTH(order_date) * 100 + DAY(order_date) AS INT) AS date_key,
               order_date AS full_date
        FROM {silver_orders}""",
    "gold_fact_sales": """
        SELECT CAST(YEAR(o.order_date) * 10000 + MONTH(o.order_date) * 100 + DAY(o.order_date) AS INT) AS order_date_key,
               o.customer_key, i.product_key, o.sales_rep_key AS employee_key, o.order_id, i.order_item_id, i.quantity,
               i.unit_price, i.line_total AS gross_amount, i.net_amount, o.order_status
        FROM {silver_orders} o JOIN {silver_order_item} i ON o.order_key = i.order_key
        WHERE o.is_valid AND i.is_valid""",
    "gold_fact_orders": """
        SELECT o.order_id, o.customer_key, o.order_status,
               CAST(YEAR(o.order_date) * 10000 + MONTH(o.order_date) * 100 + DAY(o.order_date) AS INT) AS order_date_key,
               s.net_amount
        FROM {silver_orders} o
        JOIN (SELECT order_key, CAST(SUM(net_amount) AS DECIMAL(18,2)) AS net_amount FROM {silver_order_item}
              WHERE is_valid GROUP BY order_key) s ON o.order_key = s.order_key
        WHERE o.is_valid""",
    "gold_inventory_snapshots": """
        SELECT CAST(20010731 AS INT) AS snapshot_date_key, product_key, warehouse_key,
               CAST(CASE WHEN product_key % 3 = 0 THEN quantity_on_hand + 5 ELSE quantity_on_hand END AS INT) AS quantity_on_hand,
               quantity_available, quantity_reserved, CAST(1 AS INT) AS days_of_supply, 'IN_STOCK' AS stock_status,
               CAST(0 AS DECIMAL(18,2)) AS inventory_value
        FROM {silver_inventory}
        UNION ALL
        SELECT CAST(20010801 AS INT), product_key, warehouse_key, CAST(1 AS INT), CAST(1 AS INT), CAST(0 AS INT), CAST(1 AS INT), 'LOW_STOCK', CAST(7 AS DECIMAL(18,2))
        FROM {silver_inventory} WHERE quantity_on_hand > 120
        UNION ALL
        SELECT CAST(20010801 AS INT), product_key + 900000000, warehouse_key, CAST(1 AS INT), CAST(1 AS INT), CAST(0 AS INT), CAST(1 AS INT), 'LOW_STOCK', CAST(7 AS DECIMAL(18,2))
        FROM {silver_inventory} WHERE quantity_on_hand > 140""",
    # clickstream, sessions, reviews, stock movements ----------------------------------
    "clickstream": """
        SELECT event_id, CONCAT(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
               CAST(user_id AS STRING) AS user_id,
               CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart'
                    WHEN 'signup' THEN 'checkout' WHEN 'purchase' THEN 'purchase' ELSE 'error' END AS event_type,
               CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'view' THEN
                    CONCAT('https://shop.example/product/', SUBSTR(props, 7, LENGTH(props) - 7), '?ref=mail')
                    WHEN event_type = 'click' THEN 'https://shop.example/cart'
                    WHEN event_type = 'signup' THEN 'https://shop.example/checkout/pay'
                    ELSE 'https://shop.example/' END AS page_url,
               CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'https://www.google.com/search?q=ring'
                    WHEN event_id % 4 = 2 THEN 'https://www.facebook.com/' ELSE 'https://shop.example/' END AS referrer,
               CASE WHEN event_id % 13 = 0 THEN 'not json' ELSE CONCAT('{{"device_type": "',
                    CASE WHEN user_id % 3 = 0 THEN 'mobile' ELSE 'desktop' END, '", "browser": "b',
                    CAST(user_id % 5 AS STRING), '", "os": "os', CAST(user_id % 4 AS STRING), '"}}') END AS device_info,
               ts AS event_timestamp,
               CAST(value AS DECIMAL(12,2)) AS value
        FROM {events}""",
    "web_sessions": """
        SELECT CONCAT(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
               CAST(user_id AS STRING) AS user_id, CAST(CAST(ts AS DATE) AS DATE) AS session_date,
               CASE WHEN user_id % 3 = 0 THEN 'email' WHEN user_id % 3 = 1 THEN 'search' ELSE 'direct' END AS channel,
               MIN(ts) AS start_time, MAX(ts) AS end_time, COUNT(*) AS page_count
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "raw_reviews": """
        SELECT CONCAT('r', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING),
                      '-', CAST(CAST(l_quantity AS INT) AS STRING)) AS review_id,
               CAST(l_partkey + 1 AS BIGINT) AS product_key, CAST(o_custkey + 1 AS BIGINT) AS customer_key,
               CAST(l_quantity AS INT) % 7 AS rating,
               CASE WHEN CAST(l_quantity AS INT) % 7 >= 4 THEN 'Great product, love it' WHEN CAST(l_quantity AS INT) % 7 = 3
                    THEN ' ' ELSE 'Bad and broken, poor value' END AS review_text,
               CAST(l_shipdate AS DATE) AS review_date, l_linestatus = 'F' AS verified_purchase
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "stock_movements": """
        SELECT CAST(l_partkey + 1 AS BIGINT) AS product_key, CAST(l_suppkey % 5 + 1 AS BIGINT) AS warehouse_key,
               CAST(l_quantity AS INT) AS quantity,
               CASE WHEN l_returnflag = 'R' THEN 'OUT' WHEN l_returnflag = 'A' THEN 'IN'
                    WHEN l_linenumber <= 3 THEN 'ADJUSTMENT' ELSE 'TRANSFER' END AS movement_type,
               CAST(l_shipdate AS DATE) AS movement_date
        FROM {lineitem}""",
    # query logs, counters, runs ---------------------------------------------------------
    "query_logs": """
        SELECT CAST(event_id + 1 AS BIGINT) AS log_id,
               CONCAT('q_', event_type, '_', CAST(user_id % 20 AS STRING)) AS query_hash,
               CASE event_type
                 WHEN 'click' THEN CONCAT('SELECT c.customer_id, c.income_level FROM silver.customer c WHERE c.customer_id = ', CAST(user_id AS STRING))
                 WHEN 'view' THEN CONCAT('SELECT p.category_name, SUM(oi.quantity) FROM silver.order_item oi JOIN silver.product p ON oi.product_key = p.product_key WHERE silver.orders.order_date BETWEEN ''2024-01-01'' AND ''2024-02-01'' AND p.category_name <> ''x'' GROUP BY p.category_name, p.product_id ORDER BY 2 DESC LIMIT ', CAST(user_id % 50 AS STRING))
                 WHEN 'purchase' THEN CONCAT('INSERT INTO gold.fact_sales SELECT * FROM silver.orders WHERE order_id = ', CAST(user_id AS STRING), ' OR order_date > 20240101')
                 WHEN 'signup' THEN CONCAT('WITH recent AS (SELECT * FROM gold.fact_orders AS fo WHERE fo.order_date_key > ', CAST(user_id AS STRING), ') SELECT customer_key, ROW_NUMBER() OVER (PARTITION BY customer_key ORDER BY order_id, net_amount) FROM recent')
                 ELSE CONCAT('  update bronze.orders  set order_status = ''late''  where updated_at = ', CAST(user_id AS STRING)) END AS query_text,
               CASE WHEN event_id % 10 = 0 THEN ' ' ELSE CONCAT('template ', event_type) END AS query_template,
               CAST(SUBSTR(props, 7, LENGTH(props) - 7) AS BIGINT) AS calls,
               CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS DECIMAL(15,3)) ELSE
                 CAST(CAST(value * 20 AS DECIMAL(12,3)) * CAST(SUBSTR(props, 7, LENGTH(props) - 7) AS INT) AS DECIMAL(15,3)) END AS total_exec_time_ms,
               CAST(value * 20 AS DECIMAL(15,3)) AS mean_exec_time_ms, CAST(value * 35 AS DECIMAL(15,3)) AS max_exec_time_ms,
               CAST(event_id % 1000 AS BIGINT) AS rows_affected,
               CAST((event_id * 37) % 5000 AS BIGINT) AS shared_blks_hit,
               CASE WHEN event_id % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST((event_id * 13) % 700 AS BIGINT) END AS shared_blks_read,
               CASE WHEN event_id % 12 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 12 = 1 THEN '{{broken' ELSE
                 CONCAT('{{"query_type": "', CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'SELECT'
                        WHEN event_type = 'purchase' THEN 'INSERT' ELSE 'UPDATE' END,
                   '", "table_count": ', CAST(event_id % 4 + 1 AS STRING), ', "join_count": ', CAST(event_id % 4 AS STRING),
                   ', "has_aggregation": ', CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END,
                   ', "has_window_function": ', CASE WHEN event_type = 'signup' THEN 'true' ELSE 'false' END,
                   ', "has_subquery": ', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END,
                   ', "has_cte": ', CASE WHEN event_type = 'signup' THEN 'true' ELSE 'false' END,
                   ', "filter_predicate_count": ', CAST(event_id % 6 AS STRING), ', "group_by_count": ', CAST(event_id % 3 AS STRING),
                   ', "order_by_count": ', CAST(event_id % 2 AS STRING), '}}') END AS extracted_features,
               ts AS collected_at
        FROM {events}""",
    "counter_snapshots": """
        SELECT CAST(user_id AS BIGINT) AS queryid, CAST(event_id AS BIGINT) AS snapshot_id, ts AS seen_at,
               CAST((event_id * 3) % 5000 AS BIGINT) AS calls, CAST((event_id * 3) % 5000 * 1.5 AS DECIMAL(15,3)) AS total_exec_time_ms,
               CAST((event_id * 5) % 9000 AS BIGINT) AS rows_affected,
               CAST((event_id * 7) % 20000 AS BIGINT) AS shared_blks_hit, CAST((event_id * 2) % 3000 AS BIGINT) AS shared_blks_read,
               CAST(event_id % 400 AS BIGINT) AS shared_blks_dirtied, CAST(event_id % 300 AS BIGINT) AS shared_blks_written,
               CAST(event_id % 200 AS BIGINT) AS local_blks_hit, CAST(event_id % 150 AS BIGINT) AS local_blks_read,
               CAST(event_id % 120 AS BIGINT) AS local_blks_dirtied, CAST(event_id % 90 AS BIGINT) AS local_blks_written,
               CAST(event_id % 80 AS BIGINT) AS temp_blks_read, CAST(event_id % 60 AS BIGINT) AS temp_blks_written,
               CAST(event_id % 700 AS DECIMAL(15,3)) AS blk_read_time_ms, CAST(event_id % 500 AS DECIMAL(15,3)) AS blk_write_time_ms
        FROM {events}""",
    "etl_jobs": """
        SELECT DISTINCT CONCAT('job_', CAST(user_id % 6 AS STRING)) AS job_id,
               CONCAT('Job ', CAST(user_id % 6 AS STRING)) AS job_name,
               CASE WHEN user_id % 6 = 5 THEN 'Pipeline' WHEN user_id % 6 = 4 THEN CAST(NULL AS STRING) ELSE 'batch' END AS job_type
        FROM {events}""",
    "job_runs": """
        SELECT CONCAT('run_', CAST(event_id AS STRING)) AS run_id, CONCAT('job_', CAST(user_id % 7 AS STRING)) AS job_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
               CASE WHEN event_id % 4 = 0 THEN 'bronze' WHEN event_id % 4 = 1 THEN 'silver' WHEN event_id % 4 = 2 THEN 'gold' ELSE NULL END AS layer,
               CASE WHEN event_id % 4 = 3 THEN NULL WHEN user_id % 5 = 0 THEN 'orders' WHEN user_id % 5 = 1 THEN 'customer'
                    WHEN user_id % 5 = 2 THEN 'product' WHEN user_id % 5 = 3 THEN 'order_item' ELSE 'inventory' END AS table_name,
               CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 6 = 0 THEN 'Statement TIMEOUT reached'
                    WHEN event_id % 6 = 1 THEN 'Connection reset by peer' WHEN event_id % 6 = 2 THEN 'unique constraint failed'
                    WHEN event_id % 6 = 3 THEN 'null value in column' WHEN event_id % 6 = 4 THEN 'disk full' ELSE NULL END AS error_message,
               CAST(event_id % 101 AS INT) AS progress,
               CAST(SUBSTR(props, 7, LENGTH(props) - 7) AS BIGINT) * 10 AS records_processed,
               ts AS started_at,
               CASE WHEN event_type = 'signup' THEN NULL ELSE
                 ts + INTERVAL '1' SECOND * CAST(SUBSTR(props, 7, LENGTH(props) - 7) AS INT) END AS completed_at
        FROM {events}""",
    "table_stats": """
        SELECT layer, table_name, CAST(SUM(records_processed) * 997 AS BIGINT) AS bytes,
               CAST(SUM(records_processed) * 800 AS BIGINT) AS table_bytes,
               CAST(SUM(CASE WHEN table_name = 'inventory' AND layer = 'gold' THEN 0 ELSE records_processed END) AS BIGINT) AS row_count,
               CAST(SUM(CASE WHEN table_name = 'product' THEN progress % 3 ELSE records_processed END) AS BIGINT) AS inserts,
               CAST(SUM(progress) AS BIGINT) AS updates, CAST(SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS deletes,
               CAST(SUM(CASE WHEN table_name = 'inventory' AND layer = 'gold' THEN 0 ELSE records_processed END) AS BIGINT) AS live,
               CAST(SUM(CASE WHEN table_name = 'orders' THEN records_processed ELSE progress END) AS BIGINT) AS dead,
               CAST(SUM(records_processed * 3) AS BIGINT) AS hits,
               CAST(SUM(CASE WHEN table_name = 'customer' THEN records_processed * 4 ELSE progress END) AS BIGINT) AS reads,
               MAX(started_at) AS max_ts
        FROM {job_runs} WHERE layer IS NOT NULL AND table_name IS NOT NULL
        GROUP BY layer, table_name""",
    "apply_events": """
        SELECT CONCAT('rec_', CAST(event_id AS STRING)) AS recommendation_id,
               CASE WHEN event_id % 2 = 0 THEN 'index' ELSE 'partition' END AS recommendation_type,
               CASE WHEN event_id % 3 = 0 THEN 'silver.orders' WHEN event_id % 3 = 1 THEN 'gold.fact_sales' ELSE 'silver.customer' END AS table_name,
               CASE WHEN event_id % 3 = 0 THEN '["order_date", "order_id"]' WHEN event_id % 3 = 1 THEN 'order_date_key' ELSE NULL END AS column_names,
               CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 5 < 3 THEN 'medium' ELSE 'low' END AS priority,
               CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 4 = 1 THEN 'Pending ' WHEN event_id % 4 = 2 THEN NULL ELSE 'applied' END AS status,
               CAST(event_id % 40 AS INT) AS query_count,
               CAST(event_id % 50 / 100.0 AS DOUBLE) AS estimated_improvement, ts AS applied_at
        FROM {events}""",
    "layer_catalog": """
        SELECT layer, table_name, CAST(1 AS INT) AS position, CONCAT(table_name, '_id') AS column_name, 'int' AS type FROM {table_stats}
        UNION ALL SELECT layer, table_name, CAST(2 AS INT), 'updated_at', 'string' FROM {table_stats} WHERE layer <> 'gold'
        UNION ALL SELECT layer, table_name, CAST(3 AS INT), 'order_date', 'date' FROM {table_stats} WHERE table_name = 'orders'
        UNION ALL SELECT layer, table_name, CAST(4 AS INT), 'category_name', 'string' FROM {table_stats} WHERE table_name = 'product'""",
    "model_scores": """
        SELECT log_id, CAST(mean_exec_time_ms AS DOUBLE) * 0.9 + 3 AS predicted_ms,
               CASE WHEN mean_exec_time_ms > 8000 THEN CAST(-0.75 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END AS anomaly_score
        FROM {query_logs}""",
    "stored_recommendations": """
        SELECT recommendation_id, recommendation_type, table_name,
               CASE WHEN table_name = 'silver.orders' THEN 'order_date' WHEN table_name = 'gold.fact_sales' THEN 'order_id' ELSE 'customer_id' END AS column_name,
               CASE WHEN query_count % 3 = 0 THEN '25' WHEN query_count % 3 = 1 THEN '12.5' ELSE '40ms' END AS estimated_improvement,
               priority, status, query_count, applied_at
        FROM {apply_events}""",
    "system_metrics": """
        SELECT CASE WHEN event_type = 'click' THEN 'cpu_percent' WHEN event_type = 'view' THEN 'cache_hit_percent'
                    WHEN event_type = 'purchase' THEN 'p95_latency_ms' ELSE 'disk_percent' END AS metric,
               CONCAT('host', CAST(user_id % 3 AS STRING)) AS host, ts AS observed_at, CAST(value AS DECIMAL(12,3)) AS value
        FROM {events}""",
}

PORTABLE: dict[str, str] = dict(_NAMES)
_PLACE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def references(text: str) -> list[str]:
    """Names of the tables an entry reads."""
    return list(dict.fromkeys(_PLACE.findall(text)))


def plain_sql(name: str) -> str:
    """The entry's SQL with bare table names."""
    return PORTABLE[name].format(**{n: n for n in references(PORTABLE[name])})


class TestTables:
    """Raw tables and derived inputs of one data folder, built on first use."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in PORTABLE:
                needed = {n: self(n) for n in references(PORTABLE[name])}
                self._built[name] = self.spark.sql(PORTABLE[name], **needed)
            else:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]
