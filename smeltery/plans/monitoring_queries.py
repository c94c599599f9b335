"""Storage, quality, monitoring and alert queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.operators import alerts, gold, monitoring, quality, storage
from smeltery.operators.silver import silver_customer, silver_employee
from smeltery.plans.registry import query, sql_table
from smeltery.plans.report_queries import AS_OF_TS
from smeltery.plans.silver_queries import RUN_TS

_NOW = f"TIMESTAMP '{AS_OF_TS}'"
_DAY = "2024-01-31"

# Storage ----------------------------------------------------------------------------


@query(
    "storage_utilization",
    """SELECT layer, table_name, bytes AS size_bytes, bytes - table_bytes AS extra_bytes, (SUM(bytes) OVER (PARTITION BY layer))::BIGINT AS layer_bytes,
       ROUND(bytes::DOUBLE / (SUM(bytes) OVER (PARTITION BY layer))::DOUBLE * 100, 2) AS percentage,
       ROUND(bytes::DOUBLE / (SUM(bytes) OVER ())::DOUBLE * 100, 2) AS overall_percentage FROM table_stats""",
)
def _utilization(t):
    return storage.storage_utilization(t("table_stats"))


sql_table(
    "growth",
    """WITH s AS (SELECT layer, SUM(live)::BIGINT AS current_size, SUM(inserts + updates - deletes)::BIGINT AS total_operations
          FROM (SELECT * FROM table_stats QUALIFY ROW_NUMBER() OVER (PARTITION BY layer ORDER BY live DESC, table_name) <= 10) GROUP BY layer)
       SELECT layer, current_size, total_operations, ROUND(total_operations / 30.0::DOUBLE, 2) AS daily_growth,
         ROUND(CASE WHEN current_size > 0 THEN total_operations / 30.0::DOUBLE / current_size * 100 ELSE 0 END, 4)::DOUBLE AS growth_rate_percent FROM s""",
)


@query("growth_trends", "SELECT * FROM growth")
def _growth(t):
    return storage.growth_trends(t("table_stats"), 30)


@query(
    "growth_points",
    """SELECT layer, d::DATE AS day, GREATEST(0.0::DOUBLE, current_size::DOUBLE - daily_growth * (DATE '2024-01-31' - d::DATE)) AS projected_size
       FROM growth, (SELECT UNNEST(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d)""",
)
def _points(t):
    return storage.growth_points(storage.growth_trends(t("table_stats"), 30), _DAY, 30)


@query(
    "compression_stats",
    """WITH c AS (SELECT layer, table_name, row_count, CASE WHEN row_count > 0 AND table_bytes > 0 THEN 2.5 ELSE 1 END::DOUBLE AS compression_ratio,
            CASE WHEN row_count > 0 AND table_bytes > 0 THEN 60 ELSE 0 END::DOUBLE AS compression_percentage
          FROM table_stats QUALIFY ROW_NUMBER() OVER (PARTITION BY layer ORDER BY bytes DESC, table_name) <= 10)
       SELECT *, ROUND(AVG(compression_ratio) OVER (PARTITION BY layer), 2) AS layer_average_ratio FROM c""",
)
def _compression(t):
    return storage.compression_stats(t("table_stats"))


@query(
    "cache_performance",
    """WITH x AS (SELECT layer || '.' || table_name AS table_name, hits AS cache_hits, reads AS disk_reads FROM table_stats),
       y AS (SELECT * FROM x UNION ALL SELECT 'overall', SUM(cache_hits)::BIGINT, SUM(disk_reads)::BIGINT FROM x),
       z AS (SELECT *, CASE WHEN cache_hits + disk_reads > 0 THEN cache_hits::DOUBLE / (cache_hits + disk_reads) * 100 ELSE 0 END::DOUBLE AS r FROM y)
       SELECT table_name, cache_hits, disk_reads, ROUND(r, 2) AS hit_rate,
         CASE WHEN r >= 95 THEN 'excellent' WHEN r >= 85 THEN 'good' WHEN r >= 70 THEN 'fair' ELSE 'poor' END AS status FROM z""",
)
def _cache(t):
    return storage.cache_performance(t("table_stats"))


@query(
    "cost_tracking",
    """WITH c AS (SELECT layer, ROUND(b / 1073741824, 2) AS storage_gb, ROUND(b / 1073741824 * 0.10::DOUBLE, 2) AS monthly_cost, ROUND(b / 1073741824 * 0.10::DOUBLE * 12, 2) AS yearly_cost
          FROM (SELECT layer, SUM(bytes)::DOUBLE AS b FROM table_stats GROUP BY layer))
       SELECT * FROM c UNION ALL SELECT 'total', ROUND(SUM(storage_gb), 2), ROUND(SUM(monthly_cost), 2), ROUND(SUM(yearly_cost), 2) FROM c""",
)
def _cost(t):
    return storage.cost_tracking(t("table_stats"))


@query(
    "largest_tables",
    "SELECT layer || '.' || table_name AS name, bytes AS size_bytes, bytes / 1048576.0::DOUBLE AS size_mb FROM table_stats ORDER BY bytes DESC, layer, table_name LIMIT 20",
)
def _largest(t):
    return storage.largest_tables(t("table_stats"))


@query(
    "storage_by_layer",
    "SELECT layer, SUM(bytes)::BIGINT AS total_bytes, SUM(bytes)::DOUBLE / 1073741824 AS storage_gb FROM table_stats GROUP BY layer",
)
def _by_layer(t):
    return storage.storage_by_layer(t("table_stats"))


@query(
    "resource_metrics",
    """SELECT 'table' AS resource_type, layer, table_name AS resource_name, metric, value FROM (
         SELECT layer, table_name, 'size_bytes' AS metric, bytes::DOUBLE AS value FROM table_stats
         UNION ALL SELECT layer, table_name, 'live_rows', live::DOUBLE FROM table_stats UNION ALL SELECT layer, table_name, 'dead_rows', dead::DOUBLE FROM table_stats
         UNION ALL SELECT layer, table_name, 'cache_hit_ratio', CASE WHEN hits + reads > 0 THEN hits::DOUBLE / (hits + reads) * 100 ELSE 0 END FROM table_stats)""",
)
def _resources(t):
    return storage.resource_metrics(t("table_stats"))


# Quality ----------------------------------------------------------------------------


@query(
    "duplicate_count",
    "SELECT COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def _dups(t):
    return quality.duplicate_count(t("lineitem"), ["l_orderkey", "l_linenumber"])


def _unique_sql(keys, prefix, names):
    parts = []
    for name, cols in keys.items():
        if name in names:
            key = cols[0] if len(cols) == 1 else f"({', '.join(cols)})"
            parts.append(
                f"SELECT '{name}' AS table_name, COUNT(*) - COUNT(DISTINCT {key}) AS duplicates FROM {prefix}{name}"
            )
    return f"SELECT *, duplicates > 0 AS has_duplicates FROM ({' UNION ALL '.join(parts)})"


_SILVER = [n for n in quality.SILVER_KEYS if n != "phone_number"]


@query("validate_silver", _unique_sql(quality.SILVER_KEYS, "silver_", _SILVER))
def _validate_silver(t):
    return quality.validate_unique({n: t(f"silver_{n}") for n in _SILVER}, quality.SILVER_KEYS)


@query(
    "validate_gold",
    """SELECT *, duplicates > 0 AS has_duplicates FROM (
       SELECT 'agg_daily_sales' AS table_name, COUNT(*) - COUNT(DISTINCT date_key) AS duplicates FROM expected_daily
       UNION ALL SELECT 'agg_customer_lifetime', COUNT(*) - COUNT(DISTINCT customer_key) FROM silver_customer WHERE is_valid
       UNION ALL SELECT 'agg_monthly_product_sales', COUNT(*) - COUNT(DISTINCT (y, m, c)) FROM (
         SELECT YEAR(order_date) AS y, MONTH(order_date) AS m, category_name AS c FROM silver_orders JOIN silver_order_item USING (order_key)
         JOIN silver_product USING (product_key) GROUP BY ALL))""",
)
def _validate_gold(t):
    orders, items = t("silver_orders"), t("silver_order_item")
    tables = {
        "agg_daily_sales": gold.agg_daily_sales(orders, items),
        "agg_customer_lifetime": gold.agg_customer_lifetime(t("silver_customer"), orders, items, "2001-08-01"),
        "agg_monthly_product_sales": gold.agg_monthly_product_sales(orders, items, t("silver_product")),
    }
    return quality.validate_unique(tables, quality.GOLD_KEYS)


@query(
    "valid_rows",
    "SELECT order_id, order_total::DOUBLE AS order_total, order_code FROM bronze_orders WHERE order_total > 0 AND TRIM(order_code) <> ''",
)
def _valid(t):
    return quality.valid_rows(t("bronze_orders").select("order_id", "order_total", "order_code"), "order_total", "order_code")


@query(
    "fk_misses",
    """SELECT DISTINCT 'customer_id' AS key_column, customer_id::BIGINT AS missing_value FROM bronze_orders WHERE customer_id NOT IN (SELECT customer_id FROM newest_known_customer)
       UNION ALL SELECT DISTINCT 'sales_rep_id', sales_rep_id::BIGINT FROM bronze_orders WHERE sales_rep_id NOT IN (SELECT employee_id FROM newest_known_employment)""",
)
def _misses(t):
    customers = silver_customer(t("bronze_customer"), None, RUN_TS, t("silver_person"), t("silver_customer_employee"))
    employees = silver_employee(
        t("bronze_employment"), None, RUN_TS, t("silver_person"), t("silver_employment_jobs"), t("silver_employee")
    )
    reps = employees.select(F.col("employee_id").alias("sales_rep_id"))
    return quality.fk_misses(t("bronze_orders"), {"customer_id": customers, "sales_rep_id": reps})


@query(
    "rule_violations",
    """SELECT 'rating_1_to_5' AS rule, COUNT(*) FILTER (WHERE NOT (rating BETWEEN 1 AND 5)) AS violations FROM raw_reviews
       UNION ALL SELECT 'text_present', COUNT(*) FILTER (WHERE NOT (TRIM(review_text) <> '')) FROM raw_reviews
       UNION ALL SELECT 'dated_before_2001', COUNT(*) FILTER (WHERE NOT (review_date < DATE '2001-01-01')) FROM raw_reviews""",
)
def _violations(t):
    rules = {
        "rating_1_to_5": F.col("rating").between(1, 5),
        "text_present": F.trim("review_text") != "",
        "dated_before_2001": F.col("review_date") < F.lit("2001-01-01").cast("date"),
    }
    return quality.rule_violations(t("raw_reviews"), rules)


_POPULATED = ("silver_orders", "silver_order_item", "silver_customer", "silver_product", "gold_fact_sales", "loaded_future")
sql_table("loaded_future", "SELECT * FROM silver_orders WHERE order_date > DATE '2100-01-01'")


@query(
    "population_report",
    "SELECT *, row_count = 0 AS is_empty FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in _POPULATED)
    + ")",
)
def _population(t):
    tables = {n: t(n) for n in _POPULATED if n != "loaded_future"}
    tables["loaded_future"] = t("silver_orders").where("order_date > DATE'2100-01-01'")
    return quality.population_report(tables)


# Monitoring --------------------------------------------------------------------------

_SECONDS = "(EPOCH_US(completed_at) - EPOCH_US(started_at))::DOUBLE / 1000000"
sql_table(
    "history",
    f"""SELECT run_id AS job_id, COALESCE(j.job_name, r.table_name, 'ETL Job') AS job_name, COALESCE(j.job_type, 'unknown') AS job_type, status, progress, layer, table_name,
        started_at, completed_at, records_processed, COALESCE(ROUND({_SECONDS}, 2), 0)::DOUBLE AS duration_seconds
        FROM job_runs r LEFT JOIN etl_jobs j ON j.job_id = r.job_id""",
)


@query("job_history", "SELECT * FROM history")
def _history(t):
    return monitoring.job_history(t("job_runs"), t("etl_jobs"))


_MSG = "COALESCE(error_message, 'ETL job failed')"


@query(
    "etl_errors",
    f"""SELECT run_id AS error_id, CASE WHEN LOWER({_MSG}) LIKE '%timeout%' THEN 'timeout' WHEN LOWER({_MSG}) LIKE '%connection%' OR LOWER({_MSG}) LIKE '%network%' THEN 'connection'
          WHEN LOWER({_MSG}) LIKE '%constraint%' OR LOWER({_MSG}) LIKE '%violation%' THEN 'constraint_violation' WHEN LOWER({_MSG}) LIKE '%null%' OR LOWER({_MSG}) LIKE '%missing%' THEN 'data_quality'
          ELSE 'processing_error' END AS type,
        CASE WHEN layer = 'gold' THEN 'critical' WHEN layer = 'silver' THEN 'high' ELSE 'warning' END AS severity,
        layer || '.' || table_name AS table_name, {_MSG} AS message, started_at AS occurred_at, job_name
        FROM job_runs JOIN etl_jobs USING (job_id) WHERE status = 'failed' AND started_at >= {_NOW} - INTERVAL 7 DAY
        UNION ALL SELECT layer || '_' || table_name || '_empty', 'empty_table', 'warning', layer || '.' || table_name,
          'Table ' || table_name || ' in ' || layer || ' layer has no data despite completed ETL jobs', {_NOW}, NULL FROM table_stats s
        WHERE row_count = 0 AND EXISTS (SELECT 1 FROM job_runs r WHERE r.layer = s.layer AND r.table_name = s.table_name AND r.status = 'completed')""",
)
def _errors(t):
    return monitoring.etl_errors(t("job_runs"), t("etl_jobs"), t("table_stats"), AS_OF_TS)


@query(
    "throughput",
    f"""WITH r AS (SELECT layer, table_name, records_processed, {_SECONDS} AS s FROM job_runs WHERE status = 'completed' AND records_processed > 0
              AND completed_at >= {_NOW} - INTERVAL 24 HOUR AND layer IS NOT NULL AND table_name IS NOT NULL),
        b AS (SELECT layer || '.' || table_name AS table_name, layer, ROUND(records_processed::DOUBLE / s, 2) AS records_per_second, records_processed AS total_records, ROUND(s, 2) AS duration_seconds
              FROM r WHERE s <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY layer, table_name ORDER BY records_processed::DOUBLE / s DESC, records_processed DESC, s DESC) = 1)
        SELECT *, (SELECT ROUND(SUM(records_per_second), 2) FROM b) AS overall_throughput FROM b ORDER BY records_per_second DESC, table_name LIMIT 10""",
)
def _throughput(t):
    return monitoring.throughput(t("job_runs"), t("table_stats"), AS_OF_TS)


@query(
    "throughput_fallback",
    """WITH b AS (SELECT layer || '.' || table_name AS table_name, layer, ROUND((inserts + updates) / 3600.0::DOUBLE, 2) AS records_per_second, live AS total_records, 3600.0::DOUBLE AS duration_seconds FROM table_stats)
       SELECT *, (SELECT ROUND(SUM(records_per_second), 2) FROM b) AS overall_throughput FROM b ORDER BY records_per_second DESC, table_name LIMIT 10""",
)
def _throughput_fallback(t):
    return monitoring.throughput(t("job_runs"), t("table_stats"), "2030-01-01 00:00:00")


sql_table(
    "fresh",
    f"""WITH done AS (SELECT * FROM job_runs WHERE status = 'completed' AND completed_at IS NOT NULL),
        per AS (SELECT layer, table_name, MAX(completed_at) AS ts, SUM(records_processed)::BIGINT AS records FROM done WHERE layer IS NOT NULL AND table_name IS NOT NULL GROUP BY ALL),
        tabs AS (SELECT layer, table_name FROM per UNION SELECT layer, table_name FROM table_stats),
        pipe AS (SELECT MAX(completed_at) AS ts FROM done JOIN etl_jobs j USING (job_id) WHERE LOWER(COALESCE(j.job_type, '')) = 'pipeline' OR LOWER(TRIM(COALESCE(j.job_name, ''))) LIKE '%complete etl pipeline%'),
        signs AS (SELECT layer, table_name, ts, 3 AS p, 'etl' AS sig FROM per UNION ALL SELECT layer, table_name, pipe.ts, 2, 'pipeline' FROM tabs, pipe WHERE layer IN ('silver', 'gold')
                  UNION ALL SELECT layer, table_name, max_ts, 1, 'column' FROM table_stats),
        best AS (SELECT * FROM signs WHERE ts IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY layer, table_name ORDER BY ts DESC, p DESC) = 1),
        aged AS (SELECT t.layer, t.table_name, b.ts, (EPOCH_US({_NOW}) - EPOCH_US(b.ts))::DOUBLE / 1000000 / 3600 AS h, COALESCE(per.records, s.row_count, 0) AS total_records, COALESCE(b.sig, 'unknown') AS sig
                 FROM tabs t LEFT JOIN best b USING (layer, table_name) LEFT JOIN per USING (layer, table_name) LEFT JOIN table_stats s USING (layer, table_name))
        SELECT layer, table_name, ts AS last_updated, ROUND(h, 2) AS hours_ago, CASE WHEN h IS NULL THEN 'unknown' WHEN h < 1 THEN 'fresh' WHEN h < 6 THEN 'stale' ELSE 'outdated' END AS status,
          total_records, sig AS activity_signal FROM aged""",
)


def _fresh(t):
    return monitoring.freshness(t("job_runs"), t("etl_jobs"), t("table_stats"), AS_OF_TS)


@query("freshness", "SELECT * FROM fresh")
def _freshness(t):
    return _fresh(t)


@query(
    "freshness_by_layer",
    """SELECT layer, CASE MAX(CASE status WHEN 'fresh' THEN 0 WHEN 'unknown' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END) WHEN 0 THEN 'fresh' WHEN 1 THEN 'unknown' WHEN 2 THEN 'stale' ELSE 'outdated' END AS overall_status,
       COUNT(*) FILTER (WHERE status = 'fresh') AS on_time, COUNT(*) FILTER (WHERE status = 'stale') AS at_risk, COUNT(*) FILTER (WHERE status = 'outdated') AS sla_breach,
       COUNT(*) FILTER (WHERE status = 'unknown') AS unknown_datasets FROM fresh GROUP BY layer""",
)
def _freshness_layer(t):
    return monitoring.freshness_by_layer(_fresh(t))


@query("freshness_sorted", "SELECT * FROM fresh")
def _freshness_sorted(t):
    return monitoring.freshness_sorted(_fresh(t))


_AGE = f"(EPOCH_US({_NOW}) - EPOCH_US({{}}))::DOUBLE / 1000000 / 3600"
sql_table(
    "scores",
    f"""WITH per AS (SELECT layer, table_name, COUNT(*) FILTER (WHERE started_at >= {_NOW} - INTERVAL 7 DAY) AS n, COUNT(*) FILTER (WHERE started_at >= {_NOW} - INTERVAL 7 DAY AND status = 'completed') AS ok,
             COUNT(*) FILTER (WHERE started_at >= {_NOW} - INTERVAL 7 DAY AND status = 'failed') AS bad, MAX(CASE WHEN started_at >= {_NOW} - INTERVAL 7 DAY THEN started_at END) AS lr, MAX(started_at) AS la
             FROM job_runs WHERE layer IS NOT NULL AND table_name IS NOT NULL GROUP BY ALL),
        j AS (SELECT s.*, n, ok, bad, {_AGE.format('lr')} AS age, {_AGE.format('la')} AS old,
                CASE WHEN live > 0 THEN GREATEST(0.0::DOUBLE, 100.0::DOUBLE - dead::DOUBLE / live * 100) WHEN row_count > 0 THEN 70.0::DOUBLE END AS base
              FROM table_stats s LEFT JOIN per USING (layer, table_name)),
        k AS (SELECT *, CASE WHEN n > 0 THEN COALESCE(base, CASE WHEN row_count > 0 THEN 60 ELSE 20 END) * 0.55::DOUBLE + ok::DOUBLE / n * 100 * 0.45::DOUBLE - bad::DOUBLE / n * 25 - CASE WHEN age > 72 THEN 15 WHEN age > 24 THEN 8 ELSE 0 END
              ELSE (CASE WHEN row_count = 0 THEN 20 ELSE COALESCE(base, 50) END) - CASE WHEN old > 72 THEN 12 WHEN old > 24 THEN 6 ELSE 0 END END AS raw FROM j),
        c AS (SELECT *, LEAST(100.0::DOUBLE, GREATEST(0.0::DOUBLE, raw)) AS sc FROM k)
        SELECT layer, table_name, row_count, CASE WHEN live > 0 THEN dead ELSE 0 END AS dead_rows, ROUND(sc, 2) AS quality_score,
          CASE WHEN sc >= 95 THEN 'excellent' WHEN sc >= 80 THEN 'good' WHEN sc >= 60 THEN 'fair' ELSE 'poor' END AS status FROM c""",
)


@query("quality_score", "SELECT * FROM scores")
def _score(t):
    return monitoring.quality_score(t("table_stats"), t("job_runs"), AS_OF_TS)


@query(
    "quality_by_layer",
    """SELECT layer, COUNT(*) AS datasets, ROUND(AVG(quality_score), 2) AS average_quality_score, CASE WHEN AVG(quality_score) >= 95 THEN 'excellent' WHEN AVG(quality_score) >= 80 THEN 'good'
       WHEN AVG(quality_score) >= 60 THEN 'fair' ELSE 'poor' END AS overall_status, COUNT(*) FILTER (WHERE quality_score < 80) AS below_80 FROM scores GROUP BY layer""",
)
def _score_layer(t):
    return monitoring.quality_by_layer(monitoring.quality_score(t("table_stats"), t("job_runs"), AS_OF_TS))


@query(
    "etl_kpis",
    """SELECT COUNT(*) FILTER (WHERE status IN ('running', 'pending')) AS active_pipelines, COUNT(*) FILTER (WHERE status IN ('failed', 'error')) AS failed_runs,
       SUM(duration_seconds::DECIMAL(18,2))::DOUBLE / COUNT(*) AS mean_duration_seconds, (SELECT COUNT(*) FROM fresh WHERE status = 'fresh') AS sla_met, (SELECT COUNT(*) FROM fresh) AS sla_total FROM history""",
)
def _kpis(t):
    return monitoring.etl_kpis(monitoring.job_history(t("job_runs"), t("etl_jobs")), _fresh(t))


# Alerts -------------------------------------------------------------------------------

# Storage threshold lowered so the test tables have something to report.
_RULES = tuple((k, on, s, 0.1 if k == "storage" else v) for k, on, s, v in alerts.DEFAULT_RULES)
sql_table(
    "raw_alerts",
    f"""SELECT 'empty_table_' || layer || '_' || table_name AS alert_id, 'empty_table' AS type, 'medium' AS severity, 'Empty table detected: ' || layer || '.' || table_name AS title,
          'The table ' || table_name || ' in ' || layer || ' layer has no data. ETL process may have failed.' AS message, NULL::VARCHAR AS layer, NULL::VARCHAR AS table_name, {_NOW} AS occurred_at FROM table_stats WHERE live = 0
        UNION ALL SELECT 'dead_tuples_' || layer || '_' || table_name, 'data_quality', 'medium', 'High dead tuple ratio: ' || layer || '.' || table_name,
          'Table ' || table_name || ' has ' || ROUND(dead::DOUBLE / (live + dead) * 100, 2) || '% dead tuples.', NULL, NULL, {_NOW} FROM table_stats WHERE live + dead <> 0 AND dead::DOUBLE / (live + dead) > 0.1
        UNION ALL SELECT 'cache_poor_' || layer || '_' || table_name, 'performance', 'low', 'Low cache hit rate: ' || layer || '.' || table_name,
          'Table ' || table_name || ' has only ' || ROUND(hits::DOUBLE / (hits + reads) * 100, 2) || '% cache hit rate.', NULL, NULL, {_NOW} FROM table_stats WHERE hits + reads > 1000 AND hits::DOUBLE / (hits + reads) < 0.7
        UNION ALL SELECT 'large_table_' || layer || '_' || table_name, 'storage', 'info', 'Large table: ' || layer || '.' || table_name,
          'Table ' || table_name || ' is ' || ROUND(bytes / 1073741824.0::DOUBLE, 2) || ' GB.', NULL, NULL, {_NOW} FROM table_stats WHERE bytes > 107374182
        UNION ALL SELECT 'etl_' || status || '_' || run_id, 'etl_failure', 'high', 'ETL job ' || status || ': ' || job_name,
          'ETL job ''' || job_name || ''' on layer ' || COALESCE(layer, 'unknown') || COALESCE(' for table ' || table_name, '') || ' finished with status ' || UPPER(status) || '.' || COALESCE(' Error: ' || error_message, ''),
          layer, table_name, started_at FROM job_runs JOIN etl_jobs USING (job_id) WHERE status IN ('failed', 'error') AND started_at >= {_NOW} - INTERVAL 1 DAY
        UNION ALL SELECT 'slow_q_' || SUBSTR(sha256(COALESCE(query_text, '') || '|' || COALESCE(collected_at::VARCHAR, '') || '|' || log_id), 1, 24), 'slow_query', 'high', 'Slow query (' || ROUND(mean_exec_time_ms::DOUBLE, 0) || ' ms mean)', query_text, NULL, NULL, collected_at
          FROM query_logs WHERE mean_exec_time_ms > 5000 AND collected_at >= {_NOW} - INTERVAL 1 DAY""",
)
sql_table("acks", "SELECT 'etl_failed_' || run_id AS alert_id FROM job_runs WHERE progress > 70")
sql_table("live_alerts", "SELECT *, 'active' AS status FROM raw_alerts WHERE alert_id NOT IN (SELECT alert_id FROM acks)")


def _active(t):
    acknowledged = t("job_runs").where("progress > 70").select(F.concat(F.lit("etl_failed_"), "run_id").alias("alert_id"))
    return alerts.alerts_active(
        t("table_stats"), t("job_runs"), t("etl_jobs"), t("query_logs"), acknowledged, AS_OF_TS, rules=_RULES
    )


@query("alerts_active", "SELECT * FROM live_alerts")
def _alerts_active(t):
    return _active(t)


@query("alerts_by_severity", "SELECT severity, COUNT(*) AS alerts FROM live_alerts GROUP BY 1")
def _alerts_severity(t):
    return alerts.alerts_by_severity(_active(t))


@query(
    "slow_queries",
    f"SELECT log_id, query_hash, mean_exec_time_ms::DOUBLE AS mean_exec_time_ms, collected_at FROM query_logs WHERE mean_exec_time_ms > 5000 AND collected_at >= {_NOW} - INTERVAL 1 DAY",
)
def _slow(t):
    slow = alerts.slow_queries(t("query_logs"), AS_OF_TS, 5000.0)
    return slow.select("log_id", "query_hash", "mean_exec_time_ms", "collected_at")


# Incidents on record: one per alert type seen in failed or slow history, plus types that no longer fire.
sql_table(
    "old_incidents",
    """SELECT 'inc_' || kind AS incident_id, kind AS alert_type, 'old' AS title, 'old' AS description, 'low' AS severity, st AS status, lo AS started_at,
       CASE WHEN st = 'resolved' THEN hi END AS resolved_at, n AS alert_count, '' AS affected_tables, hi AS updated_at
       FROM (SELECT CASE event_type WHEN 'error' THEN 'etl_failure' WHEN 'view' THEN 'slow_query' WHEN 'click' THEN 'disk_full' ELSE 'gone_quiet' END AS kind,
               CASE WHEN event_type IN ('error', 'click') THEN 'open' ELSE 'resolved' END AS st, MIN(ts) AS lo, MAX(ts) AS hi, COUNT(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY ALL)""",
)


def _old_incidents(t):
    e = t("events").where("event_type <> 'signup'")
    kind = (
        F.when(F.col("event_type") == "error", "etl_failure")
        .when(F.col("event_type") == "view", "slow_query")
        .when(F.col("event_type") == "click", "disk_full")
        .otherwise("gone_quiet")
    )
    status = F.when(F.col("event_type").isin("error", "click"), "open").otherwise("resolved")
    rows = e.groupBy(kind.alias("alert_type"), status.alias("status")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count("*").alias("alert_count")
    )
    return rows.select(
        F.concat(F.lit("inc_"), "alert_type").alias("incident_id"),
        "alert_type",
        F.lit("old").alias("title"),
        F.lit("old").alias("description"),
        F.lit("low").alias("severity"),
        "status",
        "started_at",
        F.when(F.col("status") == "resolved", F.col("updated_at")).alias("resolved_at"),
        "alert_count",
        F.lit("").alias("affected_tables"),
        "updated_at",
    )


_RUN = "TIMESTAMP '2024-01-31 00:05:00'"
sql_table(
    "synced",
    f"""WITH g AS (SELECT type AS alert_type, 'inc_' || type AS incident_id, MIN(occurred_at) AS s, COUNT(*) AS n,
             CASE WHEN BOOL_OR(severity IN ('critical', 'high')) THEN 'high' WHEN BOOL_OR(severity = 'medium') THEN 'medium' ELSE 'low' END AS sev FROM live_alerts GROUP BY type),
        f AS (SELECT type AS alert_type, STRING_AGG(COALESCE(table_name, title), ', ' ORDER BY alert_id) AS tabs FROM (SELECT * FROM live_alerts QUALIFY ROW_NUMBER() OVER (PARTITION BY type ORDER BY alert_id) <= 5) GROUP BY type),
        n AS (SELECT g.*, f.tabs, REPLACE(g.alert_type, '_', ' ') AS words FROM g JOIN f USING (alert_type)),
        o AS (SELECT * FROM old_incidents)
        SELECT COALESCE(n.incident_id, o.incident_id) AS incident_id, COALESCE(n.alert_type, o.alert_type) AS alert_type,
          CASE WHEN n.incident_id IS NOT NULL THEN array_to_string(list_transform(string_split(n.words, ' '), lambda w: UPPER(w[1]) || w[2:]), ' ') || ' — grouped alerts' ELSE o.title END AS title,
          CASE WHEN n.incident_id IS NOT NULL THEN n.n || ' active signal(s) of type "' || n.words || '".' ELSE o.description END AS description,
          COALESCE(n.sev, o.severity) AS severity, CASE WHEN n.incident_id IS NOT NULL THEN 'open' ELSE 'resolved' END AS status,
          CASE WHEN n.incident_id IS NOT NULL THEN LEAST(o.started_at, n.s) ELSE o.started_at END AS started_at,
          CASE WHEN n.incident_id IS NOT NULL THEN NULL WHEN o.status = 'open' THEN COALESCE(o.resolved_at, {_RUN}) ELSE o.resolved_at END AS resolved_at,
          CASE WHEN n.incident_id IS NOT NULL THEN n.n WHEN o.status = 'open' THEN 0 ELSE o.alert_count END AS alert_count,
          COALESCE(n.tabs, o.affected_tables) AS affected_tables, CASE WHEN n.incident_id IS NOT NULL OR o.status = 'open' THEN {_RUN} ELSE o.updated_at END AS updated_at
        FROM o FULL OUTER JOIN n ON n.incident_id = o.incident_id""",
)


def _synced(t):
    return alerts.incidents_sync(_old_incidents(t), _active(t), "2024-01-31 00:05:00")


@query("incidents_sync", "SELECT * FROM synced")
def _incidents(t):
    return _synced(t)


@query(
    "incidents_view",
    f"""SELECT * FROM synced WHERE status = 'open' OR (status = 'resolved' AND resolved_at >= {_NOW} - INTERVAL 1 DAY)
        """,
)
def _incidents_view(t):
    return alerts.incidents_view(_synced(t), AS_OF_TS)


@query(
    "anomalies_rules",
    f"""WITH m AS (SELECT * FROM table_stats), a AS (SELECT SUM(inserts)::DOUBLE / COUNT(*) AS v FROM m),
        b AS (SELECT * FROM table_stats WHERE live > 0), u AS (SELECT SUM((bytes::DOUBLE / live)::DECIMAL(28,8))::DOUBLE / COUNT(*) AS v FROM b)
        SELECT 'anomaly_etl_failure_' || run_id AS anomaly_id, 'etl_failure' AS type, 'high' AS severity,
          CASE WHEN layer IS NOT NULL OR table_name IS NOT NULL THEN COALESCE(layer, 'unknown') || '.' || COALESCE(table_name, 'unknown') END AS table_name, NULL::DOUBLE AS expected_value, NULL::DOUBLE AS actual_value, started_at AS occurred_at
          FROM job_runs JOIN etl_jobs USING (job_id) WHERE status = 'failed' AND started_at >= {_NOW} - INTERVAL 7 DAY
        UNION ALL SELECT 'anomaly_inserts_' || layer || '_' || table_name, 'insert_rate_drop', 'medium', layer || '.' || table_name, ROUND(a.v, 2), inserts::DOUBLE, {_NOW} FROM m, a WHERE inserts > 0 AND inserts < a.v * 0.1::DOUBLE AND a.v > 1000
        UNION ALL SELECT 'anomaly_size_' || layer || '_' || table_name, 'unusual_row_size', 'low', layer || '.' || table_name, ROUND(u.v, 2), ROUND(bytes::DOUBLE / live, 2), {_NOW} FROM b, u WHERE bytes::DOUBLE / live > u.v * 2""",
)
def _anomalies(t):
    return alerts.anomalies_rules(t("table_stats"), t("job_runs"), t("etl_jobs"), AS_OF_TS)


@query(
    "alert_history",
    f"""SELECT 'hist_etl_' || run_id AS alert_id, 'etl_failure' AS type, 'high' AS severity, 'ETL ' || status || ': ' || job_name AS title, COALESCE(error_message, 'Run failed') AS message,
          started_at AS occurred_at, completed_at AS resolved_at, {_SECONDS} AS resolution_time_seconds, 'failed' AS status
          FROM job_runs JOIN etl_jobs USING (job_id) WHERE status IN ('failed', 'error') AND started_at >= {_NOW} - INTERVAL 30 DAY
        UNION ALL SELECT alert_id, type, severity, title, message, occurred_at, NULL, NULL, status FROM live_alerts""",
)
def _alert_history(t):
    return alerts.alert_history(_active(t), t("job_runs"), t("etl_jobs"), AS_OF_TS)


def _sustained_sql() -> str:
    parts = []
    for name, metric, op, threshold, minutes, severity in alerts.SUSTAINED_RULES:
        test = f"MIN(value) > {threshold}" if op == ">" else f"MAX(value) < {threshold}"
        parts.append(
            f"""SELECT '{name}' AS rule, '{severity}' AS severity, host, w AS window_start, w + INTERVAL {minutes} MINUTE AS window_end, COUNT(*) AS samples
            FROM (SELECT host, value, UNNEST(list_transform(range({minutes}), lambda i: DATE_TRUNC('minute', observed_at) - INTERVAL 1 MINUTE * i)) AS w FROM system_metrics WHERE metric = '{metric}')
            GROUP BY host, w HAVING {test}"""
        )
    return " UNION ALL ".join(parts)


@query("sustained_alerts", _sustained_sql())
def _sustained(t):
    return alerts.sustained_alerts(t("system_metrics"))
