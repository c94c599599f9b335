"""Layout recommendation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.operators import layout
from smeltery.plans.registry import query, sql_table

_HINT_ROWS = ", ".join(f"('{h}')" for h in layout.COLUMN_HINTS)
_KEYS = ", ".join(f"'{k}'" for k in layout.KEY_LIKE)
_WORDS = " UNION ALL ".join(
    f"SELECT log_id, '{t}' AS table_name, '{c}' AS column_name FROM strict_words WHERE CONTAINS(u, '{a}') AND CONTAINS(u, '{b}')"
    for a, b, t, c in layout.WORD_FALLBACKS
)
_TIMES = ", ".join(f"'{c}'" for c in layout.TIME_COLUMNS)
_TIMED = f"(column_name IN ({_TIMES}) OR regexp_matches(column_name, '{layout.TIME_SUFFIXES}'))"


def _all(text, pattern, group):
    return f"UNNEST(regexp_extract_all({text}, '{pattern}', {group}))"


sql_table("texts", "SELECT log_id, UPPER(query_text) AS u, LOWER(query_text) AS l FROM query_logs")
sql_table(
    "strict_pairs",
    f"""SELECT log_id, LOWER(s || '.' || tb) AS table_name, LOWER(c) AS column_name FROM (
        SELECT log_id, {_all('u', layout.QUALIFIED, 1)} AS s, {_all('u', layout.QUALIFIED, 2)} AS tb, {_all('u', layout.QUALIFIED, 3)} AS c FROM texts)""",
)
sql_table("strict_words", "SELECT * FROM texts WHERE log_id NOT IN (SELECT log_id FROM strict_pairs)")
sql_table(
    "from_tables",
    f"""SELECT log_id, pos, al, CASE WHEN CONTAINS(raw, '.') THEN LOWER(raw) ELSE 'silver.' || LOWER(raw) END AS tb FROM (
        SELECT log_id, {_all('u', layout.FROM_OR_JOIN, 2)} AS raw, {_all('u', layout.FROM_OR_JOIN, 3)} AS al,
               UNNEST(range(LEN(regexp_extract_all(u, '{layout.FROM_OR_JOIN}', 2)))) AS pos FROM texts)""",
)
sql_table(
    "where_texts",
    rf"SELECT log_id, CASE WHEN regexp_matches(u, '{layout.AFTER_WHERE}') THEN regexp_extract(u, '{layout.AFTER_WHERE}', 1) ELSE u END AS w FROM texts",
)
sql_table(
    "aliased_pairs",
    f"""SELECT e.log_id, COALESCE((SELECT ARG_MAX(f.tb, f.pos) FROM from_tables f WHERE f.log_id = e.log_id AND f.al = e.lft),
               (SELECT ARG_MIN(f.tb, f.pos) FROM from_tables f WHERE f.log_id = e.log_id)) AS table_name, LOWER(e.c) AS column_name
        FROM (SELECT log_id, {_all('w', layout.ALIASED_EQUALS, 1)} AS lft, {_all('w', layout.ALIASED_EQUALS, 2)} AS c FROM where_texts) e""",
)
sql_table(
    "plain_pairs",
    f"""SELECT e.log_id, COALESCE(f.tb, 'silver.unknown') AS table_name, LOWER(e.c) AS column_name
        FROM (SELECT DISTINCT log_id, c FROM (SELECT log_id, {_all('w', layout.PLAIN_EQUALS, 1)} AS c FROM where_texts) WHERE c IN ({_KEYS})) e
        LEFT JOIN from_tables f ON f.log_id = e.log_id
        WHERE NOT EXISTS (SELECT 1 FROM aliased_pairs a WHERE a.log_id = e.log_id AND a.column_name = LOWER(e.c) AND a.table_name IS NOT NULL)""",
)
sql_table(
    "broad_pairs",
    rf"""SELECT DISTINCT n.log_id, n.tb AS table_name, h.hint AS column_name
        FROM (SELECT log_id, l, {_all('l', layout.LAYERED_NAME, 1)} || '.' || {_all('l', layout.LAYERED_NAME, 2)} AS tb FROM texts) n,
             (VALUES {_HINT_ROWS}) h(hint) WHERE regexp_matches(n.l, '\b' || h.hint || '\b')""",
)
sql_table(
    "index_pairs",
    f"""SELECT DISTINCT * FROM (SELECT * FROM strict_pairs UNION ALL {_WORDS} UNION ALL SELECT * FROM aliased_pairs WHERE table_name IS NOT NULL
        UNION ALL SELECT * FROM plain_pairs UNION ALL SELECT * FROM broad_pairs)""",
)
sql_table("timed_pairs", f"SELECT * FROM index_pairs WHERE {_TIMED}")
sql_table(
    "all_pairs",
    """SELECT log_id, 'index' AS type, table_name, column_name FROM index_pairs UNION ALL SELECT log_id, 'partition', table_name, column_name FROM timed_pairs
       UNION ALL SELECT log_id, 'partition', 'silver.orders', 'order_date' FROM texts WHERE log_id NOT IN (SELECT log_id FROM timed_pairs) AND CONTAINS(u, 'ORDER_DATE') AND CONTAINS(u, 'ORDERS')
       UNION ALL SELECT log_id, 'partition', 'bronze.customer_events', 'created_at' FROM texts WHERE log_id NOT IN (SELECT log_id FROM timed_pairs) AND CONTAINS(u, 'CREATED_AT')
       UNION ALL SELECT log_id, 'partition', 'bronze.events', 'event_ts' FROM texts WHERE log_id NOT IN (SELECT log_id FROM timed_pairs) AND CONTAINS(u, 'EVENT_TS')""",
)


@query("table_column_candidates", "SELECT * FROM all_pairs")
def _candidates(t):
    return layout.table_column_candidates(t("query_logs").select("log_id", "query_text")).drop("query_text")


@query("partition_candidates", "SELECT DISTINCT table_name, column_name FROM all_pairs WHERE type = 'partition'")
def _partitions(t):
    return layout.partition_candidates(t("query_logs"))


sql_table(
    "severities",
    """SELECT l.log_id, a AS actual_ms, COALESCE(s.predicted_ms, a) AS predicted_ms,
       CASE WHEN s.anomaly_score IS NOT NULL THEN GREATEST(0, -s.anomaly_score) WHEN s.predicted_ms IS NOT NULL AND a > 0 THEN LEAST(2.0::DOUBLE, ABS(s.predicted_ms - a) / GREATEST(a, 0.001::DOUBLE)) ELSE 0.05::DOUBLE END AS severity
       FROM (SELECT log_id, CASE WHEN mean_exec_time_ms <= 0 AND calls > 0 THEN 0.001::DOUBLE ELSE mean_exec_time_ms::DOUBLE END AS a FROM query_logs) l LEFT JOIN model_scores s USING (log_id)""",
)
sql_table(
    "recommended",
    """WITH g AS (SELECT type, table_name, column_name, COUNT(*) AS query_count, SUM(severity::DECIMAL(28,8))::DOUBLE AS s, MAX(severity) AS severity_max, SUM(predicted_ms::DECIMAL(28,8))::DOUBLE AS p, SUM(actual_ms::DECIMAL(28,8))::DOUBLE AS a
          FROM all_pairs JOIN severities USING (log_id) GROUP BY ALL),
       r AS (SELECT *, s / query_count AS severity_avg, LEAST(0.5::DOUBLE, 0.05::DOUBLE + 0.45::DOUBLE * (s / query_count / (SELECT MAX(severity_max) FROM g))) AS gain FROM g)
       SELECT type, table_name, column_name, query_count, severity_avg, severity_max, p / query_count AS predicted_avg_ms, a / query_count AS avg_execution_time_ms, gain AS estimated_improvement,
         CASE WHEN gain >= 0.30::DOUBLE THEN 'high' WHEN gain >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS priority,
         CASE WHEN gain >= 0.30::DOUBLE THEN 0.20 WHEN gain >= 0.15::DOUBLE THEN 0.15 ELSE 0.10 END::DOUBLE AS cost FROM r""",
)


def _recommended(t):
    return layout.layout_recommendations(t("query_logs"), t("model_scores"))


@query("layout_recommendations", "SELECT * FROM recommended")
def _layout(t):
    return _recommended(t)


_RANKED = "ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, query_count DESC, type, table_name, column_name"


@query("layout_recommendations_top", f"SELECT * FROM recommended WHERE type = 'index' {_RANKED} LIMIT 5")
def _layout_top(t):
    # The worst severity is taken over the kept kind, which here names every log row too.
    return layout.layout_recommendations(t("query_logs"), t("model_scores"), type_filter="index", cap=5)


@query(
    "weighted_recommendations",
    """WITH g AS (SELECT table_name, column_name, COUNT(*) AS n, SUM(mean_exec_time_ms::DECIMAL(28,8))::DOUBLE AS a, SUM(predicted_ms::DECIMAL(28,8))::DOUBLE AS p, SUM(COALESCE(shared_blks_read, 0))::DOUBLE AS io
          FROM all_pairs JOIN query_logs USING (log_id) JOIN model_scores USING (log_id) WHERE type = 'index' GROUP BY ALL HAVING COUNT(*) >= 2),
       b AS (SELECT *, a / n * n + io / n * 0.5::DOUBLE AS ben FROM g), r AS (SELECT *, 0.1::DOUBLE + 0.4::DOUBLE * (ben / (ben + 1000000)) AS gain FROM b)
       SELECT table_name, column_name, n AS query_count, a / n AS avg_execution_ms, CASE WHEN p > 0 THEN p / n ELSE a / n END AS predicted_avg_ms, gain AS estimated_improvement,
         CASE WHEN gain >= 0.35::DOUBLE THEN 'high' WHEN gain >= 0.2::DOUBLE THEN 'medium' ELSE 'low' END AS priority FROM r""",
)
def _weighted(t):
    return layout.weighted_recommendations(t("query_logs"), t("model_scores"))


@query(
    "rule_recommendations",
    """WITH s AS (SELECT *, UPPER(query_text) AS u, mean_exec_time_ms::DOUBLE AS ms FROM query_logs WHERE CONTAINS(query_text, 'WHERE') AND calls > 10),
       h AS (SELECT *, CASE WHEN CONTAINS(u, 'SILVER.ORDERS') AND CONTAINS(u, 'ORDER_DATE') THEN 'silver.orders' WHEN CONTAINS(u, 'SILVER.CUSTOMERS') AND CONTAINS(u, 'CUSTOMER_ID') THEN 'silver.customers'
              WHEN CONTAINS(u, 'SILVER.PRODUCTS') AND (CONTAINS(u, 'PRODUCT_ID') OR CONTAINS(u, 'CATEGORY')) THEN 'silver.products' END AS tb FROM s),
       k AS (SELECT *, CASE tb WHEN 'silver.orders' THEN 'order_date' WHEN 'silver.customers' THEN 'customer_id' ELSE CASE WHEN CONTAINS(u, 'PRODUCT_ID') THEN 'product_id' ELSE 'category' END END AS cn FROM h WHERE tb IS NOT NULL)
       SELECT tb AS table_name, cn AS column_name, CASE WHEN tb = 'silver.orders' AND ms > 100 THEN 'high' WHEN tb = 'silver.customers' AND ms > 50 THEN 'high' ELSE 'medium' END AS priority,
         ms * CASE tb WHEN 'silver.orders' THEN 0.5 WHEN 'silver.customers' THEN 0.3 ELSE 0.4 END::DOUBLE AS estimated_reduction_ms, calls AS query_count, ms AS avg_execution_time_ms
       FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY tb, cn ORDER BY calls DESC, mean_exec_time_ms DESC, log_id) = 1""",
)
def _rules(t):
    return layout.rule_recommendations(t("query_logs"))


sql_table(
    "lead_columns",
    f"""SELECT layer, table_name, ARG_MIN(column_name, position) AS first_column, ARG_MIN(CASE WHEN regexp_matches(type, 'date|time') OR {_TIMED} THEN column_name END,
        CASE WHEN regexp_matches(type, 'date|time') THEN position WHEN {_TIMED} THEN 1000 + position END) AS time_column FROM layer_catalog GROUP BY ALL""",
)


@query("leading_columns", "SELECT * FROM lead_columns")
def _leading(t):
    return layout.leading_columns(t("layer_catalog"))


@query(
    "activity_recommendations",
    """WITH b AS (SELECT s.*, first_column, time_column, s.layer || '.' || s.table_name AS nm, CASE WHEN reads > 100 THEN 'high' WHEN reads > 10 THEN 'medium' ELSE 'low' END AS pri
          FROM table_stats s LEFT JOIN lead_columns l ON l.layer = s.layer AND l.table_name = s.table_name WHERE reads >= 5)
       SELECT 'index' AS type, nm AS table_name, COALESCE(first_column, 'id') AS column_name, 0.25::DOUBLE AS estimated_improvement, 0.15::DOUBLE AS cost, pri AS priority, reads AS query_count FROM b
       UNION ALL SELECT 'partition', nm, time_column, 0.2, 0.2, pri, reads FROM b WHERE (live >= 1000 OR bytes / 1048576.0 >= 0.25) AND time_column IS NOT NULL""",
)
def _activity(t):
    return layout.activity_recommendations(t("table_stats"), t("layer_catalog"))


@query(
    "partition_hints",
    """WITH i AS (SELECT * FROM recommended WHERE type = 'index' QUALIFY ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY estimated_improvement DESC, query_count DESC, column_name DESC) = 1)
       SELECT 'partition' AS type, i.table_name, l.time_column AS column_name, LEAST(0.45::DOUBLE, GREATEST(0.12::DOUBLE, i.estimated_improvement * 0.85::DOUBLE)) AS estimated_improvement, 0.2::DOUBLE AS cost, i.priority, i.query_count, i.avg_execution_time_ms
       FROM i JOIN lead_columns l ON l.layer || '.' || l.table_name = i.table_name AND l.time_column IS NOT NULL
       WHERE NOT EXISTS (SELECT 1 FROM recommended p WHERE p.type = 'partition' AND p.table_name = i.table_name AND p.column_name = l.time_column)""",
)
def _hints(t):
    return layout.partition_hints(_recommended(t), t("layer_catalog"))


sql_table(
    "stored",
    """SELECT recommendation_id, recommendation_type AS type, table_name, column_name,
       CASE WHEN regexp_matches(estimated_improvement, '^[0-9]+\\.?[0-9]*$') THEN TRY_CAST(estimated_improvement AS DOUBLE) / 100 ELSE 0.3 END::DOUBLE AS estimated_improvement,
       CASE priority WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.15 ELSE 0.1 END::DOUBLE AS cost, priority, COALESCE(NULLIF(TRIM(status), ''), 'pending') AS status, query_count FROM stored_recommendations""",
)


@query("persisted_recommendations", "SELECT * FROM stored")
def _persisted(t):
    return layout.persisted_recommendations(t("stored_recommendations"))


@query(
    "rescored_recommendations",
    """WITH s AS (SELECT table_name, column_name, ARG_MAX(severity_avg, type) AS sev FROM recommended GROUP BY ALL),
       g AS (SELECT d.*, s.sev, LEAST(0.5::DOUBLE, 0.05::DOUBLE + 0.45::DOUBLE * (s.sev / (s.sev + 1))) AS gain FROM stored d LEFT JOIN s USING (table_name, column_name)),
       p AS (SELECT *, CASE WHEN gain >= 0.30::DOUBLE THEN 'high' WHEN gain >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS np FROM g)
       SELECT recommendation_id, type, table_name, column_name, CASE WHEN sev IS NULL THEN estimated_improvement ELSE gain END AS estimated_improvement,
         CASE WHEN sev IS NULL THEN cost ELSE CASE np WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.15 ELSE 0.1 END END::DOUBLE AS cost, CASE WHEN sev IS NULL THEN priority ELSE np END AS priority, status, query_count FROM p""",
)
def _rescored(t):
    return layout.rescore(layout.persisted_recommendations(t("stored_recommendations")), _recommended(t))


_SHARED = "type, table_name, column_name, estimated_improvement, cost, priority, query_count::BIGINT AS query_count"
sql_table(
    "merged",
    f"""SELECT {_SHARED} FROM (SELECT 0 AS src, * FROM (SELECT {_SHARED} FROM recommended) UNION ALL SELECT 1, * FROM (SELECT {_SHARED} FROM stored))
        QUALIFY ROW_NUMBER() OVER (PARTITION BY type, table_name, column_name ORDER BY src, estimated_improvement, cost, priority, query_count) = 1""",
)
_COLUMNS = ["type", "table_name", "column_name", "estimated_improvement", "cost", "priority"]


def _merged(t):
    live = _recommended(t).select(*_COLUMNS, "query_count")
    old = layout.persisted_recommendations(t("stored_recommendations"))
    old = old.select(*_COLUMNS, F.col("query_count").cast("long").alias("query_count"))
    return layout.merge_first_wins([live, old], ["type", "table_name", "column_name"])


@query("merged_recommendations", "SELECT * FROM merged")
def _merge(t):
    return _merged(t)


@query(
    "alternated_samples",
    """SELECT query_text FROM query_logs WHERE TRIM(query_text) <> '' GROUP BY query_text""",
)
def _alternated(t):
    rows = t("query_logs").select("query_text", "collected_at", "log_id", "calls")
    both = layout.alternate_sources(
        rows.where("calls > 50"), rows.where("calls <= 50"), "query_text", ["collected_at", "log_id"]
    )
    return both.select("query_text")


sql_table("known_columns", "SELECT DISTINCT layer || '.' || table_name AS table_name, column_name FROM layer_catalog")


@query(
    "genuine_recommendations",
    """SELECT m.* FROM merged m JOIN known_columns USING (table_name, column_name)
       JOIN (SELECT table_name, column_name FROM all_pairs GROUP BY ALL HAVING COUNT(DISTINCT log_id) >= 3) USING (table_name, column_name)""",
)
def _genuine(t):
    texts = t("query_logs").groupBy("query_text").agg(F.count("*").alias("n"))
    pairs = layout.table_column_candidates(texts, one_row_per_text=True)
    return layout.genuine_recommendations(_merged(t), t("layer_catalog"), pairs, min_evidence=3)


_EARLY = "applied_at < TIMESTAMP '2024-01-01 06:00:00' AND column_names IS NOT NULL"


@query(
    "suppressed_recommendations",
    f"""SELECT m.* FROM merged m WHERE NOT EXISTS (SELECT 1 FROM apply_events a WHERE {_EARLY} AND LOWER(a.recommendation_type) = m.type AND a.table_name = m.table_name
        AND CASE WHEN a.column_names LIKE '[%' THEN 'order_date' ELSE a.column_names END = m.column_name)""",
)
def _suppressed(t):
    return layout.suppress_applied(_merged(t), t("apply_events").where(_EARLY.replace("TIMESTAMP '", "TIMESTAMP_NTZ'")))


@query(
    "pending_recommendations",
    """SELECT recommendation_id, table_name, 'pending' AS status_norm FROM stored_recommendations WHERE LOWER(COALESCE(NULLIF(TRIM(status), ''), 'pending')) = 'pending'""",
)
def _pending(t):
    rows = layout.pending_recommendations(t("stored_recommendations"))
    return rows.select("recommendation_id", "table_name", F.lower("status_norm").alias("status_norm"))


@query(
    "optimization_history",
    """SELECT recommendation_id, recommendation_type AS type, table_name, CASE WHEN column_names LIKE '[%' THEN 'order_date,order_id' ELSE COALESCE(column_names, '') END AS columns,
       priority, query_count, estimated_improvement, applied_at FROM apply_events ORDER BY applied_at DESC, recommendation_id LIMIT 50""",
)
def _history(t):
    return layout.optimization_history(t("apply_events"))


@query(
    "monthly_applies",
    """SELECT STRFTIME(m, '%Y-%m') AS month_key, COUNT(recommendation_id) AS applied, COALESCE(SUM(estimated_improvement::DECIMAL(18,6)), 0)::DOUBLE AS sum_estimated_improvement
       FROM (SELECT UNNEST(generate_series(TIMESTAMP '2023-03-01', TIMESTAMP '2024-02-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN apply_events ON DATE_TRUNC('month', applied_at) = m GROUP BY m""",
)
def _monthly(t):
    return layout.monthly_applies(t("apply_events"), "2024-02-10")
