"""Query-log queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.operators import workload
from smeltery.plans.registry import query, sql_table

AS_OF = "2024-01-30"


def _count(text: str, word: str) -> str:
    return f"((LENGTH({text}) - LENGTH(REPLACE({text}, '{word}', ''))) // {len(word)})"


@query(
    "query_fingerprint",
    r"""SELECT log_id, sha256(query_text) AS query_sha,
        TRIM(regexp_replace(regexp_replace(regexp_replace(query_text, '''[^'']*''', '''?''', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')) AS template FROM query_logs""",
)
def _fingerprint(t):
    return workload.query_fingerprint(t("query_logs"))


_U = "UPPER(query_text)"
_TAIL = f"SUBSTR(query_text, STRPOS({_U}, 'WHERE'))"


def _listed(clause):
    rest = f"SUBSTR({_U}, STRPOS({_U}, '{clause}') + {len(clause)})"
    stretch = rf"regexp_extract({rest}, '(?s)^(.*?)(?:\b(?:HAVING|ORDER BY|LIMIT|OFFSET|WINDOW|UNION)\b|$)', 1)"
    return f"CASE WHEN STRPOS({_U}, '{clause}') > 0 THEN {_count(stretch, ',')} + 1 ELSE 0 END::INTEGER"


@query(
    "query_features",
    rf"""SELECT log_id, CASE WHEN UPPER(LTRIM(query_text)) LIKE 'SELECT%' THEN 'SELECT' WHEN UPPER(LTRIM(query_text)) LIKE 'INSERT%' THEN 'INSERT' WHEN UPPER(LTRIM(query_text)) LIKE 'UPDATE%' THEN 'UPDATE'
        WHEN UPPER(LTRIM(query_text)) LIKE 'DELETE%' THEN 'DELETE' WHEN UPPER(LTRIM(query_text)) LIKE 'CREATE%' THEN 'CREATE' WHEN UPPER(LTRIM(query_text)) LIKE 'ALTER%' THEN 'ALTER'
        WHEN UPPER(LTRIM(query_text)) LIKE 'DROP%' THEN 'DROP' ELSE 'OTHER' END AS query_type,
        ({_count(_U, 'FROM')} + {_count(_U, 'JOIN')})::INTEGER AS table_count, {_count(_U, 'JOIN')}::INTEGER AS join_count,
        {_U} LIKE '%COUNT%' OR {_U} LIKE '%SUM%' OR {_U} LIKE '%AVG%' OR {_U} LIKE '%MIN%' OR {_U} LIKE '%MAX%' OR {_U} LIKE '%GROUP BY%' AS has_aggregation,
        {_U} LIKE '%OVER (%' AS has_window_function, query_text LIKE '%(%' AND {_U} LIKE '%SELECT%' AS has_subquery, {_U} LIKE '%WITH%' AS has_cte,
        CASE WHEN STRPOS({_U}, 'WHERE') > 0 THEN {_count(_TAIL, 'AND')} + {_count(_TAIL, 'OR')} + 1 ELSE 0 END::INTEGER AS filter_predicate_count,
        {_listed('ORDER BY')} AS order_by_count, {_listed('GROUP BY')} AS group_by_count FROM query_logs""",
)
def _features(t):
    return workload.query_features(t("query_logs"))


_DELTAS = ", ".join(f"GREATEST(0, {c} - COALESCE(LAG({c}) OVER w, 0)) AS delta_{c}" for c in workload.COUNTERS)
_DOUBLES = {"total_exec_time_ms", "blk_read_time_ms", "blk_write_time_ms"}
_OUT = ", ".join(f"delta_{c}::{'DOUBLE' if c in _DOUBLES else 'BIGINT'} AS delta_{c}" for c in workload.COUNTERS)


@query(
    "counter_deltas",
    f"""SELECT queryid, snapshot_id, seen_at, {_OUT}, delta_total_exec_time_ms::DOUBLE / delta_calls AS mean_exec_time_ms
        FROM (SELECT queryid, snapshot_id, seen_at, {_DELTAS} FROM counter_snapshots WINDOW w AS (PARTITION BY queryid ORDER BY seen_at, snapshot_id)) WHERE delta_calls > 0""",
)
def _deltas(t):
    return workload.counter_deltas(t("counter_snapshots"))


sql_table(
    "timed_logs",
    """SELECT *, CASE WHEN c <> 0 THEN ((2 * (tot * 1000)::BIGINT * 1000 + c) // (2 * c)) / 1000000.0::DOUBLE END AS per_call
       FROM (SELECT *, COALESCE(calls, 0) AS c, COALESCE(total_exec_time_ms, mean_exec_time_ms * NULLIF(calls, 0), 0)::DECIMAL(24,3) AS tot FROM query_logs)""",
)


def _perf(source: str, keys: str) -> str:
    return f"""SELECT {keys}, SUM(c)::BIGINT AS execution_count, SUM(tot)::DOUBLE / NULLIF(SUM(c), 0)::DOUBLE AS avg_execution_time_ms,
        QUANTILE_CONT(per_call, 0.5) AS p50_execution_time_ms, QUANTILE_CONT(per_call, 0.95) AS p95_execution_time_ms, QUANTILE_CONT(per_call, 0.99) AS p99_execution_time_ms,
        SUM(tot)::DOUBLE AS total_execution_time_ms,
        CASE WHEN SUM(shared_blks_hit) + COALESCE(SUM(shared_blks_read), 0) > 0 THEN SUM(shared_blks_hit)::DOUBLE / (SUM(shared_blks_hit) + COALESCE(SUM(shared_blks_read), 0)) END AS cache_hit_rate,
        MAX(collected_at) AS last_executed, ARG_MAX(log_id, (collected_at, log_id)) AS sample_log_id FROM {source} GROUP BY {keys}"""


_TOP = " ORDER BY total_execution_time_ms DESC NULLS LAST, query_hash LIMIT 100"


@query(
    "query_performance",
    _perf("(SELECT * FROM timed_logs WHERE collected_at >= TIMESTAMP '2024-01-10' AND collected_at < TIMESTAMP '2024-01-25')", "query_hash") + _TOP,
)
def _performance(t):
    return workload.query_performance(t("query_logs"), "2024-01-10", "2024-01-25")


@query("query_performance_fallback", _perf("timed_logs", "query_hash") + _TOP)
def _performance_fallback(t):
    return workload.query_performance(t("query_logs"), "2030-01-10", "2030-01-25", all_if_empty=True)


@query("query_performance_one", _perf("(SELECT * FROM timed_logs WHERE query_hash = 'q_view_3')", "query_hash"))
def _performance_one(t):
    return workload.query_performance(t("query_logs"), "2024-01-01", "2024-02-01", query_id="q_view_3")


sql_table(
    "windowed",
    _perf(
        """(SELECT 'long' AS "window", * FROM timed_logs WHERE collected_at >= TIMESTAMP '2023-12-31' AND collected_at < TIMESTAMP '2024-01-31'
            UNION ALL SELECT '7d', * FROM timed_logs WHERE collected_at >= TIMESTAMP '2024-01-23' AND collected_at < TIMESTAMP '2024-01-31'
            UNION ALL SELECT '1d', * FROM timed_logs WHERE collected_at >= TIMESTAMP '2024-01-29' AND collected_at < TIMESTAMP '2024-01-31')""",
        '"window", query_hash',
    ),
)


@query(
    "query_performance_windows",
    "SELECT * FROM windowed",
)
def _windows(t):
    return workload.query_performance_windows(t("query_logs"), AS_OF, 30)


@query(
    "query_previews",
    "SELECT query_hash, COALESCE(ARG_MAX(COALESCE(NULLIF(TRIM(query_text), ''), NULLIF(TRIM(query_template), '')), (collected_at, log_id)), '') AS preview FROM query_logs GROUP BY 1",
)
def _previews(t):
    return workload.query_previews(t("query_logs"))


sql_table(
    "hourly",
    """SELECT h::INTEGER AS utc_hour, COALESCE(SUM(calls), 0)::DOUBLE AS total_calls FROM (SELECT UNNEST(range(24)) AS h)
       LEFT JOIN query_logs ON HOUR(collected_at) = h AND collected_at >= TIMESTAMP '2024-01-23' AND collected_at < TIMESTAMP '2024-01-31' GROUP BY h""",
)


@query("hourly_calls", "SELECT * FROM hourly")
def _hourly(t):
    return workload.hourly_calls(t("query_logs"), "2024-01-23", "2024-01-31")


@query(
    "window_rollups",
    """SELECT '1d' AS "window", COUNT(*) AS sample_rows, SUM(calls)::DOUBLE AS total_calls FROM query_logs WHERE collected_at >= TIMESTAMP '2024-01-29' AND collected_at < TIMESTAMP '2024-01-31'
       UNION ALL SELECT '7d', COUNT(*), SUM(calls)::DOUBLE FROM query_logs WHERE collected_at >= TIMESTAMP '2024-01-23' AND collected_at < TIMESTAMP '2024-01-31'""",
)
def _rollups(t):
    return workload.window_rollups(t("query_logs"), AS_OF)


@query(
    "peak_hour",
    """SELECT HOUR(collected_at)::INTEGER AS utc_hour, SUM(calls)::BIGINT AS total_calls, ARG_MAX(log_id, (collected_at, log_id)) AS sample_log_id
       FROM query_logs WHERE collected_at >= TIMESTAMP '2024-01-23' AND collected_at < TIMESTAMP '2024-01-31' GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1""",
)
def _peak(t):
    return workload.peak_hour(t("query_logs"), "2024-01-23", "2024-01-31")


@query(
    "bucket_rollup",
    """WITH b AS (SELECT (utc_hour // 6 * 6)::INTEGER AS bucket_start, SUM(total_calls) AS executions FROM hourly GROUP BY 1)
       SELECT bucket_start, printf('%02d:00–%02d:59', bucket_start, bucket_start + 5) AS label, executions,
         bucket_start = (SELECT bucket_start FROM b ORDER BY executions DESC, bucket_start LIMIT 1) AS is_peak FROM b""",
)
def _buckets(t):
    return workload.bucket_rollup(workload.hourly_calls(t("query_logs"), "2024-01-23", "2024-01-31"), 6)


sql_table("perf_all", _perf("timed_logs", "query_hash"))


def _kpi_sql(source: str) -> str:
    return f"""WITH r AS (SELECT execution_count AS c, ROUND(avg_execution_time_ms, 6)::DECIMAL(24,6) AS a, COALESCE(ROUND(p95_execution_time_ms, 6), 0)::DECIMAL(24,6) AS p FROM {source}),
        cut AS (SELECT (SELECT a FROM (SELECT a, ROW_NUMBER() OVER (ORDER BY a) - 1 AS i, COUNT(*) OVER () AS n FROM r WHERE a > 0) WHERE i = FLOOR((n - 1) * 0.8::DOUBLE)) AS ca,
                (SELECT p FROM (SELECT p, ROW_NUMBER() OVER (ORDER BY p) - 1 AS i, COUNT(*) OVER () AS n FROM r WHERE p > 0) WHERE i = FLOOR((n - 1) * 0.8::DOUBLE)) AS cp,
                (SELECT a FROM (SELECT a, ROW_NUMBER() OVER (ORDER BY a) - 1 AS i, COUNT(*) OVER () AS n FROM r) WHERE i = n // 2) AS med, (SELECT BOOL_OR(a >= 1000 OR p >= 2000) FROM r) AS absolute),
        m AS (SELECT r.*, CASE WHEN absolute THEN a >= 1000 OR p >= 2000 ELSE a >= ca OR p >= cp END AS slow FROM r, cut)
        SELECT SUM(c)::BIGINT AS total_executions, COUNT(*) AS distinct_queries, COUNT(*) FILTER (WHERE slow) AS slow_distinct, SUM(CASE WHEN slow THEN c ELSE 0 END)::DOUBLE / SUM(c)::DOUBLE AS slow_execution_share,
          SUM(a * c)::DOUBLE / SUM(c)::DOUBLE AS weighted_avg_latency_ms, (SELECT med FROM cut)::DOUBLE AS median_avg_latency_ms FROM m"""


@query("workload_kpis", _kpi_sql("perf_all"))
def _kpis(t):
    return workload.workload_kpis(workload.query_performance(t("query_logs"), "2023-01-01", "2025-01-01", limit=None))


# Statements a thousand times faster: nothing is slow, the top fifth stands in.
sql_table(
    "perf_fast",
    "SELECT query_hash, execution_count, avg_execution_time_ms / 1000 AS avg_execution_time_ms, p95_execution_time_ms / 1000 AS p95_execution_time_ms FROM perf_all",
)


@query("workload_kpis_fast", _kpi_sql("perf_fast"))
def _kpis_fast(t):
    perf = workload.query_performance(t("query_logs"), "2023-01-01", "2025-01-01", limit=None)
    fast = perf.withColumns({c: F.col(c) / 1000 for c in ("avg_execution_time_ms", "p95_execution_time_ms")})
    return workload.workload_kpis(fast)


@query(
    "weighted_cache_hit_rate",
    "SELECT SUM(cache_hit_rate * execution_count) / SUM(CASE WHEN cache_hit_rate IS NOT NULL THEN execution_count END)::DOUBLE AS weighted_cache_hit_rate FROM perf_all WHERE execution_count > 0",
)
def _weighted(t):
    return workload.weighted_cache_hit_rate(
        workload.query_performance(t("query_logs"), "2023-01-01", "2025-01-01", limit=None)
    )


@query(
    "hotspots",
    """WITH j AS (SELECT query_hash, o.avg_execution_time_ms AS a1, s.avg_execution_time_ms AS a7, l.avg_execution_time_ms AS al, COALESCE(o.execution_count, s.execution_count, l.execution_count) AS runs,
           COALESCE(o.sample_log_id, s.sample_log_id, l.sample_log_id) AS sample_log_id FROM (SELECT * FROM windowed WHERE "window" = '1d') o
           FULL OUTER JOIN (SELECT * FROM windowed WHERE "window" = '7d') s USING (query_hash) FULL OUTER JOIN (SELECT * FROM windowed WHERE "window" = 'long') l USING (query_hash)),
       g AS (SELECT *, CASE WHEN al > 0 THEN al WHEN a7 > 0 THEN a7 END AS base FROM j),
       h AS (SELECT *, CASE WHEN base IS NULL THEN CASE WHEN a1 > 0 THEN 100 ELSE 0 END WHEN a1 IS NULL THEN 0 ELSE (a1 - base) / base * 100 END::DOUBLE AS growth_pct FROM g)
       SELECT query_hash, runs, a1 AS avg_ms_1d, a7 AS avg_ms_7d, al AS avg_ms_long, growth_pct,
         GREATEST(0, COALESCE(a1, a7, al, 0) / 1000 * GREATEST(1, runs)) * (1 + GREATEST(0, growth_pct) / 100) AS impact_score, sample_log_id FROM h ORDER BY impact_score DESC, query_hash LIMIT 13""",
)
def _hotspots(t):
    return workload.hotspots(workload.query_performance_windows(t("query_logs"), AS_OF, 30))


def _json(key, kind, default):
    return f"COALESCE(CASE WHEN json_valid(extracted_features) THEN TRY_CAST(json_extract_string(extracted_features, '$.{key}') AS {kind}) END, {default})"


sql_table(
    "featured",
    f"""SELECT *, {_json('query_type', 'VARCHAR', "'UNKNOWN'")} AS query_type, {_json('join_count', 'INTEGER', 0)} AS join_count, {_json('filter_predicate_count', 'INTEGER', 0)} AS filter_predicate_count,
        {_json('has_aggregation', 'BOOLEAN', 'FALSE')}::INTEGER AS has_aggregation, {_json('has_window_function', 'BOOLEAN', 'FALSE')}::INTEGER AS has_window_function, {_json('has_subquery', 'BOOLEAN', 'FALSE')}::INTEGER AS has_subquery
        FROM query_logs""",
)


@query("query_type_distribution", "SELECT query_type, COUNT(*) AS queries FROM featured GROUP BY 1")
def _kinds(t):
    return workload.query_type_distribution(t("query_logs"))


@query(
    "complexity_stats",
    """SELECT COUNT(*) AS count, AVG(s) AS mean, STDDEV_SAMP(s) AS std, MIN(s) AS min, MAX(s) AS max, QUANTILE_CONT(s, 0.25) AS p25, QUANTILE_CONT(s, 0.5) AS p50, QUANTILE_CONT(s, 0.75) AS p75
       FROM (SELECT (join_count * 2 + has_aggregation * 2 + has_subquery * 3 + has_window_function * 2 + filter_predicate_count * 0.5)::DOUBLE AS s FROM featured)""",
)
def _complexity(t):
    return workload.complexity_stats(t("query_logs"))


@query(
    "time_histograms",
    """SELECT 'hour' AS unit, HOUR(collected_at)::INTEGER AS slot, SUM(calls)::BIGINT AS calls FROM query_logs GROUP BY 2
       UNION ALL SELECT 'weekday', (ISODOW(collected_at) - 1)::INTEGER, SUM(calls)::BIGINT FROM query_logs GROUP BY 2""",
)
def _histograms(t):
    return workload.time_histograms(t("query_logs"))


@query(
    "workload_totals",
    """SELECT COUNT(*) AS total_queries, COUNT(DISTINCT query_hash) AS unique_query_templates, SUM(mean_exec_time_ms)::DOUBLE / COUNT(mean_exec_time_ms) AS avg_execution_time_ms,
       SUM(total_exec_time_ms)::DOUBLE AS total_execution_time_ms, SUM(calls)::DOUBLE / COUNT(calls) AS avg_calls FROM query_logs""",
)
def _totals(t):
    return workload.workload_totals(t("query_logs"))


@query(
    "workload_classes",
    """WITH s AS (SELECT SUM(has_aggregation + has_window_function + join_count) AS olap, COUNT(*) FILTER (WHERE query_type = 'SELECT') + COUNT(*) FILTER (WHERE join_count = 0) AS oltp,
           AVG(mean_exec_time_ms) AS ms, AVG(calls) AS c FROM featured)
       SELECT CASE WHEN olap > oltp * 1.5 THEN 'OLAP' WHEN oltp > olap * 1.5 THEN 'OLTP' ELSE 'MIXED' END AS oltp_vs_olap, CASE WHEN ms < 100 THEN 'LIGHT' WHEN ms > 1000 THEN 'HEAVY' ELSE 'MODERATE' END AS light_vs_heavy,
         CASE WHEN c > 100 THEN 'SCHEDULED' ELSE 'AD_HOC' END AS ad_hoc_vs_scheduled FROM s""",
)
def _classes(t):
    return workload.workload_classes(t("query_logs"))


_SAMPLE = "(SELECT * FROM timed_logs WHERE TRIM(query_text) <> '' AND (COALESCE(mean_exec_time_ms, 0) > 0 OR COALESCE(calls, 0) > 0))"


@query(
    "sample_quality",
    f"SELECT COUNT(*) AS sampled_rows, COUNT(*) FILTER (WHERE extracted_features IS NULL) AS missing_extracted_features, MAX(collected_at) AS data_watermark_utc FROM {_SAMPLE}",
)
def _quality(t):
    return workload.sample_quality(t("query_logs"))


@query(
    "cache_candidate_base",
    f"""SELECT query_text AS query_preview, COUNT(*) AS sample_count, SUM(c)::DOUBLE AS calls_sum, SUM(tot)::DOUBLE / NULLIF(SUM(c)::DOUBLE, 0) AS mean_exec_ms
        FROM {_SAMPLE} GROUP BY query_text""",
)
def _cache_base(t):
    return workload.cache_candidate_base(t("query_logs"))


sql_table(
    "cache_feats",
    """SELECT query_text, COUNT(*) AS sample_count, GREATEST(SUM(calls)::DOUBLE, COUNT(*)::DOUBLE) AS calls_sum,
       CASE WHEN SUM(calls) > 0 THEN SUM(CASE WHEN COALESCE(total_exec_time_ms, 0) > 0 THEN total_exec_time_ms ELSE mean_exec_time_ms * calls END::DECIMAL(24,3))::DOUBLE / SUM(calls)::DOUBLE ELSE SUM(mean_exec_time_ms)::DOUBLE / COUNT(*) END AS mean_exec_ms,
       MAX(COALESCE(max_exec_time_ms, 0))::DOUBLE AS max_exec_ms, SUM(rows_affected)::DOUBLE / COUNT(*) AS mean_rows_affected,
       COALESCE(AVG(CASE WHEN shared_blks_hit + COALESCE(shared_blks_read, 0) <> 0 THEN shared_blks_hit::DOUBLE / (shared_blks_hit + COALESCE(shared_blks_read, 0)) END), 0) AS mean_hit_ratio,
       ARG_MAX(log_id, (collected_at, log_id)) AS sample_log_id FROM query_logs GROUP BY query_text""",
)


@query("cache_features", "SELECT * FROM cache_feats")
def _cache_features(t):
    return workload.cache_features(t("query_logs"))


@query(
    "cache_heuristic",
    """SELECT query_text AS query_preview, LEAST(0.99::DOUBLE, LEAST(calls_sum / 100, 1) * 0.6::DOUBLE + LEAST(mean_exec_ms / 1000, 1) * 0.4::DOUBLE) AS cache_probability,
       sample_count, calls_sum, mean_exec_ms, sample_log_id FROM cache_feats WHERE LEAST(0.99::DOUBLE, LEAST(calls_sum / 100, 1) * 0.6::DOUBLE + LEAST(mean_exec_ms / 1000, 1) * 0.4::DOUBLE) >= 0.7::DOUBLE""",
)
def _cache_heuristic(t):
    return workload.cache_heuristic(workload.cache_features(t("query_logs")))


# Scenario = event type; the optimized variant is the later half of the month.
sql_table(
    "latencies",
    "SELECT event_type AS scenario, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'optimized' END AS variant, value::DECIMAL(12,3) AS latency_ms FROM events",
)
sql_table(
    "compared",
    """WITH o AS (SELECT scenario, variant, latency_ms::DOUBLE AS v, ROW_NUMBER() OVER (PARTITION BY scenario, variant ORDER BY latency_ms) - 1 AS i, COUNT(*) OVER (PARTITION BY scenario, variant) AS n FROM latencies),
       s AS (SELECT scenario, variant, (MAX(CASE WHEN i = (n - 1) // 2 THEN v END) + MAX(CASE WHEN i = n // 2 THEN v END)) / 2 AS p50, MAX(CASE WHEN i = FLOOR(n * 0.95::DOUBLE) THEN v END) AS p95, MAX(CASE WHEN i = FLOOR(n * 0.99::DOUBLE) THEN v END) AS p99 FROM o GROUP BY ALL),
       r AS (SELECT b.scenario, (b.p50 - n.p50) / b.p50 * 100 AS a, (b.p95 - n.p95) / b.p95 * 100 AS b2, (b.p99 - n.p99) / b.p99 * 100 AS c FROM s b JOIN s n ON n.scenario = b.scenario AND b.variant = 'baseline' AND n.variant = 'optimized')
       SELECT scenario, a AS p50_reduction_pct, b2 AS p95_reduction_pct, c AS p99_reduction_pct, (a + b2 + c) / 3 AS average_improvement_pct FROM r""",
)


def _compared(t):
    variant = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "baseline").otherwise("optimized")
    latencies = t("events").select(
        F.col("event_type").alias("scenario"), variant.alias("variant"), F.col("value").cast("decimal(12,3)").alias("latency_ms")
    )
    return workload.before_after(latencies)


@query("before_after", "SELECT * FROM compared")
def _before_after(t):
    return _compared(t)


@query(
    "improvement_summary",
    "SELECT COUNT(*) AS scenarios, AVG(average_improvement_pct) AS average, MIN(average_improvement_pct) AS minimum, MAX(average_improvement_pct) AS maximum FROM compared",
)
def _improvement(t):
    return workload.improvement_summary(_compared(t))
