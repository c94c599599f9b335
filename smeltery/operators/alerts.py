"""Alert rules, incidents, rule anomalies and sustained thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from smeltery.functions.exprs import stable_id
from smeltery.operators.monitoring import at, days_back, seconds_between
from smeltery.session import durable

GIB = 1024**3
# Alert type, enabled, severity, threshold.
DEFAULT_RULES = (
    ("empty_table", True, "medium", 0.0),
    ("data_quality", True, "medium", 10.0),
    ("performance", True, "low", 70.0),
    ("storage", True, "info", 5.0),
    ("etl_failure", True, "high", 0.0),
    ("model_anomaly", True, "medium", 0.0),
    ("slow_query", True, "high", 5.0),
)
# Rule, metric, comparison, threshold, minutes it must hold, severity.
SUSTAINED_RULES = (
    ("HighCPUUsage", "cpu_percent", ">", 80.0, 5, "warning"),
    ("HighMemoryUsage", "memory_percent", ">", 85.0, 5, "warning"),
    ("TooManyConnections", "connections", ">", 180.0, 5, "warning"),
    ("SlowQueries", "mean_exec_time_ms", ">", 5000.0, 10, "warning"),
    ("LowCacheHitRate", "cache_hit_percent", "<", 70.0, 15, "warning"),
    ("DiskSpaceWarning", "disk_percent", ">", 80.0, 5, "warning"),
    ("DiskSpaceCritical", "disk_percent", ">", 90.0, 2, "critical"),
    ("HighPredictionError", "prediction_error_rate", ">", 0.10, 10, "warning"),
    ("HighAPIErrorRate", "api_error_rate", ">", 0.05, 5, "warning"),
    ("HighAPILatency", "p95_latency_ms", ">", 1000.0, 10, "warning"),
)
COLUMNS = ("alert_id", "type", "severity", "title", "message", "layer", "table_name", "occurred_at", "status")


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "alert_type string, enabled boolean, severity string, threshold double")


def _clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def _text(number: Column, digits: int) -> Column:
    return F.round(number, digits).cast("string")


def _alert(df: DataFrame, kind: str, severity: str, ident, title, message, when, layer=None, table=None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return df.select(
        ident.alias("alert_id"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        title.alias("title"),
        message.alias("message"),
        (layer if layer is not None else nothing).alias("layer"),
        (table if table is not None else nothing).alias("table_name"),
        when.alias("occurred_at"),
        F.lit("active").alias("status"),
    )


def _newest(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def alerts_active(
    stats: DataFrame,
    runs: DataFrame,
    jobs: DataFrame,
    logs: DataFrame,
    acknowledged: DataFrame,
    now,
    rules: Sequence[tuple[str, bool, str, float]] = DEFAULT_RULES,
    anomalies: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All rules' alerts without the acknowledged ones. ``limit`` keeps the newest of a rule; None keeps all."""
    ruled = {kind: (severity, threshold) for kind, enabled, severity, threshold in rules if enabled}
    name = F.concat_ws(".", "layer", "table_name")
    table, layer = F.col("table_name"), F.col("layer")
    parts: list[DataFrame] = []
    if "empty_table" in ruled:
        severity, _ = ruled["empty_table"]
        parts.append(
            _alert(
                stats.where(F.col("live") == 0),
                "empty_table",
                severity,
                F.concat(F.lit("empty_table_"), layer, F.lit("_"), table),
                F.concat(F.lit("Empty table detected: "), name),
                F.format_string("The table %s in %s layer has no data. ETL process may have failed.", table, layer),
                at(now),
            )
        )
    if "data_quality" in ruled:
        severity, threshold = ruled["data_quality"]
        ratio = F.when(F.col("live") + F.col("dead") != 0, F.col("dead").cast("double") / (F.col("live") + F.col("dead")))
        parts.append(
            _alert(
                stats.where(ratio > _clamp(threshold / 100.0, 0.0001, 0.99)),
                "data_quality",
                severity,
                F.concat(F.lit("dead_tuples_"), layer, F.lit("_"), table),
                F.concat(F.lit("High dead tuple ratio: "), name),
                F.concat(F.lit("Table "), table, F.lit(" has "), _text(ratio * 100, 2), F.lit("% dead tuples.")),
                at(now),
            )
        )
    if "performance" in ruled:
        severity, threshold = ruled["performance"]
        total = F.col("hits") + F.col("reads")
        rate = F.when(total != 0, F.col("hits").cast("double") / total)
        parts.append(
            _alert(
                stats.where((rate < _clamp(threshold / 100.0, 0.01, 0.999)) & (total > 1000)),
                "performance",
                severity,
                F.concat(F.lit("cache_poor_"), layer, F.lit("_"), table),
                F.concat(F.lit("Low cache hit rate: "), name),
                F.concat(F.lit("Table "), table, F.lit(" has only "), _text(rate * 100, 2), F.lit("% cache hit rate.")),
                at(now),
            )
        )
    if "storage" in ruled:
        severity, threshold = ruled["storage"]
        big = stats.where(F.col("bytes") > int(_clamp(threshold, 0.1, 10000.0) * GIB))
        parts.append(
            _alert(
                _newest(big, limit, F.col("bytes").desc(), layer, table),
                "storage",
                severity,
                F.concat(F.lit("large_table_"), layer, F.lit("_"), table),
                F.concat(F.lit("Large table: "), name),
                F.concat(F.lit("Table "), table, F.lit(" is "), _text(F.col("bytes") / F.lit(float(GIB)), 2), F.lit(" GB.")),
                at(now),
            )
        )
    if "etl_failure" in ruled:
        severity, _ = ruled["etl_failure"]
        failed = runs.where(F.col("status").isin("failed", "error") & (F.col("started_at") >= days_back(now, 1)))
        failed = failed.join(jobs.select("job_id", "job_name"), "job_id")
        where = F.coalesce(F.concat(F.lit(" for table "), table), F.lit(""))
        error = F.coalesce(F.concat(F.lit(" Error: "), F.col("error_message")), F.lit(""))
        parts.append(
            _alert(
                _newest(failed, limit, F.col("started_at").desc(), F.col("run_id")),
                "etl_failure",
                severity,
                F.concat(F.lit("etl_"), F.col("status"), F.lit("_"), F.col("run_id")),
                F.concat(F.lit("ETL job "), F.col("status"), F.lit(": "), F.col("job_name")),
                F.concat(
                    F.lit("ETL job '"),
                    F.col("job_name"),
                    F.lit("' on layer "),
                    F.coalesce(layer, F.lit("unknown")),
                    where,
                    F.lit(" finished with status "),
                    F.upper("status"),
                    F.lit("."),
                    error,
                ),
                F.col("started_at"),
                layer,
                table,
            )
        )
    if "model_anomaly" in ruled and anomalies is not None:
        parts.append(anomalies.select(*COLUMNS))
    if "slow_query" in ruled:
        severity, threshold = ruled["slow_query"]
        slow = slow_queries(logs, now, _clamp(threshold, 0.1, 3600.0) * 1000.0, limit)
        text = F.coalesce("query_text", F.lit(""))
        parts.append(
            _alert(
                slow,
                "slow_query",
                severity,
                F.concat(F.lit("slow_q_"), stable_id(text, F.lit("|"), F.coalesce(F.col("collected_at").cast("string"), F.lit("")), F.lit("|"), F.col("log_id").cast("string"))),
                F.concat(F.lit("Slow query ("), _text(F.col("mean_exec_time_ms").cast("double"), 0), F.lit(" ms mean)")),
                F.when(text == "", "Query exceeded configured duration threshold.").otherwise(text),
                F.col("collected_at"),
            )
        )
    union = reduce(lambda a, b: a.unionByName(b), parts)
    # Ids compress so well that adaptive execution would take them all into one sort; a number given keeps the tasks apart.
    tasks = int(union.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = acknowledged.select("alert_id").repartition(tasks, "alert_id")
    return union.repartition(tasks, "alert_id").join(known, "alert_id", "left_anti").select(*COLUMNS)


def slow_queries(logs: DataFrame, now, threshold_ms: float, limit: int | None = None) -> DataFrame:
    """Logged statements over the threshold in the last day."""
    slow = logs.where((F.col("mean_exec_time_ms") > threshold_ms) & (F.col("collected_at") >= days_back(now, 1)))
    return _newest(slow, limit, F.col("collected_at").desc_nulls_last(), F.col("log_id"))


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def alert_sums(alerts: DataFrame, keys: Sequence[str] = ("type",)) -> DataFrame:
    """Per keys: highest severity level, whether one is active, start, count, the first five tables by alert id."""
    level = F.when(F.col("severity").isin("critical", "high"), 3).when(F.col("severity") == "medium", 2).otherwise(1)
    sums = alerts.groupBy(*keys).agg(
        F.max(level).alias("_level"),
        F.max(F.col("status") == "active").alias("_open"),
        F.min("occurred_at").alias("started_at"),
        F.count("*").alias("alert_count"),
    )
    # Rank-limited before it is collected: five rows per group, whatever the group holds.
    first = W.partitionBy(*keys).orderBy("alert_id")
    five = (
        alerts.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= 5)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("alert_id", F.coalesce("table_name", "title").alias("t")))).alias("_five"))
    )
    return sums.join(five, list(keys))


def merged_sums(parts: DataFrame) -> DataFrame:
    """Sums per type from the sums of parts of the alerts; at most five names a part are brought together."""
    return parts.where("type IS NOT NULL").groupBy("type").agg(
        F.max("_level").alias("_level"),
        F.max("_open").alias("_open"),
        F.min("started_at").alias("started_at"),
        F.sum("alert_count").alias("alert_count"),
        F.slice(F.array_sort(F.flatten(F.collect_list("_five"))), 1, 5).alias("_five"),
    )


def incident_rows(sums: DataFrame) -> DataFrame:
    """One incident per alert type."""
    words = F.replace(F.col("type"), F.lit("_"), F.lit(" "))
    return sums.where("type IS NOT NULL").select(
        F.concat(F.lit("inc_"), F.col("type")).alias("incident_id"),
        F.col("type").alias("alert_type"),
        F.concat(F.initcap(words), F.lit(" — grouped alerts")).alias("title"),
        F.concat(F.col("alert_count").cast("string"), F.lit(' active signal(s) of type "'), words, F.lit('".')).alias(
            "description"
        ),
        F.when(F.col("_level") == 3, "high").when(F.col("_level") == 2, "medium").otherwise("low").alias("severity"),
        F.when(F.col("_open"), "open").otherwise("resolved").alias("status"),
        "started_at",
        "alert_count",
        F.array_join(F.transform("_five", lambda s: s["t"]), ", ").alias("affected_tables"),
    )


def incidents_sync(existing: DataFrame, alerts: DataFrame, run_ts) -> DataFrame:
    """Incidents after the current alerts: known ones updated, new ones opened, vanished types resolved.

    The alerts are stored once: their sums and their first five are read from what is there, not from all inputs again.
    """
    held = durable(alerts.select("type", "alert_id", "severity", "status", "occurred_at", "table_name", "title"))
    return sync_incidents(existing, incident_rows(alert_sums(held)), run_ts)


def sync_incidents(existing: DataFrame, current: DataFrame, run_ts) -> DataFrame:
    now = at(run_ts)
    old, new = existing.alias("o"), current.alias("n")
    joined = old.join(new, F.col("o.incident_id") == F.col("n.incident_id"), "full_outer")
    seen = F.col("n.incident_id").isNotNull()
    closing = ~seen & (F.col("o.status") == "open")

    def take(column: str) -> Column:
        return F.when(seen, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column)

    status = F.when(seen, F.col("n.status")).when(closing, "resolved").otherwise(F.col("o.status"))
    resolved = (
        F.when(seen & (F.col("n.status") == "open"), F.lit(None).cast("timestamp_ntz"))
        .when(seen | closing, F.coalesce("o.resolved_at", now))
        .otherwise(F.col("o.resolved_at"))
    )
    return joined.select(
        F.coalesce("n.incident_id", "o.incident_id").alias("incident_id"),
        F.coalesce("n.alert_type", "o.alert_type").alias("alert_type"),
        take("title"),
        take("description"),
        take("severity"),
        status.alias("status"),
        F.when(seen, F.least("o.started_at", "n.started_at")).otherwise(F.col("o.started_at")).alias("started_at"),
        resolved.alias("resolved_at"),
        F.when(seen, F.col("n.alert_count")).when(closing, 0).otherwise(F.col("o.alert_count")).alias("alert_count"),
        take("affected_tables"),
        F.when(seen | closing, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def incidents_view(incidents: DataFrame, now, limit: int | None = None) -> DataFrame:
    """Open incidents and those resolved within a day; ``limit`` keeps the newest."""
    shown = incidents.where(
        (F.col("status") == "open") | ((F.col("status") == "resolved") & (F.col("resolved_at") >= days_back(now, 1)))
    )
    order = [F.coalesce("started_at", "updated_at").desc_nulls_last(), F.col("updated_at").desc(), F.col("incident_id")]
    return shown if limit is None else shown.orderBy(*order).limit(limit)


def anomalies_rules(stats: DataFrame, runs: DataFrame, jobs: DataFrame, now, top: int | None = None) -> DataFrame:
    """Failed runs of a week; tables far behind in inserts; tables with outsized rows.

    ``top`` compares the tables of most inserts and bytes only; by default all are looked at.
    """
    failed = runs.where((F.col("status") == "failed") & (F.col("started_at") >= days_back(now, 7)))
    failed = failed.join(jobs.select("job_id", "job_name"), "job_id")
    nothing = F.lit(None).cast("double")
    target = F.concat(F.coalesce("layer", F.lit("unknown")), F.lit("."), F.coalesce("table_name", F.lit("unknown")))
    by_run = failed.select(
        F.concat(F.lit("anomaly_etl_failure_"), F.col("run_id")).alias("anomaly_id"),
        F.lit("etl_failure").alias("type"),
        F.lit("high").alias("severity"),
        F.when(F.col("layer").isNotNull() | F.col("table_name").isNotNull(), target).alias("table_name"),
        nothing.alias("expected_value"),
        nothing.alias("actual_value"),
        F.col("started_at").alias("occurred_at"),
    )
    most = _newest(stats, top, F.col("inserts").desc_nulls_last(), F.col("layer"), F.col("table_name"))
    mean = most.agg(F.sum("inserts").cast("double") / F.count("*")).scalar()
    name = F.concat_ws(".", "layer", "table_name")
    lagging = most.where((F.col("inserts") > 0) & (F.col("inserts") < mean * 0.1) & (mean > 1000)).select(
        F.concat(F.lit("anomaly_inserts_"), F.col("layer"), F.lit("_"), F.col("table_name")).alias("anomaly_id"),
        F.lit("insert_rate_drop").alias("type"),
        F.lit("medium").alias("severity"),
        name.alias("table_name"),
        F.round(mean, 2).alias("expected_value"),
        F.col("inserts").cast("double").alias("actual_value"),
        at(now).alias("occurred_at"),
    )
    big = _newest(stats.where("live > 0"), top, F.col("bytes").desc_nulls_last(), F.col("layer"), F.col("table_name"))
    width = F.col("bytes").cast("double") / F.col("live")
    usual = big.agg(F.sum(width.cast("decimal(28,8)")).cast("double") / F.count("*")).scalar()
    wide = big.where((width > usual * 2) & (usual > 0)).select(
        F.concat(F.lit("anomaly_size_"), F.col("layer"), F.lit("_"), F.col("table_name")).alias("anomaly_id"),
        F.lit("unusual_row_size").alias("type"),
        F.lit("low").alias("severity"),
        name.alias("table_name"),
        F.round(usual, 2).alias("expected_value"),
        F.round(width, 2).alias("actual_value"),
        at(now).alias("occurred_at"),
    )
    return by_run.unionByName(lagging).unionByName(wide)


def alert_history(alerts: DataFrame, runs: DataFrame, jobs: DataFrame, now, days: int = 30) -> DataFrame:
    """Failed runs of the last days and the active alerts, with the time to resolution."""
    since = max(1, min(365, days))
    failed = runs.where(F.col("status").isin("failed", "error") & (F.col("started_at") >= days_back(now, since)))
    failed = failed.join(jobs.select("job_id", "job_name"), "job_id")
    past = failed.select(
        F.concat(F.lit("hist_etl_"), F.col("run_id")).alias("alert_id"),
        F.lit("etl_failure").alias("type"),
        F.lit("high").alias("severity"),
        F.concat(F.lit("ETL "), F.col("status"), F.lit(": "), F.coalesce("job_name", "run_id")).alias("title"),
        F.coalesce("error_message", F.lit("Run failed")).alias("message"),
        F.col("started_at").alias("occurred_at"),
        F.col("completed_at").alias("resolved_at"),
        seconds_between(F.col("started_at"), F.col("completed_at")).alias("resolution_time_seconds"),
        F.lit("failed").alias("status"),
    )
    present = alerts.select(
        "alert_id",
        "type",
        "severity",
        "title",
        "message",
        "occurred_at",
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("double").alias("resolution_time_seconds"),
        "status",
    )
    return past.unionByName(present)


def sustained_alerts(metrics: DataFrame, rules=SUSTAINED_RULES) -> DataFrame:
    """Windows as long as a rule demands, one from each minute, in which every sample breaks its threshold.

    One scan: samples become extremes per host, metric and minute, and only these minutes are laid into the
    windows of the rules for their metric.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(metric).alias("metric"),
                F.lit(op).alias("op"),
                F.lit(float(threshold)).alias("threshold"),
                F.lit(int(minutes)).alias("minutes"),
                F.lit(severity).alias("severity"),
            )
            for name, metric, op, threshold, minutes, severity in rules
        ]
    )
    wanted = sorted({metric for _, metric, *_ in rules})
    per_minute = (
        metrics.where(F.col("metric").isin(wanted))
        .groupBy("host", "metric", F.date_trunc("minute", "observed_at").alias("minute"))
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    )
    met = per_minute.select("host", "metric", "minute", "low", "high", "n", F.explode(F.filter(listed, lambda r: r["metric"] == F.col("metric"))).alias("r"))
    laid = met.select("host", "minute", "low", "high", "n", "r", F.explode(F.sequence(F.lit(0), F.col("r.minutes") - 1)).alias("back"))
    start = F.col("minute") - F.make_dt_interval(mins=F.col("back"))
    spans = laid.groupBy("r", "host", start.alias("start")).agg(
        F.min("low").alias("lowest"), F.max("high").alias("highest"), F.sum("n").alias("samples")
    )
    breach = F.when(F.col("r.op") == ">", F.col("lowest") > F.col("r.threshold")).otherwise(F.col("highest") < F.col("r.threshold"))
    return spans.where(breach).select(
        F.col("r.rule").alias("rule"),
        F.col("r.severity").alias("severity"),
        "host",
        F.col("start").cast("timestamp_ntz").alias("window_start"),
        (F.col("start") + F.make_dt_interval(mins=F.col("r.minutes"))).cast("timestamp_ntz").alias("window_end"),
        "samples",
    )
