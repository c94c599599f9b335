"""Streaming queries: the job runs over the files of the test folder until they are read, its output is the result."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from smeltery.operators import alerts, workload
from smeltery.plans.monitoring_queries import _sustained_sql
from smeltery.plans.registry import query
from smeltery.session import shared_dir
from smeltery.sources.adapter import PORTABLE
from smeltery.streaming import jobs


def _source(t, name: str):
    """A raw table as a stream."""
    return jobs.file_stream(t.spark, t.folder, t(name).schema, f"{name}.parquet")


def _derived(t, name: str, raw: str):
    """A derived table over the stream of its one raw table."""
    return t.spark.sql(PORTABLE[name], **{raw: _source(t, raw)})


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def _finish(running) -> None:
    running.awaitTermination()


_LINES = """SELECT (l_orderkey + 1) * 8 + l_linenumber AS order_item_id, l_partkey + 1 AS product_id, l_quantity AS quantity, o_orderdate::DATE AS order_date
       FROM (SELECT * FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC) = 1) LEFT JOIN orders ON o_orderkey = l_orderkey"""


def _bronze_lines(t, lines):
    """Lines as they come, with the date of their order, which all versions of a line share."""
    dates = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("order_date"))
    return lines.join(dates, "l_orderkey", "left").select(
        ((F.col("l_orderkey") + 1) * 8 + F.col("l_linenumber")).alias("order_item_id"),
        (F.col("l_partkey") + 1).alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        "order_date",
        F.col("l_shipdate").alias("_load_timestamp"),
    )


def _to_silver(t, stream, base):
    _finish(
        jobs.stream_bronze_to_silver(
            stream, f"{base}/check", f"{base}/out", ["order_item_id"], lambda df: df.drop("_load_timestamp"), F.trunc("order_date", "MM")
        )
    )


@query("stream_bronze_to_silver", _LINES)
def _bronze(t):
    base = _folder(t)
    _to_silver(t, _bronze_lines(t, _source(t, "lineitem")), base)
    return jobs.read_batches(t.spark, f"{base}/out")


@query("stream_bronze_to_silver_batches", _LINES)
def _bronze_batches(t):
    """Lines in three batches; the second and third bring changed versions of lines that are there already, newer and older."""
    base, lines = _folder(t), t("lineitem")
    again = lines.withColumn("l_quantity", F.col("l_quantity") + 1000)
    newer, older = (again.withColumn("l_shipdate", F.col("l_shipdate") + F.make_dt_interval(days=F.lit(days))) for days in (9, -9))
    part = F.col("l_orderkey") % 3
    for rows in (lines.where(part == 0), lines.where(part == 1).unionByName(newer.where(part == 0)), lines.where(part == 2).unionByName(older.where(part < 2))):
        rows.write.mode("append").parquet(f"{base}/in")
        _to_silver(t, _bronze_lines(t, jobs.file_stream(t.spark, f"{base}/in", rows.schema)), base)
    return jobs.read_batches(t.spark, f"{base}/out")


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"


@query("stream_fact_incremental", _ORDERS)
def _fact(t):
    base = _folder(t)
    stream = _source(t, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    _finish(jobs.stream_fact_incremental(stream, f"{base}/check", f"{base}/out", ["o_orderkey"], F.trunc("o_orderdate", "MM")))
    return jobs.read_batches(t.spark, f"{base}/out")


@query("stream_fact_incremental_batches", _ORDERS)
def _fact_batches(t):
    """Higher ids first, then late lower ids with some of the first again, then everything again."""
    base = _folder(t)
    rows = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    high = F.col("o_orderkey") % 4 >= 2
    for part in (high, (~high & (F.col("o_orderkey") % 4 == 1)) | (F.col("o_orderkey") % 8 == 2), F.lit(True)):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        stream = jobs.file_stream(t.spark, f"{base}/in", rows.schema)
        _finish(jobs.stream_fact_incremental(stream, f"{base}/check", f"{base}/out", ["o_orderkey"], F.trunc("o_orderdate", "MM")))
    return jobs.read_batches(t.spark, f"{base}/out")


_DOUBLES = {"total_exec_time_ms", "blk_read_time_ms", "blk_write_time_ms"}


def _deltas_sql(source: str) -> str:
    grown = ", ".join(f"GREATEST(0, {c} - COALESCE(LAG({c}) OVER w, 0)) AS delta_{c}" for c in workload.COUNTERS)
    shown = ", ".join(f"delta_{c}::DOUBLE AS delta_{c}" for c in workload.COUNTERS)
    return f"SELECT queryid, snapshot_id, seen_at, {shown} FROM (SELECT queryid, snapshot_id, seen_at, {grown} FROM {source} WINDOW w AS (PARTITION BY queryid ORDER BY seen_at, snapshot_id)) WHERE delta_calls > 0"


def _as_doubles(df):
    return df.select("queryid", "snapshot_id", "seen_at", *[F.col(f"delta_{c}").cast("double").alias(f"delta_{c}") for c in workload.COUNTERS])


def _as_typed(df):
    return df.select("queryid", "snapshot_id", "seen_at", *[F.col(c).cast("double").alias(c) for c in workload.COUNTERS])


@query("stream_counter_deltas", _deltas_sql("counter_snapshots"))
def _counters(t):
    base = _folder(t)
    stream = _derived(t, "counter_snapshots", "events")
    _finish(jobs.stream_counter_deltas(stream, f"{base}/check", base, workload.counter_deltas))
    return _as_doubles(jobs.read_batches(t.spark, f"{base}/deltas"))


@query("stream_keyed_counter_deltas", _deltas_sql("counter_snapshots"))
def _keyed(t):
    """Counters as doubles per statement; the history of a busy one is cut by day, as everywhere."""
    base = _folder(t)
    stream = _as_typed(_derived(t, "counter_snapshots", "events"))
    _finish(jobs.stream_counter_deltas(stream, f"{base}/check", base, workload.counter_deltas))
    return _as_doubles(jobs.read_batches(t.spark, f"{base}/deltas"))


# Snapshots come in three slices by time; every 97th is held back and comes last, so most of those are late.
_SLICES = ("seen_at < TIMESTAMP_NTZ'2024-01-11'", "seen_at >= TIMESTAMP_NTZ'2024-01-11' AND seen_at < TIMESTAMP_NTZ'2024-01-21'", "seen_at >= TIMESTAMP_NTZ'2024-01-21'")
_IN_TIME = """(SELECT * FROM counter_snapshots c WHERE snapshot_id % 97 <> 0 OR NOT EXISTS (SELECT 1 FROM counter_snapshots d WHERE d.queryid = c.queryid AND d.snapshot_id % 97 <> 0
    AND (d.seen_at > c.seen_at OR (d.seen_at = c.seen_at AND d.snapshot_id > c.snapshot_id))))"""


@query("stream_counter_deltas_batches", _deltas_sql(_IN_TIME))
def _counter_batches(t):
    base = _folder(t)
    rows = t("counter_snapshots")
    for part in (*[f"snapshot_id % 97 <> 0 AND {s}" for s in _SLICES], "snapshot_id % 97 = 0"):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        stream = jobs.file_stream(t.spark, f"{base}/in", rows.schema)
        _finish(jobs.stream_counter_deltas(stream, f"{base}/check", base, workload.counter_deltas))
    return _as_doubles(jobs.read_batches(t.spark, f"{base}/deltas"))


# A window is written once the watermark, an hour behind the newest event, has passed its end.
_CLOSED = "(SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_hourly_dashboard", f"SELECT * FROM dashboard WHERE metric_date + INTERVAL 1 HOUR * (metric_hour + 1) <= {_CLOSED}")
def _dashboard(t):
    base = _folder(t)
    stream = _derived(t, "clickstream", "events").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    _finish(jobs.append_files(jobs.hourly_dashboard(stream, t("silver_product")), f"{base}/check", f"{base}/out"))
    return t.spark.read.parquet(f"{base}/out")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
        SELECT user_id, MIN(ts) AS start_time, MAX(ts) AS end_time, ((EPOCH_US(MAX(ts)) - EPOCH_US(MIN(ts))) // 1000000)::INTEGER AS duration_seconds, COUNT(*) AS event_count FROM s GROUP BY user_id, sid
        HAVING MAX(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def _sessions(t):
    base = _folder(t)
    stream = _source(t, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_timestamp"))
    _finish(jobs.append_files(jobs.web_sessions(stream), f"{base}/check", f"{base}/out"))
    out = t.spark.read.parquet(f"{base}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


def _closed_sustained_sql() -> str:
    """Windows that the watermark has passed: an hour behind the newest sample of the metrics that share their length."""
    parts = []
    for length in sorted({r[4] for r in alerts.SUSTAINED_RULES}):
        names = [r[0] for r in alerts.SUSTAINED_RULES if r[4] == length]
        metrics = sorted({r[1] for r in alerts.SUSTAINED_RULES if r[4] == length})
        newest = f"(SELECT MAX(observed_at) - INTERVAL 1 HOUR FROM system_metrics WHERE metric IN ({', '.join(map(repr, metrics))}))"
        parts.append(f"SELECT * FROM held WHERE rule IN ({', '.join(map(repr, names))}) AND window_end <= {newest}")
    return f"WITH held AS ({_sustained_sql()}) " + " UNION ALL ".join(parts)


@query("stream_sustained_alerts", _closed_sustained_sql())
def _sustained(t):
    base = _folder(t)
    stream = _derived(t, "system_metrics", "events").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    _finish(jobs.stream_sustained(stream, f"{base}/check", f"{base}/out"))
    lengths = sorted({r[4] for r in alerts.SUSTAINED_RULES})
    return reduce(DataFrame.unionByName, [t.spark.read.parquet(f"{base}/out/minutes={n}") for n in lengths])


@query(
    "stream_incidents",
    """SELECT 'inc_' || event_type AS incident_id, event_type AS alert_type, 'high' AS severity, 'open' AS status, MIN(ts) AS started_at, COUNT(*) AS alert_count FROM events GROUP BY event_type""",
)
def _incidents(t):
    base = _folder(t)
    _finish(jobs.stream_incidents(_alert_rows(_source(t, "events")), f"{base}/check", f"{base}/out", _no_incidents(t), "2024-01-31 00:05:00"))
    out = jobs.latest_incidents(t.spark, f"{base}/out")
    return out.select("incident_id", "alert_type", "severity", "status", "started_at", "alert_count")


@query(
    "stream_incidents_batches",
    """SELECT 'inc_' || event_type AS incident_id, event_type AS alert_type, 'high' AS severity, CASE WHEN COUNT(*) FILTER (WHERE live) > 0 THEN 'open' ELSE 'resolved' END AS status,
       COUNT(*) FILTER (WHERE live) AS alert_count
       FROM (SELECT *, NOT (event_type = 'error' OR event_id % 2 = 0) AS live FROM events) GROUP BY event_type""",
)
def _incident_batches(t):
    """One slice per event type, each a batch of its own; then errors and all even ids are resolved."""
    base = _folder(t)
    events = t("events")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    for part in (*[F.col("event_type") == k for k in kinds], None):
        over = (F.col("event_type") == "error") | (F.col("event_id") % 2 == 0)
        rows = _alert_rows(events.where(over if part is None else part))
        if part is None:
            rows = rows.withColumn("status", F.lit("resolved"))
        rows.write.mode("append").parquet(f"{base}/in")
        stream = jobs.file_stream(t.spark, f"{base}/in", rows.schema)
        _finish(jobs.stream_incidents(stream, f"{base}/check", f"{base}/out", _no_incidents(t), "2024-01-31 00:05:00"))
    return jobs.latest_incidents(t.spark, f"{base}/out").select("incident_id", "alert_type", "severity", "status", "alert_count")


def _alert_rows(events):
    return events.select(
        F.concat(F.lit("a_"), F.col("event_id").cast("string")).alias("alert_id"),
        F.col("event_type").alias("type"),
        F.lit("high").alias("severity"),
        F.lit("title").alias("title"),
        F.lit("message").alias("message"),
        F.lit(None).cast("string").alias("layer"),
        F.lit(None).cast("string").alias("table_name"),
        F.col("ts").alias("occurred_at"),
        F.lit("active").alias("status"),
    )


def _no_incidents(t):
    return t.spark.createDataFrame(
        [],
        "incident_id string, alert_type string, title string, description string, severity string, status string, started_at timestamp_ntz, "
        "resolved_at timestamp_ntz, alert_count long, affected_tables string, updated_at timestamp_ntz",
    )
