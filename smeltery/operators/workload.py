"""Analytics over the query log: fingerprints, features, counter deltas, latency, hotspots, cache candidates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from smeltery.functions.exprs import ratio, trimmed
from smeltery.functions.keyed import previous_in_key
from smeltery.functions.ordered import order_statistics, percentiles_cont
from smeltery.operators.monitoring import at
from smeltery.session import durable

# Statement kinds, aggregate words, thresholds.
STATEMENT_KINDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
AGGREGATE_WORDS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP BY")
NEXT_CLAUSE = r"(?s)^(.*?)(?:\b(?:HAVING|ORDER BY|LIMIT|OFFSET|WINDOW|UNION)\b|$)"
SLOW_AVG_MS = Decimal("1000")
SLOW_P95_MS = Decimal("2000")
COUNTERS = (
    "calls",
    "total_exec_time_ms",
    "rows_affected",
    "shared_blks_hit",
    "shared_blks_read",
    "shared_blks_dirtied",
    "shared_blks_written",
    "local_blks_hit",
    "local_blks_read",
    "local_blks_dirtied",
    "local_blks_written",
    "temp_blks_read",
    "temp_blks_written",
    "blk_read_time_ms",
    "blk_write_time_ms",
)
FEATURES = T.StructType(
    [
        T.StructField("query_type", T.StringType()),
        T.StructField("table_count", T.IntegerType()),
        T.StructField("join_count", T.IntegerType()),
        T.StructField("has_aggregation", T.BooleanType()),
        T.StructField("has_window_function", T.BooleanType()),
        T.StructField("has_subquery", T.BooleanType()),
        T.StructField("has_cte", T.BooleanType()),
        T.StructField("filter_predicate_count", T.IntegerType()),
        T.StructField("order_by_count", T.IntegerType()),
        T.StructField("group_by_count", T.IntegerType()),
        T.StructField("estimated_rows", T.DoubleType()),
        T.StructField("estimated_cost", T.DoubleType()),
        T.StructField("plan_depth", T.IntegerType()),
    ]
)


# Text ---------------------------------------------------------------------------------


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(text: Column) -> Column:
    """Literals and whole numbers as placeholders."""
    quoted = F.regexp_replace(text, "'[^']*'", "'?'")
    return squash(F.regexp_replace(quoted, r"\b\d+\b", "?"))


def query_fingerprint(logs: DataFrame) -> DataFrame:
    """SHA-256 of the text and its template."""
    return logs.select(
        "log_id", F.sha2("query_text", 256).alias("query_sha"), fingerprint(F.col("query_text")).alias("template")
    )


def _occurrences(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(word))


def _listed_after(text: Column, upper: Column, clause: str) -> Column:
    """Commas from the clause to the next one, plus one; 0 without the clause."""
    spot = F.locate(clause, upper)
    rest = F.substr(upper, spot + F.lit(len(clause)))
    stretch = F.regexp_extract(rest, NEXT_CLAUSE, 1)
    return F.when(spot > 0, _occurrences(stretch, ",") + 1).otherwise(0)


def statement_kind(text: Column) -> Column:
    start = F.upper(F.regexp_replace(text, r"^\s+", ""))
    chain = None
    for kind in STATEMENT_KINDS:
        hit = start.startswith(kind)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("OTHER")


def query_features(logs: DataFrame) -> DataFrame:
    """Text heuristics per statement: AND and OR count in their own letter case, words by their letters."""
    text = F.col("query_text")
    upper = F.upper(text)
    aggregated = F.lit(False)
    for word in AGGREGATE_WORDS:
        aggregated = aggregated | upper.contains(word)
    spot = F.locate("WHERE", upper)
    tail = F.substr(text, spot)
    predicates = F.when(spot > 0, _occurrences(tail, "AND") + _occurrences(tail, "OR") + 1).otherwise(0)
    joins = _occurrences(upper, "JOIN")
    return logs.select(
        "log_id",
        statement_kind(text).alias("query_type"),
        (_occurrences(upper, "FROM") + joins).alias("table_count"),
        joins.alias("join_count"),
        aggregated.alias("has_aggregation"),
        upper.contains("OVER (").alias("has_window_function"),
        (text.contains("(") & upper.contains("SELECT")).alias("has_subquery"),
        upper.contains("WITH").alias("has_cte"),
        predicates.alias("filter_predicate_count"),
        _listed_after(text, upper, "ORDER BY").alias("order_by_count"),
        _listed_after(text, upper, "GROUP BY").alias("group_by_count"),
    )


def features_json(features: DataFrame) -> DataFrame:
    """Features as one JSON text per statement, the form they are stored in."""
    rest = [c for c in features.columns if c != "log_id"]
    return features.select("log_id", F.to_json(F.struct(*rest)).alias("extracted_features"))


def read_features(logs: DataFrame) -> DataFrame:
    """Stored feature text as columns; missing or broken text counts as empty."""
    f = F.from_json("extracted_features", FEATURES)
    flag = lambda name: F.coalesce(F.col("_f")[name].cast("int"), F.lit(0))
    number = lambda name: F.coalesce(F.col("_f")[name], F.lit(0))
    return logs.withColumn("_f", f).select(
        *logs.columns,
        F.coalesce(F.col("_f.query_type"), F.lit("UNKNOWN")).alias("query_type"),
        *[
            number(n).alias(n)
            for n in ("table_count", "join_count", "filter_predicate_count", "order_by_count", "group_by_count")
        ],
        *[flag(n).alias(n) for n in ("has_aggregation", "has_window_function", "has_subquery", "has_cte")],
        *[number(n).alias(n) for n in ("estimated_rows", "estimated_cost", "plan_depth")],
    )


# Counters -------------------------------------------------------------------------------


def counter_deltas(snapshots: DataFrame, key: str = "queryid", ts: str = "seen_at", tie: str = "snapshot_id") -> DataFrame:
    """Growth of cumulative counters since the snapshot before; a reset counts as no growth.

    Snapshots without new calls are left out. The key's history is cut by day, so one busy
    statement does not sit in one task.
    """
    lagged = previous_in_key(snapshots, [key], [ts, tie], F.to_date(ts), COUNTERS)
    zero = F.lit(0)
    grown = {
        c: F.greatest(zero.cast(snapshots.schema[c].dataType), F.col(c) - F.coalesce(F.col(f"prev_{c}"), zero))
        for c in COUNTERS
    }
    deltas = lagged.select(key, tie, ts, *[g.alias(f"delta_{c}") for c, g in grown.items()])
    mean = ratio(F.col("delta_total_exec_time_ms"), F.col("delta_calls"))
    return deltas.where(F.col("delta_calls") > 0).withColumn("mean_exec_time_ms", mean)


# Latency --------------------------------------------------------------------------------


def with_row_total(logs: DataFrame) -> DataFrame:
    """Total time of a log row and its time per call, exact to the sixth decimal."""
    calls = F.coalesce("calls", F.lit(0))
    spelled = F.col("mean_exec_time_ms") * F.when(calls != 0, calls)
    total = F.coalesce(F.col("total_exec_time_ms"), spelled, F.lit(0)).cast("decimal(24,3)")
    units = (total * 1000).cast("long")
    return (
        logs.withColumn("_calls", calls)
        .withColumn("_total", total)
        .withColumn("_units", units)
        .withColumn(
            "_per_call",
            F.expr("CASE WHEN _calls <> 0 THEN (2 * _units * 1000 + _calls) DIV (2 * _calls) END").cast("decimal(22,0)")
            * F.lit(Decimal("0.000001")),
        )
    )


PROBS = {"p50_execution_time_ms": 0.5, "p95_execution_time_ms": 0.95, "p99_execution_time_ms": 0.99}


def _latency(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and exact percentiles per key of rows carrying their totals."""
    sums = rows.groupBy(*keys).agg(
        F.sum("_calls").alias("execution_count"),
        F.sum("_total").alias("_sum"),
        F.max("collected_at").alias("last_executed"),
        F.coalesce(F.sum("shared_blks_hit"), F.lit(0)).alias("_hit"),
        F.coalesce(F.sum("shared_blks_read"), F.lit(0)).alias("_read"),
        F.max_by("log_id", F.struct("collected_at", "log_id")).alias("sample_log_id"),
    )
    return _measured(sums, percentiles_cont(rows, keys, "_per_call", PROBS, scale=6), keys)


def _measured(sums: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = sums.join(ranks, list(keys), "left")
    mean = ratio(F.col("_sum"), F.col("execution_count"))
    return joined.select(
        *keys,
        "execution_count",
        reconciled_mean(mean, F.col("_sum").cast("double"), F.col("execution_count")).alias("avg_execution_time_ms"),
        *PROBS,
        F.col("_sum").cast("double").alias("total_execution_time_ms"),
        F.when(F.col("_hit") + F.col("_read") > 0, F.col("_hit") / (F.col("_hit") + F.col("_read"))).alias("cache_hit_rate"),
        "last_executed",
        "sample_log_id",
    )


def day_counts(logs: DataFrame) -> DataFrame:
    """One row per day, statement and time per call: how many log rows, their sums, and the newest of them.

    All windows of whole days, percentiles included, follow from these rows, so one scan of the log serves
    every window and view; counts of several days or folders add up.
    """
    return with_row_total(logs).groupBy(F.to_date("collected_at").alias("day"), "query_hash", "_per_call").agg(
        F.count("*").alias("n"),
        F.sum("_calls").alias("calls"),
        F.sum("_total").alias("total"),
        F.coalesce(F.sum("shared_blks_hit"), F.lit(0)).alias("hit"),
        F.coalesce(F.sum("shared_blks_read"), F.lit(0)).alias("read"),
        F.max(F.struct("collected_at", "log_id")).alias("newest"),
    )


def reconciled_mean(mean: Column, total: Column, calls: Column) -> Column:
    """The mean implied by the totals where it is a hundred times the stated one or more."""
    implied = F.when(calls > 0, total / calls)
    off = (implied > 0) & (mean > 0) & (implied / mean >= 100.0)
    return F.when(off, implied).otherwise(mean)


def _by_total(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    if limit is None:
        return rows
    return rows.orderBy(F.col("total_execution_time_ms").desc_nulls_last(), key).limit(limit)


def query_performance(
    logs: DataFrame, start: str, end: str, query_id: str | None = None, limit: int | None = 100, all_if_empty: bool = False
) -> DataFrame:
    """Per statement in [start, end): executions, mean, percentiles, total.

    The range is a plain filter that reaches the scan. With ``all_if_empty`` an empty window takes all rows.
    """
    inside = (F.col("collected_at") >= at(start)) & (F.col("collected_at") < at(end))
    held = logs if query_id is None else logs.where(F.col("query_hash") == query_id)
    if not all_if_empty or not held.where(inside).isEmpty():
        held = held.where(inside)
    rows = with_row_total(held)
    return _by_total(_latency(rows, ["query_hash"]), "query_hash", limit)


def window_bounds(as_of, long_days: int) -> dict[str, str]:
    """Start of the day, week and long windows that end with the day of ``as_of``."""
    day = date.fromisoformat(str(as_of))
    return {"1d": str(day - timedelta(days=1)), "7d": str(day - timedelta(days=7)), "long": str(day - timedelta(days=long_days))}


def window_day_counts(logs: DataFrame, as_of, long_days: int = 30) -> DataFrame:
    """``day_counts`` of the longest window, kept for all that is derived from it."""
    day = date.fromisoformat(str(as_of))
    ts = F.col("collected_at")
    start = window_bounds(as_of, max(7, long_days))["long"]
    return durable(day_counts(logs.where((ts >= at(start)) & (ts < at(str(day + timedelta(days=1)))))))


def query_performance_windows(
    logs: DataFrame, as_of, long_days: int = 30, limit: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """The three windows side by side for every statement; ``limit`` keeps those that rank in one.

    They are made of ``counts`` (``window_day_counts``), one scan of the log: rows are shuffled once per day, statement
    and value, and laid into windows only when they are counts per statement and value.
    """
    counts = window_day_counts(logs, as_of, long_days) if counts is None else counts
    inside = {name: F.col("day") >= F.to_date(F.lit(start)) for name, start in window_bounds(as_of, long_days).items()}

    def stacked(rows: DataFrame, fields: dict[str, Column], keys: Sequence[str]) -> DataFrame:
        """Per keys one row a window: aggregates of the days inside it, windows without a row left out."""
        windows = [F.struct(F.lit(name).alias("window"), *[f(days).alias(c) for c, f in fields.items()]).alias(f"_{name}") for name, days in inside.items()]
        wide = rows.groupBy(*keys).agg(*windows)
        return wide.select(*keys, F.inline(F.array(*[f"_{name}" for name in inside]))).where("n > 0")

    total = lambda c: lambda days: F.sum(F.when(days, F.col(c)))
    values = stacked(counts.where("_per_call IS NOT NULL"), {"n": total("n")}, ["query_hash", "_per_call"])
    newest = lambda days: F.max(F.when(days, F.col("newest")))
    fields = {"n": total("n"), "execution_count": total("calls"), "_sum": total("total"), "_hit": total("hit"), "_read": total("read"), "_newest": newest}
    sums = stacked(counts, fields, ["query_hash"]).withColumns(
        {"last_executed": F.col("_newest.collected_at"), "sample_log_id": F.col("_newest.log_id")}
    )
    keys = ["window", "query_hash"]
    measured = _measured(sums, percentiles_cont(values, keys, "_per_call", PROBS, 6, weight="n"), keys)
    if limit is None:
        return measured
    order = W.partitionBy("window").orderBy(F.col("total_execution_time_ms").desc_nulls_last(), "query_hash")
    listed = measured.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
    return measured.join(listed.select("query_hash").distinct(), "query_hash", "left_semi")


def query_previews(logs: DataFrame) -> DataFrame:
    """Text, or else template, of the newest row of every statement."""
    shown = F.coalesce(trimmed("query_text"), trimmed("query_template"))
    newest = F.max_by(shown, F.struct("collected_at", "log_id"))
    return logs.groupBy("query_hash").agg(F.coalesce(newest, F.lit("")).alias("preview"))


def hourly_calls(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Calls per hour of day, all 24 hours."""
    held = logs.where((F.col("collected_at") >= at(start)) & (F.col("collected_at") < at(end)))
    sums = held.groupBy(F.hour("collected_at").alias("utc_hour")).agg(F.sum(F.coalesce("calls", F.lit(0))).alias("c"))
    hours = logs.sparkSession.range(24).select(F.col("id").cast("int").alias("utc_hour"))
    return F.broadcast(hours).join(sums, "utc_hour", "left").select(
        "utc_hour", F.coalesce("c", F.lit(0)).cast("double").alias("total_calls")
    )


def window_rollups(logs: DataFrame, as_of, counts: DataFrame | None = None) -> DataFrame:
    """Rows and calls of the day and week windows, in one pass over the log or over ``counts`` of its days."""
    day = date.fromisoformat(str(as_of))
    starts = window_bounds(as_of, 30)
    if counts is None:
        ts = F.col("collected_at")
        held = logs.where((ts >= at(starts["7d"])) & (ts < at(str(day + timedelta(days=1)))))
        held = held.select(F.to_date(ts).alias("day"), F.lit(1).cast("long").alias("n"), F.coalesce("calls", F.lit(0)).alias("calls"))
    else:
        held = counts.where(F.col("day") >= F.to_date(F.lit(starts["7d"])))
    one = F.col("day") >= F.to_date(F.lit(starts["1d"]))
    sums = held.agg(
        F.sum(F.when(one, F.col("n"))).alias("n1"),
        F.sum(F.when(one, F.col("calls"))).alias("c1"),
        F.sum("n").alias("n7"),
        F.sum("calls").alias("c7"),
    )
    shown = lambda name, n, c: F.struct(F.lit(name).alias("window"), F.coalesce(n, F.lit(0)).alias("sample_rows"), F.coalesce(c, F.lit(0)).cast("double").alias("total_calls"))
    return sums.select(F.inline(F.array(shown("1d", "n1", "c1"), shown("7d", "n7", "c7"))))


def peak_hour(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Busiest hour of day and the newest log row in it."""
    held = logs.where((F.col("collected_at") >= at(start)) & (F.col("collected_at") < at(end)))
    per_hour = held.groupBy(F.hour("collected_at").alias("utc_hour")).agg(
        F.sum(F.coalesce("calls", F.lit(0))).alias("total_calls"),
        F.max_by("log_id", F.struct("collected_at", "log_id")).alias("sample_log_id"),
    )
    return per_hour.orderBy(F.col("total_calls").desc_nulls_last(), "utc_hour").limit(1)


def bucket_rollup(hourly: DataFrame, hours: int) -> DataFrame:
    """Hourly counts in wider buckets; the fullest one is marked, the earliest of equals."""
    width = max(1, min(24, hours))
    start = F.floor(F.col("utc_hour") / width) * width
    sums = hourly.groupBy(start.cast("int").alias("bucket_start")).agg(F.sum("total_calls").alias("executions"))
    top = sums.agg(F.max_by("bucket_start", F.struct("executions", -F.col("bucket_start")))).scalar()
    best = sums.agg(F.max("executions")).scalar()
    last = F.least(F.col("bucket_start") + width, F.lit(24)) - 1
    label = F.when(F.lit(width >= 24), F.lit("Full day")).otherwise(
        F.format_string("%02d:00–%02d:59", F.col("bucket_start"), last)
    )
    return sums.select(
        "bucket_start", label.alias("label"), "executions", ((F.col("bucket_start") == top) & (best > 0)).alias("is_peak")
    )


def workload_kpis(perf: DataFrame) -> DataFrame:
    """Share of slow executions, weighted and median latency over a statement table.

    Slow is over a second on average or two at p95; where nothing is, the top fifth.
    """
    rows = perf.select(
        F.lit(1).alias("_all"),
        F.coalesce("execution_count", F.lit(0)).alias("c"),
        F.coalesce(F.round("avg_execution_time_ms", 6), F.lit(0.0)).cast("decimal(24,6)").alias("avg"),
        F.coalesce(F.round("p95_execution_time_ms", 6), F.lit(0.0)).cast("decimal(24,6)").alias("p95"),
    )
    rows = durable(rows)
    fifth = {"k": F.floor((F.col("n") - 1) * F.lit(0.8))}
    avg_cut = order_statistics(rows.where("avg > 0"), ["_all"], "avg", fifth, 6).select("k").scalar()
    p95_cut = order_statistics(rows.where("p95 > 0"), ["_all"], "p95", fifth, 6).select("k").scalar()
    median = order_statistics(rows, ["_all"], "avg", {"k": F.floor(F.col("n") / 2)}, 6).select("k").scalar()
    absolute = (F.col("avg") >= SLOW_AVG_MS) | (F.col("p95") >= SLOW_P95_MS)
    any_slow = rows.agg(F.coalesce(F.bool_or(absolute), F.lit(False))).scalar()
    tail = F.coalesce(F.col("avg").cast("double") >= avg_cut, F.lit(False)) | F.coalesce(
        F.col("p95").cast("double") >= p95_cut, F.lit(False)
    )
    slow = F.when(any_slow, absolute).otherwise(tail)
    marked = rows.withColumn("slow", slow)
    total = F.sum("c")
    return marked.agg(
        total.alias("total_executions"),
        F.count("*").alias("distinct_queries"),
        F.count_if("slow").alias("slow_distinct"),
        F.coalesce(ratio(F.sum(F.when(F.col("slow"), F.col("c")).otherwise(0)), total), F.lit(0.0)).alias("slow_execution_share"),
        F.coalesce(ratio(F.sum(F.col("avg") * F.col("c")), total), F.lit(0.0)).alias("weighted_avg_latency_ms"),
    ).withColumn("median_avg_latency_ms", F.coalesce(median, F.lit(0.0)))


def weighted_cache_hit_rate(perf: DataFrame) -> DataFrame:
    """Hit rate weighted by executions over statements that have one."""
    held = F.col("cache_hit_rate").isNotNull() & (F.col("execution_count") > 0)
    weight = F.when(held, F.col("execution_count"))
    return perf.agg(ratio(F.sum(F.col("cache_hit_rate") * weight), F.sum(weight)).alias("weighted_cache_hit_rate"))


def hotspots(windows: DataFrame, limit: int = 13) -> DataFrame:
    """Statements by impact: recent latency times runs, raised by the growth over the long-term norm."""

    def side(name: str) -> DataFrame:
        return windows.where(F.col("window") == name).select(
            "query_hash",
            F.col("avg_execution_time_ms").alias(f"avg_ms_{name}"),
            F.col("execution_count").alias(f"runs_{name}"),
            F.col("sample_log_id").alias(f"sample_{name}"),
        )

    joined = side("1d").join(side("7d"), "query_hash", "full_outer").join(side("long"), "query_hash", "full_outer")
    recent, week, norm = F.col("avg_ms_1d"), F.col("avg_ms_7d"), F.col("avg_ms_long")
    base = F.when(norm > 0, norm).when(week > 0, week)
    growth = (
        F.when(base.isNull(), F.when(recent > 0, 100.0).otherwise(0.0))
        .when(recent.isNull(), 0.0)
        .otherwise((recent - base) / base * 100)
    )
    runs = F.coalesce("runs_1d", "runs_7d", "runs_long")
    latency = F.coalesce(recent, week, norm, F.lit(0.0)) / 1000
    impact = F.greatest(F.lit(0.0), latency * F.greatest(F.lit(1), runs)) * (1 + F.greatest(F.lit(0.0), growth) / 100)
    rows = joined.select(
        "query_hash",
        runs.alias("runs"),
        recent.alias("avg_ms_1d"),
        week.alias("avg_ms_7d"),
        norm.alias("avg_ms_long"),
        growth.alias("growth_pct"),
        impact.alias("impact_score"),
        F.coalesce("sample_1d", "sample_7d", "sample_long").alias("sample_log_id"),
    )
    return rows.orderBy(F.col("impact_score").desc(), "query_hash").limit(limit)


# Workload character -----------------------------------------------------------------------


def query_type_distribution(logs: DataFrame) -> DataFrame:
    return read_features(logs).groupBy("query_type").agg(F.count("*").alias("queries"))


def complexity_stats(logs: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the complexity score."""
    f = read_features(logs)
    score = (
        F.col("join_count") * 2
        + F.col("has_aggregation") * 2
        + F.col("has_subquery") * 3
        + F.col("has_window_function") * 2
        + F.col("filter_predicate_count") * 0.5
    )
    scored = f.select(F.lit(1).alias("_all"), score.alias("score"))
    basic = scored.groupBy("_all").agg(
        F.count("*").alias("count"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    quartiles = percentiles_cont(scored, ["_all"], "score", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, scale=1)
    return basic.join(quartiles, "_all").drop("_all")


def time_histograms(logs: DataFrame) -> DataFrame:
    """Calls per hour of day and per weekday, Monday being 0."""
    hour = logs.groupBy(F.hour("collected_at").alias("slot")).agg(F.sum("calls").alias("calls"))
    day = logs.groupBy(F.weekday("collected_at").alias("slot")).agg(F.sum("calls").alias("calls"))
    return hour.select(F.lit("hour").alias("unit"), "slot", "calls").unionByName(
        day.select(F.lit("weekday").alias("unit"), "slot", "calls")
    )


def workload_totals(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count("*").alias("total_queries"),
        F.count_distinct("query_hash").alias("unique_query_templates"),
        ratio(F.sum("mean_exec_time_ms"), F.count("mean_exec_time_ms")).alias("avg_execution_time_ms"),
        F.sum("total_exec_time_ms").cast("double").alias("total_execution_time_ms"),
        ratio(F.sum("calls"), F.count("calls")).alias("avg_calls"),
    )


def workload_classes(logs: DataFrame) -> DataFrame:
    """Transactional or analytical, light or heavy, ad hoc or scheduled."""
    f = read_features(logs)
    sums = f.agg(
        F.sum(F.col("has_aggregation") + F.col("has_window_function") + F.col("join_count")).alias("olap"),
        (F.count_if(F.col("query_type") == "SELECT") + F.count_if(F.col("join_count") == 0)).alias("oltp"),
        ratio(F.sum("mean_exec_time_ms"), F.count("mean_exec_time_ms")).alias("ms"),
        ratio(F.sum("calls"), F.count("calls")).alias("calls"),
    )
    olap, oltp = F.col("olap"), F.col("oltp")
    return sums.select(
        F.when(olap > oltp * 1.5, "OLAP").when(oltp > olap * 1.5, "OLTP").otherwise("MIXED").alias("oltp_vs_olap"),
        F.when(F.col("ms") < 100, "LIGHT").when(F.col("ms") > 1000, "HEAVY").otherwise("MODERATE").alias("light_vs_heavy"),
        F.when(F.col("calls") > 100, "SCHEDULED").otherwise("AD_HOC").alias("ad_hoc_vs_scheduled"),
    )


# Samples and cache candidates ---------------------------------------------------------------


def newest_sample(logs: DataFrame, limit: int | None) -> DataFrame:
    """Usable rows; with a limit, the newest of them."""
    busy = (F.coalesce("mean_exec_time_ms", F.lit(0)) > 0) | (F.coalesce("calls", F.lit(0)) > 0)
    usable = logs.where(trimmed("query_text").isNotNull() & busy)
    if limit is None:
        return usable
    return usable.orderBy(F.col("collected_at").desc(), "log_id").limit(limit)


def sample_quality(logs: DataFrame, limit: int | None = None) -> DataFrame:
    return newest_sample(logs, limit).agg(
        F.count("*").alias("sampled_rows"),
        F.count_if(F.col("extracted_features").isNull()).alias("missing_extracted_features"),
        F.max("collected_at").alias("data_watermark_utc"),
    )


def cache_candidate_base(logs: DataFrame, sample: int | None = None, limit: int | None = None) -> DataFrame:
    """Samples, calls and mean time per text; ``limit`` keeps the most called."""
    rows = with_row_total(newest_sample(logs, sample))
    sums = rows.groupBy("query_text").agg(
        F.count("*").alias("sample_count"), F.sum("_calls").cast("double").alias("calls_sum"), F.sum("_total").alias("t")
    )
    measured = sums.select(
        "query_text", "sample_count", "calls_sum", ratio(F.col("t"), F.col("calls_sum")).alias("mean_exec_ms")
    )
    order = [F.col("calls_sum").desc(), F.col("mean_exec_ms").desc_nulls_last(), F.col("query_text")]
    held = measured if limit is None else measured.orderBy(*order).limit(limit)
    return held.select(
        F.col("query_text").alias("query_preview"), "sample_count", "calls_sum", "mean_exec_ms"
    )


def cache_features(logs: DataFrame) -> DataFrame:
    """One row per statement text with what the cache model looks at."""
    zero = F.lit(0)
    calls, mean = F.coalesce("calls", zero), F.coalesce("mean_exec_time_ms", zero)
    stated = F.coalesce("total_exec_time_ms", zero)
    total = F.when(stated > 0, stated).otherwise(mean * calls).cast("decimal(24,3)")
    hits, reads = F.coalesce("shared_blks_hit", zero), F.coalesce("shared_blks_read", zero)
    hit_ratio = F.when(hits + reads != 0, hits / (hits + reads))
    sums = logs.groupBy("query_text").agg(
        F.count("*").alias("sample_count"),
        F.sum(calls).cast("double").alias("_calls"),
        F.sum(total).cast("double").alias("_total"),
        (F.sum(mean).cast("double") / F.count("*")).alias("_mean"),
        F.max(F.coalesce("max_exec_time_ms", zero)).cast("double").alias("max_exec_ms"),
        (F.sum(F.coalesce("rows_affected", zero)).cast("double") / F.count("*")).alias("mean_rows_affected"),
        F.coalesce(F.avg(hit_ratio), F.lit(0.0)).alias("mean_hit_ratio"),
        F.max_by("log_id", F.struct("collected_at", "log_id")).alias("sample_log_id"),
    )
    mean_ms = F.when(F.col("_calls") > 0, F.col("_total") / F.col("_calls")).otherwise(F.col("_mean"))
    return sums.select(
        "query_text",
        "sample_count",
        F.greatest("_calls", F.col("sample_count").cast("double")).alias("calls_sum"),
        mean_ms.alias("mean_exec_ms"),
        "max_exec_ms",
        "mean_rows_affected",
        "mean_hit_ratio",
        "sample_log_id",
    )


def cache_heuristic(features: DataFrame, threshold: float = 0.7, limit: int | None = None) -> DataFrame:
    """Chance of a worthwhile cache entry from call volume and time, without a model."""
    busy = F.least(F.col("calls_sum") / 100.0, F.lit(1.0))
    slow = F.least(F.col("mean_exec_ms") / 1000.0, F.lit(1.0))
    chance = F.least(F.lit(0.99), busy * 0.6 + slow * 0.4)
    held = features.withColumn("cache_probability", chance).where(F.col("cache_probability") >= threshold)
    if limit is not None:
        held = held.orderBy(F.col("cache_probability").desc(), "query_text").limit(limit)
    return held.select(
        F.col("query_text").alias("query_preview"),
        "cache_probability",
        "sample_count",
        "calls_sum",
        "mean_exec_ms",
        "sample_log_id",
    )


# Before and after ---------------------------------------------------------------------------


def before_after(latencies: DataFrame) -> DataFrame:
    """Latency cut per scenario between ``variant`` baseline and optimized.

    p50 is the median of the middle pair, p95 and p99 are the value at position floor(n*p).
    """
    n = F.col("n")
    ranks = {
        "lo": F.floor((n - 1) / 2),
        "hi": F.floor(n / 2),
        "p95": F.floor(n * F.lit(0.95)),
        "p99": F.floor(n * F.lit(0.99)),
    }
    stats = order_statistics(latencies, ["scenario", "variant"], "latency_ms", ranks, 3)
    stats = stats.select("scenario", "variant", ((F.col("lo") + F.col("hi")) / 2).alias("p50"), "p95", "p99")
    old = stats.where("variant = 'baseline'").drop("variant")
    new = stats.where("variant = 'optimized'").select("scenario", *[F.col(p).alias(f"new_{p}") for p in ("p50", "p95", "p99")])
    cut = {p: ratio(F.col(p) - F.col(f"new_{p}"), F.col(p)) * 100 for p in ("p50", "p95", "p99")}
    return old.join(new, "scenario").select(
        "scenario",
        *[c.alias(f"{p}_reduction_pct") for p, c in cut.items()],
        ((cut["p50"] + cut["p95"] + cut["p99"]) / 3).alias("average_improvement_pct"),
    )


def improvement_summary(compared: DataFrame) -> DataFrame:
    """Average, least and greatest improvement over the scenarios."""
    gain = F.col("average_improvement_pct")
    return compared.agg(
        F.count("*").alias("scenarios"), F.avg(gain).alias("average"), F.min(gain).alias("minimum"), F.max(gain).alias("maximum")
    )
