"""Run history, errors, throughput, freshness and quality scores from ``job_runs`` and table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.functions.exprs import ladder

# Fixed values.
FRESH_HOURS = 1.0
STALE_HOURS = 6.0
STATUS_RANK = {"fresh": 0, "unknown": 1, "stale": 2, "outdated": 3}
SCORE_STEPS = ((95, "excellent"), (80, "good"), (60, "fair"))
ERROR_WORDS = (
    ("timeout", ("timeout",)),
    ("connection", ("connection", "network")),
    ("constraint_violation", ("constraint", "violation")),
    ("data_quality", ("null", "missing")),
)


def at(ts) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with fractions; NULL where either is missing."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("double") / 1_000_000


def hours_since(ts: Column, now) -> Column:
    return seconds_between(ts, at(now)) / 3600


def days_back(now, days: int) -> Column:
    return at(now) - F.make_dt_interval(days=F.lit(days))


def job_history(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every run with its definition and duration."""
    defs = jobs.select("job_id", "job_name", "job_type")
    joined = runs.join(defs, "job_id", "left")
    return joined.select(
        F.col("run_id").alias("job_id"),
        F.coalesce("job_name", "table_name", F.lit("ETL Job")).alias("job_name"),
        F.coalesce("job_type", F.lit("unknown")).alias("job_type"),
        "status",
        F.coalesce("progress", F.lit(0)).alias("progress"),
        "layer",
        "table_name",
        "started_at",
        "completed_at",
        F.coalesce("records_processed", F.lit(0)).alias("records_processed"),
        F.coalesce(F.round(seconds_between(F.col("started_at"), F.col("completed_at")), 2), F.lit(0.0)).alias(
            "duration_seconds"
        ),
    )


def error_type(message: Column) -> Column:
    text = F.lower(message)
    chain = None
    for label, words in ERROR_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("processing_error")


def etl_errors(runs: DataFrame, jobs: DataFrame, stats: DataFrame, now, days: int = 7) -> DataFrame:
    """Failed runs of known jobs over the last days, and tables left empty by completed runs."""
    failed = runs.where((F.col("status") == "failed") & (F.col("started_at") >= days_back(now, days)))
    message = F.coalesce("error_message", F.lit("ETL job failed"))
    layer = F.col("layer")
    severity = F.when(layer == "gold", "critical").when(layer == "silver", "high").otherwise("warning")
    target = F.when(layer.isNotNull() & F.col("table_name").isNotNull(), F.concat_ws(".", "layer", "table_name"))
    from_runs = failed.join(jobs.select("job_id", "job_name"), "job_id").select(
        F.col("run_id").alias("error_id"),
        error_type(message).alias("type"),
        severity.alias("severity"),
        target.alias("table_name"),
        message.alias("message"),
        F.col("started_at").alias("occurred_at"),
        "job_name",
    )
    done = runs.where(F.col("status") == "completed").select("layer", "table_name")
    empty = stats.where(F.col("row_count") == 0).join(done, ["layer", "table_name"], "left_semi")
    from_tables = empty.select(
        F.concat(F.col("layer"), F.lit("_"), F.col("table_name"), F.lit("_empty")).alias("error_id"),
        F.lit("empty_table").alias("type"),
        F.lit("warning").alias("severity"),
        F.concat_ws(".", "layer", "table_name").alias("table_name"),
        F.format_string(
            "Table %s in %s layer has no data despite completed ETL jobs", F.col("table_name"), F.col("layer")
        ).alias("message"),
        at(now).alias("occurred_at"),
        F.lit(None).cast("string").alias("job_name"),
    )
    return from_runs.unionByName(from_tables)


def throughput(runs: DataFrame, stats: DataFrame, now, hours: int = 24, limit: int = 10) -> DataFrame:
    """Best records per second of every table in the last hours; the sum over all tables beside each.

    Without any such run the operation counters over an hour stand in.
    """
    since = at(now) - F.make_dt_interval(hours=F.lit(hours))
    span = seconds_between(F.col("started_at"), F.col("completed_at"))
    held = runs.where(
        (F.col("status") == "completed")
        & (F.col("records_processed") > 0)
        & (F.col("completed_at") >= since)
        & F.col("layer").isNotNull()
        & F.col("table_name").isNotNull()
    ).select("layer", "table_name", "records_processed", span.alias("s"))
    rate = F.col("records_processed").cast("double") / F.col("s")
    timed = held.where(F.col("s") != 0).select("layer", "table_name", "records_processed", "s", rate.alias("rate"))
    best = timed.groupBy("layer", "table_name").agg(
        F.max(F.struct("rate", "records_processed", "s")).alias("b")
    )
    measured = best.select(
        F.concat_ws(".", "layer", "table_name").alias("table_name"),
        "layer",
        F.round("b.rate", 2).alias("records_per_second"),
        F.col("b.records_processed").alias("total_records"),
        F.round("b.s", 2).alias("duration_seconds"),
    )
    none_measured = measured.agg(F.count("*") == 0).scalar()
    operations = F.coalesce("inserts", F.lit(0)) + F.coalesce("updates", F.lit(0))
    stand_in = stats.where(none_measured).select(
        F.concat_ws(".", "layer", "table_name").alias("table_name"),
        "layer",
        F.round(operations / F.lit(3600.0), 2).alias("records_per_second"),
        F.coalesce("live", F.lit(0)).alias("total_records"),
        F.lit(3600.0).alias("duration_seconds"),
    )
    both = measured.unionByName(stand_in)
    overall = both.agg(F.round(F.sum("records_per_second"), 2)).scalar()
    return (
        both.orderBy(F.col("records_per_second").desc(), "table_name")
        .limit(limit)
        .withColumn("overall_throughput", overall)
    )


def _freshness_status(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), "unknown")
        .when(hours < FRESH_HOURS, "fresh")
        .when(hours < STALE_HOURS, "stale")
        .otherwise("outdated")
    )


def freshness(runs: DataFrame, jobs: DataFrame, stats: DataFrame, now) -> DataFrame:
    """Newest sign of life of every table: its runs, a whole-pipeline run, its newest row time.

    Earlier kinds of sign win ties.
    """
    done = runs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
    per_table = (
        done.where(F.col("layer").isNotNull() & F.col("table_name").isNotNull())
        .groupBy("layer", "table_name")
        .agg(F.max("completed_at").alias("ts"), F.sum("records_processed").alias("records"))
    )
    tables = per_table.select("layer", "table_name").unionByName(stats.select("layer", "table_name")).distinct()
    pipelines = jobs.where(
        (F.lower(F.coalesce("job_type", F.lit(""))) == "pipeline")
        | F.lower(F.trim(F.coalesce("job_name", F.lit("")))).contains("complete etl pipeline")
    )
    last_pipeline = done.join(pipelines.select("job_id"), "job_id", "left_semi").agg(F.max("completed_at")).scalar()
    signs = (
        per_table.select("layer", "table_name", "ts", F.lit(3).alias("rank"), F.lit("etl").alias("signal"))
        .unionByName(
            tables.where(F.col("layer").isin("silver", "gold")).select(
                "layer", "table_name", last_pipeline.alias("ts"), F.lit(2).alias("rank"), F.lit("pipeline").alias("signal")
            )
        )
        .unionByName(
            stats.select(
                "layer", "table_name", F.col("max_ts").alias("ts"), F.lit(1).alias("rank"), F.lit("column").alias("signal")
            )
        )
        .where(F.col("ts").isNotNull())
    )
    newest = signs.groupBy("layer", "table_name").agg(F.max(F.struct("ts", "rank", "signal")).alias("s"))
    joined = tables.join(newest, ["layer", "table_name"], "left").join(
        per_table.select("layer", "table_name", "records"), ["layer", "table_name"], "left"
    )
    counted = joined.join(stats.select("layer", "table_name", "row_count"), ["layer", "table_name"], "left")
    hours = hours_since(F.col("s.ts"), now)
    return counted.select(
        "layer",
        "table_name",
        F.col("s.ts").alias("last_updated"),
        F.round(hours, 2).alias("hours_ago"),
        _freshness_status(hours).alias("status"),
        F.coalesce("records", "row_count", F.lit(0)).alias("total_records"),
        F.coalesce("s.signal", F.lit("unknown")).alias("activity_signal"),
    )


def status_rank(status: Column) -> Column:
    rank = F.lit(1)
    for name, value in STATUS_RANK.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def freshness_by_layer(fresh: DataFrame) -> DataFrame:
    """Worst status per layer with counts per status."""
    worst = F.max(status_rank(F.col("status")))
    named = F.element_at(F.array(*[F.lit(n) for n, _ in sorted(STATUS_RANK.items(), key=lambda p: p[1])]), worst + 1)
    return fresh.groupBy("layer").agg(
        named.alias("overall_status"),
        F.count_if(F.col("status") == "fresh").alias("on_time"),
        F.count_if(F.col("status") == "stale").alias("at_risk"),
        F.count_if(F.col("status") == "outdated").alias("sla_breach"),
        F.count_if(F.col("status") == "unknown").alias("unknown_datasets"),
    )


def freshness_sorted(fresh: DataFrame) -> DataFrame:
    """Worst first, then by age; the rank shows the order."""
    return fresh.orderBy(status_rank(F.col("status")).desc(), F.col("hours_ago").desc_nulls_last(), "layer", "table_name")


def quality_score(stats: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Score 0 to 100 per table from dead rows, run success and age of the last run."""
    keyed = runs.where(F.col("layer").isNotNull() & F.col("table_name").isNotNull())
    recent = F.col("started_at") >= days_back(now, 7)
    per_table = keyed.groupBy("layer", "table_name").agg(
        F.count_if(recent).alias("n"),
        F.count_if(recent & (F.col("status") == "completed")).alias("ok"),
        F.count_if(recent & (F.col("status") == "failed")).alias("bad"),
        F.max(F.when(recent, F.col("started_at"))).alias("last_recent"),
        F.max("started_at").alias("last_any"),
    )
    joined = stats.join(per_table, ["layer", "table_name"], "left")
    dead = F.col("dead").cast("double") / F.col("live") * 100
    base = F.when(F.col("live") > 0, F.greatest(F.lit(0.0), 100.0 - dead)).when(F.col("row_count") > 0, 70.0)
    storage = F.coalesce(base, F.when(F.col("row_count") > 0, 60.0).otherwise(20.0))
    active = F.col("n") > 0
    success = F.col("ok") / F.col("n") * 100
    age = hours_since(F.col("last_recent"), now)
    old = hours_since(F.col("last_any"), now)
    running = (
        storage * 0.55
        + success * 0.45
        - F.col("bad") / F.col("n") * 25.0
        - F.when(age > 72, 15.0).when(age > 24, 8.0).otherwise(0.0)
    )
    idle = (
        F.when(F.col("row_count") == 0, 20.0).otherwise(F.coalesce(base, F.lit(50.0)))
        - F.when(old > 72, 12.0).when(old > 24, 6.0).otherwise(0.0)
    )
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(active, running).otherwise(idle)))
    scored = joined.select(
        "layer",
        "table_name",
        "row_count",
        F.when(F.col("live") > 0, F.col("dead")).otherwise(0).alias("dead_rows"),
        score.alias("_score"),
    )
    return scored.select(
        "layer",
        "table_name",
        "row_count",
        "dead_rows",
        F.round("_score", 2).alias("quality_score"),
        ladder("_score", SCORE_STEPS, "poor").alias("status"),
    )


def quality_by_layer(scores: DataFrame) -> DataFrame:
    """Mean score per layer, its grade, and the tables under 80."""
    mean = F.avg("quality_score")
    return scores.groupBy("layer").agg(
        F.count("*").alias("datasets"),
        F.round(mean, 2).alias("average_quality_score"),
        ladder(mean, SCORE_STEPS, "poor").alias("overall_status"),
        F.count_if(F.col("quality_score") < 80).alias("below_80"),
    )


def etl_kpis(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Active and failed runs, tables within the freshness promise, mean duration."""
    met = fresh.agg(F.count_if(F.col("status") == "fresh")).scalar()
    total = fresh.agg(F.count("*")).scalar()
    cents = F.sum(F.col("duration_seconds").cast("decimal(18,2)")).cast("double")
    return history.agg(
        F.count_if(F.col("status").isin("running", "pending")).alias("active_pipelines"),
        F.count_if(F.col("status").isin("failed", "error")).alias("failed_runs"),
        (cents / F.count("*")).alias("mean_duration_seconds"),
    ).select("*", met.alias("sla_met"), total.alias("sla_total"))


def run_row(
    spark, run_id: str, step: str, layer: str, table: str, status: str, records: int, started, completed=None, error=None, progress: int = 0
):
    """One event of a step (started, finished, failed) as a frame for the run log."""
    schema = (
        "run_id string, job_id string, layer string, table_name string, status string, records_processed long, "
        "started_at timestamp, completed_at timestamp, error_message string, progress int"
    )
    return spark.createDataFrame([(run_id, step, layer, table, status, records, started, completed, error, progress)], schema)


def run_states(events: DataFrame) -> DataFrame:
    """The newest event of every step of every run: a step without an end is still ``running``, or its driver was lost."""
    step = ["run_id", "layer", "table_name", "started_at"]
    rest = [c for c in events.columns if c not in step]
    newest = F.max_by(F.struct(*rest), F.struct(F.col("completed_at").isNotNull(), "completed_at")).alias("e")
    return events.groupBy(*step).agg(newest).select(*step, "e.*").select(*events.columns)
