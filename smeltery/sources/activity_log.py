"""Activity log lines: tab-separated with the payload last, or a bare JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from smeltery.functions.exprs import trimmed

PAYLOAD = (
    "timestamp string, event_id string, event_type string, source string, page string, message string, "
    "summary string, details map<string,string>"
)
TABBED_FIELDS = 7


def parse_lines(lines: DataFrame, column: str = "value", summary_chars: int | None = None, preview_chars: int | None = None) -> DataFrame:
    """One row per line that is neither blank nor a comment, with a flag for unreadable ones.

    Summaries and previews of unreadable lines are whole texts; a page can ask for their first characters.
    """

    def shown(text: Column, chars: int | None) -> Column:
        return text if chars is None else F.left(text, F.lit(chars))

    line = F.trim(F.col(column))
    fields = F.split(F.col("_line"), "\t", -1)
    text = F.when(F.col("_line").startswith("{"), F.col("_line")).when(
        F.size(fields) >= TABBED_FIELDS, F.element_at(fields, TABBED_FIELDS)
    )
    kept = lines.select(line.alias("_line")).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parsed = kept.withColumn("_text", text).withColumn("_p", F.from_json("_text", PAYLOAD))
    # Broken JSON parses to a struct of NULLs; a JSON object has at least its braces balanced and one key read.
    readable = F.coalesce(F.json_object_keys("_text").isNotNull(), F.lit(False))
    kind = F.coalesce(F.col("_p.event_type"), F.lit("system"))
    page = F.coalesce(trimmed("_p.page"), F.lit("(unknown path)"))
    told = F.coalesce(trimmed("_p.message"), F.when(kind == "api_activity", "API client activity").when(kind == "system", "System event").otherwise(kind))
    query = trimmed(F.col("_p.details")["search"])
    spelled = (
        F.when((kind == "route_change") & query.isNotNull(), F.concat(F.lit("Navigation → "), page, F.lit(" with query "), query))
        .when(kind == "route_change", F.concat(F.lit("Navigation → "), page))
        .when(kind == "page_load", F.concat(F.lit("Dashboard SPA load / context: "), page))
        .otherwise(told)
    )
    made_up = F.substring(F.sha2(F.col("_text"), 256), 1, 32)
    return parsed.select(
        F.when(readable, F.coalesce(F.col("_p.timestamp"), F.lit(""))).alias("timestamp"),
        F.when(readable, F.coalesce(trimmed("_p.event_id"), made_up)).alias("event_id"),
        F.when(readable, kind).alias("event_type"),
        F.when(readable, F.coalesce(F.col("_p.source"), F.lit("dashboard"))).alias("source"),
        F.when(readable, F.col("_p.page")).alias("page"),
        F.when(readable, F.coalesce(trimmed("_p.summary"), shown(F.regexp_replace(spelled, r"\s+", " "), summary_chars))).alias("summary"),
        (~readable).alias("parse_error"),
        F.when(~readable, shown(F.col("_line"), preview_chars)).alias("raw_preview"),
    )


def activity_log_parse(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Newest readable events of a log file or folder."""
    events = parse_lines(spark.read.text(path)).where("NOT parse_error")
    return events.orderBy(F.col("timestamp").desc(), "event_id").limit(limit).drop("parse_error", "raw_preview")


def bad_line_count(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path)).agg(
        F.count("*").alias("lines"), F.count_if("parse_error").alias("bad_lines")
    )
