"""Layout recommendations: which column to cluster a table by, which to partition it by.

"index" stands for a cluster or sort column and "partition" for a ``partitionBy`` column;
nothing is applied. Table and column pairs come from the statement texts by patterns, as
array expressions inside one row. Log rows are summed per distinct text before their text
is taken apart, so the patterns run once per statement and not once per execution.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from smeltery.functions.exprs import ladder, tolerant_list, trimmed
from smeltery.functions.ordered import ordered_index

# Text patterns and name lists of the extraction.
QUALIFIED = r"\b(SILVER|BRONZE|GOLD)\.([A-Z0-9_]+)\.([A-Z0-9_]+)\b\s*(=|IN\b|BETWEEN\b|>|<)"
FROM_OR_JOIN = r"\b(FROM|JOIN)\s+([A-Z0-9_\.]+)(?:\s+AS)?\s+([A-Z0-9_]+)?"
AFTER_WHERE = r"(?s)\bWHERE\b(.+)"
ALIASED_EQUALS = r"\b([A-Z0-9_]+)\.([A-Z0-9_]+)\s*=\s*"
PLAIN_EQUALS = r"\b([A-Z0-9_]+)\s*=\s*"
LAYERED_NAME = r"\b(gold|silver|bronze)\.([a-z0-9_]+)\b"
KEY_LIKE = ("ID", "ORDER_ID", "CUSTOMER_ID", "PRODUCT_ID", "CREATED_AT", "UPDATED_AT", "DATE", "ORDER_DATE")
COLUMN_HINTS = (
    "order_date_key",
    "order_date",
    "sales_key",
    "product_key",
    "customer_key",
    "inventory_key",
    "net_amount",
    "quantity",
    "category_name",
    "state_province",
    "customer_id",
    "product_id",
    "order_id",
    "created_at",
    "updated_at",
    "event_ts",
    "loaded_at",
    "sku",
    "email",
    "line_no",
)
WORD_FALLBACKS = (
    ("ORDER_DATE", "ORDERS", "silver.orders", "order_date"),
    ("CUSTOMER_ID", "CUSTOMERS", "silver.customers", "customer_id"),
    ("PRODUCT_ID", "PRODUCTS", "silver.products", "product_id"),
    ("CATEGORY", "PRODUCTS", "silver.products", "category"),
)
TIME_COLUMNS = (
    "order_date",
    "created_at",
    "updated_at",
    "event_ts",
    "event_time",
    "date",
    "timestamp",
    "occurred_at",
    "loaded_at",
    "ingested_at",
)
TIME_SUFFIXES = r"(_at|_date|_ts|_time)$"
PRIORITY_RANK = {"high": 3, "medium": 2, "low": 1}
PRIORITY_STEPS = ((0.30, "high"), (0.15, "medium"))


def _pair(table: Column, column: Column) -> Column:
    return F.struct(table.alias("table"), column.alias("column"))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _qualified(upper: Column) -> Column:
    zipped = F.arrays_zip(
        _found(upper, QUALIFIED, 1).alias("s"), _found(upper, QUALIFIED, 2).alias("t"), _found(upper, QUALIFIED, 3).alias("c")
    )
    return F.transform(zipped, lambda z: _pair(F.lower(F.concat(z["s"], F.lit("."), z["t"])), F.lower(z["c"])))


def _by_words(upper: Column) -> Column:
    picks = [
        F.when(upper.contains(a) & upper.contains(b), _pair(F.lit(t), F.lit(c))) for a, b, t, c in WORD_FALLBACKS
    ]
    return F.filter(F.array(*picks), lambda p: p.isNotNull())


def _full_name(raw: Column) -> Column:
    return F.when(raw.contains("."), F.lower(raw)).otherwise(F.concat(F.lit("silver."), F.lower(raw)))


def _owner(left: Column) -> Column:
    """Table behind an alias, the last one given wins; else the first table of the statement."""
    own = F.filter("_named", lambda n: n["a"] == left)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["t"], F.try_element_at("_tables", F.lit(1)))


def _targets() -> Column:
    return F.when(F.size("_tables") > 0, F.col("_tables")).otherwise(F.array(F.lit("silver.unknown")))


def with_cluster_pairs(df: DataFrame, text: str = "query_text", name: str = "_pairs") -> DataFrame:
    """Adds the distinct (table, column) pairs of a statement.

    Every array is a column of its own before the next step reads it, so each pattern runs
    once per row however often its result is used.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    upper, lower = F.col("_upper"), F.col("_lower")
    steps: list[dict[str, Column]] = [
        {"_upper": F.upper(safe), "_lower": F.lower(safe)},
        {
            "_strict": _qualified(upper),
            "_tables": F.transform(_found(upper, FROM_OR_JOIN, 2), _full_name),
            "_aliases": _found(upper, FROM_OR_JOIN, 3),
            "_tail": F.when(upper.rlike(AFTER_WHERE), F.regexp_extract(upper, AFTER_WHERE, 1)).otherwise(upper),
            "_layered": F.array_distinct(
                F.transform(
                    F.arrays_zip(
                        _found(lower, LAYERED_NAME, 1).alias("s"), _found(lower, LAYERED_NAME, 2).alias("t")
                    ),
                    lambda z: F.concat(z["s"], F.lit("."), z["t"]),
                )
            ),
            "_hints": F.filter(
                F.array(*[F.when(lower.rlike(rf"\b{h}\b"), F.lit(h)) for h in COLUMN_HINTS]), lambda h: h.isNotNull()
            ),
        },
        {
            "_named": F.arrays_zip(F.col("_aliases").alias("a"), F.col("_tables").alias("t")),
            "_left": _found(F.col("_tail"), ALIASED_EQUALS, 1),
            "_right": _found(F.col("_tail"), ALIASED_EQUALS, 2),
            "_keys": F.filter(
                F.array_distinct(_found(F.col("_tail"), PLAIN_EQUALS, 1)), lambda c: c.isin(*KEY_LIKE)
            ),
        },
        {
            "_aliased": F.filter(
                F.transform(
                    F.arrays_zip(F.col("_left").alias("l"), F.col("_right").alias("c")),
                    lambda e: _pair(_owner(e["l"]), F.lower(e["c"])),
                ),
                lambda p: p["table"].isNotNull(),
            )
        },
        {
            "_plain": F.flatten(
                F.transform(
                    F.filter("_keys", lambda k: ~F.exists("_aliased", lambda p: p["column"] == F.lower(k))),
                    lambda k: F.transform(_targets(), lambda t: _pair(t, F.lower(k))),
                )
            ),
            "_broad": F.flatten(F.transform("_layered", lambda t: F.transform("_hints", lambda h: _pair(t, h)))),
            "_words": F.when(F.size("_strict") > 0, F.col("_strict")).otherwise(_by_words(upper)),
        },
        {name: F.array_distinct(F.concat("_words", "_aliased", "_plain", "_broad"))},
    ]
    staged = df
    for step in steps:
        staged = staged.withColumns(step)
    return staged.select(*df.columns, name)


def is_time_like(column: Column) -> Column:
    name = F.lower(F.trim(column))
    return name.isin(*TIME_COLUMNS) | name.rlike(TIME_SUFFIXES)


def partition_pairs(text: Column, clustered: Column) -> Column:
    """Pairs whose column tells a time; narrow guesses where there are none."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    timed = F.filter(clustered, lambda p: is_time_like(p["column"]))
    guesses = [
        F.when(upper.contains("ORDER_DATE") & upper.contains("ORDERS"), _pair(F.lit("silver.orders"), F.lit("order_date"))),
        F.when(upper.contains("CREATED_AT"), _pair(F.lit("bronze.customer_events"), F.lit("created_at"))),
        F.when(upper.contains("EVENT_TS"), _pair(F.lit("bronze.events"), F.lit("event_ts"))),
    ]
    guessed = F.filter(F.array(*guesses), lambda p: p.isNotNull())
    return F.array_distinct(F.when(F.size(timed) > 0, timed).otherwise(guessed))


def _pair_arrays(texts: DataFrame) -> DataFrame:
    return with_cluster_pairs(texts, name="_i").withColumn("_p", partition_pairs(F.col("query_text"), F.col("_i")))


def table_column_candidates(logs: DataFrame, one_row_per_text: bool = False) -> DataFrame:
    """One row per log row, kind and pair.

    Statements repeat far more often than they differ: the patterns run over the distinct
    texts, whose pairs are joined back, unless the frame is distinct by text already.
    """
    if one_row_per_text:
        with_pairs = _pair_arrays(logs)
    else:
        texts = logs.select("query_text").where(F.col("query_text").isNotNull()).distinct()
        with_pairs = logs.join(_pair_arrays(texts), "query_text").select(*logs.columns, "_i", "_p")
    kinds = F.array(
        F.struct(F.lit("index").alias("kind"), F.col("_i").alias("pairs")),
        F.struct(F.lit("partition").alias("kind"), F.col("_p").alias("pairs")),
    )
    by_kind = with_pairs.select(*logs.columns, F.explode(kinds).alias("_k"))
    flat = by_kind.select(*logs.columns, F.col("_k.kind").alias("type"), F.explode("_k.pairs").alias("_pair"))
    return flat.select(
        *logs.columns, "type", F.col("_pair.table").alias("table_name"), F.col("_pair.column").alias("column_name")
    )


def partition_candidates(logs: DataFrame) -> DataFrame:
    """Distinct time-like pairs over the log."""
    pairs = table_column_candidates(logs.select("query_text").distinct(), one_row_per_text=True).where("type = 'partition'")
    return pairs.select("table_name", "column_name").distinct()


def row_severity(logs: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Severity of every log row from its anomaly score, else the relative prediction error.

    ``scores``: log_id, predicted_ms, anomaly_score (NULL unless anomalous).
    """
    stated = F.coalesce(F.col("mean_exec_time_ms").cast("double"), F.lit(0.0))
    actual = F.when((stated <= 0) & (F.coalesce("calls", F.lit(0)) > 0), 0.001).otherwise(stated)
    rows = logs.select("log_id", "query_text", actual.alias("actual_ms"))
    if scores is None:
        return rows.withColumn("predicted_ms", F.col("actual_ms")).withColumn("severity", F.lit(0.05))
    joined = rows.join(scores, "log_id", "left")
    predicted = F.coalesce("predicted_ms", "actual_ms")
    error = F.least(F.lit(2.0), F.abs(predicted - F.col("actual_ms")) / F.greatest("actual_ms", F.lit(0.001)))
    severity = (
        F.when(F.col("anomaly_score").isNotNull(), F.greatest(F.lit(0.0), -F.col("anomaly_score")))
        .when(F.col("predicted_ms").isNotNull() & (F.col("actual_ms") > 0), error)
        .otherwise(0.05)
    )
    return joined.select("log_id", "query_text", "actual_ms", predicted.alias("predicted_ms"), severity.alias("severity"))


def priority_of(improvement: Column) -> Column:
    return ladder(improvement, PRIORITY_STEPS, "low")


def cost_of(priority: Column) -> Column:
    return F.when(priority == "high", 0.20).when(priority == "medium", 0.15).otherwise(0.10)


def priority_rank(priority: Column) -> Column:
    rank = F.lit(0)
    for name, value in PRIORITY_RANK.items():
        rank = F.when(F.lower(priority) == name, value).otherwise(rank)
    return rank


def _exact(value: Column) -> Column:
    """Held to eight decimals, so sums do not depend on their order."""
    return F.round(value, 8).cast("decimal(28,8)")


def layout_recommendations(
    logs: DataFrame, scores: DataFrame | None = None, type_filter: str | None = None, cap: int | None = None
) -> DataFrame:
    """Pairs grouped over the log, scored by severity against the worst one."""
    per_text = (
        row_severity(logs, scores)
        .groupBy("query_text")
        .agg(
            F.count("*").alias("n"),
            F.sum(_exact(F.col("severity"))).alias("sev"),
            F.max("severity").alias("worst"),
            F.sum(_exact(F.col("predicted_ms"))).alias("pred"),
            F.sum(_exact(F.col("actual_ms"))).alias("act"),
        )
    )
    pairs = table_column_candidates(per_text, one_row_per_text=True)
    if type_filter:
        pairs = pairs.where(F.col("type") == type_filter)
    groups = pairs.groupBy("type", "table_name", "column_name").agg(
        F.sum("n").alias("query_count"),
        F.sum("sev").cast("double").alias("_sev"),
        F.max("worst").alias("severity_max"),
        F.sum("pred").cast("double").alias("_pred"),
        F.sum("act").cast("double").alias("_act"),
    )
    worst = groups.agg(F.max("severity_max")).scalar()
    mean = F.col("_sev") / F.col("query_count")
    norm = F.when(worst > 0, mean / worst).otherwise(0.0)
    gain = F.least(F.lit(0.5), 0.05 + 0.45 * norm)
    scored = groups.select(
        "type",
        "table_name",
        "column_name",
        "query_count",
        mean.alias("severity_avg"),
        "severity_max",
        (F.col("_pred") / F.col("query_count")).alias("predicted_avg_ms"),
        (F.col("_act") / F.col("query_count")).alias("avg_execution_time_ms"),
        gain.alias("estimated_improvement"),
    )
    out = scored.withColumn("priority", priority_of(F.col("estimated_improvement")))
    out = out.withColumn("cost", cost_of(F.col("priority")))
    if cap is not None:
        out = by_priority(out).limit(cap)
    return out


def by_priority(recommendations: DataFrame) -> DataFrame:
    """High priority first, then the most queries."""
    return recommendations.orderBy(
        priority_rank(F.col("priority")).desc(), F.col("query_count").desc(), "type", "table_name", "column_name"
    )


def weighted_recommendations(
    logs: DataFrame, scores: DataFrame | None = None, min_evidence: int = 2, limit: int | None = None
) -> DataFrame:
    """Benefit from time and reads, saturating; groups with little evidence stay out."""
    rows = logs.select("log_id", "query_text", F.coalesce(F.col("mean_exec_time_ms").cast("double"), F.lit(0.0)).alias("a"), F.coalesce(F.col("shared_blks_read"), F.lit(0)).alias("io"))
    if scores is not None:
        rows = rows.join(scores.select("log_id", "predicted_ms"), "log_id", "left")
    else:
        rows = rows.withColumn("predicted_ms", F.col("a"))
    per_text = rows.groupBy("query_text").agg(
        F.count("*").alias("n"),
        F.sum(_exact(F.col("a"))).alias("act"),
        F.sum(_exact(F.coalesce("predicted_ms", "a"))).alias("pred"),
        F.sum("io").alias("io"),
    )
    pairs = table_column_candidates(per_text, one_row_per_text=True).where("type = 'index'")
    groups = pairs.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("query_count"),
        F.sum("act").cast("double").alias("_a"),
        F.sum("pred").cast("double").alias("_p"),
        F.sum("io").alias("_io"),
    )
    n = F.col("query_count")
    avg = F.col("_a") / n
    benefit = avg * n + F.col("_io") / n * 0.5
    gain = 0.1 + 0.4 * (benefit / (benefit + 1_000_000.0))
    out = groups.where(n >= min_evidence).select(
        "table_name",
        "column_name",
        "query_count",
        avg.alias("avg_execution_ms"),
        F.when(F.col("_p") > 0, F.col("_p") / n).otherwise(avg).alias("predicted_avg_ms"),
        gain.alias("estimated_improvement"),
        ladder(gain, ((0.35, "high"), (0.2, "medium")), "low").alias("priority"),
    )
    if limit is None:
        return out
    # The list is cut by the priority's name in reverse alphabet, then gain, then queries.
    order = [F.col(c).desc() for c in ("priority", "estimated_improvement", "query_count")]
    return out.orderBy(*order, "table_name", "column_name").limit(limit)


def rule_recommendations(logs: DataFrame, min_calls: int = 10, sample: int | None = None) -> DataFrame:
    """Fixed rules for three tables over the filtering statements; ``sample`` looks at the most called only."""
    held = logs.where(F.col("query_text").contains("WHERE") & (F.col("calls") > min_calls))
    if sample is not None:
        held = held.orderBy(F.col("calls").desc(), F.col("mean_exec_time_ms").desc(), "log_id").limit(sample)
    u = F.upper("query_text")
    ms = F.col("mean_exec_time_ms").cast("double")
    orders = u.contains("SILVER.ORDERS") & u.contains("ORDER_DATE")
    customers = u.contains("SILVER.CUSTOMERS") & u.contains("CUSTOMER_ID")
    products = u.contains("SILVER.PRODUCTS") & (u.contains("PRODUCT_ID") | u.contains("CATEGORY"))
    table = F.when(orders, "silver.orders").when(customers, "silver.customers").when(products, "silver.products")
    column = (
        F.when(orders, "order_date")
        .when(customers, "customer_id")
        .when(u.contains("PRODUCT_ID"), "product_id")
        .otherwise("category")
    )
    share = F.when(orders, 0.5).when(customers, 0.3).otherwise(0.4)
    priority = (
        F.when(orders & (ms > 100), "high").when(customers & ~orders & (ms > 50), "high").otherwise("medium")
    )
    hits = held.select(
        table.alias("table_name"),
        column.alias("column_name"),
        F.struct("calls", "mean_exec_time_ms", (-F.col("log_id")).alias("later")).alias("_order"),
        priority.alias("priority"),
        (ms * share).alias("estimated_reduction_ms"),
        F.col("calls").alias("query_count"),
        ms.alias("avg_execution_time_ms"),
    ).where(F.col("table_name").isNotNull())
    best = F.max_by(F.struct("priority", "estimated_reduction_ms", "query_count", "avg_execution_time_ms"), "_order")
    return hits.groupBy("table_name", "column_name").agg(best.alias("b")).select("table_name", "column_name", "b.*")


def leading_columns(catalog: DataFrame) -> DataFrame:
    """First column and best time column of every table: real dates and times before names that sound like one."""
    typed = F.col("type").rlike("date|time")
    named = is_time_like(F.col("column_name"))
    order = F.struct((~typed).alias("by_name"), "position")
    return catalog.groupBy("layer", "table_name").agg(
        F.min_by("column_name", "position").alias("first_column"),
        F.min_by("column_name", F.when(typed | named, order)).alias("time_column"),
    )


def activity_recommendations(
    stats: DataFrame, catalog: DataFrame, min_scans: int = 5, min_rows: int = 1000, min_mb: float = 0.25, top: int | None = None
) -> DataFrame:
    """Much scanned tables: cluster by the first column, and large ones partition by time. ``reads`` count as scans."""
    busy = stats.where(F.col("reads") >= min_scans)
    if top is not None:
        busy = busy.orderBy(F.col("reads").desc(), F.col("live").desc(), "layer", "table_name").limit(top)
    joined = busy.join(leading_columns(catalog), ["layer", "table_name"], "left")
    scans = F.col("reads")
    priority = F.when(scans > 100, "high").when(scans > 10, "medium").otherwise("low")
    base = joined.select(
        F.concat_ws(".", "layer", "table_name").alias("table_name"),
        scans.alias("query_count"),
        priority.alias("priority"),
        F.coalesce("first_column", F.lit("id")).alias("first_column"),
        "time_column",
        ((F.col("live") >= min_rows) | (F.col("bytes") / F.lit(1048576.0) >= min_mb)).alias("large"),
    )
    cluster = base.select(
        F.lit("index").alias("type"),
        "table_name",
        F.col("first_column").alias("column_name"),
        F.lit(0.25).alias("estimated_improvement"),
        F.lit(0.15).alias("cost"),
        "priority",
        "query_count",
    )
    parts = base.where(F.col("large") & F.col("time_column").isNotNull()).select(
        F.lit("partition").alias("type"),
        "table_name",
        F.col("time_column").alias("column_name"),
        F.lit(0.2).alias("estimated_improvement"),
        F.lit(0.2).alias("cost"),
        "priority",
        "query_count",
    )
    return cluster.unionByName(parts)


def partition_hints(live: DataFrame, catalog: DataFrame) -> DataFrame:
    """A partition row for every table with index rows and a time column, unless one is there already."""
    best = F.max_by(
        F.struct("estimated_improvement", "priority", "query_count", "avg_execution_time_ms"),
        F.struct("estimated_improvement", "query_count", "column_name"),
    )
    per_table = live.where("type = 'index'").groupBy("table_name").agg(best.alias("b"))
    timed = leading_columns(catalog).where(F.col("time_column").isNotNull()).select(
        F.concat_ws(".", "layer", "table_name").alias("table_name"), F.col("time_column").alias("column_name")
    )
    gain = F.least(F.lit(0.45), F.greatest(F.lit(0.12), F.col("b.estimated_improvement") * 0.85))
    hints = per_table.join(timed, "table_name").select(
        F.lit("partition").alias("type"),
        "table_name",
        "column_name",
        gain.alias("estimated_improvement"),
        F.lit(0.2).alias("cost"),
        F.col("b.priority").alias("priority"),
        F.col("b.query_count").alias("query_count"),
        F.col("b.avg_execution_time_ms").alias("avg_execution_time_ms"),
    )
    present = live.where("type = 'partition'").select("table_name", "column_name")
    return hints.join(present, ["table_name", "column_name"], "left_anti").select(hints.columns)


def parsed_improvement(text: Column) -> Column:
    """Percent text as a share; 0.3 for anything else."""
    return F.when(text.rlike(r"^[0-9]+\.?[0-9]*$"), text.try_cast("double") / 100.0).otherwise(0.3)


def persisted_recommendations(stored: DataFrame) -> DataFrame:
    """Stored rows in the shape of fresh ones."""
    return stored.select(
        "recommendation_id",
        F.col("recommendation_type").alias("type"),
        "table_name",
        "column_name",
        parsed_improvement(F.col("estimated_improvement")).alias("estimated_improvement"),
        F.when(F.col("priority") == "high", 0.2).when(F.col("priority") == "medium", 0.15).otherwise(0.1).alias("cost"),
        "priority",
        F.coalesce(trimmed("status"), F.lit("pending")).alias("status"),
        "query_count",
    )


def rescore(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Improvement, priority and cost anew from the severity of the same pair, where it is known."""
    sums = live.groupBy(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).agg(
        F.max_by("severity_avg", "type").alias("_s")
    )
    joined = stored.join(sums, (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c")), "left")
    severity = F.col("_s")
    gain = F.least(F.lit(0.5), 0.05 + 0.45 * F.when(severity >= 0, severity / (severity + 1.0)).otherwise(0.0))
    known = severity.isNotNull()
    rescored = joined.withColumns(
        {
            "estimated_improvement": F.when(known, gain).otherwise(F.col("estimated_improvement")),
            "priority": F.when(known, priority_of(gain)).otherwise(F.col("priority")),
        }
    )
    return rescored.withColumn("cost", F.when(known, cost_of(F.col("priority"))).otherwise(F.col("cost"))).select(
        *stored.columns
    )


def merge_first_wins(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which the earliest source holding a key supplies its row."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for c in union.columns if c != "_source"]
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct("_source", *rest)).alias("_r")
    return union.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*columns)


def alternate_sources(left: DataFrame, right: DataFrame, text: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Two newest-first lists taken in turns, one row per text; ``limit`` ends the joint list.

    Each list holds a text once, at its newest row, before rows are ranked, so that repeats use up no turn.
    """

    def ranked(df: DataFrame, source: int) -> DataFrame:
        keys = [F.col(order[0]).desc(), *order[1:]]
        clean = df.withColumn("_text", F.trim(F.coalesce(F.col(text), F.lit("")))).where("_text <> ''")
        newest = F.max_by(F.struct(*df.columns), F.struct(order[0], *[-F.col(c) for c in order[1:]])).alias("r")
        once = clean.groupBy("_text").agg(newest).select("_text", "r.*")
        return ordered_index(once, keys, "_rank").withColumn("_source", F.lit(source))

    both = ranked(left, 0).unionByName(ranked(right, 1))
    rest = [c for c in left.columns if c != text]
    firsts = both.groupBy("_text").agg(F.min(F.struct("_rank", "_source", text, *rest)).alias("r"))
    if limit is not None:
        firsts = firsts.orderBy("r._rank", "r._source").limit(limit)
    return firsts.select(*[F.col(f"r.{c}") for c in left.columns])


def genuine_recommendations(
    recommendations: DataFrame, catalog: DataFrame, pairs: DataFrame, min_evidence: int = 0
) -> DataFrame:
    """Only pairs whose table and column exist and that enough log rows name; one row per target.

    ``pairs`` is ``table_column_candidates`` of the distinct texts with their row count ``n``.
    """
    known = catalog.select(
        F.concat_ws(".", "layer", "table_name").alias("table_name"), "column_name"
    ).distinct()
    real = recommendations.join(known, ["table_name", "column_name"], "left_semi")
    if min_evidence > 0:
        # A statement names a pair once per kind: the larger kind counts its rows once.
        hits = (
            pairs.groupBy("type", "table_name", "column_name")
            .agg(F.sum("n").alias("_n"))
            .groupBy("table_name", "column_name")
            .agg(F.max("_n").alias("_hits"))
            .where(F.col("_hits") >= min_evidence)
        )
        real = real.join(hits, ["table_name", "column_name"], "left_semi")
    keys = ["type", "table_name", "column_name"]
    rest = [c for c in recommendations.columns if c not in keys]
    first = [priority_rank(F.col("priority")).alias("_rank"), F.col("query_count").alias("_n")]
    best = F.max(F.struct(*first, *rest)).alias("_r")
    return real.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*recommendations.columns)


def suppress_applied(recommendations: DataFrame, applied: DataFrame) -> DataFrame:
    """Without pairs already applied, whether recorded with or without the layer name."""
    done = applied.where(F.lower(F.coalesce("recommendation_type", F.lit(""))).isin("index", "partition")).select(
        F.lower(F.trim("recommendation_type")).alias("type"),
        F.lower(F.trim("table_name")).alias("_t"),
        F.lower(F.try_element_at(tolerant_list("column_names"), F.lit(1))).alias("_c"),
    )
    done = done.where((F.col("_t") != "") & F.col("_c").isNotNull())
    bare = F.regexp_replace("_t", r"^[^.]*\.", "")
    names = done.select("type", F.explode(F.array_distinct(F.array("_t", bare))).alias("_t"), "_c").distinct()
    own = F.lower("table_name")
    spelled = recommendations.withColumn("_key", F.lower("column_name"))
    for name in (own, F.regexp_replace(own, r"^[^.]*\.", "")):
        spelled = spelled.withColumn("_name", name).alias("r").join(
            names.alias("n"),
            (F.col("r.type") == F.col("n.type")) & (F.col("r._name") == F.col("n._t")) & (F.col("r._key") == F.col("n._c")),
            "left_anti",
        )
    return spelled.select(*recommendations.columns)


def with_status(recommendations: DataFrame, status: str) -> DataFrame:
    """Rows of one status; a missing or blank one counts as pending."""
    return recommendations.where(F.lower(F.coalesce(trimmed("status"), F.lit("pending"))) == status)


def pending_recommendations(stored: DataFrame, limit: int | None = None) -> DataFrame:
    pending = with_status(stored, "pending").withColumn("status_norm", F.coalesce(trimmed("status"), F.lit("pending")))
    if limit is None:
        return pending
    return pending.orderBy(F.col("applied_at").desc(), "recommendation_id").limit(limit)


def optimization_history(applied: DataFrame, limit: int = 50) -> DataFrame:
    """Newest applied changes with their columns as a list."""
    newest = applied.orderBy(F.col("applied_at").desc(), "recommendation_id").limit(limit)
    return newest.select(
        "recommendation_id",
        F.coalesce("recommendation_type", F.lit("index")).alias("type"),
        F.coalesce("table_name", F.lit("")).alias("table_name"),
        F.array_join(F.coalesce(tolerant_list("column_names"), F.array().cast("array<string>")), ",").alias("columns"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("query_count", F.lit(0)).alias("query_count"),
        F.coalesce("estimated_improvement", F.lit(0.0)).alias("estimated_improvement"),
        "applied_at",
    )


def monthly_applies(applied: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Changes per month over the last months, zero where there were none."""
    here = date.fromisoformat(str(as_of)).replace(day=1)
    first = F.add_months(F.lit(here), -(months - 1))
    spine = applied.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.lit(here), F.expr("interval 1 month"))).alias("m")
    )
    sums = applied.groupBy(F.to_date(F.date_trunc("month", "applied_at")).alias("m")).agg(
        F.count("*").alias("applied"),
        F.sum(F.round("estimated_improvement", 6).cast("decimal(18,6)")).cast("double").alias("gain"),
    )
    return F.broadcast(spine).join(sums, "m", "left").select(
        F.date_format("m", "yyyy-MM").alias("month_key"),
        F.coalesce("applied", F.lit(0)).alias("applied"),
        F.coalesce("gain", F.lit(0.0)).alias("sum_estimated_improvement"),
    )
