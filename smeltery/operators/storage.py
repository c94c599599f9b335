"""Storage, cache and cost figures over a frame of table statistics.

``table_stats`` has one row per table: layer, table_name, bytes, table_bytes, row_count,
inserts, updates, deletes, live, dead, hits, reads. It is as long as the catalog, so the
windows over it are small.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from smeltery.functions.exprs import ladder

GIB = 1024**3
# Fixed values.
COST_PER_GB_MONTH = 0.10
UNCOMPRESSED_FACTOR = 2.5
HIT_STEPS = ((95, "excellent"), (85, "good"), (70, "fair"))
LAYERS = ("bronze", "silver", "gold")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.when(whole > 0, part.cast("double") / whole.cast("double") * 100), 2), F.lit(0.0))


def storage_utilization(stats: DataFrame) -> DataFrame:
    """Bytes of every table with its share of the layer and of everything."""
    own = F.coalesce(F.col("bytes"), F.lit(0))
    layer_total = F.sum(own).over(W.partitionBy("layer"))
    whole = stats.agg(F.sum("bytes")).scalar()
    return stats.select(
        "layer",
        "table_name",
        own.alias("size_bytes"),
        (own - F.coalesce("table_bytes", F.lit(0))).alias("extra_bytes"),
        layer_total.alias("layer_bytes"),
        _share(own, layer_total).alias("percentage"),
        _share(own, whole).alias("overall_percentage"),
    )


def _top(stats: DataFrame, size: str, n: int | None) -> DataFrame:
    if n is None:
        return stats
    order = W.partitionBy("layer").orderBy(F.col(size).desc_nulls_last(), "table_name")
    return stats.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def growth_trends(stats: DataFrame, days: int = 30, largest: int | None = None) -> DataFrame:
    """Net operations per day and growth in percent per layer; ``largest`` looks at that many tables only."""
    sums = (
        _top(stats, "live", largest)
        .groupBy("layer")
        .agg(
            F.coalesce(F.sum("live"), F.lit(0)).alias("current_size"),
            F.coalesce(F.sum(F.col("inserts") + F.col("updates") - F.col("deletes")), F.lit(0)).alias("total_operations"),
        )
    )
    per_day = F.col("total_operations") / F.lit(float(days)) if days > 0 else F.lit(0.0)
    rate = F.when(F.col("current_size") > 0, per_day / F.col("current_size") * 100).otherwise(0.0)
    return sums.select(
        "layer",
        "current_size",
        "total_operations",
        F.round(per_day, 2).alias("daily_growth"),
        F.round(rate, 4).alias("growth_rate_percent"),
    )


def growth_points(trends: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The straight line back from today's size, never below zero, one row per layer and day."""
    today = date.fromisoformat(str(as_of))
    spine = F.sequence(F.lit(today - timedelta(days=days)), F.lit(today))
    spread = trends.select("*", F.explode(spine).alias("day"))
    back = F.datediff(F.lit(today), F.col("day"))
    size = F.greatest(F.lit(0.0), F.col("current_size").cast("double") - F.col("daily_growth") * back)
    return spread.select("layer", "day", size.alias("projected_size"))


def compression_stats(stats: DataFrame, largest: int | None = None) -> DataFrame:
    """Fixed-factor estimate for the tables of every layer, and the layer mean; ``largest`` keeps that many a layer."""
    filled = (F.col("row_count") > 0) & (F.col("table_bytes") > 0)
    saved = (UNCOMPRESSED_FACTOR - 1) / UNCOMPRESSED_FACTOR * 100
    top = _top(stats, "bytes", largest).select(
        "layer",
        "table_name",
        "row_count",
        F.when(filled, UNCOMPRESSED_FACTOR).otherwise(1.0).alias("compression_ratio"),
        F.when(filled, saved).otherwise(0.0).alias("compression_percentage"),
    )
    mean = F.round(F.avg("compression_ratio").over(W.partitionBy("layer")), 2)
    return top.withColumn("layer_average_ratio", mean)


def _hit_rate(hits: Column, reads: Column) -> Column:
    total = hits + reads
    return F.when(total > 0, hits.cast("double") / total * 100).otherwise(0.0)


def cache_performance(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """Hit rate and grade of every table and of all together; ``limit`` lists only the most hit tables."""
    hits, reads = F.coalesce("hits", F.lit(0)), F.coalesce("reads", F.lit(0))
    counted = stats.select(
        "layer", F.concat_ws(".", "layer", "table_name").alias("table_name"), hits.alias("cache_hits"), reads.alias("disk_reads")
    )
    shown = counted if limit is None else counted.orderBy(F.col("cache_hits").desc(), "layer", "table_name").limit(limit)
    per_table = shown.drop("layer")
    overall = counted.agg(
        F.sum("cache_hits").alias("cache_hits"), F.sum("disk_reads").alias("disk_reads")
    ).select(F.lit("overall").alias("table_name"), "cache_hits", "disk_reads")
    rate = _hit_rate(F.col("cache_hits"), F.col("disk_reads"))
    return per_table.unionByName(overall).select(
        "*", F.round(rate, 2).alias("hit_rate"), ladder(rate, HIT_STEPS, "poor").alias("status")
    )


def cost_tracking(stats: DataFrame) -> DataFrame:
    """Monthly and yearly cost per layer and in total."""
    sums = stats.groupBy("layer").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("b"))
    gb = F.col("b") / GIB
    month = gb * COST_PER_GB_MONTH
    rows = sums.select(
        "layer",
        F.round(gb, 2).alias("storage_gb"),
        F.round(month, 2).alias("monthly_cost"),
        F.round(month * 12, 2).alias("yearly_cost"),
    )
    total = rows.agg(
        F.round(F.sum("storage_gb"), 2).alias("storage_gb"),
        F.round(F.sum("monthly_cost"), 2).alias("monthly_cost"),
        F.round(F.sum("yearly_cost"), 2).alias("yearly_cost"),
    ).select(F.lit("total").alias("layer"), "storage_gb", "monthly_cost", "yearly_cost")
    return rows.unionByName(total)


def largest_tables(stats: DataFrame, n: int = 20) -> DataFrame:
    """Largest tables over all layers."""
    order = [F.col("bytes").desc_nulls_last(), "layer", "table_name"]
    return stats.orderBy(*order).limit(n).select(
        F.concat_ws(".", "layer", "table_name").alias("name"),
        F.col("bytes").alias("size_bytes"),
        (F.col("bytes") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
    )


def storage_by_layer(stats: DataFrame) -> DataFrame:
    sums = stats.groupBy("layer").agg(F.sum("bytes").alias("total_bytes"))
    return sums.withColumn("storage_gb", F.col("total_bytes") / F.lit(float(GIB)))


def resource_metrics(stats: DataFrame) -> DataFrame:
    """Long form: one row per resource and measure."""
    hits, reads = F.coalesce("hits", F.lit(0)), F.coalesce("reads", F.lit(0))
    wide = stats.select(
        "layer",
        F.col("table_name").alias("resource_name"),
        F.col("bytes").cast("double").alias("size_bytes"),
        F.col("live").cast("double").alias("live_rows"),
        F.col("dead").cast("double").alias("dead_rows"),
        _hit_rate(hits, reads).alias("cache_hit_ratio"),
    )
    tall = wide.unpivot(
        ["layer", "resource_name"],
        ["size_bytes", "live_rows", "dead_rows", "cache_hit_ratio"],
        "metric",
        "value",
    )
    return tall.select(F.lit("table").alias("resource_type"), "layer", "resource_name", "metric", "value")
