"""The frames one dashboard page asks for together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from smeltery.operators import alerts, monitoring, reports, workload


def home_dashboard(
    layers: Mapping[str, Mapping[str, DataFrame]], active_alerts: DataFrame, sizes: DataFrame, as_of, days: int = 60
) -> dict[str, DataFrame]:
    """Warehouse summary with the stored bytes of ``sizes`` (layer, bytes), sales, top products, customers and alerts."""
    gold = layers["gold"]
    return {
        "warehouse_summary": reports.warehouse_summary(layers, sizes),
        "sales_totals": reports.sales_totals(gold["fact_sales"]),
        "sales_daily": reports.sales_daily(gold["fact_sales"], as_of, days),
        "top_products": reports.top_products(gold["fact_sales"], gold["dim_product"]),
        "customer_stats": reports.customer_stats(gold["dim_customer"], gold["fact_orders"]),
        "alerts_by_severity": alerts.alerts_by_severity(active_alerts),
    }


def monitoring_dashboard(runs: DataFrame, jobs: DataFrame, stats: DataFrame, now) -> dict[str, DataFrame]:
    """Runs, errors, throughput, freshness and quality."""
    fresh = monitoring.freshness(runs, jobs, stats, now)
    history = monitoring.job_history(runs, jobs)
    scores = monitoring.quality_score(stats, runs, now)
    return {
        "job_history": history,
        "etl_errors": monitoring.etl_errors(runs, jobs, stats, now),
        "throughput": monitoring.throughput(runs, stats, now),
        "freshness": fresh,
        "freshness_by_layer": monitoring.freshness_by_layer(fresh),
        "quality": scores,
        "quality_by_layer": monitoring.quality_by_layer(scores),
        "kpis": monitoring.etl_kpis(history, fresh),
    }


def analytics_dashboard(logs: DataFrame, as_of, long_days: int = 30, limit: int = 100) -> dict[str, DataFrame]:
    """Latency windows, hotspots, rollups and key figures of the query log."""
    counts = workload.window_day_counts(logs, as_of, long_days)
    windows = workload.query_performance_windows(logs, as_of, long_days, limit, counts)
    week = workload.window_bounds(as_of, long_days)["7d"]
    hourly = workload.hourly_calls(logs, week, str(as_of))
    return {
        "windows": windows,
        "hotspots": workload.hotspots(windows),
        "rollups": workload.window_rollups(logs, as_of, counts),
        "hourly": hourly,
        "buckets": workload.bucket_rollup(hourly, 6),
        "kpis": workload.workload_kpis(windows.where("window = '7d'")),
        "cache": workload.weighted_cache_hit_rate(windows.where("window = '7d'")),
    }
