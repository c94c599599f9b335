"""Every registered query; importing the modules fills the registry."""

from smeltery.plans import gold_queries, layout_queries, mart_queries, ml_queries, monitoring_queries, report_queries, silver_queries, sink_queries, stream_queries, workload_queries  # noqa: F401
from smeltery.plans.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
