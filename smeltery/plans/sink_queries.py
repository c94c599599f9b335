"""Merge and ingest queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from smeltery.plans.registry import query, sql_table
from smeltery.sources import tables
from smeltery.sources.activity_log import parse_lines

_NEW_YEAR = "order_date < DATE'2001-01-01'"


@query(
    "bronze_ingest",
    """SELECT o_orderkey, o_custkey, 'shop' AS _source_system, TIMESTAMP '2001-08-02 06:00:00' AS _load_timestamp, 7 AS _batch_id FROM orders
       WHERE o_orderkey + 1 NOT IN (SELECT order_id FROM silver_orders WHERE order_date < DATE '2001-01-01')""",
)
def _ingest(t):
    have = t("silver_orders").where(_NEW_YEAR).select((F.col("order_id") - 1).alias("o_orderkey"))
    return tables.bronze_ingest(
        t("orders").select("o_orderkey", "o_custkey"), 7, "shop", "2001-08-02 06:00:00", have, ["o_orderkey"]
    )


@query(
    "insert_ignore",
    """SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem
       WHERE l_orderkey + 1 NOT IN (SELECT order_id FROM silver_orders WHERE order_date < DATE '2001-01-01') GROUP BY ALL""",
)
def _insert_ignore(t):
    target = t("lineitem").join(
        t("silver_orders").where(_NEW_YEAR).select((F.col("order_id") - 1).alias("l_orderkey")), "l_orderkey", "left_semi"
    )
    return tables.insert_ignore(
        target, t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"]
    )


sql_table(
    "seen_first",
    "SELECT user_id, MIN(ts) AS first_seen, MAX(ts) AS last_seen, COUNT(*) AS n, ARG_MAX(event_type, (ts, event_id)) AS last_type FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1",
)
sql_table(
    "seen_next",
    "SELECT user_id, MIN(ts) AS first_seen, MAX(ts) AS last_seen, COUNT(*) AS n, CASE WHEN ARG_MAX(event_type, (ts, event_id)) = 'error' THEN NULL ELSE ARG_MAX(event_type, (ts, event_id)) END AS last_type FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND user_id <> 7 GROUP BY 1",
)


def _seen(df, mask_errors):
    kind = F.max_by("event_type", F.struct("ts", "event_id"))
    kind = F.when(kind != "error", kind) if mask_errors else kind
    return df.groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), kind.alias("last_type")
    )


@query(
    "upsert",
    """SELECT COALESCE(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN b.first_seen WHEN b.user_id IS NULL THEN a.first_seen ELSE LEAST(a.first_seen, b.first_seen) END AS first_seen,
       CASE WHEN a.user_id IS NULL THEN b.last_seen WHEN b.user_id IS NULL THEN a.last_seen ELSE GREATEST(a.last_seen, b.last_seen) END AS last_seen,
       CASE WHEN b.user_id IS NULL THEN a.n ELSE b.n END AS n, CASE WHEN a.user_id IS NULL THEN b.last_type ELSE COALESCE(b.last_type, a.last_type) END AS last_type
       FROM seen_first a FULL OUTER JOIN seen_next b ON a.user_id = b.user_id""",
)
def _upsert(t):
    ts = F.col("ts")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    old = _seen(t("events").where(ts < day("2024-01-10")), False)
    new = _seen(t("events").where((ts >= day("2024-01-09")) & (F.col("user_id") != 7)), True)
    return tables.upsert(
        old, new, ["user_id"], {"first_seen": "least", "last_seen": "greatest", "n": "new", "last_type": "coalesce"}
    )


@query(
    "update_from",
    """SELECT p.product_key, p.category_name, COALESCE(n.quantity_on_hand, 0) AS on_hand, COALESCE(CASE WHEN n.product_key IS NOT NULL THEN n.quantity_available END, -1) AS available
       FROM silver_product p LEFT JOIN (SELECT * FROM silver_inventory WHERE is_valid) n USING (product_key)""",
)
def _update_from(t):
    target = t("silver_product").select("product_key", "category_name", F.lit(0).alias("on_hand"), F.lit(-1).alias("available"))
    source = t("silver_inventory").where("is_valid").select(
        "product_key", F.col("quantity_on_hand").alias("on_hand"), F.col("quantity_available").alias("available")
    )
    return tables.update_from(target, source, ["product_key"], ["on_hand", "available"])


@query(
    "delete_orphans",
    "SELECT snapshot_date_key, product_key FROM gold_inventory_snapshots WHERE product_key IN (SELECT product_key FROM silver_inventory WHERE is_valid)",
)
def _orphans(t):
    snaps = t("gold_inventory_snapshots").select("snapshot_date_key", "product_key")
    return tables.delete_orphans(snaps, t("silver_inventory").where("is_valid"), ["product_key"])


@query(
    "delete_range",
    "SELECT order_id, order_date FROM silver_orders WHERE NOT (order_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')",
)
def _range(t):
    return tables.delete_range(t("silver_orders").select("order_id", "order_date"), "order_date", "1998-01-01", "1999-12-31")


# Log lines in both shapes, with comments, blanks and broken ones between them.
_LINE = """CASE event_id % 7 WHEN 0 THEN '# comment' WHEN 1 THEN '   ' WHEN 2 THEN 'one{tab}two' WHEN 3 THEN '{{"event_type": "click", ' WHEN 4 THEN
    '{{"timestamp": "' || ts || '", "event_type": "route_change", "page": "/p' || user_id || '"}}'
    ELSE ts || '{tab}e' || event_id || '{tab}system{tab}app{tab}/x{tab}s{tab}{{"timestamp": "' || ts || '", "event_id": "e' || event_id || '", "event_type": "' || event_type || '", "message": "m ' || event_id || '"}}' END"""


@query(
    "activity_log_parse",
    """SELECT CASE WHEN event_id % 7 >= 4 THEN ts::VARCHAR END AS timestamp, CASE WHEN event_id % 7 = 4 THEN 'route_change' WHEN event_id % 7 > 4 THEN event_type END AS event_type,
       CASE WHEN event_id % 7 = 4 THEN 'Navigation → /p' || user_id WHEN event_id % 7 > 4 THEN 'm ' || event_id END AS summary, event_id % 7 < 4 AS parse_error FROM events WHERE event_id % 7 >= 2""",
)
def _log(t):
    lines = t("events").select(F.expr(_LINE.format(tab="\\t")).alias("value"))
    return parse_lines(lines).select("timestamp", "event_type", "summary", "parse_error")
