"""Marts known by their columns only; the formulas are ours and stand in each docstring.

Every mart first sums per fine key (customer and month, day and product, session) and only
then joins or ranks, so a hot customer, product or day is a handful of rows by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from smeltery.functions.exprs import money, money_ratio, ratio, trimmed
from smeltery.functions.ordered import position_in_key

# Words of the sentiment score.
POSITIVE = ("great", "good", "love", "excellent", "perfect", "happy", "nice", "best")
NEGATIVE = ("bad", "broken", "poor", "terrible", "worst", "hate", "slow", "refund")
DEVICE = "device_type string, browser string, os string"
SEARCH_HOSTS = ("google", "bing", "duckduckgo", "yahoo")
SOCIAL_HOSTS = ("facebook", "instagram", "twitter", "tiktok", "pinterest")


def _upto(*keys: str):
    return W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, 0)


def _capped(part: Column, whole: Column) -> Column:
    """A rate between 0 and 1; 0 where there is nothing to divide by."""
    rate = ratio(part, whole)
    return F.when(rate.isNull(), 0.0).when(rate > 1, 1.0).otherwise(rate)


def cohort_analysis(orders: DataFrame) -> DataFrame:
    """Customers by month of first order, followed month by month.

    Retention is active over all customers of the cohort; sums run on over the periods.
    """
    monthly = orders.groupBy("customer_key", F.trunc("order_date", "month").alias("m")).agg(
        F.sum("order_total").alias("s"), F.count_distinct("order_id").alias("n")
    )
    first = monthly.groupBy("customer_key").agg(F.min("m").alias("cohort_month"))
    size = first.groupBy("cohort_month").agg(F.count("*").alias("customers"))
    months = (F.year("m") - F.year("cohort_month")) * 12 + F.month("m") - F.month("cohort_month")
    cells = (
        monthly.join(first, "customer_key")
        .groupBy("cohort_month", months.alias("period_number"))
        .agg(F.count("*").alias("active_customers"), F.sum("s").alias("revenue"), F.sum("n").alias("orders"))
    )
    over = _upto("cohort_month", "period_number")
    return cells.join(size, "cohort_month").select(
        "cohort_month",
        "period_number",
        "customers",
        "active_customers",
        ratio(F.col("active_customers"), F.col("customers")).alias("retention_rate"),
        money(F.col("revenue"), 18).alias("revenue"),
        money(F.sum("revenue").over(over), 18).alias("cumulative_revenue"),
        money_ratio(F.col("revenue"), F.col("orders")).alias("average_order_value"),
        "orders",
        F.sum("orders").over(over).alias("cumulative_orders"),
    )


def conversion_funnel(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per day and channel: visitors and how many of them reached each stage.

    A stage counts distinct visitors with such an event; a bounce is a session of one page.
    """

    def had(kind: str) -> Column:
        return F.max((F.col("event_type") == kind).cast("int"))

    per_session = events.groupBy("session_id").agg(
        F.count_if(F.col("event_type") == "page_view").alias("views"),
        had("add_to_cart").alias("cart"),
        had("checkout").alias("checkout"),
        had("purchase").alias("purchase"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    joined = sessions.join(per_session, "session_id", "left")

    def reached(stage: str) -> Column:
        return F.count_distinct(F.when(F.col(stage) == 1, F.col("user_id")))

    sums = joined.groupBy(F.col("session_date").alias("date_key"), "channel").agg(
        F.count_distinct("user_id").alias("visitors"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("page_views"),
        reached("cart").alias("add_to_carts"),
        reached("checkout").alias("checkouts"),
        reached("purchase").alias("purchases"),
        F.sum(seconds).alias("_seconds"),
        F.count("*").alias("_sessions"),
        F.count_if(F.col("page_count") == 1).alias("_bounced"),
    )
    c = F.col
    return sums.select(
        "date_key",
        "channel",
        "visitors",
        "page_views",
        "add_to_carts",
        "checkouts",
        "purchases",
        _capped(c("purchases"), c("visitors")).alias("conversion_rate"),
        (F.when(c("add_to_carts") > 0, 1.0).otherwise(0.0) - _capped(c("purchases"), c("add_to_carts"))).alias("cart_abandonment_rate"),
        _capped(c("add_to_carts"), c("visitors")).alias("visitors_to_cart_rate"),
        _capped(c("checkouts"), c("add_to_carts")).alias("cart_to_checkout_rate"),
        _capped(c("purchases"), c("checkouts")).alias("checkout_to_purchase_rate"),
        F.floor(c("_seconds") / c("_sessions")).cast("int").alias("average_session_duration_seconds"),
        _capped(c("_bounced"), c("_sessions")).alias("bounce_rate"),
    )


def customer_360(customer: DataFrame, orders: DataFrame, items: DataFrame, product: DataFrame, reviews: DataFrame, as_of) -> DataFrame:
    """One row per customer.

    Frequency is orders per 30 days of tenure, churn risk is days since the last order over
    a year, at most 1. VIP from 20 orders, REGULAR from 5, NEW below, INACTIVE without any.
    """
    per_order = items.groupBy("order_key").agg(F.sum("net_amount").alias("net"))
    sums = (
        orders.join(per_order, "order_key", "left")
        .groupBy("customer_key")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.coalesce(F.sum("net"), F.lit(0)).alias("ltv"),
            F.min("order_date").alias("first_purchase_date"),
            F.max("order_date").alias("last_purchase_date"),
            F.max_by("order_total", F.struct("order_date", "order_id")).alias("last_order_amount"),
        )
    )
    lines = items.groupBy("order_key", "product_key").agg(F.sum("net_amount").alias("net"))
    spend = (
        lines.join(orders.select("order_key", "customer_key"), "order_key")
        .groupBy("customer_key", "product_key")
        .agg(F.sum("net").alias("net"))
        .join(product.select("product_key", "category_name"), "product_key")
        .groupBy("customer_key", "category_name")
        .agg(F.sum("net").alias("net"))
    )
    favourite = spend.groupBy("customer_key").agg(
        F.max_by("category_name", F.struct("net", "category_name")).alias("favorite_category")
    )
    rated = reviews.where(F.col("rating").between(1, 5)).groupBy("customer_key").agg(
        F.count("*").alias("total_reviews"), ratio(F.sum("rating"), F.count("*")).alias("average_rating")
    )
    today = F.to_date(F.lit(str(as_of)))
    base = (
        customer.select("customer_key", "customer_id")
        .join(sums, "customer_key", "left")
        .join(favourite, "customer_key", "left")
        .join(rated, "customer_key", "left")
    )
    n = F.coalesce("total_orders", F.lit(0))
    away = F.datediff(today, F.col("last_purchase_date"))
    since = F.datediff(today, F.col("first_purchase_date"))
    segment = F.when(n == 0, "INACTIVE").when(n >= 20, "VIP").when(n >= 5, "REGULAR").otherwise("NEW")
    return base.select(
        "customer_key",
        "customer_id",
        money(F.coalesce("ltv", F.lit(0)), 18).alias("lifetime_value"),
        n.alias("total_orders"),
        money_ratio(F.col("ltv"), F.col("total_orders")).alias("average_order_value"),
        ratio(n * 30, F.greatest(since, F.lit(1))).alias("purchase_frequency"),
        away.alias("days_since_last_purchase"),
        since.alias("days_since_first_purchase"),
        segment.alias("customer_segment"),
        F.coalesce(F.least(F.lit(1.0), away / F.lit(365.0)), F.lit(1.0)).alias("churn_risk_score"),
        "favorite_category",
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        "average_rating",
        "first_purchase_date",
        "last_purchase_date",
        "last_order_amount",
    )


def daily_sales_summary(orders: DataFrame, items: DataFrame, product: DataFrame) -> DataFrame:
    """Per day: totals, new and returning customers, best category and product by net revenue."""
    per_order = items.groupBy("order_key").agg(
        F.sum("net_amount").alias("net"), F.sum("quantity").alias("qty"), F.sum("discount_amount").alias("off")
    )
    first = orders.groupBy("customer_key").agg(F.min("order_date").alias("first_date"))
    days = (
        orders.join(per_order, "order_key", "left")
        .groupBy("order_date", "customer_key")
        .agg(
            F.count_distinct("order_id").alias("n"), F.sum("net").alias("net"), F.sum("qty").alias("qty"), F.sum("off").alias("off")
        )
        .join(first, "customer_key")
    )
    fresh = F.col("order_date") == F.col("first_date")
    totals = days.groupBy("order_date").agg(
        F.sum("n").alias("total_orders"),
        money(F.coalesce(F.sum("net"), F.lit(0)), 18).alias("total_revenue"),
        money(F.coalesce(F.sum("qty"), F.lit(0)), 18).alias("total_items_sold"),
        F.count("*").alias("unique_customers"),
        F.count_if(fresh).alias("new_customers"),
        F.count_if(~fresh).alias("returning_customers"),
        money(F.coalesce(F.sum("off"), F.lit(0)), 18).alias("total_discount_amount"),
    )
    per_product = (
        items.join(orders.select("order_key", "order_date"), "order_key")
        .groupBy("order_date", "product_key")
        .agg(F.sum("net_amount").alias("net"))
        .join(product.select("product_key", "category_name"), "product_key")
    )
    best_product = per_product.groupBy("order_date").agg(
        F.max_by("product_key", F.struct("net", -F.col("product_key"))).alias("top_product_key")
    )
    per_category = per_product.groupBy("order_date", "category_name").agg(F.sum("net").alias("net"))
    best_category = per_category.groupBy("order_date").agg(F.max(F.struct("net", "category_name")).alias("c"))
    return (
        totals.join(best_product, "order_date", "left")
        .join(best_category, "order_date", "left")
        .select(
            F.col("order_date").alias("date_key"),
            "total_orders",
            "total_revenue",
            "total_items_sold",
            money_ratio(F.col("total_revenue"), F.col("total_orders")).alias("average_order_value"),
            "unique_customers",
            "new_customers",
            "returning_customers",
            F.col("c.category_name").alias("top_category"),
            "top_product_key",
            money(F.col("c.net"), 18).alias("top_category_revenue"),
            ratio(F.col("total_items_sold"), F.col("total_orders")).alias("average_items_per_order"),
            "total_discount_amount",
        )
    )


def signed_quantity() -> Column:
    """IN and TRANSFER add, OUT takes away, ADJUSTMENT counts as written."""
    kind, quantity = F.upper("movement_type"), F.col("quantity")
    return F.when(kind == "OUT", -F.abs(quantity)).otherwise(quantity)


def inventory_snapshots(movements: DataFrame) -> DataFrame:
    """Stock level per product and warehouse for every day it moved, with the last day it holds.

    Movements are summed per day before the running total: a pair has one row per day.
    """
    daily = movements.groupBy("product_key", "warehouse_key", F.col("movement_date").alias("snapshot_date")).agg(
        F.sum(signed_quantity()).alias("net_change")
    )
    keys = ("product_key", "warehouse_key")
    following = F.lead("snapshot_date").over(W.partitionBy(*keys).orderBy("snapshot_date"))
    return daily.select(
        *keys,
        "snapshot_date",
        "net_change",
        F.sum("net_change").over(_upto(*keys, "snapshot_date")).alias("quantity_on_hand"),
        F.date_sub(following, 1).alias("holds_until"),
    )


def every_day(snapshots: DataFrame, as_of) -> DataFrame:
    """One row per calendar day, each level repeated until the next movement."""
    last = F.coalesce("holds_until", F.to_date(F.lit(str(as_of))))
    held = snapshots.where(last >= F.col("snapshot_date"))
    days = F.explode(F.sequence("snapshot_date", last))
    return held.select("product_key", "warehouse_key", days.alias("snapshot_date"), "quantity_on_hand")


def inventory_health(movements: DataFrame, as_of, days: int = 90, lead_days: int = 7, safety_days: int = 3) -> DataFrame:
    """Stock against demand of the trailing days.

    Demand is outgoing quantity per day; safety stock is three days of it, the reorder point
    a week of it plus safety, the best level a month of it plus safety. More than twice the
    best level is overstock, less than the reorder point is understock.
    """
    day = date.fromisoformat(str(as_of))
    since = F.lit(day - timedelta(days=days))
    keys = ["product_key", "warehouse_key"]
    levels = inventory_snapshots(movements)
    stock = levels.groupBy(*keys).agg(
        F.max_by("quantity_on_hand", "snapshot_date").alias("current_stock"),
        F.count_if(F.col("quantity_on_hand") <= 0).alias("stockout_frequency"),
    )
    out = movements.where(
        (F.upper("movement_type") == "OUT") & (F.col("movement_date") > since) & (F.col("movement_date") <= F.lit(day))
    )
    demand = out.groupBy(*keys).agg(F.sum(F.abs("quantity")).alias("_out"))
    joined = stock.join(demand, keys, "left").withColumn("_out", F.coalesce("_out", F.lit(0)))
    per_day = F.col("_out") / F.lit(float(days))
    safety = F.ceil(F.col("_out") * safety_days / F.lit(float(days)))
    reorder = F.ceil(F.col("_out") * lead_days / F.lit(float(days))) + safety
    best = F.ceil(F.col("_out") * 30 / F.lit(float(days))) + safety
    current = F.col("current_stock")
    return joined.select(
        *keys,
        "current_stock",
        F.when(F.col("_out") > 0, F.greatest(F.lit(0), F.floor(current * days / F.col("_out")))).alias("days_of_supply"),
        "stockout_frequency",
        (current > best * 2).alias("overstock_flag"),
        (current < reorder).alias("understock_flag"),
        reorder.alias("reorder_point"),
        safety.alias("safety_stock"),
        best.alias("optimal_stock_level"),
        per_day.alias("average_daily_demand"),
        F.when(current > 0, F.col("_out") / current).alias("stock_velocity"),
        F.lit(day).alias("snapshot_date"),
    )


def product_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with a rating from 1 to 5 and a word score between -1 and 1.

    The score is (positive - negative) / (positive + negative) words, 0 without any.
    """
    words = F.split(F.lower(F.coalesce("review_text", F.lit(""))), r"[^a-z]+")
    good = F.size(F.filter(words, lambda w: w.isin(*POSITIVE)))
    bad = F.size(F.filter(words, lambda w: w.isin(*NEGATIVE)))
    scored = raw.where(F.col("rating").between(1, 5)).withColumns({"_g": good, "_b": bad})
    return scored.select(
        "review_id",
        "product_key",
        "customer_key",
        "rating",
        trimmed("review_text").alias("review_text"),
        F.coalesce(ratio(F.col("_g") - F.col("_b"), F.col("_g") + F.col("_b")), F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("verified_purchase", F.lit(False)).alias("is_verified_purchase"),
        "review_date",
    )


def product_performance(
    orders: DataFrame, items: DataFrame, product: DataFrame, reviews: DataFrame, stock: DataFrame, returns: DataFrame, as_of
) -> DataFrame:
    """Sales, ratings, returns and turnover of every product, ranked by revenue in its category.

    Turnover is units sold over units on hand, the return rate units of ``returns`` (product_key, quantity) over
    units sold; both are null without what they are divided by.
    """
    dated = items.join(orders.select("order_key", "order_date"), "order_key")
    sums = dated.groupBy("product_key").agg(
        F.sum("quantity").alias("units"), F.sum("net_amount").alias("revenue"), F.max("order_date").alias("last_sale")
    )
    stars = {f"total_reviews_{k}_star": F.count_if(F.col("rating") == k) for k in range(5, 0, -1)}
    rated = reviews.groupBy("product_key").agg(
        F.count("*").alias("review_count"),
        ratio(F.sum("rating"), F.count("*")).alias("average_rating"),
        ratio(F.sum(F.round(F.col("sentiment_score"), 6).cast("decimal(18,6)")), F.count("*")).alias("average_sentiment_score"),
        *[c.alias(n) for n, c in stars.items()],
    )
    on_hand = stock.groupBy("product_key").agg(F.sum("quantity_on_hand").alias("on_hand"))
    joined = (
        product.select("product_key", "product_id", "product_name", F.col("category_name").alias("category"))
        .join(sums, "product_key", "left")
        .join(rated, "product_key", "left")
        .join(on_hand, "product_key", "left")
        .join(returns.groupBy("product_key").agg(F.sum("quantity").alias("returned")), "product_key", "left")
    )
    revenue = money(F.coalesce("revenue", F.lit(0)), 18)
    order = [F.col("total_revenue").desc(), F.col("product_key")]
    rows = position_in_key(joined.withColumn("total_revenue", revenue), ["category"], order, "category_rank")
    return rows.select(
        "product_key",
        "product_id",
        "product_name",
        "category",
        money(F.coalesce("units", F.lit(0)), 18).alias("total_units_sold"),
        "total_revenue",
        "average_rating",
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        ratio(F.coalesce("units", F.lit(0)), F.col("on_hand")).alias("inventory_turnover"),
        ratio(F.coalesce("returned", F.lit(0)), F.col("units")).alias("return_rate"),
        F.datediff(F.to_date(F.lit(str(as_of))), F.col("last_sale")).alias("days_since_last_sale"),
        "category_rank",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in stars],
        "average_sentiment_score",
    )


def page_category(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (
        F.when(url.isNull(), "unknown")
        .when(path.startswith("/product"), "product")
        .when(path.startswith("/cart"), "cart")
        .when(path.startswith("/checkout"), "checkout")
        .when(path.isin("", "/"), "home")
        .otherwise("other")
    )


def referrer_category(url: Column, own_host: str) -> Column:
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    return (
        F.when(url.isNull(), "direct")
        .when(host == own_host, "internal")
        .when(host.rlike("|".join(SEARCH_HOSTS)), "search")
        .when(host.rlike("|".join(SOCIAL_HOSTS)), "social")
        .otherwise("referral")
    )


def user_events(clickstream: DataFrame, own_host: str = "shop.example") -> DataFrame:
    """Clickstream with its device text as columns and pages and referrers in groups."""
    device = F.from_json("device_info", DEVICE)
    return clickstream.withColumn("_d", device).select(
        "event_id",
        "session_id",
        "user_id",
        "event_type",
        page_category(F.col("page_url")).alias("page_category"),
        "page_url",
        referrer_category(F.col("referrer"), own_host).alias("referrer_category"),
        F.col("referrer").alias("referrer_url"),
        F.coalesce("_d.device_type", F.lit("unknown")).alias("device_type"),
        F.col("_d.browser").alias("browser"),
        F.col("_d.os").alias("operating_system"),
        "event_timestamp",
    )


def product_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/product/([0-9]+)", 1), F.lit("")).try_cast("long")


def real_time_dashboard(events: DataFrame, product: DataFrame) -> DataFrame:
    """Per day and hour: orders, revenue, users, rates, the most valuable product page and category.

    A purchase event is an order worth its value; rates are over the hour's visitors and carts.
    """
    hour = F.date_trunc("hour", "event_timestamp")
    kind = F.col("event_type")
    bought = kind == "purchase"
    sums = events.groupBy(hour.alias("_h")).agg(
        F.count_if(bought).alias("orders_today"),
        money(F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0)), 18).alias("revenue_today"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_if(kind == "page_view").alias("page_views"),
        F.count_distinct(F.when(kind == "page_view", F.col("user_id"))).alias("unique_visitors"),
        F.count_distinct(F.when(bought, F.col("user_id"))).alias("_buyers"),
        F.count_distinct(F.when(kind == "add_to_cart", F.col("user_id"))).alias("_carts"),
    )
    viewed = events.select(hour.alias("_h"), product_of_url(F.col("page_url")).alias("p"), "value").where("p IS NOT NULL")
    per_product = viewed.groupBy("_h", "p").agg(F.sum("value").alias("v"))
    best = per_product.groupBy("_h").agg(F.max(F.struct("v", "p")).alias("b"))
    kinds = product.select(F.col("product_id").cast("long").alias("p"), "category_name")
    per_category = per_product.join(kinds, "p").groupBy("_h", "category_name").agg(F.sum("v").alias("v"))
    category = per_category.groupBy("_h").agg(F.max(F.struct("v", "category_name")).alias("k"))
    return dashboard_figures(sums.join(best, "_h", "left").join(category, "_h", "left"))


def dashboard_figures(hours: DataFrame) -> DataFrame:
    """The shown figures of rows with the hour, its counts, and the best product ``b`` and category ``k``."""
    return hours.select(
        F.to_date("_h").alias("metric_date"),
        F.hour("_h").alias("metric_hour"),
        "orders_today",
        "revenue_today",
        "active_users",
        (F.when(F.col("_carts") > 0, 1.0).otherwise(0.0) - _capped(F.col("_buyers"), F.col("_carts"))).alias("cart_abandonment_rate"),
        F.col("b.p").alias("top_product_id"),
        F.col("b.v").alias("top_product_value"),
        F.col("k.category_name").alias("top_category"),
        F.col("k.v").alias("top_category_revenue"),
        money_ratio(F.col("revenue_today"), F.col("orders_today")).alias("average_order_value"),
        _capped(F.col("_buyers"), F.col("active_users")).alias("conversion_rate"),
        "page_views",
        "unique_visitors",
    )


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str], run_ts) -> DataFrame:
    """History with the incoming rows merged in: changed rows closed and reopened, new keys opened.

    ``current`` holds key, tracked columns, valid_from, valid_to, is_current. Keys missing
    from the incoming rows stay as they are.
    """
    now = F.lit(run_ts).cast("timestamp_ntz")
    open_rows = current.where("is_current")
    print_of = F.sha2(F.to_json(F.struct(*tracked), {"ignoreNullFields": "false"}), 256)
    fresh = incoming.select(key, *tracked, print_of.alias("_new"))
    paired = open_rows.withColumn("_old", print_of).join(fresh.select(key, "_new"), key, "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("_old"))
    kept = paired.select(
        key,
        *tracked,
        "valid_from",
        F.when(changed, now).otherwise(F.col("valid_to")).alias("valid_to"),
        (~changed).alias("is_current"),
    )
    known = open_rows.select(key, print_of.alias("_old"))
    opened = (
        fresh.join(known, key, "left")
        .where(F.col("_old").isNull() | (F.col("_old") != F.col("_new")))
        .select(
            key, *tracked, now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current")
        )
    )
    columns = [key, *tracked, "valid_from", "valid_to", "is_current"]
    return current.where("NOT is_current").select(*columns).unionByName(kept).unionByName(opened)


BUCKET_DAYS = 32


def version_at(facts: DataFrame, versions: DataFrame, key: str, day: str, columns: Sequence[str]) -> DataFrame:
    """The facts with ``columns`` of the version of their key that was valid on ``day``, null where there is none.

    ``versions`` has key, valid_from, valid_to (null: still open) and the columns; spans of a key do not overlap, and a
    key's first version also counts for days before it. A span is cut into stretches of ``BUCKET_DAYS`` days within the
    days of the facts, so the lookup is an equi-join on key and stretch, never a comparison of all versions of a key.
    """
    on = F.col(day).cast("date")
    days = facts.agg(F.min(on).alias("low"), F.max(on).alias("high"))
    low, high = days.select("low").scalar(), days.select("high").scalar()
    stretch = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("int")
    first = versions.groupBy(key).agg(F.min("valid_from").alias("_first"))
    spans = versions.join(first, key).select(
        F.col(key).alias("_key"),
        F.when(F.col("valid_from") == F.col("_first"), low).otherwise(F.greatest(low, F.to_date("valid_from"))).alias("_from"),
        F.least(F.date_add(high, 1), F.to_date("valid_to")).alias("_to"),
        *[F.col(c).alias(f"_v_{c}") for c in columns],
    )
    cut = spans.where(F.col("_from") < F.col("_to")).select("*", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.date_sub("_to", 1)))).alias("_at"))
    placed = facts.withColumns({"_day": on, "_stretch": stretch(on)})
    match = (F.col(key) == F.col("_key")) & (F.col("_stretch") == F.col("_at")) & (F.col("_day") >= F.col("_from")) & (F.col("_day") < F.col("_to"))
    return placed.join(cut, match, "left").select(*facts.columns, *[F.col(f"_v_{c}").alias(c) for c in columns])
