"""Silver to gold: dimensions, facts, snapshots and aggregates.

``silver`` and ``gold`` are mappings from table name to DataFrame. ``mode="append"``
leaves rows already in the target as they are and adds the missing ones;
``mode="rebuild"`` computes everything anew. ``as_of`` stands for the run date.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from smeltery.functions.exprs import blank_to, date_key, ladder, money, money_ratio, trimmed
from smeltery.functions.keyed import not_yet_in, only_in
from smeltery.functions.ordered import position_in_key

Tables = Mapping[str, DataFrame]
DASH = "—"
FAR = "9999-12-31"
COST_SHARE = Decimal("0.65")
LOOKBACK_DAYS = 730

# Score steps, segments and tiers of the lifetime aggregate.
RECENCY_STEPS = ((30, 5), (60, 4), (90, 3), (180, 2))
FREQUENCY_STEPS = ((20, 5), (10, 4), (5, 3), (2, 2))
MONETARY_STEPS = ((10_000, 5), (5_000, 4), (2_000, 3), (500, 2))
TIER_STEPS = ((10_000, "PLATINUM"), (5_000, "GOLD"), (2_000, "SILVER"))


def _day(value) -> Column:
    return F.to_date(F.lit(str(value)))


def _current(df: DataFrame, effective: Column) -> DataFrame:
    """Columns of a current dimension row."""
    return (
        df.withColumn("is_current", F.lit(True))
        .withColumn("effective_date", effective)
        .withColumn("expiration_date", _day(FAR))
    )


def _to_load(df: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    return not_yet_in(df.where("is_valid"), existing, [key])


# Calendar ---------------------------------------------------------------------------


def calendar_columns(days: DataFrame, column: str = "full_date") -> DataFrame:
    """Calendar attributes of a frame of days; weeks are ISO, Monday is 1, fiscal is calendar."""
    d = F.col(column)
    weekday = F.weekday(d)
    return days.select(
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        (weekday + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short_name"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
        F.year(d).alias("year_number"),
        (weekday >= 5).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.lit("").alias("holiday_name"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"),
        F.month(d).alias("fiscal_month"),
    )


def day_spine(spark: SparkSession, first, last) -> DataFrame:
    """Every day between two dates."""
    row = spark.range(1)
    return row.select(F.explode(F.sequence(_day(first), _day(last))).alias("full_date"))


def dim_date(orders: DataFrame, as_of, start=None, end=None) -> DataFrame:
    """Calendar over the order dates; the trailing two years where there are none."""
    span = orders.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    empty_lo = _day(date.fromisoformat(str(as_of)) - timedelta(days=LOOKBACK_DAYS))
    lo = _day(start) if start else F.coalesce("lo", empty_lo)
    hi = _day(end) if end else F.coalesce("hi", _day(as_of))
    return calendar_columns(span.select(F.explode(F.sequence(lo, hi)).alias("full_date")))


def dim_date_fill_gaps(existing: DataFrame, orders: DataFrame) -> DataFrame:
    """Calendar rows for order dates the dimension lacks."""
    days = orders.where(F.col("order_date").isNotNull()).select(F.col("order_date").alias("full_date")).distinct()
    return calendar_columns(not_yet_in(days, existing, ["full_date"]))


# Dimensions -------------------------------------------------------------------------


def _primary_location(person_location: DataFrame) -> DataFrame:
    """One primary location per person: the lowest key."""
    return (
        person_location.where("is_primary")
        .groupBy("person_key")
        .agg(F.min_by("location_key", "person_location_key").alias("location_key"))
    )


def _full_name(full: Column, first: Column, last: Column) -> Column:
    spelled = F.concat(F.coalesce(first, F.lit("Unknown")), F.lit(" "), F.coalesce(last, F.lit("Unknown")))
    return F.coalesce(trimmed(full), F.trim(spelled))


def dim_customer(silver: Tables, existing: DataFrame | None, as_of) -> DataFrame:
    c = _to_load(silver["customer"], existing, "customer_key").alias("c")
    chain = (
        c.join(silver["person"].alias("p"), F.col("c.person_key") == F.col("p.person_key"), "left")
        .join(
            silver["customer_employee"].alias("ce"),
            F.col("c.customer_employee_key") == F.col("ce.customer_employee_key"),
            "left",
        )
        .join(silver["customer_company"].alias("cc"), F.col("ce.company_key") == F.col("cc.company_key"), "left")
        .join(
            _primary_location(silver["person_location"]).alias("pl"),
            F.col("p.person_key") == F.col("pl.person_key"),
            "left",
        )
        .join(silver["location"].alias("loc"), F.col("pl.location_key") == F.col("loc.location_key"), "left")
        .join(silver["country"].alias("co"), F.col("loc.country_key") == F.col("co.country_key"), "left")
    )
    manager = F.col("c.account_manager_id")
    rows = chain.select(
        "c.customer_key",
        "c.customer_id",
        blank_to("p.first_name", "Unknown").alias("first_name"),
        blank_to("p.last_name", "Unknown").alias("last_name"),
        _full_name(F.col("p.full_name"), F.col("p.first_name"), F.col("p.last_name")).alias("full_name"),
        blank_to("p.gender", "U").alias("gender"),
        blank_to("cc.company_name", "Individual").alias("company_name"),
        money(F.coalesce("cc.credit_limit", F.lit(0))).alias("company_credit_limit"),
        blank_to("c.customer_type", "RETAIL").alias("customer_type"),
        F.coalesce("c.income_level", F.lit(0)).alias("income_level"),
        blank_to("c.income_bracket", "UNKNOWN").alias("income_bracket"),
        F.coalesce(manager, F.lit(0)).alias("account_manager_id"),
        F.when(manager != 0, F.concat(F.lit("Manager "), manager.cast("string")))
        .otherwise("Unassigned")
        .alias("account_manager_name"),
        blank_to("loc.city", DASH).alias("city"),
        blank_to("loc.state_province", DASH).alias("state_province"),
        blank_to("co.country_name", DASH).alias("country_name"),
        blank_to("loc.postal_code", "00000").alias("postal_code"),
        blank_to("c.income_bracket", "STANDARD").alias("customer_segment"),
        blank_to("c.income_bracket", "STANDARD").alias("lifetime_value_tier"),
        F.coalesce("c.customer_since", _day(as_of)).alias("_since"),
    )
    return _current(rows, F.col("_since")).drop("_since")


def dim_product(silver: Tables, existing: DataFrame | None, as_of) -> DataFrame:
    p = _to_load(silver["product"], existing, "product_key")
    named = F.concat(F.lit("Product "), F.col("product_id").cast("string"))
    rows = p.select(
        "product_key",
        "product_id",
        blank_to("product_name", named).alias("product_name"),
        blank_to("description", "No description").alias("description"),
        F.coalesce("category_id", F.lit(0)).alias("category_id"),
        blank_to("category_name", "General").alias("category_name"),
        F.coalesce("weight_class", F.lit(0)).alias("weight_class"),
        blank_to("weight_class_description", "Standard").alias("weight_class_description"),
        F.coalesce("warranty_period_months", F.lit(0)).alias("warranty_period_months"),
        money(F.coalesce("list_price", F.lit(0)), 12).alias("list_price"),
        money(F.coalesce("minimum_price", F.lit(0)), 12).alias("minimum_price"),
        blank_to("price_currency", "USD").alias("price_currency"),
        money(F.coalesce("profit_margin", F.lit(0)), 12).alias("profit_margin"),
        money(F.coalesce("profit_margin_pct", F.lit(0)), 5).alias("profit_margin_pct"),
        blank_to("product_status", "Active").alias("product_status"),
        (F.lower(F.trim(F.coalesce("product_status", F.lit("Active")))) == "active").alias("is_active"),
        F.coalesce("supplier_id", F.lit(0)).alias("supplier_id"),
    )
    return _current(rows, _day(as_of))


def dim_employee(silver: Tables, existing: DataFrame | None, as_of) -> DataFrame:
    e = _to_load(silver["employee"], existing, "employee_key").alias("e")
    chain = (
        e.join(silver["person"].alias("p"), F.col("e.person_key") == F.col("p.person_key"), "left")
        .join(silver["employment_jobs"].alias("j"), F.col("e.job_key") == F.col("j.job_key"), "left")
        .join(silver["restricted_info"].alias("r"), F.col("p.person_key") == F.col("r.person_key"), "left")
        .join(
            silver["employee"].select("employee_key", "person_key").alias("m"),
            F.col("e.manager_employee_key") == F.col("m.employee_key"),
            "left",
        )
        .join(
            silver["person"].select("person_key", "full_name").alias("mp"),
            F.col("m.person_key") == F.col("mp.person_key"),
            "left",
        )
        .join(
            _primary_location(silver["person_location"]).alias("pl"),
            F.col("p.person_key") == F.col("pl.person_key"),
            "left",
        )
        .join(silver["location"].alias("loc"), F.col("pl.location_key") == F.col("loc.location_key"), "left")
        .join(silver["country"].alias("co"), F.col("loc.country_key") == F.col("co.country_key"), "left")
    )
    today = _day(as_of)
    rows = chain.select(
        "e.employee_key",
        "e.employee_id",
        blank_to("p.first_name", "Unknown").alias("first_name"),
        blank_to("p.last_name", "Unknown").alias("last_name"),
        _full_name(F.col("p.full_name"), F.col("p.first_name"), F.col("p.last_name")).alias("full_name"),
        blank_to("j.job_title", "Staff").alias("job_title"),
        F.lit("General").alias("department"),
        F.coalesce("r.hire_date", "e.start_date", today).alias("hire_date"),
        F.coalesce("e.start_date", today).alias("start_date"),
        F.coalesce("e.end_date", _day(FAR)).alias("end_date"),
        F.coalesce("e.tenure_years", F.lit(0)).alias("tenure_years"),
        F.coalesce("e.is_active", F.lit(True)).alias("is_active"),
        blank_to("e.employment_status", "ACTIVE").alias("employment_status"),
        money(F.coalesce("e.salary", F.lit(0)), 12).alias("salary"),
        money(F.coalesce("e.commission_percent", F.lit(0)), 5).alias("commission_percent"),
        F.col("e.manager_employee_key").alias("manager_employee_id"),
        blank_to("mp.full_name", "N/A").alias("manager_name"),
        blank_to("loc.city", DASH).alias("city"),
        blank_to("co.country_name", DASH).alias("country_name"),
    )
    return _current(rows, F.col("start_date"))


def dim_location(silver: Tables, existing: DataFrame | None, as_of) -> DataFrame:
    l = _to_load(silver["location"], existing, "location_key").alias("l")
    chain = l.join(silver["country"].alias("c"), F.col("l.country_key") == F.col("c.country_key"), "left")
    rows = chain.select(
        "l.location_key",
        "l.location_id",
        blank_to("l.address_line_1", DASH).alias("address_line_1"),
        blank_to("l.city", DASH).alias("city"),
        blank_to("l.state_province", DASH).alias("state_province"),
        blank_to("l.district", DASH).alias("district"),
        blank_to("l.postal_code", "00000").alias("postal_code"),
        F.coalesce("c.country_id", F.lit(0)).alias("country_id"),
        blank_to("c.country_name", "Unknown").alias("country_name"),
        blank_to("c.country_code", "UNK").alias("country_code"),
        blank_to("c.currency_code", "USD").alias("currency_code"),
        blank_to("c.country_name", "General").alias("region"),
        F.lit(DASH).alias("sub_region"),
        blank_to("l.location_type", "OTHER").alias("location_type"),
    )
    return _current(rows, _day(as_of))


def dim_warehouse(silver: Tables, dim_locations: DataFrame, existing: DataFrame | None, as_of) -> DataFrame:
    """Warehouses without a location, or whose location is in the location dimension."""
    w = _to_load(silver["warehouse"], existing, "warehouse_key")
    placed = only_in(w.where(F.col("location_key").isNotNull()), dim_locations, ["location_key"])
    held = w.where(F.col("location_key").isNull()).unionByName(placed.select(w.columns)).alias("w")
    chain = held.join(
        silver["location"].alias("l"), F.col("w.location_key") == F.col("l.location_key"), "left"
    ).join(silver["country"].alias("c"), F.col("l.country_key") == F.col("c.country_key"), "left")
    named = F.concat(F.lit("Warehouse "), F.col("w.warehouse_id").cast("string"))
    rows = chain.select(
        "w.warehouse_key",
        "w.warehouse_id",
        blank_to("w.warehouse_name", named).alias("warehouse_name"),
        "w.location_key",
        blank_to("l.city", DASH).alias("city"),
        blank_to("l.state_province", DASH).alias("state_province"),
        blank_to("c.country_name", DASH).alias("country_name"),
        blank_to("l.state_province", DASH).alias("warehouse_region"),
    )
    return _current(rows, _day(as_of))


def dim_promotion(orders: DataFrame, existing: DataFrame | None, as_of) -> DataFrame:
    """The "No promotion" row and one row per promotion code."""
    day = date.fromisoformat(str(as_of))
    codes = (
        orders.where(trimmed("promotion_code").isNotNull())
        .select("promotion_code")
        .distinct()
        .select(
            "promotion_code",
            F.col("promotion_code").alias("promotion_name"),
            F.lit("DISCOUNT").alias("promotion_type"),
            F.lit(Decimal("10.00")).cast("decimal(5,2)").alias("discount_percent"),
            F.lit(0).cast("decimal(12,2)").alias("discount_amount"),
            _day(day - timedelta(days=365)).alias("start_date"),
            _day(day + timedelta(days=365)).alias("end_date"),
            F.lit(True).alias("is_active"),
        )
    )
    none = orders.sparkSession.range(1).select(
        F.lit("").alias("promotion_code"),
        F.lit("No promotion").alias("promotion_name"),
        F.lit("NONE").alias("promotion_type"),
        F.lit(0).cast("decimal(5,2)").alias("discount_percent"),
        F.lit(0).cast("decimal(12,2)").alias("discount_amount"),
        _day("1970-01-01").alias("start_date"),
        _day(FAR).alias("end_date"),
        F.lit(True).alias("is_active"),
    )
    return not_yet_in(none.unionByName(codes), existing, ["promotion_code"])


# Facts ------------------------------------------------------------------------------


def best_location(person_location: DataFrame) -> DataFrame:
    """Per person the primary location first, then the lowest key."""
    order = F.struct((~F.coalesce("is_primary", F.lit(False))).alias("later"), "person_location_key")
    return person_location.groupBy("person_key").agg(F.min_by("location_key", order).alias("best_location_key"))


def _order_code(code: Column, order_id: Column) -> Column:
    return blank_to(code, F.concat(F.lit("ORD-"), order_id.cast("string")))


def _high_watermark(orders: DataFrame, loaded: DataFrame | None) -> DataFrame:
    """Only orders above the highest loaded id; late lower ids stay out, as the watermark rule has it."""
    if loaded is None:
        return orders
    top = loaded.agg(F.max("order_id")).scalar()
    return orders.where(F.col("order_id") > F.coalesce(top, F.lit(0)))


def fact_sales(
    silver: Tables, gold: Tables, existing: DataFrame | None = None, mode: str = "rebuild", watermark: bool = False
) -> DataFrame:
    """Order line grain. ``mode="append"`` adds lines not yet loaded, late orders included
    unless ``watermark`` asks for ids above the highest loaded one."""
    orders = silver["orders"].where(F.col("is_valid") & F.col("order_date").isNotNull())
    if mode == "append" and watermark:
        orders = _high_watermark(orders, existing)
    items = silver["order_item"].where("is_valid")
    lines = orders.drop("is_valid").alias("o").join(
        items.drop("is_valid").alias("i"), F.col("o.order_key") == F.col("i.order_key")
    )
    if mode == "append" and existing is not None:
        # lines that are there already leave before they meet a dimension
        loaded = existing.select("order_id", "order_item_id").alias("e")
        same = (F.col("o.order_id") == F.col("e.order_id")) & (F.col("i.order_item_id") == F.col("e.order_item_id"))
        lines = lines.join(loaded, same, "left_anti")
    places = (
        silver["customer"]
        .select("customer_key", "person_key")
        .join(best_location(silver["person_location"]), "person_key", "left")
        .select(F.col("customer_key").alias("_customer"), "best_location_key")
    )
    promotions = gold["dim_promotion"].select("promotion_key", F.col("promotion_code").alias("_code"))
    first_place = gold["dim_location"].agg(F.min("location_key")).scalar()
    cost = F.coalesce(F.col("i.line_total"), F.lit(0).cast("decimal(15,2)")) * F.lit(COST_SHARE)
    net = F.coalesce(F.col("i.net_amount"), F.lit(0).cast("decimal(15,2)"))
    joined = lines.join(places, F.col("o.customer_key") == F.col("_customer"), "left").join(
        promotions, blank_to("o.promotion_code", "") == F.col("_code"), "left"
    )
    return joined.select(
        date_key("o.order_date").alias("order_date_key"),
        "o.customer_key",
        "i.product_key",
        F.col("o.sales_rep_key").alias("employee_key"),
        F.coalesce("best_location_key", first_place).alias("location_key"),
        "promotion_key",
        "o.order_id",
        "i.order_item_id",
        _order_code(F.col("o.order_code"), F.col("o.order_id")).alias("order_code"),
        "i.quantity",
        "i.unit_price",
        money(F.coalesce("i.discount_amount", F.lit(0)), 12).alias("discount_amount"),
        F.col("i.line_total").alias("gross_amount"),
        "i.net_amount",
        money(F.round(cost, 2)).alias("cost_amount"),
        money(F.round(net - cost, 2)).alias("profit_amount"),
        blank_to("o.order_status", "UNKNOWN").alias("order_status"),
        blank_to("o.order_status_category", "UNKNOWN").alias("order_status_category"),
    )


def fact_orders(
    silver: Tables, gold: Tables, existing: DataFrame | None = None, mode: str = "rebuild", watermark: bool = False
) -> DataFrame:
    """Order grain, for customers of the customer dimension."""
    orders = silver["orders"].where(F.col("is_valid") & F.col("order_date").isNotNull())
    if mode == "append":
        orders = _high_watermark(orders, existing) if watermark else not_yet_in(orders, existing, ["order_id"])
    orders = only_in(orders, gold["dim_customer"], ["customer_key"])
    items = silver["order_item"].where("is_valid")
    if mode == "append":
        items = only_in(items, orders, ["order_key"])
    lines = (
        items.groupBy("order_key")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            F.count("order_item_id").alias("total_items"),
            F.count_distinct("product_key").alias("distinct_products"),
            F.sum("line_total").alias("gross_amount"),
            F.sum("discount_amount").alias("discount_amount"),
            F.sum("net_amount").alias("net_amount"),
        )
    )
    promotions = gold["dim_promotion"].select("promotion_key", F.col("promotion_code").alias("_code"))
    code = blank_to("promotion_code", "")
    joined = orders.join(lines, "order_key", "left").join(promotions, code == F.col("_code"), "left")
    nothing = F.lit(0)
    return joined.select(
        date_key("order_date").alias("order_date_key"),
        "customer_key",
        F.col("sales_rep_key").alias("employee_key"),
        "promotion_key",
        "order_id",
        _order_code(F.col("order_code"), F.col("order_id")).alias("order_code"),
        money(F.coalesce("total_quantity", nothing)).alias("total_quantity"),
        F.coalesce("total_items", nothing).cast("int").alias("total_items"),
        F.coalesce("distinct_products", nothing).cast("int").alias("distinct_products"),
        money(F.coalesce("gross_amount", nothing)).alias("gross_amount"),
        money(F.coalesce("discount_amount", nothing)).alias("discount_amount"),
        money(F.coalesce("net_amount", nothing)).alias("net_amount"),
        blank_to("order_status", "UNKNOWN").alias("order_status"),
        blank_to("order_status_category", "UNKNOWN").alias("order_status_category"),
        blank_to("order_currency", "USD").alias("order_currency"),
        (code != "").alias("has_promotion"),
    )


MEASURES = (
    "quantity_on_hand",
    "quantity_available",
    "quantity_reserved",
    "days_of_supply",
    "stock_status",
    "inventory_value",
)


def inventory_measures(inventory: DataFrame, product: DataFrame) -> DataFrame:
    """Measures per (product, warehouse); of several rows the highest inventory id counts."""
    columns = ("inventory_id", "quantity_on_hand", "quantity_available", "quantity_reserved")
    newest = (
        inventory.where("is_valid")
        .groupBy("product_key", "warehouse_key")
        .agg(F.max(F.struct(*columns)).alias("r"))
        .select("product_key", "warehouse_key", *[f"r.{c}" for c in columns[1:]])
    )
    priced = newest.join(product.where("is_valid").select("product_key", "list_price"), "product_key", "left")
    on_hand, free = F.coalesce("quantity_on_hand", F.lit(0)), F.coalesce("quantity_available", F.lit(0))
    supply = F.least(F.lit(999), F.greatest(F.lit(0), F.expr("quantity_on_hand div nullif(quantity_available, 0)")))
    price = F.coalesce(F.col("list_price"), F.lit(0).cast("decimal(12,2)"))
    return priced.select(
        "product_key",
        "warehouse_key",
        on_hand.alias("quantity_on_hand"),
        free.alias("quantity_available"),
        F.coalesce("quantity_reserved", F.lit(0)).alias("quantity_reserved"),
        F.when(free <= 0, 0).otherwise(supply).cast("int").alias("days_of_supply"),
        F.when(free <= 0, "OUT_OF_STOCK").when(free < 10, "LOW_STOCK").otherwise("IN_STOCK").alias("stock_status"),
        money(F.round(on_hand * price, 2), 18).alias("inventory_value"),
    )


def previous_snapshot_key(snapshots: DataFrame, key: int) -> Column:
    """Latest snapshot date key before the given one, as a scalar."""
    return snapshots.where(F.col("snapshot_date_key") < key).agg(F.max("snapshot_date_key")).scalar()


def fact_inventory_snapshot(silver: Tables, snapshots: DataFrame | None, day) -> DataFrame:
    """All snapshot rows of one day: carried forward, inserted, aligned with silver, orphans gone."""
    key = int(str(day).replace("-", ""))
    now = inventory_measures(silver["inventory"], silver["product"])
    pair = ["product_key", "warehouse_key"]
    if snapshots is None:
        return now.select(F.lit(key).alias("snapshot_date_key"), *pair, *MEASURES)
    same_day = snapshots.where(F.col("snapshot_date_key") == key).select(*pair, *MEASURES)
    last = snapshots.where(F.col("snapshot_date_key") == previous_snapshot_key(snapshots, key))
    held = ("quantity_on_hand", "quantity_available", "quantity_reserved")
    current = now.select(*pair, *[F.col(c).alias(f"now_{c}") for c in held])
    unchanged = F.lit(True)
    for c in held:
        unchanged = unchanged & (F.col(c) == F.col(f"now_{c}"))
    carried = last.join(current, pair).where(unchanged).select(*pair, *MEASURES)
    carried = not_yet_in(carried, same_day, pair)
    present = same_day.unionByName(carried)
    inserted = not_yet_in(now, present, pair).select(*pair, *MEASURES)
    stacked = present.unionByName(inserted)
    fresh = now.select(*pair, F.struct(*MEASURES).alias("fresh"))
    # The inner join is the update and the removal of orphans in one step: silver decides
    # the measures of every pair it has, pairs it lacks go.
    aligned = stacked.select(*pair, F.struct(*MEASURES).alias("was")).join(fresh, pair)
    settled = F.when(~F.col("was").eqNullSafe(F.col("fresh")), F.col("fresh")).otherwise(F.col("was"))
    return aligned.select(F.lit(key).alias("snapshot_date_key"), *pair, settled.alias("m")).select(
        "snapshot_date_key", *pair, "m.*"
    )


# Aggregates -------------------------------------------------------------------------


def _per_order(items: DataFrame) -> DataFrame:
    """Line sums per order: what the order-level aggregates need, reduced before any join."""
    return items.groupBy("order_key").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("line_total").alias("line_total"),
        F.sum("discount_amount").alias("discount_amount"),
        F.sum("net_amount").alias("net_amount"),
    )


def agg_daily_sales(
    orders: DataFrame, items: DataFrame, existing: DataFrame | None = None, dates: DataFrame | None = None
) -> DataFrame:
    """One row per order date in a single pass; ``existing`` rows are kept, ``dates`` narrows the days."""
    held = orders.where(F.col("is_valid") & F.col("order_date").isNotNull())
    if dates is not None:
        held = held.join(dates.select("order_date"), "order_date", "left_semi")
    sums = _per_order(items.where("is_valid"))
    joined = held.select("order_key", "order_id", "order_date", "customer_key").join(sums, "order_key", "left")
    nothing = F.lit(0)
    net = F.coalesce(F.sum("net_amount"), nothing)
    orders_n = F.count_distinct("order_id")
    daily = joined.groupBy("order_date").agg(
        orders_n.alias("total_orders"),
        F.count_distinct("customer_key").alias("total_customers"),
        money(F.coalesce(F.sum("quantity"), nothing)).alias("total_items_sold"),
        money(F.coalesce(F.sum("line_total"), nothing), 18).alias("gross_revenue"),
        money(F.coalesce(F.sum("discount_amount"), nothing), 18).alias("discount_given"),
        money(net, 18).alias("net_revenue"),
    )
    rows = daily.select(
        date_key("order_date").alias("date_key"),
        *[c for c in daily.columns if c != "order_date"],
        F.coalesce(money_ratio(F.col("net_revenue"), F.col("total_orders")), nothing).alias("avg_order_value"),
    )
    return not_yet_in(rows, existing, ["date_key"])


def daily_sales_trend(daily: DataFrame) -> DataFrame:
    """Revenue of the day before and the change in percent; one row per calendar day, so bounded."""
    over = W.orderBy("date_key")
    before = F.lag("net_revenue").over(over)
    change = (F.col("net_revenue").cast("double") - before.cast("double")) / before.cast("double") * 100
    return daily.select(
        "date_key",
        "net_revenue",
        before.alias("prev_day_revenue"),
        F.when(before != 0, change).alias("revenue_change_pct"),
    )


def agg_customer_lifetime(
    customer: DataFrame, orders: DataFrame, items: DataFrame, as_of, existing: DataFrame | None = None
) -> DataFrame:
    """Lifetime sums, R/F/M scores, segment and tier of every valid customer."""
    per_order = orders.select("order_key", "order_id", "order_date", "customer_key").join(
        _per_order(items), "order_key", "left"
    )
    per_customer = per_order.groupBy("customer_key").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("quantity"),
        F.sum("line_total").alias("line_total"),
        F.sum("net_amount").alias("net_amount"),
    )
    nothing = F.lit(0)
    stats = (
        customer.where("is_valid")
        .select("customer_key")
        .join(per_customer, "customer_key", "left")
        .select(
            "customer_key",
            "first_order_date",
            "last_order_date",
            F.coalesce("total_orders", nothing).cast("long").alias("total_orders"),
            money(F.coalesce("quantity", nothing)).alias("total_items_purchased"),
            money(F.coalesce("line_total", nothing), 18).alias("lifetime_gross_value"),
            money(F.coalesce("net_amount", nothing), 18).alias("lifetime_net_value"),
        )
    )
    today = _day(as_of)
    away = F.datediff(today, F.col("last_order_date"))
    scored = stats.select(
        "*",
        F.coalesce(money_ratio(F.col("lifetime_net_value"), F.col("total_orders")), nothing).alias("avg_order_value"),
        ladder(away, RECENCY_STEPS, 1, at_most=True).alias("r"),
        ladder("total_orders", FREQUENCY_STEPS, 1).alias("f"),
        ladder("lifetime_net_value", MONETARY_STEPS, 1).alias("m"),
    )
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 2) & (f >= 2), "Potential Loyalists")
        .when((r >= 3) & (f <= 2), "New Customers")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2) & (m >= 3), "Cannot Lose Them")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Lost")
        .otherwise("Need Attention")
    )
    span = F.datediff("last_order_date", "first_order_date").cast("long")
    gap = F.when(
        F.col("total_orders") > 1,
        F.floor(span / (F.col("total_orders") - 1)),
    )
    rows = scored.select(
        "customer_key",
        "first_order_date",
        "last_order_date",
        F.coalesce(F.datediff(today, F.col("first_order_date")), nothing).alias("customer_tenure_days"),
        "total_orders",
        "total_items_purchased",
        "lifetime_gross_value",
        "lifetime_net_value",
        "avg_order_value",
        gap.alias("avg_order_frequency_days"),
        r.alias("rfm_recency_score"),
        f.alias("rfm_frequency_score"),
        m.alias("rfm_monetary_score"),
        segment.alias("rfm_segment"),
        ladder("lifetime_net_value", TIER_STEPS, "BRONZE").alias("customer_tier"),
    )
    return not_yet_in(rows, existing, ["customer_key"])


def agg_monthly_product_sales(
    orders: DataFrame, items: DataFrame, product: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Month and category sums with the category's rank in the month."""
    lines = items.join(
        product.where("is_valid").select("product_key", F.coalesce("category_name", F.lit("Unknown")).alias("category_name")),
        "product_key",
    ).join(orders.select("order_key", "order_id", "order_date"), "order_key")
    monthly = lines.groupBy(
        F.year("order_date").alias("year_number"), F.month("order_date").alias("month_number"), "category_name"
    ).agg(
        money(F.sum("quantity")).alias("total_quantity_sold"),
        F.count_distinct("order_id").alias("total_orders"),
        money(F.sum("line_total"), 18).alias("gross_revenue"),
        money(F.sum("net_amount"), 18).alias("net_revenue"),
    )
    price = F.when(F.col("total_quantity_sold") > 0, money_ratio(F.col("gross_revenue"), F.col("total_quantity_sold")))
    rank = F.row_number().over(
        W.partitionBy("year_number", "month_number").orderBy(F.col("net_revenue").desc_nulls_first(), "category_name")
    )
    rows = monthly.select(
        "*", F.coalesce(price, F.lit(0)).alias("avg_unit_price"), rank.alias("category_rank")
    )
    return not_yet_in(rows, existing, ["year_number", "month_number", "category_name"])


def agg_sales_rep_performance(
    orders: DataFrame, items: DataFrame, employee: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Month and rep sums; a customer is new where the order falls on the customer's first order date."""
    first = orders.groupBy("customer_key").agg(F.min("order_date").alias("first_order_date"))
    held = orders.where(
        F.col("is_valid") & F.col("sales_rep_key").isNotNull() & F.col("order_date").isNotNull()
    ).select("order_key", "order_id", "customer_key", "sales_rep_key", "order_date")
    joined = held.join(_per_order(items), "order_key", "left").join(first, "customer_key", "left")
    fresh = F.when(F.col("order_date") == F.col("first_order_date"), F.col("customer_key"))
    monthly = joined.groupBy(
        F.col("sales_rep_key").alias("employee_key"),
        F.year("order_date").alias("year_number"),
        F.month("order_date").alias("month_number"),
    ).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_key").alias("total_customers_served"),
        F.count_distinct(fresh).alias("new_customers_acquired"),
        money(F.coalesce(F.sum("line_total"), F.lit(0)), 18).alias("gross_sales"),
        money(F.coalesce(F.sum("net_amount"), F.lit(0)), 18).alias("net_sales"),
    )
    rates = employee.select("employee_key", "commission_percent")
    paid = monthly.join(rates, "employee_key", "left")
    share = F.col("net_sales") * F.col("commission_percent") * F.lit(Decimal("0.01"))
    rows = paid.select(*monthly.columns, money(F.round(F.coalesce(share, F.lit(0)), 2), 18).alias("total_commission"))
    order = [F.col("net_sales").desc_nulls_first(), "employee_key"]
    rows = position_in_key(rows, ["year_number", "month_number"], order, "sales_rank")
    return not_yet_in(rows, existing, ["employee_key", "year_number", "month_number"])


def rep_quota_attainment(performance: DataFrame, quotas: DataFrame) -> DataFrame:
    """Net sales against the monthly quota, in percent."""
    joined = performance.join(quotas, ["employee_key", "year_number", "month_number"], "left")
    reached = F.col("net_sales").cast("double") / F.col("sales_quota").cast("double") * 100
    return joined.select(
        "employee_key",
        "year_number",
        "month_number",
        "net_sales",
        "sales_quota",
        F.when(F.col("sales_quota") != 0, reached).alias("quota_attainment_pct"),
    )
