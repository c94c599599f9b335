"""Reports and dashboard queries over silver and gold tables.

``as_of`` replaces the clock. Facts are reduced per key before they meet a dimension, so
neither a hot product or customer nor a wide dimension row is shuffled per fact row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from smeltery.functions.exprs import date_key, key_date, ratio, tolerant_date, tolerant_number
from smeltery.functions.ordered import dense_rank_over, ntile_over

STALE_DAYS = 730


def _day(value) -> Column:
    return F.to_date(F.lit(str(value)))


def _back(as_of, days: int) -> Column:
    return _day(date.fromisoformat(str(as_of)) - timedelta(days=days))


def _key_back(as_of, days: int) -> int:
    return int((date.fromisoformat(str(as_of)) - timedelta(days=days)).strftime("%Y%m%d"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# Warehouse overview -----------------------------------------------------------------


def layer_row_count(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all tables of a layer, summed."""
    counts = [df.agg(F.count("*").alias("rows")) for df in tables.values()]
    return _union(counts).agg(F.sum("rows").alias("total_rows"))


def warehouse_summary(layers: Mapping[str, Mapping[str, DataFrame]], sizes: DataFrame) -> DataFrame:
    """Per layer the number of tables, their exact rows and the stored bytes of ``sizes`` (layer, bytes)."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), "rows")
        for layer, tables in layers.items()
        for name, df in tables.items()
    ]
    counts = _union(parts).groupBy("layer").agg(F.count("name").alias("table_count"), F.sum("rows").alias("total_rows"))
    stored = sizes.groupBy("layer").agg(F.sum("bytes").alias("total_bytes"))
    return counts.join(stored, "layer", "left").select("layer", "table_count", "total_rows", F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def layer_bytes(spark: SparkSession, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    """layer, bytes: what lies in the folders of each layer's stored tables, from the listing alone."""
    frames = [stored_bytes(spark, folders).select(F.lit(layer).alias("layer"), "bytes") for layer, folders in paths.items() if folders]
    return _union(frames) if frames else spark.createDataFrame([], "layer string, bytes long")


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files and bytes behind the part folders of a stored table, from the listing alone."""
    files = _union([spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(p).select("path", F.col("length").alias("file_size")) for p in paths])
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def table_catalog(spark: SparkSession, layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """One row per column of every table; schema only, no data is read."""
    rows = [
        (layer, name, position, field.name, field.dataType.simpleString())
        for layer, tables in layers.items()
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "layer string, table_name string, position int, column_name string, type string")


def catalog_search(catalog: DataFrame, text: str) -> DataFrame:
    """Tables whose name holds the text in any letter case, counted per layer."""
    hits = catalog.where(F.lower("table_name").contains(text.lower())).select("layer", "table_name").distinct()
    return hits.groupBy("layer").agg(F.count("*").alias("tables"))


def table_stats_of(df: DataFrame, newest: str) -> DataFrame:
    """Rows, columns and newest time of one table."""
    return df.agg(F.count("*").alias("row_count"), F.max(newest).alias("newest")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), "newest"
    )


def table_preview(df: DataFrame, order: Sequence[str], limit: int, offset: int) -> DataFrame:
    """One page in key order with the table's total beside it."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_rows", total)


def profile_head(df: DataFrame, columns: int = 4) -> DataFrame:
    """The first few columns."""
    return df.select(*df.columns[:columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


# Sales ------------------------------------------------------------------------------


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count("*").alias("total_sales"),
        F.coalesce(F.sum("net_amount").cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(ratio(F.sum("net_amount"), F.count("net_amount")), F.lit(0.0)).alias("avg_sale"),
        F.coalesce(F.sum("quantity").cast("double"), F.lit(0.0)).alias("total_quantity"),
    )


def sales_daily(sales: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Per day up to ``as_of``; ``days`` <= 0 means every day."""
    held = sales.where(F.col("order_date_key") <= _key_back(as_of, 0))
    if days > 0:
        held = held.where(F.col("order_date_key") >= _key_back(as_of, days))
    daily = held.groupBy("order_date_key").agg(
        F.count("*").alias("sales_count"), F.sum("net_amount").cast("double").alias("revenue")
    )
    return daily.select(
        F.date_format(key_date("order_date_key"), "yyyy-MM-dd").alias("date"), "sales_count", "revenue"
    )


def top_products(sales: DataFrame, product: DataFrame, limit: int = 20) -> DataFrame:
    per_product = sales.groupBy("product_key").agg(
        F.count("*").alias("n"), F.sum("net_amount").alias("net"), F.sum("quantity").alias("qty")
    )
    named = per_product.join(product.select("product_key", "product_name"), "product_key", "left")
    ranked = named.groupBy("product_name").agg(
        F.sum("n").alias("sales_count"), F.sum("net").alias("revenue"), F.sum("qty").alias("quantity_sold")
    )
    return (
        ranked.orderBy(F.col("revenue").desc_nulls_last(), F.col("product_name").asc_nulls_last())
        .limit(limit)
        .withColumn("product_name", F.coalesce("product_name", F.lit("Unknown")))
    )


def customer_stats(dim_customer: DataFrame, orders: DataFrame) -> DataFrame:
    total = dim_customer.agg(F.count("*")).scalar()
    return orders.agg(
        F.count_distinct("customer_key").alias("unique_customers"),
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("net_amount").cast("double"), F.lit(0.0)).alias("total_revenue"),
    ).withColumn("total_customers", total)


def _readable(daily: DataFrame) -> DataFrame:
    """Date, count and revenue read from loose text; decimals, so sums do not depend on their order."""
    return daily.select(
        tolerant_date("date").alias("d"),
        tolerant_number("sales_count").cast("decimal(24,4)").alias("s"),
        tolerant_number("revenue").cast("decimal(24,4)").alias("r"),
    )


def sales_monthly(daily: DataFrame, as_of) -> DataFrame:
    """Months with zero rows up to the month of ``as_of``, unless the data ended over two years before."""
    days = _readable(daily)
    days = days.where(F.col("d").isNotNull())
    months = days.groupBy(F.trunc("d", "month").alias("m")).agg(
        F.sum("s").cast("double").alias("sales"), F.sum("r").cast("double").alias("revenue")
    )
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    here = F.trunc(_day(as_of), "month")
    last_month = F.trunc("hi", "month")
    pad = F.when((F.datediff(_day(as_of), F.col("hi")) <= STALE_DAYS) & (last_month < here), here)
    tail = span.where(pad.isNotNull()).select(
        F.explode(F.sequence(F.add_months(last_month, 1), pad, F.expr("interval 1 month"))).alias("m"),
        F.lit(0.0).alias("sales"),
        F.lit(0.0).alias("revenue"),
    )
    return months.unionByName(tail).select(F.date_format("m", "yyyy-MM").alias("month_key"), "sales", "revenue")


def sales_current_month_daily(daily: DataFrame, as_of) -> DataFrame:
    """Every day of the month of ``as_of``; days without sales are zero."""
    first = F.trunc(_day(as_of), "month")
    spine = daily.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.last_day(_day(as_of)))).alias("d")
    )
    sums = (
        _readable(daily)
        .where((F.col("d") >= first) & (F.col("d") <= F.last_day(_day(as_of))))
        .groupBy("d")
        .agg(F.sum("s").cast("double").alias("s"), F.sum("r").cast("double").alias("r"))
    )
    return F.broadcast(spine).join(sums, "d", "left").select(
        F.date_format("d", "yyyy-MM-dd").alias("day_key"),
        F.coalesce("s", F.lit(0.0)).alias("sales"),
        F.coalesce("r", F.lit(0.0)).alias("revenue"),
    )


def export_daily_sales(daily: DataFrame) -> DataFrame:
    """Rows with a readable date, in date order, as the sheet has them."""
    return (
        daily.select(
            tolerant_date("date").alias("Date"),
            tolerant_number("sales_count").alias("Orders"),
            tolerant_number("revenue").alias("Revenue"),
        )
        .where(F.col("Date").isNotNull())
        .orderBy("Date")
    )


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV with a header, one file: reports of this kind have a row a day."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _recent_sales(sales: DataFrame, dim_date: DataFrame, as_of, days: int) -> DataFrame:
    recent = dim_date.where(F.col("full_date") >= _back(as_of, days)).select(
        F.col("date_key").alias("order_date_key"), "full_date"
    )
    return sales.join(recent, "order_date_key")


def orders_report(sales: DataFrame, dim_date: DataFrame, as_of, days: int | None = 30) -> DataFrame:
    """Three metric rows over the trailing days, from one pass."""
    span = max(1, 30 if days is None else days)
    sums = _recent_sales(sales, dim_date, as_of, span).agg(
        F.count("*").cast("double").alias("orders_count"),
        F.coalesce(F.sum("net_amount").cast("double"), F.lit(0.0)).alias("sales_amount"),
        F.coalesce(F.sum("quantity").cast("double"), F.lit(0.0)).alias("units_sold"),
    )
    return sums.unpivot([], ["orders_count", "sales_amount", "units_sold"], "metric", "value")


def orders_trend(sales: DataFrame, dim_date: DataFrame, as_of, days: int = 30, limit: int = 90) -> DataFrame:
    daily = _recent_sales(sales, dim_date, as_of, days).groupBy("full_date").agg(F.sum("net_amount").alias("net_amount"))
    return daily.orderBy(F.col("full_date").desc()).limit(limit)


def top_products_recent(
    sales: DataFrame, product: DataFrame, dim_date: DataFrame, as_of, days: int = 30, limit: int = 20
) -> DataFrame:
    recent = _recent_sales(sales, dim_date, as_of, days)
    return top_products(recent.select(*sales.columns), product, limit).select("product_name", "revenue")


def income_bracket_revenue(customer: DataFrame, orders: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = orders.where((F.col("order_date") >= _back(as_of, days)) & F.col("order_total").isNotNull())
    per_customer = recent.groupBy("customer_key").agg(
        F.count_distinct("order_key").alias("o"), F.sum("order_total").alias("s"), F.count("*").alias("n")
    )
    return (
        per_customer.join(customer.select("customer_key", "income_bracket"), "customer_key")
        .groupBy("income_bracket")
        .agg(
            F.sum("o").alias("order_count"),
            F.sum("s").alias("total_revenue"),
            ratio(F.sum("s"), F.sum("n")).alias("avg_order_value"),
        )
    )


def category_sales(product: DataFrame, items: DataFrame, orders: DataFrame, as_of, days: int = 7) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days)).select("order_key")
    per_product = (
        items.join(recent, "order_key", "left_semi")
        .groupBy("product_key")
        .agg(
            F.count_distinct("order_item_id").alias("k"),
            F.sum("line_total").alias("s"),
            F.sum("unit_price").alias("p"),
            F.count("unit_price").alias("n"),
        )
    )
    return (
        per_product.join(product.select("product_key", "category_name"), "product_key")
        .groupBy("category_name")
        .agg(
            F.sum("k").alias("items_sold"),
            F.sum("s").alias("revenue"),
            ratio(F.sum("p"), F.sum("n")).alias("avg_price"),
        )
    )


def weekly_orders(orders: DataFrame, as_of, days: int = 90) -> DataFrame:
    recent = orders.where((F.col("order_date") >= _back(as_of, days)) & F.col("order_total").isNotNull())
    return recent.groupBy(F.trunc("order_date", "week").alias("week")).agg(
        F.count_distinct("order_key").alias("orders"),
        F.sum("order_total").alias("revenue"),
        F.count_distinct("customer_key").alias("customers"),
    )


def recent_orders_items(
    orders: DataFrame, customer: DataFrame, items: DataFrame, as_of, days: int = 7, limit: int = 100
) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days)).join(
        customer.select("customer_key"), "customer_key", "left_semi"
    )
    # The page is picked from the orders alone; only its lines are counted.
    page = recent.orderBy(F.col("order_date").desc(), "order_id").limit(limit).select(
        "order_key", "order_id", "order_date", "order_total"
    )
    counts = items.join(F.broadcast(page.select("order_key")), "order_key", "left_semi").groupBy("order_key").agg(
        F.count("*").alias("n")
    )
    return page.join(counts, "order_key", "left").select(
        "order_id", "order_date", "order_total", F.coalesce("n", F.lit(0)).alias("item_count")
    )


def products_of_category(product: DataFrame, items: DataFrame, category: str, limit: int = 50) -> DataFrame:
    wanted = product.where(F.col("category_name") == category).select("product_key", "product_name", "category_name")
    sums = (
        items.join(wanted, "product_key", "left_semi")
        .groupBy("product_key")
        .agg(F.sum("quantity").alias("total_quantity"), F.sum("line_total").alias("total_sales"))
    )
    return (
        sums.join(wanted, "product_key")
        .orderBy(F.col("total_quantity").desc(), "product_key")
        .limit(limit)
        .select("product_key", "product_name", "category_name", "total_quantity", "total_sales")
    )


def lookup_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches the file scan."""
    return df.where(F.col(key) == value)


# Workload mix over facts --------------------------------------------------------------


def sales_by_category(sales: DataFrame, product: DataFrame, limit: int = 200) -> DataFrame:
    per_product = sales.where("net_amount > 0").groupBy("product_key").agg(F.sum("quantity").alias("q"))
    return (
        per_product.join(product.select("product_key", "category_name"), "product_key")
        .groupBy("category_name")
        .agg(F.sum("q").alias("quantity"))
        .orderBy(F.col("quantity").desc_nulls_last(), "category_name")
        .limit(limit)
    )


def sales_by_state(sales: DataFrame, customer: DataFrame, limit: int = 100) -> DataFrame:
    per_customer = sales.groupBy("customer_key").agg(F.count("*").alias("n"))
    return (
        per_customer.join(customer.select("customer_key", "state_province"), "customer_key")
        .groupBy("state_province")
        .agg(F.sum("n").alias("sales_count"))
        .orderBy(F.col("sales_count").desc(), "state_province")
        .limit(limit)
    )


def sales_by_date_key(sales: DataFrame, limit: int = 200) -> DataFrame:
    held = sales.where(F.col("order_date_key").isNotNull())
    daily = held.groupBy("order_date_key").agg(F.sum("net_amount").alias("net_amount"))
    return daily.orderBy(F.col("order_date_key").desc()).limit(limit)


def top_sales_lines(sales: DataFrame, product: DataFrame, limit: int = 5000) -> DataFrame:
    named = product.where(F.col("category_name").isNotNull()).select("product_key")
    held = sales.join(named, "product_key", "left_semi")
    return (
        held.orderBy(F.col("net_amount").desc_nulls_last(), "order_item_id", "product_key")
        .limit(limit)
        .select("order_item_id", "net_amount", "quantity")
    )


def latest_sales_lines(
    sales: DataFrame, product: DataFrame, customer: DataFrame, low: int = 1, high: int = 100, limit: int = 3000
) -> DataFrame:
    held = (
        sales.where(F.col("quantity").between(low, high))
        .join(product.select("product_key"), "product_key", "left_semi")
        .join(customer.select("customer_key"), "customer_key", "left_semi")
    )
    return (
        held.orderBy(F.col("order_date_key").desc_nulls_last(), "order_item_id", "net_amount")
        .limit(limit)
        .select("order_item_id", "net_amount", "order_date_key")
    )


def value_counts(df: DataFrame, column: str, limit: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column).asc_nulls_last()).limit(limit)


def top_value_orders(orders: DataFrame, as_of, days: int = 180, limit: int = 4000) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days))
    return recent.orderBy(F.col("order_total").desc_nulls_last(), "order_id").limit(limit)


def quantity_per_order(orders: DataFrame, items: DataFrame, limit: int = 500) -> DataFrame:
    sums = items.groupBy("order_key").agg(F.sum("quantity").alias("quantity"))
    return (
        sums.join(orders.select("order_key", "order_id"), "order_key")
        .orderBy(F.col("quantity").desc_nulls_last(), "order_id")
        .limit(limit)
        .select("order_id", "quantity")
    )


def price_range(product: DataFrame) -> DataFrame:
    return product.agg(
        F.count("*").alias("products"), F.min("list_price").alias("min_price"), F.max("list_price").alias("max_price")
    )


def on_hand_per_product(snapshots: DataFrame, limit: int = 400) -> DataFrame:
    sums = snapshots.groupBy("product_key").agg(F.sum("quantity_on_hand").alias("on_hand"))
    return sums.orderBy(F.col("on_hand").desc_nulls_last(), "product_key").limit(limit)


def trailing_day_counts(df: DataFrame, day: str, as_of, windows: Sequence[int]) -> DataFrame:
    """Rows per trailing window, all windows from one pass."""
    tests = [F.count_if(F.col(day) >= _back(as_of, d)).alias(f"d{d}") for d in windows]
    wide = df.where(F.col(day) >= _back(as_of, max(windows))).agg(*tests)
    tall = wide.unpivot([], [f"d{d}" for d in windows], "window", "row_count")
    return tall.select(F.substring("window", 2, 10).cast("int").alias("days"), "row_count")


def trailing_hour_counts(df: DataFrame, ts: str, as_of_ts: str, windows: Sequence[int]) -> DataFrame:
    now = F.lit(as_of_ts).cast("timestamp_ntz")
    tests = [
        F.count_if(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(h))).alias(f"h{h}") for h in windows
    ]
    wide = df.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(max(windows)))).agg(*tests)
    tall = wide.unpivot([], [f"h{h}" for h in windows], "window", "row_count")
    return tall.select(F.substring("window", 2, 10).cast("int").alias("hours"), "row_count")


def event_histogram(df: DataFrame, ts: str, unit: str, as_of_ts: str, hours: int, limit: int) -> DataFrame:
    """Events per hour or day over the trailing hours, newest buckets first."""
    now = F.lit(as_of_ts).cast("timestamp_ntz")
    recent = df.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    counts = recent.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("events"))
    return counts.orderBy(F.col("bucket").desc()).limit(limit)


def top_by_key(df: DataFrame, key: str, value: str, limit: int, how: str = "sum") -> DataFrame:
    measure = F.count("*") if how == "count" else F.sum(value)
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("total"))
    return sums.orderBy(F.col("total").desc_nulls_last(), key).limit(limit)


def rows_near_max_key(sales: DataFrame, back: int) -> DataFrame:
    """Rows with key >= max(key) - back; the keys are YYYYMMDD numbers and are subtracted as such."""
    top = sales.agg(F.max("order_date_key")).scalar()
    return sales.where(F.col("order_date_key") >= top - F.lit(back)).agg(F.count("*").alias("row_count"))


def first_customer_row(customer: DataFrame) -> DataFrame:
    """The customer with the lowest id, by a scalar subquery."""
    return customer.where(F.col("customer_id") == customer.agg(F.min("customer_id")).scalar())


def products_in_category(product: DataFrame, category: str, limit: int = 50) -> DataFrame:
    held = product.where((F.col("category_name") == category) & F.col("is_valid"))
    return held.orderBy("product_id").limit(limit)


def orders_with_customer(orders: DataFrame, customer: DataFrame, as_of, days: int = 7, limit: int = 100) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days))
    joined = recent.join(customer.select("customer_key", "customer_type"), "customer_key")
    return (
        joined.orderBy(F.col("order_date").desc(), "order_id")
        .limit(limit)
        .select("order_id", "customer_type", "order_date", "order_total")
    )


def daily_order_summary(orders: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days))
    return recent.groupBy(F.col("order_date").alias("day")).agg(
        F.count("*").alias("order_count"), F.sum("order_total").alias("total_revenue")
    )


def segment_orders(orders: DataFrame, customer: DataFrame, segment: str, as_of, days: int = 30) -> DataFrame:
    recent = orders.where(F.col("order_date") >= _back(as_of, days))
    per_customer = recent.groupBy("customer_key").agg(F.count("*").alias("n"), F.sum("order_total").alias("s"))
    return (
        per_customer.join(customer.select("customer_key", F.col(segment).alias("segment")), "customer_key")
        .groupBy("segment")
        .agg(
            F.sum("n").alias("order_count"),
            F.sum("s").alias("revenue"),
            ratio(F.sum("s"), F.sum("n")).alias("avg_order_value"),
        )
    )


# Generic profiles -----------------------------------------------------------------------


def pick_columns(df: DataFrame) -> dict[str, list[str]]:
    """Number, date and text columns in schema order; real dates go before date-like names."""
    kinds: dict[str, list[str]] = {"numeric": [], "date": [], "text": []}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["date"].append(field.name)
        elif isinstance(field.dataType, T.StringType):
            kinds["text"].append(field.name)
    hints = ("_date", "_at", "_ts", "_time")
    named = [f.name for f in df.schema.fields if f.name.endswith(hints) and f.name not in kinds["date"]]
    kinds["date"] += named
    return kinds


def _metric(df: DataFrame, group: str, number: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(number).alias("metric"))


def cumulative_metric(df: DataFrame, date_col: str, num_col: str) -> DataFrame:
    """Sum per day and its running total; one row per day enters the window."""
    daily = _metric(df.withColumn(date_col, F.to_date(date_col)), date_col, num_col)
    upto = W.orderBy(date_col).rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("cumulative_metric", F.sum("metric").over(upto))


def change_over_time(df: DataFrame, date_col: str, num_col: str) -> DataFrame:
    """Sum per day beside the day before it in the data."""
    daily = _metric(df.withColumn(date_col, F.to_date(date_col)), date_col, num_col)
    return daily.withColumn("previous_metric", F.lag("metric").over(W.orderBy(date_col)))


def magnitude_by_group(df: DataFrame, group_col: str, num_col: str) -> DataFrame:
    sums = df.groupBy(group_col).agg(F.sum(num_col).alias("magnitude"))
    return sums.orderBy(F.col("magnitude").desc_nulls_first(), group_col)


def ranked_groups(df: DataFrame, group_col: str, num_col: str) -> DataFrame:
    """Dense rank of the group sums; the ranks come from the sorted distinct sums, in parallel."""
    return dense_rank_over(_metric(df, group_col, num_col), "metric", "metric_rank")


def part_to_whole(df: DataFrame, group_col: str, num_col: str) -> DataFrame:
    """Share of every group; 0 where the total is 0."""
    sums = _metric(df, group_col, num_col)
    total = sums.agg(F.sum("metric")).scalar().cast("double")
    share = F.when(total == 0, 0.0).otherwise(F.col("metric").cast("double") / total)
    return sums.withColumn("share", share)


def quartile_segments(df: DataFrame, group_col: str, num_col: str) -> DataFrame:
    """Quartile of every group by its sum; equal sums go by group name."""
    sums = _metric(df, group_col, num_col)
    return ntile_over(sums, [F.col("metric").desc_nulls_first(), F.col(group_col).asc()], 4, "segment")


def fk_hit_counts(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Joined rows per foreign key value, from counts on both sides."""
    a = left.where(F.col(on[0]).isNotNull()).groupBy(F.col(on[0]).alias("src_key")).agg(F.count("*").alias("_a"))
    b = right.groupBy(F.col(on[1]).alias("src_key")).agg(F.count("*").alias("_b"))
    return a.join(b, "src_key").select("src_key", (F.col("_a") * F.col("_b")).alias("hit_count"))


def fk_join_profile(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Matched rows and distinct keys per foreign key value."""
    hits = fk_hit_counts(left, right, on)
    return hits.select("src_key", F.col("hit_count").alias("row_count"), F.lit(1).cast("long").alias("distinct_src_keys"))


def fk_unmatched_profile(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Unmatched and scanned rows per foreign key value, NULL included."""
    a = left.groupBy(F.col(on[0]).alias("src_key")).agg(F.count("*").alias("_a"))
    b = right.where(F.col(on[1]).isNotNull()).groupBy(F.col(on[1]).alias("src_key")).agg(F.count("*").alias("_b"))
    joined = a.join(b, "src_key", "left")
    return joined.select(
        "src_key",
        F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.lit(0)).alias("unmatched_rows"),
        (F.col("_a") * F.coalesce("_b", F.lit(1))).alias("scanned_rows"),
    )


def fk_chain_profile(
    a: DataFrame, b: DataFrame, c: DataFrame, ab: tuple[str, str], bc: tuple[str, str]
) -> DataFrame:
    """Inner a-b, left b-c: joined rows, rows without a third-table match, distinct left keys.

    Key counts are joined in place of rows, so a key that holds a third of a table is one row.
    """
    left = a.where(F.col(ab[0]).isNotNull()).groupBy(F.col(ab[0]).alias("k")).agg(F.count("*").alias("_a"))
    middle = b.groupBy(F.col(ab[1]).alias("k"), F.col(bc[0]).alias("k2")).agg(F.count("*").alias("_b"))
    right = c.where(F.col(bc[1]).isNotNull()).groupBy(F.col(bc[1]).alias("k2")).agg(F.count("*").alias("_c"))
    joined = left.join(middle, "k").join(right, "k2", "left")
    rows = F.col("_a") * F.col("_b") * F.coalesce("_c", F.lit(1))
    return joined.agg(
        F.sum(rows).alias("joined_rows"),
        F.sum(F.when(F.col("_c").isNull(), F.col("_a") * F.col("_b")).otherwise(0)).alias("null_in_third_table"),
        F.count_distinct("k").alias("distinct_left_keys"),
    )


# Grouped paging ----------------------------------------------------------------------


def group_page(df: DataFrame, group: str, value: str, page: int, size: int) -> DataFrame:
    """One page of groups by falling sum, with the number of groups and pages."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"), F.count("*").alias("rows_in_group"))
    groups = sums.agg(F.count("*")).scalar()
    return (
        sums.orderBy(F.col("total").desc_nulls_last(), F.col(group).asc_nulls_last())
        .offset(page * size)
        .limit(size)
        .withColumn("group_count", groups)
        .withColumn("page_count", F.ceil(groups / F.lit(size)).cast("int"))
    )
