"""Data quality rules, duplicate checks and population reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.functions.exprs import trimmed
from smeltery.functions.keyed import count_missing

# What must be unique in the silver and gold tables.
SILVER_KEYS: dict[str, tuple[str, ...]] = {
    "country": ("country_id",),
    "location": ("location_id",),
    "warehouse": ("warehouse_id",),
    "product": ("product_id",),
    "inventory": ("inventory_id",),
    "person": ("person_id",),
    "restricted_info": ("person_key",),
    "phone_number": ("phone_id",),
    "customer_company": ("company_id",),
    "customer_employee": ("customer_employee_id",),
    "employment_jobs": ("hr_job_id",),
    "employee": ("employee_id",),
    "customer": ("customer_id",),
    "orders": ("order_id",),
    "order_item": ("order_item_id",),
    "person_location": ("person_key", "location_key"),
}
GOLD_KEYS: dict[str, tuple[str, ...]] = {
    "agg_daily_sales": ("date_key",),
    "agg_customer_lifetime": ("customer_key",),
    "agg_monthly_product_sales": ("year_number", "month_number", "category_name"),
}


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows minus distinct keys. A composite key with NULL parts is a key of its own."""
    key = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    return df.agg((F.count("*") - F.count_distinct(key)).alias("duplicates"))


def validate_unique(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per table: duplicates found and whether there are any."""
    out = None
    for name, cols in keys.items():
        if name not in tables:
            continue
        row = duplicate_count(tables[name], cols).select(F.lit(name).alias("table_name"), "duplicates")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("has_duplicates", F.col("duplicates") > 0)


def valid_rows(df: DataFrame, amount: str, identifier: str) -> DataFrame:
    """Rows with a positive amount and a non-blank id."""
    return df.where((F.col(amount) > 0) & trimmed(F.col(identifier).cast("string")).isNotNull())


def fk_misses(child: DataFrame, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct foreign key values without a parent, per key column."""
    out = None
    for column, parent in parents.items():
        missing = count_missing(child, parent, column).select(
            F.lit(column).alias("key_column"), F.col(column).cast("long").alias("missing_value")
        )
        out = missing if out is None else out.unionByName(missing)
    return out


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass; as in a CHECK, NULL does not break a rule."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def population_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and emptiness of every table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("is_empty", F.col("row_count") == 0)
