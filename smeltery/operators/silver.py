"""Bronze to silver: newest row per key, anti join against what is loaded, cleaning, key lookups.

Every builder is ``silver_<entity>(bronze, existing, run_ts, ...)``; ``existing`` may be
None on a first load. Surrogate keys are given when rows are written
(``smeltery.functions.ordered.with_surrogate_key``); parents come in as frames holding
natural and surrogate key. Day arithmetic uses the date of ``run_ts``.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.functions.exprs import (
    blank_to,
    empty_to,
    join_nonblank,
    ladder,
    lookup,
    masked,
    money,
    null_to,
    stamp,
    trimmed,
    whole_years,
)
from smeltery.functions.keyed import latest_per_key, not_yet_in, only_in

# Natural key and payload columns of the bronze tables.
BRONZE: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "country": (("country_id",), ("country_name", "country_code", "nat_lang_code", "currency_code")),
    "location": (
        ("location_id",),
        (
            "country_id",
            "address_line_1",
            "address_line_2",
            "city",
            "state",
            "district",
            "postal_code",
            "location_type_code",
            "description",
            "shipping_notes",
        ),
    ),
    "warehouse": (("warehouse_id",), ("location_id", "warehouse_name")),
    "product": (
        ("product_id",),
        (
            "product_name",
            "description",
            "category",
            "weight_class",
            "warranty_period",
            "supplier_id",
            "status",
            "list_price",
            "minimum_price",
            "price_currency",
            "catalog_url",
        ),
    ),
    "inventory": (("inventory_id",), ("product_id", "warehouse_id", "quantity_on_hand", "quantity_available")),
    "person": (
        ("person_id",),
        ("first_name", "last_name", "middle_names", "nickname", "nat_lang_code", "culture_code", "gender"),
    ),
    "restricted_info": (
        ("person_id",),
        ("date_of_birth", "date_of_death", "government_id", "passport_id", "hire_date", "seniority_code"),
    ),
    "person_location": (("persons_person_id", "locations_location_id"), ("sub_address", "location_usage", "notes")),
    "phone_number": (
        ("phone_number_id",),
        ("persons_person_id", "locations_location_id", "phone_number", "country_code", "phone_type_id"),
    ),
    "customer_company": (("company_id",), ("company_name", "company_credit_limit", "credit_limit_currency")),
    "customer_employee": (
        ("customer_employee_id",),
        ("company_id", "badge_number", "job_title", "department", "credit_limit", "credit_limit_currency"),
    ),
    "employment_jobs": (("hr_job_id",), ("countries_country_id", "job_title", "min_salary", "max_salary")),
    "employment": (
        ("employee_id",),
        (
            "person_id",
            "hr_job_id",
            "manager_employee_id",
            "start_date",
            "end_date",
            "salary",
            "commission_percent",
            "employment_status",
        ),
    ),
    "customer": (("customer_id",), ("person_id", "customer_employee_id", "accountmgr_id", "income_level")),
    "orders": (
        ("order_id",),
        (
            "customer_id",
            "sales_rep_id",
            "order_date",
            "order_code",
            "order_status",
            "order_total",
            "order_currency",
            "promotion_code",
        ),
    ),
    "order_item": (("order_item_id",), ("order_id", "product_id", "unit_price", "quantity")),
}

# Code lists and tiers of the cleaning rules.
WEIGHT_CLASSES = {1: "Light", 2: "Medium", 3: "Heavy", 4: "Very Heavy", 5: "Extra Heavy"}
SENIORITY_LEVELS = {1: "JUNIOR", 2: "MID", 3: "SENIOR", 4: "LEAD", 5: "EXECUTIVE"}
PHONE_TYPES = {1: "MOBILE", 2: "HOME", 3: "WORK", 4: "FAX", 5: "OTHER"}
CREDIT_TIERS = ((1_000_000, "PLATINUM"), (500_000, "GOLD"), (100_000, "SILVER"))
INCOME_BRACKETS = ((8, "PREMIUM"), (5, "HIGH"), (3, "MEDIUM"))
STATUS_GROUPS = (
    ("PROCESSING", ("PENDING", "PROCESSING")),
    ("COMPLETED", ("SHIPPED", "DELIVERED", "COMPLETED")),
    ("CANCELLED", ("CANCELLED", "CANCELED")),
)
USAGE_WORDS = (
    ("HOME", ("HOME",)),
    ("WORK", ("WORK", "OFFICE")),
    ("SHIPPING", ("SHIPPING", "SHIP")),
    ("BILLING", ("BILLING", "BILL")),
)
PROMOTION_RATE = Decimal("0.10")
DASH = "—"


def newest(bronze: DataFrame, table: str) -> DataFrame:
    """Newest bronze row per natural key, rows without a key left out."""
    keys, payload = BRONZE[table]
    held = bronze.dropna(subset=list(keys)).select(*keys, *payload, "_load_timestamp")
    return latest_per_key(held, keys).drop("_load_timestamp")


def _fresh(bronze: DataFrame, table: str, existing: DataFrame | None) -> DataFrame:
    return not_yet_in(newest(bronze, table), existing, BRONZE[table][0])


def _key_of(dim: DataFrame, natural: str, key: str, alias_natural: str, alias_key: str | None = None) -> DataFrame:
    return dim.select(F.col(natural).alias(alias_natural), F.col(key).alias(alias_key or key))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def silver_country(bronze: DataFrame, existing: DataFrame | None, run_ts) -> DataFrame:
    rows = _fresh(bronze, "country", existing).select(
        "country_id",
        empty_to("country_name", "Unknown").alias("country_name"),
        empty_to("country_code", "XXX").alias("country_code"),
        null_to("nat_lang_code", 1033).alias("national_language_code"),
        empty_to("currency_code", "USD").alias("currency_code"),
    )
    return stamp(rows, run_ts)


def silver_location(bronze: DataFrame, existing: DataFrame | None, run_ts, country: DataFrame) -> DataFrame:
    rows = _fresh(bronze, "location", existing).join(
        _key_of(country, "country_id", "country_key", "country_id"), "country_id", "left"
    )
    line1, city = blank_to("address_line_1", "Address pending"), blank_to("city", "Unknown")
    state, code = blank_to("state", "NA"), blank_to("postal_code", "00000")
    return stamp(
        rows.select(
            "location_id",
            "country_key",
            line1.alias("address_line_1"),
            blank_to("address_line_2", DASH).alias("address_line_2"),
            city.alias("city"),
            state.alias("state_province"),
            blank_to("district", DASH).alias("district"),
            code.alias("postal_code"),
            F.concat(F.lit("TYPE_"), _zero("location_type_code").cast("string")).alias("location_type"),
            blank_to("description", "No description").alias("description"),
            blank_to("shipping_notes", "No shipping notes").alias("shipping_notes"),
            join_nonblank(", ", line1, F.col("address_line_2"), city, state, code).alias("full_address"),
        ),
        run_ts,
    )


def silver_warehouse(bronze: DataFrame, existing: DataFrame | None, run_ts, location: DataFrame) -> DataFrame:
    rows = _fresh(bronze, "warehouse", existing).join(
        _key_of(location, "location_id", "location_key", "location_id"), "location_id", "left"
    )
    fallback = F.concat(F.lit("Warehouse "), F.col("warehouse_id").cast("string"))
    return stamp(
        rows.select("warehouse_id", "location_key", blank_to("warehouse_name", fallback).alias("warehouse_name")),
        run_ts,
    )


def silver_product(bronze: DataFrame, existing: DataFrame | None, run_ts) -> DataFrame:
    rows = _fresh(bronze, "product", existing)
    list_price = money(F.coalesce("list_price", F.lit(0)), 12)
    least = money(F.coalesce("minimum_price", F.lit(0)), 12)
    link = F.concat(F.lit("https://catalog.local/product/"), F.col("product_id").cast("string"))
    margin = list_price - least
    return stamp(
        rows.select(
            "product_id",
            empty_to("product_name", "Unknown Product").alias("product_name"),
            blank_to("description", "No description available").alias("description"),
            _zero("category").alias("category_id"),
            F.coalesce(F.concat(F.lit("Category_"), F.col("category").cast("string")), F.lit("Uncategorized")).alias(
                "category_name"
            ),
            null_to("weight_class", 1).alias("weight_class"),
            lookup("weight_class", WEIGHT_CLASSES, "Standard").alias("weight_class_description"),
            _zero("warranty_period").alias("warranty_period_months"),
            _zero("supplier_id").alias("supplier_id"),
            F.trim(empty_to("status", "ACTIVE")).alias("product_status"),
            list_price.alias("list_price"),
            least.alias("minimum_price"),
            empty_to("price_currency", "USD").alias("price_currency"),
            blank_to("catalog_url", link).alias("catalog_url"),
            money(margin, 12).alias("profit_margin"),
            F.round(F.when(list_price > 0, margin * 100 / list_price).otherwise(F.lit(0)), 2)
            .cast("decimal(5,2)")
            .alias("profit_margin_pct"),
        ),
        run_ts,
    )


def silver_inventory(
    bronze: DataFrame, existing: DataFrame | None, run_ts, product: DataFrame, warehouse: DataFrame
) -> DataFrame:
    """Product and warehouse are required: other rows drop out."""
    rows = (
        _fresh(bronze, "inventory", existing)
        .join(_key_of(product, "product_id", "product_key", "product_id"), "product_id")
        .join(_key_of(warehouse, "warehouse_id", "warehouse_key", "warehouse_id"), "warehouse_id")
    )
    held = rows.select(
        "inventory_id",
        "product_key",
        "warehouse_key",
        _zero("quantity_on_hand").alias("quantity_on_hand"),
        _zero("quantity_available").alias("quantity_available"),
        (_zero("quantity_on_hand") - _zero("quantity_available")).alias("quantity_reserved"),
        F.to_date(F.lit(run_ts)).alias("last_stock_date"),
    )
    return stamp(held, run_ts, validity=False)


def silver_person(bronze: DataFrame, existing: DataFrame | None, run_ts) -> DataFrame:
    rows = _fresh(bronze, "person", existing)
    first, last = blank_to("first_name", "Unknown"), blank_to("last_name", "Unknown")
    full = join_nonblank(" ", first, F.col("middle_names"), last)
    return stamp(
        rows.select(
            "person_id",
            first.alias("first_name"),
            last.alias("last_name"),
            blank_to("middle_names", DASH).alias("middle_names"),
            blank_to("nickname", DASH).alias("nickname"),
            full.alias("full_name"),
            blank_to("nickname", full).alias("display_name"),
            null_to("nat_lang_code", 1033).alias("national_language_code"),
            null_to("culture_code", 1033).alias("culture_code"),
            F.trim(empty_to("gender", "Unspecified")).alias("gender"),
        ),
        run_ts,
    )


def silver_restricted_info(bronze: DataFrame, existing: DataFrame | None, run_ts, person: DataFrame) -> DataFrame:
    rows = newest(bronze, "restricted_info").join(_key_of(person, "person_id", "person_key", "person_id"), "person_id")
    rows = not_yet_in(rows, existing, ["person_key"])
    today = F.to_date(F.lit(run_ts))
    level = F.when(F.col("seniority_code") != 0, lookup("seniority_code", SENIORITY_LEVELS, "UNKNOWN"))
    held = rows.select(
        "person_key",
        "date_of_birth",
        "date_of_death",
        whole_years(F.col("date_of_birth"), F.coalesce("date_of_death", today)).alias("age"),
        F.col("date_of_death").isNotNull().alias("is_deceased"),
        masked("government_id").alias("government_id_hash"),
        masked("passport_id").alias("passport_id_hash"),
        "hire_date",
        whole_years(F.col("hire_date"), today).alias("years_of_service"),
        "seniority_code",
        level.alias("seniority_level"),
    )
    return stamp(held, run_ts, validity=False)


def usage_type(usage: Column) -> Column:
    """First group whose word occurs in the usage text."""
    text = F.upper(F.coalesce(usage, F.lit("")))
    chain = None
    for label, words in USAGE_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("OTHER")


def silver_person_location(
    bronze: DataFrame, existing: DataFrame | None, run_ts, person: DataFrame, location: DataFrame
) -> DataFrame:
    rows = (
        newest(bronze, "person_location")
        .join(_key_of(person, "person_id", "person_key", "persons_person_id"), "persons_person_id")
        .join(_key_of(location, "location_id", "location_key", "locations_location_id"), "locations_location_id")
    )
    rows = not_yet_in(rows, existing, ["person_key", "location_key"])
    kind = usage_type(F.col("location_usage"))
    return stamp(
        rows.select(
            "person_key",
            "location_key",
            blank_to("sub_address", DASH).alias("sub_address"),
            blank_to("location_usage", kind).alias("location_usage"),
            kind.alias("location_usage_type"),
            blank_to("notes", DASH).alias("notes"),
            F.lit(False).alias("is_primary"),
        ),
        run_ts,
    )


def silver_phone_number(
    bronze: DataFrame, existing: DataFrame | None, run_ts, person: DataFrame, location: DataFrame
) -> DataFrame:
    fresh = newest(bronze, "phone_number").withColumnRenamed("phone_number_id", "phone_id")
    rows = (
        not_yet_in(fresh, existing, ["phone_id"])
        .join(_key_of(person.where("person_id <> 0"), "person_id", "person_key", "persons_person_id"), "persons_person_id", "left")
        .join(
            _key_of(location.where("location_id <> 0"), "location_id", "location_key", "locations_location_id"),
            "locations_location_id",
            "left",
        )
    )
    area = F.trim(empty_to("country_code", "+1"))
    number = F.trim(empty_to("phone_number", "0000000000"))
    missing = F.coalesce(F.col("phone_type_id"), F.lit(0)) == 0
    return stamp(
        rows.select(
            "phone_id",
            "person_key",
            "location_key",
            number.alias("phone_number"),
            area.alias("country_code"),
            F.trim(F.concat(area, F.lit(" "), number)).alias("full_phone_number"),
            F.when(missing, "MOBILE").otherwise(lookup("phone_type_id", PHONE_TYPES, "OTHER")).alias("phone_type"),
            F.lit(False).alias("is_primary"),
        ),
        run_ts,
    )


def silver_customer_company(bronze: DataFrame, existing: DataFrame | None, run_ts) -> DataFrame:
    limit = F.coalesce(F.col("company_credit_limit"), F.lit(0).cast("decimal(15,2)"))
    return stamp(
        _fresh(bronze, "customer_company", existing).select(
            "company_id",
            empty_to("company_name", "Unknown Company").alias("company_name"),
            limit.alias("credit_limit"),
            empty_to("credit_limit_currency", "USD").alias("credit_limit_currency"),
            ladder(limit, CREDIT_TIERS, "BRONZE").alias("credit_tier"),
        ),
        run_ts,
    )


def silver_customer_employee(bronze: DataFrame, existing: DataFrame | None, run_ts, company: DataFrame) -> DataFrame:
    rows = _fresh(bronze, "customer_employee", existing).join(
        _key_of(company, "company_id", "company_key", "company_id"), "company_id", "left"
    )
    badge = F.format_string("BADGE-%06d", F.col("customer_employee_id"))
    return stamp(
        rows.select(
            "customer_employee_id",
            "company_key",
            blank_to("badge_number", badge).alias("badge_number"),
            blank_to("job_title", "Representative").alias("job_title"),
            blank_to("department", "General").alias("department"),
            money(F.coalesce("credit_limit", F.lit(0)), 12).alias("credit_limit"),
            empty_to("credit_limit_currency", "USD").alias("credit_limit_currency"),
        ),
        run_ts,
    )


def silver_employment_jobs(bronze: DataFrame, existing: DataFrame | None, run_ts, country: DataFrame) -> DataFrame:
    rows = _fresh(bronze, "employment_jobs", existing).join(
        _key_of(country, "country_id", "country_key", "countries_country_id"), "countries_country_id", "left"
    )
    low, high = money(F.coalesce("min_salary", F.lit(0)), 12), money(F.coalesce("max_salary", F.lit(0)), 12)
    return stamp(
        rows.select(
            "hr_job_id",
            "country_key",
            empty_to("job_title", "Unknown Job").alias("job_title"),
            low.alias("min_salary"),
            high.alias("max_salary"),
            money(high - low, 12).alias("salary_range"),
            money(F.round((low + high) * F.lit(Decimal("0.5")), 2), 12).alias("mid_point_salary"),
        ),
        run_ts,
    )


def silver_employee(
    bronze: DataFrame, existing: DataFrame | None, run_ts, person: DataFrame, jobs: DataFrame, managers: DataFrame
) -> DataFrame:
    """Employment rows of known persons; the manager is looked up in ``managers``."""
    known = only_in(bronze.where(F.col("person_id").isNotNull()), person, ["person_id"])
    rows = (
        _fresh(known, "employment", existing)
        .join(_key_of(person, "person_id", "person_key", "person_id"), "person_id")
        .join(_key_of(jobs, "hr_job_id", "job_key", "hr_job_id"), "hr_job_id", "left")
        .join(
            _key_of(
                managers.where("employee_id <> 0"),
                "employee_id",
                "employee_key",
                "manager_employee_id",
                "manager_employee_key",
            ),
            "manager_employee_id",
            "left",
        )
    )
    today = F.to_date(F.lit(run_ts))
    start = F.coalesce("start_date", today)
    days = F.datediff(F.coalesce("end_date", today), start)
    salary = money(F.coalesce("salary", F.lit(0)), 12)
    share = F.lit(100).cast("decimal(5,0)") + F.coalesce(F.col("commission_percent"), F.lit(0).cast("decimal(5,2)"))
    return stamp(
        rows.select(
            "employee_id",
            "person_key",
            "job_key",
            "manager_employee_key",
            start.alias("start_date"),
            "end_date",
            days.alias("tenure_days"),
            F.floor(days / 365).cast("int").alias("tenure_years"),
            (F.col("end_date").isNull() | (F.col("end_date") > today)).alias("is_active"),
            salary.alias("salary"),
            "commission_percent",
            money(F.round(salary * share * F.lit(Decimal("0.01")), 2)).alias("total_compensation"),
            F.upper(empty_to("employment_status", "ACTIVE")).alias("employment_status"),
        ),
        run_ts,
    )


def silver_customer(
    bronze: DataFrame, existing: DataFrame | None, run_ts, person: DataFrame, customer_employee: DataFrame
) -> DataFrame:
    known = only_in(bronze.where(F.col("person_id").isNotNull()), person, ["person_id"])
    contacts = _key_of(
        customer_employee.where("customer_employee_id <> 0"),
        "customer_employee_id",
        "customer_employee_key",
        "customer_employee_id",
    )
    rows = (
        _fresh(known, "customer", existing)
        .join(_key_of(person, "person_id", "person_key", "person_id"), "person_id")
        .join(contacts, "customer_employee_id", "left")
    )
    corporate = F.coalesce(F.col("customer_employee_id"), F.lit(0)) != 0
    return stamp(
        rows.select(
            "customer_id",
            "person_key",
            "customer_employee_key",
            _zero("accountmgr_id").alias("account_manager_id"),
            _zero("income_level").alias("income_level"),
            ladder(_zero("income_level"), INCOME_BRACKETS, "LOW").alias("income_bracket"),
            F.when(corporate, "CORPORATE").otherwise("INDIVIDUAL").alias("customer_type"),
            F.to_date(F.lit(run_ts)).alias("customer_since"),
        ),
        run_ts,
    )


def status_category(status: Column) -> Column:
    chain = None
    for label, members in STATUS_GROUPS:
        hit = status.isin(*members)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise("PENDING")


def silver_orders(
    bronze: DataFrame, existing: DataFrame | None, run_ts, customer: DataFrame, employee: DataFrame
) -> DataFrame:
    known = only_in(bronze.where(F.col("customer_id").isNotNull()), customer, ["customer_id"])
    reps = _key_of(employee.where("employee_id <> 0"), "employee_id", "employee_key", "sales_rep_id", "sales_rep_key")
    rows = (
        _fresh(known, "orders", existing)
        .join(_key_of(customer, "customer_id", "customer_key", "customer_id"), "customer_id")
        .join(reps, "sales_rep_id", "left")
    )
    status = F.upper(empty_to("order_status", "PENDING"))
    code = blank_to("order_code", F.format_string("ORD-%010d", F.col("order_id")))
    promotion = blank_to("promotion_code", "")
    held = rows.select(
        "order_id",
        "customer_key",
        "sales_rep_key",
        F.coalesce("order_date", F.to_date(F.lit(run_ts))).alias("order_date"),
        code.alias("order_code"),
        status.alias("order_status"),
        status_category(status).alias("order_status_category"),
        money(F.coalesce("order_total", F.lit(0))).alias("order_total"),
        empty_to("order_currency", "USD").alias("order_currency"),
        promotion.alias("promotion_code"),
        (promotion != "").alias("has_promotion"),
    )
    return stamp(held, run_ts, validity=False)


def silver_order_item(
    bronze: DataFrame,
    existing: DataFrame | None,
    run_ts,
    bronze_orders: DataFrame,
    orders: DataFrame,
    product: DataFrame,
) -> DataFrame:
    """Lines of known orders and products; ten percent off where the newest bronze order has a promotion."""
    known = bronze.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
    known = only_in(only_in(known, orders, ["order_id"]), product, ["product_id"])
    promoted = newest(bronze_orders, "orders").select(
        "order_id", trimmed("promotion_code").isNotNull().alias("_promoted")
    )
    rows = (
        _fresh(known, "order_item", existing)
        .join(_key_of(orders, "order_id", "order_key", "order_id"), "order_id")
        .join(promoted, "order_id")
        .join(_key_of(product, "product_id", "product_key", "product_id"), "product_id")
    )
    price = money(F.greatest(F.coalesce("unit_price", F.lit(0)), F.lit(0)), 12)
    quantity = money(F.greatest(F.coalesce("quantity", F.lit(0)), F.lit(0)), 10)
    total = F.round(price * quantity, 2)
    off = F.when(F.col("_promoted"), F.round(price * quantity * F.lit(PROMOTION_RATE), 2)).otherwise(F.lit(0))
    discount = F.least(off, total)
    held = rows.select(
        "order_item_id",
        "order_key",
        "product_key",
        price.alias("unit_price"),
        quantity.alias("quantity"),
        money(total).alias("line_total"),
        money(discount, 12).alias("discount_amount"),
        money(F.round(price * quantity - discount, 2)).alias("net_amount"),
    )
    return stamp(held, run_ts, validity=False)


# What each step may load: (step, bronze table, silver table, required parents by natural key).
STEPS: tuple[tuple[str, str, str, tuple[tuple[str, str], ...]], ...] = (
    ("countries", "country", "country", ()),
    ("locations", "location", "location", ()),
    ("warehouses", "warehouse", "warehouse", ()),
    ("products", "product", "product", ()),
    ("inventory", "inventory", "inventory", ()),
    ("persons", "person", "person", ()),
    ("restricted_info", "restricted_info", "restricted_info", ()),
    ("person_locations", "person_location", "person_location", ()),
    ("phone_numbers", "phone_number", "phone_number", ()),
    ("customer_companies", "customer_company", "customer_company", ()),
    ("customer_employees", "customer_employee", "customer_employee", ()),
    ("employment_jobs", "employment_jobs", "employment_jobs", ()),
    ("employees", "employment", "employee", (("person", "person_id"),)),
    ("customers", "customer", "customer", (("person", "person_id"),)),
    ("orders", "orders", "orders", (("customer", "customer_id"),)),
    ("order_items", "order_item", "order_item", (("orders", "order_id"), ("product", "product_id"))),
)


def pending_counts(bronze: Mapping[str, DataFrame], silver: Mapping[str, DataFrame]) -> DataFrame:
    """Keys each step would still load, one row per step."""
    frames = []
    for step, source, target, parents in STEPS:
        keys = list(BRONZE[source][0])
        loaded = silver[target]
        rows = bronze[source].select(*keys, *[k for _, k in parents if k not in keys])
        for parent, natural in parents:
            rows = only_in(rows.where(F.col(natural).isNotNull()), silver[parent], [natural])
        rows = rows.select(*keys).distinct()
        if target == "restricted_info":
            rows = rows.join(silver["person"].select("person_id", "person_key"), "person_id")
            keys = ["person_key"]
        elif target == "person_location":
            rows = rows.join(
                _key_of(silver["person"], "person_id", "person_key", "persons_person_id"), "persons_person_id"
            ).join(
                _key_of(silver["location"], "location_id", "location_key", "locations_location_id"),
                "locations_location_id",
            )
            keys = ["person_key", "location_key"]
        elif target == "phone_number":
            rows = rows.withColumnRenamed("phone_number_id", "phone_id")
            keys = ["phone_id"]
        waiting = not_yet_in(rows, loaded, keys)
        frames.append(waiting.agg(F.count("*").alias("pending")).select(F.lit(step).alias("step"), "pending"))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def order_total_rollup(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order totals set to the sum over the lines; orders without lines keep theirs."""
    line = F.col("unit_price") * F.col("quantity")
    sums = items.groupBy("order_id").agg(F.round(F.sum(line), 2).cast("decimal(15,2)").alias("_sum"))
    joined = orders.join(sums, "order_id", "left")
    total = F.coalesce(F.col("_sum"), F.col("order_total"))
    return joined.withColumn("order_total", total).select(*orders.columns)


def dedupe_keep_first(df: DataFrame, keys: list[str], surrogate: str) -> DataFrame:
    """Only the row with the lowest surrogate per composite key; NULL keys count as one key here."""
    first = df.groupBy(*keys).agg(F.min(surrogate).alias(surrogate)).select(surrogate)
    return df.join(first, surrogate, "left_semi")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Composite keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
