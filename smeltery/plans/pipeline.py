"""The whole load: bronze to silver to gold over stored layers, each step logged as it happens.

A step reads what is stored, adds what is missing and is safe to run again. Orders, lines and facts are
stored by day, and a load reads and writes only days that changed: bronze from the last ingest day on,
silver and gold the order days of what came in. Small rows in ``monitoring.load_marks`` say how far that
is; they are written so that a load that stops anywhere is made good by the next. Rows whose customer,
order or product is not there yet wait in the layer ``pending`` and are tried again with every load.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.functions.keyed import not_yet_in, only_in
from smeltery.functions.ordered import with_surrogate_key
from smeltery.operators import gold, marts, quality, silver
from smeltery.operators.monitoring import run_row
from smeltery.session import durable
from smeltery.sources.tables import Warehouse

MOST_DAYS = 3000
"""More changed days than this are read as the whole table."""
TRACKED = ["income_bracket", "customer_type"]
MARKS = "table_name string, stage string, day string, value long, at timestamp"

# Surrogate key and natural key of every silver table, in load order.
SILVER_KEYS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("country", "country_key", ("country_id",)),
    ("location", "location_key", ("location_id",)),
    ("warehouse", "warehouse_key", ("warehouse_id",)),
    ("product", "product_key", ("product_id",)),
    ("inventory", "inventory_key", ("inventory_id",)),
    ("person", "person_key", ("person_id",)),
    ("restricted_info", "restricted_info_key", ("person_key",)),
    ("person_location", "person_location_key", ("person_key", "location_key")),
    ("phone_number", "phone_key", ("phone_id",)),
    ("customer_company", "company_key", ("company_id",)),
    ("customer_employee", "customer_employee_key", ("customer_employee_id",)),
    ("employment_jobs", "job_key", ("hr_job_id",)),
    ("employee", "employee_key", ("employee_id",)),
    ("customer", "customer_key", ("customer_id",)),
    ("orders", "order_key", ("order_id",)),
    ("order_item", "order_item_key", ("order_item_id",)),
)


def _clock() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Load:
    """One run over a warehouse; ``run_ts`` is the time every step stamps.

    ``whole_history`` reads everything again, as the first load does. Without it an order is taken to keep its
    order date between versions; lines of an order from an earlier load take the promotion of its newest row.
    ``only`` names the tables whose steps run; days count as loaded when both facts did.
    """

    def __init__(self, warehouse: Warehouse, run_ts: str, clock: Callable[[], dt.datetime] = _clock, whole_history: bool = False, only: Iterable[str] | None = None):
        self.wh, self.run_ts, self.clock, self.whole_history = warehouse, run_ts, clock, whole_history
        self.only = None if only is None else set(only)
        self.run_id = uuid.uuid4().hex
        self.as_of = run_ts[:10]
        self._steps_done, self._steps = 0, len(SILVER_KEYS) + 16

    # Log and marks ----------------------------------------------------------------------

    def _step(self, layer: str, table: str, work: Callable[[], int]) -> int:
        """Run one step, which returns the rows it added; the log gets a row when it starts and one when it ends."""
        if self.only is not None and table not in self.only:
            return 0
        started = self.clock()
        self._log(layer, table, "running", 0, started, None)
        try:
            added = work()
        except Exception as problem:
            self._log(layer, table, "failed", 0, started, self.clock(), str(problem))
            raise
        self._steps_done += 1
        self._log(layer, table, "completed", added, started, self.clock())
        return added

    def _log(self, layer, table, status, records, started, ended, error=None) -> None:
        progress = min(100, 100 * self._steps_done // self._steps)
        row = run_row(self.wh.spark, self.run_id, "complete_etl", layer, table, status, records, started, ended, error, progress)
        self.wh.append("monitoring", "job_runs", row.coalesce(1))

    def _mark(self, table: str, stage: str, days: Iterable[str] = (), value: int | None = None) -> None:
        rows = [(table, stage, day, value, self.clock()) for day in days] or ([(table, stage, None, value, self.clock())] if value is not None else [])
        if rows:
            self.wh.append("monitoring", "load_marks", self.wh.spark.createDataFrame(rows, MARKS).coalesce(1))

    def _marks(self, table: str, stage: str) -> DataFrame:
        held = self.wh.read_or_none("monitoring", "load_marks")
        held = self.wh.spark.createDataFrame([], MARKS) if held is None else held
        return held.where((F.col("table_name") == table) & (F.col("stage") == stage))

    def changed_days(self) -> list[str] | None:
        """Order days that silver changed since gold last took them; None stands for all days."""
        if self.whole_history:
            return None
        newest = [self._marks("orders", s).groupBy("day").agg(F.max("at").alias(s)) for s in ("changed", "loaded")]
        open_days = newest[0].join(newest[1], "day", "left").where("loaded IS NULL OR changed > loaded")
        days = sorted(r.day for r in open_days.select("day").limit(MOST_DAYS + 1).collect())
        return None if len(days) > MOST_DAYS else days

    def _top_key(self, table: str, key: str) -> int:
        """Highest surrogate key so far: from the marks, or from the table where there is none."""
        marked = self._marks(table, "key").agg(F.max("value")).first()[0]
        if marked is not None:
            return marked
        held = self.wh.read_or_none("silver", table)
        return 0 if held is None else held.agg(F.max(key)).first()[0] or 0

    # Silver -----------------------------------------------------------------------------

    def _silver(self, table: str) -> DataFrame:
        return self.wh.read("silver", table)

    def _build(self, table: str) -> DataFrame:
        bronze = self.wh.read("bronze", "employment" if table == "employee" else table)
        have = self.wh.read_or_none("silver", table)
        ts, s = self.run_ts, self._silver
        parents = {
            "location": lambda: (s("country"),),
            "warehouse": lambda: (s("location"),),
            "inventory": lambda: (s("product"), s("warehouse")),
            "restricted_info": lambda: (s("person"),),
            "person_location": lambda: (s("person"), s("location")),
            "phone_number": lambda: (s("person"), s("location")),
            "customer_employee": lambda: (s("customer_company"),),
            "employment_jobs": lambda: (s("country"),),
            "customer": lambda: (s("person"), s("customer_employee")),
        }
        builder = getattr(silver, f"silver_{table}")
        return builder(bronze, have, ts, *parents.get(table, tuple)())

    def _employees(self) -> DataFrame:
        """Managers are looked up among all employees, those of this very load included; the new ones are built once."""
        have, jobs, person = self.wh.read_or_none("silver", "employee"), self._silver("employment_jobs"), self._silver("person")
        nobody = self.wh.spark.createDataFrame([], "employee_id int, employee_key long")
        known = nobody if have is None else have.select("employee_id", "employee_key")
        bronze = self.wh.read("bronze", "employment")
        of_persons = only_in(bronze.where("person_id IS NOT NULL"), person, ["person_id"])
        ids = not_yet_in(silver.newest(of_persons, "employment"), have, ["employee_id"]).select("employee_id")
        keyed = with_surrogate_key(ids, "employee_key", ["employee_id"], self._top_key("employee", "employee_key"))
        rows = silver.silver_employee(bronze, have, self.run_ts, person, jobs, known.unionByName(keyed))
        return rows.join(keyed, "employee_id").select("employee_key", *rows.columns)

    def _arrived(self, table: str) -> tuple[DataFrame, DataFrame, str | None]:
        """Bronze rows from the last ingest day read on (all rows before the first load), rows that waited for a
        parent, and the newest ingest day."""
        last = None if self.whole_history else self._marks(table, "read").agg(F.max("day")).first()[0]
        days = [d for d in self.wh.day_list("bronze", table) if d[:1].isdigit()]
        since = None if last is None else (F.col("_load_date") >= F.lit(last).cast("date")) | F.col("_load_date").isNull()
        fresh = self.wh.read("bronze", table, since)
        waiting = self.wh.read_or_none("pending", table)
        return fresh, fresh.limit(0) if waiting is None else waiting.select(fresh.columns), max(days, default=None)

    def _in_days(self, column: str, days: Iterable[str] | None, kind: str) -> Column | None:
        return None if days is None else F.col(column).isin([F.lit(d).cast(kind) for d in days]) if days else F.lit(False)

    def _add(self, table: str, key: str, natural: tuple[str, ...], rows: DataFrame) -> int:
        """Key the rows (which stores them once), mark their days, append them."""
        start = self._top_key(table, key)
        keyed = rows if key in rows.columns else with_surrogate_key(rows, key, list(natural), start)
        if "order_date" in keyed.columns:
            found = keyed.select(F.col("order_date").cast("string")).distinct().collect()  # one row a day
            self._mark("orders", "changed", [r[0] for r in found])
        added = self.wh.append("silver", table, keyed)
        self._mark(table, "key", value=start + added)
        return added

    def _orders(self) -> int:
        fresh, waiting, newest_day = self._arrived("orders")
        customer = self._silver("customer")
        rows = fresh.unionByName(waiting)
        found = rows.select(F.col("order_date").cast("string")).distinct().limit(MOST_DAYS + 1).collect()
        days = None if self.whole_history or len(found) > MOST_DAYS or any(r[0] is None for r in found) else [r[0] for r in found]
        have = self.wh.read_or_none("silver", "orders", self._in_days("order_date", days, "date"))
        known = None if have is None else have.select("order_id")
        built = silver.silver_orders(rows, known, self.run_ts, customer, self._silver("employee"))
        added = self._add("orders", "order_key", ("order_id",), built)
        later = rows.where("customer_id IS NOT NULL").join(customer.select("customer_id"), "customer_id", "left_anti")
        self.wh.overwrite("pending", "orders", later.select(rows.columns).distinct())
        if newest_day:
            self._mark("orders", "read", [newest_day])
        return added

    def _order_items(self) -> int:
        fresh, waiting, newest_day = self._arrived("order_item")
        product, days = self._silver("product"), self.changed_days()
        orders = self.wh.read("silver", "orders", self._in_days("order_date", days, "date"))
        first, held_first, _ = self._arrived("orders")
        bronze_orders = first.unionByName(held_first)
        near_ids = durable(only_in(orders.select("order_id"), bronze_orders, ["order_id"]))
        lines = fresh.unionByName(waiting).distinct()
        near = only_in(lines, near_ids, ["order_id"])
        built = self._lines(near, days, bronze_orders, orders, product)
        later = [waiting.join(near_ids, "order_id", "left_anti")]
        far = durable(fresh.where("order_id IS NOT NULL").join(near_ids, "order_id", "left_anti"))
        all_read = days is None and self._marks("orders", "read").count() <= 1
        if not all_read and not far.isEmpty():
            # lines of orders from earlier loads: the only case that looks beyond the changed days
            everything = self.wh.read("silver", "orders")
            built = built.unionByName(self._lines(far, None, self.wh.read("bronze", "orders"), everything, product))
            far = far.join(everything.select("order_id"), "order_id", "left_anti")
        later.append(far)
        added = self._add("order_item", "order_item_key", ("order_item_id",), built)
        no_product = lines.where("order_id IS NOT NULL AND product_id IS NOT NULL").join(product.select("product_id"), "product_id", "left_anti")
        later.append(only_in(no_product, near_ids, ["order_id"]))
        still = [df.select(lines.columns) for df in later]
        self.wh.overwrite("pending", "order_item", still[0].unionByName(still[1]).unionByName(still[2]).distinct())
        if newest_day:
            self._mark("order_item", "read", [newest_day])
        return added

    def _lines(self, lines: DataFrame, days: list[str] | None, bronze_orders: DataFrame, orders: DataFrame, product: DataFrame) -> DataFrame:
        """Cleaned new lines with the day of their order, which is where they are stored."""
        have = self.wh.read_or_none("silver", "order_item", self._in_days("order_date", days, "date"))
        known = None if have is None else have.select("order_item_id")
        built = silver.silver_order_item(lines, known, self.run_ts, bronze_orders, orders, product)
        return built.join(orders.select("order_key", "order_date"), "order_key").select(*built.columns, "order_date")

    def transform_all(self) -> dict[str, int]:
        """Every silver table in foreign key order; rows added per table."""
        special = {"orders": self._orders, "order_item": self._order_items}
        added = {}
        for table, key, natural in SILVER_KEYS:
            if not self.wh.exists("bronze", "employment" if table == "employee" else table):
                continue

            def work(table=table, key=key, natural=natural) -> int:
                return self._add(table, key, natural, self._employees() if table == "employee" else self._build(table))

            added[table] = self._step("silver", table, special.get(table, work))
        return added

    # Gold ---------------------------------------------------------------------------------

    def _layer(self, layer: str) -> dict[str, DataFrame]:
        class Stored(dict):
            def __missing__(inner, name):  # noqa: N805
                return self.wh.read(layer, name)

        return Stored()

    def _append(self, table: str, build: Callable[[DataFrame | None], DataFrame], days: Column | None = None) -> int:
        return self._step("gold", table, lambda: self.wh.append("gold", table, build(self.wh.read_or_none("gold", table, days))))

    def _rebuild(self, table: str, build: Callable[[], DataFrame]) -> int:
        return self._step("gold", table, lambda: self.wh.overwrite("gold", table, build()))

    def _promotions(self, orders: DataFrame, have: DataFrame | None) -> DataFrame:
        start = 0 if have is None else have.agg(F.max("promotion_key")).first()[0] or 0
        fresh = gold.dim_promotion(orders, have, self.as_of)
        return with_surrogate_key(fresh, "promotion_key", ["promotion_code"], start)

    def aggregate_all(self, mode: str = "rebuild") -> dict[str, int]:
        """Dimensions and facts appended, one inventory snapshot, aggregates.

        Facts and the daily aggregate take the days that silver changed. ``mode="append"`` keeps aggregate rows
        already there, as the append-if-absent statements do; ``"rebuild"`` computes them from silver anew, the
        daily one for the changed days.
        """
        s, g, day = self._layer("silver"), self._layer("gold"), self.as_of
        days = self.changed_days()
        in_days = self._in_days("order_date", days, "date")
        keys = None if days is None else [d.replace("-", "") for d in days]
        by_key, by_date = self._in_days("order_date_key", keys, "int"), self._in_days("date_key", keys, "int")
        recent = self._layer("silver")
        recent |= {t: self.wh.read("silver", t, in_days) for t in ("orders", "order_item")}
        orders, items = recent["orders"], recent["order_item"]

        def dates(have: DataFrame | None) -> DataFrame:
            return gold.dim_date(orders, day) if have is None else gold.dim_date_fill_gaps(have, orders)

        done = {
            "dim_date": self._append("dim_date", dates),
            "dim_customer": self._append("dim_customer", lambda h: gold.dim_customer(s, h, day)),
            "dim_product": self._append("dim_product", lambda h: gold.dim_product(s, h, day)),
            "dim_employee": self._append("dim_employee", lambda h: gold.dim_employee(s, h, day)),
            "dim_location": self._append("dim_location", lambda h: gold.dim_location(s, h, day)),
            "dim_warehouse": self._append("dim_warehouse", lambda h: gold.dim_warehouse(s, g["dim_location"], h, day)),
            "dim_promotion": self._append("dim_promotion", lambda h: self._promotions(orders, h)),
            "fact_sales": self._append("fact_sales", lambda h: gold.fact_sales(recent, g, h, mode="append"), by_key),
            "fact_orders": self._append("fact_orders", lambda h: gold.fact_orders(recent, g, h, mode="append"), by_key),
        }
        done |= self._customer_versions(g, by_key)
        if self.wh.exists("silver", "inventory"):
            done["fact_inventory_snapshot"] = self._snapshot(s)
        daily = lambda h: gold.agg_daily_sales(orders, items, h)
        if mode == "append":
            done["agg_daily_sales"] = self._append("agg_daily_sales", daily, by_date)
        else:
            done["agg_daily_sales"] = self._step("gold", "agg_daily_sales", lambda: self.wh.overwrite_partitions("gold", "agg_daily_sales", daily(None)))
        aggregates: dict[str, Callable[[DataFrame | None], DataFrame]] = {
            "agg_customer_lifetime": lambda h: gold.agg_customer_lifetime(s["customer"], s["orders"], s["order_item"], day, h),
            "agg_monthly_product_sales": lambda h: gold.agg_monthly_product_sales(s["orders"], s["order_item"], s["product"], h),
            "agg_sales_rep_performance": lambda h: gold.agg_sales_rep_performance(s["orders"], s["order_item"], s["employee"], h),
        }
        for table, build in aggregates.items():
            done[table] = self._append(table, build) if mode == "append" else self._rebuild(table, lambda b=build: b(None))
        if self.only is not None and not {"fact_sales", "fact_orders"} <= self.only:
            return done
        if days:
            self._mark("orders", "loaded", days)
        elif days is None:
            self._mark("orders", "loaded", [d for d in self.wh.day_list("silver", "orders") if d[:1].isdigit()])
        return done

    def _customer_versions(self, g, by_key: Column | None) -> dict[str, int]:
        """History of the tracked customer columns, and for every sales line the version its customer had on that day.

        Silver keeps a customer's first row; history follows the newest bronze row of every load. Lines are looked up
        once, when they come in: a later version leaves them as they are.
        """

        def history() -> int:
            bronze, person, staff = self.wh.read("bronze", "customer"), self._silver("person"), self._silver("customer_employee")
            incoming = silver.silver_customer(bronze, None, self.run_ts, person, staff).select("customer_id", *TRACKED)
            have = self.wh.read_or_none("gold", "dim_customer_history")
            nothing = F.lit(None).cast("timestamp_ntz")
            empty = incoming.limit(0).select("*", nothing.alias("valid_from"), nothing.alias("valid_to"), F.lit(True).alias("is_current"))
            merged = marts.scd2_merge(empty if have is None else have.drop("version_key"), incoming, "customer_id", TRACKED, self.run_ts)
            before = 0 if have is None else have.count()
            return self.wh.overwrite("gold", "dim_customer_history", merged.withColumn("version_key", F.xxhash64("customer_id", "valid_from"))) - before

        def versions(have: DataFrame | None) -> DataFrame:
            sales = self.wh.read("gold", "fact_sales", by_key).select("order_date_key", "order_id", "order_item_id", "customer_key")
            if have is not None:
                sales = sales.join(have.select("order_id", "order_item_id"), ["order_id", "order_item_id"], "left_anti")
            names = self._silver("customer").select("customer_key", "customer_id")
            dated = sales.join(names, "customer_key").withColumn("sold", F.to_date(F.col("order_date_key").cast("string"), "yyyyMMdd"))
            found = marts.version_at(dated, g["dim_customer_history"], "customer_id", "sold", ["version_key"])
            return found.select("order_date_key", "order_id", "order_item_id", "customer_key", F.col("version_key").alias("customer_version_key"))

        return {
            "dim_customer_history": self._step("gold", "dim_customer_history", history),
            "fact_customer_version": self._append("fact_customer_version", versions, by_key),
        }

    def _snapshot(self, s) -> int:
        def work() -> int:
            have = self.wh.read_or_none("gold", "fact_inventory_snapshot")
            return self.wh.overwrite_partitions("gold", "fact_inventory_snapshot", gold.fact_inventory_snapshot(s, have, self.as_of))

        return self._step("gold", "fact_inventory_snapshot", work)

    def validate(self) -> DataFrame:
        """Duplicates of every stored silver and gold table."""
        parts = []
        for layer, keys in (("silver", quality.SILVER_KEYS), ("gold", quality.GOLD_KEYS)):
            held = {t: self.wh.read(layer, t) for t in keys if self.wh.exists(layer, t)}
            if held:
                parts.append(quality.validate_unique(held, keys))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def run(self, mode: str = "rebuild") -> dict[str, dict[str, int]]:
        return {"silver": self.transform_all(), "gold": self.aggregate_all(mode)}
