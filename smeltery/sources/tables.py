"""Stored layers: Parquet folders written and read by Spark, partitioned by day where a table grows by the day.

Every full rewrite of a table is a new version folder beside the last, which counts once Spark's success
mark and the schema are in it; so a frame may read the table it replaces, and a rewrite that stops half way
leaves the table as it was. Appends and refreshed days go into the current version by Spark's own writer
(append, dynamic partition overwrite), which moves files into place when the whole job is done. One load
writes a table at a time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

LAYERS = ("bronze", "silver", "gold", "monitoring")
VERSION = "v="
# Children before parents.
EMPTYING_ORDER = {
    "gold": (
        "agg_sales_rep_performance",
        "agg_monthly_product_sales",
        "agg_customer_lifetime",
        "agg_daily_sales",
        "fact_inventory_snapshot",
        "fact_customer_version",
        "fact_orders",
        "fact_sales",
        "dim_customer_history",
        "dim_promotion",
        "dim_warehouse",
        "dim_location",
        "dim_employee",
        "dim_product",
        "dim_customer",
        "dim_date",
    ),
    "silver": (
        "order_item",
        "orders",
        "customer",
        "employee",
        "employment_jobs",
        "customer_employee",
        "customer_company",
        "phone_number",
        "person_location",
        "restricted_info",
        "person",
        "inventory",
        "product",
        "warehouse",
        "location",
        "country",
    ),
    "bronze": (
        "order_item",
        "orders",
        "customer",
        "employment",
        "employment_jobs",
        "customer_employee",
        "customer_company",
        "phone_number",
        "person_location",
        "restricted_info",
        "person",
        "inventory",
        "product",
        "warehouse",
        "location",
        "country",
    ),
}


@dataclass(frozen=True)
class Days:
    """Partition column of a table. Where ``source`` is given the column is made of it on the way in and is no
    column of the table; filters on it go through ``Warehouse.read(days=...)``."""

    column: str
    source: Column | None = None
    hidden: bool = False

    def added(self, df: DataFrame) -> DataFrame:
        return df if self.source is None or self.column in df.columns else df.withColumn(self.column, self.source)


def _day_of(column: str, timestamp: str) -> Days:
    return Days(column, F.to_date(F.col(timestamp)), True)


def partitioned() -> dict[str, Days]:
    """Tables that are stored by day."""
    return {
        "bronze.orders": _day_of("_load_date", "_load_timestamp"),
        "bronze.order_item": _day_of("_load_date", "_load_timestamp"),
        "bronze.clickstream": _day_of("event_date", "event_timestamp"),
        "monitoring.query_logs": _day_of("log_date", "collected_at"),
        "silver.orders": Days("order_date"),
        "silver.order_item": Days("order_date", hidden=True),
        "silver.user_events": Days("event_date"),
        "silver.inventory_snapshots": Days("snapshot_date"),
        "gold.user_events": Days("event_date"),
        "gold.inventory_snapshots": Days("snapshot_date"),
        "gold.fact_sales": Days("order_date_key"),
        "gold.fact_orders": Days("order_date_key"),
        "gold.fact_customer_version": Days("order_date_key"),
        "gold.fact_inventory_snapshot": Days("snapshot_date_key"),
        "gold.agg_daily_sales": Days("date_key"),
    }


class Warehouse:
    """Tables under ``root/layer/table``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.days = partitioned()

    def folder(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _version(self, layer: str, table: str) -> int:
        """Number of the newest complete version; 0 where the table was never written."""
        fs, folder = self._at(self.folder(layer, table))
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted((int(n.removeprefix(VERSION)) for n in names if n.startswith(VERSION)), reverse=True)
        whole = (n for n in numbers if all(fs.exists(self._at(f"{self._path(layer, table, n)}/{f}")[1]) for f in ("_SUCCESS", "_schema")))
        return next(whole, 0)

    def _path(self, layer: str, table: str, version: int) -> str:
        return f"{self.folder(layer, table)}/{VERSION}{version:06d}"

    def _schema(self, path: str) -> T.StructType:
        fs, target = self._at(f"{path}/_schema")
        stream = fs.open(target)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return T.StructType.fromJson(json.loads(text))

    def exists(self, layer: str, table: str) -> bool:
        return self._version(layer, table) > 0

    def paths(self, layer: str, table: str) -> list[str]:
        """Folder of the current version, in a list; empty where there is none."""
        number = self._version(layer, table)
        return [self._path(layer, table, number)] if number else []

    def read(self, layer: str, table: str, days: Column | None = None) -> DataFrame:
        df = self.read_or_none(layer, table, days)
        if df is None:
            raise LookupError(f"no table {layer}.{table}")
        return df

    def read_or_none(self, layer: str, table: str, days: Column | None = None) -> DataFrame | None:
        """The current version with the schema it was written with, empty or not; ``days`` is a condition on the
        partition column, of which only the folders that fit are read."""
        number = self._version(layer, table)
        if not number:
            return None
        path, kept = self._path(layer, table, number), self.days.get(f"{layer}.{table}")
        schema = self._schema(path)
        rows = self.spark.read.schema(schema).parquet(path)
        if days is not None:
            rows = rows.where(days)
        return rows.select(*[n for n in schema.names if not (kept and kept.hidden and n == kept.column)])

    def day_list(self, layer: str, table: str) -> list[str]:
        """Values of the partition column, from the folder names alone."""
        found = set()
        for path in self.paths(layer, table):
            fs, folder = self._at(path)
            names = (s.getPath().getName() for s in fs.listStatus(folder))
            found |= {n.split("=", 1)[1] for n in names if n.startswith(f"{self.days[f'{layer}.{table}'].column}=")}
        return sorted(found)

    def _write(self, layer: str, table: str, df: DataFrame, path: str, mode: str) -> int:
        """Rows written, counted by the write itself."""
        kept, seen = self.days.get(f"{layer}.{table}"), Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if kept is None:
            rows.write.mode(mode).parquet(path)
        else:
            # rows of a day go to few files; adaptive execution splits a large day and joins small ones
            writer = rows.hint("rebalance", kept.column).write.partitionBy(kept.column)
            writer.mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)
        try:
            return seen.get["rows"]
        except Py4JJavaError:  # a plan known to be empty is cut down to nothing, the counter included
            return 0

    def overwrite(self, layer: str, table: str, df: DataFrame) -> int:
        """The table is this frame from now on; the frame may read the table itself. Returns the rows written."""
        kept = self.days.get(f"{layer}.{table}")
        rows = kept.added(df) if kept else df
        path = self._path(layer, table, self._version(layer, table) + 1)
        self._at(path)[0].delete(self._at(path)[1], True)  # what a rewrite that stopped half way left there
        written = self._write(layer, table, rows, path, "error")
        fs, target = self._at(f"{path}/_schema")
        stream = fs.create(target, True)
        stream.write(bytearray(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]).json(), "utf-8"))
        stream.close()
        return written

    def _into(self, layer: str, table: str, df: DataFrame, mode: str) -> int:
        number = self._version(layer, table)
        if not number:
            return self.overwrite(layer, table, df)
        path, kept = self._path(layer, table, number), self.days.get(f"{layer}.{table}")
        rows = kept.added(df) if kept else df
        return self._write(layer, table, rows.select(*[F.col(f.name).cast(f.dataType) for f in self._schema(path).fields]), path, mode)

    def append(self, layer: str, table: str, df: DataFrame) -> int:
        """Add rows; the first append makes the table. Returns the rows written."""
        return self._into(layer, table, df, "append")

    def overwrite_partitions(self, layer: str, table: str, df: DataFrame) -> int:
        """Replace only the days the frame holds; the others are not read or written."""
        if f"{layer}.{table}" not in self.days:
            raise ValueError(f"{layer}.{table} is not stored by day")
        return self._into(layer, table, df, "overwrite")


def read_table(spark: SparkSession, layer: str, table: str, root: str) -> DataFrame:
    """Full scan of a stored table; filters and columns of the query reach it."""
    return Warehouse(spark, root).read(layer, table)


def bronze_ingest(
    df: DataFrame, batch_id: int, source_system: str, run_ts, existing: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Raw rows with their origin; with keys, only rows not yet there."""
    rows = (
        df.withColumn("_source_system", F.lit(source_system))
        .withColumn("_load_timestamp", F.lit(run_ts).cast("timestamp_ntz"))
        .withColumn("_batch_id", F.lit(batch_id).cast("int"))
    )
    return insert_ignore(existing, rows, keys) if keys else rows


def insert_ignore(target: DataFrame | None, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows to add where keys already present, or repeated in the source, are left out.

    Of repeated source rows the smallest by the remaining columns stays, so a rerun adds the same.
    """
    rest = [c for c in source.columns if c not in keys]
    if rest:
        single = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*source.columns)
    else:
        single = source.distinct()
    if target is None:
        return single
    return single.join(target.select(*keys), list(keys), "left_anti").select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], merge: Mapping[str, str]) -> DataFrame:
    """The whole target after the merge.

    ``merge`` says per column how an existing row changes: ``new`` takes the source value,
    ``old`` keeps the stored one, ``coalesce`` the source value unless NULL, ``least`` and
    ``greatest`` the smaller or larger of both. Source keys must be unique.
    """
    t, s = target.alias("t"), source.alias("s")
    match = None
    for key in keys:
        test = F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
        match = test if match is None else match & test
    both = t.withColumn("_t", F.lit(True)).alias("t").join(s.withColumn("_s", F.lit(True)).alias("s"), match, "full_outer")
    found, given = F.col("t._t").isNotNull(), F.col("s._s").isNotNull()
    out = []
    for column in target.columns:
        if column in keys:
            out.append(F.when(found, F.col(f"t.{column}")).otherwise(F.col(f"s.{column}")).alias(column))
            continue
        old = F.col(f"t.{column}")
        new = F.col(f"s.{column}") if column in source.columns else F.lit(None)
        how = merge.get(column, "old")
        merged = {
            "new": new,
            "old": old,
            "coalesce": F.coalesce(new, old),
            "least": F.least(old, new),
            "greatest": F.greatest(old, new),
        }[how]
        out.append(F.when(found & given, merged).when(given, new).otherwise(old).alias(column))
    return both.select(*out)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Target with the columns of matching source rows, changed only where any of them differs."""
    fresh = source.select(*keys, F.struct(*cols).alias("_new"))
    joined = target.join(fresh, list(keys), "left")
    current = F.struct(*[F.col(c) for c in cols])
    differs = F.col("_new").isNotNull() & ~current.eqNullSafe(F.col("_new"))
    return joined.withColumn("_pick", F.when(differs, F.col("_new")).otherwise(current)).select(
        *[F.col(f"_pick.{c}").alias(c) if c in cols else F.col(c) for c in target.columns]
    )


def delete_orphans(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows that still have a source row."""
    return target.join(source.select(*keys), list(keys), "left_semi").select(*target.columns)


def delete_range(target: DataFrame, column: str, low, high) -> DataFrame:
    """Target without the rows of a closed range."""
    inside = F.col(column).between(F.lit(low), F.lit(high))
    return target.where(~F.coalesce(inside, F.lit(False)))


def truncate_layer(warehouse: Warehouse, layer: str) -> list[str]:
    """Empty every stored table of a layer, children first; the schemas stay."""
    emptied = []
    for table in EMPTYING_ORDER[layer]:
        for path in warehouse.paths(layer, table):
            warehouse.overwrite(layer, table, warehouse.spark.createDataFrame([], warehouse._schema(path)))
            emptied.append(table)
    return emptied
