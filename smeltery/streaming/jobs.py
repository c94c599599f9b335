"""Streaming jobs over file sources, with checkpoints and writes that a replayed batch repeats.

``foreachBatch`` jobs name what they write after the batch id: a batch that runs twice,
after a lost executor or a restarted driver, overwrites its own folders. What a batch is compared with
is only the days, or the buckets, that its own rows fall in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from smeltery.functions.keyed import latest_per_key
from smeltery.functions.exprs import money
from smeltery.operators import marts
from smeltery.operators.alerts import SUSTAINED_RULES, alert_sums, incident_rows, merged_sums, sync_incidents
from smeltery.sources.tables import insert_ignore

WATERMARK = "1 hour"
SESSION_GAP = "30 minutes"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def _start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    fs, target = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def _batches(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, root) if n.startswith("batch="))


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all batches written so far, by batch or by day."""
    if not any("=" in n for n in _names(spark, root)):
        raise LookupError(f"no batches under {root}")
    return spark.read.option("basePath", root).parquet(root).drop("batch", "_day")


# Rows added by key -----------------------------------------------------------------------


def _day_name(day) -> str:
    return "_day=__HIVE_DEFAULT_PARTITION__" if day is None else f"_day={day}"


def _days_before(spark: SparkSession, root: str, days: Sequence, batch: int, schema: T.StructType) -> DataFrame | None:
    """Rows that earlier batches stored for these days; no folder of another day is listed or read."""
    held = set(_names(spark, root))
    paths = [f"{root}/{_day_name(d)}" for d in days if _day_name(d) in held]
    if not paths:
        return None
    stored = T.StructType([*schema.fields, T.StructField("_day", T.DateType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(stored).option("basePath", root).parquet(*paths).where(F.col("batch") < batch)


def _by_day(df: DataFrame, root: str, batch: int) -> None:
    """Rows into a folder per day and batch; a replayed batch replaces its own folders."""
    writer = df.withColumn("batch", F.lit(batch)).write.partitionBy("_day", "batch").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(root)


def _new_rows(rows: DataFrame, root: str, keys: Sequence[str], day: Column, number: int) -> DataFrame:
    """Rows with their day whose key is not stored for that day yet."""
    dated = rows.withColumn("_day", day.cast("date"))
    days = [r[0] for r in dated.select("_day").distinct().collect()]  # one row a day of the batch
    have = _days_before(rows.sparkSession, root, days, number, rows.schema)
    return dated if have is None else dated.join(have.select(*keys), list(keys), "left_anti").select(dated.columns)


def stream_bronze_to_silver(
    stream: DataFrame,
    checkpoint: str,
    root: str,
    keys: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    day: Column,
    ts: str = "_load_timestamp",
    repeats: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Newest row per key of every batch, cleaned by ``build``, added where the key is not there yet.

    ``day`` is a date that all versions of a key share (an order's date, not its load time): a batch is compared
    with the stored rows of its own days, so its work does not grow with the stream. ``build`` keeps the key columns
    and those ``day`` needs. With ``repeats`` (a watermark delay on ``ts``) rows delivered twice, equal in key and
    ``ts``, leave in the engine's state before the batch; rows later than that delay are then late and go.
    """
    if repeats is not None:
        stream = stream.withWatermark(ts, repeats).dropDuplicatesWithinWatermark([*keys, ts])

    def each(batch: DataFrame, number: int) -> None:
        _by_day(_new_rows(build(latest_per_key(batch, keys, ts)), root, keys, day, number), root, number)

    return _start(stream, checkpoint, each, once)


def stream_fact_incremental(stream: DataFrame, checkpoint: str, root: str, keys: Sequence[str], day: Column, once: bool = True) -> StreamingQuery:
    """Fact rows added by key, not by highest id: late lower ids are kept.

    ``day`` is the fact's date, the same whenever a key comes again; only stored rows of a batch's days are read.
    """

    def each(batch: DataFrame, number: int) -> None:
        _by_day(_new_rows(insert_ignore(None, batch, keys), root, keys, day, number), root, number)

    return _start(stream, checkpoint, each, once)


# Counters --------------------------------------------------------------------------------


@dataclass
class Chain:
    """Queries that feed each other, to be waited for and stopped together."""

    queries: list[StreamingQuery]

    def awaitTermination(self) -> None:  # noqa: N802 - as on a query
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()

    @property
    def recentProgress(self) -> list:  # noqa: N802
        return [p for query in self.queries for p in query.recentProgress]


MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_EDGES = "queryid {key}, batch long, seen timestamp, at long, tie long, last string"


def stream_counter_deltas(
    stream: DataFrame, checkpoint: str, root: str, deltas: Callable[[DataFrame], DataFrame], once: bool = True, forget_days: int = 90, buckets: int = 512
) -> Chain:
    """Counter growth across batches, in two queries.

    The first stores each batch and, reduced before it is shuffled, the newest snapshot per statement in it. Only
    these rows, one per statement and batch, reach the second query, whose keyed state is the newest snapshot of each
    statement, kept in ``buckets`` of statements by hash, as a call per statement costs more than its row: it gives what the statement stood at before the batch, and forgets statements not seen for
    ``forget_days`` of event time. With that row in front the batch operator runs over the stored batch, so a busy statement is cut
    by day there and never sits in one task. Snapshots not after the state of their statement are late: what grew until
    then is in a later delta already, so they go to ``late`` and nowhere else, as do those without a statement or
    more than ``forget_days`` behind all others.
    """
    rows_at, edges_at, marks_at, out, late = (f"{root}/{n}" for n in ("rows", "edges", "marks", "deltas", "late"))
    schema = stream.schema
    key = schema["queryid"].dataType.simpleString()
    spark = stream.sparkSession

    def split(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(rows_at, number))
        stored = spark.read.schema(schema).parquet(_batch_folder(rows_at, number))
        newest = F.max_by(F.struct(*schema.names), F.struct("seen_at", "snapshot_id")).alias("r")
        tails = stored.where("queryid IS NOT NULL").groupBy("queryid").agg(newest)
        tails.select(
            "queryid",
            F.lit(number).cast("long").alias("batch"),
            F.col("r.seen_at").cast("timestamp").alias("seen"),
            F.unix_micros(F.col("r.seen_at").cast("timestamp")).alias("at"),
            F.col("r.snapshot_id").cast("long").alias("tie"),
            F.to_json("r", MICROS).alias("last"),
        ).write.mode("overwrite").parquet(_batch_folder(edges_at, number))

    def carry(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        fresh, found = set(), []
        if not state.hasTimedOut:
            columns = ("queryid", "batch", "at", "tie", "last")
            rows = [r for f in frames for r in zip(*(f[c].tolist() for c in columns))]
            for queryid, batch, at, tie, last in sorted(rows, key=lambda r: r[1]):
                name = str(queryid)
                before = held.get(name)
                found.append((queryid, batch, before[2] if before else None))
                fresh.add(name)
                if before is None or (at, tie) > (before[0], before[1]):
                    held[name] = (at, tie, last)
        now = state.getCurrentWatermarkMs()
        held = {n: h for n, h in held.items() if n in fresh or h[0] // 1000 + 1 >= now}
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(h[0] for h in held.values()) // 1000, now) + 1)
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["queryid", "batch", "before"])

    def grow(marks: DataFrame, number: int) -> None:
        at = _batch_folder(marks_at, number)
        marks.write.mode("overwrite").parquet(at)
        kept = spark.read.schema(f"queryid {key}, batch long, before string").parquet(at)
        for batch in sorted(r[0] for r in kept.select("batch").distinct().collect()):
            rows = spark.read.schema(schema).parquet(_batch_folder(rows_at, batch))
            last = kept.where((F.col("batch") == batch) & F.col("before").isNotNull()).select(F.from_json("before", schema, MICROS).alias("b")).select("b.*")
            mark = last.select("queryid", F.struct("seen_at", "snapshot_id").alias("_mark"))
            known = kept.where(F.col("batch") == batch).select("queryid", F.lit(True).alias("_known"))
            placed = rows.join(known, "queryid", "left").join(mark, "queryid", "left")
            behind = F.col("_known").isNull() | F.coalesce(F.struct("seen_at", "snapshot_id") <= F.col("_mark"), F.lit(False))
            placed.where(behind).select(schema.names).write.mode("overwrite").parquet(_batch_folder(late, batch))
            grown = deltas(placed.where(~behind).select(schema.names).unionByName(last))
            shown = last.select("queryid", "snapshot_id")
            grown.join(shown, ["queryid", "snapshot_id"], "left_anti").write.mode("overwrite").parquet(_batch_folder(out, batch))

    first = _start(stream, f"{checkpoint}/rows", split, once)
    if once:
        first.awaitTermination()
    edges = spark.readStream.schema(_EDGES.format(key=key)).parquet(f"{edges_at}/batch=*" if _names(spark, edges_at) else edges_at)
    placed = edges.withColumn("bucket", F.pmod(F.xxhash64("queryid"), F.lit(buckets)))
    carried = placed.withWatermark("seen", f"{forget_days} days").groupBy("bucket").applyInPandasWithState(
        carry, f"queryid {key}, batch long, before string", "held string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return Chain([first, _start(carried, f"{checkpoint}/state", grow, once)])


# Windows ---------------------------------------------------------------------------------

SKETCH_BITS = 14
"""Distinct users are estimated from sketches of 2^14 registers: exact for few, standard error 0.6 % for many."""


def hourly_dashboard(events: DataFrame, product: DataFrame) -> DataFrame:
    """All figures of ``real_time_dashboard`` per closed hour, late rows up to the watermark counted.

    Three aggregates follow each other: per hour and product page, per hour and category (the product table is
    joined in between), per hour. Sums add up, sketches of users merge, and the best entry is a greatest struct.
    """
    kind, hour = F.col("event_type"), "1 hour"
    users = {"users": F.lit(True), "visitors": kind == "page_view", "buyers": kind == "purchase", "carts": kind == "add_to_cart"}
    page = F.window("event_timestamp", hour).alias("w"), marts.product_of_url(F.col("page_url")).alias("p")
    by_page = events.withWatermark("event_timestamp", WATERMARK).groupBy(*page).agg(
        F.count_if(kind == "purchase").alias("orders"),
        F.sum(F.when(kind == "purchase", F.col("value"))).alias("revenue"),
        F.count_if(kind == "page_view").alias("views"),
        F.sum("value").alias("v"),
        *[F.hll_sketch_agg(F.when(who, F.col("user_id")), SKETCH_BITS).alias(n) for n, who in users.items()],
    )
    kinds = product.select(F.col("product_id").cast("long").alias("p"), "category_name", F.lit(True).alias("known"))

    def merged() -> list[Column]:
        return [*[F.sum(c).alias(c) for c in ("orders", "revenue", "views")], *[F.hll_union_agg(n).alias(n) for n in users]]

    def again(df: DataFrame) -> Column:
        return F.window(F.window_time("w"), hour).alias("w")

    joined = by_page.join(kinds, "p", "left")
    by_category = joined.groupBy(again(joined), "category_name", "known").agg(
        *merged(),
        F.max(F.when(F.col("p").isNotNull(), F.struct("v", "p"))).alias("b"),
        F.sum(F.when(F.col("known"), F.col("v"))).alias("kv"),
    )
    by_hour = by_category.groupBy(again(by_category)).agg(
        *merged(), F.max("b").alias("b"), F.max(F.when(F.col("known"), F.struct(F.col("kv").alias("v"), "category_name"))).alias("k")
    )
    count = lambda n: F.hll_sketch_estimate(n)
    return marts.dashboard_figures(
        by_hour.select(
            F.col("w.start").alias("_h"),
            F.col("orders").alias("orders_today"),
            money(F.coalesce("revenue", F.lit(0)), 18).alias("revenue_today"),
            count("users").alias("active_users"),
            F.col("views").alias("page_views"),
            count("visitors").alias("unique_visitors"),
            count("buyers").alias("_buyers"),
            count("carts").alias("_carts"),
            "b",
            "k",
        )
    )


def web_sessions(events: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Visits of a user, closed after a quiet gap."""
    spans = events.withWatermark("event_timestamp", WATERMARK).groupBy(
        F.session_window("event_timestamp", gap).alias("w"), "user_id"
    )
    ended = F.max("event_timestamp")
    return spans.agg(F.min("event_timestamp").alias("start_time"), ended.alias("end_time"), F.count("*").alias("event_count")).select(
        "user_id",
        "start_time",
        "end_time",
        F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).cast("int").alias("duration_seconds"),
        "event_count",
    )


def sustained(metrics: DataFrame, rules=SUSTAINED_RULES, slide: str = "1 minute") -> DataFrame:
    """Closed windows in which every sample breaks a rule, for rules of one length; equals ``sustained_alerts`` on them.

    Samples become extremes per host, metric and minute first, so the windows behind see at most one row a minute.
    The rules are a static table joined to those.
    """
    lengths = {r[4] for r in rules}
    if len(lengths) != 1:
        raise ValueError("rules of one length share a stream, others have their own (stream_sustained)")
    spark, length = metrics.sparkSession, lengths.pop()
    table = spark.createDataFrame(list(rules), "rule string, metric string, op string, threshold double, minutes int, severity string")
    minutes = (
        metrics.where(F.col("metric").isin(sorted({metric for _, metric, *_ in rules})))
        .withWatermark("observed_at", WATERMARK)
        .groupBy("host", "metric", F.window("observed_at", "1 minute").alias("m"))
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    )
    met = minutes.join(F.broadcast(table), "metric")
    spans = met.groupBy("rule", "severity", "op", "threshold", "host", F.window(F.window_time("m"), f"{length} minutes", slide).alias("w")).agg(
        F.min("low").alias("lowest"), F.max("high").alias("highest"), F.sum("n").alias("samples")
    )
    breach = F.when(F.col("op") == ">", F.col("lowest") > F.col("threshold")).otherwise(F.col("highest") < F.col("threshold"))
    return spans.where(breach).select(
        "rule",
        "severity",
        "host",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "samples",
    )


def stream_sustained(metrics: DataFrame, checkpoint: str, root: str, rules=SUSTAINED_RULES, once: bool = True) -> Chain:
    """All rules: one query per length of window, each with its rules, into a folder of its own below ``root``."""
    queries = []
    for length in sorted({r[4] for r in rules}):
        mine = [r for r in rules if r[4] == length]
        queries.append(append_files(sustained(metrics, mine), f"{checkpoint}/minutes={length}", f"{root}/minutes={length}", once))
    return Chain(queries)


def append_files(df: DataFrame, checkpoint: str, path: str, once: bool = True) -> StreamingQuery:
    """Finished windows as Parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


# Incidents -------------------------------------------------------------------------------

BUCKETS = 16


def _newest_parts(spark: SparkSession, root: str, before: int, names: Sequence[str] | None = None) -> list[str]:
    """For each bucket folder (or the named ones) its version of the newest batch before ``before``."""
    paths = []
    for bucket in names if names is not None else _names(spark, root):
        held = [b for b in _batches(spark, f"{root}/{bucket}") if b < before]
        if held:
            paths.append(f"{root}/{bucket}/batch={max(held)}")
    return paths


def _drop_old_parts(spark: SparkSession, root: str, names: Sequence[str], before: int) -> None:
    """Versions of these buckets that no replay of batch ``before`` can need any more."""
    for bucket in names:
        for old in [b for b in _batches(spark, f"{root}/{bucket}") if b < before][:-1]:
            fs, target = _fs(spark, f"{root}/{bucket}/batch={old}")
            fs.delete(target, True)


def stream_incidents(alerts: DataFrame, checkpoint: str, root: str, existing: DataFrame, run_ts, once: bool = True) -> StreamingQuery:
    """Incidents after each batch of alert changes, one version of the small incident table per batch.

    A batch says what changed, not what is all: the newest row of every alert is kept as state, an alert
    is over with a row of status ``resolved``, and only then can its incident be. State is stored in buckets of an
    alert type and the hash of the alert: a batch reads and writes only buckets that its alerts are in, and incidents
    are made anew only for its types, from one summary row a bucket.
    """
    states, summaries, table = f"{root}/alerts", f"{root}/summaries", f"{root}/incidents"
    schema = T.StructType([*alerts.schema.fields, T.StructField("bucket", T.StringType())])

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spot = F.pmod(F.xxhash64("alert_id"), F.lit(BUCKETS)).cast("string")
        placed = batch.withColumn("bucket", F.concat_ws("-", F.md5(F.coalesce("type", F.lit(""))), spot))
        names = [f"bucket={r[0]}" for r in placed.select("bucket").distinct().collect()]  # BUCKETS a type at most
        before = _newest_parts(spark, states, number, names)
        rows = placed
        if before:
            stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
            rows = spark.read.schema(stored).option("basePath", states).parquet(*before).drop("batch").unionByName(placed)
        newest = F.max_by(F.struct(*alerts.columns), F.struct("occurred_at", F.col("status") == "resolved")).alias("r")
        kept = rows.groupBy("alert_id", "bucket").agg(newest).select("r.*", "bucket").withColumn("batch", F.lit(number))
        kept.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(states)
        fresh = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", states).parquet(*[f"{states}/{n}/batch={number}" for n in names])
        sums = alert_sums(fresh.where("status <> 'resolved'"), ["bucket", "type"])
        # a bucket without an active alert has a row too, which takes the place of its last one
        sums = fresh.select("bucket").distinct().join(sums, "bucket", "left").withColumn("batch", F.lit(number))
        sums.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(summaries)
        types = {n.removeprefix("bucket=").split("-")[0] for n in names}
        touched = [n for n in _names(spark, summaries) if n.removeprefix("bucket=").split("-")[0] in types]
        parts = spark.read.option("basePath", summaries).parquet(*_newest_parts(spark, summaries, number + 1, touched))
        last = max((b for b in _batches(spark, table) if b < number), default=None)
        known = existing if last is None else spark.read.schema(existing.schema).parquet(_batch_folder(table, last))
        # of the types of this batch all alerts are summed up; incidents of other types stay as they are
        mine = F.md5(F.coalesce("alert_type", F.lit(""))).isin(sorted(types))
        changed = sync_incidents(known.where(mine), incident_rows(merged_sums(parts)), run_ts)
        changed.unionByName(known.where(~mine)).select(existing.columns).write.mode("overwrite").parquet(_batch_folder(table, number))
        _drop_old_parts(spark, states, names, number)
        _drop_old_parts(spark, summaries, names, number)

    return _start(alerts, checkpoint, each, once)


def latest_incidents(spark: SparkSession, root: str) -> DataFrame:
    table = f"{root}/incidents"
    return spark.read.parquet(_batch_folder(table, max(_batches(spark, table))))
