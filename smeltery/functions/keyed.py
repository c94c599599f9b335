"""Key-wise operators that stay whole and spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "_load_timestamp") -> DataFrame:
    """Newest row per key, NULL times last, ties settled by the remaining columns.

    One aggregate with map-side combine instead of a window, so a key with very many
    versions is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != ts]
    newest = F.max(F.struct(F.col(ts), *[F.col(c) for c in rest])).alias("_newest")
    picked = df.groupBy(*keys).agg(newest)
    return picked.select(*keys, "_newest.*").select(*df.columns)


def not_yet_in(df: DataFrame, existing: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks."""
    if existing is None:
        return df
    return df.join(existing.select(*on), list(on), "left_anti")


def only_in(df: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the parent has."""
    return df.join(parent.select(*on), list(on), "left_semi")


def previous_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` of each value per key, with the key's rows cut into ordered buckets.

    ``bucket`` must not fall while ``order`` rises. Each window holds one (key, bucket);
    the first row of a bucket takes the last row of the key's bucket before it, from a
    frame with one row per (key, bucket).
    """
    tagged = df.withColumn("_bucket", bucket)
    row = F.struct(*[F.col(c) for c in values])
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    lagged = tagged.withColumn("_lag", F.lag(row).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    tails = tagged.groupBy(*keys, "_bucket").agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    across = W.partitionBy(*keys).orderBy("_bucket")
    heads = tails.withColumn("_head", F.lag("_tail").over(across)).drop("_tail")
    joined = lagged.join(heads, [*keys, "_bucket"], "left")
    taken = F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_lag"))
    return joined.withColumn("_prev", taken).select(
        *df.columns, *[F.col("_prev")[c].alias(f"{prefix}{c}") for c in values]
    )


def count_missing(left: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Distinct non-NULL foreign keys the parent lacks."""
    return left.where(F.col(on).isNotNull()).select(on).distinct().join(parent.select(on), on, "left_anti")
