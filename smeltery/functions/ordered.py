"""Order-dependent operators over a whole frame, without drawing it into one task.

``ordered_index`` sorts by range partitioning, keeps the sorted rows durably, counts the
rows of every partition and adds the offsets. The other functions build on it or on
value histograms that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from smeltery.session import durable

_ROW_BITS = 33


def ordered_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Dense 0-based position in the given total order."""
    kept = durable(df.orderBy(*order))
    mark = F.monotonically_increasing_id()
    tagged = kept.withColumn("_mark", mark)
    tagged = tagged.withColumn("_part", F.shiftright("_mark", _ROW_BITS)).withColumn(
        "_row", F.col("_mark") - F.shiftleft("_part", _ROW_BITS)
    )
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition of the sorted frame: the window below is bounded by that count.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = tagged.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_row") + F.col("_offset")).select(*df.columns, name)


def position_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``row_number`` per key without a window over whole keys.

    A key with much of the data spans several sorted partitions: rows are numbered inside
    each (key, partition) and moved up by the key's rows in the partitions before it.
    """
    kept = durable(df.orderBy(*keys, *order))
    tagged = kept.withColumn("_mark", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_mark", _ROW_BITS))
    local = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_mark"))
    numbered = tagged.withColumn("_local", local)
    sizes = tagged.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    # One row per (key, partition) enters this window.
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    match = F.col("n._part") == F.col("o._part")
    for key in keys:
        match = match & F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}"))
    joined = numbered.alias("n").join(offsets.alias("o"), match)
    position = (F.col("_local") + F.col("_offset")).cast("int").alias(name)
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], position)


def with_surrogate_key(df: DataFrame, name: str, order: Sequence[str], start: int = 0) -> DataFrame:
    """Dense key ``start + 1 ...`` in the order of the natural key."""
    indexed = ordered_index(df, order, "_seq")
    return indexed.select((F.col("_seq") + F.lit(start + 1)).cast("long").alias(name), *df.columns)


def dense_rank_over(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """``dense_rank`` over the whole frame: positions of the distinct values, joined back."""
    column = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    levels = ordered_index(df.select(value).distinct(), [column], "_level")
    ranked = df.alias("d").join(levels.alias("l"), F.col(f"d.{value}").eqNullSafe(F.col(f"l.{value}")))
    return ranked.select("d.*", (F.col("_level") + 1).cast("int").alias(name))


def ntile_over(df: DataFrame, order: Sequence[Column], tiles: int, name: str) -> DataFrame:
    """``ntile`` over the whole frame from the dense position; the first tiles take the rest rows."""
    indexed = ordered_index(df, order, "_pos")
    total = indexed.agg(F.count("*").alias("n")).scalar()
    n = total.cast("long")
    small, extra = F.floor(n / tiles), n % tiles
    edge = extra * (small + 1)
    tile = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1)) + 1).otherwise(
        F.floor((F.col("_pos") - edge) / F.greatest(small, F.lit(1))) + extra + 1
    )
    return indexed.withColumn(name, tile.cast("int")).drop("_pos")


_HEAD_BITS = 12


def _bin_floor(unit: Column) -> Column:
    """Lowest value sharing the leading bits of a non-negative whole number; rises with it."""
    shift = F.greatest(F.lit(0), F.length(F.bin(unit)) - F.lit(_HEAD_BITS))
    return F.call_function("shiftleft", F.call_function("shiftright", unit, shift), shift)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column], scale: int = 3, weight: str | None = None
) -> DataFrame:
    """Exact k-th smallest values per key; with ``weight`` a row stands for so many equal values.

    ``ranks`` names an output and gives its 0-based rank as an expression over ``n``, the
    number of non-NULL values of the key. ``value`` must be non-negative with at most
    ``scale`` decimals. Values are counted per (key, value) first; a coarse histogram of
    leading bits finds the bin that holds each rank, and only that bin is ordered. No
    task ever sorts a whole key.
    """
    unit = F.round(F.col(value).cast(f"decimal(28,{scale})") * (10**scale), 0).cast("long")
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, unit.alias("_u"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"))
        .groupBy(*keys, "_u")
        .agg(F.sum("_w").alias("_c"))
        .withColumn("_bin", _bin_floor(F.col("_u")))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    # At most about 50 * 2**11 bins per key, whatever its number of rows.
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    bins = bins.withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
    wanted = F.array(
        *[F.struct(F.lit(name).alias("stat"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    targets = bins.select(
        *keys,
        "_bin",
        "_before",
        "n",
        F.filter(
            wanted,
            lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_before") + F.col("_c")),
        ).alias("_hits"),
    ).where(F.size("_hits") > 0)
    inside = counted.join(targets, [*keys, "_bin"])
    fine = W.partitionBy(*keys, "_bin").orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_c").over(fine), F.lit(0)))
    hit = inside.select(
        *keys,
        "n",
        "_u",
        F.explode(
            F.filter("_hits", lambda s: (s["rank"] >= F.col("_lo")) & (s["rank"] < F.col("_lo") + F.col("_c")))
        ).alias("_s"),
    )
    picked = [
        (F.max(F.when(F.col("_s.stat") == name, F.col("_u"))) / F.lit(10**scale)).cast("double").alias(name)
        for name in ranks
    ]
    return hit.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def percentiles_cont(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], scale: int = 3, weight: str | None = None
) -> DataFrame:
    """Interpolated percentiles per key, exact, from the two neighbouring order statistics."""
    n = F.col("n")
    ranks = {}
    for name, p in probs.items():
        spot = (n - 1) * F.lit(float(p))
        ranks[f"{name}__lo"] = F.floor(spot)
        ranks[f"{name}__hi"] = F.ceil(spot)
    stats = order_statistics(df, keys, value, ranks, scale, weight)
    out = []
    for name, p in probs.items():
        spot = (n - 1) * F.lit(float(p))
        low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return stats.select(*keys, *out)
