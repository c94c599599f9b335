"""Density-based clusters (DBSCAN) over a grid, without meeting all points of a dense place with each other.

Space is cut into cells of side eps / sqrt(d): any two points of a cell are within eps, so a cell of
``min_samples`` points is core as a whole and its points need no comparison among themselves. Only points of
cells with fewer points look at neighbouring cells. Core cells are linked by few representatives first; pairs of
cells that are still in different components compare the points near their common border, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from smeltery.functions.components import connected
from smeltery.functions.ordered import ordered_index
from smeltery.session import durable

MOST_DIMENSIONS = 6
REPRESENTATIVES = 16
BLOCK = 2048


def _distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _to_box2(v: Column, cell: Column, side: float) -> Column:
    """Squared distance of a point to the box of a cell."""
    low = lambda c: c.cast("double") * side
    gap = F.zip_with(v, cell, lambda x, c: F.greatest(F.lit(0.0), low(c) - x, x - (low(c) + side)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def dbscan(points: DataFrame, inputs: Sequence[str], eps: float, min_samples: int = 5, key: str = "id") -> DataFrame:
    """key, cluster, is_core for every row; noise is -1, other clusters are numbered from 0 by their smallest core key.

    A point is core with ``min_samples`` rows, itself included, within ``eps``; clusters are core points that reach each
    other in steps of at most ``eps``; another point joins the cluster of the nearest core point within ``eps`` (of
    equally near ones, the cluster with the smallest core key). Keys are unique. Rows with a null or non-finite input are
    noise. Rows at the same place are one point with a weight, so copies cost nothing.
    """
    d = len(inputs)
    if not 0 < d <= MOST_DIMENSIONS:
        raise ValueError(f"1 to {MOST_DIMENSIONS} inputs, reduce them first")
    if eps <= 0:
        raise ValueError("eps must be positive")
    side, reach = eps / math.sqrt(d), math.ceil(math.sqrt(d))
    values = [F.col(c).cast("double") for c in inputs]
    fine = F.lit(True)
    for v in values:
        fine = fine & v.isNotNull() & (F.abs(v) < F.lit(float("inf")))
    rows = points.select(F.col(key).alias("id"), F.when(fine, F.array(*[v + F.lit(0.0) for v in values])).alias("v"))
    spots = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("w"), F.min("id").alias("p"))
    cell = F.transform("v", lambda x: F.floor(x / side))
    spots = durable(spots.select("p", "v", "w", cell.alias("cell")))
    cells = durable(spots.groupBy("cell").agg(F.sum("w").alias("n"), F.min("p").alias("c")))
    near = _neighbours(cells, d, reach)

    # core points: all of a full cell, and others by counting
    full = cells.where(F.col("n") >= min_samples).select("cell")
    inside = spots.join(full, "cell", "left_semi").select("p", "v", "cell")
    loose = durable(spots.join(full, "cell", "left_anti").join(cells.select("cell", "n"), "cell"))
    others = spots.select(F.col("cell").alias("other"), F.col("v").alias("ov"), "w")
    met = loose.select("p", "v", "cell", "n").join(near, "cell").join(others, "other")
    counted = met.where(_distance2(F.col("v"), F.col("ov")) <= eps * eps).groupBy("p").agg(F.sum("w").alias("more"))
    loose = durable(loose.drop("w").join(counted, "p", "left").withColumn("core", F.col("n") + F.coalesce("more", F.lit(0)) >= min_samples))
    core = durable(inside.unionByName(loose.where("core").select("p", "v", "cell")))

    # clusters: components of cells with core points
    core_cells = durable(core.groupBy("cell").agg(F.min("p").alias("node")))
    names = core_cells.select(F.col("cell").alias("other"), F.col("node").alias("b"))
    pairs = durable(core_cells.withColumnRenamed("node", "a").join(near, "cell").join(names, "other").where("a < b").select("cell", "other", "a", "b"))
    few = _representatives(core)
    close = F.exists("few", lambda x: F.exists("ofew", lambda y: _distance2(x, y) <= eps * eps))
    quick = pairs.join(few, "cell").join(few.withColumnsRenamed({"cell": "other", "few": "ofew"}), "other").where(close).select("a", "b")
    first = durable(connected(core_cells.select("node"), quick))
    at = first.withColumnRenamed("component", "k")
    left = pairs.join(at.withColumnsRenamed({"node": "a", "k": "ka"}), "a").join(at.withColumnsRenamed({"node": "b", "k": "kb"}), "b").where("ka <> kb")
    links = _border_links(durable(left.select("cell", "other", "ka", "kb")), core, eps, side)
    joined_up = connected(first.select(F.col("component").alias("node")), links)
    second = joined_up.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    clusters = durable(core_cells.join(first, "node").join(second, "component").select("cell", "cluster"))

    # the other points, by their nearest core point
    of_core = core.join(clusters, "cell")
    candidates = of_core.select(F.col("cell").alias("other"), F.col("v").alias("ov"), "cluster")
    edge = loose.where("NOT core").select("p", "v", "cell")
    with_own = near.unionByName(cells.select("cell", F.col("cell").alias("other")))
    reached = edge.join(with_own, "cell").join(candidates, "other").withColumn("d2", _distance2(F.col("v"), F.col("ov"))).where(F.col("d2") <= eps * eps)
    joined = reached.groupBy("p").agg(F.min(F.struct("d2", "cluster")).alias("best")).select("p", F.col("best.cluster").alias("cluster"))
    labels = of_core.select("p", "cluster", F.lit(True).alias("is_core")).unionByName(joined.withColumn("is_core", F.lit(False)))
    placed = durable(spots.select("p", "v").join(labels, "p"))
    of_rows = durable(rows.join(placed, "v", "left").select("id", "cluster", "is_core"))
    order = of_rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.when(F.col("is_core"), F.col("id"))).alias("first"))
    numbered = _numbered(order)
    out = of_rows.join(numbered, "cluster", "left")
    return out.select(F.col("id").alias(key), F.coalesce("number", F.lit(-1)).cast("int").alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def _moved(cell: str, dimension: int) -> Column:
    return F.transform(cell, lambda c, at: F.when(at == dimension, c + F.col("step")).otherwise(c))


def _neighbours(cells: DataFrame, d: int, reach: int) -> DataFrame:
    """cell, other: occupied cells whose boxes may hold points within eps of each other, met by coarse cells."""
    coarse = F.transform("cell", lambda c: F.floor(c / reach))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = cells.select("cell", coarse.alias("coarse"))
    ring = spread
    for i in range(d):
        ring = ring.withColumn("step", F.explode(steps)).withColumn("coarse", _moved("coarse", i)).drop("step")
    met = ring.join(spread.withColumnRenamed("cell", "other"), "coarse").where("cell <> other")
    gap = F.zip_with("cell", "other", lambda a, b: F.greatest(F.lit(0), F.abs(a - b) - 1))
    close = F.aggregate(gap, F.lit(0).cast("long"), lambda s, x: s + x * x) <= d
    return durable(met.where(close).select("cell", "other"))


def _representatives(core: DataFrame) -> DataFrame:
    """cell, few: up to ``REPRESENTATIVES`` core points of every cell, one of each hash class."""
    classes = core.groupBy("cell", F.pmod(F.xxhash64("p"), F.lit(REPRESENTATIVES)).alias("h")).agg(F.min_by("v", "p").alias("v"))
    return classes.groupBy("cell").agg(F.collect_list("v").alias("few"))


def _border_links(pairs: DataFrame, core: DataFrame, eps: float, side: float) -> DataFrame:
    """a, b: components that the given pairs of cells link, from their core points near the other cell, block by block."""
    spot = F.xxhash64("p")
    sides = []
    for mine, theirs, first in (("cell", "other", True), ("other", "cell", False)):
        points = core.select(F.col("cell").alias(mine), "p", "v")
        held = pairs.join(points, mine).where(_to_box2(F.col("v"), F.col(theirs), side) <= eps * eps * (1 + 1e-9))
        sides.append(held.select("cell", "other", "ka", "kb", "p", "v", F.lit(first).alias("first")))
    both = durable(sides[0].unionByName(sides[1]))
    sizes = both.groupBy("cell", "other").agg(F.ceil(F.count_if(F.col("first")) / BLOCK).cast("int").alias("m"), F.ceil(F.count_if(~F.col("first")) / BLOCK).cast("int").alias("n")).where("m > 0 AND n > 0")
    sized = both.join(sizes, ["cell", "other"])
    one = sized.where("first").select("*", F.pmod(spot, "m").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    two = sized.where("NOT first").select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), F.pmod(spot, "n").cast("int").alias("j"))
    kind = dict(pairs.dtypes)["ka"]

    def compare(table: pa.Table) -> pa.Table:
        v = np.stack([np.asarray(x) for x in table.column("v").to_pylist()])
        first = np.array(table.column("first").to_pylist())
        left, right = v[first], v[~first]
        found = False
        for at in range(0, len(left), 256):
            gap = left[at : at + 256, None, :] - right[None, :, :]
            if ((gap * gap).sum(axis=2) <= eps * eps).any():
                found = True
                break
        return table.select(["ka", "kb"]).rename_columns(["a", "b"]).slice(0, 1 if found else 0)

    work = one.unionByName(two).select("cell", "other", "i", "j", "ka", "kb", "v", "first")
    return durable(work.groupBy("cell", "other", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}"))


def _numbered(order: DataFrame) -> DataFrame:
    """cluster, number: clusters by their smallest core key."""
    return ordered_index(order.select("cluster", "first"), ["first"], "number").select("cluster", "number")
