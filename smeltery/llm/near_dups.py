"""Near-duplicate groups from SetSketch registers.

Every element of a set sends a stream of exponentially spaced points to random registers; a register
keeps the smallest, on a logarithmic scale of 16 bits. Registers merge by their maximum, and two sets
agree in a register with about their Jaccard similarity. A point beyond a limit chosen from the set's
size can hardly matter, so streams are cut there; a set that still has an empty register is done again
with twice the limit, which makes the result depend on the set alone.

Linking takes these steps:

1. Documents with the same set are one class; classes go on by their smallest key.
2. Bands of register values give buckets. In each bucket every class meets one pivot, a different one in
   every band, never all the others. Pairs are estimated by the likelihood of their registers and then
   verified on full sets.
3. Links give components. Where a bucket still holds several, members stay that share one of their rarest
   shingles with another component (two sets over the threshold share at least one; pages that only have a
   template in common share none). Those outside the bucket's largest component then meet all of other
   components, in blocks, on full sets. No pair that shares a bucket and is not joined already is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from smeltery.llm.folders import stored
from smeltery.llm.graph import components
from smeltery.llm.substrings import squeezed, unsqueezed
from smeltery.llm.text import CHUNK_BYTES, NOT_SPACE, UPPER, Spans, chunks, mix, shingle_sets, table_of, word_hashes, word_spans

BLOCK = 256
SAMPLE, COMMON = 20_000, 100_000
"""Texts looked at for common shingles, and how many of these are told apart: under 2 MB for every task."""


@dataclass(frozen=True)
class Plan:
    """Sketch size from the threshold: a pair at it is missed by all bands with probability ``miss``."""

    percent: int = 80
    shingle: int = 5
    rows: int = 5
    miss: float = 1e-8
    base: float = 1.001
    rate: float = 20.0

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        """Six standard deviations under the threshold."""
        t = self.percent / 100
        return t - 6 * math.sqrt(t * (1 - t) / self.registers)


def set_sketch(values: np.ndarray, border: np.ndarray, plan: Plan) -> np.ndarray:
    """Registers of every set, one row each; those of an empty set are 0."""
    m, texts = plan.registers, len(border) - 1
    least = np.full(texts * m, np.inf)
    sizes = np.diff(border)
    todo, slack = np.flatnonzero(sizes), math.log(m) + 3.0
    while len(todo):
        count = sizes[todo]
        of = np.repeat(todo, count)
        v = values[np.repeat(border[todo] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        limit = slack / sizes[of]
        x = np.zeros(len(v))
        turn = 0
        while len(v):
            turn = (turn + 0xA0761D6478BD642F) % (1 << 64)
            h = mix(v + np.uint64(turn))
            x = x - np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / m
            stay = x <= limit
            v, x, of, limit, h = v[stay], x[stay], of[stay], limit[stay], h[stay]
            register = (mix(h ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(least, of * m + register, x)
        todo = todo[np.isinf(least.reshape(texts, m)[todo]).any(axis=1)]
        slack *= 2
    least = least.reshape(texts, m)
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least / plan.rate) / math.log(plan.base))
    return np.where(np.isinf(least), 0, np.clip(k, 0, 65535)).astype("<u2")


def likely_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float) -> np.ndarray:
    """Jaccard similarity of largest likelihood for pairs of register rows and known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    j = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u) * (1 - 1e-9)

    def p(x):
        return -np.log1p(-x * (base - 1) / base) / math.log(base)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    likelihood = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), np.argmax(likelihood, axis=1)]


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = UPPER[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return shingle_sets(word_hashes(data, starts, ends), first, size)


def _sets_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return _sets(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, size)


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """k, t -> k, s1, s2 (128 bits of the set), n (its size), registers."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "t", 2 * CHUNK_BYTES):
            values, border = _sets(data, offsets, plan.shingle)
            s1 = Spans(values).hashes(border[:-1], border[1:]).view(np.int64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x1D8E4E27C47D124F)))))
            s2 = (sums[border[1:]] - sums[border[:-1]]).view(np.int64)
            registers = pa.array([r.tobytes() for r in set_sketch(values, border, plan)], pa.binary())
            yield table_of(batch, ["k"], pa.array(s1), pa.array(s2), pa.array(np.diff(border)), registers, more_names=("s1", "s2", "n", "registers"))

    return docs.select("k", "t").mapInArrow(run, f"k {kind}, s1 bigint, s2 bigint, n bigint, registers binary")


def _close(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (size_a + size_b - inter)


def verified(pairs: DataFrame, plan: Plan) -> DataFrame:
    """a, b of those pairs (a, b, za, zb, ra, rb, na, nb) that hold on full sets."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, plan.registers) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
                likely = np.flatnonzero(likely_jaccard(ra, rb, na, nb, plan.base) >= plan.least_estimate)
                batch = batch.take(pa.array(likely))
                texts = [unpack.decompress(z) for pair in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist()) for z in pair]
                if not texts:
                    continue
                values, border = _sets_of(texts, plan.shingle)
                held = []
                for i in range(batch.num_rows):
                    x, y = values[border[2 * i] : border[2 * i + 1]], values[border[2 * i + 1] : border[2 * i + 2]]
                    held.append(bool(_close(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), plan.percent)))
                yield table_of(batch.filter(pa.array(held)), ["a", "b"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def intersections(values: np.ndarray, border: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, columns in bounded blocks."""
    out = np.zeros((len(left), len(right)))

    def taken(rows):
        count = np.diff(border)[rows]
        return values[np.repeat(border[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], np.repeat(np.arange(len(rows)), count)

    (lv, lr), (rv, rr) = taken(left), taken(right)
    shared = np.intersect1d(lv, rv)
    for at in range(0, len(shared), 4096):
        columns = shared[at : at + 4096]
        sides = []
        for v, r, n in ((lv, lr, len(left)), (rv, rr, len(right))):
            place = np.minimum(np.searchsorted(columns, v), len(columns) - 1)
            hit = columns[place] == v
            matrix = np.zeros((n, len(columns)), dtype=np.float32)
            matrix[r[hit], place[hit]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def near_groups(docs: DataFrame, percent: int = 80, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: one row per document.

    A-Z is lower-cased, words are runs without ASCII white space, a set is the distinct ``shingle``-word
    sequences (all words as one where there are fewer). Documents are linked with
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest key reachable; ``kept`` marks
    that document. Null and empty texts have an empty set and are linked with nothing. A row with a null
    key is linked with nothing, has a null component and is kept. Rows that repeat a key are one document
    where their texts are equal; they have the same component in any case.
    """
    plan = Plan(percent=percent, shingle=shingle)
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    drawn = stored(sketches(plain, plan), "sketches")
    classes = stored(drawn.where("n > 0 AND k IS NOT NULL").groupBy("s1", "s2").agg(F.min("k").alias("c")), "classes")
    nodes = stored(
        classes.withColumnsRenamed({"s1": "c1", "s2": "c2"}).join(drawn, (F.col("c") == F.col("k")) & (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2"))).select("c", "n", "registers"),
        "classes",
    )
    width = 2 * plan.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(plan.bands)])
    members = nodes.select("c", "n", F.explode(bands).alias("bucket"))
    buckets = stored(
        members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("c", "bucket").alias("by"), "c", "n")).alias("pivot")).where("size > 1").select("bucket", "size", F.col("pivot.c").alias("p"), F.col("pivot.n").alias("pn")),
        "buckets",
    )
    met = stored(members.join(buckets, "bucket"), "bucket-members")
    near = F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")
    pairs = stored(met.where("c != p").where(near).select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct(), "pairs")
    texts = squeezed(plain.where("k IS NOT NULL"), "t").withColumnsRenamed({"k": "c", "t": "z"})
    active = stored(nodes.join(met.select("c").distinct(), "c").join(texts, "c").select("c", "n", "registers", "z"), "active")
    left = active.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"), F.col("z").alias("za"))
    right = active.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"), F.col("z").alias("zb"))
    links = stored(verified(pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb", "ra", "rb", "na", "nb"), plan), "links")
    joined = stored(components(links), "components")
    rest = stored(_rest(met, active, joined, plan), "links")
    over = components(rest)
    root = joined.join(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    alone = over.join(joined.select("node"), "node", "left_anti")
    found = stored(root.unionByName(alone), "components")
    placed = stored(classes.join(found, F.col("c") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "c").alias("component_id")), "classes")
    out = drawn.select("k", "s1", "s2", "n").join(placed, ["s1", "s2"], "left")
    component = F.when(F.col("k").isNull(), F.col("k")).otherwise(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def common_shingles(members: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that stand in several of a bounded sample of texts, rarest first; only speed depends on the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(unsqueezed(batches, "z"), "z"):
            known, counts = np.unique(_sets(data, offsets, shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(counts)], names=["e", "many"])

    sample = members.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("z")
    counted = sample.mapInArrow(run, "e bigint, many bigint").groupBy("e").agg(F.sum("many").alias("many")).where("many > 1")
    rows = counted.orderBy(F.desc("many"), "e").limit(COMMON).collect()
    return np.array([r.e for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def prefixes(members: DataFrame, common: np.ndarray, plan: Plan) -> DataFrame:
    """c, g, z -> c, g, e: the rarest shingles of every set, as many as two sets over the
    threshold cannot both do without. Sets that reach it share one of them, whatever the order of shingles is."""
    kinds = dict(members.dtypes)
    place = np.argsort(common, kind="stable")
    known = common[place]
    shared = members.sparkSession.sparkContext.broadcast((known, place.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = shared.value
        for batch, data, offsets in chunks(unsqueezed(batches, "z"), "z"):
            values, border = _sets(data, offsets, plan.shingle)
            sizes = np.diff(border)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(values), -1, dtype=np.int64)  # unknown ones are the rarest
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                rank = np.where(hashes[at] == values, order[at], -1)
            sort = np.lexsort((values, rank, owner))
            position = np.arange(len(values)) - border[:-1][owner]
            keep = position < (sizes - -(-plan.percent * sizes // 100) + 1)[owner]
            row = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([batch.column("c").take(row), batch.column("g").take(row), pa.array(values[sort][keep].view(np.int64))], names=["c", "g", "e"])

    return members.select("c", "g", "z").mapInArrow(run, f"c {kinds['c']}, g {kinds['g']}, e bigint")


def _rest(met: DataFrame, active: DataFrame, joined: DataFrame, plan: Plan) -> DataFrame:
    """Links between components (a, b) that share a bucket but met no common pivot.

    Members of buckets that still hold several components first show their rarest shingles: one that shares none of
    them with another component has no link, as with pages that only have a template in common, and leaves. In what
    is left of a bucket the members outside its largest component meet those of other components, in blocks, on
    full sets.
    """
    placed = met.where("size > 2").join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("bucket", "c", F.coalesce("component", "c").alias("g"))
    several = placed.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("bucket")
    members = stored(placed.join(several, "bucket", "left_semi").select("c", "g").distinct().join(active.select("c", "z"), "c"), "rest-members")
    rare = stored(prefixes(members, common_shingles(members, plan.shingle), plan), "rest-prefixes")
    shared = rare.groupBy("e").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("e")
    linked = stored(rare.join(shared, "e", "left_semi").select("c").distinct(), "rest-linked")
    placed = stored(placed.join(linked, "c", "left_semi"), "rest-placed")
    sizes = placed.groupBy("bucket", "g").agg(F.count("*").alias("many"))
    mixed = stored(
        sizes.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("many").alias("all"), F.max(F.struct("many", "g")).alias("top")).where("groups > 1").select("bucket", F.col("all"), F.col("top.many").alias("top_many"), F.col("top.g").alias("top")),
        "mixed-buckets",
    )
    rows = stored(placed.join(mixed, "bucket").join(active.select("c", "n", "z"), "c"), "bucket-rest")
    blocks_all = F.ceil(F.col("all") / BLOCK).cast("int")
    blocks_rest = F.ceil((F.col("all") - F.col("top_many")) / BLOCK).cast("int")
    spot = F.xxhash64("c")
    asks = rows.where("g != top").select("bucket", "c", "g", "n", "z", F.pmod(spot, blocks_rest).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks_all - 1)).alias("j"), F.lit(True).alias("ask"))
    gives = rows.select("bucket", "c", "g", "n", "z", F.explode(F.sequence(F.lit(0), blocks_rest - 1)).alias("i"), F.pmod(spot, blocks_all).cast("int").alias("j"), F.lit(False).alias("ask"))
    kind = dict(rows.dtypes)["g"]
    percent, shingle = plan.percent, plan.shingle

    def run(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        values, border = _sets_of([unpack.decompress(z) for z in group.column("z").to_pylist()], shingle)
        size, names = np.diff(border), group.column("g").to_pylist()
        codes = {name: i for i, name in enumerate(dict.fromkeys(names))}
        g, ask = np.array([codes[name] for name in names]), np.array(group.column("ask").to_pylist())
        left, right = np.flatnonzero(ask), np.flatnonzero(~ask)
        pairs: set[tuple] = set()
        if len(left) and len(right):
            hit = _close(intersections(values, border, left, right), size[left][:, None], size[right][None, :], percent) & (g[left][:, None] != g[right][None, :])
            pairs = {(names[left[x]], names[right[y]]) for x, y in zip(*np.nonzero(hit))}
        one = group.schema.field("g").type
        return pa.table({"a": pa.array([x for x, _ in pairs], one), "b": pa.array([y for _, y in pairs], one)})

    return asks.unionByName(gives).groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")
