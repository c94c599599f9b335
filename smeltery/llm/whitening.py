"""Embedding whitening from the principal components of all distinct vectors.

Spark counts and sums: distinct integer vectors, their per-dimension sums, and partial products of the
centred vectors, one small matrix a partition. The covariance, dimension x dimension whatever the number
of rows, is then divided spectrally: the polar factor of ``V - shift`` (QDWH iterations) gives the
projector on the eigenvectors above the shift, an orthonormal basis of its range splits ``V`` into two
smaller blocks, and blocks are split again until single components are left. The mean and the wanted
components go to every task, which whitens its rows in one map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from smeltery.llm.folders import stored

SCALE, SHIFT = 64, 1_000_000
MOST_DIMENSIONS = 4096
"""The covariance is held by the driver: 128 MB at this dimension."""
EXACT = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums ``sums``; ``components`` in rows, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    n, eps = len(a), np.finfo(float).eps
    x = a / np.linalg.norm(a)
    low = eps
    for _ in range(50):
        d = (4 * (1 - low * low) / low**4) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
        following = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        following = (following + following.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved = np.linalg.norm(following - x)
        x = following
        if 1 - low < 10 * eps and moved < 1e-8:
            break
    return x


def range_basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal matrix whose first ``rank`` columns span the projector's range and the others its complement."""
    left, picked = projector.copy(), []
    for _ in range(rank):
        sizes = np.einsum("ij,ij->j", left, left)
        sizes[picked] = -1
        column = int(np.argmax(sizes))
        picked.append(column)
        unit = left[:, column] / np.linalg.norm(left[:, column])
        left -= np.outer(unit, unit @ left)
    q, _ = np.linalg.qr(projector[:, picked], mode="complete")
    for _ in range(2):
        q, _ = np.linalg.qr(projector @ q[:, :rank], mode="complete")
    return q


def divide(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix and their unit eigenvectors in rows, by falling value.

    Blocks that hold none of the wanted components are not divided any further. A block that no shift
    divides has equal eigenvalues to double precision; any basis of it is an answer.
    """
    negligible = 4 * len(a) * np.finfo(float).eps * np.linalg.norm(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    blocks = [(a, np.eye(len(a)))]  # the block of the largest eigenvalues is last
    while blocks and len(values) < want:
        block, basis = blocks.pop()
        n = len(block)
        mean = np.trace(block) / n
        if n == 1 or np.linalg.norm(block - mean * np.eye(n)) <= negligible:
            for i in range(n):
                values.append(float(block[i, i]))
                vectors.append(basis[:, i])
            continue
        best = None
        for shift in (float(np.median(np.diag(block))), mean, *(mean + s * np.linalg.norm(block - mean * np.eye(n)) / n for s in (0.37, -0.37))):
            projector = (polar_factor(block - shift * np.eye(n)) + np.eye(n)) / 2
            rank = int(round(np.trace(projector)))
            if not 0 < rank < n:
                continue
            q = range_basis(projector, rank)
            turned = q.T @ block @ q
            error = np.linalg.norm(turned[rank:, :rank])
            if best is None or error < best[0]:
                best = error, rank, q, turned
            if error <= negligible:
                break
        if best is None:
            raise ArithmeticError("no shift divides the block")
        _, rank, q, turned = best
        turned, basis = (turned + turned.T) / 2, basis @ q
        blocks.append((turned[rank:, rank:], basis[:, rank:]))
        blocks.append((turned[:rank, :rank], basis[:, :rank]))
    order = np.argsort(values, kind="stable")[::-1][:want]
    rows = np.array(vectors).reshape(-1, len(a))[order]
    return np.einsum("ij,jk,ik->i", rows, a, rows), rows


def whole_vectors(rows: DataFrame, vector: str) -> Column:
    """The vector in whole numbers, floor(64 c) + 1000000; null where it is null, empty, or holds null or non-finite entries."""
    at = F.col(vector)
    fine = F.forall(at, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.when((F.size(at) > 0) & fine, F.transform(at, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(SHIFT)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), -1)


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S without rounding: 64 bits where they are enough, else Python's numbers."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) + int(np.abs(sums).max()) >= EXACT:
        x, sums = x.astype(object), sums.astype(object)
    return n * x - sums


def _partial_products(fit: DataFrame, size: int, centred) -> np.ndarray:
    """Sum over the rows of the outer product of ``centred(x)``, one matrix a partition, added row by row of the matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                c = centred(_matrix(batch.column(0)))
                total += c.T @ c
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("part").combine_chunks().flatten().to_numpy().reshape(-1, size)
        rows = rows[np.lexsort(rows.T[::-1])]  # one order of adding, whatever order the parts come in
        return pa.table({"i": table.column("i")[:1], "part": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "i int, part array<double>"
    total = np.zeros((size, size))
    for row in fit.mapInArrow(products, schema).groupBy("i").applyInArrow(add, schema).collect():  # size rows
        total[row.i] = row.part
    return total


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Components of the distinct vectors; None where no row has a vector.

    Vectors of another length than the commonest (of equally common ones, the shortest) do not count.
    Components without spread to double precision are left out, so there may be fewer than asked for.
    """
    x = rows.select(whole_vectors(rows, vector).alias("x")).where("x IS NOT NULL")
    sizes = x.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "size").limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions, at most {MOST_DIMENSIONS} fit the driver")
    fit = stored(x.where(F.size("x") == size).distinct(), "whitening-fit")
    n = fit.count()
    summed = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.array([int(r.s) for r in sorted(summed, key=lambda r: r.i)], dtype=object)
    if max(map(abs, sums)) < EXACT:
        sums = sums.astype(np.int64)
    v = _partial_products(fit, size, lambda x: _apart(x, n, sums).astype(float) / n) / n
    trace = float(np.trace(v))
    values, vectors = divide(v, min(components, size)) if trace > 0 else (np.zeros(0), np.zeros((0, size)))
    spread = values > size * np.finfo(float).eps * trace
    values, vectors = values[spread], vectors[spread]
    error = 0.0
    if len(values):
        into = vectors.T / np.sqrt(values)
        identity = _partial_products(fit, len(values), lambda x: _apart(x, n, sums).astype(float) / n @ into) / n
        error = float(np.abs(identity - np.eye(len(values))).max())
    return Whitening(n, sums, vectors, values, values / trace if trace else values, error)


def whiten(rows: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows that have a vector of the model's length, with ``deviation`` decimal(38,0) and ``whitened`` array<double> added.

    deviation is the sum of (n*x - S)^2, exact; whitened has one entry a component. Every row is judged
    for itself, also with repeated or null keys; columns named ``deviation`` or ``whitened`` are replaced,
    all others stay. No model, or an empty table, gives no rows. What is sent to the tasks is
    components x dimensions doubles.
    """
    kept = rows.drop("deviation", "whitened")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", deviation decimal(38,0), whitened array<double>"
    if model is None:
        return kept.limit(0).select("*", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    n, sums, into = model.n, model.sums, model.components.T / np.sqrt(model.eigenvalues)
    names = kept.columns
    x = whole_vectors(kept, vector)
    framed = kept.select(F.struct("*").alias("row"), x.alias("x")).where(F.size("x") == len(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _apart(_matrix(batch.column(1)), n, sums)
            centred = apart.astype(float)
            if (centred * centred).sum(axis=1).max() >= EXACT:
                apart = apart.astype(object)
            deviation = [int(d) for d in (apart * apart).sum(axis=1)]
            flat = centred / n @ into
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(deviation, pa.decimal128(38, 0)), whitened], names=[*names, "deviation", "whitened"])

    return framed.mapInArrow(run, schema)


def whitened_components(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16) -> DataFrame:
    """One row per row with a vector and component, the figures of the fit beside them."""
    model = fit_whitening(rows, vector, components)
    done = whiten(rows.select(key, vector), model, vector)
    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    long = done.select(key, F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
