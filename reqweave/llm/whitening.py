"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the vectors multiplies it with a narrow block of directions:
every task adds up ``Xc' (Xc Q)`` over its centred rows and the sums of the tasks are added by dimension. Between
passes the driver holds blocks of dimension x directions only. A polynomial recurrence damps the
spectrum below the smallest Ritz value, QR makes the block orthonormal, Rayleigh-Ritz rotates it, and rounds
follow until the residuals of all wanted components certify them.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are vectors of
another length than most (of equally frequent lengths the shorter one counts). Components without variance are not
returned, so equal vectors, or a single one, give no rows; neither does an empty table. Repeated rows count and are
returned as often as they occur; a null id stays null; extra columns are not read. Entries must lie below 2**40.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.llm.common import arrow_schema
from reqweave.storage import materialize

COMPONENTS = 32
#: Directions carried beyond the wanted ones, as a share of them and at least.
GUARD_SHARE, GUARD_LEAST = 0.5, 8
#: Highest degree of the polynomial, and the largest growth of a direction in one round.
DEGREE, GROWTH = 16, 1e8
#: Residual, relative to the largest eigenvalue, that certifies a component; what is accepted where it improves no more.
CERTIFIED, ACCEPTED = 1e-13, 1e-11
ROUNDS = 200
#: Most cells of a block of directions; it travels with every task.
BLOCK_CELLS = 1 << 22
#: Entries become whole numbers: scale and shift.
SCALE, SHIFT = 64, 1_000_000
#: Components at or below this share of the largest have no variance but rounding.
FLAT = 1e-12


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, x`` of the vectors that count, written once, and their dimension."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("entries"))
    finite = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where((F.size("entries") > 0) & finite)
    most = rows.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    whole = F.transform("entries", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return materialize(rows.where(F.size("entries") == d).select("vec_id", whole.alias("x")), "whole_vectors"), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def totals(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, np.int64)
        for batch in batches:
            sums += matrix(batch.column(0), d).sum(axis=0)
            n += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(d)), pa.array(sums), pa.array(np.full(d, n))], names=["i", "s", "n"])

    parts = rows.select("x").mapInArrow(add, "i long, s long, n long")
    found = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (found[0]["n"], np.array([r["s"] for r in found], np.int64)) if found else (0, np.zeros(d, np.int64))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less their mean; the difference is taken in whole numbers, so nothing cancels."""
    return (x * n - sums) / n


def summed(rows: DataFrame, d: int, height: int, width: int, task) -> np.ndarray:
    """Sum over all rows of the ``height x width`` blocks that ``task`` makes of batches of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((height, width))
        for batch in batches:
            block += task(matrix(batch.column(0), d))
        values = pa.ListArray.from_arrays(pa.array(np.arange(height + 1, dtype=np.int32) * width), pa.array(block.reshape(-1)))
        yield pa.record_batch([pa.array(np.arange(height)), values], names=["i", "y"])

    parts = rows.select("x").mapInArrow(add, "i long, y array<double>")
    found = parts.select("i", F.posexplode("y").alias("j", "y")).groupBy("i", "j").agg(F.sum("y").alias("y")).toArrow()
    out = np.zeros((height, width))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["y"].to_numpy()
    return out


def filtered(product, block: np.ndarray, image: np.ndarray, bound: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance on ``block``: what lies in [0, bound] is damped. ``image`` is its first product."""
    half = bound / 2
    before, now = block, (image - half * block) / half
    for _ in range(degree - 1):
        before, now = now, 2 / half * (product(now) - half * now) - before
    return now


def leading(product, d: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of a matrix that is known by its products with blocks only."""
    width = min(d, wanted + max(GUARD_LEAST, math.ceil(GUARD_SHARE * wanted)))
    if d * width > BLOCK_CELLS:
        raise ValueError(f"{d} dimensions times {width} directions are more than {BLOCK_CELLS} cells")
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        image = product(block)
        small = block.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        if ritz[0] <= 0:
            return ritz[:wanted], block[:, :wanted]
        worst = np.linalg.norm(image - block * ritz, axis=0)[:wanted].max() / ritz[0]
        if worst <= CERTIFIED or (worst <= ACCEPTED and worst > last / 2):
            return ritz[:wanted], block[:, :wanted]
        last = worst
        bound = max(ritz[-1], 1e-6 * ritz[0])
        growth = math.acosh(max(2 * ritz[0] / bound - 1, 1 + 1e-9))
        degree = int(min(DEGREE, max(2, math.log(2 * GROWTH) // growth)))
        block = np.linalg.qr(filtered(product, block, image, bound, degree))[0]
    raise RuntimeError(f"components are not certified after {ROUNDS} rounds; the worst residual is {last}")


def one_sign(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    at = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum of squares of ``n x - S`` per row, in whole numbers of any size."""
    away = x * n - sums
    if len(away) and float(np.abs(away).max()) ** 2 * away.shape[1] >= 2.0**62:
        return [sum(v * v for v in row) for row in away.tolist()]
    return (away * away).sum(axis=1).tolist()


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component, numbered from 1 by falling variance. A deviation beyond a long is an error."""
    rows, d = whole_vectors(vectors, id_col, vector_col)
    spark, schema = rows.sparkSession, arrow_schema(WHITENED)
    n, sums = totals(rows, d) if d else (0, None)
    if not n:
        return spark.createDataFrame([], WHITENED)
    product = lambda block: summed(rows, d, d, block.shape[1], lambda x: (c := centred(x, n, sums)).T @ (c @ block)) / n
    trace = float(summed(rows, d, 1, 1, lambda x: np.square(centred(x, n, sums)).sum(keepdims=True).reshape(1, 1))[0, 0]) / n
    values, basis = leading(product, d, min(components, d))
    varied = values > FLAT * max(values[0], 0.0)
    values, basis = values[varied], one_sign(basis[:, varied])
    k = len(values)
    if not k:
        return spark.createDataFrame([], WHITENED)
    scaled, explained = basis / np.sqrt(values), values / trace
    again = summed(rows, d, k, k, lambda x: (w := centred(x, n, sums) @ scaled).T @ w) / n
    error = float(np.abs(again - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            m = len(x)
            columns = {
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n),
                "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": (centred(x, n, sums) @ scaled).reshape(-1), "explained": np.tile(explained, m), "identity_error": np.full(m * k, error),
            }
            yield pa.record_batch([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return rows.mapInArrow(project, WHITENED)
