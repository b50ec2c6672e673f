"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Every entry ``c`` of a vector becomes the integer ``floor(64 * c) + 1000000``. The fit list holds
each distinct integer vector once; it is written to the shared folder, because each Lanczos step
reads it. A step is one distributed pass: tasks multiply their centred rows ``X`` with ``v``, the
result with the transpose, and Spark adds up the ``d`` sums of all tasks. Left vectors are never
stored: each is ``X g`` for a short vector ``g`` that the driver keeps, so a lost executor repeats
one task of one pass. Both sides are orthogonalised against all vectors before them. The singular
values of the small bidiagonal matrix are the deviations, its vectors give the components.

Steps end when the wanted components have converged, at the latest after ``d``. As one Krylov
sequence meets only one vector of equal singular values, a sequence that ended early is followed
by another one, orthogonal to what was found, until that brings no larger value.

Rows whose vector is null, or holds a null, non-finite or larger entry than a long can hold, are
left out, as are vectors of another length than most have (of equally frequent lengths the longer
one counts). Repeated rows are rows of the result each, but count once in the fit. Null ids are
kept. Other columns are ignored. Without rows, or without any deviation, the result is empty; with
fewer than ``components`` directions of positive deviation it holds just those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import ship_package
from chainlake.session import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Residual of a component, as part of the largest singular value, below which it has converged.
TOLERANCE = 1e-14
#: Squared singular values below this part of the largest are rounding, not deviation.
NEGLIGIBLE = 1e-20
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit found; all of it is of the size of a few vectors."""

    n: int
    sums: list[int]
    directions: np.ndarray  # one column a component
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the usable rows, and the length of x (0 without rows)."""
    vector = F.col(vector_col)
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**56, F.lit(False)) & ~F.isnan(c)
    rows = df.filter(F.coalesce(F.forall(vector, fits) & (F.size(vector) > 0), F.lit(False))).select(
        F.col(id_col).alias("id"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)).alias("x"),
    )
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.filter(F.size("x") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, d: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``add(rows)``, a vector of ``size`` doubles; only the sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(_matrix(batch, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["pos", "value"])

    parts = fit.mapInArrow(run, "pos int, value double")
    out = np.zeros(size)
    for row in parts.groupBy("pos").agg(F.sum("value").alias("value")).collect():  # ``size`` rows
        out[row["pos"]] = row["value"]
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
            ["pos", "n", "high", "low"],
        )

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = fit.mapInArrow(run, "pos int, n long, high long, low long")
    rows = parts.groupBy("pos").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect()  # d rows
    sums = {r["pos"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums[i] for i in range(d)] if rows else []


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Integer part and remainder of the mean: x - S/n is (x - whole) - rest without loss."""
    whole = np.array([s // n for s in sums], np.int64)
    return whole, np.array([(s % n) / n for s in sums])


def _orthogonal(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``w`` without its parts along the columns of ``basis``; twice, as once leaves rounding."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    return w


def _fresh(basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    w = _orthogonal(rng.standard_normal(len(basis)), basis)
    return w / np.linalg.norm(w)


def bidiagonalise(
    product: Callable[[np.ndarray], tuple[np.ndarray, float]],
    d: int,
    wanted: int,
    locked: np.ndarray,
    scale: float,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(singular values, right vectors as columns, steps, whether the space was exhausted).

    ``product(t)`` gives (XᵀXt, |Xt|²). All vectors stay orthogonal to the columns of ``locked``.
    """
    space = d - locked.shape[1]
    v, lefts, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas: list[float] = []
    betas: list[float] = []
    tiny = scale * 1e-15
    direction, fresh = _fresh(locked, rng), True
    while True:
        v = np.column_stack([v, direction])
        t = direction - (betas[-1] * lefts[:, -1] if betas else 0)
        z, square = product(t)
        along = lefts.T @ z  # what rounding has left along earlier left vectors
        t, z, square = t - lefts @ along, z - images @ along, square - float(along @ along)
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= tiny:
            alpha, t, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            t, z = t / alpha, z / alpha
        alphas.append(alpha)
        lefts, images = np.column_stack([lefts, t]), np.column_stack([images, z])
        k = len(alphas)
        w = _orthogonal(z - alpha * direction, np.column_stack([locked, v]))
        beta = float(np.linalg.norm(w))
        b = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, right = np.linalg.svd(b)
        top = min(wanted, k)
        done = k >= wanted and bool(np.all(abs(beta * left[-1, :top]) <= TOLERANCE * sigma[0]))
        # A random direction without image: nothing deviates outside of what was found.
        exhausted = k == space or fresh and alpha == 0
        if exhausted or done and beta > tiny:
            return sigma[:top], (v @ right.T)[:, :top], k, exhausted
        fresh = beta <= tiny  # an invariant space ends here; go on beside it
        if fresh:
            beta, direction = 0.0, _fresh(np.column_stack([locked, v]), rng)
        else:
            direction = w / beta
        betas.append(beta)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit the whitening to the distinct ``x`` of ``vectors``; None when nothing deviates."""
    if not d:
        return None
    ship_package(vectors.sparkSession)
    distinct = materialize(vectors.select("x").distinct(), "fit-list")
    n, sums = exact_sums(distinct, d)
    if not n:
        return None
    whole, rest = _centre(n, sums)

    def product(t: np.ndarray) -> tuple[np.ndarray, float]:
        def add(x: np.ndarray) -> np.ndarray:
            c = (x - whole) - rest
            p = c @ t
            return np.append(p @ c, p @ p)

        out = summed(distinct, d, d + 1, add)
        return out[:d], float(out[d])

    total = float(summed(distinct, d, 1, lambda x: np.array([(((x - whole) - rest) ** 2).sum()]))[0])
    if total <= 0:
        return None
    rng = np.random.default_rng(0)
    wanted = min(components, d)
    scale = np.sqrt(total)
    sigma, v, steps, exhausted = bidiagonalise(product, d, wanted, np.zeros((d, 0)), scale, rng)
    while not exhausted and v.shape[1] < d:
        more, w, k, last = bidiagonalise(product, d, 1, v, scale, rng)
        steps += k
        if more[0] <= sigma[wanted - 1] * (1 + 1e-12):
            break
        # The sequence before had met only one of several equal or hidden values.
        sigma, v = np.append(sigma, more), np.column_stack([v, w])
        order = np.argsort(-sigma, kind="stable")
        sigma, v = sigma[order], v[:, order]
        exhausted = last
    keep = sigma[:wanted] ** 2 > NEGLIGIBLE * sigma[0] ** 2
    sigma, v = sigma[:wanted][keep], v[:, :wanted][:, keep]
    k = len(sigma)
    turned = v / (sigma / np.sqrt(n))

    def spread(x: np.ndarray) -> np.ndarray:
        w = ((x - whole) - rest) @ turned
        return (w.T @ w).ravel()

    error = float(np.abs(summed(distinct, d, k * k, spread).reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, v, sigma**2 / n, sigma**2 / total, error, steps)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n*x - S)² for every row; null beyond the range of a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    near = x - whole
    largest = (int(np.abs(near).max()) + 1) * n if near.size else 0
    if x.shape[1] * largest * largest <= _LONG:
        return ((near * n - rest) ** 2).sum(1).tolist()
    exact = ((near.astype(object) * n - rest.astype(object)) ** 2).sum(1)
    return [v if v <= _LONG else None for v in exact.tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: ``id_col``, n, deviation, whitened and explained (one entry a component), identity_error."""
    vectors, d = integer_vectors(df, id_col, vector_col)
    model = fit(vectors, d, components)
    id_type = df.schema[id_col].dataType
    schema = T.StructType().add("id", id_type).add("n", "long").add("deviation", "long").add(
        "whitened", T.ArrayType(T.DoubleType())
    )
    if model is None:
        out = df.sparkSession.createDataFrame([], schema)
        explained, error = [], 0.0
    else:
        n, sums = model.n, model.sums
        whole, rest = _centre(n, sums)
        turned = model.directions / np.sqrt(model.variances)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, d)
                flat = (((x - whole) - rest) @ turned).ravel()
                ends = np.arange(0, len(flat) + 1, turned.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), pa.array(np.full(len(x), n)), pa.array(deviations(x, n, sums), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    ["id", "n", "deviation", "whitened"],
                )

        out = vectors.mapInArrow(run, schema)
        explained, error = [float(e) for e in model.explained], model.identity_error
    return out.select(
        F.col("id").alias(id_col), "n", "deviation", "whitened",
        F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
