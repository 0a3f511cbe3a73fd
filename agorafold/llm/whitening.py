"""Whitening by a matrix-free block Lanczos method with full reorthogonalisation.

An entry c of a vector becomes the integer x = floor(SCALE * c) + SHIFT, and
every distinct x vector once is the fit list: n vectors with per-dimension sums
S.  V is their covariance (divisor n).  Its leading eigenvectors are found
without V: a pass over the fit list gives, for a block B of vectors,

    V B = sum over x of (x - S/n) ((x - S/n)' B) / n,

summed in tasks and between them; the driver gets one (dimension, block)
matrix a pass and holds at most ``BASIS`` such columns.

* The next block is the last product, orthogonalised twice against the whole
  basis (full reorthogonalisation).
* Breakdown: directions that vanish in it mean that the basis holds an
  invariant subspace; random ones orthogonal to the basis take their place.
* Ritz pairs come from the basis and its kept products, so a residual
  |V u - e u| is that of the pair itself; the method ends when the residuals of
  all wanted pairs are of rounding size, no longer fall, or the basis spans
  the space.
* A full basis is replaced by its leading Ritz vectors, and goes on with the
  residuals' directions.

Sums and deviations are exact integers, (n x - S) / n is rounded once.  The fit
list is a kept table, so that passes don't repeat the shuffle that finds
distinct vectors and a lost executor costs its tasks only.

Defined results: rows with a null vector or a null or non-finite entry, or of
another length than the table's (``vectors.usable``), are dropped; entries whose
x - SHIFT would be 2^52 or more count as that.  A vector of d dimensions has
min(d, components) components.  A component without variance (fewer distinct
vectors than components, constant dimensions) has a null ``whitened`` and is left
out of ``identity_error``; ``explained`` is null if there is no variance at all.  A
deviation that a long can't hold is null.  Equal rows get equal results, null
ids included; an empty table gives an empty result.  The sign of a component
makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorafold.llm import common, vectors

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
MOST = float(1 << 52)
#: Vectors of a block, and columns of the basis at which it is replaced by its leading Ritz vectors.
BLOCK, BASIS = 16, 256
PASSES = 500
_EPS = float(np.finfo(np.float64).eps)


def integers(vector: Column) -> Column:
    """array<bigint>: x of each entry."""
    return F.transform(vector, lambda c: (F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(-MOST)), F.lit(MOST))).cast("long") + F.lit(SHIFT).cast("long"))


@dataclass
class Centre:
    """n and S of the fit list."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S of each row: int64, or Python integers where that could overflow."""
        most = int(np.abs(x).max()) if x.size else 0
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Of each row the sum of (n x - S)^2, exact; Python integers where int64 could overflow."""
        t = self.numerators(x)
        most = int(np.abs(t).max()) if t.size else 0
        t = t if most * most * max(1, x.shape[1]) < 1 << 63 else t.astype(object)
        return (t * t).sum(axis=1)


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x): each distinct integer vector once."""
    return rows.select(integers(F.col(vector)).alias("x")).distinct()


def _centre(fit: DataFrame, length: int) -> Centre:
    """Sums in two halves, so that no batch can overflow; tasks' sums are added as decimals."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column(0), length)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        at = np.arange(length + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], names=["at", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = {r["at"]: int(r["h"]) * (1 << 26) + int(r["l"]) for r in fit.mapInArrow(halves, "at int, high bigint, low bigint").groupBy("at").agg(exact("high").alias("h"), exact("low").alias("l")).collect()}
    return Centre(found.get(length, 0), [found.get(i, 0) for i in range(length)])


def summed(fit: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], length: int, size: int) -> np.ndarray:
    """The sum over the fit list of ``of_rows`` (x matrix -> ``size`` numbers, already summed over its rows).

    A task gives ``size`` numbers; those of a place are added by Spark, and the
    driver receives ``size`` rows.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of_rows(vectors.matrix(batch.column(0), length)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(added, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _next(basis: np.ndarray, block: np.ndarray, width: int, scale: float, draw: np.random.Generator) -> np.ndarray:
    """An orthonormal block orthogonal to the basis: the directions of ``block`` outside it, then random ones."""
    width = min(width, basis.shape[0] - basis.shape[1])
    u, s, _ = np.linalg.svd(_against(basis, block), full_matrices=False)
    new = u[:, s > 4 * _EPS * scale][:, :width]
    while True:
        new = np.linalg.qr(_against(basis, new))[0]
        if new.shape[1] == width:
            return new
        fresh = _against(np.hstack([basis, new]), draw.normal(size=(len(basis), width - new.shape[1])))
        new = np.hstack([new, np.linalg.qr(fresh)[0]])


def leading(product: Callable[[np.ndarray], np.ndarray], length: int, components: int = COMPONENTS, block: int = BLOCK, most: int = BASIS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors as columns, largest residual) of the symmetric V of ``product`` (B -> V B)."""
    wanted = min(components, length)
    most = max(most, wanted + 2 * block)
    draw = np.random.default_rng(seed)
    basis, products = np.zeros((length, 0)), np.zeros((length, 0))
    new = _next(basis, np.zeros((length, 0)), block, 0.0, draw) if length else basis
    best, stale = np.inf, 0
    for _ in range(PASSES):
        if not new.shape[1]:
            break
        last = product(new)
        basis, products = np.hstack([basis, new]), np.hstack([products, last])
        small = basis.T @ products
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, of_ritz = basis @ turn, products @ turn
        apart = np.linalg.norm(of_ritz - ritz * value, axis=0)
        worst = apart[:wanted].max(initial=0.0) if len(value) >= wanted else np.inf
        rounding = 8 * _EPS * max(value[0], 0.0) * np.sqrt(length)
        best, stale = (worst, 0) if worst < best / 2 else (best, stale + 1)
        if basis.shape[1] == length or worst <= rounding or (stale >= 4 and worst < 1e-11 * value[0]):
            break
        scale = float(np.abs(value).max())
        if basis.shape[1] + block > most:
            basis, products = ritz[:, : wanted + block], of_ritz[:, : wanted + block]
            last = products - basis * value[: wanted + block]
        new = _next(basis, last, block, scale, draw)
    if not length:
        return np.zeros(0), np.zeros((0, 0)), 0.0
    ritz = ritz[:, :wanted]
    sign = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(wanted)])
    return value[:wanted], ritz * np.where(sign == 0, 1, sign), float(worst)


@dataclass
class Whitening:
    """projection: components as columns over the root of their eigenvalue; those without variance are nan."""

    centre: Centre
    values: np.ndarray
    projection: np.ndarray
    explained: list[float | None]
    identity_error: float
    residual: float


def learn(fit: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a kept fit list."""
    centre = _centre(fit, length)
    if not centre.n:
        return Whitening(centre, np.zeros(0), np.zeros((length, 0)), [], 0.0, 0.0)
    trace = summed(fit, lambda x: np.array([float(centre.deviations(x).sum())]), length, 1)[0] / centre.n**3

    def product(block: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            away = centre.centred(x)
            return away.T @ (away @ block)

        return summed(fit, of_rows, length, block.size).reshape(block.shape) / centre.n

    values, axes, residual = leading(product, length, components)
    varies = values > 64 * _EPS * length * max(values.max(initial=0.0), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        projection = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    used = projection[:, varies]

    def covariance(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x) @ used
        return z.T @ z

    k = used.shape[1]
    error = np.abs(summed(fit, covariance, length, k * k).reshape(k, k) / centre.n - np.eye(k)).max(initial=0.0) if k else 0.0
    shares = [float(max(e, 0.0) / trace) if trace > 0 else None for e in values]
    return Whitening(centre, values, projection, shares, float(error), residual)


def whiten(rows: DataFrame, model: Whitening, length: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row and component: the key, component, n, deviation, whitened, explained, identity_error."""
    k = model.projection.shape[1]
    kind = rows.schema[key].dataType.simpleString()

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = vectors.matrix(batch.column(1), length)
            z = (model.centre.centred(x) @ model.projection).ravel()
            dev = model.centre.deviations(x)
            dev = pa.array([int(d) if int(d) < 1 << 63 else None for d in dev] if dev.dtype == object else dev, pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)), dev.take(each),
                 pa.array(z, mask=np.isnan(z)), pa.array(list(model.explained) * m, pa.float64()), pa.array(np.full(m * k, model.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    named = rows.select(F.col(key), integers(F.col(vector)).alias("__wh_x"))
    return named.mapInArrow(whitened, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the components of the distinct ones."""
    rows, length = vectors.usable(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    fit = common.Scratch(spark, "whitening").keep(fit_list(rows))
    return whiten(rows, learn(fit, length), length)
