"""Whitening of vectors by shifted Cholesky QR.

Entries become whole numbers, so that the mean is exact.  The centred rows are made
orthonormal in passes over the table: a pass sums up the Gram matrix of the rows, its
Cholesky factor is shifted in the first pass so that it exists whatever the condition,
and the rows of the next pass go through triangular solves with all factors so far.  The
product of the factors is the triangular factor R of the centred table, and the singular
value decomposition of R gives components and variances without squaring its condition.

Only sums of dimension x dimension numbers reach the driver, whatever the number of
rows; rows are worked on in blocks of bounded size and never meet.

Defined results: a vector that is null, or has null or non-finite entries, takes no part;
of vectors of different lengths those of the most frequent length take part (of equally
frequent ones the longest); 64 times an entry beyond 2^52 in size counts as 2^52; a
direction without variance (below 10^-20 of the largest, where rounding decides) cannot be
whitened and is no component, so fewer than the asked ones may be returned, and none for a single or for equal vectors; a deviation that does not fit a long is null; repeated rows are returned
each; columns besides id and vector are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52)
COMPONENTS = 32
#: Passes at most, and how far from the identity the Gram matrix of the last may be.
PASSES, SETTLED = 8, 1e-13
#: Singular values below this share of the largest are directions without variance.
FLAT = 1e-10
BLOCK_NUMBERS = 1 << 19
UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Fit:
    """Number of rows, sums, components as columns, and their variances and shares of the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def whole_numbers(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows ``(id, x)`` of the vectors that take part, as whole numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & good & (F.size(vector) > 0))

    def value(c):
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled).cast("long") + F.lit(SHIFT).cast("long")

    return kept.select(F.col(id_col).alias("id"), F.transform(vector, value).alias("x"))


def usual_length(rows: DataFrame) -> int:
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    return 0 if top is None else top["d"]


def blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as a table of whole numbers."""
    step = max(1, BLOCK_NUMBERS // dim)
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of each dimension."""
    def partial(batches):
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for _, x in blocks(batches, 0, dim):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array(np.full(dim, n))], names=["j", "high", "low", "n"])

    found = rows.select("x").mapInArrow(partial, "j long, high long, low long, n long")
    exact = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low", "n")]
    got = {r["j"]: r for r in found.groupBy("j").agg(*exact).collect()}
    return int(got[0]["n"]), tuple((int(got[j]["high"]) << 32) + int(got[j]["low"]) for j in range(dim))


def _small(n: int, sums: tuple[int, ...], x: np.ndarray) -> bool:
    """Whether n * x - S and the sum of its squares fit 64 bits."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    return most < 1 << 62


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, rounded once."""
    if _small(n, sums, x):
        return (x * n - np.array(sums, dtype=np.int64)) / float(n)
    return np.array([[float(Fraction(int(v) * n - s, n)) for v, s in zip(row, sums)] for row in x])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n * x - S)^2 over the dimensions, exact."""
    if _small(n, sums, x):
        gap = x * n - np.array(sums, dtype=np.int64)
        # a bound in floating point decides whether whole numbers of 64 bits are enough
        if float((gap.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
            return (gap * gap).sum(axis=1).tolist()
    exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, dim: int, transform) -> tuple[np.ndarray, np.ndarray]:
    """Sums and Gram matrix of the transformed rows, added up over all tasks."""
    def partial(batches):
        total = None
        for _, x in blocks(batches, 0, dim):
            y = transform(x)
            own = np.vstack([y.sum(axis=0), y.T @ y])
            total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            use = i.ravel() <= j.ravel() + 1  # the sums, and the upper triangle of the matrix
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()[use]) for v in (i, j, total)], names=["i", "j", "v"])

    summed = rows.select("x").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = summed.toPandas()
    width = int(got["j"].max()) + 1
    full = np.zeros((width + 1, width))
    full[got["i"], got["j"]] = got["v"]
    upper = full[1:]
    return full[0], np.triu(upper) + np.triu(upper, 1).T


def factor_of(matrix: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor, shifted where asked or where there is none without."""
    dim = len(matrix)
    shift = 11 * (n * dim + dim * (dim + 1)) * UNIT * max(np.linalg.norm(matrix, 2), np.finfo(np.float64).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(matrix).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 10


def triangular_factor(rows: DataFrame, dim: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred rows, composed of the factors of the passes."""
    factors: list[np.ndarray] = []
    composed = np.eye(dim)
    for i in range(PASSES):
        used = list(factors)

        def orthogonal(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            for factor in used:
                y = solved(y, factor)
            return y

        _, matrix = gram(rows, dim, orthogonal)
        if not matrix.any():
            return np.zeros((dim, dim))
        live = np.diag(matrix) > 0.5
        if i and np.abs(matrix[np.ix_(live, live)] - np.eye(int(live.sum()))).max(initial=0) <= SETTLED * dim and not matrix[~live].any():
            break
        factors.append(factor_of(matrix, n, shifted=i == 0))
        composed = factors[-1] @ composed
    return composed


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Fit:
    """Components of the rows ``(id, x)`` of one length."""
    n, sums = exact_sums(rows, dim)
    _, spread, turned = np.linalg.svd(triangular_factor(rows, dim, n, sums) / np.sqrt(n))
    use = (spread > FLAT * spread[0]) & (spread > 0)
    use &= np.cumsum(use) <= components
    variances = spread**2
    whole = variances.sum()
    return Fit(n, sums, turned[use].T, variances[use], variances[use] / whole if whole else variances[use])


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows ``(id, component, n, deviation, whitened, explained, identity_error)``, one for each vector and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    numbers = stored(whole_numbers(rows, id_col, vector), "whitening-rows")
    dim = usual_length(numbers)
    numbers = numbers.where(F.size("x") == dim)
    model = fit(numbers, dim, components) if dim else None
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums = model.n, model.sums
    onto = model.components / np.sqrt(model.variances)
    means, moments = gram(numbers, dim, lambda x: centred(x, n, sums) @ onto)
    width = len(model.variances)
    error = float(np.abs(moments / n - np.outer(means / n, means / n) - np.eye(width)).max())
    explained = model.explained

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1, dim):
            each = np.repeat(np.arange(len(x)), width)
            values = (centred(x, n, sums) @ onto).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(values),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return numbers.mapInArrow(written, schema)
