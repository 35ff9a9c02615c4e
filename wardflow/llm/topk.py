"""Exact top-k search with a table of distances to pivots.

Components become the integers floor(256 x); a score is an inner product.  The distances of a
vector to many pivots and to the origin fix its place in the space that the pivots span, and how
far it lies outside.  Two vectors are nearest if they lie outside on the same side: that is the
greatest lower bound on their distance which all these distances together allow (never less than
the greatest difference of two distances to a pivot), hence an upper bound on their inner
product, the product of the places plus that of the heights outside.  Candidates are evaluated
in the order of that bound, until the next bound is below the k-th score found, which makes the
result exact.

Queries meet all rows in blocks of bounded size: rows are dealt to blocks by a hash, a
task has one block of queries and one of candidates, and gives at most k rows per query.

Defined results: vectors that are null or hold null or non-finite components take no part,
neither as query nor as candidate; shorter vectors count as padded with zeros; ties go to the smaller id,
null ids last; rows with equal ids are different candidates, and only the query's own row
is left out; components and scores beyond 64 bits are the nearest 64-bit integer, and tie; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.llm.common import parts_for, stored

K = 5
PIVOTS = 48
#: Vectors from which pivots are picked, one after another far outside the span of the earlier ones.
PIVOT_SAMPLE = 2000
QUERY_EVERY = 50
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
STEP = 64
#: Pivots that lie nearer to the span of the earlier ones, as a share of the longest vector, are not taken.
LEAST_HEIGHT = 1e-3
#: Share of the lengths that bounds are widened by, which is more than their rounding.
SLACK = 1e-5
LONGEST = 2**63


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(length.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = _padded(x, width).astype(np.float64), _padded(pivots, width).astype(np.float64)
    square = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Up to ``PIVOTS`` rows, each the farthest outside the span of those before."""
    rest = sample.astype(np.float64)
    picked: list[int] = []
    longest = (rest**2).sum(axis=1).max(initial=0)
    while len(picked) < min(PIVOTS, len(sample)):
        height = (rest**2).sum(axis=1)
        far = int(height.argmax())
        if height[far] <= LEAST_HEIGHT**2 * longest:
            break
        picked.append(far)
        way = rest[far] / np.sqrt(height[far])
        rest -= np.outer(rest @ way, way)
    return sample[picked]


def places(norm: np.ndarray, table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Where rows lie by their lengths and distances to pivots: coordinates in the span, and at last the height outside.

    The inner product of two rows is at most that of their places, but for rounding.
    """
    if not len(pivots):
        return norm[:, None]
    p = pivots.astype(np.float64)
    products = (norm[:, None] ** 2 + (p**2).sum(axis=1)[None, :] - table**2) / 2
    factor = np.linalg.cholesky(p @ p.T)
    inside = np.zeros(products.shape)
    for j in range(len(p)):
        inside[:, j] = (products[:, j] - inside[:, :j] @ factor[j, :j]) / factor[j, j]
    height = np.sqrt(np.maximum(norm**2 - (inside**2).sum(axis=1), 0))
    return np.concatenate([inside, height[:, None]], axis=1)


def _scored(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond 64 bits are the nearest 64-bit integer."""
    scores = x @ q
    return scores if scores.dtype != object else np.array([min(max(v, -LONGEST), LONGEST - 1) for v in scores], np.int64)


def block_top(q: np.ndarray, q_row: np.ndarray, q_place: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_place: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its best candidates of a block: query, candidates, scores, how many were evaluated.

    Candidates must ascend by id with nulls last.
    """
    width = max(q.shape[1], x.shape[1])
    q, x = _padded(q, width), _padded(x, width)
    size = max(float(np.abs(q.astype(np.float64)).max(initial=0)), float(np.abs(x.astype(np.float64)).max(initial=0))) ** 2 * max(width, 1)
    kind = np.float64 if size < 2**52 else np.int64 if size < 2**62 else object
    qs, xs = q.astype(kind), x.astype(kind)
    x_norm = np.sqrt((x_place.astype(np.float64) ** 2).sum(axis=1))
    for i in range(len(q)):
        bound = (x_place @ q_place[i]).astype(np.float64)
        bound += SLACK * x_norm * np.sqrt((q_place[i].astype(np.float64) ** 2).sum()) + 1
        # bounds only order and stop; no score lies below the least integer
        np.maximum(bound, -float(LONGEST), out=bound)
        own = np.flatnonzero(x_row == q_row[i])
        bound[own] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[: len(order) - len(own)]
        best = np.zeros(0, np.int64)
        score = np.zeros(0, np.int64)
        seen = 0
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(best) == k:
                part = part[bound[part] >= score[-1]]
                if not len(part):
                    break
            seen += len(part)
            best, score = np.concatenate([best, part]), np.concatenate([score, _scored(xs[part], qs[i]).astype(np.int64)])
            first = np.lexsort((best, ~score))[:k]
            best, score = best[first], score[first]
        yield i, best, score, seen


def _integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, v, row`` of the vectors that take part, stored, so that ``row`` stays the same."""
    values = F.transform(F.col(embedding), lambda x: x.cast("double"))
    whole = F.col(embedding).isNotNull() & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.filter(whole).select(F.col(vec_id).cast("long").alias("id"), F.transform(values, lambda x: F.floor(256 * x).cast("long")).alias("v"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")


def search(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the best candidates of every row whose id is divisible by ``QUERY_EVERY``."""
    rows = _integers(vectors, vec_id, embedding)
    sample = rows.orderBy(F.xxhash64("id", "row")).limit(PIVOT_SAMPLE).select("v").toArrow()
    pivots = choose_pivots(_matrix(sample.column("v")))
    asked = (F.col("id") % QUERY_EVERY == 0)
    total, queries = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, groups = parts_for(total, BLOCK_ROWS), parts_for(queries, QUERY_ROWS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
                table = places(norm, _distances(x, pivots), pivots).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "row", "d"])

    table = stored(rows.mapInArrow(measured, "id long, v array<long>, row long, d array<float>"), "topk-pivots")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.filter(asked).select("id", "v", "row", "d", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), each(blocks).alias("b"))
    right = table.select("id", "v", "row", "d", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), each(groups).alias("g"))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}
        if len(one) and len(two):
            two = two.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
            q, x = _matrix(one.column("v")), _matrix(two.column("v"))
            pivot_count = len(pivots) + 1
            dq = one.column("d").combine_chunks().flatten().to_numpy().reshape(len(one), pivot_count)
            dx = two.column("d").combine_chunks().flatten().to_numpy().reshape(len(two), pivot_count)
            ids, row = two.column("id").to_pylist(), two.column("row").to_numpy()
            query_ids, query_row = one.column("id").to_pylist(), one.column("row").to_numpy()
            for i, best, score, _ in block_top(q, query_row, dq, x, row, dx, k):
                for b, s in zip(best.tolist(), score.tolist()):
                    for name, value in zip(found, (query_row[i], query_ids[i], ids[b], row[b], s)):
                        found[name].append(value)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in found.items()})

    met = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(meet, "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
