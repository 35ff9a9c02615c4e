"""Whitened vectors against numpy and exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from wardflow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check(spark, vectors, found=None, rank=None):
    """``vectors``: pairs of id and vector, all usable ones of one length."""
    rows = [(i, v, 0) for i, v in vectors]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect() if found is None else found
    ids = [i for i, v in vectors if usable(v)]
    x = np.array([whole(v) for _, v in vectors if usable(v)], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    c = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(row, sums)] for row in x])
    _, spread, turned = np.linalg.svd(c, full_matrices=False)
    values, vectors_of = spread**2 / n, turned.T
    k = min(32, x.shape[1]) if rank is None else rank
    assert len(got) == n * k
    places = {i: [j for j, o in enumerate(ids) if o == i] for i in set(ids)}
    want = c @ vectors_of[:, :k] / np.sqrt(values[:k])
    mine = np.zeros((n, k))
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        for j in places[r.vec_id]:
            assert r.deviation == sum((int(a) * n - int(s)) ** 2 for a, s in zip(x[j], sums))
            mine[j, r.component - 1] = r.whitened
    for j in range(k):  # either sign, the same for all rows
        sign = np.sign((mine[:, j] * want[:, j]).sum())
        assert np.abs(mine[:, j] - sign * want[:, j]).max() < 1e-6
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(k)).max() < 1e-9


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    spread = np.geomspace(30, 0.2, 40)
    rows = [(i, [float(x) for x in rng.normal(size=40) * spread]) for i in range(500)]
    check(spark, rows)
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 90)
    check(spark, [(i, v[:5]) for i, v in rows[:70]])


def test_ill_conditioned(spark):
    """Spreads from 1 to 10^4: squaring the condition would lose digits of the smallest ones."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * np.geomspace(3e4, 1, 6)]) for i in range(200)]
    check(spark, rows)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 1.0]), (None, [0.5, 0.25, 1.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {*range(30), None}
    check(spark, rows, found=got)


def test_directions_without_variance(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        a, b = (float(x) for x in rng.normal(size=2) * 20)
        a, b = math.floor(64 * a) / 64, math.floor(64 * b) / 64
        rows.append((i, [a, 7.0, b, 2 * a, a + b]))
    check(spark, rows, rank=2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_repeated_rows_other_lengths_and_other_columns(spark):
    rng = np.random.default_rng(5)
    vectors = [(i // 2, [float(x) for x in rng.normal(size=2)]) for i in range(20)] + [(50, [1.0, 2.0, 3.0])]
    rows = [(i, v, "n", "c") for i, v in vectors]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component string")).collect()
    assert len(got) == 40 and 50 not in {r.vec_id for r in got}


def test_huge_entries(spark):
    rows = [(i, [1e9 if i == 1 else float(i), float(i * i % 7)], 0) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 18 and all(r.deviation is None for r in got) and all(math.isfinite(r.whitened) for r in got)


def test_query(spark, folder):
    found = queries.QUERIES["op12_cholesky_whitening"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(spark, [(r.vec_id, r.embedding) for r in rows], found=found)
