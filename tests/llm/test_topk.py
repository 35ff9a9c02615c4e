import numpy as np
from pyspark.sql import functions as F

from wardflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    """Scores of every query with every other row, by plain integers."""
    held = []
    for place, (vec_id, v, _) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((place, vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for place, vec_id, v in held:
        if vec_id is not None and vec_id % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), o is None, o or 0) for p, o, w in held if p != place)
            out += [(vec_id, r + 1, None if null else o, -s) for r, (s, null, o) in enumerate(scores[:k])]
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_against_plain_integers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(400)]
    check(spark, rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "STEP", 7)
    check(spark, rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v, 1), (0, v, 1), (50, None, 1), (100, [], 1), (150, [nan, 1.0, 1.0], 1), (200, [inf, 1.0, 1.0], 1), (250, [1.0, None, 1.0], 1),
        (300, [1.0, 2.0], 1), (-50, [-1.0] * 5, 1), (None, [2.0, 2.0, 2.0], 1), (7, v, 1), (8, v, 1), (9, v, 1), (350, [3.0e6, 1.0], 1), (10, [0.0, 0.0, 0.0], 1),
    ]
    check(spark, rows)


def test_equal_vectors_tie_to_the_smaller_id(spark):
    check(spark, [(i, [1.0, 1.0], 0) for i in range(120)])


def test_few_rows_and_empty_table(spark):
    check(spark, [(0, [1.0], 0)])
    check(spark, [(0, [1.0], 0), (1, [2.0], 0)])
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.search(empty).count() == 0
    assert topk.search(spark.createDataFrame([(3, [1.0], 0)], SCHEMA).withColumn("id", F.lit(1))).count() == 0


def shares(x, queries, k=5):
    """Results of a block against all products, and the share of candidates evaluated."""
    pivots = topk.choose_pivots(x[:500])
    norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    place = topk.places(norm, topk._distances(x, pivots), pivots).astype(np.float32)
    rows = np.arange(len(x))
    seen = 0
    for i, best, score, evaluated in topk.block_top(x[:queries], rows[:queries], place[:queries], x, rows, place, k):
        full = x @ x[i]
        full[i] = -(2**60)
        want = np.lexsort((rows, -full))[:k]
        assert best.tolist() == want.tolist() and score.tolist() == full[want].tolist()
        seen += evaluated
    return seen / (queries * len(x))


def test_the_bound_stops_early():
    """Clustered vectors: most candidates are never evaluated."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 2000
    assert shares(np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64), 40) < 0.2


def test_the_bound_stops_early_without_clusters():
    """Unit vectors in all directions, where differences of single distances exclude nothing."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    assert shares(np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64), 40) < 0.5


def test_places_bound_every_product():
    """Products never exceed the bound, also where vectors depend on each other or are zero."""
    rng = np.random.default_rng(6)
    thin = rng.integers(-500, 500, (300, 3)) @ rng.integers(-9, 9, (3, 12))
    for x in (thin, rng.integers(-300, 300, (300, 70)), np.zeros((9, 4), np.int64), np.repeat(thin[:1], 20, axis=0)):
        pivots = topk.choose_pivots(x)
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        place = topk.places(norm, topk._distances(x, pivots), pivots)
        assert (x @ x.T <= place @ place.T + topk.SLACK * np.outer(norm, norm) + 1).all()


def test_products_beyond_64_bits_are_the_nearest_integer(spark):
    """Long components: exact while products fit into 64 bits, the nearest 64-bit integer beyond."""
    big = float(2**22)
    check(spark, [(0, [big, 1.0], 0), (1, [big, -2.0], 0), (2, [-big, 3.0], 0), (3, [1.0, 1.0], 0)])
    huge = [(0, [1e30, 1.0], 0), (1, [1e30, 0.0], 0), (2, [-1e30, 0.0], 0), (3, [0.0, 2.0], 0)]
    got = [(r.vec_id, r.score) for r in topk.search(spark.createDataFrame(huge, SCHEMA)).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 256 * 512), (2, -(2**63))]
