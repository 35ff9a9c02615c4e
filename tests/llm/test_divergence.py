"""Shares, distances and ranks against plain Python, and against the SQL on whole tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import TEXTS
from tests.oracle import compare, connect
from wardflow.llm import divergence, queries
from wardflow.llm.oracles import CHECKS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    """Rows ``(lang, source, part, item, value, rank)`` by plain integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in [[x or "" for x in r] for r in rows]:
        found = [t.translate(LOWER) for t in TERM.findall(text)]
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        every = sum((counts[lang, s] for s in sources), Counter())

        def share(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:10])]
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == brute(rows)


@pytest.fixture()
def small_parts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 300)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 7)
    monkeypatch.setattr(divergence, "CELLS", 11)


def some_rows(seed, n=160):
    rng = np.random.default_rng(seed)
    stock = ["a", "Abc", "abC", "éclair", "漢字漢字漢字", "exactly8", "exactly8b", "sixteenletterslo", "seventeenletterslo", "word", "x" * 40, "X" * 65, "y" * 300, "ß", "ÉCOLE", "naïve"]
    rows = []
    for i in range(n):
        words = rng.choice(stock, rng.integers(0, 30), p=np.arange(1, 17) / 136)
        rows.append((rng.choice(["en", "de", ""]), f"s{rng.integers(0, 4) if i % 3 else 0}", rng.choice([" ", "-1\n", "_"]).join(words)))
    return rows


def test_against_plain_integers(spark):
    check(spark, some_rows(1))


def test_small_slices_and_buckets(spark, small_parts):
    check(spark, some_rows(2))


def test_nulls_ties_and_lone_groups(spark):
    rows = [(None, None, None), (None, "s", ""), ("en", None, "tie knot " * 3)] + [("en", f"s{i % 3}", "knot tie both") for i in range(12)]
    rows += [("fr", "only", "un deux")] * 11 + [("es", "a", "raro"), ("es", "b", None)]
    check(spark, rows)
    check(spark, rows * 2)


def test_long_and_odd_texts(spark):
    check(spark, [("en", f"s{i % 2}", t) for t in TEXTS for i in range(12)])


def test_empty_table_and_other_columns(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [("x", 1, 2.0, "en", f"s{i % 2}", "some words here", "k") for i in range(20)]
    docs = spark.createDataFrame(rows, "term string, n long, docs double, lang string, source string, text string, bucket string")
    assert divergence.audit(docs).count() == 2


def test_packed_order_is_byte_order():
    words = sorted({bytes(w) for w in np.random.default_rng(3).integers(97, 255, (400, 5)).astype(np.uint8)} | {b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop"})
    data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    mixed = np.random.default_rng(4).permutation(len(words))
    order = divergence.radix_order(divergence.packed_words(data, start[mixed], size[mixed], 2))
    assert mixed[order].tolist() == list(range(len(words)))


def test_large_shares_are_exact(spark):
    row = spark.range(1).select(divergence.share("9000000000000000000L", "9100000000000000000L", "17L").alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**18 + 2) // (91 * 10**17 + 34)


def test_same_rows_as_sql(spark, folder):
    con = connect(folder)
    assert compare(queries.QUERIES["op13_source_divergence"](spark, folder), con, CHECKS["op13_source_divergence"]) is None


def test_counts_leave_a_task_once_for_each_group_and_term():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["a", "b", "a"]), pa.array(["x y x", "x", "Y y"])], names=["lang", "source", "text"])
    rows = [r for b in divergence.count_terms(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["source"], r["term"], r["n"], r["docs"]) for r in rows) == [("a", "x", 2, 1), ("a", "y", 3, 2), ("b", "x", 1, 1)]
