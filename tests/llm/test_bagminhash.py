import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import bagminhash
from wardflow.llm.octets import slices


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def brute(rows):
    bags = [bag(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def check(docs):
    rows = docs.collect()
    roots = brute(rows)
    want = {}
    for r, root in zip(rows, roots):
        want.setdefault(root, []).append(r.doc_id)
    expected = sorted((d, min(c), len(c)) for c in want.values() for d in c)
    got = bagminhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    assert {r.doc_id for r in got if r.kept} == {min(c) for c in want.values()}
    kept = [r.doc_id for r in bagminhash.unique_documents(docs).collect()]
    assert sorted(kept) == sorted(min(c) for c in want.values())


def test_against_brute_force(small_docs):
    check(small_docs)


def test_edge_rows(edge_docs):
    check(edge_docs)


def test_chain_and_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(40):  # each differs from the first in two words, and from the others in four
        copy = list(base)
        for k in rng.sample(range(200), 2):
            copy[k] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for k in range(6):  # a chain whose ends are not similar
        texts.append(" ".join([f"z{i}" for i in range(k * 8, k * 8 + 120)]))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))


def test_components_estimate_weighted_jaccard():
    a = "p q r s t " * 9 + " ".join(f"a{i}" for i in range(30))
    b = "p q r s t " * 5 + " ".join(f"a{i}" for i in range(20)) + " c d e f g"
    t = next(slices(pa.array([a, b])))[2]
    true = similarity(bag(a), bag(b))
    owner, gram, weight = bagminhash.shingles(t)
    assert bagminhash.overlap(next(slices(pa.array([a])))[2], next(slices(pa.array([b])))[2])[0] == pytest.approx(true)
    shares = []
    for salt in range(40):
        s = bagminhash.signatures(owner, gram + np.full(1, salt * 7919 + 1, np.uint64), weight.astype(float), 2)
        assert np.isfinite(s).all()
        shares.append((s[0] == s[1]).mean())
    error = (true * (1 - true) / (40 * bagminhash.COMPONENTS)) ** 0.5
    assert abs(np.mean(shares) - true) < 4 * error


def test_empty_table(no_docs):
    assert bagminhash.near_duplicates(no_docs).count() == 0
    assert bagminhash.unique_documents(no_docs).columns == no_docs.columns
