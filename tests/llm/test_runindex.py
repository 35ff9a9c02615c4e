import hashlib

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import runindex
from wardflow.llm.blocks import to_blocks_of


def brute(rows, length=50):
    first = {}
    for r in rows:
        data = (r.text or "").encode()
        key = runindex.LARGEST if r.doc_id is None else r.doc_id
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if first.get(w, key) >= key:
                first[w] = key
    out = []
    for r in rows:
        data = (r.text or "").encode()
        key = runindex.LARGEST if r.doc_id is None else r.doc_id
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        out.append((str(r.doc_id), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs):
    got = runindex.deduplicated(docs).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert mine == brute(docs.collect())


def test_small_table(small_docs):
    check(small_docs)


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs)
    assert runindex.deduplicated(no_docs).count() == 0


def test_repetitive_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(runindex, "TEXT_BYTES", 2000)
    monkeypatch.setattr(runindex, "PART_BYTES", 3000)
    monkeypatch.setattr(runindex, "INDEX_BYTES", 500)
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("abé \n"), 600))
    rows = []
    for i in range(60):
        t = list(base[int(rng.integers(0, 100)) : int(rng.integers(300, 600))])
        for k in rng.integers(0, len(t), int(rng.integers(0, 4))):
            t[k] = str(rng.choice(list("abcdxyz\0")))
        rows.append((int(rng.integers(0, 40)), "".join(t)))
    rows += [(None, base), (None, base[:200]), (5, "q" * 400), (6, "q" * 300 + "ab" * 100), (7, "ab" * 90), (8, base[:49]), (-3, base[100:149]), (2, base[100:150])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


@pytest.mark.parametrize("alphabet", [1, 2, 4, 256])
def test_index_against_plain_search(alphabet):
    rng = np.random.default_rng(alphabet)
    base = rng.integers(0, alphabet, 300).astype(np.uint8)
    strings = []
    for _ in range(80):
        a = int(rng.integers(0, 200))
        s = base[a : a + int(rng.integers(50, 85))].copy()
        if rng.random() < 0.5:
            s[int(rng.integers(0, len(s)))] = rng.integers(0, alphabet)
        strings.append(s)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    value = rng.integers(0, 1000, len(strings))
    got = runindex.least_values(np.concatenate(strings), offsets, value)
    least = {}
    for s, v in zip(strings, value):
        for i in range(len(s) - 49):
            w = s[i : i + 50].tobytes()
            least[w] = min(least.get(w, v), v)
    assert got.tolist() == [least[s[i : i + 50].tobytes()] for s in strings for i in range(len(s) - 49)]
    index = runindex.RunIndex(np.concatenate(strings), offsets, value)
    assert len(index.start) <= offsets[-1]


def test_indexes_by_anchor_give_the_same():
    rng = np.random.default_rng(9)
    strings = [rng.integers(0, 2, int(rng.integers(50, 84))).astype(np.uint8) for _ in range(60)]
    data, length = np.concatenate(strings), np.array([len(s) for s in strings])
    anchor, value = rng.integers(0, 7, 60), rng.integers(0, 99, 60)
    old, runindex.INDEX_BYTES = runindex.INDEX_BYTES, 300
    try:
        got = runindex.least_by_anchor(data, length, anchor, value)
    finally:
        runindex.INDEX_BYTES = old
    at = np.cumsum(length - 49) - (length - 49)
    for a in range(7):
        mine = np.flatnonzero(anchor == a)
        want = runindex.least_values(np.concatenate([strings[i] for i in mine]), np.concatenate([[0], np.cumsum(length[mine])]), value[mine])
        assert np.concatenate([got[at[i] : at[i] + length[i] - 49] for i in mine]).tolist() == want.tolist()


def asked_bytes(rows):
    """Bytes that a block of texts sends to the index, beside those of heads and documents."""
    docs = pa.table({"doc_id": [i for i, _ in rows], "unused": [0] * len(rows), "text": [t for _, t in rows]})
    (block,) = list(to_blocks_of(1 << 30)(iter(docs.combine_chunks().to_batches())))
    block = pa.table({"block": block.column(0), "texts": block.column(2)})
    batches = list(runindex._ask_anchors(1)(iter(block.to_batches())))
    answers = runindex._answer_anchors(pa.Table.from_batches(batches))
    asked = runindex._ask_contexts(1)((), block, answers)
    if len(asked):
        answers = pa.concat_tables([answers, runindex._answer_contexts(asked)])
    return sum(len(b) for b in runindex._ask_bytes(1)((), block, answers).column("one").to_pylist())


def test_short_common_phrases_do_not_reach_the_index():
    """Phrases that are shorter than a window and in many documents repeat nothing, however many documents there are."""
    rng = np.random.default_rng(3)
    phrase = "in the course of the day"
    said = lambda: "".join(rng.choice(list("abcdefghijklmnop "), 60))
    rows = [(i, "".join(said() + phrase for _ in range(20))) for i in range(40)]
    assert asked_bytes(rows) == 0
    copied = rows[0][1][100:400]
    assert asked_bytes([*rows, (40, said() + copied + said())]) > 0


def test_a_hot_anchor_is_cut_into_small_indexes(monkeypatch):
    """One line that follows many different ones: its contexts are all different and have one anchor."""
    monkeypatch.setattr(runindex, "INDEX_BYTES", 2000)
    monkeypatch.setattr(runindex, "SLICE_BYTES", 5000)
    rng = np.random.default_rng(4)
    line = rng.integers(97, 123, 40).astype(np.uint8)
    strings = [np.concatenate([rng.integers(97, 100, int(rng.integers(10, 25))).astype(np.uint8), line]) for _ in range(1500)]
    data, length = np.concatenate(strings), np.array([len(s) for s in strings])
    value = rng.integers(0, 1000, len(strings))
    want = runindex.least_values(data, np.concatenate([[0], np.cumsum(length)]), value)
    largest = []
    build = runindex.least_values
    monkeypatch.setattr(runindex, "least_values", lambda d, o, v: largest.append(len(d)) or build(d, o, v))
    got = runindex.least_by_anchor(data, length, np.zeros(len(strings), np.uint64), value)
    assert got.tolist() == want.tolist()
    assert sum(length) > 20 * runindex.INDEX_BYTES and max(largest) < 4 * runindex.INDEX_BYTES
