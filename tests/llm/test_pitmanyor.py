import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from wardflow.llm import pitmanyor as lm


def plain_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def check(docs):
    rows = docs.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r) for w in plain_tokens(r.text))
    n, v = sum(count.values()), len(count)
    base = lambda tokens: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
    want = [(r.doc_id is None, r.doc_id or 0, len(plain_tokens(r.text)), base(plain_tokens(r.text)), held(r), sum(count[w] > 0 for w in plain_tokens(r.text))) for r in rows]
    got = lm.score(docs).collect()
    mine = [(g.doc_id is None, g.doc_id or 0, g.n_tokens, g.base_score, g.held_out, g.n_known) for g in got]
    order = lambda x: (*x[:3], round(x[3], 6))
    assert len(mine) == len(want)
    for g, w in zip(sorted(mine, key=order), sorted(want, key=order)):
        assert (*g[:3], *g[4:]) == (*w[:3], *w[4:]) and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
    assert all(g.train_tokens == n and g.score <= 1e-9 and math.isfinite(g.score) for g in got)
    return got


def test_base_and_held_out_perplexity(small_docs):
    got = check(small_docs)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_extra_columns(small_docs):
    """Columns named like those used inside do not matter."""
    docs = small_docs.limit(20).selectExpr("doc_id", "text", "1 AS held", "'x' AS block", "2 AS part", "3 AS word", "4 AS sums", "5 AS n")
    check(docs)


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs)
    assert lm.score(no_docs).count() == 0


def test_only_held_out_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    check(spark.createDataFrame([(i, "a b") for i in ids] + [], "doc_id long, text string"))


def test_null_ids_and_block_cuts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "PART_BYTES", 200)
    rows = [(None if i % 9 == 0 else i, f"the w{i % 4} the w{i % 7} Of x{i}") for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def hash_of(*words):
    return np.unique(lm._tokens(pa.table({"text": list(words)}))[0])


def of(rows, column, value):
    return rows.filter(pc.equal(rows.column(column), value))


def passes(table, parts, hot):
    """All passes without Spark over one block: its tokens, and the numbers it is told."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    batch = pa.RecordBatch.from_pydict({"block": [1], "texts": [sink.getvalue().to_pybytes()]})
    asked = pa.Table.from_batches(list(lm._asker(parts, hot)(iter([batch]))))
    summed = lambda rows: np.sum([v for v in rows.column("sums").to_pylist() if v], axis=0)
    words = pa.Table.from_batches(list(lm._lister(parts, hot)(iter([batch]))))
    sent = pa.concat_tables([lm._first_pass(parts, hot)(of(asked, "part", k)) for k in range(parts) if len(of(asked, "part", k))])
    totals = lm.Totals(hot, summed(sent), parts)
    replies = pa.concat_tables([lm._parent_pass(totals)(of(sent, "home", k)) for k in range(parts) if len(of(sent, "home", k))])
    totals.take_parent(summed(replies))
    drawn = pa.concat_tables([lm._second_pass(totals)(of(asked, "part", k), of(replies, "part", k)) for k in range(parts)])
    totals.take_tables(summed(drawn))
    final = [lm._final_parent(totals)(of(words, "part", k), of(drawn, "home", k)) for k in range(parts) if len(of(words, "part", k)) + len(of(drawn, "home", k))]
    parents = pa.concat_tables(final)
    totals.take_parent(summed(parents))
    answers = pa.concat_tables([of(drawn, "block", 1), of(parents, "block", 1)], promote_options="default")
    tokens = lm.Tokens(table, parts, hot)
    return tokens, *lm._told(tokens, answers, totals), totals


@pytest.mark.parametrize("hots", [[], ["w1", "w2"]])
def test_probabilities_sum_to_one(hots):
    """In every context, hot or not, the known words and one unknown word share a mass of one."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 50) for _ in range(60)]
    known = sorted({w for t in texts for w in t.split()})
    # held-out texts hold all pairs; an unseen context is among them
    others = [f"{u} {w}" for u in [*known, "never"] for w in [*known, "never"]] + ["", *known]
    table = pa.table({"doc_id": list(range(len(texts) + len(others))), "held": [False] * len(texts) + [True] * len(others), "text": texts + others})
    t, count, probability, totals = passes(table, 3, hash_of(*hots) if hots else np.zeros(0, lm.U))
    assert t.hot.any() == bool(hots)
    for u in range(len(t.word)):
        mine = t.context == u
        assert mine.sum() == len(known) + 2 and probability[mine].sum() == pytest.approx(1, abs=1e-4)
    tokens = Counter(w for x in texts for w in plain_tokens(x))
    assert sorted(count) == sorted([*tokens.values(), 0]) and totals.tokens == sum(tokens.values())


def test_the_word_before_counts():
    """The same word after two contexts: likely after the one that it follows, unlikely after the other."""
    texts = ["new york"] * 30 + ["dark night"] * 30 + ["new night", "dark york"]
    table = pa.table({"doc_id": list(range(62)), "held": [False] * 60 + [True] * 2, "text": texts})
    t, _, probability, _ = passes(table, 4, np.zeros(0, lm.U))
    new, york, dark = (int(np.flatnonzero(t.word == h)[0]) for h in (lm._tokens(pa.table({"text": [w]}))[0][0] for w in ("new", "york", "dark")))
    p = {(u, w): float(q) for u, w, q in zip(t.context, t.second, probability)}
    assert p[new, york] > 0.9 and p[dark, york] < 0.1


def test_hot_words_change_nothing_but_the_draws(spark, small_docs, monkeypatch):
    """Without hot words, and with many: the same base scores, and nearly the same held-out score."""
    scores = []
    for least in (1, 64, 4096):
        monkeypatch.setattr(lm, "HOT_LEAST", least)
        rows = lm.score(small_docs).collect()
        scores.append((sum(r.score for r in rows if r.held_out), sum(r.base_score for r in rows)))
    for s, base in scores[1:]:
        assert s == pytest.approx(scores[0][0], rel=0.01) and base == pytest.approx(scores[0][1], rel=1e-9)


def test_frequent_words(spark):
    """Words above the share are found, over blocks, and only few others."""
    texts = ["a b " * 50 + " ".join(f"x{i}-{k}" for k in range(100)) for i in range(20)]
    docs = spark.createDataFrame([(i, False, x) for i, x in enumerate(texts)], "doc_id long, held boolean, text string").repartition(4)
    blocks = docs.mapInArrow(lm.to_blocks_of(3000), "block long, bytes long, texts binary").cache()
    assert set(lm.hot_words(blocks, 50).tolist()) >= set(hash_of("a", "b").tolist()) - {int(lm.END)}
    assert len(lm.hot_words(blocks, 50)) <= 100


def test_forward_runs_follow_the_restaurant_process():
    """Mean number of tables against a customer-by-customer simulation."""
    rng = np.random.default_rng(3)
    for pull, discount, customers in ((0.7, 0.5, 60), (4.0, 0.3, 200), (80.0, 0.4, 400)):
        tables, _ = lm._seat_once(np.full(3000, float(customers)), np.full(3000, pull), discount, rng)
        t = np.ones(3000)
        for j in range(1, customers):
            t += rng.random(3000) < pull / (pull + j - discount * t)
        assert tables.mean() == pytest.approx(t.mean(), rel=0.04)


def test_seating_follows_its_conditional():
    """Three customers: the exact conditional over one to three tables."""
    pull, d = 1.3, 0.4
    weight = {1: (1 - d) * (2 - d), 2: pull * ((1 - d) + (2 - 2 * d)), 3: pull**2}
    rng = np.random.default_rng(5)
    old = lm.RUNS
    try:
        lm.RUNS = 30
        t = lm.seat(np.full(20000, 3.0), np.full(20000, pull), d, rng)
    finally:
        lm.RUNS = old
    share = np.array([np.mean(t == k) for k in weight])
    assert np.allclose(share, np.array(list(weight.values())) / sum(weight.values()), atol=0.015)
