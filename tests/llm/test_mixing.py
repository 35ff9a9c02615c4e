import re
from collections import defaultdict

from wardflow.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    """Shares by weight, the excess of capped sources dealt out again."""
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    free, left, target = set(sizes), sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = plain_targets(dict(sizes))
    source = {r.doc_id: r.source for r in rows}
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for g in got:
        assert 0 <= g.taken <= 3 * g.size and g.source_size == sizes[source[g.doc_id]]
        assert abs(g.target - want[source[g.doc_id]]) < 1e-6
        taken[source[g.doc_id]] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    again = sorted((g.doc_id, g.taken) for g in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((g.doc_id, g.taken) for g in got)
    out = mixing.realised(docs).collect()
    made = defaultdict(int)
    texts = defaultdict(set)
    for r in rows:
        texts[r.doc_id].add(r.text or "")
    for r in out:
        made[source[r.doc_id]] += len(words(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
    assert {s: n for s, n in made.items() if n} == {s: n for s, n in taken.items() if n}


def test_small_table(small_docs):
    check(small_docs)


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs)
    assert mixing.mix(no_docs).count() == 0 and mixing.realised(no_docs).columns == no_docs.columns


def test_ranges_hot_source_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rows = [(i, " ".join(["w"] * (i % 9)), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(300)]
    rows += [(1000, " \n a b  c\td ", "en", "tiny", 0), (1001, None, "en", "none", 0), (1002, "x", "en", None, 0)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
