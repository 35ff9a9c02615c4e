import re

from wardflow.llm import linededup


def brute(rows):
    """Kept text of every document by comparing every line with all earlier ones."""
    lines = []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        for i, line in enumerate((r.text or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if words:
                lines.append(((r.doc_id is not None, r.doc_id or 0, i), words))
    gone = set()
    for place, words in lines:
        for other, w in lines:
            if other >= place:
                break
            if 4 * max(len(w), len(words)) <= 5 * min(len(w), len(words)) and 9 * len(words & w) >= 4 * (len(words) + len(w)):
                gone.add(place)
                break
    return gone


def check(docs):
    rows = docs.collect()
    gone = brute({(r.doc_id, r.text): r for r in rows}.values())
    out = linededup.deduplicated(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        source = next(s for s in rows if s.doc_id == r.doc_id)
        if source.text is None:
            assert r.text is None and r.n_lines == r.n_removed == 0
            continue
        lines = source.text.split("\n")
        mine = [line for i, line in enumerate(lines) if (r.doc_id is not None, r.doc_id or 0, i) not in gone]
        assert r.text == "\n".join(mine)
        assert r.n_removed == len(lines) - len(mine)
        assert r.n_lines == sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in lines)


def test_against_brute_force(small_docs):
    check(small_docs)


def test_edge_rows(edge_docs):
    check(edge_docs)


def test_near_lines_ties_and_nulls(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(i, "\n".join([" ".join(base[:18] + [f"x{i}", f"y{i}"]), f"own {i} line", "a b c d", "d c b a a"])) for i in range(30)]
    rows += [(None, "a b c d\nonly here"), (99, "   \n\t\n"), (100, "\n" * 200 + "a b c d e\n" + "a b c d e f")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_empty_table_and_extra_columns(no_docs, spark):
    out = linededup.deduplicated(no_docs)
    assert out.count() == 0 and out.columns == [*[c for c in no_docs.columns if c != "text"], "text", "n_lines", "n_removed"]
    odd = spark.createDataFrame([(1, "a b\na b", 5, "u")], "doc_id long, text string, line int, uid string")
    assert linededup.deduplicated(odd).first().asDict() == {"doc_id": 1, "text": "a b", "line": 5, "uid": "u", "n_lines": 2, "n_removed": 1}


def test_neighbouring_size_classes_in_passes(spark, monkeypatch):
    """Pairs whose sizes lie on both sides of a bound of classes are found, in every pass, either one being first."""
    monkeypatch.setattr(linededup, "PASS_SETS", 0)
    rows = []
    for k, (n, m) in enumerate([(4, 5), (5, 6), (12, 15), (13, 15), (14, 15), (30, 36), (34, 37), (70, 87), (80, 90), (48, 49), (44, 55)]):
        words = [f"t{k}w{i}" for i in range(m)]
        pair = [" ".join(words[:n]), " ".join(words)]
        rows += [(10 * k, pair[k % 2]), (10 * k + 1, pair[1 - k % 2]), (10 * k + 2, "  " + "\t".join(words[: n * 3 // 4]) + "  x ")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_a_pair_of_near_copies_is_one_candidate(spark):
    """Not one for each direction and each shared word."""
    base = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(20)], "doc_id long, text string")
    lines = linededup._sets(linededup._identified(docs), "text")
    sets = lines.withColumn("lines", linededup.F.lit(1)).localCheckpoint()
    none = sets.filter("false").select("uid", "line")
    pairs = [{(r.lu, r.ll), (r.eu, r.el)} for r in linededup._joined(sets, none).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) == 20 * 19 // 2


def test_the_left_side_of_the_join_has_only_words_that_may_lead(spark):
    """Above an exchange that both sides share, not below it."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    sets = linededup._sets(linededup._identified(docs), "text").localCheckpoint()
    n, p = linededup.F.col("n").cast("long"), linededup.F.col("p").cast("long")
    placed = sets.select("*", linededup.F.posexplode("prefix").alias("p", "w"))
    rows = placed.select("doc", "uid", "line", "mark0", "mark1", n.bitwiseOR(linededup.F.shiftleft(p, 30)).alias("x"), linededup.F.hash("w").alias("t")).localCheckpoint()
    plan = linededup._met(rows.repartition("t"))._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Filter .*9.*\n.*Exchange hashpartitioning\(t#\d+", plan), plan


def test_odd_blanks_and_marks_of_large_sets(spark):
    """Words are split as by the separators; the bitmaps never tell more than the words that differ."""
    rows = [(k, " ".join(f"w{i}" for i in range(k, 120))) for k in range(0, 90, 9)]
    rows += [(200, "\ta\x0bb  c \r\n  \t \n a b c\x0c"), (201, "c\tb\ta \r\n\r\nd  e"), (202, "e d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(docs)
    sets = linededup._sets(linededup._identified(docs), "text").collect()
    words = {(r.doc, r.line): set(re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc].split("\n")[r.line])) for r in sets}
    for a in sets:
        assert a.n == len(words[a.doc, a.line])
        for b in sets:
            marks = [a.mark0 ^ b.mark0, a.mark1 ^ b.mark1]
            if min(a.n, b.n) <= linededup.LARGE:
                marks = [marks[0] ^ marks[1]]
            apart = sum((m & (1 << 64) - 1).bit_count() for m in marks)
            assert apart <= len(words[a.doc, a.line] ^ words[b.doc, b.line])
