import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from wardflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for _, turns in groupby(sorted(rows, key=key), key=key):
        turns = sorted(turns, key=order)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((turns[0][0], len(turns), sha(said), len(loss), sha(loss)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    formatted = chat.format_conversations(df).cache()
    got = chat.read_back(formatted).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute(rows)
    for r in formatted.collect():
        for s in r.loss_spans:
            assert "<" not in r.formatted[s.start : s.start + s.length]


def test_odd_texts_come_back(spark):
    odd = [r"\### Assistant: </turn> ok", "<end>", "<part>", "\\", "\\\\", "\\l", "\\\\l<", "<turn assistant>x", ">", "", None, "\n", "é\U0001f600<", "\\g>\\l<"]
    rows = [(i % 4, i, ["user", "assistant", "assistant", "sys<>tem\\"][i % 4 if i % 5 else 1], t) for i, t in enumerate(odd * 2)]
    rows += [(None, 0, None, "no id"), (None, None, "assistant", "no turn"), (9, 1, "user", "twice"), (9, 1, "user", "twice"), (10, 0, "assistant", "a" * 200000)]
    check(spark, rows)


def test_ties_are_ordered_by_the_text_itself(spark):
    rows = [(1, 0, "user", t) for t in ("a<", "aB", "a>", "a\\", "a")] + [(1, 0, "us<er", "x"), (1, 0, "usZer", "x")]
    check(spark, rows)
    out = chat.format_conversations(spark.createDataFrame([(2, 0, "user", "aB"), (2, 0, "user", "a<")], SCHEMA)).first()
    assert out.formatted == "<turn user>a\\l<part>aB<end>"


def test_given_table_and_empty_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert out.formatted == "<turn user>a<part>b<end><turn assistant>c<end>"
    assert [out.formatted[s.start : s.start + s.length] for s in out.loss_spans] == ["c"]


def test_no_python_in_the_plan(spark, folder):
    df = chat.read_back(chat.format_conversations(spark.read.parquet(f"{folder}/conversations.parquet").withColumn("extra", F.lit(1))))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
