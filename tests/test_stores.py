"""Written tables: runs that are started again, parts that are left alone, failures half way."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators import maintenance as dm
from wardflow.operators import sinks
from wardflow.sources.stores import KEYLESS, KeyedTable, RunTable
from wardflow.sources.trigrams import TextIndex

SCHEMA = T.StructType().add("k", "long").add("v", "string").add("n", "integer")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path, rows, width=10):
    made = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", width)
    made.create(spark.createDataFrame(rows, SCHEMA))
    return made


def frame(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def test_runs_are_added_and_replaced(spark, tmp_path):
    log = RunTable(spark, str(tmp_path / "log"), SCHEMA)
    assert log.read().count() == 0 and log.runs() == []
    log.add(frame(spark, [(1, "a")]), 1)
    log.add(frame(spark, [(2, "b"), (3, None)]), 2)
    log.add(frame(spark, [(2, "c")]), 2)
    assert rows_of(log.read()) == [(1, "a", None), (2, "c", None)]
    assert rows_of(log.read(before=2)) == [(1, "a", None)]
    log.add(frame(spark, []), 2)
    assert log.runs() == [1] and log.read().count() == 1


def test_columns_in_another_order_and_type(spark, tmp_path):
    log = RunTable(spark, str(tmp_path / "log"), SCHEMA)
    log.add(spark.createDataFrame([("a", "7", 1.0)], "v string, n string, k double"), 1)
    assert rows_of(log.read()) == [(1, "a", 7)]


def test_keys_go_on_and_stay(spark, tmp_path):
    log = RunTable(spark, str(tmp_path / "log"), SCHEMA)
    sinks.append_run(log, frame(spark, [("b",), ("a",)], "v string"), "k", ["v"], 1)
    sinks.append_run(log, frame(spark, [("d",), ("c",)], "v string"), "k", ["v"], 2)
    want = [(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", None)]
    assert rows_of(log.read()) == want
    sinks.append_run(log, frame(spark, [("b",), ("a",)], "v string"), "k", ["v"], 1)
    sinks.append_run(log, frame(spark, [("d",), ("c",)], "v string"), "k", ["v"], 2)
    assert rows_of(log.read()) == want


def test_only_touched_parts_are_read_and_written(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "old", i) for i in range(100)])
    seen = []

    def change(rows, chg):
        seen.append((rows._jdf.queryExecution().executedPlan().toString(), rows.inputFiles()))
        return dm.update_by_key(rows, chg, "k", ["v"])

    before = t.live()
    t.rewrite(frame(spark, [(42, "new")]), change, 1)
    plan, files = seen[0]
    assert "(_part" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert files and all("/_part=4/" in f for f in files)
    changed = {p for p, at in t.live().items() if before[p] != at}
    assert changed == {4}
    assert rows_of(t.read().where("v = 'new'")) == [(42, "new", 42)] and t.read().count() == 100


def test_same_rows_as_a_rewrite_of_the_whole_table(spark, tmp_path):
    rows = [(i if i % 7 else None, f"v{i}", i) for i in range(60)]
    chg = frame(spark, [(3, "x"), (55, None), (200, "far"), (None, "lost")])
    for i, operator in enumerate((dm.upsert, dm.insert_missing, dm.delete_by_key)):
        t = table(spark, tmp_path / str(i), rows)
        want = operator(spark.createDataFrame(rows, SCHEMA), chg, "k") if operator is dm.delete_by_key else None
        if operator is dm.upsert:
            want = dm.upsert(spark.createDataFrame(rows, SCHEMA), chg.withColumn("n", F.lit(None).cast("int")), "k")
            got = sinks.stored_change(t, chg.withColumn("n", F.lit(None).cast("int")), operator, 1, key="k")
        else:
            want = want if want is not None else operator(spark.createDataFrame(rows, SCHEMA), chg, "k")
            got = sinks.stored_change(t, chg, operator, 1, key="k")
        assert rows_of(got) == rows_of(want)


def test_a_run_started_again_counts_once(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "a", 0) for i in range(30)])
    raised = lambda rows, chg: rows.join(chg, "k", "left_semi").withColumn("n", F.col("n") + 1).unionByName(rows.join(chg, "k", "left_anti"))
    for run in (1, 1, 2, 2, 2):
        t.rewrite(frame(spark, [(5, ""), (25, "")]), raised, run)
    assert rows_of(t.read().where("n > 0").select("k", "n")) == [(25, 2), (5, 2)]
    with pytest.raises(ValueError):
        t.rewrite(frame(spark, [(5, "")]), raised, 1)


def test_a_failed_run_leaves_the_table_as_it_was(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "a", i) for i in range(30)])
    want = rows_of(t.read())
    broken = lambda rows, chg: rows.withColumn("v", F.when(F.col("k") < 15, F.lit("b")).otherwise(F.raise_error("half way")))
    with pytest.raises(Exception, match="half way"):
        t.rewrite(frame(spark, [(5, ""), (25, "")]), broken, 1)
    assert rows_of(t.read()) == want
    with pytest.raises(Exception, match="moved out"):
        t.rewrite(frame(spark, [(5, "")]), lambda rows, chg: rows.withColumn("k", F.col("k") + 1000), 1)
    assert rows_of(t.read()) == want
    t.rewrite(frame(spark, [(5, "")]), lambda rows, chg: rows.withColumn("v", F.lit("b")), 1)
    assert t.read().where("v = 'b'").count() == 10


def test_parts_that_become_empty_and_come_back(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "a", i) for i in range(20)])
    t.rewrite(frame(spark, [(i, "") for i in range(10)]), lambda rows, chg: dm.delete_by_key(rows, chg, "k"), 1)
    assert sorted(r.k for r in t.read().collect()) == list(range(10, 20)) and 0 not in t.live()
    insert = lambda rows, chg: dm.insert_missing(rows, chg, "k")
    t.rewrite(frame(spark, [(4, "back"), (None, "keyless"), (-3, "low")]), insert, 2)
    assert rows_of(t.read().where("n is null")) == [(-3, "low", None), (4, "back", None), (None, "keyless", None)]
    assert set(t.live()) == {KEYLESS, -1, 0, 1}


def test_no_changes_and_an_empty_table(spark, tmp_path):
    t = table(spark, tmp_path, [])
    assert t.read().count() == 0
    t.rewrite(frame(spark, []), lambda rows, chg: dm.insert_missing(rows, chg, "k"), 1)
    assert t.read().count() == 0
    t.rewrite(frame(spark, [(1, "a")]), lambda rows, chg: dm.insert_missing(rows, chg, "k"), 2)
    assert rows_of(t.read()) == [(1, "a", None)]


def test_superseded_files_go_and_rows_stay(spark, tmp_path):
    t = table(spark, tmp_path, [(i, "a", i) for i in range(30)])
    for run in (1, 2):
        t.rewrite(frame(spark, [(5, "x")]), lambda rows, chg: dm.update_by_key(rows, chg, "k", ["v"]), run)
    want = rows_of(t.read())
    assert t.drop_superseded() == 2 and rows_of(t.read()) == want
    assert len(list((tmp_path / "t" / "rows").glob("_part=*/_at=*"))) == 3


def test_index_opens_only_parts_that_can_contain_a_text(spark, tmp_path):
    texts = [None, "", "ab", "abc", "xabcx", "sugar cane", "cane sugar", "100% _x_", "سلام دنیا"]
    rows = [(i, texts[i // 10 % len(texts)], i) for i in range(120)]
    t = table(spark, tmp_path, rows)
    index = TextIndex(spark, str(tmp_path / "index"), t, ["v"])
    index.build()
    for text in ("abc", "cane s", "sugar", "zzz", "ab", "% _", "لام د", "", "canesugar"):
        want = sorted(r for r in rows if r[1] is not None and text in r[1])
        assert sorted(map(tuple, index.search(text).collect())) == want, text
    opened = index.search("cane s").inputFiles()
    assert {f.split("/_part=")[1].split("/")[0] for f in opened} == {"6"}
    t.rewrite(frame(spark, [(3, "now with sugar cane")]), lambda r, chg: dm.update_by_key(r, chg, "k", ["v"]), 1)
    index.extend(frame(spark, [(3, "now with sugar cane")]), 1)
    assert 3 in {r.k for r in index.search("sugar cane").collect()}
