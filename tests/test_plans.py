"""What the physical plans must not contain, for every registered query."""

import re

import pytest

from wardflow.bindings import catalog

QUERIES = {name: catalog.bound(name) for name in catalog.QUERIES}
FORBIDDEN = r"PythonUDF|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pair_joins(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert not re.search(FORBIDDEN, plan), plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["ag_05_has_all"](spark, folder))
    assert "PushedFilters: [In(o_orderpriority" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan


def test_pivot_needs_one_shuffle(spark, folder):
    plan = plan_of(QUERIES["ag_10_period_pivot"](spark, folder))
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["wn_01_numbered", "wn_02_line_no", "wn_06_navigate", "wn_07_lead_and_group", "dm_01_append"])
def test_total_order_is_not_one_task(spark, folder, name):
    """A window without partitioning may only see one row per range."""
    plan = plan_of(QUERIES[name](spark, folder))
    for single in re.finditer(r"Exchange SinglePartition[^\n]*\n([^\n]*)", plan):
        assert re.search(r"HashAggregate|Project|ObjectHashAggregate|SortAggregate", single.group(1)), plan


def test_no_forced_join_hints():
    """The size-checked automatic broadcast decides, except for summaries with one row per range."""
    from pathlib import Path

    import wardflow

    root = Path(wardflow.__file__).parent
    for file in [p for part in ("functions", "sources", "operators", "plans", "bindings") for p in (root / part).glob("*.py")]:
        hints = re.findall(r"F\.broadcast\((\w+)|\.hint\((?!\"rebalance\")", file.read_text())
        assert set(hints) <= ({"offsets", "carried", "after"} if file.name == "windows.py" else set()), file


def test_row_numbers_shuffle_full_rows_once(spark, folder):
    """After the checkpoint only the summary of ranges is exchanged."""
    plan = plan_of(QUERIES["wn_01_numbered"](spark, folder))
    assert "hashpartitioning(_range" not in plan.replace("_rows", "").split("BroadcastExchange")[0]


def test_income_report_reads_each_table_once(spark, folder):
    plan = plan_of(QUERIES["cq_02_income_report"](spark, folder))
    assert plan.count("FileScan parquet") <= 10, plan


@pytest.mark.parametrize("name,sorts", [("wn_06_navigate", 1), ("wn_07_lead_and_group", 2)])
def test_neighbours_need_one_exchange_of_rows(spark, folder, name, sorts):
    """Rows meet by range once, in one order; there is no second look in the opposite one."""
    plan = plan_of(QUERIES[name](spark, folder)).split("Subqueries")[0]
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"_k#\d+L? DESC", window), plan
    by_range = re.findall(r"Exchange hashpartitioning\(_range#\d+, \d+\)[^\n]*\n([^\n]*)", plan)
    rows = [x for x in by_range if "Aggregate" not in x]
    assert len(rows) == 1, plan


def test_lab_window_reaches_the_scan(spark, folder, tmp_path):
    """Both Solar Hijri bounds are compared with the stored time itself."""
    from wardflow.bindings.star import StarTables
    from wardflow.plans import waiting

    t = dict(StarTables(spark, folder))
    t["lab_patients"].write.parquet(str(tmp_path / "lab"))
    t["lab_patients"] = spark.read.parquet(str(tmp_path / "lab"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(waiting.lab_patients_in_window(t, "1380/05/15", True, 30))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[([^\]]*RegisterDate[^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(RegisterDate,2001-07-07" in pushed and "LessThan(RegisterDate,2001-08-07" in pushed


def test_no_row_holds_more_than_two_maps(spark, folder):
    """The workflow composes neighbours in rounds; nothing gathers all slices of a visit."""
    import inspect

    from wardflow.operators import workflow

    body = inspect.getsource(workflow._composed)
    assert body.count("collect_list") == 1 and 'F.floor(F.col("slice") / 2)' in body


def test_ranges_do_not_change_between_runs(spark):
    """The range of a row depends on the rows alone, not on how they lie in partitions."""
    from pyspark.sql import functions as F

    from wardflow.operators.windows import in_ranges

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("v"))
    once = {r.k: r._range for r in in_ranges(df, ["k"]).collect()}
    again = {r.k: r._range for r in in_ranges(df.repartition(5, "k").sort(F.rand()), ["k"]).collect()}
    assert once == again and len(set(once.values())) > 20
    assert [r for _, r in sorted(once.items())] == sorted(once.values())


def test_stored_audit_needs_no_exchange_below_the_union(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(QUERIES["cq_25_stored_audit"](spark, folder))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    deep = [re.search(r"[A-Za-z(*]", x + "-").start() if re.search(r"[A-Za-z(*]", x) else 0 for x in lines]
    top = next(i for i, x in enumerate(lines) if x.endswith("- Union"))
    end = next(i for i in range(top + 1, len(lines)) if deep[i] <= deep[top])
    below = lines[top + 1 : end]
    assert any("Bucketed: true" in x for x in below) and not any("Exchange" in x for x in below), plan
def test_visits_that_refer_to_none_are_spread(spark, folder):
    """Visits without a referral share one key, which must not make one task of them."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("prj_11_resolve_tariff", "cq_01_visit_statistics"):
            assert re.search(r"hashpartitioning\(RefFileID#\d+L?, _spread#\d+", plan_of(QUERIES[name](spark, folder))), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_sheets_are_made_in_parts_of_bounded_size(spark, folder, monkeypatch):
    from wardflow.plans import ordersheet

    monkeypatch.setattr(ordersheet, "PART_ROWS", 50)
    receipts = spark.read.parquet(f"{folder}/orders.parquet").count()
    for name in ("cq_22_order_sheet", "cq_22_sheet_rows"):
        assert re.search(rf"hashpartitioning\(siFiles#\d+L?, {-(-receipts // 50)}\), REPARTITION_BY_NUM", plan_of(QUERIES[name](spark, folder))), name
