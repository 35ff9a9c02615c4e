"""Edge rows where a careless rewrite gives another answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.functions import dates, nulls, numbers, text
from wardflow.operators import aggs, filters, joins, maintenance, setops, sorting, windows
from wardflow.operators.projections import render_message
from wardflow.operators.xmlrows import shred_lists, shred_pairs
from wardflow.plans import reports, waiting

c = F.col


def one(spark, expr, **cols):
    """Value of an expression over one row of text, number or NULL cells."""
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


def test_concatenation_of_missing_parts(spark):
    cells = dict(a="x", b=None)
    assert one(spark, nulls.cat_strict(c("a"), c("b")), **cells) is None
    assert one(spark, nulls.cat_loose(c("a"), c("b")), **cells) == "x"
    assert one(spark, nulls.full_name(c("b"), c("a")), **cells) == "x"
    assert one(spark, nulls.name_dash_job(c("a"), c("b"), c("a")), **cells) is None


def test_not_in_with_a_null_key(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert joins.not_in(df, keys, "k").count() == 0
    assert [r["k"] for r in joins.not_in(df, keys.where("k is not null"), "k").collect()] == [2]
    assert joins.not_in(df, keys.where("k > 5"), "k").count() == 3
    assert {r["k"] for r in joins.anti(df, keys, "k").collect()} == {2, None}


@pytest.mark.parametrize(
    "unit,a,b,want",
    [
        ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:01", 1),
        ("minute", "2024-01-01 00:00:00", "2024-01-01 00:00:59", 0),
        ("hour", "2024-01-01 23:59:00", "2024-01-02 00:01:00", 1),
        ("day", "2024-01-01 23:59:00", "2024-01-02 00:01:00", 1),
        ("month", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1),
        ("year", "2023-12-31 00:00:00", "2024-01-01 00:00:00", 1),
    ],
)
def test_boundary_differences(spark, unit, a, b, want):
    expr = dates.datediff_boundary(unit, c("a").cast("timestamp_ntz"), c("b").cast("timestamp_ntz"))
    assert one(spark, expr, a=a, b=b) == want


def test_missing_time_counts_as_old(spark):
    now = dates.timestamp_lit("2024-01-01 00:01:01")
    assert one(spark, dates.age_at_least(c("a").cast("timestamp_ntz"), now, 1), a="2024-01-01 00:00:59")
    assert one(spark, dates.age_at_least(c("a").cast("timestamp_ntz"), now, 999), a=None)
    assert not one(spark, nulls.nvl(dates.age_at_most(c("a").cast("timestamp_ntz"), now, 9), False), a=None)


def test_pivot_keeps_groups_outside_all_periods(spark):
    rows = [("a", "1402/01/05"), ("a", "1402/02/01"), ("b", "1390/01/01"), ("c", None), ("a", "1402/02/02")]
    df = spark.createDataFrame(rows, "k string, d string")
    args = (["k"], "d", "1402/02/01", ["1402/02/01", "1402/01/01"])
    got = {r["k"]: (r["Zone1"], r["Zone2"]) for r in aggs.period_pivot(df, *args).collect()}
    assert got == {"a": (1, 1), "b": (None, None), "c": (None, None)}
    inside = aggs.period_pivot(df, *args, keep_outside=False)
    assert [r["k"] for r in inside.collect()] == ["a"]


def test_integer_division_truncates(spark):
    assert one(spark, numbers.reduced_price(c("p"), c("q")), p=7, q=15) == 6
    assert one(spark, numbers.int_div(c("p"), c("q")), p=-7, q=2) == -3
    assert one(spark, numbers.age(c("b"), c("r")), b="13x0", r="1397/01/01") is None


@pytest.mark.parametrize(
    "value,mask,mode,want",
    [(None, "1", "and", 1), (None, "1", "or", 0), ("10", "102", "and", 1), ("1", "11", "and", 0), ("01", "21", "or", 1), ("1", "", "and", 1), ("1", "", "or", 0)],
)
def test_masks(spark, value, mask, mode, want):
    assert one(spark, text.mask_match(c("v"), mask, mode), v=value) == want


def test_list_membership_has_no_width_limit(spark):
    df = spark.createDataFrame([(7,), (107,)], "k int")
    assert [r["k"] for r in df.where(filters.in_list(c("k"), ",107,")).collect()] == [107]
    assert df.where(filters.in_list(c("k"), ",0,")).count() == 2
    assert one(spark, filters.in_list(c("k"), c("l")), k=107, l="1,107")


def test_counting_characters_and_lines(spark):
    assert one(spark, text.count_char(c("s"), ","), s="a,b,,") == 3
    assert one(spark, text.count_char(c("s"), " "), s="a b ") == 1
    assert one(spark, text.count_char(c("s"), ","), s=None) == 0
    assert one(spark, text.count_lines(c("s")), s="x\ny\n") == 1
    assert one(spark, text.count_lines(c("s")), s="x\ny") == 1
    assert one(spark, text.count_lines(c("s")), s="") == 0


@pytest.mark.parametrize(
    "value,want",
    [
        ("97/1/5", "1397/01/05"), ("397/12/3", "1397/12/03"), ("1397/1/15", "1397/01/15"), ("1397/01/15", "1397/01/15"),
        ("", ""), (None, None), ("97", "97"),
    ],
)
def test_date_repair(spark, value, want):
    assert one(spark, dates.repair_date(c("s")), s=value) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ("a\nb\nc\nd\ne", ["a", "b", "c", "d"]), ("   ", [None] * 4), (None, [None] * 4), (" x ", ["x", None, None, None]),
        ("a\r\n b\n", ["a\r", "b", None, None]), ("a\n\nb", ["a", "", "b", None]), ("a\n\n", ["a", "", None, None]),
    ],
)
def test_line_split(spark, value, want):
    assert list(one(spark, F.array(*text.split_lines(c("s"))), s=value)) == want


@pytest.mark.parametrize("value,mobile", [("0912;1", True), ("912", True), ("021", False), ("0091", False)])
def test_phones(spark, value, mobile):
    phone, cell = text.classify_phone(c("s"))
    assert one(spark, F.array(phone, cell), s=value) == ([None, value] if mobile else [value, None])
    assert one(spark, F.array(phone, cell), s=None) == [None, None]


def test_letters(spark):
    assert one(spark, text.to_arabic(c("s")), s="کی" * 80) == "كي" * 80
    assert one(spark, text.to_arabic(c("s"), limit=100), s="کی" * 80) == "كي" * 50
    assert one(spark, text.to_persian(c("s")), s="كي" * 80) == "کی" * 80
    assert one(spark, text.match_key(c("s"), c("m")), s="a b", m=None) == "ab"


def test_failed_deliveries_come_first(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (None,)], "s int")
    assert sorting.priority_sort(df, sorting.failed_first(c("s")), []).first()["s"] == 3
    assert sorting.top_n(df.where("s is not null"), ["-s"], 1).first()["s"] == 3


def test_navigation_stays_at_the_ends(spark):
    files = spark.createDataFrame([(1,), (2,)], "k long")
    moves = spark.createDataFrame([(1, "P"), (2, "N")], "current long, direction string")
    assert sorted((r["current"], r["target"]) for r in windows.navigate(files, "k", moves).collect()) == [(1, 1), (2, 2)]


def test_distinct_names(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (2, None)]
    df = spark.createDataFrame(rows, "k int, n string")
    assert {r["k"]: r["List"] for r in aggs.name_list(df, "k", "n").collect()} == {1: "a, b", 2: None}


def test_relational_division(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (2, 5), (3, 7)], "k int, c int")
    assert [r["k"] for r in aggs.has_all(df, "k", "c", [5, 6, 6]).collect()] == [1]


def test_next_keys(spark):
    files = spark.createDataFrame([(7, 1)], "FileID int, siBranch int")
    branches = spark.createDataFrame([(1,), (22,)], "siBranch int")
    got = {r["siBranch"]: r["NewID"] for r in aggs.next_key(files, "FileID", branches, "siBranch", 97).collect()}
    assert got == {1: 8, 22: 2_297_000_001}
    assert aggs.next_key(files.where("FileID > 9"), "FileID").first()["NewID"] == 1001


def test_union_with_and_without_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    assert setops.union_distinct(df, df).count() == 1
    assert setops.union_levels({0: df, 1: df}).count() == 4


def test_left_join_keeps_rows_its_condition_misses(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 0), (2, 1)], "k int, v int")
    got = {r["k"]: r["v"] for r in joins.left_join_where(left, right, "k", c("v") == 1).collect()}
    assert got == {1: None, 2: 1}


def test_message_lines(spark):
    message = render_message([F.lit("a"), (c("p") != "", F.concat(F.lit("p "), c("p"))), F.lit("z")], "\n")
    assert one(spark, message, p="5") == "a\np 5\nz"
    assert one(spark, message, p=None) == "a\nz"
    assert one(spark, render_message([F.lit("a"), c("p")], "\n"), p=None) is None


def test_xml_pairs(spark):
    df = spark.createDataFrame([(1, "<T><F>1</F><F>9</F></T><T><F>2</F></T>"), (2, None), (3, "")], "id int, x string")
    assert sorted(map(tuple, shred_pairs(df, "x").drop("x").collect())) == [(1, "1", "9"), (1, "2", None)]
    both = shred_lists(df.withColumn("y", F.lit("<T><F>a&amp;b</F></T>")), {0: "x", 1: "y"})
    rows = [tuple(r) for r in both.collect()]
    assert sorted(r for r in rows if r[1] == 1) == [(i, 1, "a&b", None) for i in (1, 2, 3)]
    assert sorted(r for r in rows if r[1] == 0) == [(1, 0, "1", "9"), (1, 0, "2", None)]


def test_first_write_wins(spark):
    table = spark.createDataFrame([(1, None, None), (2, "old", "m")], "siWait int, WaitCheck string, MachineCheck string")
    chg = spark.createDataFrame([(1, "new", "n"), (2, "new", "n")], "siWait int, WaitCheck string, MachineCheck string")
    got = maintenance.set_once(table, chg, "siWait", "WaitCheck", ["WaitCheck", "MachineCheck"])
    assert sorted(map(tuple, got.collect())) == [(1, "new", "n"), (2, "old", "m")]


def test_delivery_reads_the_old_row(spark):
    day = dt.datetime(2024, 1, 1)
    schema = (
        "siWait int, TelegramStatus int, ManualTelegStatus int, TelegMessageId int, TryCount int, "
        "AttachedCountTeleg int, SendDate timestamp_ntz, ManualTelegDate timestamp_ntz"
    )
    table = spark.createDataFrame([(1, 1, 1, 9, None, 0, day, day), (2, 1, 1, 9, 4, 0, day, None)], schema)
    outcomes = spark.createDataFrame([(1, 2, 0, 3), (2, 1, 5, 3)], "siWait int, TelegramStatus int, TelegMessageId int, AttachedCount int")
    got = maintenance.apply_visit_delivery(table, outcomes, dates.timestamp_lit("2024-02-02 10:00:00"))
    new = dt.datetime(2024, 2, 2, 10)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 9, 1, 3, day, new), (2, 1, 1, 5, 4, 3, new, None)]


def test_unknown_condition_keeps_the_row(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    kept, gone = maintenance.split_delete(df, c("k") > 2)
    assert {r["k"] for r in kept.collect()} == {1, None} and [r["k"] for r in gone.collect()] == [3]


def clinic(spark, **overrides):
    """Smallest set of tables the income report needs: one visit, two equal services."""
    t = {
        "files": ([(1, 10, 10, "L", None, "1400/01/05", "s", 1, 1, 0, 5, 6)],
                  "siFiles int, FileID int, RefFileID int, LName string, FName string, ReferDate string, Subject string, Bef_Aft int, PaidAfter int, SendType int, siDoctor int, siHospital int"),
        "doctors": ([(5, "D", None, "j", 1, 2)], "siDoctors int, LName string, FName string, Job string, PerDiscount int, SumAfter int"),
        "hospitals": ([(6, "H")], "siHospital int, FullName string"),
        "private_tariffs": ([(5,)], "siDoctors int"),
        "albums": ([(1, "1400/01/06"), (1, "1400/01/06")], "siFiles int, SurgDate string"),
        "waits": ([(1, "10:00", "11:00")], "siFiles int, WaitTime string, WaitTimeOut string"),
        "services": ([(1, 2), (1, 2), (1, 3)], "siFiles int, Number int"),
        "accounts": ([(1, None, 100, 60, 40, 5, "1400/02/01", "c", 1)],
                     "siFiles int, siDiscount int, PayableFee int, PaidAmount int, RemainAmount int, Discount int, PaidDate string, Comment string, RoundAmount int"),
        "discounts": ([(1, "t", 5)], "siDiscount int, Title string, PerDiscount int"),
    }
    return {n: spark.createDataFrame(*(overrides.get(n) or v)) for n, v in t.items()}


def test_equal_quantities_count_once(spark):
    rows = reports.visit_statistics(clinic(spark)).collect()
    assert [(r["TotalNumber"], r["PreCost"], r["PatientName"]) for r in rows] == [(5, 1, "L ")]


def test_visit_paid_inside_the_range_counts_its_remainder(spark):
    rows = reports.income_report(clinic(spark), "1400/02/01", "1400/02/30").collect()
    totals = [r for r in rows if r["Report"] == "Report"]
    assert len(rows) == 2 and totals[0]["SumPaidAmount"] == 40 and totals[0]["SumPayableFee"] is None
    inside = [r for r in reports.income_report(clinic(spark), "1400/01/01", "1400/01/30").collect() if r["Report"]]
    assert inside[0]["SumPaidAmount"] == 60 and inside[0]["SumPayableFee"] == 100


def test_empty_range_still_has_a_totals_row(spark):
    rows = reports.income_report(clinic(spark), "1300/01/01", "1300/01/02").collect()
    assert [(r["Report"], r["SumPaidAmount"]) for r in rows] == [("Report", None)]


def test_station_conflicts(spark):
    waits = spark.createDataFrame(
        [(1, 1, "A"), (2, 1, "A"), (3, 1, "B"), (4, 2, "A"), (5, 1, None)], "siWait int, Status int, MachineCheck string"
    )
    stations = spark.createDataFrame([("A", 1), ("C", 3)], "MachineCheck string, siWait int")
    got = waiting.station_conflicts(waits, stations, "MachineCheck", 1)
    assert sorted((r["ErrorNO"], r["Station"], r["siWait"]) for r in got.collect()) == [(1, "A", 1), (2, "C", 3), (3, "A", 2)]


def test_two_word_search(spark):
    df = spark.createDataFrame([("x", None), ("y", "x"), (None, None)], "a string, b string")
    cols = [c("a"), c("b")]
    assert df.where(filters.multi_text_search(cols, "x", "y", "and")).count() == 1
    assert df.where(filters.multi_text_search(cols, "x", "y", "or")).count() == 2
    assert df.where(filters.multi_text_search(cols, None, "y", "and")).count() == 1
    assert df.where(filters.multi_text_search(cols, None, None, "and")).count() == 3


def test_ordered_ranges_need_a_shared_folder_on_a_cluster(spark):
    # Locally the setting or a temporary folder is used.
    assert windows.numbered(spark.range(5).toDF("k"), ["k"]).count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None


def test_long_match_keys_differ_after_many_characters(spark):
    from wardflow.operators.joins import match_entities

    a = spark.createDataFrame([(1, "L" * 100 + "A")], "i int, k string")
    b = spark.createDataFrame([(2, "L" * 100 + "B"), (3, "L" * 100 + "A")], "j int, k2 string")
    got = match_entities(a, b, [c("k")], [c("k2")]).collect()
    assert [(r.i, r.j) for r in got] == [(1, 3)]


def test_long_texts_are_joined_whole(spark):
    from wardflow.operators.aggs import concat_ordered

    df = spark.range(1000).select(F.lit(1).alias("k"), F.lpad(c("id").cast("string"), 10, "x").alias("v"), "id")
    text_ = concat_ordered(df, "k", c("v"), ["id"], ",").first()["List"]
    assert text_ == ",".join(str(i).rjust(10, "x") for i in range(1000))


def test_repeated_changes_never_multiply_rows(spark):
    from wardflow.operators import maintenance as dm

    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    chg = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "p", 1), (3, "q", 2), (None, "m", 1)], "k int, v string, n int")
    updated = dm.update_by_key(old, chg, "k", ["v"], order=["n"])
    assert sorted(map(tuple, updated.collect()), key=str) == [(1, "x"), (2, "b"), (None, "n")]
    changed = dm.upsert(old.where("k IS NOT NULL"), chg.select("k", "v", "n").where("k IS NOT NULL"), "k", order=["n"])
    assert sorted(map(tuple, changed.collect())) == [(1, "x"), (2, "b"), (3, "q")]
    added = dm.insert_missing(old, chg.select("k", "v"), "k")
    assert sorted(map(tuple, added.collect()), key=str) == [(1, "a"), (2, "b"), (3, "q"), (None, "m"), (None, "n")]
