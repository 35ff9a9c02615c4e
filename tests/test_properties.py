"""Operators against brute force."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.functions.dates import to_shamsi
from wardflow.functions.text import mask_match
from wardflow.operators import aggs, filters, maintenance, windows
from wardflow.operators.workflow import TIMES, apply_3d_transition
from wardflow.sources.calendar import build_calendar, miladi_of

LEAP = (1, 5, 9, 13, 17, 22, 26, 30)


def walked_shamsi(first: dt.date, last: dt.date) -> dict[dt.date, str]:
    """Calendar that walks year by year and month by month."""
    left = (first - dt.date(1900, 1, 1)).days + 466702
    year = 1
    while left > 365 + (year % 33 in LEAP):
        left -= 365 + (year % 33 in LEAP)
        year += 1
    month, day = 1, 1
    out, current = {}, first
    lengths = lambda y: [31] * 6 + [30] * 5 + [29 + (y % 33 in LEAP)]
    for _ in range(left - 1):
        day += 1
        if day > lengths(year)[month - 1]:
            day, month = 1, month + 1
    while current <= last:
        out[current] = f"{year}/{month:02d}/{day:02d}"
        current += dt.timedelta(1)
        day += 1
        if day > lengths(year)[month - 1]:
            day, month = 1, month + 1
            if month > 12:
                month, year = 1, year + 1
    return out


def test_calendar_over_two_centuries(spark):
    want = walked_shamsi(dt.date(1900, 1, 1), dt.date(2099, 12, 31))
    cal = build_calendar(spark, "1900-01-01", "2099-12-31")
    got = {r["MiladiDate"]: r["Shamsi"] for r in cal.select("MiladiDate", "Shamsi").collect()}
    assert got == want
    back = miladi_of(cal.select("Shamsi", F.col("Miladi").alias("want")), cal, "Shamsi", "got")
    assert back.where("got <> want").count() == 0


def test_calendar_anchors(spark):
    anchors = {
        "1900-01-01": "1278/10/11", "1998-08-02": "1377/05/11", "2020-03-20": "1399/01/01",
        "2021-03-20": "1399/12/30", "2024-01-01": "1402/10/11", "2025-03-20": "1403/12/30", None: None,
    }
    df = spark.createDataFrame([(k,) for k in anchors], "d string")
    got = {r["d"]: r["s"] for r in df.select("d", to_shamsi(F.col("d").cast("date")).alias("s")).collect()}
    assert got == anchors


def test_calendar_span_is_limited(spark):
    with pytest.raises(ValueError):
        build_calendar(spark, "1000-01-01", "2000-01-01")


def literal_mask(text, mask, mode):
    result = 1 if mode == "and" else 0
    for i, ch in enumerate((mask or "").rstrip(" ")):
        if ch == "2" or text is None:
            continue
        same = text[i : i + 1] == ch
        if mode == "or" and same:
            return 1
        if mode == "and" and not same:
            return 0
    return result


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("0123", max_size=5)), st.text("012", max_size=5)), min_size=1, max_size=60))
def test_mask_match(spark, pairs):
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(pairs)], "i int, t string, m string")
    rows = df.select(
        "i", *[mask_match(F.col("t"), F.col("m"), mode).alias(mode + "_") for mode in ("and", "or")]
    ).collect()
    for r in rows:
        t, m = pairs[r["i"]]
        assert (r["and_"], r["or_"]) == (literal_mask(t, m, "and"), literal_mask(t, m, "or"))


# The modes that let each state through.
MODES = {
    1: [1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31],
    16: list(range(16, 32)),
}


def test_mask_filter_lists(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, 4, 8, 16, 32)], "s int")
    for mode in range(1, 32):
        got = {r["s"] for r in df.where(filters.mask_filter(F.col("s"), mode)).collect()}
        assert got == {s for s in (1, 2, 4, 8, 16) if s & mode}
        for state, modes in MODES.items():
            assert (state in got) == (mode in modes)


def skewed(spark, n=3000):
    """A third of all rows belongs to key 0."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("id"), F.when(i % 3 == 0, 0).otherwise(i % 50).alias("k"), (i * 7919 % 1000).alias("ts"), (i * 31 % 17).alias("v")
    )


def test_numbered_on_a_hot_value(spark):
    rows = windows.numbered(skewed(spark).select("k", "id"), ["k", "id"]).collect()
    want = sorted((r["k"], r["id"]) for r in rows)
    assert [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["RW"])] == want
    assert sorted(r["RW"] for r in rows) == list(range(1, len(rows) + 1))


def test_latest_and_rest_partition_the_rows(spark):
    df = skewed(spark)
    kept, rest = windows.latest_and_rest(df, ["k"], "ts", "id")
    a, b = kept.collect(), rest.collect()
    assert sorted(r["id"] for r in a + b) == list(range(3000))
    best = {}
    for r in df.collect():
        best[r["k"]] = max(best.get(r["k"], (-1, -1)), (r["ts"], r["id"]))
    assert {r["k"]: (r["ts"], r["id"]) for r in a} == best


def test_lead_in_a_hot_partition(spark):
    df = skewed(spark)
    rows = windows.lead_in(df, ["k"], ["ts", "id"], "id").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["k"], []).append((r["ts"], r["id"], r["Edge"]))
    for members in groups.values():
        members.sort()
        ids = [m[1] for m in members]
        assert [m[2] for m in members] == [*ids[1:], None]


def test_concat_ordered_on_a_hot_key(spark):
    df = skewed(spark)
    got = {r["k"]: r["List"] for r in aggs.concat_ordered(df, "k", F.col("v"), ["ts", "id"], ",", limit=400).collect()}
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["id"])):
        groups.setdefault(r["k"], []).append(str(r["v"]))
    assert got == {k: ",".join(v)[:400] for k, v in groups.items()}


def test_navigate_with_absent_keys(spark):
    keys = [2, 3, 5, 8, 13]
    files = spark.createDataFrame([(k,) for k in keys], "k long")
    asked = [(m, d) for m in range(0, 16) for d in "FPCNL"]
    moves = spark.createDataFrame(asked, "current long, direction string")
    for r in windows.navigate(files, "k", moves).collect():
        cur, way = r["current"], r["direction"]
        lower, upper = [k for k in keys if k < cur], [k for k in keys if k > cur]
        here = [cur] if cur in keys else lower[-1:] or keys[-1:]
        want = {"F": keys[0], "L": keys[-1], "P": (lower or keys)[-1] if lower else keys[0], "C": here[0], "N": (upper or keys[-1:])[0]}[way]
        ends = ("F" if want == keys[0] else "") + ("L" if want == keys[-1] else "")
        assert (r["target"], r["RowNO"], r["RowStatus"]) == (want, keys.index(want) + 1, ends)


def test_upsert_is_insert_plus_update(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    chg = spark.createDataFrame([(2, None), (4, "d")], "k int, v string")
    assert sorted(map(tuple, maintenance.upsert(old, chg, "k").collect())) == [(1, "a"), (2, None), (3, None), (4, "d")]


def step_by_step(row, events):
    """The workflow rules for one visit, one event at a time."""
    wait = None
    steps = (1, 5, 10, 16, 20)
    for step, undo, at in events:
        if row is None:
            if step == 1:
                row = {"Status": 1, "LastStatus": None, **dict.fromkeys(TIMES), "DeliveryTime": at}
            continue
        if undo and step == 1 and row["LastStatus"] is None:
            row, wait = None, 2
            continue
        before = row["Status"]
        row["Status"] = step if not undo else 5 if step == 10 else row["LastStatus"]
        row["LastStatus"] = before
        row[TIMES[steps.index(step)]] = None if undo else at
        if step in (1, 10):
            for t in TIMES[steps.index(step) + 1 :]:
                row[t] = None
        if step == 10 and not undo:
            wait = 4
    return row, wait


@pytest.mark.parametrize("slice_size", [3, 40, 100_000])
def test_workflow_in_slices(spark, slice_size):
    import random

    rnd = random.Random(slice_size)
    base = dt.datetime(2024, 1, 1)
    steps = (1, 5, 10, 16, 20)
    stored = {
        v: {"Status": rnd.choice((None, *steps)), "LastStatus": rnd.choice((None, *steps)), **{t: base for t in TIMES}}
        for v in range(6)
    }
    events = [
        (0 if rnd.random() < 0.4 else rnd.randrange(12), i, rnd.choice(steps), rnd.randrange(2), base + dt.timedelta(minutes=i))
        for i in range(300)
    ]
    schema = "siFiles long, siWait3D long, Status int, LastStatus int, " + ", ".join(f"{t} timestamp_ntz" for t in TIMES)
    table = spark.createDataFrame([(v, v + 100, *r.values()) for v, r in stored.items()], schema)
    evs = spark.createDataFrame(events, "siFiles long, seq long, step int, undo int, at timestamp_ntz")
    new, waits = apply_3d_transition(table, evs, slice_size)
    got = {r["siFiles"]: tuple(r[x] for x in ("Status", "LastStatus", *TIMES)) for r in new.collect()}
    got_waits = {r["siFiles"]: r["WaitStatus"] for r in waits.collect()}
    for v in range(12):
        row = dict(stored[v]) if v in stored else None
        row, wait = step_by_step(row, [e[2:] for e in events if e[0] == v])
        assert got.get(v) == (None if row is None else tuple(row[x] for x in ("Status", "LastStatus", *TIMES)))
        assert got_waits.get(v) == wait
