"""Several changes of a key in one table leave what the same changes leave one after another."""

import random

import pytest
from pyspark.sql import functions as F

from wardflow.functions import dates
from wardflow.operators import maintenance as dm
from wardflow.operators.workflow import apply_3d_transition

c = F.col


def noon():
    return dates.timestamp_lit("2024-01-30 12:00:00")


WAITS = (
    "siWait long, Status int, WaitCheck string, MachineCheck string, WaitCall string, MachinePhoto string, SentEMail int, AttachedCount int, "
    "EMailDate string, EMailTime string, TelegramStatus int, SendDate timestamp_ntz, AttachedCountTeleg int, ManualTelegDate timestamp_ntz, "
    "ManualTelegStatus int, TelegMessageId long, TryCount int"
)


def table(spark):
    rows = [
        (k, 8, None if k % 2 else "08:00", None, "08:10", "P1", None, 3, "1402/01/01", "09:00", 2, None, 1, None, 3, 70 + k, None if k % 3 else 4)
        for k in range(8)
    ]
    df = spark.createDataFrame(rows, WAITS)
    return df.withColumn("ManualTelegDate", F.when(c("siWait") > 4, noon()))


def walked(spark, schema, make, operator, seed):
    """The result of one batch, and of its rounds one by one."""
    rng = random.Random(seed)
    changes = [(k, turn, *make(rng)) for k in range(10) for turn in range(rng.randint(0, 4))]
    rng.shuffle(changes)
    schema = f"siWait long, turn int, {schema}"
    at_once = operator(table(spark), spark.createDataFrame(changes, schema))
    step = table(spark)
    for turn in range(4):
        step = operator(step, spark.createDataFrame([x for x in changes if x[1] == turn], schema))
    return sorted(map(str, at_once.collect())), sorted(map(str, step.collect()))


CASES = {
    "status": ("Status int", lambda r: (r.choice([1, 2, 4, 16, None]),), lambda d, x: dm.apply_status(d, x, order=["turn"])),
    "once": (
        "WaitCheck string, MachineCheck string",
        lambda r: (r.choice([None, "a", "b"]), r.choice([None, "m", "n"])),
        lambda d, x: dm.set_once(d, x, "siWait", "WaitCheck", ["WaitCheck", "MachineCheck"], order=["turn"]),
    ),
    "blank": (
        "WaitCall string, MachinePhoto string",
        lambda r: (r.choice([None, " ", "x", "y"]), r.choice([None, "p", "q"])),
        lambda d, x: dm.update_keep_blank(d, x, "siWait", ["MachinePhoto"], ["WaitCall"], "WaitCall", order=["turn"]),
    ),
    "delivery": (
        "TelegramStatus int, TelegMessageId long, AttachedCount int",
        lambda r: (r.choice([1, 2, 3, None]), r.choice([None, 0, 5, 9]), r.choice([None, 2])),
        lambda d, x: dm.apply_visit_delivery(d, x, noon(), order=["turn"]),
    ),
    "email": (
        "SentEMail int, AttachedCount int",
        lambda r: (r.choice([0, 1, 2, 3, None]), r.choice([1, 6])),
        lambda d, x: dm.apply_email(d, x, d.where("siWait % 2 = 0").select("siWait"), "1402/11/10", noon(), order=["turn"]),
    ),
    "update": (
        "WaitCall string",
        lambda r: (r.choice([None, "x", "y"]),),
        lambda d, x: dm.update_by_key(d, x, "siWait", ["WaitCall"], order=["turn"]),
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_one_after_another(spark, name):
    for seed in (1, 2):
        at_once, step = walked(spark, *CASES[name], seed)
        assert at_once == step


def test_long_visits_are_composed(spark):
    """Slices of 2, 3 and 7 events against one fold; one visit has most of the events."""
    rng = random.Random(9)
    sizes = [61, 1, 8, 2, 7, 14, 0, 5]
    events = []
    for k, n in enumerate(sizes):
        for _ in range(n):
            events.append((k, len(events), rng.choice([1, 1, 5, 10, 16, 20, 3]), rng.randint(0, 1)))
    rng.shuffle(events)
    df = spark.createDataFrame(events, "siFiles long, seq long, step int, undo int")
    df = df.withColumn("at", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=c("seq").cast("int"))))
    times = ", ".join(f"{t} timestamp_ntz" for t in ("DeliveryTime", "TakePhoto", "DenseCloudTime", "PaidTime", "Object3DTime"))
    held = spark.createDataFrame([(0, 5, 1, *[None] * 5), (2, 16, 10, *[None] * 5), (50, 1, None, *[None] * 5)], f"siFiles long, Status int, LastStatus int, {times}")
    want = [sorted(map(str, x.collect())) for x in apply_3d_transition(held, df)]
    for size in (2, 3, 7):
        assert [sorted(map(str, x.collect())) for x in apply_3d_transition(held, df, slice_size=size)] == want


def test_no_events(spark):
    times = ", ".join(f"{t} timestamp_ntz" for t in ("DeliveryTime", "TakePhoto", "DenseCloudTime", "PaidTime", "Object3DTime"))
    held = spark.createDataFrame([(1, 5, 1, *[None] * 5)], f"siFiles long, Status int, LastStatus int, {times}")
    events = spark.createDataFrame([], "siFiles long, seq long, step int, undo int, at timestamp_ntz")
    table_, waits = apply_3d_transition(held, events)
    assert table_.count() == 1 and waits.count() == 0


def test_maps_of_states_follow_single_events(spark):
    """The sign that a map has for a state is the one of the state after the event itself."""
    from wardflow.operators.workflow import SIGNS, STATES, STEPS, _after, _code, _entry, _mapped

    rows = [(k, p, n, l, s, u) for k, (p, n, l) in enumerate(STATES) for s in STEPS for u in (0, 1)]
    df = spark.createDataFrame(rows, "k int, p boolean, n int, l int, step int, undo int").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    event = F.struct("step", "undo", "at")
    after = _after(_entry(c("p"), c("n"), c("l")), event)
    out = df.select("k", _mapped(F.lit(SIGNS), event).alias("map"), _code(after).alias("code")).collect()
    assert len(out) == 370 and all(r.map[r.k] == SIGNS[r.code - 1] for r in out)


def test_slices_of_many_rounds(spark):
    """A visit of more slices than are composed in two rounds, whose table rows come twice in different states."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice([1, 5, 10, 16, 20]), rng.randint(0, 1)) for i in range(1100)]
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=c("seq").cast("int"))
    df = spark.createDataFrame(rows, "siFiles long, seq long, step int, undo int").withColumn("at", at)
    times = ", ".join(f"{t} timestamp_ntz" for t in ("DeliveryTime", "TakePhoto", "DenseCloudTime", "PaidTime", "Object3DTime"))
    held = spark.createDataFrame([(7, 5, 1, *[None] * 5), (7, 16, 10, *[None] * 5)], f"siFiles long, Status int, LastStatus int, {times}")
    want, got = ([sorted(map(str, x.collect())) for x in apply_3d_transition(held, df, size)] for size in (2000, 1))
    assert got == want
