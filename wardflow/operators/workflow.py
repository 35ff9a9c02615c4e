"""Five-step 3-D workflow with undo (DM-14).

The steps of one visit depend on each other, so they run in order of a sequence
number, as a fold over a sorted array.  A visit with more events than a slice holds
is not one group: its events are cut into slices by their place in the visit.  The
first slice starts from the stored state.  Each further slice becomes a map from states to
states first, a text with one sign for each state.  Some neighbouring maps at a time are composed,
round by round, until one map for each visit is left, and on the way back every slice
gets the state that it starts from.  Then it is folded once, and aggregates join what the
slices of a visit leave behind.  So no row holds more than a few maps, and visits with few
events need none of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.dates import hhmm
from wardflow.operators.joins import anti, semi
from wardflow.operators.maintenance import update_from
from wardflow.operators.windows import numbered

# The steps, and the time column each step sets.
STEPS = (1, 5, 10, 16, 20)
TIMES = ("DeliveryTime", "TakePhoto", "DenseCloudTime", "PaidTime", "Object3DTime")
WAIT_CHECKED, WAIT_PHOTO_DONE = 2, 4
SLICE = 100_000

# Possible states: no row, or a pair of current and last step.  Undoing a step
# that has no last step leaves the current step empty.
KNOWN = (None, *STEPS)
STATES = [(False, None, None)] + [(True, now, last) for now in KNOWN for last in KNOWN]
#: One sign for each state; a map of states is the text of the signs they go to.
SIGNS = "".join(chr(48 + i) for i in range(len(STATES)))
#: Maps that are composed at a time.
COMPOSED = 32


def _state(present: Column, now: Column, last: Column, times: dict, touched: dict, wait: Column, reset: Column, photo: Column) -> Column:
    return F.struct(
        present.alias("present"),
        now.cast("int").alias("now"),
        last.cast("int").alias("last"),
        *[times[t].cast("timestamp_ntz").alias(t) for t in TIMES],
        *[touched[t].alias("set_" + t) for t in TIMES],
        wait.cast("int").alias("wait"),
        reset.alias("reset"),
        photo.cast("timestamp_ntz").alias("photo"),
    )


def _entry(present: Column, now: Column, last: Column, times: dict | None = None) -> Column:
    """A state in which no event has happened yet."""
    empty = {t: F.lit(None) for t in TIMES}
    untouched = {t: F.lit(False) for t in TIMES}
    return _state(present, now, last, times or empty, untouched, F.lit(0), F.lit(False), F.lit(None))


def _after(s: Column, event: Column) -> Column:
    """State after one event."""
    step, undo = event["step"], event["undo"] == 1
    present, now, last = s["present"], s["now"], s["last"]
    born = ~present & (step == 1)
    gone = present & (step == 1) & undo & last.isNull()
    moved = present & ~gone
    # An undone step 10 falls back to 5, the others to the last step.
    target = F.when(~undo, step).when(step == 10, 5).otherwise(last)
    stamp = F.when(born | ~undo, event["at"])
    times, touched = {}, {}
    for own, t in zip(STEPS, TIMES):
        sets = (born | moved) & (step == own)
        clears = gone | ((born | moved) & step.isin(1, 10) & (step < own))
        times[t] = F.when(clears, F.lit(None)).when(sets, stamp).otherwise(s[t])
        touched[t] = s["set_" + t] | clears | sets
    photographed = moved & (step == 10) & ~undo
    wait = F.when(gone, WAIT_CHECKED).when(photographed, WAIT_PHOTO_DONE).otherwise(s["wait"])
    return _state(
        (present & ~gone) | born,
        F.when(born, 1).when(moved, target),
        F.when(moved, now),
        times,
        touched,
        wait,
        s["reset"] | gone,
        F.coalesce(s["photo"], F.when(photographed, event["at"])),
    )


def _code(s: Column) -> Column:
    """Place of a state in ``STATES``, counted from 1."""

    def place(step: Column) -> Column:
        return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in STEPS]), step), F.lit(0))

    pair = place(s["now"]) * len(KNOWN) + place(s["last"]) + 2
    return F.when(s["present"], pair).otherwise(1).cast("int")


def _joined(s: Column, effect: Column) -> Column:
    """State after further events, given what these leave behind."""
    times = {t: F.when(effect["set_" + t], effect[t]).otherwise(s[t]) for t in TIMES}
    touched = {t: s["set_" + t] | effect["set_" + t] for t in TIMES}
    wait = F.when(effect["wait"] != 0, effect["wait"]).otherwise(s["wait"])
    photo = F.coalesce(s["photo"], effect["photo"])
    return _state(effect["present"], effect["now"], effect["last"], times, touched, wait, s["reset"] | effect["reset"], photo)


def _moves(step: int, undo: bool) -> str:
    """The map of states of one event, as ``_after`` has it."""

    def to(present: bool, now: int | None, last: int | None) -> tuple:
        if not present:
            return (True, 1, None) if step == 1 else (False, None, None)
        if step == 1 and undo and last is None:
            return (False, None, None)
        return (True, step if not undo else 5 if step == 10 else last, now)

    return "".join(SIGNS[STATES.index(to(*state))] for state in STATES)


def _mapped(signs: Column, event: Column) -> Column:
    """A map of states followed by one event."""
    undo = F.coalesce(event["undo"] == 1, F.lit(True))
    return F.coalesce(
        *[F.when((event["step"] == s) & (undo == u), F.translate(signs, SIGNS, _moves(s, u))) for s in STEPS for u in (False, True)]
    )


def _then(signs: Column, following: Column) -> Column:
    """Signs after the map ``following``."""
    return F.call_function("translate", signs, F.lit(SIGNS), following)


def _sliced(events: DataFrame, slice_size: int, in_order: Column) -> DataFrame:
    """Events of each visit in slices by their place in the visit."""
    # numbers run on through each visit, so its first number gives the place in it
    walked_in = numbered(events, ["siFiles", "seq"], "_n")
    heads_at = walked_in.groupBy("siFiles").agg(F.min("_n").alias("_from"))
    place = F.floor((F.col("_n") - F.col("_from")) / slice_size)
    return walked_in.join(heads_at, "siFiles").groupBy("siFiles", place.alias("slice")).agg(in_order)


def _starts(slices: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """``siFiles, slice, root, sign``: the state in which each slice starts, for each ``root`` of its visit.

    ``first`` holds ``siFiles`` and ``root``, the signs of states that the slice 0 may start from; ``most`` is
    the greatest number of slices of a visit.
    """
    parts = slices.select("siFiles", "slice", F.aggregate("events", F.lit(SIGNS), _mapped).alias("map"))
    levels = []
    while most > 1:
        row = F.array_sort(F.collect_list(F.struct("slice", "map"))).alias("row")
        level = parts.groupBy("siFiles", F.floor(F.col("slice") / COMPOSED).alias("slice")).agg(row)
        levels.append(level)
        parts = level.select("siFiles", "slice", F.aggregate("row", F.lit(SIGNS), lambda signs, p: _then(signs, p["map"])).alias("map"))
        most = -(-most // COMPOSED)
    starts = first.select("siFiles", F.lit(0).cast("long").alias("slice"), "root", F.col("root").alias("sign"))
    for level in reversed(levels):
        none = F.array().cast("array<struct<slice: bigint, sign: string>>")
        walk = F.aggregate(
            "row",
            F.struct(F.col("sign"), none.alias("done")),
            lambda a, p: F.struct(
                _then(a["sign"], p["map"]).alias("sign"),
                F.concat(a["done"], F.array(F.struct(p["slice"].alias("slice"), a["sign"].alias("sign")))).alias("done"),
            ),
            lambda a: a["done"],
        )
        met = level.join(starts, ["siFiles", "slice"]).select("siFiles", "root", F.explode(walk).alias("at"))
        starts = met.select("siFiles", F.col("at.slice").alias("slice"), "root", F.col("at.sign").alias("sign"))
    return starts


def _effects(slices: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """``siFiles, root, effect``: what all these slices of a visit leave behind together."""
    entries = F.array(*[_entry(*[F.lit(x) for x in state]) for state in STATES])
    entry = F.element_at(entries, F.ascii("sign") - ord(SIGNS[0]) + 1)
    walked = slices.join(_starts(slices, first, most), ["siFiles", "slice"]).select(
        "siFiles", "root", "slice", F.aggregate("events", entry, _after).alias("s")
    )
    s, place = F.col("s"), F.col("slice")
    gathered = walked.groupBy("siFiles", "root").agg(
        F.max_by(F.struct(s["present"].alias("present"), s["now"].alias("now"), s["last"].alias("last")), place).alias("end"),
        *[F.max_by(F.struct(s[t].alias("v")), F.when(s["set_" + t], place)).alias(t) for t in TIMES],
        *[F.bool_or(s["set_" + t]).alias("set_" + t) for t in TIMES],
        F.max_by(s["wait"], F.when(s["wait"] != 0, place)).alias("wait"),
        F.bool_or(s["reset"]).alias("reset"),
        F.min_by(s["photo"], F.when(s["photo"].isNotNull(), place)).alias("photo"),
    )
    end = F.col("end")
    times = {t: F.col(t)["v"] for t in TIMES}
    touched = {t: F.col("set_" + t) for t in TIMES}
    wait = F.coalesce("wait", F.lit(0))
    effect = _state(end["present"], end["now"], end["last"], times, touched, wait, F.col("reset"), F.col("photo"))
    return gathered.select("siFiles", "root", effect.alias("effect"))


def apply_3d_transition(current: DataFrame, events: DataFrame, slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """New 3-D table, and what the events ask of the waiting list.

    ``events`` holds ``siFiles``, a unique ``seq``, ``step``, ``undo`` (0/1) and
    the time ``at``.  The second output has one row per visit whose waiting entry
    changes: its new ``WaitStatus``, whether call time and machine are cleared, and
    the time ``WaitPhoto`` of the first photo.
    """
    event = F.struct("seq", "step", "undo", F.col("at").cast("timestamp_ntz").alias("at"))
    in_order = F.array_sort(F.collect_list(event)).alias("events")
    known = events.where(F.col("step").isin(*STEPS)).select("siFiles", "seq", "step", "undo", "at")
    stored = current.select("siFiles", F.struct("Status", "LastStatus", *TIMES).alias("old"))
    old = F.col("old")
    start = _entry(old.isNotNull(), old["Status"], old["LastStatus"], {t: old[t] for t in TIMES})

    def folded(first_slices: DataFrame) -> DataFrame:
        joined = first_slices.join(stored, "siFiles", "left")
        return joined.select("siFiles", F.aggregate("events", start, _after).alias("state"))

    sizes = known.groupBy("siFiles").agg(F.count(F.lit(1)).alias("_size"))
    most = sizes.agg(F.max("_size").alias("n")).first()["n"] or 0
    if most <= slice_size:
        walked = folded(known.groupBy("siFiles").agg(in_order)).withColumnRenamed("state", "new")
    else:
        long = sizes.where(F.col("_size") > slice_size).select("siFiles")
        few = anti(known, long, "siFiles").groupBy("siFiles").agg(in_order)
        slices = _sliced(semi(known, long, "siFiles"), slice_size, in_order)
        root = F.substring(F.lit(SIGNS), _code(F.col("state")), F.lit(1)).alias("root")
        first = folded(slices.where(F.col("slice") == 0)).select("siFiles", "state", root)
        further = slices.where(F.col("slice") > 0).withColumn("slice", F.col("slice") - 1)
        rest = _effects(further, first.select("siFiles", "root").distinct(), -(-most // slice_size) - 1)
        done = F.when(F.col("effect").isNull(), F.col("state")).otherwise(_joined(F.col("state"), F.col("effect")))
        walked = first.join(rest, ["siFiles", "root"], "left").select("siFiles", done.alias("new"))
        walked = walked.unionByName(folded(few).withColumnRenamed("state", "new"))
    new = F.col("new")
    values = {"Status": new["now"], "LastStatus": new["last"], **{t: new[t] for t in TIMES}}
    table = (
        current.join(walked, "siFiles", "full_outer")
        .where(new.isNull() | new["present"])
        .select(
            *[
                F.when(new.isNotNull(), values[x]).otherwise(F.col(x)).alias(x) if x in values else F.col(x)
                for x in current.columns
            ]
        )
    )
    waits = walked.where(new["wait"] != 0).select(
        "siFiles", new["wait"].alias("WaitStatus"), new["reset"].alias("WaitReset"), hhmm(new["photo"]).alias("WaitPhoto")
    )
    return table, waits


def apply_to_waits(waits: DataFrame, asked: DataFrame) -> DataFrame:
    """Waiting entries after the second output of ``apply_3d_transition``.

    The step is set, a reset clears call time and machine, and the photo time is
    written only where there is none yet.
    """
    cleared = F.col("new_WaitReset")
    mapping = {
        "Status": F.col("new_WaitStatus"),
        "WaitCall": F.when(~cleared, F.col("WaitCall")),
        "MachinePhoto": F.when(~cleared, F.col("MachinePhoto")),
        "WaitPhoto": F.coalesce("WaitPhoto", "new_WaitPhoto"),
    }
    return update_from(waits, asked, "siFiles", mapping)


def paid_events(changes: DataFrame, waits: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Workflow events that follow from waiting entries set to their last step.

    A visit whose 3-D work has not reached step 16 is moved there when its
    waiting entry is settled; ``changes`` is the input of ``apply_status``.
    """
    settled = changes.where(F.col("Status") == 16).select("siWait")
    visits = semi(waits.select("siWait", "siFiles"), settled, "siWait")
    behind = current.where(F.col("Status") < 16)
    return semi(visits, behind, "siFiles").select(
        "siFiles", F.col("siWait").alias("seq"), F.lit(16).alias("step"), F.lit(0).alias("undo"), as_of.alias("at")
    )
