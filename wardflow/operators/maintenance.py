"""Batch table maintenance (DM-1 .. DM-13).

Each operator takes the current table and a change table and returns the new
table.  Several changes of a key act as if they came one after another by the columns
``order``, or by all their columns where no order is given; an update never adds
rows.  What a sequence of changes leaves behind is said by a few aggregates of it (the last
change, the last that counts for a column, the number of tries), so one row per key
meets the table, and all new values are computed from the old row in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.dates import add_time, hhmm
from wardflow.functions.nulls import nvl
from wardflow.operators.joins import anti, semi
from wardflow.operators.windows import numbered

NEW = "new_"


def _turn(chg: DataFrame, key: str, order: list[str] | None) -> Column:
    """What changes of a key are ordered by; equal ones by all their columns."""
    rest = [c for c in chg.columns if c != key]
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])], *rest)


def last_changes(chg: DataFrame, key: str, order: list[str] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the last by ``order``; ties go to the greatest row.  NULL is no key.

    ``also`` adds aggregates over all changes of the key.
    """
    keyed = chg.where(F.col(key).isNotNull())
    also = {n: v.alias(n) for n, v in (also or {}).items()}
    if len(chg.columns) == 1:
        return keyed.distinct()
    return keyed.groupBy(key).agg(F.max(_turn(chg, key, order)).alias("_last"), *also.values()).select(
        *[F.col(key) if c == key else F.col("_last")[c].alias(c) for c in chg.columns], *also
    )


def _last_of(chg: DataFrame, key: str, order: list[str] | None, cond: Column, value: str) -> Column:
    """Aggregate: the value of the last change that meets a condition, NULL if none does."""
    return F.max(F.when(cond, _turn(chg, key, order)))[value]


def _first_of(chg: DataFrame, key: str, order: list[str] | None, cond: Column) -> Column:
    """Aggregate: the first change that meets a condition."""
    return F.min(F.when(cond, _turn(chg, key, order)))


def _apply(
    df: DataFrame,
    chg: DataFrame,
    key: str,
    rules: dict[str, Column],
    only: Column | None = None,
    order: list[str] | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Left join the last changes as ``new_<col>`` and rewrite the ruled columns."""
    chg = last_changes(chg, key, order, also)
    renamed = chg.select(
        key, *[F.col(c).alias(NEW + c) for c in chg.columns if c != key], F.lit(True).alias("_hit")
    )
    hit = F.col("_hit").isNotNull()
    if only is not None:
        hit = hit & nvl(only, False)
    joined = df.join(renamed, key, "left")
    return joined.select(
        *[
            F.when(hit, rules[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c)
            if c in rules
            else F.col(c)
            for c in df.columns
        ]
    )


def append(df: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """Add rows with the next free surrogate keys, in the given order (DM-1)."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()
    keyed = numbered(new, order, "_n").withColumn(
        key, (F.col("_n") + top).cast(df.schema[key].dataType)
    )
    return df.unionByName(keyed.drop("_n"), allowMissingColumns=True)


def update_by_key(df: DataFrame, chg: DataFrame, key: str, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """Overwrite listed columns of the rows named by key, also with NULL (DM-2)."""
    return _apply(df, chg, key, {c: F.col(NEW + c) for c in cols}, order=order)


def upsert(df: DataFrame, chg: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Change rows that exist, insert those that do not (DM-3)."""
    chg = last_changes(chg, key, order)
    cols = [c for c in df.columns if c != key]
    old = df.select(key, F.struct(*cols).alias("_old"))
    new = chg.select(
        key, F.struct(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in cols]).alias("_new")
    )
    row = F.coalesce("_new", "_old")
    return (
        old.join(new, key, "full_outer")
        .select(key, row.alias("_row"))
        .select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])
    )


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove the rows of a key or of a parent key (DM-4)."""
    return anti(df, keys, key)


def update_from(df: DataFrame, src: DataFrame, key: str, mapping: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Update from a join with another table (DM-5).

    ``mapping`` gives each target column an expression over ``new_<source
    column>`` and the old row.  Of several source rows of a key the last by ``order`` is used.
    """
    return _apply(df, src, key, mapping, order=order)


def insert_missing(df: DataFrame, src: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Add the source rows whose key the table lacks, one per key; rows without a key are all added (DM-6)."""
    fresh = anti(last_changes(src, key, order), df.where(F.col(key).isNotNull()), key)
    keyless = src.where(F.col(key).isNull())
    cols = [c for c in src.columns if c in df.columns]
    return df.unionByName(fresh.select(*cols).unionByName(keyless.select(*cols)), allowMissingColumns=True)


def split_delete(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows; an unknown condition keeps the row (DM-7)."""
    gone = nvl(cond, False)
    return df.where(~gone), df.where(gone)


def refresh_derived(df: DataFrame, derived: DataFrame, key: str, col: str, affected: DataFrame | None = None) -> DataFrame:
    """Rewrite a column from an aggregate per key (DM-8).

    Keys the aggregate lacks get NULL.  With ``affected`` only those keys change.
    """
    fresh = derived.select(key, F.col(derived.columns[-1]).alias("_fresh"))
    joined = df.join(fresh, key, "left")
    value = F.col("_fresh")
    if affected is not None:
        marks = affected.select(key).distinct().withColumn("_mark", F.lit(True))
        joined = joined.join(marks, key, "left")
        value = F.when(F.col("_mark"), value).otherwise(F.col(col))
    return joined.select(*[value.alias(c) if c == col else F.col(c) for c in df.columns])


def snapshot(df: DataFrame, keys: DataFrame, key: str, log_type: str, as_of: Column) -> DataFrame:
    """Copies of the named rows with time and type of the change (DM-9)."""
    return semi(df, keys, key).select(
        "*", as_of.alias("LogDateTime"), F.lit(log_type).alias("LogType")
    )


def set_once(df: DataFrame, chg: DataFrame, key: str, gate: str, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """First write wins: columns change only while ``gate`` is NULL (DM-10).

    Of several changes the first that fills the gate closes it; while none does, each
    replaces the one before.
    """
    filled = F.col(gate).isNotNull() if gate in chg.columns else F.lit(False)
    also = {"closing": _first_of(chg, key, order, filled)}
    closing = F.col(NEW + "closing")
    rules = {c: F.when(closing.isNotNull(), closing[c]).otherwise(F.col(NEW + c)) for c in cols}
    return _apply(df, chg, key, rules, only=F.col(gate).isNull(), order=order, also=also)


def update_keep_blank(
    df: DataFrame, chg: DataFrame, key: str, cols: list[str], gated: list[str], gate: str, order: list[str] | None = None
) -> DataFrame:
    """Update, but leave the gated columns alone when the new ``gate`` is blank (DM-10)."""
    filled = nvl(F.trim(F.col(gate)), "") != ""
    also = {"any": F.max(filled)} | {f"filled_{c}": _last_of(chg, key, order, filled, c) for c in gated}
    rules = {c: F.col(NEW + c) for c in cols}
    rules |= {c: F.when(F.col(NEW + "any"), F.col(f"{NEW}filled_{c}")).otherwise(F.col(c)) for c in gated}
    return _apply(df, chg, key, rules, order=order, also=also)


# Delivery states that count as queued, sent and reset.
QUEUED, SENT_MAIL = 1, 3


def apply_visit_delivery(waits: DataFrame, outcomes: DataFrame, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """Outcome of sending a visit's pictures (DM-11).

    Rows with a manual send time record it in the manual columns, others in the
    automatic ones.  Going to the queue does not count as a try, every other outcome does; a
    message number of 0 or NULL keeps the one before.
    """
    manual = F.col("ManualTelegDate").isNotNull()
    status = F.col("new_TelegramStatus")
    numbered_message = nvl(F.col("TelegMessageId"), 0) != 0
    also = {
        "tries": F.count(F.when(nvl(F.col("TelegramStatus") != QUEUED, True), 1)),
        "message": _last_of(outcomes, "siWait", order, numbered_message, "TelegMessageId"),
    }
    tries = F.col("new_tries")
    rules = {
        "ManualTelegStatus": F.when(manual, status).otherwise(F.col("ManualTelegStatus")),
        "ManualTelegDate": F.when(manual, as_of),
        "TelegramStatus": F.when(manual, F.col("TelegramStatus")).otherwise(status),
        "SendDate": F.when(manual, F.col("SendDate")).otherwise(as_of),
        "TelegMessageId": F.coalesce("new_message", "TelegMessageId"),
        "TryCount": F.when(tries == 0, F.col("TryCount")).otherwise(nvl(F.col("TryCount"), 0) + tries),
        "AttachedCountTeleg": F.col("new_AttachedCount"),
    }
    return _apply(waits, outcomes, "siWait", rules, order=order, also=also)


def apply_lab_delivery(patients: DataFrame, outcomes: DataFrame, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """Outcome of sending a laboratory answer (DM-11); every one counts as a try."""
    rules = {
        "TelegramStatus": F.col("new_TelegramStatus"),
        "TelegMessageId": F.col("new_TelegMessageId"),
        "TryCount": nvl(F.col("TryCount"), 0) + F.col("new_tries"),
        "SendDate": as_of,
    }
    return _apply(patients, outcomes, "FileID", rules, order=order, also={"tries": F.count(F.lit(1))})


def reset_lab_delivery(patients: DataFrame, requests: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Put laboratory answers back into the queue (Mode 0) or take them out (Mode 1)."""
    rules = {
        "TelegramStatus": F.when(F.col("new_Mode") == 0, QUEUED),
        "TryCount": F.lit(0),
        "TelegMessageId": F.lit(None),
        "SendDate": F.lit(None),
    }
    return _apply(patients, requests, "FileID", rules, order=order)


def request_manual_delivery(waits: DataFrame, requests: DataFrame, as_of: Column, delay_minutes: int) -> DataFrame:
    """Queue visits by hand; the time is set so that the delay ends in one minute."""
    rules = {
        "ManualTelegDate": add_time(as_of, 1 - delay_minutes, "minute"),
        "ManualTelegStatus": F.lit(QUEUED),
        "TryCount": F.lit(0),
        "TelegMessageId": F.lit(None),
    }
    return _apply(waits, requests, "siWait", rules)


def apply_email(
    waits: DataFrame, outcomes: DataFrame, auto_visits: DataFrame, today: str, as_of: Column, order: list[str] | None = None
) -> DataFrame:
    """Outcome of an e-mail (DM-11).

    A sent mail also queues the visit for automatic delivery when it is among
    ``auto_visits`` (column ``siWait``).  Of several outcomes the last says the state, the last
    that sets or clears the time says the time, and any sent mail queues the visit.
    """
    flagged = outcomes.join(
        auto_visits.select("siWait").distinct().withColumn("Auto", F.lit(True)), "siWait", "left"
    )
    each = F.col("SentEMail")
    also = {
        "timed": _last_of(flagged, "siWait", order, each.isin(0, 2, SENT_MAIL), "SentEMail"),
        "sent": F.max(nvl(each == SENT_MAIL, False)),
    }
    state, timed = F.col("new_SentEMail"), F.col("new_timed")
    moved = nvl(F.col("new_Auto"), False) & F.col("new_sent")

    def stamp(col: str, value: Column) -> Column:
        return F.when(timed == 0, F.lit(None)).when(timed.isNotNull(), value).otherwise(F.col(col))

    rules = {
        "SentEMail": state,
        "AttachedCount": F.when(state != 0, F.col("new_AttachedCount")),
        "EMailDate": stamp("EMailDate", F.lit(today)),
        "EMailTime": stamp("EMailTime", hhmm(as_of)),
        "TelegramStatus": F.when(moved, QUEUED).otherwise(F.col("TelegramStatus")),
        "SendDate": F.when(moved, as_of).otherwise(F.col("SendDate")),
        "AttachedCountTeleg": F.when(moved, 0).otherwise(F.col("AttachedCountTeleg")),
    }
    return _apply(waits, flagged, "siWait", rules, order=order, also=also)


def mark_sms(df: DataFrame, keys: DataFrame, key: str, as_of: Column, status: str = "SentSMS", time: str = "SentSMSTime") -> DataFrame:
    """Mark messages as sent on the day of ``as_of`` (DM-11)."""
    day = as_of.cast("date")
    return _apply(df, keys.select(key), key, {status: F.lit(1), time: day})


def repair_table(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Whole-table repair: all rules see the old row (DM-12)."""
    return df.withColumns(rules)


# Columns a step change clears, by the new step.
STEP_RESETS = {1: ("WaitCheck", "MachineCheck"), 2: ("WaitCall", "MachinePhoto")}


def apply_status(waits: DataFrame, chg: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Step change that clears what later steps had recorded (DM-13).

    Of several changes the last says the step, and each clears its columns.
    """
    rules = {"Status": F.col("new_Status")}
    for code, cols in STEP_RESETS.items():
        for c in cols:
            rules[c] = F.when(~F.col(f"new_back_{code}"), F.col(c))
    also = {f"back_{code}": F.max(nvl(F.col("Status") == code, False)) for code in STEP_RESETS}
    return _apply(waits, chg, "siWait", rules, order=order, also=also)
