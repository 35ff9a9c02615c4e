"""Queries for batch table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardflow.bindings.basics import AS_OF, SHORT_DATES, now, short_dates
from wardflow.bindings.registry import query
from wardflow.functions import dates, text
from wardflow.operators import aggs, maintenance as dm
from wardflow.operators.joins import split_rows
from wardflow.operators.workflow import TIMES, apply_3d_transition, apply_to_waits, paid_events
from wardflow.plans import upkeep

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(name: str):
    return F.date_format(name, STAMP).alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query(
    "dm_01_append",
    """SELECT siAccount, siFiles, PayableFee FROM accounts
       UNION ALL SELECT (SELECT max(siAccount) FROM accounts) + row_number() OVER (ORDER BY siFiles, siCommonTariff, UsedPrice, Number NULLS FIRST), siFiles, UsedPrice
       FROM services WHERE Type = 1""",
)
def _(t):
    accounts = t["accounts"].select("siAccount", "siFiles", "PayableFee")
    new = t["services"].where(c("Type") == 1).select(
        "siFiles", c("UsedPrice").alias("PayableFee"), "siCommonTariff", "Number"
    )
    order = ["siFiles", "siCommonTariff", "PayableFee", "Number"]
    return dm.append(accounts, new, "siAccount", order).select("siAccount", "siFiles", "PayableFee")


@query(
    "dm_02_update",
    """SELECT f.siFiles, CASE WHEN a.siAlbum IS NULL THEN f.Subject ELSE a.AlbumName END AS Subject,
         CASE WHEN a.siAlbum IS NULL THEN f.Comment ELSE a.Comment END AS Comment, f.LName
       FROM files f LEFT JOIN albums a ON a.siFiles = f.siFiles""",
)
def _(t):
    files = t["files"].select("siFiles", "Subject", "Comment", "LName")
    chg = t["albums"].select("siFiles", c("AlbumName").alias("Subject"), "Comment")
    return dm.update_by_key(files, chg, "siFiles", ["Subject", "Comment"])


@query(
    "dm_02_repeated_changes",
    """SELECT c_custkey, CASE WHEN e.user_id IS NULL THEN c_mktsegment ELSE e.event_type END AS c_mktsegment
       FROM customer LEFT JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS e
         ON e.user_id = c_custkey AND e.n = 1""",
)
def _(t):
    chg = t["events"].select(c("user_id").alias("c_custkey"), c("event_type").alias("c_mktsegment"), "ts", "event_id")
    held = t["customer"].select("c_custkey", "c_mktsegment")
    return dm.update_by_key(held, chg, "c_custkey", ["c_mktsegment"], order=["ts", "event_id"])


@query(
    "dm_03_upsert",
    f"""SELECT coalesce(n.FileID, o.FileID) AS FileID, CASE WHEN n.FileID IS NULL THEN o.Status ELSE n.siHospital % 11 END AS Status,
         CASE WHEN n.FileID IS NULL THEN strftime(o.LogDate, '%Y-%m-%d %H:%M:%S') ELSE '{AS_OF}' END AS LogDate
       FROM deletion_log o FULL JOIN (SELECT * FROM files WHERE Is3D = 1 OR Bef_Aft = 1) n ON n.FileID = o.FileID""",
)
def _(t):
    chg = t["files"].where((c("Is3D") == 1) | (c("Bef_Aft") == 1)).select(
        "FileID", (c("siHospital") % 11).alias("Status"), now().alias("LogDate")
    )
    return dm.upsert(t["deletion_log"], chg, "FileID").select("FileID", "Status", stamp("LogDate"))


@query("dm_04_delete", "SELECT siFiles, siServiceTable FROM services WHERE siFiles NOT IN (SELECT siFiles FROM account_log)")
def _(t):
    return dm.delete_by_key(t["services"].select("siFiles", "siServiceTable"), t["account_log"], "siFiles")


@query(
    "dm_05_update_from",
    """SELECT d.siDoctors, CASE WHEN l.fCode IS NULL THEN d.Job ELSE l.fLastName END AS Job,
         CASE WHEN l.fCode IS NULL THEN d.Tag1 ELSE d.Tag1 + coalesce(l.fCodeSpecialty, 0) END AS Tag1
       FROM doctors d LEFT JOIN (SELECT * FROM lab_doctors WHERE fMedicalNo IS NOT NULL) l ON l.fCode = d.siDoctors""",
)
def _(t):
    src = t["lab_doctors"].where(c("fMedicalNo").isNotNull()).select(
        c("fCode").alias("siDoctors"), "fLastName", "fCodeSpecialty"
    )
    mapping = {"Job": c("new_fLastName"), "Tag1": c("Tag1") + F.coalesce("new_fCodeSpecialty", F.lit(0))}
    return dm.update_from(t["doctors"].select("siDoctors", "Job", "Tag1"), src, "siDoctors", mapping)


@query(
    "dm_06_insert_missing",
    """SELECT siDoctors, ForceAfter, Comment FROM private_tariffs
       UNION ALL SELECT siDoctors, NULL, Job FROM doctors WHERE siDoctors NOT IN (SELECT siDoctors FROM private_tariffs)""",
)
def _(t):
    table = t["private_tariffs"].select("siDoctors", "ForceAfter", "Comment")
    src = t["doctors"].select("siDoctors", c("Job").alias("Comment"))
    return dm.insert_missing(table, src, "siDoctors")


@query(
    "dm_07_split_delete",
    """SELECT FileID, CASE WHEN RegisterDate IS NULL AND date_diff('day', MiladiDate, DATE '1999-01-01') >= 30 THEN 'removed' ELSE 'kept' END AS side FROM lab_patients""",
)
def _(t):
    old = dates.datediff_boundary("day", c("MiladiDate"), dates.timestamp_lit("1999-01-01 00:00:00")) >= 30
    kept, removed = dm.split_delete(t["lab_patients"], c("RegisterDate").isNull() & old)
    return kept.select("FileID", F.lit("kept").alias("side")).union(removed.select("FileID", F.lit("removed")))


@query(
    "dm_08_refresh",
    """WITH l AS (SELECT siAlbum, string_agg(DISTINCT trim(SurgeryName), ', ' ORDER BY trim(SurgeryName)) AS List
         FROM album_procedures JOIN procedures ON procedures.siSurgery = album_procedures.siSurgery GROUP BY siAlbum),
         x AS (SELECT DISTINCT f.siFiles FROM files f JOIN doctors d ON d.siDoctors = f.siDoctor JOIN album_procedures a ON a.siAlbum = f.siFiles
               JOIN procedures p ON p.siSurgery = a.siSurgery WHERE list_contains(list_transform(string_split(d.Filter, ','), lambda i: trim(i)), trim(p.SurgeryName)))
       SELECT f.siFiles, l.List AS Subject, CASE WHEN x.siFiles IS NOT NULL THEN 1 END AS HasFilterList
       FROM files f LEFT JOIN l ON l.siAlbum = f.siFiles LEFT JOIN x ON x.siFiles = f.siFiles""",
)
def _(t):
    names = t["procedures"].select("siSurgery", F.trim("SurgeryName").alias("SurgeryName"))
    held = t["album_procedures"].join(names, "siSurgery").select(c("siAlbum").alias("siFiles"), "SurgeryName")
    held = held.distinct()
    files = t["files"].select("siFiles", "siDoctor", "Subject", "HasFilterList")
    files = dm.refresh_derived(files, aggs.name_list(held, "siFiles", "SurgeryName"), "siFiles", "Subject")
    barred = split_rows(t["doctors"].select(c("siDoctors").alias("siDoctor"), "Filter"), "Filter", out="SurgeryName")
    hits = files.select("siFiles", "siDoctor").join(held, "siFiles").join(
        barred.select("siDoctor", "SurgeryName"), ["siDoctor", "SurgeryName"]
    )
    flags = hits.select("siFiles").distinct().withColumn("flag", F.lit(1))
    return dm.refresh_derived(files, flags, "siFiles", "HasFilterList").drop("siDoctor")


@query(
    "dm_09_snapshot",
    f"""SELECT siAccount, siFiles, PayableFee, '{AS_OF}' AS LogDateTime, 'cancel' AS LogType FROM accounts
       WHERE siFiles IN (SELECT siFiles FROM waits WHERE Status = 16)""",
)
def _(t):
    rows = t["accounts"].select("siAccount", "siFiles", "PayableFee")
    keys = t["waits"].where(c("Status") == 16)
    return dm.snapshot(rows, keys, "siFiles", "cancel", now()).withColumn(
        "LogDateTime", F.date_format("LogDateTime", STAMP)
    )


@query(
    "dm_10_set_once",
    """SELECT siWait, CASE WHEN Status >= 4 AND WaitCheck IS NULL THEN WaitTimeOut ELSE WaitCheck END AS WaitCheck,
         CASE WHEN Status >= 4 AND WaitCheck IS NULL THEN 'desk' ELSE MachineCheck END AS MachineCheck FROM waits""",
)
def _(t):
    waits = t["waits"].select("siWait", "WaitCheck", "MachineCheck")
    chg = t["waits"].where(c("Status") >= 4).select(
        "siWait", c("WaitTimeOut").alias("WaitCheck"), F.lit("desk").alias("MachineCheck")
    )
    return dm.set_once(waits, chg, "siWait", "WaitCheck", ["WaitCheck", "MachineCheck"])


@query(
    "dm_10_keep_blank",
    """SELECT siWait, props AS Comment, CASE WHEN siWait % 3 <> 0 THEN WaitTimeOut ELSE WaitTime END AS WaitTime,
         CASE WHEN siWait % 3 <> 0 THEN 16 ELSE Status END AS Status FROM waits JOIN events ON event_id = siWait""",
)
def _(t):
    waits = t["waits"].select("siWait", F.lit("old").alias("Comment"), "WaitTime", "Status")
    k = c("siWait") % 3
    time = F.when(k == 0, F.when(c("Edited").isNull(), "")).otherwise(c("WaitTimeOut"))
    chg = t["waits"].select("siWait", "Comment", time.alias("WaitTime"), F.lit(16).alias("Status"))
    return dm.update_keep_blank(waits, chg, "siWait", ["Comment"], ["WaitTime", "Status"], "WaitTime")


WAIT_COLS = ["siWait", "TelegramStatus", "ManualTelegStatus", "TelegMessageId", "TryCount", "AttachedCountTeleg"]


@query(
    "dm_11_visit_delivery",
    f"""WITH o AS (SELECT siWait AS k, Status % 6 AS s, nullif(siWait % 4, 1) AS m, AttachedCount AS a FROM waits WHERE Status >= 4)
       SELECT siWait, CASE WHEN k IS NULL OR ManualTelegDate IS NOT NULL THEN TelegramStatus ELSE s END AS TelegramStatus,
         CASE WHEN k IS NOT NULL AND ManualTelegDate IS NOT NULL THEN s ELSE ManualTelegStatus END AS ManualTelegStatus,
         CASE WHEN k IS NOT NULL AND coalesce(m, 0) <> 0 THEN m ELSE TelegMessageId END AS TelegMessageId,
         CASE WHEN k IS NOT NULL AND s <> 1 THEN coalesce(TryCount, 0) + 1 ELSE TryCount END AS TryCount,
         CASE WHEN k IS NOT NULL THEN a ELSE AttachedCountTeleg END AS AttachedCountTeleg,
         CASE WHEN k IS NOT NULL AND ManualTelegDate IS NULL THEN '{AS_OF}' ELSE strftime(SendDate, '%Y-%m-%d %H:%M:%S') END AS SendDate,
         CASE WHEN k IS NOT NULL AND ManualTelegDate IS NOT NULL THEN '{AS_OF}' ELSE strftime(ManualTelegDate, '%Y-%m-%d %H:%M:%S') END AS ManualTelegDate
       FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    outcomes = t["waits"].where(c("Status") >= 4).select(
        "siWait",
        (c("Status") % 6).alias("TelegramStatus"),
        F.nullif(c("siWait") % 4, F.lit(1)).alias("TelegMessageId"),
        "AttachedCount",
    )
    waits = t["waits"].select(*WAIT_COLS, "SendDate", "ManualTelegDate")
    out = dm.apply_visit_delivery(waits, outcomes, now())
    return out.select(*WAIT_COLS, stamp("SendDate"), stamp("ManualTelegDate"))


LAB_COLS = ["FileID", "TelegramStatus", "TelegMessageId", "TryCount"]


@query(
    "dm_11_lab_delivery",
    f"""SELECT FileID, CASE WHEN Status = 3 THEN 2 ELSE TelegramStatus END AS TelegramStatus, CASE WHEN Status = 3 THEN FileID ELSE TelegMessageId END AS TelegMessageId,
         CASE WHEN Status = 3 THEN coalesce(TryCount, 0) + 1 ELSE TryCount END AS TryCount,
         CASE WHEN Status = 3 THEN '{AS_OF}' ELSE strftime(SendDate, '%Y-%m-%d %H:%M:%S') END AS SendDate FROM lab_patients""",
)
def _(t):
    outcomes = t["lab_patients"].where(c("Status") == 3).select(
        "FileID", F.lit(2).alias("TelegramStatus"), c("FileID").alias("TelegMessageId")
    )
    out = dm.apply_lab_delivery(t["lab_patients"].select(*LAB_COLS, "SendDate"), outcomes, now())
    return out.select(*LAB_COLS, stamp("SendDate"))


@query(
    "dm_11_lab_reset",
    """SELECT FileID, CASE Status WHEN 1 THEN NULL WHEN 3 THEN 1 ELSE TelegramStatus END AS TelegramStatus,
         CASE WHEN Status IN (1, 3) THEN NULL ELSE TelegMessageId END AS TelegMessageId,
         CASE WHEN Status IN (1, 3) THEN 0 ELSE TryCount END AS TryCount,
         CASE WHEN Status NOT IN (1, 3) THEN strftime(SendDate, '%Y-%m-%d %H:%M:%S') END AS SendDate FROM lab_patients""",
)
def _(t):
    mode = F.when(c("Status") == 3, 0).otherwise(1)
    requests = t["lab_patients"].where(c("Status").isin(1, 3)).select("FileID", mode.alias("Mode"))
    out = dm.reset_lab_delivery(t["lab_patients"].select(*LAB_COLS, "SendDate"), requests)
    return out.select(*LAB_COLS, stamp("SendDate"))


@query(
    "dm_11_manual_request",
    """SELECT siWait, CASE WHEN SurgStatus = 1 THEN 1 ELSE ManualTelegStatus END AS ManualTelegStatus, CASE WHEN SurgStatus = 1 THEN 0 ELSE TryCount END AS TryCount,
         CASE WHEN SurgStatus = 1 THEN NULL ELSE TelegMessageId END AS TelegMessageId,
         CASE WHEN SurgStatus = 1 THEN '2024-01-30 11:56:00' ELSE strftime(ManualTelegDate, '%Y-%m-%d %H:%M:%S') END AS ManualTelegDate FROM waits""",
)
def _(t):
    cols = ["siWait", "ManualTelegStatus", "TryCount", "TelegMessageId"]
    out = dm.request_manual_delivery(
        t["waits"].select(*cols, "ManualTelegDate"), t["waits"].where(c("SurgStatus") == 1).select("siWait"), now(), 5
    )
    return out.select(*cols, stamp("ManualTelegDate"))


@query(
    "dm_11_email",
    f"""WITH auto AS (SELECT siWait AS w FROM waits JOIN files ON files.siFiles = waits.siFiles JOIN doctors ON siDoctors = siDoctor
           WHERE IsActiveTelegClinic = 1 AND TelegramClinic IS NOT NULL AND coalesce(IsAuto, 0) = 1 AND coalesce(HasFilterList, 0) = 0),
         o AS (SELECT siWait AS k, siWait % 4 AS s, siWait % 9 AS a FROM waits WHERE Status IN (8, 16))
       SELECT siWait, CASE WHEN k IS NULL THEN SentEMail ELSE s END AS SentEMail,
         CASE WHEN k IS NULL THEN AttachedCount WHEN s = 0 THEN NULL ELSE a END AS AttachedCount,
         CASE WHEN s IN (2, 3) THEN '1402/11/10' WHEN s = 0 THEN NULL ELSE EMailDate END AS EMailDate,
         CASE WHEN s IN (2, 3) THEN '12:00' WHEN s = 0 THEN NULL ELSE EMailTime END AS EMailTime,
         CASE WHEN s = 3 AND w IS NOT NULL THEN 1 ELSE TelegramStatus END AS TelegramStatus,
         CASE WHEN s = 3 AND w IS NOT NULL THEN 0 ELSE AttachedCountTeleg END AS AttachedCountTeleg,
         CASE WHEN s = 3 AND w IS NOT NULL THEN '{AS_OF}' ELSE strftime(SendDate, '%Y-%m-%d %H:%M:%S') END AS SendDate
       FROM waits LEFT JOIN o ON k = siWait LEFT JOIN auto ON w = siWait""",
)
def _(t):
    doctors = t["doctors"].where(
        (c("IsActiveTelegClinic") == 1) & c("TelegramClinic").isNotNull() & (F.coalesce("IsAuto", F.lit(0)) == 1)
    )
    visits = t["files"].where(F.coalesce("HasFilterList", F.lit(0)) == 0).select("siFiles", "siDoctor")
    visits = visits.join(doctors.select(c("siDoctors").alias("siDoctor")), "siDoctor", "left_semi")
    auto = t["waits"].select("siWait", "siFiles").join(visits.select("siFiles"), "siFiles", "left_semi")
    outcomes = t["waits"].where(c("Status").isin(8, 16)).select(
        "siWait", (c("siWait") % 4).alias("SentEMail"), (c("siWait") % 9).alias("AttachedCount")
    )
    cols = ["siWait", "SentEMail", "AttachedCount", "EMailDate", "EMailTime", "TelegramStatus", "AttachedCountTeleg"]
    out = dm.apply_email(t["waits"].select(*cols, "SendDate"), outcomes, auto, "1402/11/10", now())
    return out.select(*cols, stamp("SendDate"))


@query(
    "dm_11_sms",
    """SELECT siWait, CASE WHEN Status = 8 THEN 1 ELSE SentSMS END AS SentSMS,
         CASE WHEN Status = 8 THEN '2024-01-30 00:00:00' ELSE strftime(SentSMSTime, '%Y-%m-%d %H:%M:%S') END AS SentSMSTime FROM waits""",
)
def _(t):
    waits = t["waits"].select("siWait", "SentSMS", "SentSMSTime")
    out = dm.mark_sms(waits, t["waits"].where(c("Status") == 8), "siWait", now())
    return out.select("siWait", "SentSMS", stamp("SentSMSTime"))


@query(
    "dm_12_repair",
    f"""SELECT q.o_orderkey, CASE WHEN q.d IS NOT NULL THEN '13' || y || '/' || m || '/' || dd END AS ReferDate,
         CASE WHEN q.d IS NOT NULL THEN CAST('13' || y AS INT) - CAST(f.BirthYear AS INT) END AS Age
       FROM ({SHORT_DATES}) AS q JOIN files f ON f.siFiles = q.o_orderkey""",
)
def _(t):
    births = t["files"].select(c("siFiles").alias("o_orderkey"), "BirthYear")
    rows = short_dates(t).join(births, "o_orderkey").withColumnRenamed("d", "ReferDate")
    fixed = dm.repair_table(rows, {"ReferDate": dates.repair_date(c("ReferDate"))})
    from wardflow.functions.numbers import age

    aged = dm.repair_table(fixed, {"Age": age(c("BirthYear"), c("ReferDate"))})
    return aged.select("o_orderkey", "ReferDate", "Age")


@query(
    "dm_13_status",
    """WITH k AS (SELECT siWait AS w, CASE Status WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 16 END AS s FROM waits WHERE Status IN (2, 4, 8))
       SELECT siWait, coalesce(s, Status) AS Status, CASE WHEN s = 1 THEN NULL ELSE WaitCheck END AS WaitCheck, CASE WHEN s = 1 THEN NULL ELSE MachineCheck END AS MachineCheck,
         CASE WHEN s = 2 THEN NULL ELSE WaitCall END AS WaitCall, CASE WHEN s = 2 THEN NULL ELSE MachinePhoto END AS MachinePhoto
       FROM waits LEFT JOIN k ON w = siWait""",
)
def _(t):
    step = F.when(c("Status") == 2, 1).when(c("Status") == 4, 2).otherwise(16)
    chg = t["waits"].where(c("Status").isin(2, 4, 8)).select("siWait", step.alias("Status"))
    cols = ["siWait", "Status", "WaitCheck", "MachineCheck", "WaitCall", "MachinePhoto"]
    return dm.apply_status(t["waits"].select(*cols), chg)


def _walk_sql() -> str:
    """Recursive walk over the events of each visit, one step per round; ``z`` has the last state."""
    times = ", ".join(TIMES)

    def time(name: str, step: int) -> str:
        later = "b.step IN (1, 10)" if step > 10 else "b.step = 1"
        value = f"CASE WHEN b.undo = 1 THEN NULL ELSE b.at END"
        own = f"WHEN b.step = {step} THEN {value} "
        return (
            f"CASE WHEN NOT a.here AND b.step = 1 THEN {'b.at' if step == 1 else 'NULL'} WHEN NOT a.here THEN NULL "
            f"WHEN b.step = 1 AND b.undo = 1 AND a.LastStatus IS NULL THEN NULL {own}"
            f"{'' if step == 1 else f'WHEN {later} THEN NULL '}ELSE a.{name} END"
        )

    moves = ", ".join(time(n, s) for n, s in zip(TIMES, (1, 5, 10, 16, 20)))
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY siFiles ORDER BY seq) AS n FROM step_events),
      w AS (
        SELECT k.siFiles, CAST(0 AS BIGINT) AS n, t.siFiles IS NOT NULL AS here, t.Status, t.LastStatus, {', '.join('t.' + x for x in TIMES)},
          0 AS wait, false AS reset, CAST(NULL AS VARCHAR) AS photo
        FROM (SELECT siFiles FROM step_events UNION SELECT siFiles FROM waits_3d) k LEFT JOIN waits_3d t ON t.siFiles = k.siFiles
        UNION ALL
        SELECT a.siFiles, b.n,
          CASE WHEN NOT a.here THEN b.step = 1 ELSE NOT (b.step = 1 AND b.undo = 1 AND a.LastStatus IS NULL) END,
          CASE WHEN NOT a.here THEN CASE WHEN b.step = 1 THEN 1 END WHEN b.undo = 0 THEN b.step WHEN b.step = 10 THEN 5 ELSE a.LastStatus END,
          CASE WHEN NOT a.here THEN NULL WHEN b.step = 1 AND b.undo = 1 AND a.LastStatus IS NULL THEN NULL ELSE a.Status END,
          {moves},
          CASE WHEN NOT a.here THEN a.wait WHEN b.step = 1 AND b.undo = 1 AND a.LastStatus IS NULL THEN 2 WHEN b.step = 10 AND b.undo = 0 THEN 4 ELSE a.wait END,
          a.reset OR (a.here AND b.step = 1 AND b.undo = 1 AND a.LastStatus IS NULL),
          coalesce(a.photo, CASE WHEN a.here AND b.step = 10 AND b.undo = 0 THEN strftime(b.at, '%H:%M') END)
        FROM w a JOIN e b ON b.siFiles = a.siFiles AND b.n = a.n + 1),
      z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY siFiles ORDER BY n DESC) AS back FROM w) AS y WHERE back = 1)"""


WORKFLOW_SQL = f"""{_walk_sql()} SELECT siFiles, Status, LastStatus, {', '.join(f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {x}" for x in TIMES)} FROM z WHERE here"""


@query("dm_14_workflow", WORKFLOW_SQL)
def _(t):
    table, _ = apply_3d_transition(t["waits_3d"], t["step_events"])
    return table.select("siFiles", "Status", "LastStatus", *[stamp(x) for x in TIMES])


@query("dm_14_small_slices", WORKFLOW_SQL)
def _(t):
    """The same with slices of five events, so that most visits have several."""
    table, _ = apply_3d_transition(t["waits_3d"], t["step_events"], slice_size=5)
    return table.select("siFiles", "Status", "LastStatus", *[stamp(x) for x in TIMES])


@query(
    "dm_14_waits",
    f"""{_walk_sql()} SELECT v.siWait, v.siFiles, CASE WHEN z.wait > 0 THEN z.wait ELSE v.Status END AS Status, CASE WHEN z.wait > 0 AND z.reset THEN NULL ELSE v.WaitCall END AS WaitCall,
        CASE WHEN z.wait > 0 AND z.reset THEN NULL ELSE v.MachinePhoto END AS MachinePhoto, coalesce(v.WaitPhoto, z.photo) AS WaitPhoto
      FROM waits v LEFT JOIN z ON z.siFiles = v.siFiles""",
)
def _(t):
    _, asked = apply_3d_transition(t["waits_3d"], t["step_events"])
    waits = t["waits"].select("siWait", "siFiles", "Status", "WaitCall", "MachinePhoto", "WaitPhoto")
    return apply_to_waits(waits, asked)


@query(
    "dm_13_paid_3d",
    f"""WITH p AS (SELECT DISTINCT siFiles FROM waits WHERE Status = 8)
      SELECT x.siFiles, CASE WHEN p.siFiles IS NOT NULL AND x.Status < 16 THEN 16 ELSE x.Status END AS Status,
        CASE WHEN p.siFiles IS NOT NULL AND x.Status < 16 THEN '{AS_OF}' ELSE strftime(x.PaidTime, '%Y-%m-%d %H:%M:%S') END AS PaidTime
      FROM waits_3d x LEFT JOIN p ON p.siFiles = x.siFiles""",
)
def _(t):
    chg = t["waits"].where(c("Status") == 8).select("siWait", F.lit(16).alias("Status"))
    events = paid_events(chg, t["waits"], t["waits_3d"], now())
    return apply_3d_transition(t["waits_3d"], events)[0].select("siFiles", "Status", stamp("PaidTime"))


# ------------------------------------------------------ multi-table upkeep

@query(
    "dm_09_cancel_accounts",
    f"""WITH g AS (SELECT * FROM accounts WHERE Type = 1 AND RoundAmount >= 5), v AS (SELECT DISTINCT siFiles FROM g)
      SELECT 'accounts' AS part, siAccount AS key, NULL AS value FROM accounts WHERE siAccount NOT IN (SELECT siAccount FROM g)
      UNION ALL SELECT 'account_log', siAccount, PayableFee FROM account_log
      UNION ALL SELECT 'account_log', siAccount, PayableFee FROM g
      UNION ALL SELECT 'service_log', siAccount, UsedPrice FROM service_log
      UNION ALL SELECT 'service_log', g.siAccount, s.UsedPrice FROM services s JOIN g ON g.siFiles = s.siFiles
      UNION ALL SELECT 'waits', siWait, CASE WHEN siFiles IN (SELECT siFiles FROM v) THEN 8 ELSE Status END FROM waits
      UNION ALL SELECT 'waits_3d', siFiles, CASE WHEN Status = 16 AND siFiles IN (SELECT siFiles FROM v) THEN LastStatus ELSE Status END FROM waits_3d""",
)
def _(t):
    gone = t["accounts"].where((c("Type") == 1) & (c("RoundAmount") >= 5)).select("siAccount")
    new = upkeep.cancel_accounts(t, gone, "cancel", now())
    shown = {
        "accounts": ("siAccount", F.lit(None)),
        "account_log": ("siAccount", c("PayableFee")),
        "service_log": ("siAccount", c("UsedPrice")),
        "waits": ("siWait", c("Status")),
        "waits_3d": ("siFiles", c("Status")),
    }
    parts = [
        new[n].select(F.lit(n).alias("part"), c(key).alias("key"), value.cast("bigint").alias("value"))
        for n, (key, value) in shown.items()
    ]
    return reduce(lambda a, b: a.union(b), parts)


@query(
    "dm_05_link_doctors",
    f"""WITH k AS (SELECT f.FileID AS id, f.siDoctor AS doc, rtrim(concat(d.FName, ' ', d.LName)) AS name FROM files f LEFT JOIN doctors d ON d.siDoctors = f.siDoctor WHERE f.Is3D = 1)
      SELECT FileID, coalesce(doc, siDoctor) AS siDoctor, CASE WHEN id IS NULL THEN DoctorName ELSE name END AS DoctorName, CASE WHEN id IS NULL THEN AutoStatus ELSE 2 END AS AutoStatus,
        CASE WHEN id IS NOT NULL AND Status = 3 AND AnswerDate IS NOT NULL THEN '{AS_OF}' ELSE strftime(AnswerDate, '%Y-%m-%d %H:%M:%S') END AS AnswerDate
      FROM lab_patients LEFT JOIN k ON id = FileID""",
)
def _(t):
    links = t["files"].where(c("Is3D") == 1).select("FileID", "siDoctor")
    out = upkeep.link_doctors(t, links, now())
    return out.select("FileID", "siDoctor", "DoctorName", "AutoStatus", stamp("AnswerDate"))


@query(
    "dm_05_reset_links",
    """WITH k AS (SELECT a.fCode AS code, b.fFirstName AS name FROM lab_acceptances a JOIN lab_doctors b ON b.fCode = a.fCodeDoctor WHERE a.fPutAnswer = 1)
      SELECT FileID, CASE WHEN code IS NULL THEN DoctorName ELSE name END AS DoctorName, CASE WHEN code IS NULL THEN siDoctor END AS siDoctor, CASE WHEN code IS NULL THEN AutoStatus END AS AutoStatus,
        CASE WHEN code IS NULL THEN TryCount END AS TryCount, CASE WHEN code IS NULL THEN TelegramStatus END AS TelegramStatus
      FROM lab_patients LEFT JOIN k ON code = fCode""",
)
def _(t):
    codes = t["lab_acceptances"].where(c("fPutAnswer") == 1).select("fCode")
    return upkeep.reset_links(t, codes).select(
        "FileID", "DoctorName", "siDoctor", "AutoStatus", "TryCount", "TelegramStatus"
    )


@query(
    "dm_03_link_patients",
    """WITH k AS (SELECT f.FileID AS id, a.*, f.DoctorName AS doc, d.MedicalID AS med FROM files f JOIN doctors d ON d.siDoctors = f.siDoctor JOIN lab_acceptances a ON a.fCode = f.siFiles + 7000000 WHERE f.Bef_Aft = 0 AND f.PaidAfter = 1)
      SELECT coalesce(p.FileID, k.id) AS FileID, CASE WHEN k.id IS NULL THEN p.fCode ELSE k.fCode END AS fCode, CASE WHEN k.id IS NULL THEN p.Mobile ELSE k.fMobile END AS Mobile,
        CASE WHEN k.id IS NULL THEN p.SendType ELSE CASE k.fEmergency WHEN 1 THEN 0 WHEN 0 THEN 1 END END AS SendType, CASE WHEN k.id IS NULL THEN p.DoctorName ELSE k.doc END AS DoctorName,
        p.Phone1, if(k.id IS NULL, p.SendStatus, ['عادي', 'اورژانس'][k.fEmergency + 1]) AS SendStatus, if(k.id IS NULL, p.BirthYear, k.fBirthDate[1:4]) AS BirthYear,
        if(k.id IS NULL, p.MedicalID, k.med) AS MedicalID, if(k.id IS NULL, p.Sex, k.fSex) AS Sex, if(k.id IS NULL, p.SexTitle, ['زن', 'مرد'][k.fSex + 1]) AS SexTitle,
        CASE WHEN k.id IS NULL THEN p.Status WHEN k.fCancellation = 1 THEN 2 WHEN k.fPutAnswer = 1 THEN 3 ELSE 1 END AS Status,
        CASE WHEN p.FileID IS NULL THEN 0 ELSE p.TelegramStatus END AS TelegramStatus
      FROM lab_patients p FULL JOIN k ON k.id = p.FileID""",
)
def _(t):
    links = t["files"].where((c("Bef_Aft") == 0) & (c("PaidAfter") == 1)).select(
        "FileID", (c("siFiles") + 7000000).alias("fCode")
    )
    return upkeep.link_patients(t, links).select(
        "FileID", "fCode", "Mobile", "SendType", "DoctorName", "Status", "TelegramStatus",
        "Phone1", "SendStatus", "BirthYear", "MedicalID", "Sex", "SexTitle",
    )


# --------------------------------------------- several changes of one key

LATER = "(ts, event_id)"


def in_turn(t, **cols):
    """Changes from the event stream: several for each waiting entry, in order of time and number."""
    return t["events"].select(c("user_id").alias("siWait"), *[v.alias(n) for n, v in cols.items()], "ts", "event_id")


TURN = ["ts", "event_id"]


@query(
    "dm_11_repeated_delivery",
    f"""WITH o AS (SELECT user_id AS k, arg_max(event_id % 6, {LATER}) AS s, arg_max(event_id % 7, {LATER}) AS a, count(*) FILTER (event_id % 6 <> 1) AS tries,
           arg_max(event_id % 4, {LATER}) FILTER (event_id % 4 <> 0) AS m FROM events GROUP BY user_id)
       SELECT siWait, CASE WHEN k IS NULL OR ManualTelegDate IS NOT NULL THEN TelegramStatus ELSE s END AS TelegramStatus,
         CASE WHEN k IS NOT NULL AND ManualTelegDate IS NOT NULL THEN s ELSE ManualTelegStatus END AS ManualTelegStatus, coalesce(m, TelegMessageId) AS TelegMessageId,
         CASE WHEN tries > 0 THEN coalesce(TryCount, 0) + tries ELSE TryCount END AS TryCount, CASE WHEN k IS NOT NULL THEN a ELSE AttachedCountTeleg END AS AttachedCountTeleg
       FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    n = c("event_id")
    outcomes = in_turn(t, TelegramStatus=n % 6, TelegMessageId=n % 4, AttachedCount=n % 7)
    waits = t["waits"].select(*WAIT_COLS, "SendDate", "ManualTelegDate")
    return dm.apply_visit_delivery(waits, outcomes, now(), order=TURN).select(*WAIT_COLS)


@query(
    "dm_11_repeated_lab_delivery",
    f"""WITH o AS (SELECT user_id + 1000 AS k, arg_max(event_id % 5, {LATER}) AS s, arg_max(event_id, {LATER}) AS m, count(*) AS tries FROM events GROUP BY user_id)
       SELECT FileID, CASE WHEN k IS NULL THEN TelegramStatus ELSE s END AS TelegramStatus, CASE WHEN k IS NULL THEN TelegMessageId ELSE m END AS TelegMessageId,
         CASE WHEN k IS NULL THEN TryCount ELSE coalesce(TryCount, 0) + tries END AS TryCount FROM lab_patients LEFT JOIN o ON k = FileID""",
)
def _(t):
    n = c("event_id")
    outcomes = t["events"].select((c("user_id") + 1000).alias("FileID"), (n % 5).alias("TelegramStatus"), n.alias("TelegMessageId"), "ts", "event_id")
    patients = t["lab_patients"].select(*LAB_COLS, "SendDate")
    return dm.apply_lab_delivery(patients, outcomes, now(), order=TURN).select(*LAB_COLS)


@query(
    "dm_11_repeated_email",
    f"""WITH o AS (SELECT user_id AS k, arg_max(event_id % 4, {LATER}) AS s, arg_max(event_id % 9, {LATER}) AS a, arg_max(event_id % 4, {LATER}) FILTER (event_id % 4 <> 1) AS d,
           bool_or(event_id % 4 = 3) AS sent FROM events GROUP BY user_id)
       SELECT siWait, CASE WHEN k IS NULL THEN SentEMail ELSE s END AS SentEMail, CASE WHEN k IS NULL THEN AttachedCount WHEN s <> 0 THEN a END AS AttachedCount,
         CASE WHEN d = 0 THEN NULL WHEN d > 0 THEN '1402/11/10' ELSE EMailDate END AS EMailDate, CASE WHEN sent AND siWait % 2 = 0 THEN 1 ELSE TelegramStatus END AS TelegramStatus
       FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    outcomes = in_turn(t, SentEMail=c("event_id") % 4, AttachedCount=c("event_id") % 9)
    auto = t["waits"].where(c("siWait") % 2 == 0).select("siWait")
    cols = ["siWait", "SentEMail", "AttachedCount", "EMailDate", "EMailTime", "TelegramStatus", "AttachedCountTeleg", "SendDate"]
    out = dm.apply_email(t["waits"].select(*cols), outcomes, auto, "1402/11/10", now(), order=TURN)
    return out.select("siWait", "SentEMail", "AttachedCount", "EMailDate", "TelegramStatus")


STEP_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END"


@query(
    "dm_13_repeated_status",
    f"""WITH o AS (SELECT user_id AS k, arg_max({STEP_SQL}, {LATER}) AS s, bool_or(event_type = 'view') AS back1, bool_or(event_type = 'click') AS back2 FROM events GROUP BY user_id)
       SELECT siWait, coalesce(s, Status) AS Status, CASE WHEN back1 THEN NULL ELSE WaitCheck END AS WaitCheck, CASE WHEN back1 THEN NULL ELSE MachineCheck END AS MachineCheck,
         CASE WHEN back2 THEN NULL ELSE WaitCall END AS WaitCall, CASE WHEN back2 THEN NULL ELSE MachinePhoto END AS MachinePhoto FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    cols = ["siWait", "Status", "WaitCheck", "MachineCheck", "WaitCall", "MachinePhoto"]
    return dm.apply_status(t["waits"].select(*cols), in_turn(t, Status=F.expr(STEP_SQL)), order=TURN)


@query(
    "dm_10_repeated_set_once",
    f"""WITH e AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN 'c' || event_id END AS g FROM events),
         o AS (SELECT user_id AS k, arg_min(struct_pack(g := g, m := event_type), {LATER}) FILTER (g IS NOT NULL) AS f, arg_max(event_type, {LATER}) AS l FROM e GROUP BY user_id)
       SELECT siWait, CASE WHEN WaitCheck IS NULL THEN f.g ELSE WaitCheck END AS WaitCheck,
         CASE WHEN WaitCheck IS NOT NULL OR k IS NULL THEN MachineCheck WHEN f IS NOT NULL THEN f.m ELSE l END AS MachineCheck FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    gate = F.when(c("event_id") % 3 > 0, F.concat(F.lit("c"), c("event_id").cast("string")))
    chg = in_turn(t, WaitCheck=gate, MachineCheck=c("event_type"))
    return dm.set_once(t["waits"].select("siWait", "WaitCheck", "MachineCheck"), chg, "siWait", "WaitCheck", ["WaitCheck", "MachineCheck"], order=TURN)


@query(
    "dm_10_repeated_keep_blank",
    f"""WITH o AS (SELECT user_id AS k, arg_max(event_type, {LATER}) AS m, arg_max('t' || event_id, {LATER}) FILTER (event_id % 3 = 1) AS g, bool_or(event_id % 3 = 1) AS filled FROM events GROUP BY user_id)
       SELECT siWait, CASE WHEN k IS NULL THEN Comment ELSE m END AS Comment, CASE WHEN filled THEN g ELSE WaitTime END AS WaitTime FROM waits LEFT JOIN o ON k = siWait""",
)
def _(t):
    blank = F.when(c("event_id") % 3 == 0, " ")
    time = F.when(c("event_id") % 3 == 1, F.concat(F.lit("t"), c("event_id").cast("string"))).otherwise(blank)
    chg = in_turn(t, Comment=c("event_type"), WaitTime=time)
    return dm.update_keep_blank(t["waits"].select("siWait", "Comment", "WaitTime"), chg, "siWait", ["Comment"], ["WaitTime"], "WaitTime", order=TURN)


@query(
    "dm_05_repeated_update_from",
    f"""WITH o AS (SELECT user_id AS k, arg_max(event_type, {LATER}) AS v FROM events GROUP BY user_id)
       SELECT siDoctors, coalesce(v, Job) AS Job, CASE WHEN k IS NULL THEN Tag1 ELSE Tag1 + length(v) END AS Tag1 FROM doctors LEFT JOIN o ON k = siDoctors""",
)
def _(t):
    src = t["events"].select(c("user_id").alias("siDoctors"), "event_type", "ts", "event_id")
    mapping = {"Job": F.coalesce("new_event_type", "Job"), "Tag1": c("Tag1") + F.length("new_event_type")}
    return dm.update_from(t["doctors"].select("siDoctors", "Job", "Tag1"), src, "siDoctors", mapping, order=TURN)
