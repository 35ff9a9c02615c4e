"""Queries whose result was written to a table and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.bindings.basics import AS_OF, now
from wardflow.bindings.registry import CHECKS, query
from wardflow.bindings.upkeep import STAMP, stamp
from wardflow.operators import aggs, maintenance as dm, sinks
from wardflow.plans import reports
from wardflow.session import shared_folder
from wardflow.sources.stores import KeyedTable, RunTable, bucketed
from wardflow.sources.trigrams import TextIndex

c = F.col
#: Keys of one part of the stored tables here; a part of a real table has some hundred megabytes.
WIDTH = 20_000


def place(t, name: str) -> str:
    """A new folder for a stored table, removed when the application ends."""
    folder = f"{shared_folder(t.spark)}/tables/{name}-{uuid.uuid4().hex}"
    jvm = t.spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return folder


def kept(t, df, by: str, name: str) -> KeyedTable:
    """The rows as a stored table in parts by ``by``."""
    table = KeyedTable(t.spark, place(t, name), df.schema, by, WIDTH)
    table.create(df)
    return table


@query("dm_01_stored_append", CHECKS["dm_01_append"])
def _(t):
    """Two runs, the second one started twice: its rows are not doubled and keep their keys."""
    accounts = t["accounts"].select("siAccount", "siFiles", "PayableFee")
    new = t["services"].where(c("Type") == 1).select("siFiles", c("UsedPrice").alias("PayableFee"), "siCommonTariff", "Number")
    order = ["siFiles", "siCommonTariff", "PayableFee", "Number"]
    table = RunTable(t.spark, place(t, "accounts"), accounts.schema)
    table.add(accounts, 0)
    for _ in range(2):
        sinks.append_run(table, new, "siAccount", order, run=1)
    return table.read()


@query(
    "dm_09_stored_snapshot",
    f"""WITH s AS (SELECT siAccount, siFiles, PayableFee FROM accounts)
      SELECT *, '{AS_OF}' AS LogDateTime, 'cancel' AS LogType FROM s WHERE siFiles IN (SELECT siFiles FROM waits WHERE Status = 16)
      UNION ALL SELECT *, '{AS_OF}', 'change' FROM s WHERE siFiles IN (SELECT siFiles FROM waits WHERE Status = 8)""",
)
def _(t):
    rows = t["accounts"].select("siAccount", "siFiles", "PayableFee")
    log = RunTable(t.spark, place(t, "account_log"), T.StructType([*rows.schema.fields]).add("LogDateTime", "timestamp_ntz").add("LogType", "string"))
    for run, status, kind in ((1, 16, "cancel"), (2, 8, "change"), (2, 8, "change")):
        sinks.snapshot_run(log, rows, t["waits"].where(c("Status") == status), "siFiles", kind, now(), run)
    return log.read().withColumn("LogDateTime", F.date_format("LogDateTime", STAMP))


@query(
    "dm_09_stored_services",
    """WITH g AS (SELECT siAccount, siFiles FROM accounts WHERE RoundAmount >= 5)
      SELECT g.siAccount, s.siFiles, s.siWait, s.siCommonTariff, s.Number, s.UsedPrice FROM services s JOIN g ON g.siFiles = s.siFiles""",
)
def _(t):
    changed = t["accounts"].where(c("RoundAmount") >= 5)
    log = RunTable(t.spark, place(t, "service_log"), t["service_log"].schema)
    sinks.snapshot_children(log, t["services"], changed, "siFiles", ["siAccount"], run=1)
    return log.read()


@query("dm_02_stored_update", CHECKS["dm_02_update"])
def _(t):
    files = kept(t, t["files"].select("siFiles", "Subject", "Comment", "LName"), "siFiles", "files")
    chg = t["albums"].select("siFiles", c("AlbumName").alias("Subject"), "Comment")
    for _ in range(2):
        out = sinks.stored_change(files, chg, dm.update_by_key, 1, key="siFiles", cols=["Subject", "Comment"])
    return out


@query("dm_03_stored_upsert", CHECKS["dm_03_upsert"])
def _(t):
    chg = t["files"].where((c("Is3D") == 1) | (c("Bef_Aft") == 1)).select("FileID", (c("siHospital") % 11).alias("Status"), now().alias("LogDate"))
    log = kept(t, t["deletion_log"], "FileID", "deletion_log")
    return sinks.stored_change(log, chg, dm.upsert, 1, key="FileID").select("FileID", "Status", stamp("LogDate"))


@query("dm_04_stored_delete", CHECKS["dm_04_delete"])
def _(t):
    services = kept(t, t["services"].select("siFiles", "siServiceTable"), "siFiles", "services")
    return sinks.stored_change(services, t["account_log"].select("siFiles"), dm.delete_by_key, 1, key="siFiles")


@query("dm_05_stored_update_from", CHECKS["dm_05_update_from"])
def _(t):
    src = t["lab_doctors"].where(c("fMedicalNo").isNotNull()).select(c("fCode").alias("siDoctors"), "fLastName", "fCodeSpecialty")
    mapping = {"Job": c("new_fLastName"), "Tag1": c("Tag1") + F.coalesce("new_fCodeSpecialty", F.lit(0))}
    doctors = kept(t, t["doctors"].select("siDoctors", "Job", "Tag1"), "siDoctors", "doctors")
    for _ in range(2):  # Tag1 is raised once
        out = sinks.stored_change(doctors, src, dm.update_from, 1, key="siDoctors", mapping=mapping)
    return out


@query("dm_06_stored_insert_missing", CHECKS["dm_06_insert_missing"])
def _(t):
    tariffs = kept(t, t["private_tariffs"].select("siDoctors", "ForceAfter", "Comment"), "siDoctors", "private_tariffs")
    src = t["doctors"].select("siDoctors", c("Job").alias("Comment"))
    return sinks.stored_change(tariffs, src, dm.insert_missing, 1, key="siDoctors")


@query(
    "dm_08_stored_refresh",
    """WITH l AS (SELECT siAlbum, string_agg(DISTINCT trim(SurgeryName), ', ' ORDER BY trim(SurgeryName)) AS List
         FROM album_procedures JOIN procedures ON procedures.siSurgery = album_procedures.siSurgery GROUP BY siAlbum)
       SELECT f.siFiles, CASE WHEN f.siHospital = 3 THEN l.List ELSE f.Subject END AS Subject FROM files f LEFT JOIN l ON l.siAlbum = f.siFiles""",
)
def _(t):
    """Only the visits of one hospital are refreshed."""
    names = t["procedures"].select("siSurgery", F.trim("SurgeryName").alias("SurgeryName"))
    lists = aggs.name_list(t["album_procedures"].join(names, "siSurgery").select(c("siAlbum").alias("siFiles"), "SurgeryName"), "siFiles", "SurgeryName")
    files = kept(t, t["files"].select("siFiles", "Subject"), "siFiles", "files")
    affected = t["files"].where(c("siHospital") == 3).select("siFiles")

    def refresh(rows, chosen):
        return dm.refresh_derived(rows, lists.join(chosen, "siFiles", "left_semi"), "siFiles", "Subject", chosen)

    files.rewrite(affected, refresh, 1)
    return files.read()


@query("dm_10_stored_set_once", CHECKS["dm_10_set_once"])
def _(t):
    waits = kept(t, t["waits"].select("siWait", "WaitCheck", "MachineCheck"), "siWait", "waits")
    chg = t["waits"].where(c("Status") >= 4).select("siWait", c("WaitTimeOut").alias("WaitCheck"), F.lit("desk").alias("MachineCheck"))
    return sinks.stored_change(waits, chg, dm.set_once, 1, key="siWait", gate="WaitCheck", cols=["WaitCheck", "MachineCheck"])


@query("dm_11_stored_lab_delivery", CHECKS["dm_11_lab_delivery"])
def _(t):
    cols = ["FileID", "TelegramStatus", "TelegMessageId", "TryCount"]
    outcomes = t["lab_patients"].where(c("Status") == 3).select("FileID", F.lit(2).alias("TelegramStatus"), c("FileID").alias("TelegMessageId"))
    patients = kept(t, t["lab_patients"].select(*cols, "SendDate"), "FileID", "lab_patients")
    for _ in range(2):  # a try counts once
        out = sinks.stored_change(patients, outcomes, dm.apply_lab_delivery, 1, as_of=now())
    return out.select(*cols, stamp("SendDate"))


@query("dm_13_stored_status", CHECKS["dm_13_status"])
def _(t):
    step = F.when(c("Status") == 2, 1).when(c("Status") == 4, 2).otherwise(16)
    chg = t["waits"].where(c("Status").isin(2, 4, 8)).select("siWait", step.alias("Status"))
    waits = kept(t, t["waits"].select("siWait", "Status", "WaitCheck", "MachineCheck", "WaitCall", "MachinePhoto"), "siWait", "waits")
    return sinks.stored_change(waits, chg, dm.apply_status, 1)


BUCKETS = 16


@query("cq_25_stored_audit", CHECKS["cq_25_account_audit"])
def _(t):
    """The accounts and their log lie in buckets of visits, so nothing is exchanged before they are united."""
    stored = {}
    for name in ("accounts", "account_log"):
        folder = place(t, name)
        stored[name] = bucketed(t[name], f"{name}_{folder[-32:]}", folder, "siFiles", BUCKETS)
    rows = reports.account_audit({**stored, "files": t["files"]}, "1377/01/01")
    return rows.select("siAccount", "siFiles", "PayableFee", "PaidAmount", stamp("LogDateTime"), "LogType", "FName", "LName")


@query(
    "flt_04_indexed_comments",
    """SELECT siFiles, Comment, Subject FROM files WHERE Comment LIKE '%URGENT P%' OR Subject LIKE '%URGENT P%'
       UNION ALL SELECT siFiles, Comment, Subject FROM files WHERE Comment LIKE '% F%' OR Subject LIKE '% F%'""",
)
def _(t):
    """A long text through the index, and one that is too short for it."""
    files = kept(t, t["files"].select("siFiles", "Comment", "Subject"), "siFiles", "files")
    index = TextIndex(t.spark, place(t, "files_index"), files, ["Comment", "Subject"])
    index.build()
    return index.search("URGENT P").unionByName(index.search(" F"))
