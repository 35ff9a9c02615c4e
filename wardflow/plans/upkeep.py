"""Multi-table upkeep: cancelled accounts and links to the laboratory (DM-2 .. DM-5, DM-9, JN-9)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.operators.joins import anti, join_by_link, semi
from wardflow.operators.maintenance import delete_by_key, snapshot, update_by_key, update_from
from wardflow.operators.workflow import apply_3d_transition
from wardflow.plans.lab import acceptance_person, acceptance_state

Tables = Mapping[str, DataFrame]
c = F.col

# Steps a cancelled visit goes back to, and the link made by hand.
SERVICES_SET, PAID_3D = 8, 16
MANUAL_LINK = 2


def cancel_accounts(t: Tables, accounts: DataFrame, log_type: str, as_of: Column) -> dict[str, DataFrame]:
    """Tables after the accounts named by ``siAccount`` were cancelled.

    Accounts and the services of their visits go to the logs, the accounts are
    removed, waiting entries return to the service step, and paid 3-D work is
    undone by one step.
    """
    gone = semi(t["accounts"], accounts, "siAccount")
    visits = gone.select("siFiles", "siAccount")
    logged = snapshot(t["accounts"], accounts, "siAccount", log_type, as_of)
    account_log = t["account_log"]
    service_log = t["service_log"]
    services = t["services"].join(visits, "siFiles")
    steps = t["waits"].join(visits.select("siFiles").distinct(), "siFiles", "left_semi")
    paid_3d = semi(t["waits_3d"].where(c("Status") == PAID_3D), visits, "siFiles")
    undo = paid_3d.select(
        "siFiles", c("siFiles").alias("seq"), F.lit(PAID_3D).alias("step"), F.lit(1).alias("undo"), as_of.alias("at")
    )
    return {
        "accounts": delete_by_key(t["accounts"], accounts, "siAccount"),
        "account_log": account_log.unionByName(logged.select(*account_log.columns)),
        "service_log": service_log.unionByName(services.select(*service_log.columns)),
        "waits": update_by_key(t["waits"], steps.select("siWait", F.lit(SERVICES_SET).alias("Status")), "siWait", ["Status"]),
        "waits_3d": apply_3d_transition(t["waits_3d"], undo)[0],
    }


def link_doctors(t: Tables, links: DataFrame, as_of: Column) -> DataFrame:
    """Laboratory patients after linking them (``FileID``) to our doctors (``siDoctor``) by hand."""
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), F.rtrim(F.concat_ws("", "FName", F.lit(" "), "LName")).alias("Name")
    )
    chosen = links.select("FileID", "siDoctor").join(doctors, "siDoctor", "left")
    again = (c("Status") == 3) & c("AnswerDate").isNotNull()
    mapping = {
        "DoctorName": c("new_Name"),
        "AutoStatus": F.lit(MANUAL_LINK),
        "siDoctor": c("new_siDoctor"),
        "AnswerDate": F.when(again, as_of).otherwise(c("AnswerDate")),
    }
    return update_from(t["lab_patients"], chosen, "FileID", mapping)


# What a patient loses when the doctor link is reset.
LINK_COLUMNS = ("AutoStatus", "siDoctor", "SendDate", "TryCount", "TelegMessageId", "TelegramStatus")


def reset_links(t: Tables, codes: DataFrame) -> DataFrame:
    """Laboratory patients after their doctor link (by ``fCode``) was reset to the laboratory's doctor."""
    doctors = t["lab_doctors"].select(c("fCode").alias("fCodeDoctor"), c("fFirstName").alias("Name"))
    accepted = semi(t["lab_acceptances"].select("fCode", "fCodeDoctor"), codes, "fCode")
    mapping = {"DoctorName": c("new_Name"), **{x: F.lit(None) for x in LINK_COLUMNS}}
    return update_from(t["lab_patients"], accepted.join(doctors, "fCodeDoctor").select("fCode", "Name"), "fCode", mapping)


def link_patients(t: Tables, links: DataFrame) -> DataFrame:
    """Laboratory patients after linking visits (``FileID``) to acceptances (``fCode``).

    Known patients take over the data of the acceptance, others are added.
    """
    patients = t["lab_patients"]
    medical = t["doctors"].select(c("siDoctors").alias("siDoctor"), c("MedicalID").alias("_medical"))
    visits = t["files"].select("FileID", "siDoctor", c("DoctorName").alias("_doctor")).join(medical, "siDoctor").drop("siDoctor")
    values = {
        "FileID": c("FileID"),
        "fCode": c("fCode"),
        "FName": c("fFirstName"),
        "LName": c("fLastName"),
        **acceptance_person(),
        "MedicalID": c("_medical"),
        "MiladiDate": c("fDateTime").cast("date"),
        "ReferDate": c("fAcceptionDate"),
        "DoctorName": c("_doctor"),
        "Status": acceptance_state(),
        "RegisterDate": c("fAcceptionDateTime"),
    }
    rows = join_by_link(visits, links.select("FileID", "fCode"), t["lab_acceptances"], "FileID", "fCode").select(
        *[v.cast(patients.schema[n].dataType).alias(n) for n, v in values.items()]
    )
    changed = update_by_key(patients, rows, "FileID", [n for n in values if n != "FileID"])
    added = anti(rows, patients, "FileID").withColumn(
        "TelegramStatus", F.lit(0).cast(patients.schema["TelegramStatus"].dataType)
    )
    return changed.unionByName(added, allowMissingColumns=True)
