"""Laboratory acceptances and two-way synchronisation (CQ-13, CQ-23)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import dates
from wardflow.functions.nulls import SEND_STATUS, SEX_TITLE, decode, nvl
from wardflow.functions.text import classify_phone
from wardflow.operators.joins import insert_filter, match_entities
from wardflow.operators.maintenance import split_delete

Tables = Mapping[str, DataFrame]
c = F.col

# States of a laboratory patient and of the doctor link.
CANCELED, ANSWERED, OPEN, RE_ACCEPTED = 2, 3, 1, -1
LINK_TITLE = {1: "Auto Link", 2: "Manual Link"}
RE_ACCEPTED_TITLE, RE_ACCEPTED_CODE = "پذيرش مجدد", 4
NORMAL, URGENT = "عادي", "اورژانس"
WOMAN, MAN = "زن", "مرد"


def lab_acceptances(t: Tables, day: str | None, only_unlinked: bool) -> DataFrame:
    """Acceptances of a day (or of all days) with the state of their doctor link (CQ-13)."""
    accepted = t["lab_acceptances"].where(c("fCancellation") != 1)
    if day is not None:
        accepted = accepted.where(c("fAcceptionDate") == day)
    doctors = t["lab_doctors"].select(
        c("fCode").alias("fCodeDoctor"), c("fLastName").alias("_dl"), c("fFirstName").alias("_df"), "fMedicalNo", "fCodeSpecialty"
    )
    jobs = t["lab_specialties"].select(c("fCode").alias("fCodeSpecialty"), c("fName").alias("Job"))
    patients = t["lab_patients"].where(c("RegisterDate").isNotNull()).select(
        "fCode", "FileID", "siDoctor", "AutoStatus", "DoctorName"
    )
    own = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), "MedicalID", "IsOwnDoc", c("FName").alias("_of"), c("LName").alias("_ol")
    )
    rows = (
        accepted.join(doctors, "fCodeDoctor", "left")
        .join(jobs, "fCodeSpecialty", "left")
        .join(patients, "fCode", "left")
        .join(own, "siDoctor", "left")
    )
    auto = c("AutoStatus")
    is_own = F.when(auto.isin(1, 2), c("IsOwnDoc"))
    if only_unlinked:
        rows = rows.where(c("siDoctor").isNull()).where(auto.isNull() | (auto.isin(1, 2) & (is_own == 0)))
    again = c("ReAccept") == 1
    title = F.coalesce(decode(auto, LINK_TITLE), F.when(again, RE_ACCEPTED_TITLE))
    code = F.when(auto.isin(1, 2), auto.cast("int")).when(again, RE_ACCEPTED_CODE).otherwise(0)
    return rows.select(
        "fCode", "FileID",
        F.concat_ws("", "fLastName", F.lit(" "), "fFirstName").alias("PatientName"),
        F.concat_ws("", "_dl", F.lit(" "), "_df").alias("DoctorName"),
        F.when(auto == 2, c("DoctorName")).alias("LinkedDoctor"),
        "siDoctor",
        decode(c("fEmergency"), {0: NORMAL}, URGENT).alias("SendStatus"),
        decode(c("fSex"), {0: WOMAN}, MAN).alias("SexTitle"),
        c("fMobile").alias("Mobile"),
        "fMedicalNo",
        c("fAcceptionDate").alias("AcceptionDate"),
        "fAcceptionDateTime",
        dates.hhmm(c("fAcceptionDateTime")).alias("AcceptionTime"),
        "Job", "AutoStatus",
        title.alias("LinkStatus"),
        code.alias("LinkStatusCode"),
        "MedicalID",
        F.concat_ws("", "_of", F.lit(" "), "_ol").alias("DoctorFullName"),
        is_own.alias("IsOwnDoc"),
    ).orderBy(F.desc("fAcceptionDateTime"), "fCode")


def acceptance_state() -> Column:
    """Patient state that follows from an acceptance."""
    return (
        F.when(c("fCancellation") == 1, CANCELED)
        .when((c("fCancellation") == 0) & (c("fPutAnswer") == 1), ANSWERED)
        .otherwise(OPEN)
    )


def acceptance_person() -> dict[str, Column]:
    """What an acceptance says of its patient."""
    return {
        "Mobile": c("fMobile"),
        "SendType": F.when(c("fEmergency") == 1, 0).when(c("fEmergency") == 0, 1),
        "SendStatus": decode(c("fEmergency"), {1: URGENT, 0: NORMAL}),
        "BirthYear": F.left(c("fBirthDate"), F.lit(4)),
        "Sex": c("fSex"),
        "SexTitle": decode(c("fSex"), SEX_TITLE),
    }


def doctor_matches(t: Tables) -> DataFrame:
    """Laboratory doctors that are the same person as one of our doctors."""
    dash = F.lit("-")
    own = t["doctors"].where(c("MedicalID").isNotNull()).select("siDoctors", "LName", "FName", "MedicalID")
    lab = t["lab_doctors"].select(c("fCode").alias("fCodeDoctor"), "fLastName", "fFirstName", "fMedicalNo")
    return match_entities(
        own, lab,
        [c("LName"), dash, c("FName"), c("MedicalID")],
        [c("fLastName"), dash, c("fFirstName"), c("fMedicalNo")],
    ).select("fCodeDoctor", "siDoctors")


def sync_lab_in(t: Tables, as_of: Column, answer_days: int) -> DataFrame:
    """Laboratory patients after taking over the acceptances (CQ-23).

    Re-accepted patients are closed, today's new acceptances are added, and state
    and answer time of recent patients are refreshed.
    """
    patients = t["lab_patients"]
    accepted = t["lab_acceptances"]
    # Old rows: close re-accepted ones first, as the refresh skips closed rows.
    states = accepted.select(
        "fCode", c("ReAccept").alias("_again"), acceptance_state().alias("_state"), c("fPutAnswer").alias("_answer")
    )
    fresh = _new_patients(t, as_of)
    both = patients.unionByName(fresh, allowMissingColumns=True)
    rows = both.join(states, "fCode", "left")
    was_old = c("_again") == 1
    status = F.when(was_old, RE_ACCEPTED).otherwise(c("Status"))
    recent = (status > 0) & c("_state").isNotNull() & (dates.datediff_boundary("day", c("RegisterDate"), as_of) <= answer_days)
    now_answered = F.when(c("Status") == ANSWERED, c("AnswerDate").isNull()).otherwise(c("_answer") == 1)
    new_values = {
        "Status": F.when(nvl(recent, False), c("_state")).otherwise(status),
        "AnswerDate": F.when(nvl(recent & now_answered, False), as_of).otherwise(c("AnswerDate")),
    }
    return rows.select(
        *[(new_values[x].cast(patients.schema[x].dataType).alias(x) if x in new_values else c(x)) for x in patients.columns]
    )


def _new_patients(t: Tables, as_of: Column) -> DataFrame:
    patients = t["lab_patients"]
    today = t["lab_acceptances"].where(
        (c("ReAccept") != 1)
        & (c("fAcceptionDateTime").cast("date") == as_of.cast("date"))
        & (c("fCancellation") == 0)
    )
    doctors = t["lab_doctors"].select(
        c("fCode").alias("fCodeDoctor"),
        F.concat_ws("", "fFirstName", F.lit(" "), "fLastName").alias("DoctorName"),
        F.trim(c("fMedicalNo").cast("string")).alias("_medical"),
    )
    rows = (
        insert_filter(today, patients, "fCode")
        .join(doctors, "fCodeDoctor")
        .join(doctor_matches(t), "fCodeDoctor", "left")
    )
    values = {
        "FileID": c("fCode"),
        "fCode": c("fCode"),
        "FName": c("fFirstName"),
        "LName": c("fLastName"),
        "Phone1": F.lit(None),
        **acceptance_person(),
        "MedicalID": c("_medical"),
        "MiladiDate": c("fDateTime").cast("date"),
        "ReferDate": c("fAcceptionDate"),
        "DoctorName": c("DoctorName"),
        "siDoctor": c("siDoctors"),
        "AutoStatus": F.when(c("siDoctors").isNotNull(), 1),
        "Status": acceptance_state(),
        "RegisterDate": c("fAcceptionDateTime"),
        "TelegramStatus": F.lit(0),
    }
    return rows.select(*[v.cast(patients.schema[n].dataType).alias(n) for n, v in values.items()])


def sync_lab_out(t: Tables, as_of: Column, delay_days: int) -> DataFrame:
    """Laboratory patients after pushing recent visits and expiring old ones (CQ-23)."""
    patients = t["lab_patients"]
    days = t["calendar"].select(c("Shamsi").alias("ReferDate"), "MiladiDate")
    recent = days.where(dates.add_time(as_of, -delay_days).cast("date") <= c("MiladiDate"))
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"),
        F.concat(nvl(c("FName"), ""), F.lit(" "), nvl(c("LName"), "")).alias("_doctor"),
        "MedicalID",
    )
    visits = (
        t["files"].select("siDoctor", "FileID", "FName", "LName", "Phone1", "SendType", "ReferDate", "BirthYear", "Sex")
        .join(recent, "ReferDate")
        .join(doctors, "siDoctor")
    )
    phone, mobile = classify_phone(c("Phone1"))
    values = {
        "FileID": c("FileID"),
        "FName": c("FName"),
        "LName": c("LName"),
        "Phone1": phone,
        "Mobile": mobile,
        "SendType": c("SendType"),
        "SendStatus": decode(c("SendType"), SEND_STATUS),
        "BirthYear": c("BirthYear"),
        "MedicalID": c("MedicalID"),
        "Sex": c("Sex"),
        "SexTitle": decode(c("Sex"), SEX_TITLE),
        "MiladiDate": c("MiladiDate"),
        "ReferDate": c("ReferDate"),
        "DoctorName": c("_doctor"),
        "Status": F.lit(0),
        "TelegramStatus": F.lit(0),
    }
    pushed = visits.select(*[v.cast(patients.schema[n].dataType).alias(n) for n, v in values.items()])
    all_rows = patients.unionByName(pushed, allowMissingColumns=True)
    expired = c("RegisterDate").isNull() & (
        dates.datediff_boundary("day", c("MiladiDate"), as_of) >= delay_days
    )
    return split_delete(all_rows, expired)[0]
