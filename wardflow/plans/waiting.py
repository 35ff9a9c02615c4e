"""Waiting list, delivery boards and stations (CQ-6, CQ-7, CQ-10 .. CQ-12, CQ-14, CQ-16)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import dates
from wardflow.functions.nulls import (
    DELIVERY_TITLE,
    EMAIL_TITLE,
    SEND_STATUS,
    SHORT_DELIVERY_TITLE,
    WAIT_STATUS,
    decode,
    flag,
    full_name,
    null_if_blank,
    nvl,
)
from wardflow.operators.aggs import code_pivot, count_where
from wardflow.operators.filters import mask_filter
from wardflow.operators.joins import anti, semi
from wardflow.operators.setops import union_distinct
from wardflow.operators.sorting import failed_first, mode_sort, priority_sort

Tables = Mapping[str, DataFrame]
c = F.col

# Labels, the six services shown on the board and the final step.
DONE = 16
BOARD_SERVICES = {71: "BEF", 72: "A4", 73: "OC", 76: "AFT", 77: "NOP", 84: "EXT"}
EDITED_LABEL = "صادر شد"
PRINTED_LABEL = "چاپ شد"
SENT_LABEL = "ارسال"
SCAN_LABEL = {0: "Faild", -1: "NO"}
EMPTY_DATE = "1300/01/01"
CONTACTS = ("EMail1", "EMail2", "SMS1", "SMS2", "TelegramClinic")


def _two_part(first: Column, last: Column) -> Column:
    return F.concat(nvl(first, ""), F.lit(" "), nvl(last, ""))


def waiting_list(t: Tables) -> DataFrame:
    """Enriched waiting list: visit, doctor, hospital and branch of each entry (CQ-6).

    The Solar Hijri text of a moment is computed, only the way back needs the
    calendar table.
    """
    waits = t["waits"].withColumnRenamed("Comment", "WaitComment")
    files = t["files"].select(
        "siFiles", c("FileID").alias("PatientFileID"), c("LName").alias("_pl"), c("FName").alias("_pf"), "Phone1", "Phone2",
        "ReferDate", "Bef_Aft", "SendType", "IsScanned", "Subject", "HasFilterList", "Is3D", "siDoctor", "siHospital", "siBranch",
    )
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), "FileID", c("LName").alias("_dl"), c("FName").alias("_df"), "Description", *CONTACTS,
        "IsActiveEMail", "IsActiveSMS", "IsActiveTelegClinic", "IsAuto", "Filter",
    )
    hospitals = t["hospitals"].select("siHospital", "FullName")
    days = t["calendar"].select(c("Shamsi").alias("EMailDate"), "Miladi")
    rows = (
        waits.join(files, "siFiles")
        .join(doctors, "siDoctor")
        .join(hospitals, "siHospital")
        .join(t["branches"], "siBranch")
        .join(days, "EMailDate", "left")
    )
    mail_time = F.concat(F.replace(c("Miladi"), F.lit("/"), F.lit("-")), F.lit(" "), c("EMailTime"))
    automatic = dates.is_automatic(c("SendDate"), c("ManualTelegDate"))
    return rows.select(
        *[w for w in waits.columns if w not in ("WaitComment",)],
        "PatientFileID", c("siDoctor").alias("siDoctors"), "FileID", "siBranch", "BranchName", "FullName", "Phone1", "Phone2",
        "ReferDate", "Bef_Aft", "SendType", "Subject", "HasFilterList", "Is3D", "Description", "Filter",
        nvl(c("IsScanned"), -1).alias("IsScanned"),
        decode(c("SurgStatus"), {0: "Before"}, "AFTER").alias("SG_Status"),
        decode(c("Status"), WAIT_STATUS).alias("WaitStatus"),
        decode(c("SendType"), SEND_STATUS).alias("SendStatus"),
        nvl(c("_pl"), "").alias("PLName"),
        nvl(c("_pf"), "").alias("PFName"),
        _two_part(c("_pl"), c("_pf")).alias("PatientName"),
        _two_part(c("_df"), c("_dl")).alias("DoctorName2"),
        _two_part(c("_dl"), c("_df")).alias("DoctorName"),
        mail_time.try_cast("timestamp_ntz").alias("SentEMailTime"),
        dates.to_shamsi(c("ManualTelegDate")).alias("ManualTelegDateS"),
        *[null_if_blank(c(x)).alias(x) for x in CONTACTS],
        "IsActiveEMail", "IsActiveSMS", "IsActiveTelegClinic",
        nvl(c("IsAuto"), 0).alias("IsAuto"),
        F.when(automatic, "A").otherwise("M").alias("AutoOrManual"),
        flag(c("Edited").isNull()).alias("IsFirstPrint"),
    )


def _with_doctor_number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("FullDoctorName", F.concat(c("DoctorName"), F.lit(" "), c("FileID").cast("string")))


def _at(day: str | None, branch: int) -> Column:
    cond = F.lit(True)
    if branch:
        cond = cond & (c("siBranch") == branch)
    if day is not None:
        cond = cond & (c("WaitDate") == day)
    return cond


BOARD_COLUMNS = [
    "siWait", "siFiles", "WaitDate", "WaitTime", "WaitCall", "WaitPhoto", "WaitService", "WaitTimeOut", "SurgStatus", "Status",
    "SG_Status", "WaitStatus", "PatientName", "Subject", "siDoctors", "FileID", "DoctorName", "FullDoctorName", "FullName",
    "SendType", "SendStatus", "MachinePhoto", "siBranch", "BranchName",
]


def waiting_board(
    t: Tables, mask: int, day: str | None = None, branch: int = 0, caller: int = 1, services: dict = BOARD_SERVICES
) -> tuple[DataFrame, DataFrame]:
    """Waiting list by step mask, branch and day with a service pivot, and the total count (CQ-7).

    Callers other than 1 see only entries whose scan state is known.
    """
    everything = waiting_list(t).where(_at(day, branch))
    shown = everything.where(mask_filter(c("Status"), mask))
    if caller != 1:
        shown = shown.where(c("IsScanned") != -1)
    pivot = code_pivot(t["services"], "siWait", "siCommonTariff", "Number", services)
    photos = t["waits_3d"].select("siFiles", dates.hhmm(c("TakePhoto")).alias("TakePhoto"))
    rows = _with_doctor_number(shown).join(pivot, "siWait", "left").join(photos, "siFiles", "left")
    board = rows.select(
        *BOARD_COLUMNS, "WaitCheck", "MachineCheck", "IsScanned", "FactorStatus", *services.values(),
        decode(c("IsScanned"), SCAN_LABEL).alias("ScannedStatus"),
        "Is3D", "TakePhoto", _title_3d().alias("Is3DTitle"),
    )
    ordered = board.orderBy("Status", "WaitDate", F.desc("WaitTimeOut"), "WaitTime", "siWait")
    return ordered, count_where(everything, F.lit(True))


def _title_3d() -> Column:
    return F.when(c("Is3D") == 0, F.lit(None)).otherwise("3D")


def _editor_columns(rows: DataFrame) -> DataFrame:
    """Edit, print and e-mail state with their labels."""
    edited, printed = nvl(c("Edited"), 0), nvl(c("Printed"), 0)
    titles = {
        "Edited": edited,
        "Printed": printed,
        "EditedTitle": F.when(edited != 0, EDITED_LABEL),
        "PrintedTitle": F.when(printed != 0, PRINTED_LABEL),
        "Finished": flag((edited == 1) & (printed == 1)),
        "SentEMailTitle": decode(nvl(c("SentEMail"), 0), EMAIL_TITLE),
        "SentSMSTitle": F.when(nvl(c("SentSMS"), 0) != 0, SENT_LABEL),
    }
    return _with_doctor_number(rows).withColumns(titles)


EDITOR_COLUMNS = [
    *BOARD_COLUMNS, "Edited", "Printed", "EditedTitle", "PrintedTitle", "Finished", "SentEMail", "SentEMailTitle", "EMailDate",
    "EMailTime", "AttachedCount", "SentSMS", "SentSMSTitle", "IsActiveEMail", "EMail1", "EMail2",
]


def _ready() -> Column:
    return (nvl(c("Printed"), 0) == 1) & (nvl(c("Edited"), 0) == 1)


def _mail_ready() -> Column:
    return (nvl(c("IsActiveEMail"), 0) == 1) & _ready()


def editor_list(
    t: Tables, lo: str | None, hi: str | None, email: bool, done: bool
) -> tuple[DataFrame, DataFrame]:
    """Editors' list with mode-dependent filter and sort, and the count of unfinished visits (CQ-10)."""
    albums = t["albums"].select("siFiles", "siAlbum", "SurgDate")
    rows = waiting_list(t).where((c("Status") == DONE) & dates.date_text_between(c("WaitDate"), lo, hi))
    with_album = rows.join(albums, "siFiles")
    unfinished = with_album.where(c("SurgDate").isNull() & ~_both_set())
    if email:
        unfinished = unfinished.where(nvl(c("IsActiveEMail"), 0) == 1)
    shown = with_album
    if email:
        shown = shown.where(_mail_ready())
        if not done:
            shown = shown.where(nvl(c("SentEMail"), 0) != 3)
    elif not done:
        shown = shown.where((nvl(c("Printed"), 0) == 0) | (nvl(c("Edited"), 0) == 0))
    ended_3d = t["waits_3d"].where(c("Status") >= 20).select("siFiles", "siWait3D")
    shown = shown.join(ended_3d, "siFiles", "left").where(
        (c("Is3D") == 0) | ((c("Is3D") == 1) & c("siWait3D").isNotNull())
    )
    out = _editor_columns(shown).select(
        *EDITOR_COLUMNS, "siAlbum", "Description", "Is3D", _title_3d().alias("Is3DTitle"), "IsFirstPrint"
    )
    sent = nvl(c("SentEMail"), 0)
    tail = ["-WaitDate", "SendType", "WaitTimeOut", "siWait", "siAlbum"]
    failed = F.when(sent == 0, 1).when(sent != 2, 2)
    keys = {True: [failed.asc_nulls_first(), sent.asc(), *tail], False: ["Finished", *tail]}
    return mode_sort(out, email, keys), unfinished.agg(F.count(F.lit(1)).alias("NonEditedCount"))


def _both_set() -> Column:
    """Neither edit nor print state is 0 or missing."""
    return (nvl(c("Edited"), 0) != 0) & (nvl(c("Printed"), 0) != 0)


def shifted_day(shamsi: str, days: int) -> Column:
    """Solar Hijri text of the day ``days`` before a given one, a constant of the plan."""
    return dates.to_shamsi(F.date_sub(dates.from_shamsi(F.lit(shamsi)), days))


def delivery_overview(
    t: Tables, lo: str | None, hi: str, done: bool, message_days: int, ranking: str = "stage"
) -> DataFrame:
    """Visits that wait for e-mail or message delivery, ranked by urgency (CQ-11).

    ``ranking`` is ``stage`` (failed, listed, queued, sent) or ``order``, the
    older scheme that compares the two delivery states; it also shows visits
    with a procedure the doctor excluded.
    """
    rows = _editor_columns(waiting_list(t)).join(t["albums"].select("siFiles", "siAlbum"), "siFiles")
    has_message = nvl((c("IsActiveTelegClinic") == 1) & c("TelegramClinic").isNotNull(), False)
    ready = (c("Printed") == 1) & (c("Edited") == 1)
    mail = dates.date_text_between(c("WaitDate"), lo, hi) & (c("Status") == DONE) & (nvl(c("IsActiveEMail"), 0) == 1) & ready
    message = c("WaitDate").between(shifted_day(hi, message_days), F.lit(hi)) & ready & has_message
    if ranking == "stage":
        message = message & ((nvl(c("HasFilterList"), 0) == 0) | (c("AutoOrManual") == "M"))
    if not done:
        mail = mail & (nvl(c("SentEMail"), 0) != 3)
        auto_open = (c("AutoOrManual") == "A") & (nvl(c("TelegramStatus"), 0) != 2)
        manual_open = (c("AutoOrManual") == "M") & (nvl(c("ManualTelegStatus"), 0) != 2)
        message = message & (auto_open | manual_open)
    picked = rows.where(mail | message).withColumns(
        {
            "IsActiveEMail": nvl(c("IsActiveEMail"), 0),
            "HasTelegram": flag(has_message),
            "HasFilterList": nvl(c("HasFilterList"), 0),
            "TelegramStatus": _picked("TelegramStatus", "ManualTelegStatus"),
            "TelegStatusTitle": decode(
                nvl(_picked("TelegramStatus", "ManualTelegStatus"), 0), SHORT_DELIVERY_TITLE
            ),
            "SendDateS": F.coalesce(
                F.when(c("AutoOrManual") == "A", dates.to_shamsi(c("SendDate"))),
                F.when(c("AutoOrManual") == "M", c("ManualTelegDateS")),
            ),
            "SendDateTime": F.when(c("AutoOrManual") == "A", dates.hhmm(c("SendDate"))).otherwise(
                dates.hhmm(c("ManualTelegDate"))
            ),
        }
    )
    by_mail, by_message = c("IsActiveEMail") == 1, c("HasTelegram") == 1
    no_mail = c("IsActiveEMail") == 0
    channel = F.when(by_mail & ~by_message, "E").when(no_mail & by_message, "T").when(by_mail & by_message, "ET")
    rank = {"stage": _stage_rank, "order": _order_rank}[ranking]()
    out = picked.select(
        channel.alias("EMailTeleg"), rank.alias("SendQueue"), *EDITOR_COLUMNS, "siAlbum", "AttachedCountTeleg", "IsAuto",
        "HasTelegram", "TelegramStatus", "TelegStatusTitle", "SendDateS", "SendDateTime", "Is3D",
    )
    return out.orderBy("SendQueue", F.desc("WaitDate"), "SendType", "WaitTimeOut", "siWait", "siAlbum")


def _picked(auto: str, manual: str) -> Column:
    return F.when(c("AutoOrManual") == "A", c(auto)).otherwise(c(manual))


def _stage_rank() -> Column:
    """1 failed, 3 queued, 2 listed, 4 sent, over both channels in this order."""
    mail = F.when(c("IsActiveEMail") != 0, nvl(c("SentEMail"), 0))
    message = F.when(c("HasTelegram") != 0, nvl(c("TelegramStatus"), 0))

    def either(mail_state, message_states, extra: Column | None = None) -> Column:
        hit = message.isin(message_states)
        if extra is not None:
            hit = hit & extra
        return nvl(mail == mail_state, False) | nvl(hit, False)

    return (
        F.when(either(2, [3, 4, 5]), 1)
        .when(either(1, [1]), 3)
        .when(either(0, [0], c("HasFilterList") != 1), 2)
        .when(either(3, [2]), 4)
    )


# Fixed value: order number of a channel that is off.
CHANNEL_OFF = 99


def _order_rank() -> Column:
    """Rank of the older scheme; a failed message comes first, then listed, queued."""
    mail = F.when(c("IsActiveEMail") == 1, nvl(c("SentEMail"), 0)).otherwise(CHANNEL_OFF)
    message = F.when(c("HasTelegram") == 1, nvl(c("TelegramStatus"), 0)).otherwise(CHANNEL_OFF)
    status = nvl(c("TelegramStatus"), 0)
    mail_over = mail.isin(3, CHANNEL_OFF)
    after_mail = (
        F.when((message == 1) | (status == 1), -3)
        .when((message == 2) | (status == 2), message)
        .when(message == 0, -4)
        .when(message == CHANNEL_OFF, 2)
        .otherwise(message)
    )
    return (
        F.when((mail == 2) | ((message > 2) & (message < CHANNEL_OFF)), -5)
        .when(mail_over, after_mail)
        .when(mail == 0, -4)
        .otherwise(mail)
    )


def deliverable_channels(t: Tables, visits: DataFrame) -> DataFrame:
    """For each visit the waiting entry to send by e-mail and by message, 0 if none (CQ-12).

    Of several finished entries the one with the highest number counts.
    """
    rows = semi(waiting_list(t), visits, "siFiles").where((c("Status") == DONE) & _ready())
    last = semi(rows, t["albums"], "siFiles").groupBy("siFiles").agg(
        F.max("siWait").alias("_w"),
        F.max_by(nvl(c("IsActiveEMail"), 0), "siWait").alias("_mail"),
        F.max_by(nvl(c("IsActiveTelegClinic"), 0), "siWait").alias("_message"),
    )
    zero = F.lit(0).cast("bigint")

    def entry(flag_col: str) -> Column:
        return F.when(c(flag_col) == 1, c("_w")).otherwise(zero)

    return visits.select("siFiles").distinct().join(last, "siFiles", "left").select(
        "siFiles", entry("_mail").alias("siWaitForEmail"), entry("_message").alias("siWaitForTeleg")
    )


def deliverable_visits(t: Tables, visits: DataFrame) -> DataFrame:
    """Finished entries of the visits with their delivery state (CQ-12)."""
    rows = semi(waiting_list(t), visits, "siFiles").where((c("Status") == DONE) & _ready())
    rows = _editor_columns(rows.join(t["albums"].select("siFiles", "siAlbum"), "siFiles"))
    return rows.select(
        *[x for x in EDITOR_COLUMNS], "siAlbum", _picked("TelegramStatus", "ManualTelegStatus").alias("TelegramStatus")
    )


def clinic_delivery_board(t: Tables, day: str, done: bool, window_days: int) -> DataFrame:
    """Delivery state of the visits of a rolling window (CQ-14).

    An automatic send date counts here only when it carries no clock time.
    """
    rows = waiting_list(t).where(
        c("WaitDate").between(shifted_day(day, window_days), F.lit(day))
        & ((c("SentEMail") == 3) | c("ManualTelegDate").isNotNull())
        & (c("IsActiveTelegClinic") == 1)
        & c("TelegramClinic").isNotNull()
    )
    if not done:
        rows = rows.where(nvl(c("TelegramStatus"), 0) != 2)
    midnight = c("SendDate") == c("SendDate").cast("date")
    rows = rows.withColumn("_auto_day", F.when(midnight, dates.to_shamsi(c("SendDate"))))
    automatic = nvl(c("_auto_day"), EMPTY_DATE) >= nvl(c("ManualTelegDateS"), EMPTY_DATE)

    def pick(auto: Column, manual: Column) -> Column:
        return F.when(automatic, auto).otherwise(manual)

    status = pick(c("TelegramStatus"), c("ManualTelegStatus"))
    out = rows.select(
        "siWait", "siFiles", "PatientName", "DoctorName", c("FullName").alias("RefPlace"), "AttachedCount", "SG_Status", "SendType",
        "SendStatus", "Subject", "BranchName", "WaitDate", "WaitTime",
        status.alias("TelegramStatus"),
        decode(nvl(status, 0), DELIVERY_TITLE).alias("TelegStatusTitle"),
        pick(c("_auto_day"), c("ManualTelegDateS")).alias("SendDateS"),
        pick(dates.hhmm(c("SendDate")), dates.hhmm(c("ManualTelegDate"))).alias("SendDateTime"),
    )
    return priority_sort(out, failed_first(c("TelegramStatus")), ["-WaitDate", "SendType", "WaitTime", "siWait"])


def lab_patients_in_window(t: Tables, day: str, done: bool, window_days: int) -> DataFrame:
    """Laboratory patients registered in a rolling window whose doctor gets messages."""
    doctors = t["doctors"].where((c("IsActiveTelegLab") == 1) & c("TelegramLab").isNotNull()).select(
        c("siDoctors").alias("siDoctor"), c("LName").alias("_dl"), c("FName").alias("_df"), "TelegramLab", "IsActiveEmailLab"
    )
    registered = dates.to_shamsi(c("RegisterDate"))
    last = dates.from_shamsi(F.lit(day))
    rows = t["lab_patients"].where(
        dates.on_days(c("RegisterDate"), F.date_sub(last, window_days), last) & c("fCode").isNotNull() & c("Status").isin(1, 3)
    )
    if not done:
        rows = rows.where(nvl(c("TelegramStatus"), 0) != 2)
    return rows.withColumns({"ReferDate": registered, "ReferTime": dates.hhmm(c("RegisterDate"))}).join(doctors, "siDoctor")


def lab_delivery_board(t: Tables, day: str, done: bool, window_days: int, pdf_root: str = "", pdf_network: str = "") -> DataFrame:
    """Delivery state of laboratory answers of a rolling window (CQ-14)."""
    accepted = t["lab_acceptances"].select("fCode")
    rows = lab_patients_in_window(t, day, done, window_days).join(accepted, "fCode")
    answered = F.when(
        c("Status") == 3,
        F.concat_ws("", dates.hhmm(c("AnswerDate")), F.lit(" - "), dates.to_shamsi(c("AnswerDate"))),
    )
    mailed = dates.to_shamsi(c("SentEMailLabTime"))
    code = c("fCode").cast("string")
    out = rows.select(
        "FileID", "fCode", "FName", "LName",
        F.concat_ws("", "FName", F.lit(" "), "LName").alias("FullName"),
        F.concat_ws("", "LName", F.lit(" "), "FName").alias("FullName2"),
        "Mobile", "MiladiDate",
        dates.to_shamsi(c("SendDate")).alias("SendDateS"),
        dates.hhmm(c("SendDate")).alias("SendTime"),
        "ReferDate", "ReferTime", "DoctorName",
        F.rtrim(F.concat_ws("", "_dl", F.lit(" "), "_df")).alias("DoctorName2"),
        "Status", "TelegramStatus", "SendType",
        decode(c("SendType"), SEND_STATUS).alias("SendStatus"),
        decode(nvl(c("TelegramStatus"), 0), DELIVERY_TITLE).alias("TelegStatusTitle"),
        "TelegMessageId", "TelegramLab",
        nvl(c("TryCount"), 0).alias("TryCount"),
        F.concat(F.lit(pdf_root), code, F.lit(".pdf")).alias("PdfPath"),
        F.concat(F.lit(pdf_network), code, F.lit(".pdf")).alias("PdfNetwork"),
        code.alias("fCodeMonth"),
        answered.alias("AnswerDate"),
        F.when(mailed.isNotNull(), F.concat(dates.hhmm(c("SentEMailLabTime")), F.lit(" - "), mailed)).otherwise("").alias("SentLabDate"),
        F.when(nvl(c("IsActiveEmailLab"), 0) == 0, "").otherwise("E").alias("IsActiveEmailLab"),
    )
    keys = ["-Status", "-ReferDate", "SendType", "ReferTime", "FileID"]
    return priority_sort(out, failed_first(c("TelegramStatus")), keys)


# Error numbers of a work station check.
OWN, HELD_BY_OTHER, OTHER_LEFT_OPEN = 1, 2, 3


def station_conflicts(waits: DataFrame, stations: DataFrame, machine: str, step: int) -> DataFrame:
    """Conflicts of work stations that want to open an entry (CQ-16).

    ``stations`` has one row per station: its name in ``machine`` and the wanted
    ``siWait``.  1: the entry is open here already, 2: another station holds it,
    3: this station left another entry open.
    """
    held = waits.where((c("Status") == step) & c(machine).isNotNull())
    asked = stations.select(c(machine).alias("_station"), c("siWait").alias("_wanted"))
    here = held.join(asked, c(machine) == c("_station"))
    there = held.join(asked, c("siWait") == c("_wanted")).where(c(machine) != c("_station"))

    def found(rows: DataFrame, error: int) -> DataFrame:
        return rows.select(F.lit(error).alias("ErrorNO"), c("_station").alias("Station"), *waits.columns)

    return union_distinct(
        found(here.where(c("siWait") == c("_wanted")), OWN),
        found(here.where(c("siWait") != c("_wanted")), OTHER_LEFT_OPEN),
        found(there, HELD_BY_OTHER),
    )


def photo_conflicts(t: Tables, waits: DataFrame, stations: DataFrame) -> DataFrame:
    """Conflicts at the photo stations; visits with a 3-D photo no longer count (CQ-16)."""
    shot = t["waits_3d"].where(c("TakePhoto").isNotNull()).select("siFiles")
    return station_conflicts(anti(waits, shot, "siFiles").select(*waits.columns), stations, "MachinePhoto", 2)
