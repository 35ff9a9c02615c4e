"""Next-to-send queues (CQ-15).

Each queue is a batch query over the current tables: who may be sent to, in
which order, with which text.  ``n`` limits the answer to the head of the queue;
``None`` gives the whole queue.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import dates
from wardflow.functions.nulls import flag, nvl
from wardflow.operators.joins import anti
from wardflow.operators.projections import derive_paths, render_message
from wardflow.operators.sorting import failed_first, top_n
from wardflow.plans.search import excluded_procedures
from wardflow.plans.waiting import lab_patients_in_window, waiting_list

Tables = Mapping[str, DataFrame]
c = F.col

# Limits of the queues, states and message lines.
BACK_OFF_MINUTES = 5
MAX_TRIES = 10
DONE, ANSWERED = 16, 3
CR, CRLF = "\r", "\r\n"
BEFORE, AFTER = "قبل از درمان", "بعد از درمان"


@dataclass(frozen=True)
class QueueSettings:
    """Delays and expiry limits, and the sender's last line."""

    email_lab_days: int = 30
    email_days: int = 30
    visit_delay_minutes: int = 5
    sms_delay_minutes: int = 30
    sms_expire_days: int = 3
    message_days: int = 10
    lab_delay_minutes: int = 10
    pdf_root: str = ""
    pdf_network: str = ""
    signature: str = ""


def _lab_text(settings: QueueSettings) -> Column:
    return render_message(
        [
            F.lit(" پزشک گرامي "),
            F.concat(F.lit(" دکتر "), c("DoctorName")),
            F.lit(""),
            F.concat(F.lit(" جواب آزمايش "), F.concat_ws("", "FName", F.lit(" "), "LName")),
            F.concat(F.lit(" به تاريخ   "), c("ReferDate")),
            F.concat(F.lit(" و تلفن   "), c("Mobile")),
            F.lit(""),
            F.lit(" با احترام "),
            F.lit(settings.signature),
        ],
        CRLF,
    )


LAB_COLUMNS = ["FileID", "fCode", "FName", "LName", "Mobile", "MiladiDate", "ReferDate", "DoctorName", "Status", "TelegramStatus", "TelegMessageId"]


def _lab_rows(t: Tables, doctors: DataFrame) -> DataFrame:
    answered = t["lab_patients"].where(c("fCode").isNotNull() & (c("Status") == ANSWERED))
    return answered.join(doctors, "siDoctor")


def _pdf(settings: QueueSettings) -> list[Column]:
    """The answer's file as seen locally and over the network."""
    roots = {"PdfPath": settings.pdf_root, "PdfNetwork": settings.pdf_network}
    return [F.concat(F.lit(root), c("fCode").cast("string"), F.lit(".pdf")).alias(name) for name, root in roots.items()]


def lab_email_queue(t: Tables, as_of: Column, n: int | None, settings: QueueSettings) -> DataFrame:
    """Laboratory answers to mail: new or failed, five minutes after the last try."""
    doctors = t["doctors"].where(
        (c("IsActiveEmailLab") == 1) & (c("EMailLab1").isNotNull() | c("EMailLab2").isNotNull())
    ).select(c("siDoctors").alias("siDoctor"), "EMailLab1", "EMailLab2", "TelegramLab")
    rows = _lab_rows(t, doctors).where(
        nvl(c("SentEMailLab"), 0).isin(0, 2)
        & dates.age_at_least(c("SentEMailLabTime"), as_of, BACK_OFF_MINUTES)
        & dates.age_at_most(c("MiladiDate"), as_of, settings.email_lab_days)
    )
    out = rows.withColumn("TryCount", nvl(c("TryCount"), 0))
    head = top_n(out, ["TryCount", "SentEMailLabTime", "FileID"], n)
    return head.select(
        *LAB_COLUMNS, "TelegramLab", "TryCount", "EMailLab1", "EMailLab2",
        *_pdf(settings), _lab_text(settings).alias("TitleContent"),
        F.concat_ws("", "FName", F.lit(" "), "LName").alias("PatientFullName"),
    )


def lab_message_queue(t: Tables, as_of: Column, n: int | None, settings: QueueSettings) -> DataFrame:
    """Laboratory answers to send as messages: queued or failed, below ten tries."""
    doctors = t["doctors"].where((c("IsActiveTelegLab") == 1) & c("TelegramLab").isNotNull()).select(
        c("siDoctors").alias("siDoctor"), "TelegramLab"
    )
    rows = _lab_rows(t, doctors).withColumn("TryCount", nvl(c("TryCount"), 0))
    rows = rows.where(
        (c("TryCount") < MAX_TRIES)
        & c("TelegramStatus").isin(1, 3, 5)
        & dates.age_at_least(c("SendDate"), as_of, BACK_OFF_MINUTES)
    )
    head = top_n(rows, ["TryCount", "SendDate", "FileID"], n)
    return head.select(
        *LAB_COLUMNS, "TelegramLab", "TryCount", *_pdf(settings), _lab_text(settings).alias("TitleContent")
    )


def _visit_rows(t: Tables) -> DataFrame:
    files = t["files"].select(
        "siFiles", "siDoctor", "Subject", "Bef_Aft", "Phone1", F.nullif("Phone2", F.lit("")).alias("Phone2"),
        F.concat(nvl(c("FName"), ""), F.lit(" "), nvl(c("LName"), "")).alias("PatientFullName"),
    )
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), "EMail1", "EMail2", "SMS1", "SMS2", "IsActiveEMail", "IsActiveSMS",
        c("LName").alias("DoctorLName"),
        F.concat(nvl(c("FName"), ""), F.lit(" "), nvl(c("LName"), "")).alias("DoctorFullName"),
    )
    waits = t["waits"].where(c("Status") == DONE)
    return waits.join(files, "siFiles").join(doctors, "siDoctor")


def _phase() -> Column:
    return F.when(c("Bef_Aft") == 1, AFTER).otherwise(BEFORE)


def email_queue(t: Tables, n: int | None, settings: QueueSettings) -> DataFrame:
    """Visit e-mails in the queue; the entry number decides the order."""
    rows = _visit_rows(t).where((c("SentEMail") == 1) & (c("IsActiveEMail") == 1))
    text = render_message(
        [
            F.concat(F.lit(" پزشک گرامي دکتر  "), c("DoctorFullName")),
            F.concat(F.lit(" مراجعه کننده "), c("PatientFullName"), F.lit(" به همراه:  "), c("Phone1")),
            (nvl(c("Phone2"), "") != "", F.concat(F.lit(" به تلفن:  "), c("Phone2"))),
            F.concat(F.lit(" در تاريخ "), c("WaitDate"), F.lit(" - "), c("WaitTimeOut")),
            F.concat(F.lit(" موضوع: "), c("Subject"), F.lit("   "), _phase()),
            F.lit(settings.signature),
        ],
        CR,
    )
    return top_n(rows, ["siWait"], n).select(
        "siWait", "WaitDate", "WaitTimeOut", "PatientFullName", "EMail1", "EMail2", c("DoctorLName").alias("LName"),
        "DoctorFullName", "siFiles", "AttachedCount", text.alias("EMailContent"),
    )


def sms_queue(t: Tables, as_of: str, n: int | None, settings: QueueSettings) -> DataFrame:
    """Visit SMS: after a delay on the same day, or on a later day until they expire."""
    now = dates.timestamp_lit(as_of)
    days = t["calendar"].select(c("Shamsi").alias("WaitDate"), c("MiladiDate").alias("_day"))
    rows = _visit_rows(t).where((c("IsActiveSMS") == 1) & (c("SentSMS").isNull() | (c("SentSMS") == 3)))
    rows = rows.join(days, "WaitDate")
    waited = dates.clock_minutes(c("WaitTimeOut"), dates.hhmm(now)) > settings.sms_delay_minutes
    rows = rows.where(
        (waited | (c("_day") != now.cast("date"))) & (F.datediff(now, c("_day")) <= settings.sms_expire_days)
    )
    text = render_message(
        [
            F.lit(" پزشک گرامي "),
            F.concat(F.lit(" دکتر "), c("DoctorFullName")),
            F.concat(F.lit(" مراجعه کننده "), c("PatientFullName")),
            F.concat(F.lit(" به همراه:  "), c("Phone1")),
            (nvl(c("Phone2"), "") != "", F.concat(F.lit(" به تلفن:  "), c("Phone2"))),
            F.concat(F.lit(" در تاريخ "), c("WaitDate"), F.lit(" - "), c("WaitTimeOut")),
            F.concat(F.lit(" موضوع: "), c("Subject")),
            F.lit(settings.signature),
        ],
        CR,
    )
    return top_n(rows, ["siWait"], n).select(
        "siWait", "WaitDate", "WaitTimeOut", "SentSMSTime", "PatientFullName", "SMS1", "SMS2",
        c("DoctorLName").alias("LName"), "DoctorFullName", text.alias("SMSContent"),
    )


def visit_message_queue(t: Tables, as_of: Column, n: int | None, settings: QueueSettings) -> DataFrame:
    """Visit pictures to send as messages, automatic or requested by hand."""
    delay = settings.visit_delay_minutes
    rows = waiting_list(t).where(
        (c("Status") == DONE)
        & (nvl(c("Printed"), 0) == 1)
        & (nvl(c("Edited"), 0) == 1)
        & (nvl(c("IsActiveTelegClinic"), 0) == 1)
        & c("TelegramClinic").isNotNull()
    )
    automatic = anti(
        rows.where(
            c("ManualTelegDate").isNull()
            & (c("SentEMail") == 3)
            & (nvl(c("TelegramStatus"), 0) != 2)
            & (c("IsAuto") == 1)
            & dates.age_at_most(c("SentEMailTime"), as_of, settings.email_days)
            & dates.age_at_least(c("SendDate"), as_of, delay)
        ),
        excluded_procedures(t).select("siFiles"),
        "siFiles",
    )
    manual = rows.where(
        c("ManualTelegDate").isNotNull()
        & (nvl(c("ManualTelegStatus"), 0) != 2)
        & dates.age_at_least(c("ManualTelegDate"), as_of, delay)
    )
    folders = t["doctors"].select("siDoctors", "FolderName")
    places = t["files"].select("siFiles", "PathFolder", "FName", "LName")
    # The two sides exclude each other, so the union has nothing to de-duplicate.
    both = automatic.select(*rows.columns).union(manual.select(*rows.columns))
    placed = both.join(folders, "siDoctors").join(places, "siFiles")
    placed = derive_paths(placed, c("PathFolder"), c("FolderName"), c("LName"), c("FName"), c("PatientFileID"))
    text = render_message(
        [
            F.lit("پزشک گرامي"),
            F.concat(F.lit("دکتر "), c("DoctorName2")),
            F.concat(F.lit("مراجعه کننده "), F.concat_ws("", "PFName", F.lit(" "), "PLName")),
            F.concat(F.lit("به همراه:  "), c("Phone1")),
            (nvl(c("Phone2"), "") != "", F.concat(F.lit("به تلفن:  "), c("Phone2"))),
            F.concat(F.lit("در تاريخ "), c("WaitDate"), F.lit(" - "), c("WaitTimeOut")),
            F.concat(F.lit("موضوع: "), c("Subject"), F.lit(" ")),
            _phase(),
            F.lit(settings.signature),
        ],
        CRLF,
    )
    keys = [failed_first(c("TelegramStatus")).asc_nulls_first(), "ReferDate", "WaitTimeOut", "siWait"]
    return top_n(placed, keys, n).select(
        "siWait", "FileID", c("PFName").alias("FName"), c("PLName").alias("LName"), c("Phone1").alias("Mobile"), "ReferDate",
        c("DoctorName2").alias("DoctorName"), "Status", "TelegramClinic", "TelegramStatus", "TelegMessageId", "TryCount",
        c("PathEMail").alias("ImagePath"), "Is3D", text.alias("TitleContent"),
    )


def automatic_lab_candidates(t: Tables, today: str, as_of: Column, settings: QueueSettings) -> DataFrame:
    """Answered laboratory patients and whether they go to the queue now.

    ``Send`` rows are the input of the delivery reset with mode 0.
    """
    rows = lab_patients_in_window(t, today, False, settings.message_days).where(
        dates.datediff_boundary("minute", c("AnswerDate"), as_of) > settings.lab_delay_minutes
    )
    tried = nvl(dates.datediff_boundary("minute", c("SendDate"), as_of), dates.MISSING_AGE)
    send = (c("Status") != 1) & (nvl(c("TelegramStatus"), 0) != 1) & (tried >= BACK_OFF_MINUTES)
    out = rows.select(
        "FileID", "fCode", "Status", "TelegramStatus", "ReferDate", "ReferTime", "SendType",
        tried.alias("TelegramLastTryTime"), flag(send).alias("Send"),
    )
    keys = [failed_first(c("TelegramStatus")).asc_nulls_first(), "-Status", "-ReferDate", "SendType", "ReferTime", "FileID"]
    return top_n(out, keys, None)


def send_queue(
    t: Tables, channel: str, as_of: str, n: int | None = 1, settings: QueueSettings = QueueSettings()
) -> DataFrame:
    """Head of a send queue: ``email``, ``lab_email``, ``sms``, ``lab_message``, ``visit_message``."""
    now = dates.timestamp_lit(as_of)
    build = {
        "email": lambda: email_queue(t, n, settings),
        "lab_email": lambda: lab_email_queue(t, now, n, settings),
        "sms": lambda: sms_queue(t, as_of, n, settings),
        "lab_message": lambda: lab_message_queue(t, now, n, settings),
        "visit_message": lambda: visit_message_queue(t, now, n, settings),
    }
    return build[channel]()
