"""Queries for sources, projections, filters, text and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.bindings.registry import query
from wardflow.functions import dates, nulls, numbers, text
from wardflow.operators import aggs, filters, projections, sorting
from wardflow.operators.xmlrows import shred_pairs
from wardflow.sources import calendar as cal
from wardflow.sources import tables as src

c = F.col
AS_OF = "2024-01-30 12:00:00"


def now():
    return dates.timestamp_lit(AS_OF)


# ---------------------------------------------------------------- sources

@query("src_01_scan", "SELECT siFiles, FileID, ReferDate, Subject FROM files")
def _(t):
    return src.scan(t, "files", ["siFiles", "FileID", "ReferDate", "Subject"])


@query(
    "src_02_namespaces",
    """SELECT c_custkey, c_name, count(*) AS visits
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def _(t):
    spaces = src.ParquetTables(t.spark, t.base.folders[""], doc=t.base.folders[""])
    doctors = src.scan(spaces, "doc.customer", ["c_custkey", "c_name"])
    visits = src.scan(spaces, "orders", ["o_custkey"]).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("visits")
    )
    return visits.join(doctors, c("o_custkey") == c("c_custkey")).select("c_custkey", "c_name", "visits")


@query(
    "src_03_staged",
    """WITH s AS (SELECT siFiles, CAST(sum(Number) AS BIGINT) AS n FROM services GROUP BY siFiles)
       SELECT siFiles, n, NULL AS total FROM s WHERE n >= 10
       UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT) FROM s""",
)
def _(t):
    sums = t["services"].groupBy("siFiles").agg(F.sum("Number").alias("n"))
    detail, total = src.staged(
        sums, lambda d: d.where(c("n") >= 10), lambda d: d.agg(F.sum("n").alias("total"))
    )
    return detail.unionByName(total, allowMissingColumns=True)


@query(
    "src_04_settings",
    """SELECT siFiles, FileID, (SELECT max(p_size) FROM part) AS YearCode,
              (SELECT 'x/' || max(p_brand) FROM part) AS PdfPath FROM files""",
)
def _(t):
    settings = t["part"].agg(
        F.max("p_size").alias("YearCode"), F.concat(F.lit("x/"), F.max("p_brand")).alias("PdfPath")
    )
    return src.with_settings(t["files"].select("siFiles", "FileID"), settings, ["YearCode", "PdfPath"])


# ------------------------------------------------------------ projections

@query("prj_01_light", "SELECT * EXCLUDE (Thumb, Address, Comment) FROM files")
def _(t):
    return projections.select_light(t["files"], ["Thumb", "Address", "Comment"])


@query(
    "prj_02_names",
    """SELECT siDoctors,
         trim(coalesce(LName, '') || '  ' || coalesce(FName, '')) AS DoctorName,
         trim(coalesce(FName, '') || '  ' || coalesce(LName, '')) AS Reversed,
         trim(coalesce(LName, '') || '  ' || coalesce(FName, '')) || '  -  ' || FileID || '  -  ' || Job AS FullName,
         trim(coalesce(LName, '') || ' ' || coalesce(FName, '')) || ' (' || Job || ')' || FileID AS WithJob
       FROM doctors""",
)
def _(t):
    name = nulls.full_name(c("FName"), c("LName"), sep="  ")
    return t["doctors"].select(
        "siDoctors",
        name.alias("DoctorName"),
        nulls.full_name(c("FName"), c("LName"), "first_last", "  ").alias("Reversed"),
        nulls.name_dash_job(name, c("Job"), c("FileID")).alias("FullName"),
        nulls.name_with_job(nulls.full_name(c("FName"), c("LName")), c("Job"), c("FileID")).alias("WithJob"),
    )


@query(
    "prj_03_concat",
    """SELECT siDoctors, FileID || '-' || LName || ' ' || FName || '-' || Job AS Alias,
         concat(LName, coalesce(' ' || FName, ''), '-', Job, '-', FileID) AS Doctor,
         CASE WHEN PerDiscount BETWEEN 1 AND 100 THEN PerDiscount || '%' ELSE PerDiscount || '' END AS Discount
       FROM doctors""",
)
def _(t):
    dash, blank = F.lit("-"), F.lit(" ")
    return t["doctors"].select(
        "siDoctors",
        nulls.cat_strict(c("FileID"), dash, c("LName"), blank, c("FName"), dash, c("Job")).alias("Alias"),
        nulls.cat_loose(
            c("LName"), nulls.cat_strict(blank, c("FName")), dash, c("Job"), dash, c("FileID")
        ).alias("Doctor"),
        nulls.percent_text(c("PerDiscount")).alias("Discount"),
    )


@query(
    "prj_04_decode",
    """SELECT siWait,
         CASE Status WHEN 1 THEN 'ثبت شد' WHEN 2 THEN 'چک شد' WHEN 4 THEN 'عکسبرداري شد'
           WHEN 8 THEN 'خدمات تعيين شد' WHEN 16 THEN 'تسويه حساب شد' END AS WaitStatus,
         CASE SurgStatus WHEN 0 THEN 'Before' ELSE 'AFTER' END AS SG_Status,
         CASE coalesce(SentEMail, 0) WHEN 1 THEN 'صف' WHEN 2 THEN 'Failed' WHEN 3 THEN 'ارسال' END AS MailTitle
       FROM waits""",
)
def _(t):
    return t["waits"].select(
        "siWait",
        nulls.decode(c("Status"), nulls.WAIT_STATUS).alias("WaitStatus"),
        nulls.decode(c("SurgStatus"), {0: "Before"}, "AFTER").alias("SG_Status"),
        nulls.decode(nulls.nvl(c("SentEMail"), 0), nulls.EMAIL_TITLE).alias("MailTitle"),
    )


@query(
    "prj_05_flags",
    """SELECT siWait, CASE WHEN Edited IS NULL THEN 1 ELSE 0 END AS IsFirstPrint,
         CASE WHEN coalesce(Edited, 0) = 1 AND coalesce(Printed, 0) = 1 THEN 1 ELSE 0 END AS Finished
       FROM waits""",
)
def _(t):
    done = (nulls.nvl(c("Edited"), 0) == 1) & (nulls.nvl(c("Printed"), 0) == 1)
    return t["waits"].select(
        "siWait", nulls.flag(c("Edited").isNull()).alias("IsFirstPrint"), nulls.flag(done).alias("Finished")
    )


@query(
    "prj_06_nulls",
    """SELECT a.siAccount, nullif(trim(f.Phone2), '') AS Phone2, coalesce(f.IsScanned, -1) AS IsScanned,
         nullif(a.RoundAmount, 0) AS RoundAmount, coalesce(a.IsExtra, 0) = 0 AS Normal
       FROM accounts a JOIN files f ON f.siFiles = a.siFiles""",
)
def _(t):
    files = t["files"].select("siFiles", "Phone2", "IsScanned")
    return t["accounts"].join(files, "siFiles").select(
        "siAccount",
        nulls.null_if_blank(c("Phone2")).alias("Phone2"),
        nulls.nvl(c("IsScanned"), -1).alias("IsScanned"),
        nulls.null_if_zero(c("RoundAmount")).alias("RoundAmount"),
        nulls.same_or_default(c("IsExtra"), 0).alias("Normal"),
    )


@query(
    "prj_07_paths",
    """WITH p AS (
         SELECT siFiles, PathFolder || chr(92) || FolderName || chr(92) || f.LName || ' ' || f.FName || ' ' || f.FileID AS base,
           chr(92) || f.LName || ' ' || f.FName || ' ' || f.FileID AS leaf
         FROM files f JOIN doctors d ON f.siDoctor = d.siDoctors)
       SELECT siFiles, base AS Path, base || leaf || '-Final' AS PathFinal, base || leaf || '-EMail' AS PathEMail,
         base || leaf || '-Original' AS PathOriginal, base || leaf || '-Others' AS PathOther FROM p""",
)
def _(t):
    folders = t["doctors"].select(c("siDoctors").alias("siDoctor"), "FolderName")
    visits = t["files"].select("siFiles", "siDoctor", "PathFolder", "LName", "FName", "FileID")
    out = projections.derive_paths(
        visits.join(folders, "siDoctor"), c("PathFolder"), c("FolderName"), c("LName"), c("FName"), c("FileID")
    )
    return out.select("siFiles", "Path", "PathFinal", "PathEMail", "PathOriginal", "PathOther")


@query(
    "prj_08_message",
    """SELECT siFiles, 'Dear ' || DoctorName || chr(13) || chr(10) || 'visit of ' || concat(FName, ' ', LName) || chr(13) || chr(10)
         || CASE WHEN coalesce(Phone2, '') <> '' THEN 'phone: ' || Phone2 || chr(13) || chr(10) ELSE '' END
         || 'on ' || ReferDate AS Message FROM files""",
)
def _(t):
    lines = [
        F.concat(F.lit("Dear "), c("DoctorName")),
        F.concat(F.lit("visit of "), nulls.cat_loose(c("FName"), F.lit(" "), c("LName"))),
        (nulls.nvl(c("Phone2"), "") != "", F.concat(F.lit("phone: "), c("Phone2"))),
        F.concat(F.lit("on "), c("ReferDate")),
    ]
    return t["files"].select("siFiles", projections.render_message(lines).alias("Message"))


@query(
    "prj_09_padding",
    """SELECT siFiles, PaidAmount, NULL AS Number FROM accounts
       UNION ALL SELECT siFiles, NULL, Number FROM services""",
)
def _(t):
    accounts = t["accounts"].select("siFiles", "PaidAmount")
    services = t["services"].select("siFiles", "Number")
    both = accounts.withColumn("Number", F.lit(None).cast("bigint")).schema
    return projections.pad_to(accounts, both).union(projections.pad_to(services, both))


@query(
    "prj_10_line_price",
    """SELECT s.siServiceTable, s.siFiles, coalesce(s.Number, 0) * p.Price AS Fee, coalesce(s.Number, 1) * p.Price AS FeeOne,
         p.Price - (p.Price * coalesce(p.ExtraPercent, 0)) // 100 AS Reduced
       FROM services s JOIN tariffs p ON p.siCommonTariff = s.siCommonTariff""",
)
def _(t):
    tariffs = t["tariffs"].select("siCommonTariff", "Price", "ExtraPercent")
    return t["services"].join(tariffs, "siCommonTariff").select(
        "siServiceTable",
        "siFiles",
        numbers.line_fee(c("Number"), c("Price")).alias("Fee"),
        numbers.line_fee(c("Number"), c("Price"), 1).alias("FeeOne"),
        numbers.reduced_price(c("Price"), c("ExtraPercent")).alias("Reduced"),
    )


# ---------------------------------------------------------------- filters

@query(
    "flt_01_lookup",
    """SELECT siAccount, siFiles, PayableFee FROM accounts
       WHERE siFiles IN (SELECT siFiles FROM waits) AND coalesce(IsExtra, 0) = 0""",
)
def _(t):
    rows = t["accounts"].where(nulls.same_or_default(c("IsExtra"), 0))
    return filters.lookup(rows, t["waits"], ["siFiles"]).select("siAccount", "siFiles", "PayableFee")


@query(
    "flt_02_optional_search",
    """SELECT siFiles, LName, ReferDate FROM files
       WHERE BirthYear >= '1345' AND SendType = 1 AND LName LIKE '%L1%' AND Subject LIKE '%HIGH%'""",
)
def _(t):
    criteria = [
        ("BirthYear", "ge", "1345"),
        ("BirthYear", "le", None),
        ("SendType", "eq", 1, (None, 2)),
        ("PaidAfter", "eq", 2, (None, 2)),
        ("LName", "contains", "L1"),
        ("Subject", "contains", "HIGH"),
        ("Phone1", "like", None),
    ]
    return filters.search(t["files"], criteria).select("siFiles", "LName", "ReferDate")


@query(
    "flt_03_date_ranges",
    """SELECT siAccount, FactorDate, PaidDate FROM accounts
       WHERE FactorDate BETWEEN '1376/01/01' AND '1377/06/31' OR PaidDate BETWEEN '1376/01/01' AND '1377/06/31'""",
)
def _(t):
    rows = t["accounts"].select("siAccount", "FactorDate", "PaidDate")
    return rows.where(filters.either_in_range(["FactorDate", "PaidDate"], "1376/01/01", "1377/06/31"))


@query(
    "flt_04_like",
    """SELECT siFiles, LName, Comment FROM files
       WHERE LName LIKE 'L3%' OR Comment LIKE '%MEDIUM%' OR Comment || ' ' LIKE '%1-URGENT F %'""",
)
def _(t):
    cond = (
        filters.like_any(c("LName"), "L3", "starts")
        | filters.like_any(c("Comment"), "MEDIUM")
        | filters.like_any(c("Comment"), "1-URGENT F", "item", " ")
    )
    return t["files"].where(cond).select("siFiles", "LName", "Comment")


@query(
    "flt_05_in_list",
    """SELECT f.siFiles, f.siBranch, d.Filter FROM files f JOIN doctors d ON d.siDoctors = f.siDoctor
       WHERE f.siBranch IN (1, 3, 4) AND list_contains(string_split(d.Filter, ','), 'PROMO')""",
)
def _(t):
    doctors = t["doctors"].select(c("siDoctors").alias("siDoctor"), "Filter")
    rows = t["files"].where(filters.in_list(c("siBranch"), ",1,3,4,"))
    return rows.join(doctors, "siDoctor").where(filters.in_list(F.lit("PROMO"), c("Filter"))).select(
        "siFiles", "siBranch", "Filter"
    )


@query(
    "flt_06_state_mask",
    "SELECT siWait, Status FROM waits WHERE Status IN (1, 2, 4, 8, 16) AND (Status & 21) <> 0",
)
def _(t):
    return t["waits"].where(filters.mask_filter(c("Status"), 21)).select("siWait", "Status")


@query(
    "flt_07_exists_flags",
    """SELECT siFiles, CASE WHEN siFiles IN (SELECT siFiles FROM services) THEN 1 ELSE 0 END AS HasService,
         CASE WHEN siFiles IN (SELECT siFiles FROM albums) THEN 1 ELSE 0 END AS HasAlbum,
         CASE WHEN siFiles IN (SELECT siFiles FROM waits) THEN 1 ELSE 0 END AS HasWait FROM files""",
)
def _(t):
    relations = {"HasService": t["services"], "HasAlbum": t["albums"], "HasWait": t["waits"]}
    return filters.exists_flags(t["files"].select("siFiles"), "siFiles", relations)


@query(
    "flt_08_membership",
    """SELECT siDoctors, 'in' AS side FROM doctors WHERE siDoctors IN (SELECT siDoctors FROM private_tariffs)
       UNION ALL SELECT siDoctors, 'out' FROM doctors WHERE siDoctors NOT IN (SELECT siDoctors FROM private_tariffs)
       UNION ALL SELECT siDoctors, 'all' FROM doctors""",
)
def _(t):
    doctors = t["doctors"].select("siDoctors")
    parts = [
        filters.membership(doctors, t["private_tariffs"], "siDoctors", mode).withColumn("side", F.lit(mode))
        for mode in ("in", "out", "all")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "flt_09_two_words",
    """SELECT d.siDocument, a.siAlbum, f.siFiles FROM files f
       LEFT JOIN albums a ON a.siFiles = f.siFiles LEFT JOIN visit_documents d ON d.siAlbum = a.siAlbum
       WHERE (coalesce(d.Comment LIKE '%the %', false) OR coalesce(a.Comment LIKE '%the %', false) OR coalesce(f.Comment LIKE '%the %', false))
         AND (coalesce(d.Comment LIKE '%HIGH%', false) OR coalesce(a.Comment LIKE '%HIGH%', false) OR coalesce(f.Comment LIKE '%HIGH%', false))""",
)
def _(t):
    files = t["files"].select("siFiles", c("Comment").alias("f"))
    albums = t["albums"].select("siFiles", "siAlbum", c("Comment").alias("a"))
    docs = t["visit_documents"].select("siAlbum", "siDocument", c("Comment").alias("d"))
    rows = files.join(albums, "siFiles", "left").join(docs, "siAlbum", "left")
    cond = filters.multi_text_search([c("d"), c("a"), c("f")], "the ", "HIGH", "and")
    return rows.where(cond).select("siDocument", "siAlbum", "siFiles")


@query(
    "flt_10_mask_match",
    """WITH m AS (SELECT siDocument, CheckValue AS v, coalesce(substr(CheckValue, 1, 1), '~') AS a,
                    coalesce(substr(CheckValue, 3, 1), '~') AS b FROM visit_documents)
       SELECT siDocument, v AS CheckValue,
         CASE WHEN v IS NULL THEN 1 WHEN a = '1' AND b = '0' THEN 1 ELSE 0 END AS AllMatch,
         CASE WHEN v IS NULL THEN 0 WHEN a = '1' OR b = '0' THEN 1 ELSE 0 END AS AnyMatch FROM m""",
)
def _(t):
    return t["visit_documents"].select(
        "siDocument",
        "CheckValue",
        text.mask_match(c("CheckValue"), "120", "and").alias("AllMatch"),
        text.mask_match(c("CheckValue"), "120", "or").alias("AnyMatch"),
    )


@query(
    "flt_11_time_window",
    """SELECT siWait, strftime(SendDate, '%Y-%m-%d %H:%M:%S') AS SendDate FROM waits
       WHERE coalesce(date_diff('minute', SendDate, TIMESTAMP '2024-01-30 12:00:00'), 999) >= 5
         AND date_diff('day', ManualTelegDate, TIMESTAMP '2024-01-30 12:00:00') <= 20""",
)
def _(t):
    cond = dates.age_at_least(c("SendDate"), now(), 5) & dates.age_at_most(c("ManualTelegDate"), now(), 20)
    return t["waits"].where(cond).select(
        "siWait", F.date_format("SendDate", "yyyy-MM-dd HH:mm:ss").alias("SendDate")
    )


@query(
    "flt_12_codes",
    "SELECT siCommonTariff, TariffName, Price FROM tariffs WHERE Type = 0 AND Disabled IS NULL",
)
def _(t):
    return filters.code_filter(t["tariffs"], "Type", [0], "Disabled").select("siCommonTariff", "TariffName", "Price")


@query(
    "flt_13_contacts",
    """WITH d AS (SELECT siDoctors, coalesce(trim(EMail1), '') || coalesce(trim(EMail2), '') || coalesce(trim(SMS1), '') || coalesce(trim(SMS2), '') AS k FROM doctors)
       SELECT siDoctors, CASE WHEN k <> '' THEN 1 ELSE 2 END AS Mode FROM d
       UNION ALL SELECT siDoctors, 0 FROM d""",
)
def _(t):
    cols = ["EMail1", "EMail2", "SMS1", "SMS2"]
    parts = [
        filters.contact_filter(t["doctors"], cols, mode).select("siDoctors", F.lit(mode).alias("Mode"))
        for mode in (0, 1, 2)
    ]
    return parts[0].union(parts[1]).union(parts[2])


# ------------------------------------------------------- text and dates

@query(
    "st_01_count_char",
    """SELECT doc_id, CAST(length(rtrim(text, ' ')) - length(replace(rtrim(text, ' '), ',', '')) AS INT) AS commas,
         CAST(length(rtrim(text, ' ')) - length(replace(rtrim(text, ' '), ' ', '')) AS INT) AS blanks FROM documents""",
)
def _(t):
    return t["documents"].select(
        "doc_id", text.count_char(c("text"), ",").alias("commas"), text.count_char(c("text"), " ").alias("blanks")
    )


@query(
    "st_02_count_lines",
    r"""SELECT doc_id, len(string_split(left(rtrim(text, ' '), greatest(length(rtrim(text, ' ')) - 1, 0)), chr(10))) - 1 AS line_feeds FROM documents""",
)
def _(t):
    return t["documents"].select("doc_id", text.count_lines(c("text")).cast("bigint").alias("line_feeds"))


@query(
    "st_03_letters",
    """SELECT siDoctors, replace(replace(FName, 'ک', 'ك'), 'ی', 'ي') AS Arabic,
         replace(replace(replace(replace(FName, 'ک', 'ك'), 'ی', 'ي'), 'ك', 'ک'), 'ي', 'ی') AS Persian FROM doctors""",
)
def _(t):
    arabic = text.to_arabic(c("FName"))
    return t["doctors"].select("siDoctors", arabic.alias("Arabic"), text.to_persian(arabic).alias("Persian"))


@query("st_04_match_key", "SELECT siDoctors, replace(concat(LName, '-', FName, MedicalID), ' ', '') AS Total FROM doctors")
def _(t):
    return t["doctors"].select(
        "siDoctors", text.match_key(c("LName"), F.lit("-"), c("FName"), c("MedicalID")).alias("Total")
    )


@query(
    "st_05_strings",
    """SELECT c_custkey, left(c_name, 4) AS a, right(c_name, 3) AS b, substr(c_name, 3, 5) AS c,
         instr(c_name, '#') AS d, substr(c_name, 1, 1) || '**' || substr(c_name, 4) AS e, reverse(c_name) AS f,
         c_mktsegment || chr(10) AS g FROM customer""",
)
def _(t):
    name = c("c_name")
    return t["customer"].select(
        "c_custkey",
        F.left(name, F.lit(4)).alias("a"),
        F.right(name, F.lit(3)).alias("b"),
        F.substring(name, 3, 5).alias("c"),
        F.locate("#", name).cast("bigint").alias("d"),
        F.overlay(name, F.lit("**"), 2, 2).alias("e"),
        F.reverse(name).alias("f"),
        F.concat(c("c_mktsegment"), F.char(F.lit(10))).alias("g"),
    )


@query(
    "st_06_split_lines",
    r"""WITH d AS (SELECT siDoctors, trim(Comment, ' ') AS s FROM doctors),
         p AS (SELECT siDoctors, s, string_split(CASE WHEN right(s, 1) = chr(10) THEN left(s, length(s) - 1) ELSE s END, chr(10)) AS l FROM d)
       SELECT siDoctors, CASE WHEN s <> '' THEN trim(l[1], ' ') END AS Address1, CASE WHEN s <> '' THEN trim(l[2], ' ') END AS Address2,
         CASE WHEN s <> '' THEN trim(l[3], ' ') END AS Address3, CASE WHEN s <> '' THEN trim(l[4], ' ') END AS Address4 FROM p""",
)
def _(t):
    lines = text.split_lines(c("Comment"))
    return t["doctors"].select("siDoctors", *[x.alias(f"Address{i + 1}") for i, x in enumerate(lines)])


@query(
    "st_07_phones",
    """SELECT siFiles, if(NOT regexp_matches(';' || Phone1, '^(;0?)+9'), Phone1, NULL) AS Phone, if(regexp_matches(';' || Phone1, '^(;0?)+9'), Phone1, NULL) AS Mobile FROM files""",
)
def _(t):
    phone, mobile = text.classify_phone(c("Phone1"))
    return t["files"].select("siFiles", phone.alias("Phone"), mobile.alias("Mobile"))


@query(
    "dt_01_to_shamsi",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, Shamsi FROM lineitem
       LEFT JOIN calendar ON MiladiDate = CAST(l_shipdate AS DATE)""",
)
def _(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.to_shamsi(c("l_shipdate")).alias("Shamsi")
    )


@query(
    "dt_02_calendar_lookup",
    """SELECT o_orderkey, Shamsi, strftime(o_orderdate, '%Y/%m/%d') AS Miladi,
         (SELECT Shamsi FROM calendar WHERE MiladiDate = DATE '2024-01-30') AS Today
       FROM orders LEFT JOIN calendar ON MiladiDate = CAST(o_orderdate AS DATE)""",
)
def _(t):
    days = t["calendar"]
    out = cal.shamsi_of(t["orders"].select("o_orderkey", "o_orderdate"), days, "o_orderdate", "Shamsi")
    out = cal.miladi_of(out, days, "Shamsi", "Miladi")
    return out.select("o_orderkey", "Shamsi", "Miladi", cal.today_shamsi(days, AS_OF).scalar().alias("Today"))


@query(
    "dt_03_calendar_use",
    """SELECT k.Shamsi, k.DayInMonth, k.DayInWeek, count(*) AS visits FROM orders
       JOIN calendar k ON k.MiladiDate = CAST(o_orderdate AS DATE) GROUP BY k.Shamsi, k.DayInMonth, k.DayInWeek""",
)
def _(t):
    daily = t["orders"].groupBy(c("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("visits"))
    return daily.join(t["calendar"], c("d") == c("MiladiDate")).select(
        "Shamsi", "DayInMonth", "DayInWeek", "visits"
    )


@query(
    "dt_04_add_time",
    """SELECT event_id, strftime(ts + INTERVAL '10' DAY, '%Y-%m-%d %H:%M:%S') AS later,
         strftime(ts - INTERVAL '90' MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier FROM events""",
)
def _(t):
    pattern = "yyyy-MM-dd HH:mm:ss"
    return t["events"].select(
        "event_id",
        F.date_format(dates.add_time(c("ts"), 10), pattern).alias("later"),
        F.date_format(dates.add_time(c("ts"), -90, "minute"), pattern).alias("earlier"),
    )


@query(
    "dt_05_boundaries",
    """SELECT event_id, date_diff('minute', ts, TIMESTAMP '2024-01-30 12:00:00') AS minutes,
         date_diff('hour', ts, TIMESTAMP '2024-01-30 12:00:00') AS hours, date_diff('day', ts, TIMESTAMP '2024-01-30 12:00:00') AS days,
         date_diff('month', ts, TIMESTAMP '2024-01-30 12:00:00') AS months, date_diff('year', ts, TIMESTAMP '2024-01-30 12:00:00') AS years FROM events""",
)
def _(t):
    return t["events"].select(
        "event_id",
        *[
            dates.datediff_boundary(unit, c("ts"), now()).cast("bigint").alias(unit + "s")
            for unit in ("minute", "hour", "day", "month", "year")
        ],
    )


@query(
    "dt_06_formats",
    "SELECT event_id, strftime(ts, '%H:%M') AS clock, strftime(ts, '%Y/%m/%d') AS day FROM events",
)
def _(t):
    return t["events"].select("event_id", dates.hhmm(c("ts")).alias("clock"), dates.ymd(c("ts")).alias("day"))


@query(
    "dt_07_pick_latest",
    """SELECT siWait, CASE WHEN coalesce(SendDate, TIMESTAMP '2000-01-01') >= coalesce(ManualTelegDate, TIMESTAMP '2000-01-01')
         THEN TelegramStatus ELSE ManualTelegStatus END AS TelegramStatus FROM waits""",
)
def _(t):
    picked = dates.pick_latest(c("SendDate"), c("ManualTelegDate"), c("TelegramStatus"), c("ManualTelegStatus"))
    return t["waits"].select("siWait", picked.alias("TelegramStatus"))


@query(
    "dt_08_clock_minutes",
    """SELECT siWait, date_diff('minute', CAST(WaitTime || ':00' AS TIME), CAST(WaitTimeOut || ':00' AS TIME)) AS minutes FROM waits""",
)
def _(t):
    return t["waits"].select(
        "siWait", dates.clock_minutes(c("WaitTime"), c("WaitTimeOut")).cast("bigint").alias("minutes")
    )


SHORT_DATES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%y/%-m/%-d')
    WHEN 1 THEN '3' || strftime(o_orderdate, '%y/%-m/%-d') WHEN 2 THEN '13' || strftime(o_orderdate, '%y/%-m/%-d') END AS d,
    strftime(o_orderdate, '%y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS dd FROM orders"""


def short_dates(t):
    """Date text as it was typed in: short years, no padding, some missing."""
    d, k = c("o_orderdate"), c("o_orderkey") % 4
    short = F.date_format(d, "yy/M/d")
    typed = F.when(k == 0, short).when(k == 1, F.concat(F.lit("3"), short)).when(k == 2, F.concat(F.lit("13"), short))
    return t["orders"].select("o_orderkey", typed.alias("d"))


@query(
    "dt_09_repair_date",
    f"SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN '13' || y || '/' || m || '/' || dd END AS ReferDate FROM ({SHORT_DATES}) AS q",
)
def _(t):
    return short_dates(t).select("o_orderkey", dates.repair_date(c("d")).alias("ReferDate"))


@query(
    "mt_01_integers",
    """SELECT siFiles, CAST(left(ReferDate, 4) AS INT) - CAST(BirthYear AS INT) AS Years,
         CAST(trunc((siFiles - 7000) / 9.0) AS BIGINT) AS Quotient, (siFiles - 7000) % 9 AS Remainder FROM files""",
)
def _(t):
    return t["files"].select(
        "siFiles",
        numbers.age(c("BirthYear"), c("ReferDate")).alias("Years"),
        numbers.int_div(c("siFiles") - 7000, 9).alias("Quotient"),
        ((c("siFiles") - 7000) % 9).alias("Remainder"),
    )


@query(
    "cv_01_casts",
    """SELECT siDoctors, TRY_CAST(MedicalID AS INT) AS MedicalID, TRY_CAST(LName AS INT) AS NotANumber, left(FileID || '', 5) AS Short,
         ('0x' || lpad(CAST(siDoctors AS STRING), 6, '0'))::BIGINT AS FromHex FROM doctors""",
)
def _(t):
    return t["doctors"].select(
        "siDoctors",
        numbers.cast_safe(c("MedicalID"), "int").alias("MedicalID"),
        numbers.cast_safe(c("LName"), "int").alias("NotANumber"),
        numbers.cut(c("FileID"), 5).alias("Short"),
        numbers.hex_to_number(F.lpad(c("siDoctors").cast("string"), 6, "0")).alias("FromHex"),
    )


@query(
    "xm_01_shred",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS STRING) AS F1, CAST(l_suppkey AS STRING) AS F2 FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, NULL FROM lineitem""",
)
def _(t):
    xml = F.format_string(
        "<T><F>%d</F><F>%d</F></T><T><F>%s</F></T>", c("l_partkey"), c("l_suppkey"), c("l_returnflag")
    )
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", xml.alias("list"))
    return shred_pairs(rows, "list").drop("list")
