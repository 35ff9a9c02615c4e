"""Reports and pricing (CQ-1 .. CQ-5, CQ-8, CQ-9, CQ-25)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.nulls import decode, full_name, null_if_blank, null_if_zero, nvl
from wardflow.functions.numbers import reduced_price
from wardflow.operators.aggs import conditional_sums, period_pivot, rollup_pivot
from wardflow.operators.joins import dim_left_join, semi
from wardflow.operators.projections import resolve_tariff
from wardflow.operators.setops import union_distinct
from wardflow.operators.windows import line_no, numbered, period_starts
from wardflow.session import checkpointed

Tables = Mapping[str, DataFrame]
c = F.col

# Labels of the reports.
PHASE_LABEL = {0: "Before"}
PHASE_AFTER = "After"
TARIFF_LABEL = ("ثابت", "عمومی")
PAID_AFTER_LABEL = {1: "در یافت مبلغ AFTER"}
SEND_LABEL = {0: "اورژانس"}
SEND_NORMAL = "عادی"
PERIODS = 24
AUDIT_SINCE = "1397/01/01"


def name_of(first: str, last: str) -> Column:
    """Last and first name; NULL when the last name is missing."""
    return F.concat(c(last), F.lit(" "), nvl(c(first), ""))


def precost(files: DataFrame) -> DataFrame:
    """Number of prepaid visits per record number, for referral look-ups."""
    paid = files.where(c("PaidAfter") == 1).groupBy("FileID").agg(F.count(F.lit(1)).alias("_paid"))
    return paid.withColumnRenamed("FileID", "RefFileID")


def with_precost(files: DataFrame, all_files: DataFrame) -> DataFrame:
    """Adds ``PreCost``: prepaid visits the row refers to, 0 unless it is an after visit.

    Rows that refer to none have no partner, but one join key; they are spread by a second one.
    """
    spread = F.when(c("RefFileID").isNull(), F.xxhash64("siFiles")).otherwise(0)
    # 0 too, but not as a literal, which would be taken out of the join key
    paid = precost(all_files).withColumn("_spread", F.least("_paid", F.lit(0)))
    joined = files.withColumn("_spread", spread).join(paid, ["RefFileID", "_spread"], "left").drop("_spread")
    zero = F.lit(0).cast("bigint")
    return joined.withColumn(
        "PreCost", F.when(c("Bef_Aft") == 1, F.coalesce("_paid", zero)).otherwise(zero)
    ).drop("_paid")


def visit_statistics(t: Tables, visits: DataFrame | None = None) -> DataFrame:
    """One row per visit, operation date, waiting time and account (CQ-1).

    Quantities of equal size on one visit count once.  The child tables are
    reduced to what the report shows before they meet, so the join never makes
    more rows than the result has.  ``visits`` (column ``siFiles``) restricts the
    report before any other table is joined.
    """
    def asked(rows: DataFrame) -> DataFrame:
        return rows if visits is None else semi(rows, visits, "siFiles")

    files = asked(
        t["files"].select(
            "siFiles", "FileID", "RefFileID", "LName", "FName", "ReferDate", "Subject", "Bef_Aft",
            "PaidAfter", "SendType", "siDoctor", "siHospital",
        )
    )
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), name_of("FName", "LName").alias("DoctorName"), "Job",
        c("PerDiscount").alias("D_PerDiscount"), "SumAfter",
    )
    hospitals = t["hospitals"].select("siHospital", "FullName")
    private = t["private_tariffs"].select(c("siDoctors").alias("siDoctor"), F.lit(True).alias("_private")).distinct()
    albums = asked(t["albums"].select("siFiles", "SurgDate")).distinct()
    waits = asked(t["waits"].select("siFiles", "WaitTime", "WaitTimeOut")).distinct()
    services = asked(t["services"].select("siFiles", "Number")).groupBy("siFiles").agg(F.sum_distinct("Number").alias("TotalNumber"))
    discounts = t["discounts"].select("siDiscount", "Title", "PerDiscount")
    accounts = (
        asked(
            t["accounts"].select(
                "siFiles", "siDiscount", "PayableFee", "PaidAmount", "RemainAmount", "Discount", "PaidDate", "Comment", "RoundAmount"
            )
        )
        .join(discounts, "siDiscount", "left")
        .drop("siDiscount")
        .distinct()
    )
    joined = (
        with_precost(files, t["files"])
        .join(albums, "siFiles")
        .join(services, "siFiles", "left")
        .join(waits, "siFiles", "left")
        .join(accounts, "siFiles", "left")
        .join(doctors, "siDoctor")
        .join(hospitals, "siHospital")
        .join(private, "siDoctor", "left")
    )
    return joined.select(
        "siFiles",
        c("FileID").alias("P_FileID"),
        name_of("FName", "LName").alias("PatientName"),
        "DoctorName", "Job", "FullName", "ReferDate", "SurgDate", "WaitTime", "WaitTimeOut", "Subject", "TotalNumber",
        decode(c("Bef_Aft"), PHASE_LABEL, PHASE_AFTER).alias("Bef_Aft"),
        F.when(c("_private"), TARIFF_LABEL[0]).otherwise(TARIFF_LABEL[1]).alias("HasPrivateTariffCost"),
        decode(c("PaidAfter"), PAID_AFTER_LABEL).alias("PaidAfter"),
        "PreCost",
        decode(c("SendType"), SEND_LABEL, SEND_NORMAL).alias("SendType"),
        "D_PerDiscount", "SumAfter", "PayableFee", "PaidAmount", "RemainAmount", "Discount", "PaidDate", "Comment",
        "RoundAmount", "Title", "PerDiscount",
    )


INCOME_COLUMNS = (
    "P_FileID", "ReferDate", "PatientName", "DoctorName", "Job", "Subject", "Bef_Aft", "HasPrivateTariffCost", "SendType",
    "WaitTime", "WaitTimeOut", "PayableFee", "PaidAmount", "RemainAmount", "Discount", "Comment", "RoundAmount",
)


def income_report(t: Tables, lo: str, hi: str) -> DataFrame:
    """Visits referred or paid in a date range, plus a totals row (CQ-2).

    A visit referred outside the range counts with its remainder as paid.  Rows and
    totals come from one pass, by grouping sets over all columns and over none.
    """
    referred = t["files"].where(c("ReferDate").between(lo, hi)).select("siFiles")
    paid = t["accounts"].where(c("PaidDate").between(lo, hi)).select("siFiles")
    # the visits restrict every table below, so they are found once
    rows = visit_statistics(t, checkpointed(union_distinct(referred, paid)))
    in_range = c("ReferDate").between(lo, hi)
    rows = rows.where(in_range | c("PaidDate").between(lo, hi)).select("siFiles", *INCOME_COLUMNS)
    # a row that stands for no visit, so that there are totals where there are no rows
    none = rows.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(False).alias("_real")
    )
    keys = [*rows.columns, "_real"]
    both = rows.withColumn("_real", F.lit(True)).unionByName(none).groupingSets([keys, []], *keys)
    total = F.grouping_id() != 0

    def summed(value: Column) -> Column:
        return F.when(total, F.sum(value))

    cells = both.agg(
        total.alias("_total"),
        F.count(F.lit(1)).alias("_times"),
        F.when(total, "Report").alias("Report"),
        summed(F.when(in_range, c("PayableFee"))).alias("SumPayableFee"),
        summed(F.when(in_range, c("PaidAmount")).otherwise(c("RemainAmount"))).alias("SumPaidAmount"),
        summed(F.when(in_range, c("Discount"))).alias("SumDiscount"),
        summed(F.when(in_range, c("RemainAmount"))).alias("SumRemainAmount"),
        summed(F.when(in_range, c("RoundAmount"))).alias("SumRoundAmount"),
    )
    cells = cells.where(c("_total") | c("_real"))
    once = F.explode(F.sequence(F.lit(1).cast("long"), F.when(c("_total"), 1).otherwise(c("_times"))))
    sums = ["Report", "SumPayableFee", "SumPaidAmount", "SumDiscount", "SumRemainAmount", "SumRoundAmount"]
    return cells.select(*INCOME_COLUMNS, *sums, once.alias("_copy")).drop("_copy")


def referral_pivot(t: Tables, today: str, mode: str = "M", summed: bool = False) -> DataFrame:
    """Referrals per doctor and hospital over the last 24 months or weeks (CQ-3).

    Only the period starts, at most 24 short texts, pass through the driver.
    Visits are counted before the dimensions are joined.
    """
    starts = [r["Shamsi"] for r in period_starts(t["calendar"], today, mode, PERIODS).orderBy("RowNO").collect()]
    counts = period_pivot(
        t["files"].select("siDoctor", "siHospital", "ReferDate"), ["siDoctor", "siHospital"], "ReferDate", today, starts
    )
    cells = [f"Zone{i + 1}" for i in range(PERIODS)]
    missing = {z: F.lit(None).cast("bigint") for z in cells[len(starts):]}
    if missing:
        counts = counts.withColumns(missing)
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"),
        F.concat(nvl(c("LName"), ""), F.lit("    "), nvl(c("FName"), "")).alias("DoctorName"),
        "Job",
        "IsOwnDoc",
    )
    hospitals = t["hospitals"].select("siHospital", "FullName")
    if summed:
        known = semi(counts, hospitals.select("siHospital"), "siHospital")
        rows = rollup_pivot(known, ["siDoctor"], cells).join(doctors, "siDoctor")
        rows = rows.withColumns({"siHospital": F.lit(None).cast("bigint"), "FullName": F.lit(None).cast("string")})
    else:
        rows = counts.join(hospitals, "siHospital").join(doctors, "siDoctor")
    return rows.select("siDoctor", "DoctorName", "Job", "IsOwnDoc", "siHospital", "FullName", *cells).orderBy(
        "DoctorName", "siHospital", "siDoctor"
    )


def _in_branch(branch: int) -> Column:
    return F.lit(True) if branch == 0 else c("siBranch") == branch


def account_list(t: Tables, day: str, branch: int = 0) -> DataFrame:
    """Accounts issued or paid on a day, with line numbers (CQ-4).

    Amounts are blank when the account was paid on another day than issued.
    """
    files = t["files"].where(_in_branch(branch)).select(
        "siFiles", "LName", "FName", "RefPlace", "Subject", "siBranch", "DoctorName"
    )
    rows = (
        t["accounts"]
        .where((c("FactorDate") == day) | (c("PaidDate") == day))
        .join(files, "siFiles")
        .join(t["branches"], "siBranch")
    )
    paid = null_if_blank(c("PaidDate"))
    other_day = paid.isNotNull() & (c("PaidDate") != c("FactorDate"))
    shown = {
        a: F.when(~other_day | other_day.isNull(), c(a))
        for a in ("TotalPrice", "PaidAmount", "RoundAmount", "DiscountTitle", "RemainAmount")
    }
    rest = F.when(paid.isNull(), 0).otherwise(c("RemainAmount"))
    out = rows.select(
        "siAccount",
        full_or_blank("FName", "LName").alias("PatientName"),
        "RefPlace", "Subject", "BranchName", "DoctorName",
        *[v.alias(a) for a, v in shown.items()],
        rest.alias("PaidRemain"),
        "Comment",
    )
    return line_no(out, ["siAccount"])


def full_or_blank(first: str, last: str) -> Column:
    """``last first`` with blanks for missing parts, untrimmed."""
    return F.concat(nvl(c(last), ""), F.lit(" "), nvl(c(first), ""))


def finished_list(t: Tables, day: str, branch: int = 0) -> DataFrame:
    """Visits that were finished on a day, numbered by leaving time (CQ-5)."""
    files = t["files"].where(_in_branch(branch)).select(
        "siFiles", "LName", "FName", "RefPlace", "DoctorName", "Subject", "siBranch", "Job", "Bef_Aft", "SendType"
    )
    rows = (
        t["waits"]
        .where((c("Status") >= 16) & (c("WaitDate") == day))
        .select("siWait", "siFiles", "WaitTimeOut")
        .join(files, "siFiles")
        .join(t["branches"], "siBranch")
        .join(t["albums"].select("siFiles", "siAlbum", "SurgDate"), "siFiles")
    )
    out = rows.select(
        "siWait", "siAlbum", "WaitTimeOut",
        full_or_blank("FName", "LName").alias("PatientName"),
        "RefPlace", "DoctorName", "Subject", "BranchName", "Job",
        decode(c("Bef_Aft"), PHASE_LABEL, PHASE_AFTER).alias("Bef_Aft"),
        decode(c("SendType"), SEND_LABEL, SEND_NORMAL).alias("SendType"),
        "SurgDate",
    )
    return numbered(out, ["WaitTimeOut", "siWait", "siAlbum"])


TARIFF_AMOUNTS = ("ForceAfter", "ConstantBefor", "PercentBefor", "LimmitBefor", "ConstantAfter", "PercentAfter", "LimmitAfter")


def files_with_tariffs(t: Tables) -> DataFrame:
    """Visits with the tariff columns of hospital (``H_``) and doctor (``D_``)."""
    hospitals = t["hospitals"].select(
        "siHospital", "FullName", "Location", *[c(a).alias("H_" + a) for a in TARIFF_AMOUNTS]
    )
    private = t["private_tariffs"].select(
        c("siDoctors").alias("siDoctor"), "siPrivateTariff", *[c(a).alias("D_" + a) for a in TARIFF_AMOUNTS]
    )
    files = t["files"].select(
        "siFiles", "FileID", "RefFileID", "siHospital", "siDoctor", "PaidAfter", "SendType", "Bef_Aft"
    )
    return files.join(hospitals, "siHospital").join(private, "siDoctor", "left")


def visit_tariff(t: Tables) -> DataFrame:
    """The tariff that applies to each visit (CQ-8)."""
    rows = with_precost(files_with_tariffs(t), t["files"])
    resolved = resolve_tariff(c("Location"))
    return rows.select(
        "siFiles", "Location", "FullName",
        *[v.alias(n) for n, v in resolved.items()],
        "PaidAfter", "SendType", "Bef_Aft", "FileID",
        null_if_zero(c("PreCost")).alias("PreCost"),
    )


def price_totals(t: Tables, visits: DataFrame) -> DataFrame:
    """Service totals per visit and the general price sums (CQ-9)."""
    tariffs = t["tariffs"].where(c("Disabled").isNull())
    normal = tariffs.where(c("Type") == 0).select("siCommonTariff", "Price", "IsAfter")
    lines = semi(t["services"].select("siFiles", "siCommonTariff", "Number"), visits, "siFiles").join(
        normal, "siCommonTariff"
    )
    sums = conditional_sums(
        lines,
        c("Number") * c("Price"),
        {"All": F.lit(True), "Normal": c("IsAfter") == 0, "After": c("IsAfter") == 1},
        ["siFiles"],
    )
    classes = {"Extra": c("Type") == 2}
    classes |= {n: (c("Type") == 1) & (c("TariffClass") == i) for i, n in enumerate(("T_F", "T_B", "T_A", "T_O"))}
    general = conditional_sums(tariffs, c("Price"), classes)
    one_row = general.select(F.struct(*classes).alias("g")).scalar()
    return (
        visits.select("siFiles").distinct().join(sums, "siFiles", "left")
        .withColumn("_general", one_row)
        .select("siFiles", "All", "Normal", "After", "_general.*")
    )


def extra_price_list(t: Tables, visits: DataFrame) -> DataFrame:
    """Extra services that may be priced for the visits, at reduced prices (CQ-9).

    ``siFiles`` says which visit an offer belongs to.  Tariffs that are always offered
    appear with every service row they have, or alone when they have none.  Services
    are restricted before they meet the tariffs: of the other tariffs only those of
    the asked visits count.
    """
    tariffs = t["tariffs"].where(c("Type") != 1).select(
        "siCommonTariff", "TariffName", "Price", "Type", "IsAfter", "ExtraPercent", "ForceExtra"
    )
    services = t["services"].select("siServiceTable", "siFiles", "siCommonTariff", "Number")
    asked = visits.select("siFiles")
    phases = t["files"].select("siFiles", "Bef_Aft")
    forced = c("ForceExtra") == 1
    always = dim_left_join(tariffs.where(forced), services, "siCommonTariff")
    others = semi(services, asked, "siFiles").join(tariffs.where(~nvl(forced, False)), "siCommonTariff")
    rows = (
        always.unionByName(others)
        .join(phases, "siFiles", "left")
        .where(c("Bef_Aft").isNull() | (c("Bef_Aft") == 1) | (c("Bef_Aft") == c("IsAfter")))
    )
    return rows.select(
        "siFiles", "siServiceTable", "siCommonTariff", "TariffName",
        reduced_price(c("Price"), c("ExtraPercent")).alias("Price"),
        "Type", "IsAfter", nvl(c("ExtraPercent"), 0).alias("ExtraPercent"), "ForceExtra", "Bef_Aft", "Number",
        nvl(c("Number"), 1).alias("Number2"),
    )


def visit_offers(t: Tables, visits: DataFrame) -> DataFrame:
    """Extra services that may be priced for each asked visit, at reduced prices (CQ-9).

    Unlike ``extra_price_list``, an offer that is always made belongs to every asked
    visit: with the visit's own service rows, or without one.  Only the services of the asked
    visits are read into the join, and the tariffs that are always offered are few.
    """
    tariffs = t["tariffs"].where(c("Type") != 1).select(
        "siCommonTariff", "TariffName", "Price", "Type", "IsAfter", "ExtraPercent", "ForceExtra"
    )
    asked = semi(t["files"].select("siFiles", "Bef_Aft"), visits.select("siFiles"), "siFiles")
    services = semi(t["services"].select("siServiceTable", "siFiles", "siCommonTariff", "Number"), visits.select("siFiles"), "siFiles")
    used = services.join(tariffs.select("siCommonTariff"), "siCommonTariff", "left_semi")
    forced = tariffs.where(c("ForceExtra") == 1).select("siCommonTariff")
    listed = forced.agg(F.collect_set("siCommonTariff").alias("l")).scalar()
    always = asked.select("siFiles", F.explode(listed).alias("siCommonTariff"))
    bare = always.join(used.select("siFiles", "siCommonTariff").distinct(), ["siFiles", "siCommonTariff"], "left_anti")
    rows = used.unionByName(bare, allowMissingColumns=True).join(tariffs, "siCommonTariff").join(asked, "siFiles")
    rows = rows.where(c("Bef_Aft").isNull() | (c("Bef_Aft") == 1) | (c("Bef_Aft") == c("IsAfter")))
    return rows.select(
        "siFiles", "siServiceTable", "siCommonTariff", "TariffName",
        reduced_price(c("Price"), c("ExtraPercent")).alias("Price"),
        "Type", "IsAfter", nvl(c("ExtraPercent"), 0).alias("ExtraPercent"), "ForceExtra", "Bef_Aft", "Number",
        nvl(c("Number"), 1).alias("Number2"),
    )


def account_audit(t: Tables, since: str = AUDIT_SINCE) -> DataFrame:
    """Current and logged versions of changed accounts (CQ-25)."""
    log = t["account_log"]
    cols = [x for x in log.columns if x not in ("LogDateTime", "LogType")]
    current = semi(t["accounts"].select(*cols), log.select("siFiles"), "siFiles").select(
        "*", F.lit(None).cast(log.schema["LogDateTime"].dataType).alias("LogDateTime"), F.lit("Issued").alias("LogType")
    )
    files = t["files"].where(c("ReferDate") >= since).select("siFiles", "FName", "LName")
    return union_distinct(current, log).join(files, "siFiles").orderBy(F.desc("siFiles"), F.desc("siAccount"))


def service_audit(t: Tables, since: str = AUDIT_SINCE) -> DataFrame:
    """Current and logged versions of changed services, current ones first (CQ-25)."""
    log = t["service_log"]
    cols = [x for x in log.columns if x != "siAccount"]
    current = semi(t["services"].select(*cols), log.select("siFiles"), "siFiles").withColumn(
        "siAccount", F.lit(0).cast(log.schema["siAccount"].dataType)
    )
    files = t["files"].where(c("ReferDate") >= since).select("siFiles", "FName", "LName", "FileID", "ReferDate")
    rows = union_distinct(current, log).join(files, "siFiles")
    return rows.orderBy(F.desc("siFiles"), F.nullif(c("siAccount"), F.lit(0)).desc_nulls_first())
