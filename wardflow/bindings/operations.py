"""Queries for joins, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardflow.bindings.registry import query
from wardflow.operators import aggs, joins, setops, sorting, windows

c = F.col
TODAY = "1380/05/15"


# ------------------------------------------------------------------ joins

@query(
    "jn_01_inner",
    "SELECT f.siFiles, d.siDoctors, d.MedicalID FROM files f JOIN doctors d ON d.siDoctors = f.siDoctor",
)
def _(t):
    doctors = t["doctors"].select("siDoctors", "MedicalID")
    out = joins.inner(t["files"].select("siFiles", "siDoctor"), doctors, c("siDoctor") == c("siDoctors"))
    return out.select("siFiles", "siDoctors", "MedicalID")


@query(
    "jn_02_left",
    "SELECT d.siDoctors, p.siPrivateTariff, p.ForceAfter FROM doctors d LEFT JOIN private_tariffs p ON p.siDoctors = d.siDoctors",
)
def _(t):
    tariffs = t["private_tariffs"].select("siDoctors", "siPrivateTariff", "ForceAfter")
    return joins.left(t["doctors"].select("siDoctors"), tariffs, "siDoctors")


@query(
    "jn_03_star",
    """SELECT f.siFiles, a.siAlbum, d.MedicalID, h.FullName, b.BranchName, p.siPrivateTariff FROM files f
       JOIN albums a ON a.siFiles = f.siFiles JOIN doctors d ON d.siDoctors = f.siDoctor
       JOIN hospitals h ON h.siHospital = f.siHospital JOIN branches b ON b.siBranch = f.siBranch
       LEFT JOIN private_tariffs p ON p.siDoctors = f.siDoctor""",
)
def _(t):
    files = t["files"].select("siFiles", "siDoctor", "siHospital", "siBranch")
    out = joins.star(
        files,
        [
            (t["albums"].select("siFiles", "siAlbum"), "siFiles", "inner"),
            (t["doctors"].select(c("siDoctors").alias("siDoctor"), "MedicalID"), "siDoctor", "inner"),
            (t["hospitals"].select("siHospital", "FullName"), "siHospital", "inner"),
            (t["branches"], "siBranch", "inner"),
            (t["private_tariffs"].select(c("siDoctors").alias("siDoctor"), "siPrivateTariff"), "siDoctor", "left"),
        ],
    )
    return out.select("siFiles", "siAlbum", "MedicalID", "FullName", "BranchName", "siPrivateTariff")


@query(
    "jn_04_left_with_condition",
    """SELECT p.siCommonTariff, p.TariffName, s.siFiles, coalesce(s.Number, 0) * p.Price AS Fee FROM tariffs p
       LEFT JOIN services s ON s.siCommonTariff = p.siCommonTariff AND s.Type = 1 AND s.Number >= 8""",
)
def _(t):
    services = t["services"].select("siCommonTariff", "siFiles", "Number", c("Type").alias("Kind"))
    tariffs = t["tariffs"].select("siCommonTariff", "TariffName", "Price")
    out = joins.left_join_where(tariffs, services, "siCommonTariff", (c("Kind") == 1) & (c("Number") >= 8))
    return out.select(
        "siCommonTariff", "TariffName", "siFiles", (F.coalesce("Number", F.lit(0)) * c("Price")).alias("Fee")
    )


@query("jn_05_semi", "SELECT siFiles, FileID FROM files WHERE siFiles IN (SELECT siFiles FROM account_log)")
def _(t):
    return joins.semi(t["files"].select("siFiles", "FileID"), t["account_log"].select("siFiles"), "siFiles")


@query(
    "jn_06_anti",
    """SELECT 'left' AS form, siFiles FROM files WHERE NOT EXISTS (SELECT 1 FROM albums a WHERE a.siFiles = files.siFiles)
       UNION ALL SELECT 'none', siFiles FROM files WHERE siFiles + 7000000 NOT IN (SELECT fCode FROM lab_patients)
       UNION ALL SELECT 'rest', siFiles FROM files WHERE siFiles + 7000000 NOT IN (SELECT fCode FROM lab_patients WHERE fCode IS NOT NULL)""",
)
def _(t):
    files = t["files"].select("siFiles", (c("siFiles") + 7000000).alias("fCode"))
    codes = t["lab_patients"].select("fCode")
    parts = {
        "left": joins.anti(files, t["albums"].select("siFiles"), "siFiles"),
        "none": joins.not_in(files, codes, "fCode"),
        "rest": joins.not_in(files, codes.where(c("fCode").isNotNull()), "fCode"),
    }
    out = [df.select(F.lit(form).alias("form"), "siFiles") for form, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query(
    "jn_07_split_rows",
    """SELECT siDoctors, trim(i) AS Item FROM (SELECT siDoctors, unnest(string_split(Filter, ',')) AS i FROM doctors) AS q
       WHERE trim(i) <> ''""",
)
def _(t):
    return joins.split_rows(t["doctors"].select("siDoctors", "Filter"), "Filter").select("siDoctors", "Item")


@query(
    "jn_08_calendar_roles",
    """SELECT w.siWait, a.Shamsi AS SendDateS, b.Shamsi AS ManualDateS, m.Miladi AS MailDay FROM waits w
       LEFT JOIN calendar a ON a.MiladiDate = CAST(w.SendDate AS DATE)
       LEFT JOIN calendar b ON b.MiladiDate = CAST(w.ManualTelegDate AS DATE)
       LEFT JOIN calendar m ON m.Shamsi = w.EMailDate""",
)
def _(t):
    days = t["calendar"]
    out = t["waits"].select("siWait", "SendDate", "ManualTelegDate", "EMailDate")
    out = joins.with_calendar(out, days, "SendDate", "a")
    out = joins.with_calendar(out, days, "ManualTelegDate", "b")
    out = joins.with_calendar(out, days, "EMailDate", "m", on="Shamsi")
    return out.select(
        "siWait", c("a_Shamsi").alias("SendDateS"), c("b_Shamsi").alias("ManualDateS"), c("m_Miladi").alias("MailDay")
    )


@query(
    "jn_09_linked_pairs",
    """SELECT l.FileID, l.fCode, f.DoctorName, a.fMobile FROM lab_patients l
       JOIN files f ON f.FileID = l.FileID JOIN lab_acceptances a ON a.fCode = l.fCode""",
)
def _(t):
    files = t["files"].select("FileID", "DoctorName")
    acceptances = t["lab_acceptances"].select("fCode", "fMobile")
    return joins.join_by_link(files, t["lab_patients"].select("FileID", "fCode"), acceptances, "FileID", "fCode")


@query(
    "jn_10_entity_match",
    """SELECT b.fCode AS fCodeDoctor, a.siDoctors, a.MedicalID FROM doctors a JOIN lab_doctors b
       ON replace(replace(replace(concat(a.LName, '-', a.FName, a.MedicalID), ' ', ''), 'ک', 'ك'), 'ی', 'ي')
        = replace(replace(replace(concat(b.fLastName, '-', b.fFirstName, b.fMedicalNo), ' ', ''), 'ک', 'ك'), 'ی', 'ي')
       WHERE a.MedicalID IS NOT NULL""",
)
def _(t):
    own = t["doctors"].where(c("MedicalID").isNotNull()).select("siDoctors", "LName", "FName", "MedicalID")
    lab = t["lab_doctors"].select(c("fCode").alias("fCodeDoctor"), "fLastName", "fFirstName", "fMedicalNo")
    dash = F.lit("-")
    matched = joins.match_entities(
        own,
        lab,
        [c("LName"), dash, c("FName"), c("MedicalID")],
        [c("fLastName"), dash, c("fFirstName"), c("fMedicalNo")],
    )
    return matched.select("fCodeDoctor", "siDoctors", "MedicalID")


@query(
    "jn_11_insert_filter",
    "SELECT fCode, fMobile FROM lab_acceptances WHERE fCode NOT IN (SELECT coalesce(fCode, 0) FROM lab_patients)",
)
def _(t):
    return joins.insert_filter(t["lab_acceptances"].select("fCode", "fMobile"), t["lab_patients"], "fCode")


@query(
    "jn_12_orphans",
    """SELECT 'album of procedure' AS relation, count(*) AS orphans FROM album_procedures WHERE siAlbum NOT IN (SELECT siAlbum FROM albums)
       UNION ALL SELECT 'visit of service', count(*) FROM services WHERE siFiles NOT IN (SELECT siFiles FROM files)
       UNION ALL SELECT 'acceptance of patient', count(*) FROM lab_patients WHERE fCode IS NOT NULL AND fCode NOT IN (SELECT fCode FROM lab_acceptances)""",
)
def _(t):
    return joins.orphans(
        {
            "album of procedure": (t["album_procedures"], t["albums"], "siAlbum", "siAlbum"),
            "visit of service": (t["services"], t["files"], "siFiles", "siFiles"),
            "acceptance of patient": (t["lab_patients"], t["lab_acceptances"], "fCode", "fCode"),
        }
    )


# ----------------------------------------------------------- aggregations

@query("ag_01_row_count", 'SELECT count(*) AS "Number" FROM services')
def _(t):
    return aggs.row_count(t["services"])


@query(
    "ag_02_count_where",
    "SELECT count(*) AS RecordCount FROM waits WHERE Status = 16 AND (coalesce(Edited, 0) = 0 OR coalesce(Printed, 0) = 0)",
)
def _(t):
    open_rows = (F.coalesce("Edited", F.lit(0)) == 0) | (F.coalesce("Printed", F.lit(0)) == 0)
    return aggs.count_where(t["waits"], (c("Status") == 16) & open_rows)


@query(
    "ag_03_next_key",
    """SELECT 'all' AS branch, coalesce(max(FileID), 1000) + 1 AS NewID FROM files
       UNION ALL SELECT 'b' || b.siBranch, coalesce(max(f.FileID), b.siBranch * 100000000 + 98 * 1000000) + 1
       FROM branches b LEFT JOIN files f ON f.siBranch = b.siBranch AND f.Is3D = 1 AND f.siHospital < 3 GROUP BY b.siBranch""",
)
def _(t):
    files = t["files"].select("FileID", "siBranch", "Is3D", "siHospital")
    total = aggs.next_key(files, "FileID").select(F.lit("all").alias("branch"), "NewID")
    some = files.where((c("Is3D") == 1) & (c("siHospital") < 3))
    each = aggs.next_key(some, "FileID", t["branches"], "siBranch", 98)
    return total.union(each.select(F.concat(F.lit("b"), c("siBranch").cast("string")), "NewID"))


@query(
    "ag_04_sum_by",
    """SELECT siFiles, Type, CAST(sum(Number) AS BIGINT) AS TotalNumber, CAST(sum(UsedPrice) AS BIGINT) AS TotalPrice
       FROM services GROUP BY siFiles, Type""",
)
def _(t):
    return aggs.sum_by(t["services"], ["siFiles", "Type"], {"TotalNumber": c("Number"), "TotalPrice": c("UsedPrice")})


@query(
    "ag_05_has_all",
    """SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
       GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3""",
)
def _(t):
    return aggs.has_all(t["orders"], "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query(
    "ag_06_having",
    """SELECT siDoctor, CAST(sum(coalesce(Remain, 0)) AS BIGINT) AS RemainPay FROM albums a
       JOIN files f ON f.siFiles = a.siFiles GROUP BY siDoctor HAVING sum(coalesce(Remain, 0)) > 0""",
)
def _(t):
    rows = t["albums"].select("siFiles", "Remain").join(t["files"].select("siFiles", "siDoctor"), "siFiles")
    return aggs.having_sum(rows, "siDoctor", "Remain", True)


@query("ag_07_distinct", "SELECT DISTINCT Title, TypeNumber, Path FROM visit_documents")
def _(t):
    return aggs.distinct_rows(t["visit_documents"], ["Title", "TypeNumber", "Path"])


@query(
    "ag_08_name_list",
    """SELECT f.siFiles, l.List FROM files f LEFT JOIN (
         SELECT siAlbum, string_agg(DISTINCT trim(SurgeryName), ', ' ORDER BY trim(SurgeryName)) AS List
         FROM album_procedures JOIN procedures ON procedures.siSurgery = album_procedures.siSurgery GROUP BY siAlbum) AS l ON l.siAlbum = f.siFiles""",
)
def _(t):
    names = t["procedures"].select("siSurgery", F.trim("SurgeryName").alias("SurgeryName"))
    pairs = t["album_procedures"].join(names, "siSurgery")
    lists = aggs.name_list(pairs, "siAlbum", "SurgeryName").withColumnRenamed("siAlbum", "siFiles")
    return t["files"].select("siFiles").join(lists, "siFiles", "left")


@query(
    "ag_09_concat_ordered",
    """WITH r AS (SELECT n_regionkey, left(n_name || '/' || s_name, 9) AS v, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
       SELECT n_regionkey, string_agg(v, ' -- ' ORDER BY s_suppkey, v) AS List FROM r GROUP BY n_regionkey""",
)
def _(t):
    nations = t["nation"].select(c("n_nationkey").alias("s_nationkey"), "n_regionkey", "n_name")
    rows = t["supplier"].join(nations, "s_nationkey")
    value = F.concat(c("n_name"), F.lit("/"), c("s_name"))
    rows = rows.select("n_regionkey", "s_suppkey", value.alias("v"))
    return aggs.concat_ordered(rows, "n_regionkey", c("v"), ["s_suppkey"], " -- ", width=9)


STARTS = ["1380/05/01", "1380/04/01", "1380/02/01", "1379/11/01", "1378/01/01"]


@query(
    "ag_10_period_pivot",
    """SELECT siDoctor, siHospital,
         CAST(sum(CASE WHEN ReferDate >= '1380/05/01' AND ReferDate <= '1380/05/15' THEN 1 END) AS BIGINT) AS Zone1,
         CAST(sum(CASE WHEN ReferDate >= '1380/04/01' AND ReferDate < '1380/05/01' THEN 1 END) AS BIGINT) AS Zone2,
         CAST(sum(CASE WHEN ReferDate >= '1380/02/01' AND ReferDate < '1380/04/01' THEN 1 END) AS BIGINT) AS Zone3,
         CAST(sum(CASE WHEN ReferDate >= '1379/11/01' AND ReferDate < '1380/02/01' THEN 1 END) AS BIGINT) AS Zone4,
         CAST(sum(CASE WHEN ReferDate >= '1378/01/01' AND ReferDate < '1379/11/01' THEN 1 END) AS BIGINT) AS Zone5
       FROM files GROUP BY siDoctor, siHospital""",
)
def _(t):
    return aggs.period_pivot(t["files"], ["siDoctor", "siHospital"], "ReferDate", TODAY, STARTS)


@query(
    "ag_11_conditional_sums",
    """SELECT siFiles, CAST(sum(CASE WHEN Type = 0 THEN Number * UsedPrice END) AS BIGINT) AS Normal,
         CAST(sum(CASE WHEN Type = 1 THEN Number * UsedPrice END) AS BIGINT) AS Extra,
         CAST(sum(CASE WHEN Number > 5 THEN Number * UsedPrice END) AS BIGINT) AS Large FROM services GROUP BY siFiles""",
)
def _(t):
    conditions = {"Normal": c("Type") == 0, "Extra": c("Type") == 1, "Large": c("Number") > 5}
    return aggs.conditional_sums(t["services"], c("Number") * c("UsedPrice"), conditions, ["siFiles"])


@query(
    "ag_12_rollup_pivot",
    """SELECT siHospital, CAST(sum(CASE WHEN ReferDate >= '1380/05/01' AND ReferDate <= '1380/05/15' THEN 1 END) AS BIGINT) AS Zone1,
         CAST(sum(CASE WHEN ReferDate >= '1378/01/01' AND ReferDate < '1380/05/01' THEN 1 END) AS BIGINT) AS Zone2
       FROM files WHERE ReferDate BETWEEN '1378/01/01' AND '1380/05/15' GROUP BY siHospital""",
)
def _(t):
    keys = ["siHospital", "siBranch"]
    pivot = aggs.period_pivot(t["files"], keys, "ReferDate", TODAY, [STARTS[0], STARTS[-1]], keep_outside=False)
    return aggs.rollup_pivot(pivot, ["siHospital"], ["Zone1", "Zone2"])


@query(
    "ag_13_code_pivot",
    """SELECT l_orderkey, coalesce(min(CASE WHEN l_linenumber = 1 THEN floor(l_quantity)::BIGINT END), 0) AS BEF,
         coalesce(min(CASE WHEN l_linenumber = 3 THEN floor(l_quantity)::BIGINT END), 0) AS AFT,
         coalesce(min(CASE WHEN l_linenumber = 7 THEN floor(l_quantity)::BIGINT END), 0) AS EXT FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", F.floor("l_quantity").alias("q"))
    return aggs.code_pivot(rows, "l_orderkey", "l_linenumber", "q", {1: "BEF", 3: "AFT", 7: "EXT"})


# ---------------------------------------------------------------- windows

@query(
    "wn_01_numbered",
    """SELECT siDoctors, row_number() OVER (ORDER BY LName ASC NULLS FIRST, FName ASC NULLS FIRST, siDoctors) AS RW FROM doctors""",
)
def _(t):
    rows = t["doctors"].select("siDoctors", "LName", "FName")
    return windows.numbered(rows, ["LName", "FName", "siDoctors"]).select("siDoctors", "RW")


@query("wn_02_line_no", "SELECT siAccount, PayableFee, row_number() OVER (ORDER BY siAccount) AS RW FROM accounts")
def _(t):
    return windows.line_no(t["accounts"].select("siAccount", "PayableFee"), ["siAccount"])


@query(
    "wn_03_latest_and_rest",
    """SELECT siPermission, CASE WHEN row_number() OVER (PARTITION BY LoginName, siFile ORDER BY ActionTime DESC, siPermission DESC) = 1
         THEN 'kept' ELSE 'logged' END AS side FROM access_log""",
)
def _(t):
    kept, logged = windows.latest_and_rest(t["access_log"], ["LoginName", "siFile"], "ActionTime", "siPermission")
    return kept.select("siPermission", F.lit("kept").alias("side")).union(
        logged.select("siPermission", F.lit("logged"))
    )


@query(
    "wn_04_period_starts",
    """WITH last AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders),
         m AS (SELECT 'M' AS Mode, Shamsi, row_number() OVER (ORDER BY ID DESC) AS RowNO FROM calendar, last WHERE MiladiDate <= d AND DayInMonth = 1),
         w AS (SELECT 'W', Shamsi, row_number() OVER (ORDER BY ID DESC) AS RowNO FROM calendar, last WHERE MiladiDate <= d AND DayInWeek = 1)
       SELECT Mode, Shamsi, CAST(RowNO AS INT) AS RowNO FROM m WHERE RowNO <= 24 UNION ALL SELECT 'W', Shamsi, CAST(RowNO AS INT) FROM w WHERE RowNO <= 24""",
)
def _(t):
    from wardflow.functions.dates import to_shamsi

    today = t["orders"].agg(to_shamsi(F.max("o_orderdate")).alias("d")).first()["d"]
    parts = [
        windows.period_starts(t["calendar"], today, mode).select(F.lit(mode).alias("Mode"), "Shamsi", "RowNO")
        for mode in ("M", "W")
    ]
    return parts[0].union(parts[1])


@query(
    "wn_05_first_last",
    """SELECT siFiles, first_value(siFiles) OVER w AS FsiFiles, last_value(siFiles) OVER w AS LsiFiles FROM files WHERE siBranch IN (1, 2)
       WINDOW w AS (ORDER BY ReferDate, siFiles ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def _(t):
    rows = t["files"].where(c("siBranch").isin(1, 2)).select("siFiles", "ReferDate")
    return windows.first_last(rows, ["ReferDate", "siFiles"], "siFiles", ("FsiFiles", "LsiFiles")).drop("ReferDate")


@query(
    "wn_06_navigate",
    """WITH n AS (SELECT siFiles, row_number() OVER (ORDER BY siFiles) AS r, count(*) OVER () AS total FROM files WHERE siBranch IN (1, 2)),
         m AS (SELECT event_id, user_id AS cur, CASE event_type WHEN 'view' THEN 'F' WHEN 'click' THEN 'P' WHEN 'signup' THEN 'C' WHEN 'purchase' THEN 'N' ELSE 'L' END AS direction FROM events),
         k AS (SELECT m.*, (SELECT count(*) FROM n WHERE siFiles < cur) AS below, (SELECT count(*) FROM n WHERE siFiles <= cur) AS upto, (SELECT max(total) FROM n) AS total FROM m),
         p AS (SELECT *, CASE direction WHEN 'F' THEN 1 WHEN 'L' THEN total WHEN 'P' THEN greatest(below, 1) WHEN 'N' THEN least(upto + 1, total) WHEN 'C' THEN CASE WHEN upto > 0 THEN upto ELSE total END END AS r2 FROM k)
       SELECT event_id, direction, n.siFiles AS target, r2 AS RowNO, CASE WHEN r2 = 1 THEN 'F' ELSE '' END || CASE WHEN r2 = p.total THEN 'L' ELSE '' END AS RowStatus
       FROM p JOIN n ON n.r = p.r2""",
)
def _(t):
    ways = {"view": "F", "click": "P", "signup": "C", "purchase": "N"}
    way = F.coalesce(*[F.when(c("event_type") == k, v) for k, v in ways.items()], F.lit("L"))
    moves = t["events"].select("event_id", c("user_id").alias("current"), way.alias("direction"))
    rows = t["files"].where(c("siBranch").isin(1, 2)).select("siFiles")
    return windows.navigate(rows, "siFiles", moves).drop("current")


@query(
    "wn_07_lead_and_group",
    """SELECT siCommonTariff, Type, TariffName,
         lead(TariffName) OVER (PARTITION BY Type ORDER BY TariffName, siCommonTariff) AS Edge,
         dense_rank() OVER (ORDER BY TariffName) - 1 AS GrpNo FROM tariffs""",
)
def _(t):
    rows = t["tariffs"].select("siCommonTariff", "Type", "TariffName")
    edged = windows.lead_in(rows, ["Type"], ["TariffName", "siCommonTariff"], "TariffName")
    return windows.group_no(edged, ["TariffName"])


@query("wn_08_renumber", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS SeqNO FROM part")
def _(t):
    rows = t["part"].select("p_partkey", "p_size")
    return windows.renumber(rows, [F.desc("p_size"), "p_partkey"], "SeqNO").select("p_partkey", "SeqNO")


# ------------------------------------------------------- sorting, limits

@query("sl_01_sorted", "SELECT siHospital, FullName, SeqNO FROM hospitals ORDER BY SeqNO, FullName")
def _(t):
    return sorting.sorted_by(t["hospitals"].select("siHospital", "FullName", "SeqNO"), ["SeqNO", "FullName"])


@query("sl_02_top_n", "SELECT siFiles, ReferDate FROM files ORDER BY ReferDate DESC, siFiles DESC LIMIT 50")
def _(t):
    return sorting.top_n(t["files"].select("siFiles", "ReferDate"), ["-ReferDate", "-siFiles"], 50)


@query(
    "sl_03_queue_head",
    """SELECT FileID, TryCount FROM lab_patients WHERE Status = 3
       ORDER BY coalesce(TryCount, 0), SendDate ASC NULLS FIRST, FileID LIMIT 1""",
)
def _(t):
    rows = t["lab_patients"].where(c("Status") == 3)
    tries = F.coalesce("TryCount", F.lit(0)).asc()
    return sorting.queue_head(rows, [tries, "SendDate", "FileID"]).select("FileID", "TryCount")


@query(
    "sl_04_priority",
    """SELECT siWait, TelegramStatus FROM waits
       ORDER BY CASE WHEN coalesce(TelegramStatus, 0) >= 3 THEN NULL ELSE coalesce(TelegramStatus, 0) END NULLS FIRST, WaitDate DESC, siWait""",
)
def _(t):
    ordered = sorting.priority_sort(t["waits"], sorting.failed_first(c("TelegramStatus")), ["-WaitDate", "siWait"])
    return ordered.select("siWait", "TelegramStatus")


@query(
    "sl_05_mode_sort",
    """SELECT * FROM (SELECT 'mail' AS mode, siWait FROM waits ORDER BY SentEMail NULLS FIRST, WaitDate DESC, siWait) AS a
       UNION ALL SELECT * FROM (SELECT 'step' AS mode, siWait FROM waits ORDER BY Status, WaitDate DESC, siWait) AS b""",
)
def _(t):
    key_sets = {"mail": ["SentEMail", "-WaitDate", "siWait"], "step": ["Status", "-WaitDate", "siWait"]}
    parts = [
        sorting.mode_sort(t["waits"], mode, key_sets).select(F.lit(mode).alias("mode"), "siWait")
        for mode in key_sets
    ]
    return parts[0].union(parts[1])


@query("sl_06_unordered", "SELECT siSurgery, SurgeryName, Sequent FROM procedures WHERE \"Show\" = '1'")
def _(t):
    return sorting.unordered(t["procedures"].where(c("Show") == "1").select("siSurgery", "SurgeryName", "Sequent"))


# ---------------------------------------------------------- set operations

@query(
    "so_01_union_distinct",
    """SELECT siFiles, siCommonTariff, Number FROM services WHERE siFiles IN (SELECT siFiles FROM service_log)
       UNION SELECT siFiles, siCommonTariff, Number FROM service_log""",
)
def _(t):
    cols = ["siFiles", "siCommonTariff", "Number"]
    log = t["service_log"].select(*cols)
    return setops.union_distinct(joins.semi(t["services"].select(*cols), log.select("siFiles"), "siFiles"), log)


@query(
    "so_02_union_levels",
    """SELECT 0 AS CatLevel, siFiles, A AS TopCat, NULL AS SubCat1 FROM receipts
       UNION ALL SELECT 1, siFiles, NULL, B FROM receipts UNION ALL SELECT 2, siFiles, NULL, C FROM receipts""",
)
def _(t):
    rows = t["receipts"]
    return setops.union_levels(
        {
            0: rows.select("siFiles", c("A").alias("TopCat")),
            1: rows.select("siFiles", c("B").alias("SubCat1")),
            2: rows.select("siFiles", c("C").alias("SubCat1")),
        }
    )


@query(
    "so_03_totals_row",
    """SELECT siAccount, PayableFee, NULL AS SumPayableFee FROM accounts
       UNION ALL SELECT NULL, NULL, CAST(sum(PayableFee) AS BIGINT) FROM accounts""",
)
def _(t):
    detail = t["accounts"].select("siAccount", "PayableFee")
    return setops.with_totals(detail, detail.agg(F.sum("PayableFee").alias("SumPayableFee")))
