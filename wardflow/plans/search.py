"""Visit searches and navigation (CQ-17 .. CQ-20, CQ-24)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.nulls import SEND_STATUS, decode
from wardflow.functions.text import mask_match
from wardflow.operators.aggs import having_sum
from wardflow.operators.filters import fold_conditions, in_list, membership, multi_text_search, search
from wardflow.operators.joins import semi, split_rows
from wardflow.operators.sorting import top_n
from wardflow.operators.windows import navigate

Tables = Mapping[str, DataFrame]
c = F.col

# Labels of the result list and the document type of check sheets.
PAID_LABEL = "پرداخت شد"
PHASES = {0: "Bef"}
CHECK_SHEET = 9

RESULT_COLUMNS = [
    "siFiles", "FileID", "FName", "LName", "Phone1", "Phone2", "PaidAfter", "BirthYear", "ReferDate", "Subject", "Comment",
    "Address", "Age", "DoctorName", "Job", "RefFileID", "SendType", "Is3D",
]


def result_list(t: Tables, files: DataFrame, limit: int | None, extra: list[str] | None = None) -> DataFrame:
    """Labelled result rows with operation dates, newest referral first."""
    albums = t["albums"].select("siFiles", "siAlbum", "SurgDate")
    all_name = F.trim(F.concat(c("LName"), F.lit(" "), F.coalesce("FName", F.lit(""))))
    rows = files.join(albums, "siFiles", "left").select(
        *(extra or []), *RESULT_COLUMNS, "siAlbum", "SurgDate",
        decode(c("SendType"), {0: SEND_STATUS[0]}, SEND_STATUS[1]).alias("SendTypeName"),
        decode(c("Bef_Aft"), PHASES, "Aft").alias("BEF_AFT_Title"),
        all_name.alias("AllName"),
        F.when((c("PaidAfter") != 0) | c("PaidAfter").isNull(), PAID_LABEL).alias("PaidAfterStatus"),
        F.when((c("Is3D") != 0) | c("Is3D").isNull(), "3D").alias("Is3DTitle"),
    )
    return top_n(rows, ["-ReferDate", "-siFiles", "siAlbum"], limit)


def search_visits(
    t: Tables,
    *,
    file_id=None, first=None, last=None, paid_after=None, birth_from=None, birth_to=None, phone=None, refer_from=None,
    refer_to=None, subject=None, comment=None, address=None, album: str = "all", age_from=None, age_to=None, send_type=None,
    doctor_name=None, job=None, doctor=None, hospital=None, branches=None, limit: int | None = None,
) -> DataFrame:
    """Visit search on optional criteria (CQ-17).

    Criteria that are not given leave no trace in the plan.  ``phone`` is a LIKE
    pattern on phone or place; ``album`` is ``in``, ``out`` or ``all``.
    """
    criteria = [
        ("BirthYear", "ge", birth_from), ("BirthYear", "le", birth_to), ("Age", "ge", age_from), ("Age", "le", age_to),
        ("siDoctor", "eq", doctor), ("siHospital", "eq", hospital), ("FileID", "eq", file_id),
        ("PaidAfter", "eq", paid_after if paid_after in (0, 1) else None),
        ("SendType", "eq", send_type if send_type in (0, 1) else None),
        ("FName", "contains", first), ("LName", "contains", last), ("Subject", "contains", subject),
        ("Comment", "contains", comment), ("Address", "contains", address), ("DoctorName", "contains", doctor_name),
        ("Job", "contains", job), ("ReferDate", "ge", refer_from), ("ReferDate", "le", refer_to),
    ]
    files = search(t["files"].where(in_list(c("siBranch"), branches)), criteria)
    if phone is not None:
        files = files.where(c("Phone1").like(phone) | c("RefPlace").like(phone))
    return result_list(t, membership(files, t["albums"], "siFiles", album), limit)


def search_by_letter(t: Tables, letter: str | None, branches=None, limit: int | None = None) -> DataFrame:
    """Visits whose last name starts with a letter (CQ-17)."""
    files = search(t["files"].where(in_list(c("siBranch"), branches)), [("LName", "starts", letter)])
    return result_list(t, files, limit)


def search_patients(t: Tables, **parts: str | None) -> DataFrame:
    """Visits by parts of number, names, phone, age, date and subject (CQ-17)."""
    files = search(t["files"], [(name, "contains", part) for name, part in parts.items()])
    doctors = t["doctors"].select(c("siDoctors").alias("siDoctor"), "MedicalID")
    return files.join(doctors, "siDoctor").select(
        "siFiles", "FileID", "FName", "LName", "Phone1", "Phone2", "Age", "ReferDate", "DoctorName", "Subject", "MedicalID"
    ).orderBy(F.desc("ReferDate"), "siFiles")


def search_by_album(
    t: Tables, *, name=None, date_from=None, date_to=None, surgery_from=None, surgery_to=None, comment=None,
    procedures=None, insurance=None, only_remaining: bool = False, branches=None, limit: int | None = None,
) -> DataFrame:
    """Visits by album and procedure, with the outstanding sum (CQ-18)."""
    criteria = [
        ("AlbumName", "contains", name), ("AssurList", "contains", insurance), ("Comment", "contains", comment),
        ("AlbumDate", "ge", date_from), ("AlbumDate", "le", date_to), ("SurgDate", "ge", surgery_from), ("SurgDate", "le", surgery_to),
    ]
    albums = search(t["albums"], criteria)
    if procedures is not None:
        held = t["album_procedures"].where(in_list(c("siSurgery"), procedures))
        albums = semi(albums, held.select("siAlbum"), "siAlbum")
    files = t["files"].where(in_list(c("siBranch"), branches))
    hits = semi(files, albums.select("siFiles"), "siFiles")
    sums = having_sum(t["albums"], "siFiles", "Remain", only_remaining)
    return result_list(t, hits.join(sums, "siFiles"), limit, ["RemainPay"])


def search_by_document(
    t: Tables, *, title=None, comment=None, types=None, branches=None, limit: int | None = None
) -> DataFrame:
    """Visits by their documents (CQ-18)."""
    documents = search(t["visit_documents"], [("Title", "contains", title), ("Comment", "contains", comment)])
    documents = documents.where(in_list(c("TypeNumber"), types))
    albums = semi(t["albums"], documents.select("siAlbum"), "siAlbum")
    files = semi(t["files"].where(in_list(c("siBranch"), branches)), albums.select("siFiles"), "siFiles")
    return result_list(t, files, limit)


def search_by_mask(t: Tables, page: int, mask: str, mode: str) -> DataFrame:
    """Visits whose check sheet fits a positional mask (FLT-10)."""
    fits = mask_match(c("CheckValue"), mask, mode) == 1
    sheets = t["visit_documents"].where((c("TypeNumber") == CHECK_SHEET) & (c("siPage") == page) & fits)
    albums = semi(t["albums"], sheets.select("siAlbum"), "siAlbum")
    files = semi(t["files"], albums.select("siFiles"), "siFiles")
    return files.select("siFiles", "FileID", "FName", "LName", "ReferDate", "Subject").orderBy(F.desc("FileID"))


def search_mixed(
    t: Tables, *, file_from=None, file_to=None, paid_after: int | None = 2, refer_from=None, refer_to=None, procedures: str | None = None,
    surgery_from=None, surgery_to=None, title=None, types=None, word1=None, word2=None, all_procedures: bool = True,
    both_words: bool = True, branches=None, limit: int | None = None,
) -> DataFrame:
    """Criteria set and comment set, intersected (CQ-19).

    ``procedures`` lists codes; with ``all_procedures`` a visit must hold each of
    them, counted over the albums and documents that meet the other criteria.
    Child tables are reduced to keys before they are joined.
    """
    files = t["files"].where(in_list(c("siBranch"), branches))
    wanted = search(
        files,
        [
            ("FileID", "ge", file_from), ("FileID", "le", file_to), ("PaidAfter", "eq", paid_after, (None, 2)),
            ("ReferDate", "ge", refer_from), ("ReferDate", "le", refer_to),
        ],
    )
    conditions = [("SurgDate", "ge", surgery_from), ("SurgDate", "le", surgery_to)]
    albums = search(t["albums"].select("siFiles", "siAlbum", "SurgDate"), conditions)
    needs_album = any(v is not None for v in (surgery_from, surgery_to, title, types, procedures))
    if title is not None or types is not None:
        documents = search(t["visit_documents"], [("Title", "contains", title)]).where(in_list(c("TypeNumber"), types))
        albums = semi(albums, documents.select("siAlbum"), "siAlbum")
    if procedures is not None:
        codes = sorted({int(p) for p in procedures.split(",") if p.strip()})
        held = t["album_procedures"].where(c("siSurgery").isin(codes))
        pairs = albums.select("siFiles", "siAlbum").join(held, "siAlbum")
        need = len(codes) if all_procedures else 1
        # The set per visit holds at most the listed codes.
        kept = pairs.groupBy("siFiles").agg(F.size(F.collect_set("siSurgery")).alias("_n")).where(c("_n") >= need)
        wanted = semi(wanted, kept.select("siFiles"), "siFiles")
    elif needs_album:
        wanted = semi(wanted, albums.select("siFiles"), "siFiles")
    return result_list(t, _with_words(t, wanted, word1, word2, both_words), limit)


def _with_words(t: Tables, files: DataFrame, word1, word2, both: bool) -> DataFrame:
    """Visits whose comments, or those of an album and its document, hold the words."""
    words = [w for w in (word1, word2) if w is not None]
    if not words:
        return files
    hits = {f"_w{i}": word for i, word in enumerate(words)}

    def marks(col: str) -> dict[str, Column]:
        return {n: F.coalesce(c(col).contains(w), F.lit(False)) for n, w in hits.items()}

    def combine(cols) -> Column:
        return fold_conditions([c(x) for x in cols]) if both else multi_any(cols)

    # Whether a path visit-album-document holds the words depends only on which
    # words each part holds: parts are reduced to these marks and made distinct.
    docs = t["visit_documents"].select("siAlbum", *[v.alias("d" + n) for n, v in marks("Comment").items()]).distinct()
    albums = t["albums"].select("siFiles", "siAlbum", *[v.alias("a" + n) for n, v in marks("Comment").items()])
    paths = albums.join(docs, "siAlbum", "left").select(
        "siFiles",
        *[(c("a" + n) | F.coalesce(c("d" + n), F.lit(False))).alias("p" + n) for n in hits],
    ).distinct()
    own = files.select("siFiles", *[v.alias(n) for n, v in marks("Comment").items()])
    full = own.join(paths, "siFiles", "left").select(
        "siFiles", *[(c(n) | F.coalesce(c("p" + n), F.lit(False))).alias(n) for n in hits]
    )
    return semi(files, full.where(combine(list(hits))).select("siFiles"), "siFiles")


def multi_any(cols) -> Column:
    out = F.lit(False)
    for x in cols:
        out = out | c(x)
    return out


def navigate_visits(t: Tables, moves: DataFrame, branches=None) -> DataFrame:
    """Visit that a move leads to, with its position and end marker (CQ-20)."""
    files = t["files"].where(in_list(c("siBranch"), branches)).select(
        c("siFiles").alias("target"), "FileID", "FName", "LName", "ReferDate", "DoctorName", "siBranch", "Is3D"
    )
    return navigate(files, "target", moves).join(files, "target")


def excluded_procedures(t: Tables) -> DataFrame:
    """Visits that hold a procedure their doctor excluded (CQ-24)."""
    names = t["procedures"].select("siSurgery", F.trim("SurgeryName").alias("SurgeryName"))
    barred = split_rows(t["doctors"].select(c("siDoctors").alias("siDoctor"), "Filter"), "Filter", out="SurgeryName")
    visits = t["files"].select("siFiles", "siDoctor").join(t["albums"].select("siFiles", "siAlbum"), "siFiles")
    held = visits.join(t["album_procedures"], "siAlbum").join(names, "siSurgery")
    return held.join(barred.select("siDoctor", "SurgeryName"), ["siDoctor", "SurgeryName"]).select(
        "siFiles", "siDoctor", "SurgeryName"
    )
