"""Storage-cleanup candidates (CQ-21)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions import dates
from wardflow.functions.nulls import nvl
from wardflow.operators.joins import anti, semi
from wardflow.operators.projections import derive_paths

Tables = Mapping[str, DataFrame]
c = F.col

# Procedures whose files may go, and states of the deletion log.
ERASABLE_PROCEDURES = [31, 32, 33, 34, 35, 42]
FINISHED_STATES = [3, 10]
ALWAYS_LISTED = 8
COMPLETED = 10


def _placed(t: Tables, files: DataFrame) -> DataFrame:
    """Visits with network and local paths, in visit order.

    Rows are sorted while they are narrow; the paths are added behind the sort.
    """
    doctors = t["doctors"].select(c("siDoctors").alias("siDoctor"), "FolderName")
    roots = t["paths"].select(c("NetworkPath").alias("PathFolder"), "LocalPath").distinct()
    rows = files.join(doctors, "siDoctor").join(roots, "PathFolder").orderBy("siFiles")
    for prefix, root in (("NetPath", "PathFolder"), ("WinPath", "LocalPath")):
        rows = derive_paths(rows, c(root), c("FolderName"), c("LName"), c("FName"), c("FileID"), prefix)
    return rows.drop("siDoctor", "FolderName")


FILE_COLUMNS = ["siFiles", "FileID", "FName", "LName", "ReferDate", "DoctorName", "PathFolder", "siDoctor"]


def cleanup_candidates(
    t: Tables, as_of: Column, delete_days: int, states: list[int] | None = None, procedures: list[int] = ERASABLE_PROCEDURES
) -> DataFrame:
    """Visits old enough to erase, by procedure and deletion state.

    Without ``states`` all but the finished ones are listed; with it, those in
    the given states or always listed.
    """
    days = t["calendar"].select(c("Shamsi").alias("ReferDate"), "MiladiDate")
    old = days.where(dates.before_days(c("MiladiDate"), as_of, delete_days))
    held = t["album_procedures"].where(c("siSurgery").isin(procedures)).select("siAlbum")
    albums = semi(t["albums"], held, "siAlbum").select("siFiles")
    files = semi(t["files"].select(*FILE_COLUMNS), albums, "siFiles").join(old, "ReferDate", "left_semi")
    log = t["deletion_log"].select("FileID", "Status")
    state = nvl(c("Status"), 0)
    wanted = ~state.isin(FINISHED_STATES) if states is None else state.isin([*states, ALWAYS_LISTED])
    rows = files.join(log, "FileID", "left").where(wanted)
    return _placed(t, rows)


def cleanup_others(t: Tables, before: str) -> DataFrame:
    """Visits referred before a date whose other files are not erased yet."""
    done = t["deletion_log"].where(c("Status") == COMPLETED).select("FileID")
    files = t["files"].where(c("ReferDate") < before).select(*FILE_COLUMNS)
    return _placed(t, anti(files, done, "FileID"))


def visit_paths(t: Tables, visits: DataFrame) -> DataFrame:
    """Storage paths of the given visits."""
    doctors = t["doctors"].select(
        c("siDoctors").alias("siDoctor"), "FolderName",
        F.concat_ws("", "LName", F.lit(" "), "FName").alias("DoctorFullName"),
    )
    files = semi(t["files"].select(*FILE_COLUMNS, "Subject", "Bef_Aft", "Age"), visits, "siFiles")
    rows = derive_paths(
        files.join(doctors, "siDoctor"), c("PathFolder"), c("FolderName"), c("LName"), c("FName"), c("FileID")
    )
    return rows.drop("siDoctor", "FolderName")
