"""Order sheet (CQ-22)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.nulls import BACK_COLOR, decode, nvl
from wardflow.operators.joins import semi
from wardflow.operators.xmlrows import shred_lists

Tables = Mapping[str, DataFrame]
c = F.col

# Separators, and the category number from which entries come first.
CATEGORY_SEP, LINE_SEP = " -- ", "\r"
LATE_CATEGORY = 207
LISTS = {0: "TopCategory", 1: "SubCategory1", 2: "SubCategory2"}
#: Receipts of one part, about; a part is parsed, titled and grouped in one task.
PART_ROWS = 25_000
ROLES = {"Photo": "PhotoTitle", "Editor": "EditorTitle", "Checker": "Title"}


def order_sheet_rows(t: Tables, visits: DataFrame) -> DataFrame:
    """The three XML lists of each visit as rows with level and title numbers.

    Receipts are spread by visit while they are still one row each: parsing runs
    on all cores, and the later grouping by visit needs no further shuffle of the
    many parsed rows as long as the titles are small enough to be broadcast.  Parsed
    rows take far more room than the compressed receipts, by which Spark would size the
    tasks; so the number of parts follows from the number of receipts.  It is never that of other
    shuffles, with which Spark would take this one out.
    """
    least = int(t["receipts"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least + 1, -(-t["receipts"].count() // PART_ROWS))
    receipts = semi(t["receipts"].select("siFiles", *LISTS.values()), visits, "siFiles")
    rows = shred_lists(receipts.repartition(parts, "siFiles"), LISTS)
    is_top, zero = c("CatLevel") == 0, F.lit("0")
    return rows.select(
        "siFiles",
        "CatLevel",
        F.when(is_top, c("F1")).otherwise(zero).alias("TopCat"),
        F.when(is_top, zero).otherwise(c("F1")).alias("SubCat1"),
        F.when(is_top, zero).otherwise(c("F2")).alias("SubCat2"),
    )


def order_sheet(t: Tables, visits: DataFrame) -> DataFrame:
    """One row per visit with the texts for photographer, editor and checker.

    The lists of a visit come out of one stored row each, so collecting them per
    visit is bounded by the size of that row.
    """
    rows = order_sheet_rows(t, visits)
    titles = t["receipt_titles"]
    top = titles.select(c("siReceipt").alias("TopCat"), c("Title").alias("CatTitle"))
    sub = titles.select(c("siReceipt").alias("SubCat2"), *ROLES.values())
    titled = rows.join(top, "TopCat", "left").join(sub, "SubCat2", "left")
    number = c("SubCat1").try_cast("int")
    place = F.struct(
        F.when(nvl(number, 0) < LATE_CATEGORY, 2).alias("late"),
        number.alias("n1"),
        c("SubCat2").try_cast("int").alias("n2"),
        c("TopCat").try_cast("int").alias("top"),
    )
    entry = F.struct(
        place.alias("place"),
        "CatTitle",
        *[F.concat_ws("", "SubCat1", col).alias(role) for role, col in ROLES.items()],
    )
    lists = titled.groupBy("siFiles").agg(
        *[F.sort_array(F.collect_list(F.when(c("CatLevel") == level, entry))).alias(f"l{level}") for level in LISTS]
    )

    def joined(level: int, field: str, sep: str) -> Column:
        return F.array_join(F.transform(c(f"l{level}"), lambda e: e[field]), sep)

    unknown = F.exists(c("l0"), lambda e: e["CatTitle"].isNull())
    texts = lists.select(
        "siFiles",
        F.when(~unknown, joined(0, "CatTitle", CATEGORY_SEP)).alias("CatTitle"),
        *[joined(level, role, LINE_SEP).alias(f"{role}Sub{level}") for role in ROLES for level in (1, 2)],
    )
    heads = semi(t["receipts"], visits, "siFiles").select(
        "siFiles",
        decode(nvl(c("BackColor"), 4), BACK_COLOR).alias("BackColor"),
        F.when(nvl(c("LifeSize").cast("int"), 0) == 1, " LifeSize").otherwise("").alias("LifeSize"),
        F.when(nvl(c("GridLine").cast("int"), 0) == 1, " GridLine").otherwise("").alias("GridLine"),
        nvl(c("Comment1"), "").alias("Comment1"),
        nvl(c("Comment2"), "").alias("Comment2"),
    )
    # A visit whose lists are all empty has empty texts.
    blank = [x for x in texts.columns if x not in ("siFiles", "CatTitle")]
    sheet = heads.join(texts.withColumn("_listed", F.lit(True)), "siFiles", "left").fillna("", blank)
    cat = F.when(c("_listed"), c("CatTitle")).otherwise("")
    return sheet.withColumn("CatTitle", cat).drop("_listed")
