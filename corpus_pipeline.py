"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last keep the columns
of ``documents``.  When a stage begins and its ``docs`` were read from where the stage
before was written, the tables that the one before had stored on its way are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import bagminhash, linededup, mixing, packing, quality
from wardflow.llm.common import aside, read, remove, scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stages stored, and what the last one returned.
_LEFT: list[str] = []
_MADE: list[DataFrame] = []


def _still_read(docs: DataFrame) -> bool:
    """Whether ``docs`` is not written yet, but still computed from stored tables."""
    files = docs.inputFiles()
    return any(docs is made for made in _MADE) or any(path.split(":", 1)[-1] in file for path in _LEFT for file in files)


def stage(build: Stage) -> Stage:
    """A stage whose stored tables go when the next one begins."""

    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not _still_read(docs):
            remove(spark, _LEFT)
            _LEFT.clear()
        with scratch() as used:
            made = build(spark, docs, sf_dir)
        _LEFT.extend(used)
        _MADE[:] = [made]
        return made

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, with the rest of their text."""
    plain, back = aside(docs, "doc_id", "text", "n_chars")
    found = linededup.deduplicated(plain)
    if "n_chars" in plain.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(found)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.unique_documents(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realised(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, _ = aside(docs, "doc_id", "text")
    return packing.pack(packing.pieces(plain))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Robust estimates, signatures and the genetic search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, build in STAGES:
        with scratch() as written:
            docs = stored(build(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, before)
        before = written
    return docs
