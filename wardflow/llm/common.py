"""Helpers shared by the operators: stored intermediate tables, documents, sizing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.session import shared_folder

#: What separates words: space and the ASCII control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths stored so far, innermost scratch last.
_STORED: list[list[str]] = [[]]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The tables stored inside, but for those that outlive it, as a list to be removed."""
    paths: list[str] = []
    _STORED.append(paths)
    try:
        yield paths
    finally:
        # by identity: an outer list that is as empty is equal
        _STORED[:] = [other for other in _STORED if other is not paths]


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of an execution when it ends, not when its plan is collected as garbage."""
    was = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, was)


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read and not a rerun of
    what came before.  The files are removed when the application ends, or earlier
    by whoever opened the scratch around it; ``outlives`` leaves them to the next outer one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    jvm = spark.sparkContext._jvm
    jvm.System.gc()  # Spark then deletes the shuffle files of finished steps, which the heap alone would not ask for
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    _STORED[-2 if outlives and len(_STORED) > 1 else -1].append(path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


SIEVE_WORDS = 1 << 14


def sieve(wanted: DataFrame, column: str) -> Column:
    """A bitmap over hashes in ``column``, of fixed size whatever the rows, as a scalar subquery.

    Rows that do not pass it need not be shuffled to a join with ``wanted``; where
    many are wanted it fills up, and then lets all pass.
    """
    words = wanted.groupBy(F.floor(F.pmod(F.col(column), F.lit(SIEVE_WORDS * 64)) / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) AS int))")).alias("m")
    )
    every = wanted.sparkSession.range(SIEVE_WORDS).select(F.col("id").cast("int").alias("w"))
    filled = F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m"))))
    dense = every.join(words, "w", "left").agg(F.transform(filled, lambda x: x["m"]).alias("bits"))
    return stored(dense, "sieve").scalar()


def passes(bits: Column, column: str) -> Column:
    """Whether a hash in ``column`` may be one of those that ``sieve`` was made from."""
    word = F.get(bits, F.floor(F.pmod(F.col(column), F.lit(SIEVE_WORDS * 64)) / 64).cast("int"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) AS int))")) != 0


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with neutral names for all columns but the needed ones, and the way back.

    So no name that an operator uses inside can clash with a column of the user, also not
    in another case.  The way back gives the columns in their order, the one named ``last``
    after them; ``added`` ones come at the end and replace those of the same name.
    """
    plain: list[str] = []
    for i, name in enumerate(docs.columns):
        plain.append(name if name in needed and name not in plain else f"other_{i}")
    same = plain == docs.columns

    def back(rows: DataFrame, *added: str, last: str | None = None) -> DataFrame:
        kept = [(p, F.col(p).alias(n)) for p, n in zip(plain, docs.columns) if n not in added]
        return rows.select(*[c for p, c in kept if p != last], *[c for p, c in kept if p == last], *added)

    return docs if same else docs.toDF(*plain), back


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` rows."""
    return max(least, -(-rows // each))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
