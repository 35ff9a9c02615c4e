"""Tables that are written: a log of runs, and a table of which a run rewrites only some parts.

Every write belongs to a run, a number that grows from run to run and is part of the
path.  A run that is started again, after a failure or by mistake, computes from
what was there before it and replaces its own files only, so rows are never doubled and a
count is never raised twice.  Files are plain Parquet, written by Spark's dynamic
partition overwrite: they appear when the job has succeeded.  One run writes to a table at
a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN, PART, AT = "_run", "_part", "_at"
#: The part of rows without a key.
KEYLESS = -(1 << 62)


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the table in its order and types; columns that are missing are NULL."""
    held = set(df.columns)
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; large ones get several files."""
    rows = df.hint("rebalance", *by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def bucketed(df: DataFrame, name: str, path: str, by: str, buckets: int) -> DataFrame:
    """Store rows in buckets of a key, sorted by it.

    Tables stored with the same key and number of buckets meet without an exchange, and
    distinct keys and distinct rows of one need none either.
    """
    spread = df.repartition(buckets, by)
    spread.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


class RunTable:
    """Rows that are only ever added, one partition for each run."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def with_runs(self, before: int | None = None) -> DataFrame:
        """Rows with the number of their run, of all runs or of those before one."""
        whole = T.StructType([*self.schema.fields, T.StructField(RUN, T.LongType())])
        files, target = _files(self.spark, self.path)
        if not files.exists(target):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).parquet(self.path)
        return rows if before is None else rows.where(F.col(RUN) < before)

    def read(self, before: int | None = None) -> DataFrame:
        return self.with_runs(before).drop(RUN)

    def runs(self) -> list[int]:
        """Numbers of the runs that have rows, from the names of the folders."""
        files, target = _files(self.spark, self.path)
        names = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{RUN}="))

    def add(self, rows: DataFrame, run: int) -> None:
        """Write the rows of a run; what the run had written before is replaced, also by no rows."""
        before = run in self.runs()
        _write(_shaped(rows, self.schema).withColumn(RUN, F.lit(run).cast("long")), self.path, [RUN])
        if before and rows.isEmpty():  # a dynamic overwrite leaves a partition alone that gets no rows
            files, target = _files(self.spark, f"{self.path}/{RUN}={run}")
            files.delete(target, True)


class KeyedTable:
    """A table in parts by ranges of a whole-number key; a run rewrites only the parts it touches.

    A run writes its parts to new folders.  When all are written, the run is entered in
    a small log with the folder and number of rows of each part; readers take each part
    from the last run in the log, so they see all of a run or nothing of it.  A run that
    is started again replaces its entry when it has succeeded.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: str, width: int):
        self.spark, self.path, self.schema, self.by, self.width = spark, path, schema, by, width
        self.rows_path = f"{path}/rows"
        self.log = RunTable(spark, f"{path}/log", T.StructType().add("part", "long").add("at", "string").add("rows", "long"))

    def part_of(self, key: Column) -> Column:
        return F.coalesce(F.floor(key.cast("long") / F.lit(self.width)).cast("long"), F.lit(KEYLESS))

    def live(self, before: int | None = None) -> dict[int, str]:
        """The folder that each part with rows is to be read from: one entry for each part."""
        entries = self.log.with_runs(before)
        last = entries.groupBy("part").agg(F.max(F.struct(RUN, "at", "rows")).alias("last"))
        return {r["part"]: r["last"]["at"] for r in last.collect() if r["last"]["rows"] > 0}

    def read(self, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
        """All rows, or those of some parts; other parts are neither listed nor opened."""
        live = self.live(before)
        wanted = sorted(live if parts is None else set(parts) & set(live))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.rows_path}/{PART}={p}/{AT}={live[p]}" for p in wanted]
        rows = self._reader(self.schema).parquet(*folders)
        if parts is not None:
            rows = rows.where(F.col(PART).isin(wanted))
        return rows.drop(PART, AT)

    def _reader(self, schema: T.StructType):
        places = [T.StructField(PART, T.LongType()), T.StructField(AT, T.StringType())]
        return self.spark.read.schema(T.StructType([*schema.fields, *places])).option("basePath", self.rows_path)

    def create(self, rows: DataFrame, run: int = 0) -> None:
        """Write the whole table."""
        self._enter(rows, None, run)

    def touched(self, keys: DataFrame) -> list[int]:
        """Parts that a change can touch, by its key column: at most as many as the table has, and new ones."""
        found = keys.select(self.part_of(F.col(self.by)).alias("part")).distinct()
        return sorted(r["part"] for r in found.collect())

    def rewrite(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], run: int) -> None:
        """``change(rows, changes)`` for the parts that the keys of the changes lie in.

        The change may alter, add and remove rows, but not move one to a part that no
        key of the changes lies in.
        """
        later = [r for r in self.log.runs() if r > run]
        if later:
            raise ValueError(f"run {run} comes after run {later[-1]}, which was built on what is there now")
        parts = self.touched(changes)
        self._enter(change(self.read(parts, before=run), changes), parts, run)

    def _enter(self, rows: DataFrame, parts: list[int] | None, run: int) -> None:
        at = f"{run}-{uuid.uuid4().hex}"
        part = self.part_of(F.col(self.by))
        if parts is not None:
            lost = F.raise_error(F.concat(F.lit(f"moved out of the touched parts, by {self.by}: "), F.col(self.by).cast("string")))
            part = F.when(part.isin(parts), part).otherwise(lost.cast("long"))
        _write(_shaped(rows, self.schema).withColumn(PART, part).withColumn(AT, F.lit(at)), self.rows_path, [PART, AT])
        # no column is asked for, so the counts come from the ends of the files
        found = self._reader(T.StructType()).parquet(self.rows_path).where(F.col(AT) == at)
        written = {r[PART]: r["count"] for r in found.groupBy(PART).count().collect()}
        entries = [(p, at, written.get(p, 0)) for p in (sorted(written) if parts is None else parts)]
        self.log.add(self.spark.createDataFrame(entries, self.log.schema), run)

    def drop_superseded(self) -> int:
        """Remove the folders that no reader takes any more, and give their number."""
        live = self.live()
        files, every = _files(self.spark, f"{self.rows_path}/{PART}=*/{AT}=*")
        removed = 0
        for status in files.globStatus(every) or []:
            part, at = (x.getName().split("=", 1)[1] for x in (status.getPath().getParent(), status.getPath()))
            if live.get(int(part)) != at:
                removed += bool(files.delete(status.getPath(), True))
        return removed
