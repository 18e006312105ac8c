"""Several tables that change together.

Each change writes its rows to folders of its own, one per table, and then adds one file to a log that
all tables share. That file names all tables of the change: before it is there, readers see none of it,
afterwards all of it. So an order, its items and the stock it takes are current together or not at all, and
a job that dies between two tables leaves no trace that a reader meets.

A change is ``whole`` (the table's new content) or ``more`` (rows added to what there is). Whoever commits
names the commit it started from, and is refused if that is not the newest one any more. A version that is
committed already is not written again, so a repeated job or task adds nothing. The rows of an insert are
what was committed under its version. No clock decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "number long, version string, table string, kind string"
WHOLE, MORE = "whole", "more"


def _log(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all commits that count: of two with one number the one with the smaller version."""
    try:
        rows = spark.read.schema(_LOG).parquet(f"{root}/_commits")
    except AnalysisException:  # nothing is committed yet
        return spark.createDataFrame([], _LOG)
    first = rows.groupBy(F.col("number").alias("_number")).agg(F.min("version").alias("_version"))
    return rows.join(first, (F.col("number") == F.col("_number")) & (F.col("version") == F.col("_version")), "left_semi")


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest commit; 0 if there is none."""
    return _log(spark, root).agg(F.max("number")).first()[0] or 0


def commit(spark: SparkSession, root: str, version: str, base: int, whole: dict[str, DataFrame] | None = None,
           more: dict[str, DataFrame] | None = None) -> int:
    """Make changes of several tables current at once, and return the commit's number. ``version`` names the
    change, and its folder below each table; what a run that died has left there is replaced."""
    log = _log(spark, root)
    if done := log.filter(F.col("version") == version).select("number").first():
        return done["number"]
    current = newest(spark, root)
    if current != base:
        raise ValueError(f"made from commit {base}, but {current} is current")
    changes = [(t, WHOLE, df) for t, df in (whole or {}).items()] + [(t, MORE, df) for t, df in (more or {}).items()]
    if len({t for t, _, _ in changes}) < len(changes):
        raise ValueError("a table is named twice")
    for table, _, df in changes:
        df.write.mode("overwrite").parquet(f"{root}/{table}/{version}")
    entries = spark.createDataFrame([(base + 1, version, t, kind) for t, kind, _ in changes], _LOG)
    entries.coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    if _log(spark, root).filter(F.col("version") == version).isEmpty():
        raise ValueError(f"another writer made commit {base + 1} first")
    return base + 1


def read(spark: SparkSession, root: str, table: str, at: int | None = None) -> DataFrame:
    """A table as of a commit (the newest if none is given)."""
    entries = [r for r in _log(spark, root).filter(F.col("table") == table).orderBy("number").collect() if at is None or r["number"] <= at]
    last = max((i for i, r in enumerate(entries) if r["kind"] == WHOLE), default=0)
    if not entries:
        raise ValueError(f"{table} is not there" + ("" if at is None else f" at commit {at}"))
    return reduce(DataFrame.unionByName, [inserted(spark, root, table, r["version"]) for r in entries[last:]])


def inserted(spark: SparkSession, root: str, table: str, version: str) -> DataFrame:
    """The rows that a change has written to a table."""
    return spark.read.parquet(f"{root}/{table}/{version}")
