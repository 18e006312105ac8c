"""Replace a stored table: plain parquet has no MERGE, so a change writes a new
snapshot beside the old one and then moves a pointer. Readers of the old snapshot
are not disturbed, and a job that dies half-way leaves the pointer alone. The pointer is a
log of numbered versions: who writes names the version it started from, and is refused if
that is not the newest one any more. No clock decides."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.sources.schemas import schema


_LOG = "version string, number long"


def _log(spark: SparkSession, root: str, table: str) -> DataFrame:
    path = f"{root}/{table}/_current_versions"
    try:
        return spark.read.schema(_LOG).parquet(path)
    except AnalysisException:  # the first version has no log yet
        return spark.createDataFrame([], _LOG)


def _newest(spark: SparkSession, root: str, table: str) -> tuple[str | None, int]:
    """The newest version and its number; of two with one number the smaller name."""
    row = _log(spark, root, table).orderBy(F.desc("number"), "version").first()
    return (row["version"], row["number"]) if row else (None, 0)


def write_snapshot(df: DataFrame, root: str, table: str, version: str, base: str | None = None) -> str:
    """Write ``<root>/<table>/<version>`` and make it current. ``base`` is the version it was
    made from (none for the first); if another one is current the write is refused. A version
    that exists already is an error: snapshots are never overwritten."""
    spark = df.sparkSession
    newest, number = _newest(spark, root, table)
    if newest != base:
        raise ValueError(f"{table}: made from version {base}, but {newest} is current")
    path = f"{root}/{table}/{version}"
    df.write.mode("error").parquet(path)
    pointer = spark.createDataFrame([(version, number + 1)], _LOG)
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{table}/_current_versions")
    if _newest(spark, root, table)[0] != version:
        raise ValueError(f"{table}: another writer was first")
    return path


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    return _newest(spark, root, table)[0]


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    version = current_version(spark, root, table)
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}/{version}")
