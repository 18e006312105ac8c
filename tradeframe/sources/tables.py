"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.sources.schemas import BUSINESS, GIVEN, schema

Db = dict[str, DataFrame]


def read_table(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One given table (``<dir>/<table>.parquet``) under its declared schema."""
    return spark.read.schema(schema(table)).parquet(f"{directory}/{table}.parquet")


def load(spark: SparkSession, directory: str, tables: list[str] | None = None) -> Db:
    """The business tables below a directory, one folder of parquet files each."""
    return {t: spark.read.schema(schema(t)).parquet(f"{directory}/{t}") for t in tables or BUSINESS}


def load_given(spark: SparkSession, directory: str, tables: list[str] | None = None) -> Db:
    return {t: read_table(spark, directory, t) for t in tables or GIVEN}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """A live database table, read in ``partitions`` key ranges at once."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


def run_sql(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A SQL text with bound values (``:name``) over the given frames (``{name}``)."""
    return spark.sql(text, args=args or {}, **frames)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Append rows to a stored table and return them."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of the declared schema, in order and type; missing ones are null."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema(table).fields
    ])


def table_counts(db: Db, tables: list[str]) -> DataFrame:
    """Row count of each table."""
    counts = [db[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
              for t in tables]
    return reduce(DataFrame.unionAll, counts)
