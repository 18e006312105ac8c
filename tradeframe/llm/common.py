"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeframe.session import shared_folder

#: Characters that separate words, as a character class.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def extended(schema: T.StructType, columns: str) -> T.StructType:
    """The schema with more columns, given as ``name type, ...``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder that all executors share and go on from there."""
    path = f"{shared_folder(df.sparkSession, name)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


class Recent(dict):
    """Results of ``compute`` by key. When ``most`` are held they become the older half, which is
    dropped when the newer half is full; so memory is bounded and frequent keys stay."""

    def __init__(self, compute: Callable[[str], object], most: int) -> None:
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str) -> object:
        if (value := self.older.get(key)) is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def in_fold(column: Column, modulus: int, remainder: int) -> Column:
    """True where the CRC-32 of the value as text leaves ``remainder``; false for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def folded(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and all other columns as one, ``rest``, so that no name of theirs meets
    a name an operator adds."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unfolded(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``folded`` was given, some of them replaced."""
    named = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return df.select(*(new.get(c, named.get(c, F.col("rest").getField(c))).alias(c) for c in columns))


def few(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``keys``. A first cut by hash leaves
    about twice as many, so tasks have few rows to hand over however many tasks there are."""
    n = df.count()
    hashed = F.xxhash64(F.lit("few"), *keys)
    some = df.filter(F.pmod(hashed, F.lit(n)) < 2 * most) if n > 2 * most else df
    return some.orderBy(hashed, *keys).limit(most)


def met(rows: DataFrame, sizes: DataFrame, others: DataFrame, key: str, salt: Column, how: str, per_part: int = 1_000_000) -> DataFrame:
    """``rows`` joined to ``others``, a row per ``key`` at most. ``sizes`` has the number ``n`` of rows of each
    key: one with more than ``per_part`` is dealt to as many parts as that takes, each with its own copy
    of the other side. The table of such keys, which is broadcast, has a row for every ``per_part`` rows at most."""
    large = sizes.filter(F.col("n") > per_part).select(key, F.ceil(F.col("n") / per_part).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("_part", F.pmod(salt, parts).cast("int")).drop("_parts")
    copies = others.join(F.broadcast(large), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
