"""A pipeline over ``documents``: drop toxic texts, near copies, repeated passages and benchmark
leaks, then encode what is left.

Every stage reads all rows that the one before it kept, from Parquet. All stages but the last
return the columns of their input; the last returns one row of digests per document.

Rows: each stage treats nulls, empty texts and repeated rows as its operator says. A document
without text stays (the first of them: texts without words are copies of each other).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.llm import bpe, decontaminate, simhash, substring_dedup, toxicity
from tradeframe.llm.common import folded, kept, read, unfolded
from tradeframe.llm.queries import vocabulary_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    scored = toxicity.scored(folded(docs), read(spark, sf_dir, "labels"), ("doc_id", "text", "rest"))
    return unfolded(scored.filter(F.col("score") < toxicity.THRESHOLD), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest ``doc_id``."""
    return simhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur earlier. A text that loses words is the
    others joined by a space, with ``n_chars`` counted anew; other texts stay as they are."""
    found = substring_dedup.deduplicated(folded(docs), ("doc_id", "text", "rest"))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return unfolded(found, docs.columns, **new)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of any benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and what ``bpe.digests`` says of the text."""
    return bpe.digests(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]
#: No SQL: the models, the components and the merges are beyond it; the tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
