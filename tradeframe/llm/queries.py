"""The queries of the operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.llm import bpe, decontaminate, hard_negatives, html_text, lexical_search, lm_score, packing, quality, simhash, sql, substring_dedup, token_counts, toxicity, url_filter
from tradeframe.llm.common import read


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


#: Verdict, host, start of the path. A rule without a path ends its host with a slash.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary_path())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).drop("char_divergence", "word_divergence")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary_path())


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    # the vocabulary of byte_bpe_50k.json as ranks, and its special token
    special = bpe.vocabulary(bpe.load(vocabulary_path())).special
    return packing.placements(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), PATTERN, special)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_lm_score": op2_lm_score,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}
#: The others are learned, iterate, or follow a vocabulary file; tests compare them by brute force.
SQL: dict[str, str] = {
    "op6_decontaminate": sql.DECONTAMINATE,
    "op7_substring_dedup": sql.SUBSTRINGS,
    "op9_quality": sql.QUALITY,
    "op12_lexical_search": sql.LEXICAL_SEARCH,
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
