"""Documents dealt out in blocks of about equal size, for operators that ask the corpus about
their words in bulk: a block asks once for each thing it holds, not once per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import part_count


def in_blocks(docs: DataFrame, chars: int) -> DataFrame:
    """``docs`` with a column ``block``, partitioned by it. Blocks have about ``chars`` characters of
    ``text``; a longer document makes its block longer. The block is a hash of ``doc_id`` and ``text``,
    so the same rows meet again when a lost task is repeated."""
    total = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(total // chars + 1)).cast("int")
    return docs.withColumn("block", block).repartition(part_count(docs.sparkSession), "block")
