"""Keys and document numbers that need neither a counter nor the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column | str) -> Column:
    """Surrogate key from the natural key: the first 60 bits of its md5 as bigint.
    Every task can compute it alone, where a running number needs a global order."""
    digest = F.md5(F.concat_ws("-", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def document_number(prefix: str, date: Column, key: Column | str, width: int = 6) -> Column:
    """``PREFIX-YYYYMMDD-<key>``, the key padded to ``width`` but never cut. Unique
    because the key is; running the job again gives the same number."""
    key = F.col(key) if isinstance(key, str) else key
    text = key.cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat_ws("-", F.lit(prefix), F.date_format(date, "yyyyMMdd"), padded)


def movement_number(movement_type: Column | str, date: Column, key: Column | str) -> Column:
    """``SM-<type>-<year>-<key>``."""
    movement_type = F.col(movement_type) if isinstance(movement_type, str) else movement_type
    key = F.col(key) if isinstance(key, str) else key
    return F.concat_ws("-", F.lit("SM"), movement_type, F.year(date).cast("string"), key.cast("string"))
