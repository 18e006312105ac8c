"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of each document, one of character classes and one of common words, are compared
with the reference of its language by Jensen-Shannon divergence (base 2, from 0 to 1). The
references are the summed histograms of all documents of the language that pass the base rules;
a document in another language, or in none, is compared with the sum over all, by characters
only. Short texts have ragged histograms, so each comparison has a minimum length.

Rows: a null text is empty: all counts are 0, ``base_failed`` is true (fewer than 50 words). Nulls
in ``doc_id`` and repeated rows pass through, one result per row. Only ``doc_id``, ``text`` and
``lang`` are read. A table without any passing document has no reference: nothing diverges.
Repeated word windows are told apart by a 64-bit hash within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import BLANKS, kept

# Frequent words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"],
}
SLOTS = "abcdefghijklmnopq"
#: Words of a single mark share the last slot.
MARKS = ["|", "#", "*", "-", "&", "+", "="]
SYMBOLS = "[#*$%&|<>]"
CLASSES = {"upper": "[A-Z]", "digits": "[0-9]", "points": "[.,;:!?'\"()\\[\\]-]", "other_marks": "[@^_`~{}+=/\\x5C]"}
CHARS = ["h_blanks", "h_upper", "h_digits", "h_points", "h_symbols", "h_other_marks", "h_letters"]
WORDS = [f"w_{c}" for c in SLOTS] + ["w_rest"]

#: Least characters and words of a text for the two comparisons.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Largest divergences that are kept.
MOST_CHARS, MOST_WORDS = 0.08, 0.16


def _fewer(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _number(word: Column) -> Column:
    return F.size("words") - F.size(F.array_remove("words", word))


def _common(i: int) -> Column:
    """The i-th common word of the document's language; never a word if there is none."""
    word = F.lit("")
    for lang, common in COMMON.items():
        word = F.when(F.col("lang") == lang, F.lit(common[i])).otherwise(word)
    return word


def features(docs: DataFrame) -> DataFrame:
    """One row of counts per document."""
    text = F.col("text")
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select(
        "doc_id", "lang", F.char_length(text).alias("n_chars"),
        F.split(text, "\n").alias("lines"),
        F.regexp_replace(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANKS, " ").alias("spaced"),
        # a short string: what is left without small letters, letters beyond ASCII and blanks
        F.regexp_replace(text, r"[a-z\x20\x09-\x0D\x80-\x{10FFFF}]+", "").alias("marks"),
    )
    lines = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "lang", "n_chars", lines.alias("lines"), F.char_length("spaced").alias("spaced_chars"),
        _fewer(F.col("marks"), SYMBOLS).cast("long").alias("n_symbols"),
        *(_fewer(F.col("marks"), pattern).alias(f"h_{name}") for name, pattern in CLASSES.items()),
        F.when(F.col("spaced") == "", F.array().cast("array<string>")).otherwise(F.split("spaced", " ")).alias("words"),
    )
    words = F.col("words")
    # the last two have fewer than three words and equal no other
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    counts = [_number(_common(i)).alias(f"w_{c}") for i, c in enumerate(SLOTS[:-1])]
    counts.append(sum((_number(F.lit(m)) for m in MARKS), F.lit(0)).alias(f"w_{SLOTS[-1]}"))
    df = df.select(
        "doc_id", "lang", "n_chars", "n_symbols", *(f"h_{name}" for name in CLASSES),
        F.size("words").cast("long").alias("n_words"),
        (F.col("spaced_chars") - F.greatest(F.size("words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"), *counts,
    )
    # only texts with some window twice are sorted
    df = df.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    df = df.withColumn("ordered", F.when(F.col("twice"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ordered = F.col("ordered")
    same = F.filter(ordered, lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("at", F.when(F.col("twice"), F.sort_array(F.transform(same, lambda x: x["i"]))))
    at = F.col("at")
    # each window covers up to where the next one begins, three words at most
    steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumns({"h_blanks": F.col("n_chars") - F.col("word_chars"), "h_symbols": F.col("n_symbols")})
    seen = sum((F.col(c) for c in CHARS if c != "h_letters"), F.lit(0))
    common = sum((F.col(f"w_{c}") for c in SLOTS), F.lit(0))
    df = df.withColumns({"h_letters": F.col("n_chars") - seen, "w_rest": F.col("n_words") - common})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "base_failed", *(F.col(c).cast("long").alias(c) for c in CHARS + WORDS))


def references(rows: DataFrame) -> DataFrame:
    """Share of each class and each common word, one row for each language of ``COMMON`` and one
    (key ``*``) for all documents together."""
    good = rows.filter(~F.col("base_failed"))
    sums = [F.sum(c).alias(c) for c in CHARS + WORDS]
    each = good.filter(F.col("lang").isin(*COMMON)).groupBy(F.col("lang").alias("key")).agg(*sums)
    both = each.unionByName(good.groupBy(F.lit("*").alias("key")).agg(*sums))
    def shares(names: list[str]) -> list[Column]:
        total = sum((F.col(c) for c in names), F.lit(0))
        return [F.try_divide(F.col(c), total).alias(f"r_{c}") for c in names]
    return both.select("key", *shares(CHARS), *shares(WORDS))


def divergence(names: list[str], total: Column) -> Column:
    """Jensen-Shannon divergence of a document's counts from the reference's shares."""
    def part(x: Column, m: Column) -> Column:
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)
    terms = []
    for c in names:
        p, q = F.col(c) / total, F.col(f"r_{c}")
        m = (p + q) / 2
        terms.append(part(p, m) + part(q, m))
    return reduce(lambda a, b: a + b, terms) / 2


def quality(docs: DataFrame) -> DataFrame:
    """The counts of ``features``, both divergences (null where a text is too short for them),
    ``base_failed`` and ``kept``."""
    rows = kept(features(docs), "quality-counts")
    key = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("*")
    # at most one row per known language and one more
    joined = rows.withColumn("key", key).join(F.broadcast(references(rows)), "key", "left")
    chars = F.when(F.col("n_chars") >= LEAST_CHARS, divergence(CHARS, F.col("n_chars")))
    words = F.when((F.col("n_words") >= LEAST_WORDS) & (F.col("key") != "*"), divergence(WORDS, F.col("n_words")))
    joined = joined.withColumns({"char_divergence": chars, "word_divergence": words})
    clear = (F.coalesce("char_divergence", F.lit(0.0)) <= MOST_CHARS) & (F.coalesce("word_divergence", F.lit(0.0)) <= MOST_WORDS)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & clear).alias("kept"), "char_divergence", "word_divergence")
