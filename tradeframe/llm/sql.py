"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from tradeframe.llm import quality

WORDS = r"[^\x20\x09-\x0D]+"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as line
  from items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as t(i) where len(w) > 0),
places as (
  select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as line
  from (select distinct n from windows), docs, unnest(range(1, greatest(len(w) - n, -1) + 2)) as t(i)),
hits as (select doc_id, i, places.n, item_id from places join windows on places.line = windows.line and places.n = windows.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join found using (doc_id)
"""

SUBSTRINGS = rf"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as line from docs, unnest(range(1, greatest(len(w) - 19, 0) + 1)) as t(i)),
firsts as (select line, min(row(doc_id, i)) as first from windows group by line having count(*) > 1),
gone as (
  select doc_id, list(distinct p) as gone
  from (select doc_id, unnest(range(i, i + 20)) as p from windows join firsts using (line) where row(doc_id, i) > first) group by doc_id),
kept as (
  select doc_id, w, coalesce(len(gone), 0) as n_removed,
    case when gone is null then w else list_filter(w, lambda x, k: not list_contains(gone, k)) end as kept
  from docs left join gone using (doc_id))
select doc_id, cast(len(w) as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from kept
"""


def _text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _divergence(counts: str, shares: str) -> str:
    """Jensen-Shannon divergence of a list of counts from a list of shares."""
    p = f"list_transform({counts}, lambda x: x / greatest(list_sum({counts}), 1))"
    terms = " + ".join(f"case when {x} > 0 then {x} * log2(2 * {x} / (z[1] + z[2])) else 0 end" for x in ("z[1]", "z[2]"))
    return f"(list_sum(list_transform(list_zip({p}, {shares}), lambda z: {terms})) / 2)"


def _class_counts() -> str:
    pattern = {name: p.replace("'", "''") for name, p in {**quality.CLASSES, "symbols": quality.SYMBOLS}.items()}
    number = {name: f"len(regexp_extract_all(t, '{p}'))" for name, p in pattern.items()}
    number["blanks"] = r"len(regexp_extract_all(t, '[\x20\x09-\x0D]'))"
    named = [c.removeprefix("h_") for c in quality.CHARS if c != "h_letters"]
    return "[" + ", ".join(number[c] for c in named) + ", length(t) - " + " - ".join(number[c] for c in named) + "]"


def _common() -> str:
    cases = " ".join(f"when '{lang}' then {_text_list(words)}" for lang, words in quality.COMMON.items())
    return f"case lang {cases} end"


QUALITY = rf"""
with texts as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
split as (
  select *, regexp_extract_all(t, '{WORDS}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    {_class_counts()} as chars, {_common()} as common
  from texts),
windows as (select r, i, array_to_string(list_slice(w, i, i + 2), ' ') as line from split, unnest(range(1, greatest(len(w) - 2, 0) + 1)) as t(i)),
twice as (select r, line from windows group by r, line having count(*) > 1),
repeats as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 3)) as p from windows join twice using (r, line)) group by r),
base as (
  select split.*, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed,
    list_concat(list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))), [len(list_filter(w, lambda x: list_contains({_text_list(quality.MARKS)}, x)))]) as named
  from split left join repeats using (r)),
counted as (select *, case when common is null then null else list_append(named, len(w) - list_sum(named)) end as words, coalesce(case when common is null then null else lang end, '*') as key from base),
sums as (
  select key, 'c' as kind, k, sum(x) as x from (select lang as key, unnest(chars) as x, unnest(range(len(chars))) as k from counted where not base_failed and common is not null) group by key, k
  union all
  select '*', 'c', k, sum(x) from (select unnest(chars) as x, unnest(range(len(chars))) as k from counted where not base_failed) group by k
  union all
  select key, 'w', k, sum(x) from (select lang as key, unnest(words) as x, unnest(range(len(words))) as k from counted where not base_failed and common is not null) group by key, k),
shares as (select key, kind, list(x / total order by k) as share from (select *, sum(x) over (partition by key, kind) as total from sums) group by key, kind),
judged as (
  select counted.*, case when length(t) >= {quality.LEAST_CHARS} then {_divergence("chars", "c.share")} end as dc,
    case when n_words >= {quality.LEAST_WORDS} and common is not null then {_divergence("words", "v.share")} end as dw
  from counted left join shares c on c.key = counted.key and c.kind = 'c' left join shares v on v.key = counted.key and v.kind = 'w')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(dc, 0) <= {quality.MOST_CHARS} and coalesce(dw, 0) <= {quality.MOST_WORDS} as kept
from judged
"""

LEXICAL_SEARCH = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') as w
  from documents where text is not null),
items as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) as term
  from benchmark where text is not null),
sizes as (select r, doc_id, cast(len(w) as bigint) as n from docs where len(w) > 0),
totals as (select count(*) as docs, cast(sum(n) as bigint) as terms from sizes),
postings as (
  select r, term, count(*) as tf from (select r, unnest(w) as term from docs) where term in (select term from items) group by r, term),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as weight
  from postings, totals group by term),
scores as (
  select item_id, r, doc_id,
    cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) as bigint) as score
  from items join weights using (term) join postings using (term) join sizes using (r), totals group by item_id, r, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scores where score > 0)
where rank <= 10
"""

HARD_NEGATIVES = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from vectors a, vectors r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank,
  id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
