"""URL verdicts from rules and from the link graph between hosts.

Trust flows along links from hosts with allowed pages, distrust flows against links from hosts
with blocked pages: two personalised PageRanks on the same graph, computed together. A host that
nobody's rules decide is blocked if its distrust exceeds ``RATIO`` times its trust.

Links between the same two hosts are counted before they are shuffled by host, so a host with
much of the web is one row per partner. Links within a host carry nothing. What a host without
outgoing links holds returns to the seeds. Rounds go on until the ranks settle and no further host
is reached, however long the chains of links are.

Rows: a null url, or one without ``://``, has empty host and path and no rule; the empty host is
no host and is allowed. Null html has no links. Nulls in ``page_id`` and repeated rows pass
through, one result per row; a repeated page counts its links again. Only ``page_id``, ``url``
and ``html`` are read. Without seeds all ranks are 0 and every undecided host is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.common import kept, met

#: Verdict, host with its subdomains, start of the path.
Rule = tuple[str, str, str]
DAMPING = 0.85
#: The ranks are final when a round changes them by less than this in sum, each of the two.
TOLERANCE = 1e-6
RATIO = 1.0
#: Rounds between two looks at whether the ranks have settled.
CUT = 4


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: Sequence[Rule]) -> Column:
    """The index of the longest fitting rule, by columns ``host`` and ``path``; null if none fits."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    cases = F.lit(None).cast("int")
    for i in reversed(order):
        _, host, path = rules[i]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        cases = F.when(fits, F.lit(i)).otherwise(cases)
    return cases


def _pick(index: Column, values: Sequence[str]) -> Column:
    return reduce(lambda other, i: F.when(index == i, F.lit(values[i])).otherwise(other), range(len(values)), F.lit(None).cast("string"))


def links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: ``source``, ``target``, ``n``. Relative links stay on the host."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    df = pages.select(host_of(F.col("url")).alias("source"), F.explode(found).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    df = df.select("source", host_of(full).alias("target"))
    df = df.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return df.groupBy("source", "target").agg(F.count("*").alias("n"))


def host_scores(seeds: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of every host with a score. ``seeds``: ``host``, ``trusted``,
    ``blocked`` (weights, e.g. pages); ``edges``: ``source``, ``target``, ``n``. ``rounds`` is for a fixed number of them."""
    # both directions as one graph: the kind keeps the two ranks apart
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "n"))
    degree = ways.groupBy("kind", "host").agg(F.sum("n").alias("degree"))
    ways = kept(ways.join(degree, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("degree")).alias("share")), "url-links")
    start = seeds.select(F.lit("trust").alias("kind"), "host", F.col("trusted").cast("double").alias("w")).unionByName(
        seeds.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").cast("double").alias("w"))).filter("w > 0")
    totals = {r["kind"]: r["w"] for r in start.groupBy("kind").agg(F.sum("w").alias("w")).collect()}  # two rows
    whole = F.when(F.col("kind") == "trust", F.lit(totals.get("trust", 1.0))).otherwise(F.lit(totals.get("distrust", 1.0)))
    start = kept(start.select("kind", "host", (F.col("w") / whole).alias("jump")), "url-seeds")
    ranks = start.select("kind", "host", F.col("jump").alias("rank"))
    before = ranks
    if ways.isEmpty():
        rounds = 0
    i = 0
    while rounds is None or i < rounds:
        # a host with far more partners than others: its rank is small data, AQE splits its links
        moved = ranks.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        moved = kept(moved, "url-ranks")
        # without a fixed number of rounds nothing returns before the end: what returns only scales all ranks
        back = F.lit(1.0)
        if rounds is not None:
            held = {r["kind"]: r["m"] for r in moved.groupBy("kind").agg(F.sum("moved").alias("m")).collect()}  # two rows
            back = F.when(F.col("kind") == "trust", F.lit(1 - damping * held.get("trust", 0.0))).otherwise(F.lit(1 - damping * held.get("distrust", 0.0)))
        ranks = moved.join(start, ["kind", "host"], "full_outer").select(
            "kind", "host", (damping * F.coalesce("moved", F.lit(0.0)) + back * F.coalesce("jump", F.lit(0.0))).alias("rank"))
        i += 1
        if rounds is None:
            if i % CUT == CUT - 1:
                before = ranks
            elif i % CUT == 0:
                was = before.select("kind", "host", F.col("rank").alias("was"))
                both = ranks.join(was, ["kind", "host"], "full_outer")
                change = F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
                settled = both.groupBy("kind").agg(change.alias("change"), F.count_if(F.col("rank") > 0).alias("hosts"), F.count_if(F.col("was") > 0).alias("had")).collect()  # two rows
                if all(r["change"] < TOLERANCE and r["hosts"] == r["had"] for r in settled):
                    break
    if rounds is None:
        ranks = kept(ranks, "url-ranks")
        sums = ranks.groupBy("kind").agg(F.sum("rank").alias("sum"))
        ranks = ranks.join(sums, "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank"))
    one = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(one("trust"), one("distrust"))


def judged(pages: DataFrame, rules: Sequence[Rule], ratio: float = RATIO) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every page."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("index", matched(rules))
    by_rule = _pick(F.col("index"), [r[0] for r in rules])
    df = df.withColumn("by_rule", by_rule)
    hosts = kept(df.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("trusted"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "url-hosts")
    scores = host_scores(hosts.filter(F.col("host") != ""), links(pages))
    # one verdict per host; a host with many pages meets it in parts
    df = met(df, hosts, scores, "host", F.xxhash64("path", "page_id"), "left")
    by_graph = F.when((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") > 0), "block").otherwise("allow")
    return df.select("page_id", "host", "path", _pick(F.col("index"), [r[1] + r[2] for r in rules]).alias("rule"),
                     F.coalesce("by_rule", by_graph).alias("verdict"),
                     F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
