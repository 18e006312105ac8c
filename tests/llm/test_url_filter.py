from collections import Counter

import pytest

from tradeframe.llm import url_filter
from tradeframe.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], PAGES)


def test_rules_and_parts(spark):
    rows = [("http://EXAMPLE.com/en/1?q#f", None), ("https://www.example.com/en/", ""), ("http://a.com", None), ("http://x.net/es/1", None),
            ("http://x.net/en", None), ("http://y.org/a", None), (None, None), ("no scheme", None), ("http://www.example.com?x=/en/", None), ("ftp://u:p@A.org:8/Z#", None)]
    found = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judged(pages(spark, rows), URL_RULES).collect()}
    assert found == {
        0: ("example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        2: ("a.com", "", None, "allow"), 3: ("x.net", "/es/1", "net/es/", "block"), 4: ("x.net", "/en", None, "block"), 5: ("y.org", "/a", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("www.example.com", "", None, "allow"), 9: ("u:p@a.org:8", "/Z", None, "allow")}


def link(*hosts):
    return "".join(f'<a class="x" href="https://{h}/p">t</a>' for h in hosts) + '<a href="/own">o</a>'


def reference(seeds, edges, rounds):
    """The same propagation with dictionaries."""
    out = {}
    for kind, pairs in (("trusted", edges), ("blocked", {(b, a): n for (a, b), n in edges.items()})):
        total = sum(s[kind] for s in seeds.values())
        jump = {h: s[kind] / total for h, s in seeds.items() if s[kind]}
        degree = {}
        for (a, _), n in pairs.items():
            degree[a] = degree.get(a, 0) + n
        rank = dict(jump)
        for _ in range(rounds):
            moved = {}
            for (a, b), n in pairs.items():
                if a in rank:
                    moved[b] = moved.get(b, 0) + rank[a] * n / degree[a]
            back = 1 - url_filter.DAMPING * sum(moved.values())
            rank = {h: url_filter.DAMPING * moved.get(h, 0) + back * jump.get(h, 0) for h in moved.keys() | jump.keys()}
        out[kind] = rank
    return out


def test_ranks_follow_links(spark):
    edges = {("good.com", "friend.org"): 2, ("friend.org", "far.org"): 1, ("spam.org", "bad.net"): 3, ("hub.org", "spam.org"): 1, ("good.com", "hub.org"): 1}
    seeds = {"good.com": {"trusted": 2, "blocked": 0}, "bad.net": {"trusted": 0, "blocked": 5}}
    frames = (spark.createDataFrame([(h, s["trusted"], s["blocked"]) for h, s in seeds.items()], "host string, trusted long, blocked long"),
              spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, n long"))
    found = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(*frames, rounds=6).collect()}
    want = reference(seeds, edges, 6)
    for host, (trust, distrust) in found.items():
        assert trust == pytest.approx(want["trusted"].get(host, 0)) and distrust == pytest.approx(want["blocked"].get(host, 0))


def test_verdict_of_the_graph(spark):
    rows = [("http://good.com/a", link("friend.org")), ("http://bad.net/es/x", None), ("http://spam.org/", link("bad.net", "bad.net")),
            ("http://friend.org/", None), ("http://alone.org/", link("alone.org")), ("http://hub.org/", "<A HREF='//Bad.net/q'>")]
    found = {r["host"]: r["verdict"] for r in url_filter.judged(pages(spark, rows), URL_RULES).collect()}
    assert found == {"good.com": "allow", "bad.net": "block", "spam.org": "block", "friend.org": "allow", "alone.org": "allow", "hub.org": "block"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    chain = [f"h{i}.org" for i in range(18)]
    rows = [(f"http://{a}/", link(b)) for a, b in zip(chain, [*chain[1:], "bad.net"])] + [("http://bad.net/es/x", None)]
    found = {r["host"]: r["verdict"] for r in url_filter.judged(pages(spark, rows), URL_RULES).collect()}
    assert found == dict.fromkeys([*chain, "bad.net"], "block")


def test_ranks_settle(spark):
    edges = {("good.com", "friend.org"): 2, ("friend.org", "far.org"): 1, ("spam.org", "bad.net"): 3, ("hub.org", "spam.org"): 1, ("good.com", "hub.org"): 1}
    seeds = {"good.com": {"trusted": 2, "blocked": 0}, "bad.net": {"trusted": 0, "blocked": 5}}
    frames = (spark.createDataFrame([(h, s["trusted"], s["blocked"]) for h, s in seeds.items()], "host string, trusted long, blocked long"),
              spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, n long"))
    want = reference(seeds, edges, 400)
    for r in url_filter.host_scores(*frames).collect():
        assert r["trust"] == pytest.approx(want["trusted"].get(r["host"], 0), abs=1e-6) and r["distrust"] == pytest.approx(want["blocked"].get(r["host"], 0), abs=1e-6)


def test_empty(spark):
    assert url_filter.judged(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_odd_rows(spark):
    long = "https://long.example.com/" + "a/" * 500_000 + "?" + "q" * 500_000
    rows = [(None, "http://example.com/en/x", None), (1, None, None), (1, "http://a.net/fr/", "<p>"), (1, "http://a.net/fr/", "<p>"), (None, None, ""), (2, long, link("a.net")),
            (3, "", ""), (4, "://", None), (5, "http:///path", None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    found = url_filter.judged(frame, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter((r[0], r[1], len(r[2]), r[3]) for r in found) == Counter(
        [(None, "example.com", 5, "example.com/en/"), (1, "", 0, None), (1, "a.net", 4, "net/fr/"), (1, "a.net", 4, "net/fr/"), (None, "", 0, None),
         (2, "long.example.com", 1_000_001, "com/"), (3, "", 0, None), (4, "", 0, None), (5, "", 5, None)])
    assert {r[4] for r in found} <= {"allow", "block"}
    assert url_filter.judged(frame.limit(0), URL_RULES).count() == 0
