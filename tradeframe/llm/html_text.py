"""Main text of web pages by the distribution of text over lines.

Markup is stripped: each block of the page becomes a line, and an element that is no article
(menu, header, footer, form, script, notice, advert, comments, hidden part) becomes one empty line.
What tags and names say goes into the weight of a line only: a line weighs its length, ``TEXT`` more if its
element is one for running text, ``MARKED`` more inside the page's marked article (``article`` or
``itemprop=articleBody``, else ``main``); lines that are mostly link text weigh nothing, and so do lines
outside a marked article that holds at least ``HOLDS`` of the page's text.

The sums of the weights over ``WINDOW`` lines decide, on all pages: text begins where they surge to
``SURGE`` (or to the page's largest sum, if that is less) and ends where they dive below it. All lines
between are kept, light ones and single link lines too; a run of links is a dive. A light line next to
heavy ones is so kept with them, and an advert between two lines does not part them.

Names of class, id and role count as whole words: every part of ``cookie-notice`` or ``site-footer`` has to be
a known one, so ``has-sidebar`` or ``notice-2021`` say nothing. An element that holds the marked article is
never left out, nor for its name one that holds most of the page's text, comments apart.

Result: character references decoded, white space in a block turned into one space, blocks in
page order joined by two line ends. Null or empty html gives an empty text; broken markup gives
what can be read, in time proportional to its length (quotes that never close end at the next ``>``). Nulls
in ``page_id`` and ``url`` and repeated rows pass through, one result per row. Only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tradeframe.llm.common import extended, slices

WINDOW = 3
SURGE = 40
TEXT = 20
MARKED = 60
HOLDS = 0.3
#: A line with more than this share of link text is a menu.
LINKED = 0.5
#: More than this share is most of a page's text.
MOST = 0.5

# Names of HTML elements.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes"
NO_ARTICLE = set("head nav aside footer form button select option dialog menu svg canvas object audio video map iframe template noscript datalist search".split())
#: Words of class, id or role that mark an element as no article; words that may stand beside them; comments.
NO_ARTICLE_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie
    cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu menubar breadcrumb
    breadcrumbs sidebar sidenav widget widgets footer masthead topbar toolbar comment comments commentlist disqus respond replies
    share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager
    skip contentinfo complementary""".split())
BESIDE = set("""site page main global top bottom left right upper lower primary secondary inner outer sub mini list box block
    container wrapper wrap section area bar row col column item items content panel group buttons button links link posts post articles
    article news stories form text message msg icon icons inline sticky fixed js responsive mobile desktop reader user""".split())
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
HEADER_NAMES = {"header", "masthead", "topbar", "banner"}
ARTICLE_NAMES = {"article", "entry", "post", "story"}
RUNNING = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption caption td th summary".split())
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

#: Comments and raw elements end at the page's end if nothing closes them.
DROPPED = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)")
OPENS = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?])")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

Tag = tuple[int, int, str, str, str]  # start, end, slash, name, attributes


def tags_of(page: str) -> list[Tag]:
    """All tags. Once quotes turn out not to close, tags end at the next ``>``."""
    out: list[Tag] = []
    at, quotes = 0, True
    while m := OPENS.search(page, at):
        closed = QUOTED.match(page, m.end()) if quotes else None
        if closed:
            at = closed.end()
        else:
            quotes = False
            at = page.find(">", m.end()) + 1
            if not at:
                break
        out.append((m.start(), at, m[1] or "", (m[2] or "").lower(), page[m.end() : at - 1]))
    return out


def ends_of(tags: list[Tag]) -> tuple[list[int], list[bool]]:
    """For each opening tag the number of the tag that ends its element (itself, if nothing does), and
    whether that is its own end tag."""
    ends, own = list(range(len(tags))), [False] * len(tags)
    stack: list[int] = []
    where: dict[str, list[int]] = {}  # places in the stack by name

    def end(down_to: int, at: int) -> None:
        for k in stack[down_to:]:
            ends[k] = at
            where[tags[k][3]].pop()
        del stack[down_to:]

    for k, (_, _, slash, name, rest) in enumerate(tags):
        if not name or name in VOID:
            continue
        if slash:
            if where.get(name):
                i = where[name][-1]
                own[stack[i]] = True
                end(i, k)
        elif not rest.endswith("/"):
            if name in ENDS_ITSELF and stack and tags[stack[-1]][3] == name:
                end(len(stack) - 1, k)
            where.setdefault(name, []).append(len(stack))
            stack.append(k)
    for k in stack:  # an article that nothing ends goes on
        if tags[k][3] in ("article", "main"):
            ends[k], own[k] = len(tags), True
    return ends, own


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text else {}


def names_of(found: dict[str, str]) -> tuple[set[str], set[str]]:
    """The names an element has that mark it as no article, and all words of its class, id and role."""
    marks, words = set(), set()
    for key in ("class", "id", "role"):
        for token in found.get(key, "").split():
            parts = [p.lower() for p in PART.findall(token)]
            words.update(parts)
            if all(p in NO_ARTICLE_NAMES or p in HEADER_NAMES or p in BESIDE for p in parts):
                marks.update(p for p in parts if p in NO_ARTICLE_NAMES or p in HEADER_NAMES)
    return marks, words


def outside(name: str, found: dict[str, str], in_article: bool) -> str:
    """Why an element is no part of an article: its ``tag``, its ``name``, or as ``comments``."""
    if name in NO_ARTICLE:
        return "tag"
    if name in ("html", "body", "main"):
        return ""
    if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
        return "tag"
    if not found and name != "header":
        return ""
    marks, words = names_of(found)
    if marks & COMMENTS:
        return "comments"
    if name == "header" or marks & HEADER_NAMES:
        if marks - HEADER_NAMES or not in_article and not words & ARTICLE_NAMES:
            return "tag" if name == "header" else "name"
        return ""
    return "name" if marks else ""


def lines(page: str) -> list[tuple[str, int]]:
    """Each line and its weight; lines that are surely no text are empty."""
    page = DROPPED.sub("", page[: page.rfind(">") + 1]) + page[page.rfind(">") + 1 :]
    tags = tags_of(page)
    ends, own = ends_of(tags)
    known = [attributes(rest) if name and not slash else {} for _, _, slash, name, rest in tags]
    edges = [0, *(t[1] for t in tags), len(page)]
    sizes = [(tags[k][0] if k < len(tags) else len(page)) - edges[k] for k in range(len(tags) + 1)]
    before = [0, *accumulate(sizes)]  # characters of text before each tag
    total = max(before[-1], 1)
    kinds = [0] * len(tags)  # 2: marks the article, 1: main
    for k, (_, _, slash, name, _) in enumerate(tags):
        if name and not slash and (own[k] or name in ("article", "main")):
            if (name == "article" or known[k].get("itemprop") == "articleBody") and not names_of(known[k])[0]:
                kinds[k] = 2
            elif name == "main" or known[k].get("role") == "main":
                kinds[k] = 1
    best = max(kinds, default=0)
    marks = [0, *accumulate(int(kind == best > 0) for kind in kinds)]
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    article = skipped = links = -1  # the tag that ends what we are in
    running = False

    def end_line() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            inside = article >= at
            weight = 0 if linked > LINKED * len(text) else len(text) + TEXT * running + MARKED * inside
            out.append((text, weight, inside))
        parts.clear()
        linked = 0

    for at in range(len(tags) + 1):
        if at > skipped:
            stop = tags[at][0] if at < len(tags) else len(page)
            if stop > edges[at]:
                piece = page[edges[at] : stop]
                if at == len(tags) and "<" in piece:  # a tag that the page's end cuts off
                    piece = piece[: OPENS.search(piece).start()] if OPENS.search(piece) else piece
                parts.append(piece)
                linked += len(piece) * (links >= at)
        if at == len(tags):
            break
        _, _, slash, name, _ = tags[at]
        if at < skipped or not name:
            continue
        if name in BLOCKS:
            end_line()
            running = name in RUNNING and not slash
        elif name == "br":
            parts.append("\n")
        if slash or name in VOID:
            continue
        if name == "a" and own[at]:
            links = ends[at]
        why = outside(name, known[at], article > at) if own[at] else ""
        holds = article <= at and marks[ends[at]] > marks[at]
        share = (before[min(ends[at], len(tags))] - before[at + 1]) / total
        if why and not holds and not (why == "name" and share > MOST):
            end_line()
            out.append(("", 0, article > at))
            skipped = ends[at]
        elif kinds[at] == best > 0:
            article = max(article, ends[at])
    at = len(tags)
    end_line()
    inside = sum(len(text) for text, _, yes in out if yes)
    if inside and inside >= HOLDS * sum(len(text) for text, _, _ in out):
        return [(text, weight) if yes else ("", 0) for text, weight, yes in out]
    return [(text, weight - MARKED * (yes and weight > 0)) for text, weight, yes in out]


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """Where the sums over ``WINDOW`` lines surge to ``SURGE`` and dive below it, from the first weight of the
    first such window to the last weight of the last one."""
    sums = [sum(weights[max(i, 0) : i + WINDOW]) for i in range(1 - WINDOW, len(weights))]
    bar = min(SURGE, max(sums, default=0))
    found, start = [], None
    for i, total in enumerate([*sums, 0], 1 - WINDOW):
        if bar and total >= bar:
            start = i if start is None else start
        elif start is not None:
            heavy = [k for k in range(max(start, 0), min(i - 1 + WINDOW, len(weights))) if weights[k]]
            found.append((heavy[0], heavy[-1] + 1))
            start = None
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    kept = dict.fromkeys(i for a, b in stretches([weight for _, weight in rows]) for i in range(a, b))
    return "\n\n".join(rows[i][0] for i in kept if rows[i][0])


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    rows = pages.select("page_id", "url", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, extended(rows.select("page_id", "url").schema, "text string, n_chars long"))
