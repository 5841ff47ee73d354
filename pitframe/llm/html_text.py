"""Main text of HTML pages by composite text density (operator 7).

A page is parsed into a tree that forgives unclosed and stray tags. Subtrees that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments by tag, role or a whole name in class or id leave first; the name
``header`` does not count inside an ``article`` or ``main``, where it is a lead, and no name counts on a node that holds the greatest ``article`` or ``main``, or, where all of these are under such names or there
are none, at least half of the text outside links. Every other node gets its
density, characters per tag scaled down by how much of it is links, and the sum of its children's densities. The node
with the greatest sum is the core, and the least density on its path to the body is the threshold. From the body down, of
each node that reaches the threshold the part with the greatest sum is kept; so is the widest ``article`` or ``main`` around the
core. Above kept parts, text that stands directly in a node stays with them, as do blocks between them, headings over them
and what else is in a node of which at least half is kept, unless it is mostly links.

Defined cases: a null or empty page, or one with no text left, gives an empty text; ties go to the earlier node; repeated
rows are treated alike; an empty table gives an empty result; other columns are not carried. Pages are never cut.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*>""", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: What is never main text: tags, roles, and whole names in class and id attributes.
DROP_TAGS = frozenset("head nav header footer aside form button select input textarea script style title noscript template iframe object svg canvas dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header menu nav navbar navigation newsletter notice notices pagination popup modal promo promotion related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Names that do not count inside these tags.
LEADS, MAIN = frozenset(["header"]), frozenset(["article", "main"])


class Page:
    """Nodes of one page in document order: tag, parent, and the text and child nodes that each holds, in order."""

    def __init__(self):
        self.tags, self.parents, self.dropped, self.named, self.content = ["#page"], [-1], [False], [False], [[]]

    def add(self, tag: str, parent: int, dropped: bool, named: bool) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(dropped)
        self.named.append(named)
        self.content.append([])
        self.content[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the node is never main text, and whether it has a name of such nodes; ``inside`` an article or main leads may be named header."""
    if tag in DROP_TAGS:
        return True, False
    named = False
    if not attributes.strip(" /\n\t\r"):
        return False, False
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in DROP_ROLES) or (name == "style" and "display:none" in value.replace(" ", "")):
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            named = named or not (DROP_WORDS - LEADS if inside else DROP_WORDS).isdisjoint(value.split())
    return False, named


def _drop_named(page: Page) -> None:
    """Nodes with names of what is no main text are dropped, but for those that hold it."""
    n = len(page.tags)
    if True not in page.named:
        return
    plain, in_link, under = [0] * n, [False] * n, [False] * n  # characters outside links
    for i in range(1, n):
        up = page.parents[i]
        in_link[i] = in_link[up] or page.tags[i] == "a"
        under[i] = under[up] or page.named[i]
    for i in range(n - 1, -1, -1):
        if page.dropped[i]:
            continue
        if not in_link[i]:
            plain[i] += sum(len(" ".join(x.split())) for x in page.content[i] if isinstance(x, str))
        if i:
            plain[page.parents[i]] += plain[i]
    texts = [i for i in range(n) if page.tags[i] in ("article", "main") and plain[i]]
    holds = [False] * n
    if texts:
        i = max(texts, key=lambda i: (plain[i], -i))
        while i >= 0:
            holds[i], i = True, page.parents[i]
    free = any(not under[i] for i in texts)
    for i in range(1, n):  # parents come before their children
        kept = holds[i] or (not free and 2 * plain[i] >= plain[0] > 0)
        page.dropped[i] = page.dropped[i] or page.dropped[page.parents[i]] or (page.named[i] and not kept)


def parse(source: str) -> Page:
    page, stack, at = Page(), [0], 0

    main = 0  # open articles and mains

    def close(to: int) -> None:
        nonlocal main
        main -= sum(page.tags[i] in MAIN for i in stack[to:])
        del stack[to:]

    def text(piece: str) -> None:
        if piece:
            page.content[stack[-1]].append(piece)

    while (m := _token.search(source, at)) is not None:
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] == tag:
                    close(i)
                    break
                if tag in INLINE and page.tags[stack[i]] not in INLINE:
                    break  # a stray inline end does not close blocks
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] == "p":
                    close(i)
                    break
                if page.tags[stack[i]] not in INLINE:
                    break
        elif tag in CLOSES_SAME:
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] in same:
                    close(i)
                    break
                if page.tags[stack[i]] in CLOSES_SAME[tag]:
                    break
        if tag == "body":
            close(2 if len(stack) > 1 and page.tags[stack[1]] == "html" else 1)
        dropped, named = _unwanted(tag, m[3], main > 0)
        node = page.add(tag, stack[-1], page.dropped[stack[-1]] or dropped, named)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            main += tag in MAIN
    text(source[at:])
    _drop_named(page)
    return page


def _densities(page: Page, body: int) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density of each node, the sum over its children, and its characters, all and in links."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        if page.dropped[i]:
            continue
        for x in page.content[i]:
            if isinstance(x, str):
                chars[i] += len(" ".join(x.split()))
            elif not page.dropped[x]:
                chars[i] += chars[x]
                tags[i] += tags[x] + 1
                link_chars[i] += link_chars[x]
                link_tags[i] += link_tags[x] + (page.tags[x] == "a")
        if page.tags[i] == "a":
            link_chars[i] = chars[i]
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    for i in range(n):
        if chars[i] and not page.dropped[i]:
            rest = chars[i] - link_chars[i]
            base = math.log(chars[i] / max(1, rest) * link_chars[i] + share * chars[i] + math.e)
            ratio = chars[i] / max(1, link_chars[i]) * max(1, tags[i]) / max(1, link_tags[i])
            density[i] = chars[i] / max(1, tags[i]) * math.log(max(ratio, 1.0) + 1e-9) / max(1e-9, math.log(base + 1e-9) if base > 1.0001 else 1.0)
    sums = [sum(density[x] for x in page.content[i] if not isinstance(x, str)) for i in range(n)]
    return density, sums, chars, link_chars


def _marked(page: Page, inside: list[bool], density: list[float], sums: list[float], body: int, threshold: float) -> list[bool]:
    """The nodes that are kept whole: of each node reaching the threshold, under nodes that reach it, the part of greatest sum."""
    n = len(page.tags)
    best = list(range(n))
    for i in range(n - 1, body, -1):
        if inside[i] and (sums[best[i]], -best[i]) > (sums[best[up := page.parents[i]]], -best[up]):
            best[up] = best[i]
    whole, reached = [False] * n, [False] * n
    for i in range(body, n):
        up = page.parents[i]
        if not inside[i]:
            continue
        whole[i] |= i > body and whole[up]
        if not whole[i] and density[i] >= threshold and (i == body or reached[up]):
            reached[i] = True
            whole[best[i]] = True
    return whole


def _shown(page: Page, inside: list[bool], whole: list[bool], chars: list[int], link_chars: list[int], body: int) -> dict[int, list]:
    """What is shown of the nodes above kept ones; ``whole`` gets the blocks that stay with kept ones."""
    out: dict[int, list] = {}
    got = [0] * len(page.tags)
    linked = lambda x: 2 * link_chars[x] > chars[x]
    for i in range(len(page.tags) - 1, body - 1, -1):
        if not inside[i]:
            continue
        nodes = [x for x in page.content[i] if not isinstance(x, str) and inside[x]]
        kept = [k for k, x in enumerate(nodes) if whole[x] or x in out]
        if whole[i]:
            got[i] = chars[i]
        elif kept:
            first, last = kept[0], kept[-1]
            if i != body and 2 * sum(got[nodes[k]] for k in kept) >= chars[i]:
                first, last = 0, len(nodes) - 1
            for k in range(first - 1, -1, -1):
                if chars[nodes[k]] and linked(nodes[k]):
                    break
                if chars[nodes[k]] and re.fullmatch("h[1-6]", page.tags[nodes[k]]):
                    first = k
            for x in nodes[first : last + 1]:
                if x not in out and not linked(x):
                    whole[x], got[x] = True, chars[x]
            shown: list = []
            run: list = []
            for x in [*page.content[i], None]:
                if isinstance(x, str) or (x is not None and (page.tags[x] in INLINE or page.tags[x] == "br")):
                    run.append(x)
                    continue
                own = sum(len(" ".join(y.split())) for y in run if isinstance(y, str))
                parts = [y for y in run if not isinstance(y, str) and inside[y]]
                if own and 2 * sum(link_chars[y] for y in parts) <= own + sum(chars[y] for y in parts):
                    shown += run  # a sentence with its links
                    got[i] += own
                    for y in parts:
                        whole[y], got[y] = True, chars[y]
                        out.pop(y, None)
                else:
                    shown += [y for y in parts if whole[y] or y in out or page.tags[y] == "br"]
                run = []
                if x is not None:
                    shown.append(x)
            got[i] += sum(got[x] for x in nodes)
            out[i] = shown
    return out


def _blocks(page: Page, top: int, whole: list[bool], shown: dict[int, list]) -> list[str]:
    out: list[list[str]] = [[]]
    todo: list = [top]
    while todo:  # not recursive: pages may be nested deeply
        x = todo.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif x == -1:
            out.append([])
        elif not page.dropped[x]:
            if page.tags[x] == "br":
                out[-1].append(" ")
            elif page.tags[x] not in INLINE:
                out.append([])
                todo.append(-1)
            todo += reversed(page.content[x] if whole[x] else shown.get(x, ()))
    return [b for parts in out if (b := " ".join(html.unescape("".join(parts)).split()))]


def main_text(source: str | None) -> str:
    """The article's blocks, joined by two line ends."""
    page = parse(source or "")
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    density, sums, chars, link_chars = _densities(page, body)
    inside = [False] * len(page.tags)
    inside[body] = True
    for i in range(body + 1, len(page.tags)):
        inside[i] = page.parents[i] >= 0 and inside[page.parents[i]] and not page.dropped[i]
    core = max((i for i in range(len(page.tags)) if inside[i]), key=lambda i: (sums[i], -i))
    if not sums[core]:
        core = body
    path = [core]
    while path[-1] != body and page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    threshold = min(density[i] for i in path)
    whole = _marked(page, inside, density, sums, body, threshold)
    for i in path:
        whole[i] |= i == core or page.tags[i] in ("article", "main")
    for i in range(body + 1, len(page.tags)):
        whole[i] |= inside[i] and whole[page.parents[i]]
    shown = {} if whole[body] else _shown(page, inside, whole, chars, link_chars, body)
    for i in range(body + 1, len(page.tags)):
        whole[i] |= inside[i] and whole[page.parents[i]]
    return "\n\n".join(_blocks(page, body, whole, shown))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    common.session(pages)
    kind = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.record_batch([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {kind[id_col]}, url {kind[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
