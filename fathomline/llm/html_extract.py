"""Main-text extraction from web pages by minimum-cut labelling of text blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+(?:>|\Z)|([^<]++|<)""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed lists: kinds of elements, and words of class, id and role that tell what an element holds.
RAW = frozenset("script style template iframe object svg canvas audio video title textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option a".split())
FRAME_TAGS = frozenset("nav aside form footer button fieldset dialog menu".split())
CONTENT_WORDS = frozenset("article content entry post story main body text prose page".split())
FRAME_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar side aside breadcrumb breadcrumbs pagination pager toolbar topbar "
    "bottom copyright legal login signin signup search form skip banner contentinfo complementary rail widget meta tags tagcloud logo".split()
)
TALK_WORDS = frozenset(
    "comment comments reply replies respond discussion disqus thread ad ads advert adverts advertisement advertising adsense sponsor "
    "sponsored promo promotion promoted notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended recommendations trending outbrain taboola paywall dialog".split()
)
PAPER_WORDS = frozenset("work works research literature studies".split())
#: Costs, in one unit: what a mark of the innermost telling element weighs, how much of the outer ones remains, and the
#: capacities of the edges between blocks next to one another, with one parent, and with one grandparent.
CONTENT, FRAME, TALK, OUTER = 4.0, -8.0, -12.0, 0.25
NEXT, PARENT, GRANDPARENT = 0.8, 0.8, 0.4


#: Code points of a block of running text.
RUNNING = 80


class _Block:
    __slots__ = ("text", "links", "mark", "origin", "parents", "tag")

    def __init__(self, text: str, links: int, mark: float, origin: int, parents: tuple[int, int], tag: str):
        self.text, self.links, self.mark, self.origin, self.parents, self.tag = text, links, mark, origin, parents, tag


def _marked(tag: str, attributes: str, outer: float) -> float:
    """The mark of an element inside one with mark ``outer``; 0 is no evidence."""
    words: set[str] = set()
    if attributes and ("=" in attributes or "hidden" in attributes):
        if outer <= 0 and HIDDEN.search(attributes):  # in an article, text that unfolds is the article's
            return FRAME + OUTER * min(outer, 0)
        if tag not in ("html", "body"):
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role"):
                    words.update(w.lower() for w in PIECE.findall(a or b or c))
    if tag == "main":
        return CONTENT
    if words & TALK_WORDS and not (words & TALK_WORDS == {"related"} and words & PAPER_WORDS):
        return TALK
    content, frame = bool(words & CONTENT_WORDS), bool(words & FRAME_WORDS) and tag not in ("article",)
    if tag in FRAME_TAGS or frame and not content:
        return outer if tag not in FRAME_TAGS and outer > 0 and words & {"header", "meta", "side", "body"} else FRAME + OUTER * min(outer, 0)
    if tag == "header":
        return outer if outer > 0 else FRAME
    if tag == "article":
        return CONTENT if outer > TALK / 2 - 3 else outer
    if content and not frame and outer > FRAME / 2:
        return max(outer, CONTENT * 0.75)
    return outer


def blocks(html: str) -> list[_Block]:
    """Text blocks in page order, references decoded, white space collapsed. Bad markup never fails: what isn't a tag is text."""
    found: list[_Block] = []
    # Tag, number, mark and the element that it comes from, of open elements; numbers and tags of those that make blocks; how many of a tag are open.
    stack: list[tuple[str, int, float, int]] = [("", 0, 0.0, 0)]
    outer: list[tuple[int, str]] = [(0, "")]
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    ids = links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                found.append(_Block(words, links, stack[-1][2], stack[-1][3], (outer[-1][0], outer[-2][0] if len(outer) > 1 else -1), outer[-1][1]))
            text.clear()
            links = 0

    def close() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        if tag not in INLINE:
            outer.pop()
        return tag

    at = 0
    while m := TOKEN.match(html, at):
        at = m.end()
        closing, tag, attributes, words = m.groups()
        if words is not None:
            text.append(words)
            if in_link:
                links += len(words.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if open_tags[tag]:
                while close() != tag:
                    pass
            if tag == "a":
                in_link = False
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in CLOSED_BY_SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            close()
                        break
                    if stack[k][0] not in INLINE:
                        break
            ids += 1
            mark = _marked(tag, attributes, stack[-1][2])
            named = tag not in FRAME_TAGS and mark != stack[-1][2] and mark < 0
            stack.append((tag, ids, mark, ids if named else stack[-1][3] if mark == stack[-1][2] else 0))
            open_tags[tag] += 1
            if tag not in INLINE:
                outer.append((ids, tag))
            in_link = in_link or tag == "a"
    flush()
    return found


def score(block: _Block, marked: bool) -> float:
    """What speaks for content, above 0, or against. ``marked``: some element of the page is marked as content."""
    n = len(block.text)
    s = block.mark if block.mark else (-1.5 if marked else 0.0)
    s += 1.5 if n >= 120 else 0.8 if n >= 50 else 0.0 if n >= 25 else -0.4
    s += 0.4 if block.text[-1] in ".!?…:;\"”»" else -0.2
    s -= 3.0 * (block.links / n) if block.links > 0.3 * n else 0.0
    if block.tag in ("h1", "h2", "p", "blockquote", "pre"):
        s += 0.4
    if n < 200 and ("©" in block.text or "all rights reserved" in block.text.lower()):
        s -= 4.0
    return s


def _eliminated(gain: list[float], near: list[dict[int, float]], side: list[bool | None]) -> list[tuple[int, float, dict[int, float]]]:
    """Takes out undecided nodes with at most two neighbours, in turn; what is left is smaller and has the same minimum. Returns them with gain and edges.

    The best that such a node can do is a function of its neighbours' sides, and that function is a change of their gains and an edge between them.
    """
    gone: list[tuple[int, float, dict[int, float]]] = []
    work = deque(i for i, s in enumerate(side) if s is None and len(near[i]) <= 2)
    out = [s is not None for s in side]
    while work:
        i = work.popleft()
        if out[i] or len(near[i]) > 2:
            continue
        out[i], g, own = True, gain[i], near[i]
        gone.append((i, g, own))
        near[i] = {}
        for j in own:
            del near[j][i]
        if len(own) == 1:
            ((a, w),) = own.items()
            gain[a] += min(0.0, w - g) - min(w, -g)
        elif own:
            (a, v), (b, w) = own.items()
            none, both, first, second = min(0.0, v + w - g), min(v + w, -g), min(v, w - g), min(w, v - g)  # cost by the sides of a and b
            edge = max((first + second - none - both) / 2, 0.0)
            gain[a] -= first - none - edge
            gain[b] -= second - none - edge
            if edge > 1e-12:
                near[a][b] = near[a].get(b, 0.0) + edge
                near[b][a] = near[b].get(a, 0.0) + edge
        work.extend(j for j in own if len(near[j]) <= 2)
    return gone


def _flowed(gain: list[float], near: list[dict[int, float]], nodes: list[int], side: list[bool | None]) -> None:
    """Sets the sides of ``nodes`` by a maximum flow: blocking flows over level graphs, until no path is left."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {i: gain[i] for i in nodes if gain[i] > 0}, {}
    for i in nodes:
        room[i][sink], room[i][source] = max(-gain[i], 0.0), 0.0
        room[sink][i] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, r in room[i].items():
                if r > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            break
        ways = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                cut = len(path)
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    room[a][b] -= least
                    room[b][a] += least
                    if room[a][b] <= 1e-9:
                        cut = k
                del path[cut:]  # back to where the first full edge starts
                continue
            for j in ways[i]:
                if level.get(j) == level[i] + 1 and room[i][j] > 1e-9:
                    path.append(j)
                    break
            else:
                path.pop()
    for i in nodes:
        side[i] = i in level


def minimum_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; ties go to the sink's.

    A node with ``gain`` above 0 has that capacity from the source, else to the sink; edges go both ways. Nodes whose own
    gain exceeds all their edges lie on their side in every minimum cut: they are set first, and what they pull with is added
    to their neighbours' gains. Of the rest, nodes with two neighbours or fewer are taken out, again and again (:func:`_eliminated`): pages are mostly
    chains and nested lists, which vanish so in time that follows their length. A maximum flow decides what is left, and those taken out follow it.
    """
    near: list[dict[int, float]] = [{} for _ in gain]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    gain, side, work = list(gain), [None] * len(gain), deque(range(len(gain)))
    while work:
        i = work.popleft()
        if side[i] is None and abs(gain[i]) > sum(near[i].values()) + 1e-12:
            side[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if side[i] else -w
                work.append(j)
            near[i] = {}
    gone = _eliminated(gain, near, side)
    taken = {i for i, _, _ in gone}
    left = [i for i, s in enumerate(side) if s is None and i not in taken]
    if left:
        _flowed(gain, near, left, side)
    for i, g, own in reversed(gone):
        side[i] = g + sum(w if side[j] else -w for j, w in own.items()) > 1e-9
    return side


def main_text(html: str | None, stats: dict[str, int] | None = None) -> str:
    """The page's main text: blocks that the minimum cut leaves with the content, in page order, joined by a space. ``stats`` counts ``blocks`` and
    labels that the cut ``changed`` against the sign of a block's own gain."""
    found = blocks(html or "")
    if not found:
        return ""
    marked = any(b.mark > 0 for b in found)
    if not marked:
        # A name that speaks against an element with most of the page's running text is no evidence: it names the article.
        held: Counter[int] = Counter()
        for b in found:
            held[b.origin] += len(b.text) if len(b.text) >= RUNNING else 0
        most = {o for o, n in held.items() if o and 2 * n > sum(held.values())}
        for b in found:
            if b.origin in most:
                b.mark = 0.0
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = edges.get((i - 1, i), 0.0) + NEXT
        for level, weight in ((0, PARENT), (1, GRANDPARENT)):
            place = level, b.parents[level]
            if place in last:
                edges[last[place], i] = edges.get((last[place], i), 0.0) + weight
            last[place] = i
    gains = [score(b, marked) for b in found]
    keep = minimum_cut(gains, edges)
    if stats is not None:
        for name, more in (("blocks", len(found)), ("changed", sum(k != (g > 0) for k, g in zip(keep, gains, strict=True)))):
            stats[name] = stats.get(name, 0) + more
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of each page: the article without what frames it.

    A page's text blocks are nodes. A classifier of the elements around a block, its length, its end and its share of link text
    gives each a cost of either label, as capacity to the source (content) or sink (boilerplate); blocks next to one
    another, or of one parent or grandparent in the document tree, are joined by smoothness edges. The minimum cut is the
    labelling of least cost. Pages are read whole, row by row, so equal pages give equal texts.

    NULL and empty pages, and pages without content, give an empty text. Bad markup is read as far as it goes. An empty table
    gives no rows. Columns other than ``keep`` are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b.pop("_html")]
            yield b.assign(text=texts, n_chars=[len(t) for t in texts])

    own = pages.select(*keep, F.col(html).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_html")
    return own.mapInPandas(rows, f"{kinds}, text string, n_chars long")
