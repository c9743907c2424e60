"""Parsers of recorded pages, feeds and archive records: HTML and XML in, columns out. Fetching is left to a callable."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from fathomline.functions import dates
from fathomline.functions.batches import BATCH_BYTES, bounded_batches
from fathomline.functions.text import absolute_url, any_or_all_words, clean_block, clean_html, collapse, contains_any, query_words, strip, text
from fathomline.operators.filters import any_query_word, is_pdf, skipped_site
from fathomline.operators.retrieval import ranked
from fathomline.params import DEFAULT, ENFORCEMENT_URL_KEYWORDS, Params

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARSED = (
    "struct<h1:string,og_title:string,title:string,paragraphs:array<struct<text:string,class:string,widget:boolean,entry:boolean>>,ems:array<string>,times:array<string>,metas:map<string,string>,"
    "links:array<struct<href:string,text:string,parent:string>>,rows:array<array<string>>,iframes:array<string>,images:array<string>>"
)


class _Page(HTMLParser):
    """One pass over a page: the texts of telling elements, links with their parent's text, table rows, metas."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = {k: [] for k in ("h1", "title", "p", "em", "time", "a", "tr", "iframe", "img")}
        self.metas: dict[str, str] = {}
        self.stack: list[tuple[str, list[str], dict]] = []
        self.waiting: dict[int, list[list]] = {}  # links by depth, until their parent's text is known
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for kind in ("property", "name", "itemprop"):
                if a.get(kind):
                    self.metas.setdefault(f"{kind}={a[kind]}", a.get("content", ""))
        elif tag == "time" and "datetime" in a:
            self.out["time"].append(a["datetime"])
        elif tag in ("iframe", "img") and a.get("src"):
            self.out[tag].append(a["src"])
        if tag in VOID:
            return
        if tag == "p":
            self._close("p")
        self.skip += tag in ("script", "style")
        self.stack.append((tag, [], a))

    def _close(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while True:
            t, parts, a = self.stack.pop()
            self.skip -= t in ("script", "style")
            words = " ".join("".join(parts).split())
            if t == "a":
                link = [a.get("href", ""), words, len(self.stack)]
                self.out["a"].append(link)
                self.waiting.setdefault(len(self.stack), []).append(link)
            elif t in ("td", "th"):
                row = next((x for x in reversed(self.stack) if x[0] == "tr"), None)
                if row:
                    row[2].setdefault("", []).append(words)
            elif t == "tr":
                self.out["tr"].append(a.get("", []))
            elif t == "p" and words:
                around = {c for x in self.stack if x[0] == "div" for c in x[2].get("class", "").split()}
                self.out["p"].append({"text": words, "class": a.get("class", ""), "widget": "elementor-widget-container" in around, "entry": "entry-content" in around})
            elif t in self.out and t != "time" and words:
                self.out[t].append(words)
            for link in self.waiting.pop(len(self.stack) + 1, ()) if t != "a" else ():
                link[2] = words
            if self.stack and t not in ("script", "style"):
                self.stack[-1][1].append(" " + words + " " if t in ("p", "div", "td", "li", "tr") else "".join(parts))
            if t == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and not self.skip:
            self.stack[-1][1].append(data)

    def parsed(self) -> dict:
        for tag in [t for t, _, _ in self.stack][::-1]:
            self._close(tag)
        o, first = self.out, lambda x: x[0] if x else ""
        return {
            "h1": first(o["h1"]), "og_title": self.metas.get("property=og:title", ""), "title": first(o["title"]), "paragraphs": o["p"], "ems": o["em"], "times": o["time"],
            "metas": self.metas, "links": [{"href": h, "text": t, "parent": p if isinstance(p, str) else t} for h, t, p in o["a"]], "rows": o["tr"],
            "iframes": o["iframe"], "images": o["img"],
        }


def parsed_page(html: Column) -> Column:
    """A struct of what a page holds (:data:`PARSED`); the parsers below are expressions over it."""
    bounded_batches()

    @F.pandas_udf(PARSED)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for html in pages:
                page = _Page()
                page.feed(html or "")
                rows.append(page.parsed())
            yield pd.DataFrame(rows, columns=list(_Page().parsed()))

    return parse(html)


# Metas that may date a page, in this order.
DATE_METAS = ["property=article:published_time", "property=og:published_time", "name=pubdate", "name=publishdate", "name=date", "itemprop=datePublished"]
# What marks paragraphs that are no content.
DISCLAIMERS = ["ram ratings receives compensation", "the credit rating is not a recommendation"]


def page_date(page: Column, content: Column, known: Column, p: Params = DEFAULT) -> Column:
    """DAT08: the known date, else the metas', else that of the first ``<time>`` with a ``datetime``, all as ISO only; else the first date token
    of the content's head, in any form."""
    head = lambda x: dates.iso(F.left(x, F.lit(10)))
    time = head(F.try_element_at(page["times"], F.lit(1)))
    return F.coalesce(head(F.trim(known)), *(head(page["metas"][m]) for m in DATE_METAS), time, dates.parsed(dates.first_token(F.left(content, F.lit(p.date_chars)))))


def rating_detail(page: Column) -> Column:
    """SRC17: ``title`` (h1), ``date`` (first em's first token), ``content``: paragraphs, without those of social boxes and disclaimers."""
    good = lambda x: ~F.contains(F.lower(x["class"]), F.lit("wrapper_social")) & ~contains_any(F.lower(x["text"]), DISCLAIMERS)
    date = dates.parsed(dates.first_token(F.try_element_at(page["ems"], F.lit(1))))
    content = F.array_join(F.transform(F.filter(page["paragraphs"], good), lambda x: x["text"]), "\n\n")
    return F.struct(strip(page["h1"]).alias("title"), date.alias("date"), content.alias("content"))


def article(page: Column) -> Column:
    """SRC19: ``title`` (og, then h1, then title) and ``content``: different paragraphs of widget containers, then of entry contents."""
    title = F.coalesce(*(F.nullif(strip(page[c]), F.lit("")) for c in ("og_title", "h1", "title")), F.lit(""))
    inside = lambda box: F.transform(F.filter(page["paragraphs"], lambda x: x[box]), lambda x: x["text"])
    chosen = F.concat(inside("widget"), inside("entry"))
    lows = F.transform(chosen, F.lower)
    once = F.filter(F.transform(chosen, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lows, F.lower(s["x"])) == s["i"] + 1)
    return F.struct(title.alias("title"), F.array_join(F.transform(once, lambda s: s["x"]), "\n\n").alias("content"))


def search_links(pages: DataFrame, query: str = "query", least_title: int = 8, most: int = 10, enforcement: bool = False, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC13, SRC14: links of result pages (``site``, ``site_pos``, ``base_url``, ``html``): different URLs in site order, at most ten.

    A link's title has eight characters or more, and it or its parent's text holds a query token. With ``enforcement``, only URLs
    of enforcement pages count on a site, if it has any; else all.
    """
    rows = pages.select("*", F.posexplode(parsed_page(F.col("html"))["links"]).alias("link_pos", "_l"))
    rows = rows.withColumns({"url": absolute_url(F.col("base_url"), F.col("_l.href")), "title": F.col("_l.text"), "_parent": F.col("_l.parent")})
    words = query_words(F.col(query))
    rows = rows.filter((F.length("title") >= least_title) & any_or_all_words(F.concat_ws(" ", "title", "_parent"), words)).filter("url != '#'")
    if enforcement:
        rows = rows.withColumn("_e", contains_any(F.lower("url"), ENFORCEMENT_URL_KEYWORDS))
        rows = rows.withColumn("_any", F.max("_e").over(W.partitionBy(*by, "site"))).filter("_e OR NOT _any")
    rows = ranked(rows, [*by, "url"], ["site_pos", "link_pos"], 1, "_turn")
    return ranked(rows, by, ["site_pos", "link_pos"], most, "pos").select(*by, "site", "url", "title", "pos")


def list_items(html: Column) -> Column:
    """SRC16: items of a list fragment: links with the first ``em`` as date and the last ``span`` that isn't a dash as snippet."""
    item = r"(?is)<li\b.*?</li>"

    def read(x: Column) -> Column:
        spans = F.filter(F.transform(F.regexp_extract_all(x, F.lit("(?is)<span[^>]*>(.*?)</span>"), F.lit(1)), clean_html), lambda s: ~s.isin("", "-"))
        return F.struct(
            clean_html(F.regexp_extract(x, r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("title"), F.regexp_extract(x, r"""(?i)<a\b[^>]*href=["']([^"']+)""", 1).alias("url"),
            dates.parsed(clean_html(F.regexp_extract(x, r"(?is)<em[^>]*>(.*?)</em>", 1))).alias("date"), F.coalesce(F.try_element_at(spans, F.lit(-1)), F.lit("")).alias("snippet"),
        )

    return F.filter(F.transform(F.regexp_extract_all(text(html), F.lit(item), F.lit(0)), read), lambda s: s["url"] != "")


def listed_pages(pages: DataFrame, most: int = 10, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC15: items of tabs and pages (``tab``, ``page``, ``html``) in order, each tab up to its first empty page; different URLs, at most ten."""
    rows = pages.withColumn("_items", list_items(F.col("html")))
    empty = F.min(F.when(F.size("_items") == 0, F.col("page"))).over(W.partitionBy(*by, "tab"))
    rows = rows.withColumn("_end", empty).filter(F.col("_end").isNull() | (F.col("page") < F.col("_end")))
    rows = rows.select(*by, "tab", "page", F.posexplode("_items").alias("item", "_i")).select(*by, "tab", "page", "item", "_i.*")
    return ranked(ranked(rows, [*by, "url"], ["tab", "page", "item"], 1, "_turn").drop("_turn"), by, ["tab", "page", "item"], most, "pos")


def table_lines(rows: Column) -> Column:
    """TXT25: table rows as ``key: value`` lines, further cells after bars."""
    full = F.filter(F.transform(rows, lambda r: F.filter(r, lambda c: c != "")), lambda r: F.size(r) > 0)
    more = lambda r: F.concat_ws(" | ", F.slice(r, F.lit(2), F.size(r)))
    return F.array_join(F.transform(full, lambda r: F.when(F.size(r) > 1, F.concat_ws(": ", F.element_at(r, 1), more(r))).otherwise(F.element_at(r, 1))), "\n")


def marked_iframe(page: Column, marker: str) -> Column:
    """TXT24."""
    return F.coalesce(F.try_element_at(F.filter(page["iframes"], lambda s: F.contains(F.lower(s), F.lit(marker))), F.lit(1)), F.lit(""))


def image_urls(page: Column, most: int = 3) -> Column:
    """SRC28: different web images that aren't drawings or data."""
    good = F.filter(page["images"], lambda s: s.rlike("(?i)^https?://") & ~F.lower(s).rlike(r"\.svg(?:[?#]|$)"))
    lows = F.transform(good, F.lower)
    once = F.filter(F.transform(good, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(lows, F.lower(s["x"])) == s["i"] + 1)
    return F.slice(F.transform(once, lambda s: s["x"]), 1, most)


def joined_url(base: Column, href: Column) -> Column:
    """TXT20, the other variant: as browsers join."""

    @F.pandas_udf(T.StringType())
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([urljoin(x or "", y or "") for x, y in zip(b, h, strict=True)], dtype="object")

    return join(base, href)


# What marks a rating announcement's URL.
RATING_SITE = "marc.com.my"
RATING_PATHS = ["/rating-announcements/", "/rating-announcement/"]


def rating_links(pages: DataFrame, base: str, most: int = 30, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC18: ``url`` and ``pos`` of rating announcements on result pages (``html``): links of card headings within articles, or of all card headings
    where no article has one; of the site only, different URLs in either case, at most thirty."""
    bounded_batches()

    @F.pandas_udf("array<struct<inside:boolean,href:string>>")
    def cards(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for html in b:
                page = _Cards()
                page.feed(html or "")
                out.append(page.links)
            yield pd.Series(out, dtype="object")

    rows = pages.select(*by, cards(F.col("html")).alias("_all"))
    inside = F.filter("_all", lambda x: x["inside"])
    rows = rows.select(*by, F.posexplode(F.when(F.size(inside) > 0, inside).otherwise(F.col("_all"))).alias("_i", "_x"))
    rows = rows.withColumn("url", joined_url(F.lit(base + "/"), strip(F.col("_x.href")))).withColumn("_low", F.lower("url"))
    rows = rows.filter((strip(F.col("_x.href")) != "") & F.contains("_low", F.lit(RATING_SITE)) & contains_any(F.col("_low"), RATING_PATHS))
    return ranked(ranked(rows, [*by, "_low"], ["_i"], 1, "_turn"), by, ["_i"], most, "pos").select(*by, "url", "pos")


class _Cards(HTMLParser):
    """Links within card headings, and whether an article is around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.articles = 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self.articles += tag == "article"
        if tag == "h4":
            self.heading = "elementor-heading-title" in a.get("class", "").split()
        elif tag == "a" and self.heading and "href" in a:
            self.links.append({"inside": self.articles > 0, "href": a["href"]})

    def handle_endtag(self, tag: str) -> None:
        if tag == "article":
            self.articles = max(0, self.articles - 1)
        elif tag == "h4":
            self.heading = False


class _Tree(HTMLParser):
    """A page as nodes ``(tag, attributes, children)``; a child is a node or a text. Scripts have no text. Open tags are counted, so a stray end tag costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.open = [self.root]
        self.counts: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        while self.counts.get(tag):
            done = self.open.pop()[0]
            self.counts[done] -= 1
            if done == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.counts.get("script"):
            self.open[-1][2].append(data)


#: Plain text, or a tag of letters and digits with quoted attributes; tags whose content is read otherwise aren't among these.
PLAIN = re.compile(
    r"""([^<&]+)|<(/?)(?!(?:script|style|title|textarea|iframe|xmp|noembed|noframes|noscript|plaintext)\b)([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][a-z0-9_-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*)>""",
    re.I | re.A,
)
ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9_-]*)=(?:'([^']*)'|"([^"]*)")""")


def _tree(html: str) -> tuple:
    """The root of a page's :class:`_Tree`. A page of nothing but :data:`PLAIN` is cut by that pattern, others by the parser, whose steps cost several times as much."""
    page, at = _Tree(), 0
    for m in PLAIN.finditer(html):
        if m.start() != at or m[2] and m[4]:
            break
        at = m.end()
        if m[1]:
            page.handle_data(m[1])
        elif m[2]:
            page.handle_endtag(m[3].lower())
        else:
            page.handle_starttag(m[3].lower(), [(k.lower(), a or b) for k, a, b in ATTRIBUTE.findall(m[4])] if m[4] else [])
    if at < len(html):
        page = _Tree()
        page.feed(html)
    return page.root


def _walk(node: tuple, *tags: str) -> Iterator[tuple]:
    """Nodes below ``node`` in page order; of ``tags`` alone, if given."""
    left = list(reversed(node[2]))
    while left:
        x = left.pop()
        if not isinstance(x, str):
            if not tags or x[0] in tags:
                yield x
            left.extend(reversed(x[2]))


def _words(node: tuple) -> str:
    """The texts below a node, stripped, one a line."""
    parts, left = [], [node]
    while left:
        x = left.pop()
        parts.append(x) if isinstance(x, str) else left.extend(reversed(x[2]))
    lines = "\n".join(y for x in parts if (y := x.strip())).replace("\r\n", "\n").replace("\r", "\n")
    if "\t" in lines or "  " in lines:
        lines = re.sub(r"[ \t]+", " ", lines)
    if "\n" in lines:
        lines = re.sub(r"\n\s*\n+", "\n\n", lines)
    return lines.strip()


def _classes(node: tuple) -> list[str]:
    return node[1].get("class", "").split()


def _row_lines(table: tuple) -> Iterator[str]:
    """A row of a table of changes: two cells as key and value, others by bars; of another table: key and value, further cells on a line by bars."""
    changes = "ven_table" in table[1].get("class", "").lower()
    for tr in _walk(table, "tr"):
        cells = [_words(x) for x in _walk(tr, "th", "td")]
        full = [x for x in cells if x]
        if changes:
            yield (": " if len(full) == 2 else " | ").join(full)
        elif any(cells[:2]):
            yield ": ".join(x for x in cells[:2] if x)
            yield " | ".join(x for x in cells[2:] if x)


def _detail(html: str) -> dict:
    root = _tree(html)
    title = next(map(_words, _walk(root, "h3")), "")
    info = next((x for x in _walk(root, "div") if "ven_announcement_info" in _classes(x)), ("", {}, []))
    pairs = [cells for tr in _walk(info, "tr") if len(cells := [_words(x) for x in _walk(tr, "td")]) > 1]
    labelled = lambda label: next((r[1] for r in pairs if label in r[0].lower() and r[1]), "")
    company = next((_words(x) for x in _walk(root, "td") if "company_name" in _classes(x)), "") or labelled("company name")
    main = next((x for x in _walk(root) if x[1].get("id") == "main"), root)
    lines = [x for x in (title, company) if x]
    places = {id(x): (parent, i) for parent in (main, *_walk(main)) for i, x in enumerate(parent[2]) if not isinstance(x, str) and x[0] == "h4"}
    for h4 in _walk(main, "h4"):
        if name := _words(h4):
            lines += ["", name]
        parent, i = places[id(h4)]
        for x in islice(parent[2], i + 1, None):
            if not isinstance(x, str):
                if x[0] in ("h3", "h4"):
                    break
                lines += filter(None, _row_lines(x)) if x[0] == "table" else ()
    return {"title": title, "company": company, "announced": labelled("date announced"), "text": "\n".join(lines)}


def disclosure_detail(html: Column) -> Column:
    """TXT26, SRC20: ``title`` (the first h3), ``company``, ``source_date`` and ``text`` of a disclosure's page: title, company, then each h4 with the
    rows of the tables that follow it up to the next heading, within the main part if there is one."""
    bounded_batches()

    @F.pandas_udf("struct<title:string,company:string,announced:string,text:string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_detail(page or "") for page in b], columns=["title", "company", "announced", "text"])

    x = read(html)
    date = F.coalesce(dates.parsed(dates.first_token(x["announced"])), dates.parsed(x["announced"]))
    return F.struct(x["title"].alias("title"), x["company"].alias("company"), date.alias("source_date"), clean_block(x["text"]).alias("text"))


def disclosure_documents(details: DataFrame, most: int = 40, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC20: documents of fetched details (``pos``, ``url``, ``html``, ``attachments``: URLs): each page's text, then a placeholder of each attachment
    for the enrichment to fill; pages without text go, forty documents stay."""
    # Pages without text go by having nothing to explode: a filter would be pushed below, and parse each page again.
    rows = details.withColumn("_d", disclosure_detail(F.col("html")))
    page = F.struct(F.col("url").alias("url"), F.col("_d.text").alias("content"), F.lit(False).alias("is_attachment"))
    files = F.transform("attachments", lambda u: F.struct(u.alias("url"), F.lit("").alias("content"), F.lit(True).alias("is_attachment")))
    rows = rows.select(*by, F.col("pos").alias("_page"), F.posexplode(F.when(F.col("_d.text") != "", F.concat(F.array(page), F.coalesce(files, F.filter(F.array(page), lambda x: F.lit(False)))))).alias("_i", "_x"), F.col("_d.title").alias("title"), F.col("_d.company").alias("company"), F.col("_d.source_date").alias("source_date"))
    return ranked(rows.select(*by, "_page", "_i", "title", "company", "source_date", "_x.*"), by, ["_page", "_i"], most, "pos").drop("_page", "_i")


def announcement_ids(c: Column) -> Column:
    """SRC21: different ids in order."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"\bann_id=(\d+)\b"), F.lit(1)))


#: RSS and Atom by Spark's XML parser; entries keep what differs between the two.
TEXT = "struct<_VALUE:string,_type:string>"
ITEM = "array<struct<title:string,link:string,description:string,pubDate:string>>"
FEED = f"channel struct<item:{ITEM}>, item {ITEM}, entry array<struct<title:{TEXT},link:array<struct<_href:string,_rel:string>>,summary:{TEXT},content:{TEXT},published:string,updated:string>>, _corrupt_record string"


def parsed_feed(xml: Column) -> Column:
    """Entries of an RSS or Atom document: structs ``title``, ``link``, ``summary``, ``published``; none of a document that isn't XML.

    Elements with a prefix are extensions and don't count. An Atom link is the first that isn't for another purpose than the entry itself.
    """
    x = F.from_xml(F.nullif(F.trim(xml), F.lit("")), FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "valueTag": "_VALUE", "inferSchema": "false"})
    of = lambda title, link, summary, at: F.struct(title.alias("title"), link.alias("link"), summary.alias("summary"), at.alias("published"))
    rss = lambda items: F.transform(items, lambda e: of(e["title"], e["link"], e["description"], e["pubDate"]))
    own = lambda links: F.get(F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    atom = F.transform(x["entry"], lambda e: of(e["title"]["_VALUE"], own(e["link"]), F.coalesce(e["summary"]["_VALUE"], e["content"]["_VALUE"]), F.coalesce(e["published"], e["updated"])))
    none = F.filter(rss(x["item"]), lambda e: F.lit(False))
    found = F.concat(*(F.coalesce(e, F.array().cast("array<struct<title:string,link:string,summary:string,published:string>>")) for e in (rss(x["channel"]["item"]), rss(x["item"]), atom)))
    return F.when(x["_corrupt_record"].isNull(), found).otherwise(F.coalesce(none, F.array().cast("array<struct<title:string,link:string,summary:string,published:string>>")))


def feed_entries(feeds: DataFrame, query: str = "query", p: Params = DEFAULT, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC09: entries of feeds (``feed_pos``, ``xml``): of each the first thirty, those that match the query, the first ten of all. Damaged feeds give none."""
    rows = feeds.withColumn("_entries", parsed_feed(F.col("xml")))
    rows = rows.select(*by, query, "feed_pos", F.posexplode(F.slice("_entries", 1, p.feed_entries)).alias("entry", "_e"))
    rows = rows.select(*by, query, "feed_pos", "entry", clean_html(F.col("_e.title")).alias("title"), F.trim("_e.link").alias("url"), clean_html(F.col("_e.summary")).alias("content"),
                       F.coalesce(dates.parsed(F.left("_e.published", F.lit(10))), dates.parsed(dates.first_token(F.col("_e.published")))).alias("source_date"))
    rows = rows.filter(any_query_word(F.concat_ws(" ", "title", "content"), query_words(F.col(query)), 1, F.col(query)))
    return ranked(rows, by, ["feed_pos", "entry"], p.source_results, "pos")


def archive_hits(hits: DataFrame, per_index: int = 50, most: int = 50, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """SRC10: index records with status 200, different URLs; caps of each index and of all, in order of ``index_pos``, ``pattern_pos``, ``hit``."""
    order = ["index_pos", "pattern_pos", "hit"]
    rows = ranked(hits.filter(F.col("status") == "200"), [*by, "url"], order, 1, "_turn").drop("_turn")
    rows = ranked(rows, [*by, "index_pos"], order, per_index, "_turn").drop("_turn")
    return ranked(rows, by, order, most, "pos")


def archive_documents(records: DataFrame, extract: Callable[[str], str], least: int = 100, most: int = 15000, wanted: int = 0, order: Sequence[str] = ("url",)) -> DataFrame:
    """SRC11, SRC12: records (``url``, ``timestamp``, gzip ``body``) as documents: headers off, main text by ``extract``, title and date.

    A record that can't be read gives no document, and no failure. With ``wanted``, the first so many documents in ``order`` stay, each task
    keeping no more than that; unlike a race of fetches, reruns agree.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["url", "timestamp", "html", "content"]
        for b in batches:
            rows, size = [], 0
            for r in b.itertuples():
                try:
                    html = gzip.decompress(r.body).decode("utf-8", "replace").split("\r\n\r\n", 2)[-1]
                    rows.append((r.url, r.timestamp, html, extract(html) or ""))
                except (OSError, EOFError, TypeError):
                    continue
                size += len(html) + len(rows[-1][-1])
                if size > BATCH_BYTES:  # unpacked, records are many times their batch
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    bounded_batches(records.sparkSession)
    rows = records.select("url", "timestamp", "body").mapInPandas(read, "url string, timestamp string, html string, content string")
    t = F.col("timestamp")
    date = dates.iso(F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    title = F.left(collapse(F.regexp_extract("html", r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(200))
    rows = rows.filter(F.length("content") >= least)
    rows = rows.select("url", title.alias("title"), F.left("content", F.lit(most)).alias("content"), date.alias("source_date"))
    return rows.orderBy(*order).limit(wanted) if wanted else rows


def enriched(docs: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]], extract: Callable[[str], str], pdf_text: Callable[[bytes], str], p: Params = DEFAULT) -> DataFrame:
    """SRC29, SRC27: documents with the text behind their URL, where they are short and it can be had.

    Documents without a URL, of skipped sites, or long enough pass through, and never reach Python's fetch. ``fetch`` returns status,
    content type and bytes; a failure leaves the document as it was. PDF texts need 50 characters, others 100.
    """
    wanted = (text(F.col("url")) != "") & (F.col("url") != "#") & ~skipped_site(F.col("url")) & (F.length(text(F.col("content"))) <= p.content_enough)

    bounded_batches()

    @F.pandas_udf("struct<kind:string,body:string>")
    def got(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for url in urls:
                try:
                    status, kind, body = fetch(url) if url else (0, "", b"")
                    pdf = "application/pdf" in kind.lower() or re.search(r"\.pdf(?:[?#]|$)", url, re.I)
                    rows.append((kind, (pdf_text(body) if pdf else extract(body.decode("utf-8", "replace"))) if status == 200 else None))
                except Exception:  # any failure of one page leaves its document alone
                    rows.append((None, None))
            yield pd.DataFrame(rows, columns=["kind", "body"])

    asked = docs.filter(wanted).withColumn("_g", got(F.col("url")))
    least = F.when(is_pdf(F.col("_g.kind"), F.col("url")), p.pdf_min).otherwise(p.content_min)
    new = F.when(F.length(strip(F.col("_g.body"))) >= least, F.left(strip(F.col("_g.body")), F.lit(p.content_max)))
    dated = F.coalesce(dates.iso(F.col("source_date")), dates.parsed(dates.first_token(F.left(new, F.lit(p.date_chars)))))
    asked = asked.withColumns({"content": F.coalesce(new, "content"), "snippet": F.coalesce(F.left(new, F.lit(p.snippet_chars)), "snippet"), "source_date": F.coalesce(dated.cast("string"), "source_date")})
    return asked.drop("_g").unionByName(docs.filter(~wanted))
