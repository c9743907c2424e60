"""String and URL expressions. All take and return columns and stay in the JVM; NULL counts as the empty string unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.params import ENGLISH_STOPWORDS, MALAY_STOPWORDS, NOTE_DROP_TOKENS


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: Unicode white space, what ``(?U)\s`` stands for.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; only the ends are looked at, not each run inside as by a pattern."""
    return F.trim(text(c), F.lit(WHITE))


def collapse(c: Column) -> Column:
    """TXT01: runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clean_block(c: Column) -> Column:
    """TXT02: one kind of line end, single blanks, at most one blank line in a row."""
    s = F.regexp_replace(F.regexp_replace(text(c), "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(s, r"\n\s*\n+", "\n\n"))


def contains_phrase(c: Column, phrase: Column) -> Column:
    """TXT03: collapsed, lower-cased containment; an empty phrase is in everything."""
    return F.contains(F.lower(collapse(c)), F.lower(collapse(phrase)))


# What a lookup key loses, in this order, wherever it stands.
KEY_SUFFIXES = ["berhad", "bhd", "had", "plc", "limited", "ltd", "sdn", "bhds", "sdn bhd"]


def lookup_key(c: Column) -> Column:
    """TXT04: lower case, letters and digits only, without company suffixes (cut from inside words too)."""
    s = collapse(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]+", " "))
    for suffix in KEY_SUFFIXES:
        s = F.replace(s, F.lit(suffix), F.lit(" "))
    return collapse(s)


def entity_name(c: Column) -> Column:
    """TXT05: collapsed, without one quote at either end."""
    return collapse(F.regexp_replace(collapse(c), '^"|"$', ""))


def entity_key(c: Column) -> Column:
    return lookup_key(entity_name(c))


def query_words(c: Column, least: int = 3, stopwords: Sequence[str] | None = None) -> Column:
    """TXT06: different lower-case words of ``least`` characters or more, without stopwords, in order."""
    stop = ENGLISH_STOPWORDS + MALAY_STOPWORDS if stopwords is None else stopwords
    words = F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(rf"(?U)\b\w{{{least},}}\b"), F.lit(0)))
    return F.array_except(words, F.array(*(F.lit(w) for w in stop)))


def query_tokens(c: Column, least: int = 3, drop: Sequence[str] = NOTE_DROP_TOKENS) -> Column:
    """TXT07: different runs of ``[a-z0-9]``, first ones first, without dropped tokens."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(rf"[a-z0-9]{{{least},}}"), F.lit(0)))
    return F.array_except(found, F.array(*(F.lit(w) for w in drop)))


# Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#8211;", "-"), ("&#8212;", "-")]


def clean_html(c: Column) -> Column:
    """TXT08: without tags, with eight entities decoded in turn, collapsed."""
    s = F.regexp_replace(text(c), "<[^>]+>", "")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return collapse(s)


SENTENCE = r"(?<=[.?!])\s+"


def sentence_chunks(c: Column, size: int = 100, overlap: int = 20) -> Column:
    """TXT09: chunks of ``size`` sentences that share ``overlap`` with the one before; no chunk lies within another."""
    step = size - overlap

    def cut(parts: Column) -> Column:
        last = F.greatest(F.ceil((F.size(parts) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
        chunk = lambda i: F.array_join(F.slice(parts, i * step + 1, size), " ")
        return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), last), chunk)).otherwise(F.array().cast("array<string>"))

    # A lambda's variable holds the sentences, so the text is split once and not for each chunk.
    parts = F.filter(F.split(text(c), SENTENCE), lambda x: x != "")
    return F.element_at(F.transform(F.array(parts), cut), 1)


def clean_document(c: Column) -> Column:
    """TXT10: without empty lines and extra white space."""
    lines = F.transform(F.split(text(c), "\n"), lambda x: collapse(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def claims(c: Column, most: int = 10, least: int = 20) -> Column:
    """TXT11: sentences of ``least`` characters or more, the first ``most`` (all, if that is 0 or less)."""
    found = F.filter(F.transform(F.split(collapse(c), SENTENCE), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return F.slice(found, 1, most) if most > 0 else found


def evidence_text(c: Column, most: int = 1500) -> Column:
    """TXT12: the head of the stripped text, collapsed. Empty texts stay, so places agree."""
    return collapse(F.left(strip(c), F.lit(most)))


def to_full_sentence(c: Column) -> Column:
    """TXT13: up to the last sentence end, if there is one."""
    s = strip(c)
    return F.when(s.rlike("[.?!]"), F.regexp_extract(s, r"(?s)^(.*[.?!])", 1)).otherwise(s)


# Openings that are stripped, in this order.
PREFACES = [
    r"the requested narrative snapshot\s*:\s*", r"the requested output\s*:\s*", r"requested output\s*:\s*", r"here is the narrative snapshot\s*:\s*",
    r"here is the snapshot\s*:\s*", r"here is\s+",
]


def strip_preface(c: Column) -> Column:
    """TXT14."""
    s = strip(c)
    for opening in PREFACES:
        s = F.regexp_replace(s, rf"(?i)^\s*{opening}", "")
    return strip(s)


def authority(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital, also after digits, quotes and hyphens."""
    letters = F.regexp_extract_all(text(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def website_name(url: Column) -> Column:
    """TXT15: the telling label of the host, in title case; a host of one label as it is."""
    host = F.regexp_replace(F.lower(authority(url)), r"^www\.", "")
    parts = F.split(host, r"\.")
    second = F.try_element_at(parts, F.lit(-2))
    label = F.when(second.isin("com", "gov", "org", "net", "co"), F.try_element_at(parts, F.lit(1))).otherwise(second)
    return F.when(F.size(parts) >= 2, title_case(F.translate(label, "-_", "  "))).otherwise(host)


def citation_chain(source: Column, from_store: Column, original: Column, website: Column) -> Column:
    """TXT16: ``Database`` with the original source, or the source; then the website unless one name holds the other."""
    source, original, website = text(source), text(original), text(website)
    a, b = F.replace(F.lower(website), F.lit(" "), F.lit("")), F.replace(F.lower(source), F.lit(" "), F.lit(""))
    apart = (website != "") & ~F.contains(b, a) & ~F.contains(a, b)
    head = F.when(from_store, F.concat_ws(" - ", F.lit("Database"), F.nullif(original, F.lit("")))).otherwise(source)
    return F.concat_ws(" - ", head, F.when(apart, website))


def diversity_domain(url: Column) -> Column:
    """TXT17: the host with its port, every ``www.`` cut; the empty string is a domain too."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def url_patterns(query: Column, most: int = 2) -> Column:
    """TXT18: the words joined by hyphens, and run together."""
    q = F.lower(collapse(query))
    hyphen, joined = F.regexp_replace(F.replace(q, F.lit(" "), F.lit("-")), "^-+|-+$", ""), F.replace(q, F.lit(" "), F.lit(""))
    return F.slice(F.filter(F.array_distinct(F.array(hyphen, joined)), lambda x: x != ""), 1, most)


def html_title(html: Column, most: int = 200) -> Column:
    """TXT19."""
    return F.left(collapse(F.regexp_extract(text(html), r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(most))


def absolute_url(base: Column, href: Column) -> Column:
    """TXT20: ``#`` for a missing link; protocol-relative, root-relative and other links get what they lack."""
    base, href = F.regexp_replace(base, "/+$", ""), text(href)
    return (
        F.when(href == "", "#").when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(F.concat(base, F.lit("/"), href))
    )


def query_id(url: Column, *names: str) -> Column:
    """TXT21: the first named query parameter that the URL has, if it is a number; else empty."""
    values = [F.nullif(F.try_parse_url(strip(url), F.lit("QUERY"), F.lit(n)), F.lit("")) for n in names]
    value = strip(F.coalesce(*values))
    return F.when(value.rlike("^[0-9]+$"), value).otherwise("")


def built_url(base: str, path: str = "", **parameters: Column | str) -> Column:
    """TXT22: ``base`` and ``path`` with encoded query parameters, in the order given."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in parameters.items()]
    return F.concat(F.lit(base.rstrip("/") + path + ("?" if pairs else "")), F.concat_ws("&", *pairs))


def attachment_links(hrefs: Column, keywords: Sequence[str], most: int = 20) -> Column:
    """TXT23: links that end in ``.pdf`` or hold a keyword; different ones, sorted."""
    low = lambda h: F.lower(h)
    hit = lambda h: F.endswith(F.regexp_replace(low(h), r"[?#].*$", ""), F.lit(".pdf")) | contains_any(low(h), keywords)
    return F.slice(F.array_sort(F.array_distinct(F.filter(hrefs, hit))), 1, most)


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def without_parentheses(c: Column) -> Column:
    """TXT29."""
    return F.regexp_replace(text(c), r"\s*\(.*?\)", "")


def without_possessive(c: Column) -> Column:
    """TXT30: no possessive ending and no quotes around the name."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"['’]s\b", ""), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


def for_search(c: Column) -> Column:
    """TXT31: lower case, collapsed."""
    return F.lower(collapse(c))


def without_urls(c: Column) -> Column:
    # The pattern is slow, and most texts have neither start.
    some = F.contains(F.lower(text(c)), F.lit("http")) | F.contains(F.lower(text(c)), F.lit("www."))
    return F.when(some, F.regexp_replace(text(c), r"(?i)https?://\S+|www\.\S+", "")).otherwise(text(c))


def escaped_html(c: Column) -> Column:
    s = text(c)
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def document_fields(content: Column, snippet: Column, most: int = 300) -> tuple[Column, Column]:
    """TXT32: ``(content, snippet)``: the snippet's head, and the content or, failing that, the snippet."""
    return F.coalesce(F.nullif(text(content), F.lit("")), text(snippet)), F.left(text(snippet), F.lit(most))


def meaningful(c: Column) -> Column:
    """FLT14: no placeholder, three characters or more."""
    s = F.trim(text(c))
    return ~F.lower(s).isin("", "-", "n/a", "na", "none", "null", "not identified", "unknown", "no") & (F.length(s) >= 3)


def without_fences(c: Column) -> Column:
    """JSN04: the body of a fenced block; other texts as they are."""
    s = F.regexp_replace(text(c), r"(?U)^\s+", "")
    body = F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?[\r\n]*", ""), r"(?s)^(.*)```.*$", "$1")
    return F.when(F.startswith(s, F.lit("```")), strip(body)).otherwise(text(c))


def listed_queries(c: Column) -> Column:
    """JSN05: the strings of a ``"queries": [...]`` list; without one, the lines less bullets and structure."""
    inner = F.regexp_extract(text(c), r'(?is)"queries"\s*:\s*\[(.*?)\]', 1)
    quoted = F.filter(F.transform(F.regexp_extract_all(inner, F.lit('"([^"]+)"'), F.lit(1)), strip), lambda x: x != "")
    lines = F.transform(F.split(text(c), r"[\r\n]+"), lambda x: strip(F.regexp_replace(strip(x), r"^[-•*]\s*", "")))
    heading = lambda x: F.contains(F.lower(x), F.lit("queries")) & F.contains(x, F.lit(":"))
    plain = F.filter(lines, lambda x: (x != "") & ~heading(x) & ~x.rlike(r"^[{}\[\]]"))
    return F.when(F.size(quoted) > 0, quoted).otherwise(plain)


def any_or_all_words(c: Column, words: Column) -> Column:
    """Whether any of ``words`` is in the text; true without words."""
    low = F.lower(text(c))
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(low, w))
