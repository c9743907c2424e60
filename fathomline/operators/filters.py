"""Predicates and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathomline.functions.text import collapse, contains_any, contains_phrase, for_search, query_tokens, strip, text
from fathomline.params import DEFAULT, INTERNAL_META, NAME_STOPWORDS, PDF_URL_KEYWORDS, SKIP_DOMAINS, Params


def prefer_phrase(docs: DataFrame, phrase: str = "query", by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """FLT01: documents that hold the query's phrase in title, snippet or content; all of them if none does or it is short."""
    hay = F.concat_ws("\n", *(text(F.col(c)) for c in ("title", "snippet", "content")))
    long = F.length(collapse(F.col(phrase))) >= p.phrase_min_chars
    rows = docs.withColumn("_hit", long & contains_phrase(hay, F.col(phrase)))
    return rows.withColumn("_any", F.max("_hit").over(W.partitionBy(*by))).filter("_hit OR NOT _any").drop("_hit", "_any")


def high_risk_others(items: Column, query: Column, customer: Column, p: Params = DEFAULT) -> Column:
    """FLT02: items with a name that isn't the query's, nor the customer's or, if long enough, its beginning."""
    q, c = for_search(query), for_search(customer)

    def other(x: Column) -> Column:
        n = for_search(x["name"])
        start = (F.length(n) >= p.self_min_chars) & F.startswith(c, n)
        return x.isNotNull() & (n != "") & (n != q) & (n != c) & ~start

    return F.filter(items, other)


def has_content(docs: DataFrame) -> DataFrame:
    """FLT03."""
    return docs.filter(text(F.col("content")) != "")


def is_pdf(content_type: Column, url: Column) -> Column:
    """FLT05."""
    low = F.lower(text(url))
    path = F.regexp_replace(low, r"[?#].*$", "")
    return F.contains(F.lower(text(content_type)), F.lit("application/pdf")) | F.endswith(path, F.lit(".pdf")) | contains_any(low, PDF_URL_KEYWORDS)


def skipped_site(url: Column) -> Column:
    """FLT06: by substring, so ``x.com`` is found in longer names too."""
    return contains_any(F.lower(text(url)), SKIP_DOMAINS)


def any_query_word(c: Column, words: Column, least: int = 1, phrase: Column | None = None) -> Column:
    """FLT07: the whole phrase, or ``least`` different words, as substrings; no words match all but empty texts nothing."""
    low = F.lower(text(c))
    hit = F.size(F.filter(words, lambda w: F.contains(low, F.lower(w)))) >= least
    if phrase is not None:
        full = F.lower(strip(phrase))
        hit = hit | ((full != "") & F.contains(low, full))
    return (strip(c) != "") & ((F.size(words) == 0) | hit)


def query_token_match(query: Column, title: Column, content: Column, least: int = 1) -> Column:
    """FLT08: the phrase, or ``least`` tokens at the beginning of words; no tokens match all."""
    q, hay = F.lower(strip(query)), F.lower(F.concat_ws(" ", text(title), text(content)))
    tokens = query_tokens(q)
    found = F.size(F.filter(tokens, lambda t: F.regexp_like(hay, F.concat(F.lit(r"(?U)\b"), t)))) >= least
    return (q == "") | F.contains(hay, q) | (F.size(tokens) == 0) | found


def rating_note(content: Column) -> Column:
    """FLT09."""
    low = F.lower(text(content))
    has = lambda s: F.contains(low, F.lit(s))
    return (
        has("marc ratings") | low.rlike(r"\bmarc-\d\b") | low.rlike(r"\bmarc[-\s]?1\b") | (low.rlike(r"\baaa\b") & has("rating"))
        | has("financial institution ratings") | (has("withdrawn") & has("ratings"))
    )


def challenge_page(html: Column) -> Column:
    """FLT10."""
    return contains_any(F.lower(text(html)), ["<title>just a moment", "cdn-cgi/challenge-platform", "cf_chl_opt"])


def disclosure_page(html: Column) -> Column:
    """FLT10."""
    return contains_any(F.lower(text(html)), ['id="main"', "ven_announcement_info", "company_name"])


def valid_entity(name: Column) -> Column:
    """FLT11: two characters or more, and not only stopwords."""
    s = strip(name)
    words = F.split(F.lower(s), r"\s+")
    rest = F.array_except(words, F.array(*(F.lit(w) for w in NAME_STOPWORDS)))
    return (s != "") & (s != "-") & (F.length(s) >= 2) & (F.size(rest) > 0)


def models_in_order(models: DataFrame) -> DataFrame:
    """FLT12: enabled models; the default ones, then built-in ones, then custom ones, each by name."""
    tier = F.when(F.col("is_default"), 0).when(~F.col("is_custom"), 1).otherwise(2)
    return models.filter("enabled").orderBy(tier, "name")


def merged_models(default: DataFrame, custom: DataFrame) -> DataFrame:
    """JSN07: models by ``model_id``; an enabled custom one takes the default one's place, a disabled one is passed over. NULL ``enabled`` is enabled."""
    own = custom.filter(F.coalesce("enabled", F.lit(True)))
    return default.join(own.select("model_id"), "model_id", "left_anti").unionByName(own.select(*default.columns))


def parsed_limit(raw: Column, default: int) -> Column:
    """FLT13: a struct ``limit``, ``status``: the default for none at all, a number of digits alone, else no limit and 400."""
    s = strip(raw)
    good = F.when(raw.isNull(), F.lit(default).cast("long")).when(s.rlike("^[0-9]+$"), s.try_cast("long"))
    return F.struct(good.alias("limit"), F.when(good.isNull(), 400).otherwise(200).alias("status"))


def output_meta(meta: Column) -> Column:
    """FLT15, FLT16: a map without NULLs and internal keys."""
    return F.map_filter(meta, lambda k, v: v.isNotNull() & ~k.isin(*INTERNAL_META))


def worth_saving(profiles: DataFrame) -> DataFrame:
    """FLT17: profiles with a snapshot, a party or a high-risk item."""
    named = lambda c: F.coalesce(F.col(c).isNotNull() & (F.to_json(c) != "{}"), F.lit(False))
    return profiles.filter((text(F.col("snapshot")) != "") | named("customer") | named("corporate_guarantor") | (F.size("high_risk_entities") > 0))
