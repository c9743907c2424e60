"""Golden literals of scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.functions import dates, scores
from fathomline.functions import json as js
from fathomline.functions import text as tx
from fathomline.operators import filters


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: tx.collapse(F.lit("  a  b\t\nc ")), "a b c"),
        (lambda: tx.collapse(F.lit(None)), ""),
        (lambda: tx.clean_block(F.lit("a\r\nb \t c\n\n\n\nd ")), "a\nb c\n\nd"),
        (lambda: tx.contains_phrase(F.lit("Abc  Def"), F.lit("c d")), True),
        (lambda: tx.contains_phrase(F.lit("x"), F.lit(" ")), True),
        (lambda: tx.lookup_key(F.lit("Maybank Berhad")), "maybank"),
        (lambda: tx.lookup_key(F.lit("Shadow Bhds")), "s ow s"),
        (lambda: tx.entity_name(F.lit(' " A  b" ')), "A b"),
        (lambda: tx.query_words(F.lit("The café of naïve dan ab")), ["café", "naïve"]),
        (lambda: tx.clean_html(F.lit("<p>a &amp;lt; b</p>&nbsp;&#8211;")), "a < b -"),
        (lambda: tx.claims(F.lit("Short. This one is long enough. And so is this one too?"), 10, 20), ["This one is long enough.", "And so is this one too?"]),
        (lambda: tx.to_full_sentence(F.lit("One. Two! thr")), "One. Two!"),
        (lambda: tx.to_full_sentence(F.lit("no end")), "no end"),
        (lambda: tx.strip_preface(F.lit(" Here is the snapshot : here is  it")), "it"),
        (lambda: tx.title_case(F.lit("o'neil 3com abc-def")), "O'Neil 3Com Abc-Def"),
        (lambda: tx.website_name(F.lit("https://www.the-star.com.my/a")), "The Star"),
        (lambda: tx.website_name(F.lit("https://Example.org")), "Example"),
        (lambda: tx.diversity_domain(F.lit("http://www.A.com:80/x")), "A.com:80"),
        (lambda: tx.diversity_domain(F.lit("not a url")), ""),
        (lambda: tx.absolute_url(F.lit("https://a/"), F.lit("x")), "https://a/x"),
        (lambda: tx.absolute_url(F.lit("https://a/"), F.lit("//b/x")), "https://b/x"),
        (lambda: tx.absolute_url(F.lit("https://a/"), F.lit(None)), "#"),
        (lambda: tx.query_id(F.lit("http://a/?prviewId=12x"), "prviewid", "prviewId"), ""),
        (lambda: tx.sentence_chunks(F.lit("A. B. C. D. E."), 3, 1), ["A. B. C.", "C. D. E."]),
        (lambda: tx.sentence_chunks(F.lit(""), 3, 1), []),
        (lambda: tx.without_fences(F.lit(" ```JSON\n{}\n``` ")), "{}"),
        (lambda: tx.without_fences(F.lit("{}")), "{}"),
        (lambda: tx.listed_queries(F.lit("- a\n* b\nqueries: x\n[")), ["a", "b"]),
        (lambda: js.is_object(F.lit('{"a": "}"}')), True),
        (lambda: js.is_object(F.lit("{a")), False),
        (lambda: dates.iso(F.lit("2024-02-30")), None),
        (lambda: dates.iso(F.lit("2024-02-29T10")), datetime.date(2024, 2, 29)),
        (lambda: dates.iso(F.lit("1899-12-31")), None),
        (lambda: dates.iso(F.lit("2101-01-01")), None),
        (lambda: dates.parsed(F.lit("29/02/2023")), None),
        (lambda: dates.parsed(F.lit("1 Sept 2024")), datetime.date(2024, 9, 1)),
        (lambda: dates.parsed(F.lit("Jan 5, 2024")), datetime.date(2024, 1, 5)),
        (lambda: dates.parsed(F.lit("5 Abc 2024")), None),
        (lambda: dates.first_token(F.lit("1/2/2020 then 2021-03-04")), "2021-03-04"),
        (lambda: dates.first_token(F.lit("none")), None),
        (lambda: scores.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), 0.0),
        (lambda: scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))), 0.0),
        (lambda: scores.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 0.0),
        (lambda: filters.valid_entity(F.lit("the of")), False),
        (lambda: filters.skipped_site(F.lit("https://netflix.com")), True),
    ],
)
def test_value(spark, made, want):
    assert value(spark, made()) == want


@pytest.mark.parametrize(("text", "want"), [('a {"x": "}{"} b', '{"x": "}{"}'), ("{ {", ""), ("", ""), (None, ""), ('{"a": "\\"}"} }', '{"a": "\\"}"}')])
def test_first_object(spark, text, want):
    assert value(spark, js.first_object(F.lit(text).cast("string"))) == want
