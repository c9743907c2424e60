"""Places of matches, mentions and their contexts against Python's own search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathomline.functions import places
from fathomline.functions.places import match_places, phrase_places
from fathomline.operators import mentions
from fathomline.params import Params

TEXTS = ["", None, "aaaa", "Aa aA\naa", "x aa", "😀aa😀 aa", "a.a*a", "\\E\\Q a", "ÄÖ äö ÄÖ", "aa" * 200]


def test_places(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = {(r["id"], r["start"], r["end"]) for r in match_places(df, ["id"], "t", F.lit("(?i)aa")).collect()}
    assert got == {(i, m.start(), m.end()) for i, t in enumerate(TEXTS) for m in re.finditer("aa", t or "", re.I)}
    for phrase in ("aa", "a", "äö", "a.a", "\\E", "\\Q", "zz", "aaa"):
        got = {(r["id"], r["start"]) for r in phrase_places(df, ["id"], "t", F.lit(phrase)).collect()}
        assert got == {(i, m.start()) for i, t in enumerate(TEXTS) for m in re.finditer(f"(?={re.escape(phrase)})", t or "", re.I)}, phrase


def context(text, name, keywords, w):
    words = re.findall("[a-z0-9]+", name.lower())
    found = list(re.finditer(r"\b" + r"[\s\W]+".join(words) + r"\b", text, re.I)) if words else []
    keys = [" ".join(k.lower().split()) for k in keywords if k and k.strip()]
    return len(found), sum(any(k in text[max(0, m.start() - w) : m.end() + w].lower() for k in keys) for m in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_equal_a_search(spark, seed):
    """Windows cut by the ends of texts, keywords that touch, overlap or hold the mention, hot texts with hundreds of mentions."""
    rng = random.Random(seed)
    words = ["acme", "Corp", "loan", "bank", "x", "loans", "ACME", ".", "\n", "é", "a_b"]
    docs = [(q, i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 400]))), f"u{rng.randrange(4)}" + " " * rng.randrange(2)) for q in (0, 1) for i in range(15)] + [(0, 99, None, "u")]
    names = [(q, n, r, k) for q in (0, 1) for n, r, k in (("Acme Corp", "customer", ["loan", " Bank "]), ("acme", "high_risk", ["p l", "oa"]), ("  ", "customer", ["x"]), ("corp.", "guarantor", [" ", ""]), ("é", "guarantor", ["x"]), ("acme", "customer", ["a_b acme", "LOAN"]))]
    d = spark.createDataFrame(docs, "query_id int, doc_index int, content string, url string").withColumns({c: F.lit("") for c in ("title", "source", "source_date")})
    n = spark.createDataFrame(names, "query_id int, name string, role string, keywords array<string>")
    p = Params(window_chars=12, min_context=0)
    got = {(r["query_id"], r["name"], r["role"]): (r["mentions"], r["context_hits"], [e["url"] for e in r["evidence"]]) for r in mentions.scored_candidates(d, n, p=p).collect()}
    want = {}
    for q, name, role, keys in names:
        counts = [(i, url, *context(t or "", name, keys, 12)) for g, i, t, url in docs if g == q]
        counts = [c for c in sorted(counts) if c[2]]
        if counts:
            first = {}
            for _, url, _, _ in counts:
                first.setdefault(url.strip(), url)
            want[q, name, role] = (sum(c[2] for c in counts), sum(c[3] for c in counts), list(first.values()))
    assert got == want and len(want) >= 6


@pytest.mark.parametrize("sizes", [(1, 1), (5, 2), (1_024, 256)])
def test_windows_stay_with_their_text(spark, monkeypatch, sizes):
    """any sizes of pieces and runs give what a search gives, nothing is shuffled, and time is linear in mentions."""
    monkeypatch.setattr(mentions, "PIECE", sizes[0])
    monkeypatch.setattr(places, "RUN", sizes[1])
    texts = ["😀aa x loan", "aa" + "é" * 9 + "loan aa", "a", "", None, "loan" + "😀" * 5 + "aA.Aa " * 30, "aa aa aa lo an", "aa loan aa loan aa"]
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "id int, content string, name string").withColumns({"role": F.lit("r"), "keywords": F.array(F.lit(" LOAN"), F.lit(" "))})
    hits = mentions.context_hits(df, ["id", "name", "role"], Params(window_chars=9))
    want = {i: context(t or "", "aa", ["loan"], 9)[1] for i, t in enumerate(texts)}
    assert {r["id"]: r["hits"] for r in hits.collect()} == {i: n for i, n in want.items() if n} and sum(want.values()) > 3
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    if sizes[0] > 5:
        long = df.limit(1).withColumn("content", F.repeat(F.lit("aa, loan "), 50_000))
        assert mentions.context_hits(long, ["id", "name", "role"]).first()["hits"] == 50_000


def test_only_texts_with_all_words_are_searched(spark):
    """The cheap test lets every text through that the pattern takes, letters that fold to ASCII ones too."""
    rows = [("Skill İx ıx", "skill"), ("ſKill", "skill"), ("İx", "ix"), ("ıX", "ix"), ("the OF", "of the"), ("nothing", "of the"), ("x", "..")]
    df = spark.createDataFrame(rows, "t string, n string").select(mentions.may_mention(mentions.folded(F.col("t")), F.col("n")).alias("may"), (mentions.mention_count(F.col("t"), F.col("n")) > 0).alias("does"))
    got = [tuple(r) for r in df.collect()]
    assert all(may or not does for may, does in got) and [does for _, does in got] == [True, True, True, True, False, False, False] and not got[5][0]
