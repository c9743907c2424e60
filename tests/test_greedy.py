"""The parallel greedy choice against the fold in order that it stands for."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fathomline.operators import dedupe
from fathomline.operators.greedy import first_independent


def folded(items, like):
    kept = []
    for x in items:
        if not any(like(x, k) for k in kept):
            kept.append(x)
    return kept


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("seed", "share"), [(1, 0.5), (2, 0.85), (3, 0.3)])
def test_equals_the_fold(spark, seed, share):
    """Sets that drift, so that likeness forms chains, in groups of very different sizes; some rows have no tokens."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i:02}" for i in range(40)]
    for g, n in ((0, 150), (1, 30), (2, 1), (None, 20)):
        own = set(rng.sample(words, 12))
        for i in range(n):
            own = (own - set(rng.sample(sorted(own), min(len(own), rng.randrange(0, 3))))) | set(rng.sample(words, rng.randrange(0, 3)))
            rows.append((g, i * 3 + 1, sorted(own) if rng.random() > 0.03 else []))
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "g int, o long, t array<string>")
    like = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= share
    stats = {}
    got = {tuple(r) for r in first_independent(df, ["g"], "o", "t", share, like, stats=stats).select("g", "o").collect()}
    want = set()
    for g in (0, 1, 2):
        own = [(o, set(t)) for h, o, t in rows if h == g]
        want |= {(g, o) for o, t in own if not t} | {(g, o) for o, _ in folded([x for x in own if x[1]], lambda x, k: jaccard(x[1], k[1]) >= share)}
    assert got == want and stats["rounds"] >= 1


def test_a_group_of_near_copies_costs_its_tokens(spark):
    """3,000 near copies of one text: the first takes out all others, and no pairs among them are made."""
    base = [f"word{i:03}" for i in range(60)]
    rows = spark.range(3000).select(F.col("id").alias("o"), F.lit(1).alias("g"), F.array_sort(F.concat(F.array(*map(F.lit, base)), F.array(F.concat(F.lit("z"), F.col("id").cast("string"))))).alias("t"))
    stats = {}
    like = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.85
    kept = first_independent(rows, ["g"], "o", "t", 0.85, like, stats=stats).collect()
    assert [r["o"] for r in kept] == [0] and stats == {"rounds": 1, "met": 2999, "edges": 0}


def test_near_duplicates(spark, data):
    docs = [(r["doc_id"] % 3, r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs += [(0, 9001, None), (0, 9002, ""), (0, 9003, "a b"), (1, 9004, docs[1][2]), (1, 9005, docs[1][2].upper())]
    df = spark.createDataFrame(docs, "query_id int, order long, content string").withColumns({c: F.lit(1) for c in ("_o", "_a", "_token", "item")})
    out = dedupe.greedy_near_duplicates(df)
    assert out.columns == df.columns
    words = lambda t: frozenset(re.findall(r"\b[a-z0-9]{3,}\b", (t or "")[:2000].lower()))
    want = set()
    for q in range(3):
        own = sorted((o, words(t)) for g, o, t in docs if g == q)
        want |= {o for o, w in folded(own, lambda x, k: bool(x[1]) and bool(k[1]) and jaccard(x[1], k[1]) >= 0.85)}
    assert {r["order"] for r in out.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_entities(spark, seed):
    """Names a few edits apart, ties of score, repeated and blank names, any characters."""
    rng = random.Random(seed)
    stems, rows = ["maybank berhad", "acme holdings", "zürich été", "a", "bb", "x" * 30, "tan sri 😀 lim"], []
    for i in range(160):
        name = list(rng.choice(stems))
        for _ in range(rng.randrange(0, 5)):
            name[rng.randrange(len(name))] = rng.choice("abcé x")
        name = "".join(name)
        rows.append((i % 2, rng.choice([name, name.title(), name.upper() if "ü" not in name else name]), rng.choice(["ORG", "PERSON"]), rng.choice([0.5, 0.9, rng.random()]), i))
    rows += [(0, None, "ORG", 1.0, 900), (0, "", "ORG", 1.0, 901), (0, "Acme", None, 1.0, 902), (0, "Acme", "", 1.0, 903)]
    got = {r["pos"] for r in dedupe.distinct_entities(spark.createDataFrame(rows, "query_id int, name string, type string, score double, pos int")).collect()}
    want = set()
    for q in (0, 1):
        for t in ("ORG", "PERSON"):
            own = sorted((r for r in rows if r[0] == q and r[2] == t and (r[1] or "").strip(" ")), key=lambda r: (-r[3], r[4]))
            want |= {r[4] for r in folded(own, lambda x, k: SequenceMatcher(None, x[1].lower(), k[1].lower()).ratio() > 0.75)}
    assert got == want
    assert dedupe.distinct_entities(spark.createDataFrame([], "query_id int, name string, type string, score double, pos int")).count() == 0
