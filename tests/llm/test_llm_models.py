"""Clustering, divergence audit and quality classifier against brute force, and their edge cases."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import clustering, divergence, quality, queries
from fathomline.llm.langid import held_out

DOCS = "doc_id long, text string, lang string, source string"
INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty, blank and long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, "Alpha beta-gamma alpha", "en", "a"), (1, "Alpha beta-gamma alpha", "en", "a"), (2, "alpha BETA gamma2delta", "en", "b"), (3, "", "en", "c"), (4, None, None, None),
        (None, " \n ", "en", "c"), (5, "été Été été x alpha", "fr", "a"), (6, "été Été x", "fr", "b"), (7, "été und x", "fr", None), (8, "alpha " * 60_000, "en", "b"),
        (9, "x" * 300_000, "fr", "a"), (10, "😀 ünd 😀 ÜND", "fr", ""),
    ]
    extra = ("n", "term", "slice", "a", "b", "v", "of", "t", "h", "k", "y", "turn", "score", "predicted", "quality", "total", "p", "part", "value", "rank")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in extra})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------------------------------------------------------------- clusters
def lloyd(rows, k, rounds, size, scale):
    """All vectors against all centroids, in plain integers."""
    kept = [(i, [int(np.floor(np.float64(c) * scale)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = np.array([v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            for j in set(own.tolist()):
                c[j] = x[own == j].sum(0) // (own == j).sum()
    best = d.min(1)
    sums = np.bincount(own, best, len(c)).astype(int)
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return [(i, int(o), int(e), int(sums[o]), int(best.sum()), names[o]) for (i, _), o, e in zip(kept, own, best, strict=True)]


def same_rows(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_clusters_equal_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    same_rows(clustering.cluster(df).collect(), lloyd([(r["vec_id"], r["embedding"]) for r in df.collect()], 16, 3, 64, 64))


@pytest.mark.parametrize("k", [1, 3, 5, 50])
def test_clusters_odd_vectors(spark, k):
    """NULLs, other lengths, values that aren't finite, repeated rows and keys, ties, and more centroids than vectors."""
    rows = [(i, [float(i % 7), float(-(i % 5))]) for i in range(40)] + [(3, [3.0, -3.0]), (3, [9.0, 9.0]), (None, [1.0, 1.0]), (50, None), (51, [1.0]), (52, [1.0, None]), (53, [NAN, 1.0]), (54, [INF, 1.0]), (55, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("v", "cluster", "upper", "lower", "distance")})
    same_rows(clustering.cluster(df, k, 3, 2, 2).collect(), lloyd(rows, k, 3, 2, 2))


def test_clusters_without_vectors(spark):
    got = clustering.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    renamed = clustering.cluster(spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "v string, e array<double>"), 1, 1, 1, 1, key="v", vector="e")
    assert sorted((r["v"], r["distance"]) for r in renamed.collect()) == [("x", 0), ("y", 1)]


def test_assign_keeps_bounds_and_saves_distances():
    """On vectors in groups most centroids are never looked at; bounds hold after each round, and equal distances go to the smaller number."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (24, 8))
    x = (centres[rng.integers(0, 24, 4000)] + rng.integers(-6, 7, (4000, 8))).astype(np.int64)
    c = np.concatenate([x[:23], x[:1]])  # two equal centroids
    own, upper, lower, stats = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)), {}
    for _ in range(5):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own, upper, lower = clustering.assign(x, own, upper, lower, c, stats)
        assert (own == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), own])).all()
        d[np.arange(len(x)), own] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(d.min(1).astype(float))).all()
        moved = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
        shift = np.sqrt(((moved - c) ** 2).sum(1))
        upper, lower, c = upper + shift[own] * (1 + 1e-12), lower - np.array([np.delete(shift, j).max() for j in range(len(c))])[own], moved
    assert stats["distances"] < 0.4 * stats["all"]


# -------------------------------------------------------------------------------------------------------------------- divergence
def divergences(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least)
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if t in set(kept))
        every = Counter(t for c in count.values() for t in c.elements())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (every[t] + 1) // (every.total() + len(kept)) for t in kept}
        for s in p:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                found += [(lang, s, part, name, -v, i) for i, (v, _, name) in enumerate(items, 1)]
    return found


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("which", ["data", "odd", "none"])
def test_divergence_equals_brute_force(request, spark, data, monkeypatch, which, small):
    """Also with many slices, parts and blocks, counters and buffers that go out early, and pair sums in small steps."""
    if small:
        for name, value in (("SLICE", 50), ("PART", 4000), ("BLOCK", 300), ("HELD_TERMS", 100), ("HELD_BYTES", 2000), ("PAIRS", 7)):
            monkeypatch.setattr(divergence, name, value)
    df = spark.read.parquet(f"{data}/documents.parquet") if which == "data" else request.getfixturevalue(which)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    for least in (3,) if which == "data" else (1, 3):
        same_rows(divergence.audit(df, least).collect(), divergences(rows, least))


def test_occurrences_are_whole_terms():
    got = divergence.occurrences(["a", "aa", "b a", "ü"], [("s", " a aa a  ab a "), ("t", " ü üa "), ("s", " a ")])
    assert got == {"s": {"a": 4, "aa": 1}, "t": {"ü": 1}} and divergence.occurrences([], [("s", " a ")]) == {}


def test_probabilities_are_exact(spark):
    rows = [(c, n, v) for c, n, v in itertools.product([0, 1, 10**6, 10**12], [10**12, 10**15, 1], [1, 7, 10**9]) if c <= n]
    got = divergence._probability(spark.createDataFrame(rows, "c long, n long, v long"), "p", "c", "n", "v").collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"]) for r in got)


# ----------------------------------------------------------------------------------------------------------------------- quality
def test_counts_do_not_depend_on_pieces(monkeypatch):
    texts = [b"", b"a", "été été, A!!  b\nb b\tc ".encode() * 50, b"x" * 500, b"ab ab " * 100, b" lead and trail "]
    whole = [quality.counts(t) for t in texts]
    assert whole[2][-2] == 2 * 50 and whole[4][-2] == 199 and quality.counts(b"a a a")[-2:].tolist() == [2, 0]
    for size in (1, 3, 50):
        monkeypatch.setattr(quality, "PIECE", size)
        for t, w in zip(texts, whole, strict=True):
            assert (quality.counts(t) == w).all()


@pytest.fixture(scope="module")
def fitted(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.train(docs, labels)


def test_scores_equal_brute_force(fitted):
    """Every vector against every neighbour, one by one, in integers."""
    docs, _, model = fitted
    neighbours, k = model.vectors.astype(int).tolist(), round(len(model.labels) ** 0.5 / 2)
    got = {r["doc_id"]: r["score"] for r in quality.predict(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(150).collect():
        v = model.place(r["text"].encode()).astype(int).tolist()
        like = [sum(map(int.__mul__, v, w)) for w in neighbours]
        near = sorted(range(len(like)), key=lambda i: (-like[i], i))[:k]
        weights = [max(like[i], 0) for i in near]
        assert got[r["doc_id"]] == sum(w * int(model.labels[i]) for w, i in zip(weights, near, strict=True)) / sum(weights)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = quality.predict(docs.filter(held_out()), model).join(labels, "doc_id").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 8 and sum(good) == len(good) and sum(bad) <= 0.25 * len(bad)
    low, high = (max(r["score"] for r in rows if r["quality"] == 0), min(r["score"] for r in rows if r["quality"] == 1))
    assert low < high


def test_learns_only_from_rows_that_are_not_held_out(fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, turned)
    assert (again.vectors == model.vectors).all() and (again.labels == model.labels).all() and len(model.labels) <= docs.join(labels, "doc_id").filter(~held_out()).count()


@pytest.mark.parametrize("which", ["odd", "none"])
def test_quality_of_odd_rows(request, spark, which):
    df = request.getfixturevalue(which)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (4, 0, None), (6, None, 1), (8, 0, 0), (None, 1, 1), (77, 1, 1), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.rate(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) <= 1
    nothing = quality.rate(df, labels.limit(0)).collect()
    assert all((r["score"], r["predicted"]) == (0.5, 1) for r in nothing) and len(nothing) == df.count()


# --------------------------------------------------------------------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, data), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    same_rows(df.select(columns).collect(), sql.select(*columns).fetchall())
