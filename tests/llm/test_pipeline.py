"""The pipeline's stages, each on what the one before kept."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm.shared import cut


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(cut(stage(spark, kept[-1], data), f"test-{k}"))
    language, near, scanned, mixed, packed = kept[1:]
    assert all(x.columns == docs.columns for x in kept[:-1])
    assert language.count() >= 0.99 * docs.count()
    assert near.select("doc_id").distinct().count() == near.count() < language.count()
    assert scanned.count() == near.count()
    assert not [r for r in scanned.collect() if re.search(r'token = "?[0-9a-f]{12,}', r["text"])]
    sizes = {r["source"]: 0 for r in mixed.collect()}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in scanned.collect())
    assert abs(sum(sizes.values()) - total) <= 3 * len(sizes)
    assert packed.groupBy().sum("length").first()[0] == sum(r["n"] for r in packed.selectExpr("doc_id", "start", "doc_tokens n").filter("start = 0").collect())
    assert len(corpus_pipeline.STAGES) == 5


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, data):
    """The documents with NULLs in every column, empty, blank and long texts, repeated rows and ids, and columns with clashing names."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.orderBy("doc_id").first()["text"]
    rows = [
        (900_001, None, "en", "a", 0), (900_002, "", "en", "a", 0), (900_003, " \n ", None, None, None), (None, text, "en", "a", 1), (900_004, text, "en", None, 1), (900_004, text, "en", None, 1),
        (900_005, (text + " ") * 400, "en", "hot", 1), (900_006, "12 34 !!", "en", "a", 1), (900_007, "token = abcdefgh12345678", "en", "a", 24), (900_007, "another text under the same number", "en", "a", 1),
    ]
    extra = ("k", "n", "h", "s", "t", "row", "size", "block", "shard", "component_id", "score", "rejected", "lang_pred", "base", "spans", "_text", "_best", "mix_shard_id")
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA)).withColumns({c: F.lit(1) for c in extra})


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_on_odd_rows(request, spark, data, which):
    """Each stage works on what the one before kept: columns stay, nothing clean goes, and an empty table passes through."""
    docs = request.getfixturevalue("odd") if which == "odd" else spark.createDataFrame([], SCHEMA)
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(cut(stage(spark, kept[-1], data), f"odd-{which}-{k}"))
        if k < 4:
            assert kept[-1].columns == docs.columns
    if which == "none":
        assert [df.count() for df in kept] == [0] * 6
        return
    language, near, scanned, mixed, packed = kept[1:]
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    # Texts that are NULL or without a letter have no language; all others of it stay, repeats too.
    gone = ids(docs) - ids(language)
    assert {900_001, 900_002, 900_003, 900_006} <= gone.keys() and ids(language)[900_004] == 2 and ids(language)[900_007] == 2
    # One document of each group of copies stays, and a different text under a known number is a document of its own.
    texts = Counter(r["text"] for r in near.select("text").collect())
    assert max(texts.values()) == 1 and ids(near)[900_007] == 2 and ids(near)[900_004] == 0
    assert ids(scanned) == ids(near) and not scanned.filter("text LIKE '%abcdefgh12345678%'").count()
    assert set(ids(mixed)) <= set(ids(scanned)) and mixed.filter("text IS NULL OR n_chars <> length(text)").count() == 0
    assert set(ids(packed)) == set(ids(mixed)) and packed.filter("length < 1").count() == 0
