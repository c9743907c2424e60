"""The whole plan of a search: from company names to scored, cited profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import clean_document, sentence_chunks
from fathomline.operators.dedupe import greedy_near_duplicates, keep_best_per_url
from fathomline.operators.filters import has_content
from fathomline.operators.rank import by_recency, model_scores, rerank, select_chunks, with_fallback
from fathomline.operators.retrieval import ranked, retrieved, vector_top_k
from fathomline.params import DEFAULT, Params


def candidate_documents(store: DataFrame, vectors: Sequence[Sequence[float]], p: Params = DEFAULT, id_col: str = "doc_id") -> DataFrame:
    """Stages 3 and 4 (SRC04, SRC08, AGG01, AGG03): the documents nearest to each vector, best per URL, without near-duplicates."""
    hits = retrieved(vector_top_k(store, vectors, p.retrieval_limit, id_col), p).withColumn("pos", F.col("rank"))
    return greedy_near_duplicates(keep_best_per_url(hits), p=p)


def top_documents(docs: DataFrame, as_of: Column, score: Callable, p: Params = DEFAULT) -> DataFrame:
    """Stages 5 and 6 (FLT03, FLT04, ORD04, ORD01, ORD05)."""
    cap = 3 * p.max_docs
    rows = ranked(has_content(docs), ["query_id"], ["order"], cap, "_turn").drop("_turn").withColumn("content", clean_document(F.col("content")))
    best = by_recency(rerank(model_scores(rows, score, p=p), p=p), as_of, p=p)
    return with_fallback(best, rows, p.top_results)


def chunks(docs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Stage 7 (TXT09): sentence chunks of each document, ordered by document and place."""
    parts = F.posexplode(sentence_chunks(F.col("content"), p.split_sentences, p.split_overlap)).alias("chunk", "_text")
    rows = docs.select("*", parts).withColumn("content", F.col("_text")).drop("_text")
    return ranked(rows, ["query_id"], ["order", "chunk"], name="_order").drop("order").withColumnRenamed("_order", "order")


def best_chunks(docs: DataFrame, as_of: Column, score: Callable, p: Params = DEFAULT) -> DataFrame:
    """Stages 7 and 8 (TXT09, FLT01, ORD06)."""
    return select_chunks(model_scores(chunks(docs, p), score, p=p), as_of, p=p)
