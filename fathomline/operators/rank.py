"""Orders, caps and fallbacks of retrieved documents. All within ``by``, which starts with the query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathomline.functions import dates
from fathomline.functions.scores import clamp01, decay, sigmoid
from fathomline.functions.text import diversity_domain, for_search, strip, text
from fathomline.operators.filters import prefer_phrase
from fathomline.operators.retrieval import ranked
from fathomline.params import DEFAULT, Params
from fathomline.sources.folders import shuffled


def recency_score(base: Column, date: Column, as_of: Column, confidence: Column, p: Params = DEFAULT) -> Column:
    """ORD01: ``(base + weight * decay(age)) * (1 - cache + cache * confidence)``; no date, no bonus; no confidence, factor 1."""
    bonus = F.coalesce(decay(F.datediff(as_of, date), p.recency_days) * p.recency_weight, F.lit(0.0))
    factor = F.coalesce(clamp01(confidence) * p.cache_weight + (1 - p.cache_weight), F.lit(1.0))
    return (base + bonus) * factor


def by_recency(docs: DataFrame, as_of: Column, by: Sequence[str] = ("query_id",), order: str = "order", p: Params = DEFAULT) -> DataFrame:
    """ORD01: adds ``adjusted`` and numbers documents anew in ``order``."""
    indexed = F.col("indexed_at") if p.carry_index_meta else F.lit(None)
    confidence = F.col("profile_confidence") if p.carry_index_meta else F.lit(None).cast("double")
    base = F.coalesce("relevance_score", "score", F.lit(0.0))
    rows = docs.withColumn("adjusted", recency_score(base, dates.best_date(F.col("source_date"), indexed), as_of, confidence, p))
    return ranked(rows, by, [F.desc("adjusted"), order], name="_order").drop(order).withColumnRenamed("_order", order)


def prefer_names(docs: DataFrame, names: str = "names", by: Sequence[str] = ("query_id",), order: str = "order") -> DataFrame:
    """ORD03: by the number of different names in the document; without any hit the order stays."""
    hay = for_search(F.concat_ws(" ", *(text(F.col(c)) for c in ("title", "snippet", "content"))))
    keys = F.filter(F.array_distinct(F.transform(names, for_search)), lambda n: n != "")
    rows = docs.withColumn("name_hits", F.size(F.filter(keys, lambda n: F.contains(hay, n))))
    return ranked(rows, by, [F.desc("name_hits"), order], name="_order").drop(order).withColumnRenamed("_order", order)


def model_scores(docs: DataFrame, score_fn, query: str = "query", p: Params = DEFAULT) -> DataFrame:
    """Adds ``logit`` of query and the head of each content that is long enough; ``score_fn`` takes two lists of texts."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in batches:
            yield pd.Series(score_fn(q.tolist(), c.tolist()), dtype="float64")

    rows = docs.filter(F.length(strip(F.col("content"))) >= p.min_content)
    return rows.withColumn("logit", scores(text(F.col(query)), F.left(F.col("content"), F.lit(p.rerank_chars))))


def rerank(docs: DataFrame, by: Sequence[str] = ("query_id",), order: str = "order", p: Params = DEFAULT) -> DataFrame:
    """ORD04: the best documents by model score, with a penalty for repeated domains at the top.

    ``logit`` becomes a score, scores below the gate go, the rest are sorted. Of the first five, those of a domain met before
    lose a tenth; then they are sorted again and the first ten stay.
    """
    score = sigmoid(F.col("logit")) if p.score_is_logit else F.col("logit")
    rows = docs.filter(F.length(strip(F.col("content"))) >= p.min_content).withColumn("relevance_score", score)
    rows = rows.filter(F.col("relevance_score") >= p.min_relevance).withColumn("_domain", diversity_domain(F.col("url")))
    rows = ranked(rows, by, [F.desc("relevance_score"), order], name="_rank")
    # Only the first rows can lose, so their domains' ordinals are all that is needed.
    met = F.row_number().over(W.partitionBy(*by, "_domain").orderBy("_rank"))
    again = (F.col("_rank") <= p.diverse_top) & (text(F.col("url")) != "") & (met > 1)
    rows = rows.withColumn("_again", again).withColumn(
        "relevance_score", F.when(F.col("_again"), F.col("relevance_score") * p.diversity_penalty).otherwise(F.col("relevance_score"))
    )
    rows = ranked(rows, by, [F.desc("relevance_score"), "_rank"], p.top_results, "_order")
    return rows.drop(order, "_rank", "_again", "_domain").withColumnRenamed("_order", order)


def with_fallback(chosen: DataFrame, otherwise: DataFrame, most: int, by: Sequence[str] = ("query_id",), order: str = "order") -> DataFrame:
    """ORD05: the first ``most`` chosen documents of each query; where none was chosen, of the others."""
    rest = otherwise.join(chosen.select(*by).distinct(), list(by), "left_anti")
    both = chosen.unionByName(rest, allowMissingColumns=True)
    return ranked(both, by, [order], most, "_turn").drop("_turn")


def select_chunks(chunks: DataFrame, as_of: Column, by: Sequence[str] = ("query_id",), order: str = "order", p: Params = DEFAULT) -> DataFrame:
    """ORD06: phrase filter, candidate cap, reranking, recency, final cap; the candidates themselves where nothing passes."""
    candidates = ranked(prefer_phrase(chunks, by=by, p=p), by, [order], p.chunk_candidates, "_turn").drop("_turn")
    return with_fallback(by_recency(rerank(candidates, by, order, p), as_of, by, order, p), candidates, p.max_docs, by, order)


def context_block(entities: DataFrame, relations: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """ORD07: ``context``: persons and organisations by score, and relations, those that touch ``company`` first, as lines."""
    e = entities.filter((text(F.col("name")) != "") & F.upper("type").isin("PERSON", "ORG"))
    e = ranked(e, by, [F.desc(F.coalesce("score", F.lit(0.0))), "pos"], p.context_entities)
    line = F.format_string("- %s: %s | score=%.2f", F.trim("type"), F.trim("name"), F.coalesce("score", F.lit(0.0)))
    e = e.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("e"))
    company = F.lower(F.trim(text(F.col("company"))))
    direct = (company != "") & (F.contains(F.lower("source"), company) | F.contains(F.lower("target"), company))
    r = relations.filter((text(F.col("source")) != "") & (text(F.col("target")) != "") & (text(F.col("relationship_type")) != ""))
    r = ranked(r, by, [F.desc(direct.cast("int")), F.desc(F.coalesce("confidence", F.lit(0.0))), "pos"], p.context_relations)
    line = F.format_string(
        "- %s --[%s]--> %s | confidence=%.2f", F.trim("source"), F.trim("relationship_type"), F.trim("target"), F.coalesce("confidence", F.lit(0.0))
    )
    r = r.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("r"))
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit("\n"))) for c, head in (("e", "ENTITIES:\n"), ("r", "RELATIONSHIPS:\n"))]
    block = F.concat_ws("\n", *parts)
    return e.join(shuffled(r), list(by), "full").select(*by, F.when(block == "", "none").otherwise(block).alias("context"))
