"""Incremental ingest: batches of documents into the store, with the seen URLs and candidates as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathomline.functions.text import strip, text
from fathomline.operators.dedupe import with_embeddings
from fathomline.operators.joins import unseen
from fathomline.operators.retrieval import ranked
from fathomline.params import DEFAULT, UNRANKED_SOURCES, Params
from fathomline.sources.stores import DocumentStore, SeenUrls


def routed(docs: DataFrame, official: Column, rerank: Callable[[DataFrame], DataFrame], p: Params = DEFAULT, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """SNK06, SNK07: documents to index, by seed: official ones, then those of unranked sources, then the others as ``rerank`` orders them.

    Where reranking keeps none of a seed's others, they stay as they came. Short contents go; forty stay. ``order`` numbers them.
    """
    kind = F.when(official, 0).when(F.col("source").isin(*UNRANKED_SOURCES), 1).otherwise(2)
    rows = docs.filter(F.length(strip(F.col("content"))) >= p.min_content).withColumn("_kind", kind).withColumn("order", F.col("pos"))
    others = rows.filter("_kind = 2")
    best = rerank(others)
    left = others.join(best.select(*by).distinct(), list(by), "left_anti")
    every = rows.filter("_kind < 2").unionByName(best, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    return ranked(every, by, ["_kind", "order"], p.max_index_docs, "_order").drop("order", "_kind").withColumnRenamed("_order", "order")


def ingest(docs: DataFrame, store: DocumentStore, seen: SeenUrls, embed, stamp: dict[str, str], strict: bool = False) -> int:
    """STR01, STR02: one batch: unseen documents are stamped, embedded and appended, and their URLs join the seen ones; their number.

    The seen URLs are written after the documents, so a batch that fails between is repeated and not lost. The anti-join comes
    before the embedding. ``strict`` also drops repeats inside the batch.
    """
    known = seen.read()
    fresh = unseen(docs, known, strict, ("order",)).withColumns({k: F.lit(v) for k, v in stamp.items()})
    fresh = with_embeddings(fresh, embed).persist()
    try:
        n = fresh.count()
        if n:
            store.append(fresh)
            seen.add(fresh)
    finally:
        fresh.unpersist()
    return n


def stream_documents(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """STR01: runs ``handle`` on each micro-batch of what is there, then ends; the checkpoint remembers where."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_distinct(stream: DataFrame, key: str, out: str, checkpoint: str):
    """STR02: rows whose key wasn't met before in any run over this checkpoint."""
    rows = stream.filter(text(F.col(key)) != "").dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def planned_items(priority: DataFrame, queries: DataFrame, seeds: DataFrame, batch: int, seed: int, p: Params = DEFAULT) -> DataFrame:
    """STR04: the next items: queries of priority entities, latest entity first, base query first, eight each; then a seeded draw of the others.

    Queries are many times what a plan takes them for when they are expanded from names, so the joins sort both sides and broadcast none. Only the
    first ``batch`` rows of either kind are numbered.
    """
    first = priority.select(F.col("name").alias("seed"), "promoted_at", F.col("pos").alias("entity_pos")).hint("merge")
    mine = ranked(queries.join(first, "seed"), ["seed"], [F.desc("is_base"), "suffix_pos"], p.priority_queries, "_turn")
    turn = [F.desc("promoted_at"), "entity_pos", "_turn", "seed"]
    mine = mine.orderBy(*turn).limit(batch).withColumn("order", F.row_number().over(W.orderBy(*turn)))
    mine = mine.select("seed", "expanded", "order").withColumn("_kind", F.lit(0))
    rest = seeds.join(first, "seed", "left_anti").join(queries.hint("merge"), "seed")
    rest = rest.select("seed", "expanded", F.xxhash64(F.lit(seed), "expanded").alias("order")).orderBy("order", "expanded", "seed").limit(batch).withColumn("_kind", F.lit(1))
    return mine.unionByName(rest).orderBy("_kind", "order").limit(batch).drop("_kind")


def cached(cache: DataFrame, now: Column, ttl_seconds: int, enabled: bool = True) -> DataFrame:
    """AGG21: entries that are young enough and not empty; none when the cache is off."""
    if not enabled or ttl_seconds <= 0:
        return cache.limit(0)
    age = F.unix_timestamp(now) - F.unix_timestamp("saved_at")
    return cache.filter((age <= ttl_seconds) & (F.size("docs") > 0))


def windowed_counts(events: DataFrame, ts: str, length: str, lateness: str, *keys: str) -> DataFrame:
    """Counts by event-time window, for streams and tables alike; rows later than ``lateness`` are dropped by a stream."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))
