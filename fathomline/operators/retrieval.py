"""Vector scans over document stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from fathomline.functions.scores import distance_score
from fathomline.functions.text import strip, text
from fathomline.params import DEFAULT, Params


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, most: int | None = None, name: str = "rank") -> DataFrame:
    """Numbers rows from 1 within ``by``. With ``most``, Spark keeps that many of each task before the shuffle."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.filter(F.col(name) <= most)


def numbered(df: DataFrame, order: Sequence, name: str = "pos") -> DataFrame:
    """Numbers all rows from 1 in ``order`` without gathering them: a range sort, places within its parts, and the sizes of the parts before.

    The sorted rows are kept, so that sizes and places speak of the same parts; what is broadcast has a row a part.
    """
    rows = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).persist()
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("_part", before.alias("_before"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return rows.join(F.broadcast(parts), "_part").withColumn(name, at.cast("long")).drop("_part", "_at", "_before")


def distances_to(queries: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    """Squared distances of a vector to each query, NULL for vectors that are NULL, hold NULL or have another length: one matrix step a batch."""
    of = [np.asarray(q, float) for q in queries]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def distances(vectors: pd.Series) -> pd.Series:
        out = np.full((len(vectors), len(of)), np.nan)
        sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for n in {len(q) for q in of}:
            rows = np.flatnonzero(sizes == n)
            if len(rows):
                x = np.array(vectors.iloc[rows].tolist(), float).reshape(len(rows), n)
                for i, q in enumerate(of):
                    if len(q) == n:
                        out[rows, i] = ((x - q) ** 2).sum(1)
        return pd.Series([[None if np.isnan(d) else d for d in r] for r in out])

    return distances


def vector_top_k(store: DataFrame, queries: Sequence[Sequence[float]], k: int, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """SRC04: the ``k`` nearest rows (1 at least) by squared distance for each query vector, ties by id: ``query_id``, ``distance``, ``rank`` and all columns.

    Query vectors are the caller's few: one scan scores them all by Arrow batches of vectors and ids, and each task keeps its best. Other columns
    come back by a join of the ids found, so they are read for the hits alone. An empty vector finds nothing. Ids are unique.
    """
    asked = [(i, q) for i, q in enumerate(queries) if len(q)]
    if not asked:
        return store.limit(0).select(F.lit(0).alias("query_id"), F.lit(0.0).alias("distance"), "*", F.lit(0).alias("rank"))
    scored = store.select(id_col, F.posexplode(distances_to([q for _, q in asked])(F.col(vector))).alias("_at", "distance"))
    number = F.element_at(F.array(*(F.lit(i) for i, _ in asked)), F.col("_at") + 1)
    best = ranked(scored.select(number.alias("query_id"), "distance", id_col), ["query_id"], [F.asc_nulls_last("distance"), id_col], max(1, k))
    # The hits' number is the caller's: k for each of the queries.
    return store.join(F.broadcast(best), id_col).select("query_id", "distance", *store.columns, "rank")


def multi_store_top_k(stores: Sequence[DataFrame], query: Sequence[float], k: int, id_col: str = "doc_id") -> DataFrame:
    """SRC05: the best ``k`` of all stores' best ``k``, one for each URL and stripped content, of the earliest store."""
    found = [
        vector_top_k(s, [query], k, id_col).withColumn("store_id", F.lit(i)) for i, s in enumerate(stores)
    ]
    hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    one = ranked(hits.withColumn("_content", strip(F.col("content"))), ["url", "_content"], ["store_id", "rank"], 1, "_turn").drop("_turn", "_content")
    return ranked(one.withColumnRenamed("rank", "store_rank"), ["query_id"], ["distance", "store_id", "store_rank"], max(1, k))


def retrieved(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """SRC08: hits as documents: contents of 50 characters or more, a score from the distance, defaults for missing fields."""
    rows = hits.filter(F.length(strip(F.col("content"))) >= p.min_content)
    or_else = lambda c, default: F.coalesce(F.nullif(text(F.col(c)), F.lit("")), default)
    return rows.withColumns({
        "url": or_else("url", F.lit("#")), "title": or_else("title", F.lit("Cached")), "source": or_else("source", F.lit("Database")),
        "snippet": or_else("snippet", F.left(F.col("content"), F.lit(p.snippet_chars))), "score": distance_score(F.coalesce("distance", F.lit(1.0))),
        "is_from_db": F.lit(True), "relevance_score": F.col("relevance_score") if "relevance_score" in hits.columns else F.lit(None).cast("double"),
    })


def expanded_queries(queries: DataFrame, suffixes: Sequence[str], most: int, col: str = "query", by: Sequence[str] = ()) -> DataFrame:
    """ARR01, ARR02, AGG16: each query alone and with each suffix, the first ``most`` of each; different ones by lower case, first wins.

    ``queries`` has ``pos``, its order. ``by`` are columns within which queries must differ; without any, all must.
    """
    every = F.slice(F.array(*(F.lit(s) for s in ["", *suffixes])), 1, most)
    rows = queries.select("*", F.posexplode(every).alias("suffix_pos", "suffix")).withColumn(
        "expanded", F.regexp_replace(F.trim(F.concat_ws(" ", F.trim(col), "suffix")), r"(?U)\s+", " ")
    )
    rows = rows.filter("expanded != ''").withColumn("_key", F.lower("expanded"))
    return ranked(rows, [*by, "_key"], ["pos", "suffix_pos"], 1, "_turn").drop("_turn", "_key", "suffix")


def store_count(stores: Sequence[DataFrame]) -> DataFrame:
    """SRC07."""
    return reduce(DataFrame.union, [s.select(F.lit(1).alias("x")) for s in stores]).agg(F.count("*").alias("documents"))
