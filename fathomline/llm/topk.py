"""Exact top-k by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut, tidy

#: Vectors of a candidate block and of a query block.
BLOCK, QUERIES = 16_384, 2_048
#: Queries that read lists together; a list is read on by this part of its length; reads between looks at the bounds, as a share of all lists.
TOGETHER, STEP, LOOK = 32, 2, 8
#: Rows of a query whose lower bounds are looked at.
BEST = 128
#: Slots of query blocks of one dimension: pairs of blocks meet by slot, not by dimension alone.
SLOTS = 64


class Lists:
    """A block of vectors with a sorted list of its rows for each component."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.rows = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.x.T, self.rows, axis=1))


def top_k(lists: Lists, q: np.ndarray, q_ids: np.ndarray, k: int, stats: dict[str, int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of the best ``k`` rows with another id, ties to the smaller id; no random access until the end.

    Each list is read in order, by each query from the end where its products are greatest. Of a row, products that were read are
    known; each other one lies between the product of the last value read from its list and that of the list's other end. A read changes
    the sums of the rows that it or an earlier one of its list met, and nothing else: ``high`` holds, for each row and query, its
    known products less the upper list bounds that they replace. The list whose bounds lie farthest apart is read next. Now and then,
    lower bounds are taken of the :data:`BEST` rows of the greatest upper bounds, and rows whose upper bound is below the ``k``-th best of
    them go: they can't qualify any more. When few are left for every query, or the lists end, scores of those left are resolved. All arithmetic is on integers, held in floats where they are exact
    there. ``stats`` counts entries ``read`` of ``all`` and rows ``resolved`` of ``rows``, over queries.
    """
    (n, d), m = lists.x.shape, len(q)
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T  # by component, then query: what reads from the greatest and the least value on
    least, most = (lists.values[:, 0], lists.values[:, -1]) if n else (np.zeros(d, q.dtype), np.zeros(d, q.dtype))
    top_up, top_down = most[:, None] * up, least[:, None] * down  # of the next read, at most
    end_up, end_down = least[:, None] * up, most[:, None] * down  # of the other end
    high, last_up, last_down = np.zeros((n, m), q.dtype), most.copy(), least.copy()
    left, depth, reads, step = lists.ids[:, None] != q_ids[None, :], np.zeros(d, np.int64), 0, max(1, -(-n // STEP))
    apart = (top_up + top_down - end_up - end_down).max(1, initial=0)
    none = np.iinfo(np.int64).min // 4 if q.dtype == np.int64 else -np.inf
    while apart.any() and left.sum(0).max(initial=0) > max(4 * k, n // 64):
        for _ in range(max(1, d // LOOK)):
            j = int(apart.argmax())
            s, e = int(depth[j]), min(n, int(depth[j]) + step)
            last_up[j], last_down[j] = lists.values[j, n - e], lists.values[j, e - 1]
            for rows, values, before, last, product, top in (
                (lists.rows[j, n - e : n - s], lists.values[j, n - e : n - s], lists.rows[j, n - s :], last_up[j], up[j], top_up),
                (lists.rows[j, s:e], lists.values[j, s:e], lists.rows[j, :s], last_down[j], down[j], top_down),
            ):
                bound = last * product
                if s:
                    high[before] += top[j] - bound
                high[rows] += (values - last)[:, None] * product
                top[j] = bound
            depth[j], reads = e, reads + 1
            apart[j] = 0 if e == n else (top_up[j] + top_down[j] - end_up[j] - end_down[j]).max()
            if not apart.any():
                break
        # No row can go while bounds are farther apart than rows are from one another.
        if not ((top_up + top_down - end_up - end_down).sum(0) < high.max(0) - high.min(0)).any():
            continue
        upper = np.where(left, high + (top_up + top_down).sum(0), none)
        best = np.argpartition(np.ascontiguousarray(upper.T), n - min(max(BEST, k), n), axis=1)[:, n - min(max(BEST, k), n) :]
        for i in range(m):
            of = best[i][left[best[i], i]]
            x, read = lists.x[of], depth > 0
            # A value that its list was read down to, or one as good, is known.
            known = read & np.where(q[i] > 0, x >= last_up, x <= last_down)
            lower = np.where(known, x * q[i], end_up[:, i] + end_down[:, i]).sum(1)
            if len(lower) >= k:
                left[:, i] &= upper[:, i] >= np.partition(lower, len(lower) - k)[len(lower) - k]
    if stats is not None:
        for name, more in (("read", int(depth.sum()) * m), ("all", n * d * m), ("resolved", int(left.sum())), ("rows", n * m)):
            stats[name] = stats.get(name, 0) + more
    found = []
    for i in range(m):
        of = np.flatnonzero(left[:, i])
        score = (lists.x[of] @ q[i]).astype(np.int64)
        best = np.lexsort((lists.ids[of], -score))[:k]
        found.append((lists.ids[of[best]], score[best]))
    return found


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """Floats where all sums of products are exact in them, else integers."""
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if reach < 2**22 else np.float64 if reach < 2**51 else np.int64


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one dimension, as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(d: int) -> pd.DataFrame:
            nonlocal made
            ids, values = held.pop(d)
            made += 1
            of = np.asarray(ids, np.int64).tobytes(), np.asarray(values, np.float64).tobytes()
            return pd.DataFrame({"block": [(task << 20) + made], "d": [d], "ids": [of[0]], "data": [of[1]]})

        for b in batches:
            for i, v in zip(b["id"], b["v"], strict=True):
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for d in list(held):
            yield block(d)

    return rows.mapInPandas(pack, "block long, d int, ids binary, data binary")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best rows by integer inner product for each query row, every row but the query's own being a candidate.

    Components become ``floor(scale * x)``. Candidates and queries are packed into blocks; each pair of blocks is searched by
    :func:`top_k`, and the best of all pairs are ranked. Blocks of queries are a stated set against all rows: a candidate block is
    read once for each. A block's lists are sorted once for a query block.

    Returns ``query_id``, ``rank`` (from 1), ``key``, ``score``; fewer than ``k`` rows where there are fewer candidates. Ties go to
    the smaller id. Vectors that are NULL or hold NULL, NaN or infinite components take no part, nor do rows without an id;
    vectors of another length than the query's are no candidates. Rows that share an id are one another's own row, so never
    matched; a query id that repeats gives the best over all its vectors once per rank. An empty table gives no rows.
    Other columns are ignored.
    """
    bad = F.exists(F.col("v"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))
    candidates = cut(_packed(rows.select("id", "v"), BLOCK), "topk-rows")
    queries = cut(rows.filter("asks").select("id", "v"), "topk-asks")
    asked = cut(_packed(queries.repartition(max(1, -(-queries.count() // QUERIES))), QUERIES), "topk-queries")
    slot = F.pmod(F.xxhash64("ask"), F.lit(SLOTS)).cast("int").alias("slot")
    pairs = candidates.select("block", "d", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")).join(asked.select(F.col("block").alias("ask"), "d").select("ask", "d", slot), ["d", "slot"])
    pairs = pairs.select("block", "ask").join(candidates, "block")
    pairs = pairs.join(asked.select(F.col("block").alias("ask"), F.col("ids").alias("q_ids"), F.col("data").alias("q")), "ask")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidy(batches):
            for r in b.itertuples():
                x, q = np.frombuffer(r.data, np.float64).reshape(-1, r.d), np.frombuffer(r.q, np.float64).reshape(-1, r.d)
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                kind = _exact(x, q)
                lists, q = Lists(x.astype(kind), ids), q.astype(kind)
                for i in range(0, len(q), TOGETHER):
                    out = top_k(lists, q[i : i + TOGETHER], q_ids[i : i + TOGETHER], k)
                    yield pd.DataFrame({"query_id": np.repeat(q_ids[i : i + TOGETHER], [len(f) for f, _ in out]), key: np.concatenate([f for f, _ in out]), "score": np.concatenate([x for _, x in out])})

    found = pairs.select("d", "ids", "data", "q_ids", "q").mapInPandas(best, f"query_id long, `{key}` long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
