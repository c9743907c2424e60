"""Centroid clustering of integer vectors: rounds of exact assignment by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import cut, tidy

#: Components lie within this, so that a squared distance of 64 components fits a long.
LIMIT = 1 << 27
#: Relative allowance for rounding in bounds, which are only ever used to leave out work.
SLACK = 1e-12


def assign(
    x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, stats: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row of ``x`` (squared distance, ties to the smaller number), and new bounds.

    ``own`` is the last centroid (-1: none), ``upper`` bounds the distance to it from above, ``lower`` that to every other centroid from
    below; all hold for ``centroids`` as they are now. A row whose upper bound is below its lower bound, or below half the distance from its
    centroid to the nearest other one, stays without any distance. Else the upper bound becomes the distance itself, and if that doesn't
    do, the row scans the centroids of its ball: around its own centroid, with a radius of twice that distance plus the distance to the
    nearest other centroid, taken as a prefix of the list of centroids sorted by distance from its own. No centroid outside can be
    nearest or second; the radius is inclusive, so none that ties is missed. Distances are integers, thus exact. ``stats`` counts
    ``distances`` of ``all``.
    """
    k = len(centroids)
    own, upper, lower = np.maximum(own, 0), np.where(own < 0, np.inf, upper), np.where(own < 0, 0.0, lower)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    ahead = np.sqrt(np.take_along_axis(apart, order, axis=1).astype(float))
    other = np.sqrt(np.where(np.eye(k, dtype=bool), np.iinfo(np.int64).max, apart).min(1).astype(float))
    open_ = np.flatnonzero(~(upper < np.maximum(lower, other[own] / 2 * (1 - SLACK))))
    exact = ((x[open_] - centroids[own[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    computed = len(open_)
    still = ~(upper[open_] < np.maximum(lower[open_], other[own[open_]] / 2 * (1 - SLACK)))
    open_, exact = open_[still], exact[still]
    around = own[open_]
    for a in np.unique(around):
        of = around == a
        rows, base = open_[of], exact[of]
        reach = np.searchsorted(ahead[a] * (1 - SLACK), (2 * upper[rows] + other[a]) * (1 + SLACK), side="right") if k > 1 else np.ones(len(rows), int)
        turn = np.argsort(-reach, kind="stable")
        rows, base, reach = rows[turn], base[turn], reach[turn]
        # The own centroid may stand anywhere among those at distance 0 of it: it goes first, then its list without it.
        best, at, second = base.copy(), np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
        for t in range(int(reach.max(initial=0))):
            j, m = order[a, t], int(np.searchsorted(-reach, -t, side="left"))
            if j == a:
                continue
            d = ((x[rows[:m]] - centroids[j]) ** 2).sum(1)
            computed += m
            wins = (d < best[:m]) | ((d == best[:m]) & (j < at[:m]))
            second[:m] = np.where(wins, best[:m], np.minimum(second[:m], d))
            best[:m], at[:m] = np.where(wins, d, best[:m]), np.where(wins, j, at[:m])
        own[rows], upper[rows], lower[rows] = at, np.sqrt(best.astype(float)) * (1 + SLACK), np.sqrt(second.astype(float)) * (1 - SLACK)
    if stats is not None:
        for name, more in (("distances", computed), ("all", len(x) * k)):
            stats[name] = stats.get(name, 0) + more
    return own, upper, lower


def kept(vectors: DataFrame, size: int, scale: int, key: str, vector: str) -> DataFrame:
    """``key`` and the integer components ``v`` of the vectors with ``size`` components that are all finite."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).filter(F.coalesce(F.size("v") == size, F.lit(False)) & finite)
    return rows.withColumn("v", F.transform("v", lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")))


def _round(state: DataFrame, centroids: np.ndarray, shift: np.ndarray, key: str, last: bool) -> DataFrame:
    """``state`` with each row's centroid and bounds after centroids moved by ``shift``; ``distance`` is exact if ``last``, else NULL."""
    worst = np.array([np.delete(shift, a).max(initial=0.0) for a in range(len(shift))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, centroids.shape[1]).astype(np.int64)
            own, upper, lower = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            before = np.maximum(own, 0)
            own, upper, lower = assign(x, own, upper + shift[before] * (1 + SLACK), lower - worst[before] * (1 + SLACK), centroids)
            distance = pa.array(((x - centroids[own]) ** 2).sum(1)) if last else pa.nulls(b.num_rows, pa.int64())
            parts = [b.column(key), b.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), distance]
            yield pa.RecordBatch.from_arrays(parts, [key, "v", "cluster", "upper", "lower", "distance"])

    kind = state.schema[key].dataType.simpleString()
    return state.select(key, "v", "cluster", "upper", "lower").mapInArrow(step, f"`{key}` {kind}, v array<int>, cluster int, upper double, lower double, distance long")


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Lloyd's rounds over all ``vectors`` of ``size`` finite components, turned into ``floor(scale * x)``.

    The first centroids are the ``k`` vectors with the least SHA-256 of ``seed:key`` (fewer, if there are fewer vectors). Each round assigns
    every vector by :func:`assign`, then sets each centroid with vectors to the floor of their componentwise mean; an empty one stays.
    Vectors are assigned once more at the end. Bounds go along with the vectors from round to round, in a table of the shared folder, so
    a lost executor costs only its tasks. The driver and the tasks hold the ``k`` centroids and nothing else; sums are made where the rows are.

    Returns ``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` for each vector.
    Vectors that are NULL, of another length, or with NULL, NaN or infinite components are left out. Components beyond ±2^27 count as
    that bound. Repeated rows are vectors of their own; of vectors that share a key, the lesser starts first; a NULL key counts as empty in
    the hash and comes back as NULL. Sums that a long can't hold come back as its greatest value. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    if key in ("v", "cluster", "upper", "lower", "distance"):
        return cluster(vectors.withColumnRenamed(key, "_key"), k, rounds, size, scale, seed, "_key", vector).withColumnRenamed("_key", key)
    state = kept(vectors, size, scale, key, vector).withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0)})
    state = cut(state, "clusters-start")
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    centroids = np.array([r["v"] for r in state.orderBy(turn, "v").select("v").limit(k).collect()], np.int64).reshape(-1, size)
    columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {state.schema[key].dataType.simpleString()}, {columns}")
    shift = np.zeros(len(centroids))
    for _ in range(rounds):
        state = cut(_round(state, centroids, shift, key, False), "clusters")
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(size)))
        moved = centroids.copy()
        for r in sums.collect():  # a row per centroid
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
        shift, centroids = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK), moved
    state = cut(_round(state, centroids, shift, key, True), "clusters-last")
    most = (1 << 63) - 1
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # A row per centroid: k bounds the size of what is broadcast.
    told = spark.createDataFrame([(c, min(s, most), min(sum(sums.values()), most), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(key, "cluster", "distance").join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
