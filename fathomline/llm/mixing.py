"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathomline.llm.shared import WORD, cut, word_count

#: Words that one output shard holds, about; blocks of one shard; the fewest shards.
SHARD_WORDS = 1 << 24
BLOCKS_PER_SHARD = 16
LEAST_SHARDS = 16
#: Tables of a row per block or draw are broadcast up to so many rows, some 50 bytes each; larger ones are joined by shuffling.
BROADCAST_ROWS = 100_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, epochs: float) -> np.ndarray:
    """Shares of ``sum(sizes)`` by weight, none above ``epochs`` times its size; what is above is shared again."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, left = np.zeros(len(sizes)), float(sizes.sum())
    free = sizes > 0
    while free.any():
        share = np.where(free, left * weights / weights[free].sum(), 0)
        above = free & (share > epochs * sizes)
        if not above.any():
            return np.where(free, share, target)
        target[above] = epochs * sizes[above]
        left -= target[above].sum()
        free &= ~above
    return target


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length, by source, of the drawn blocks that ``shard`` gets.

    Walks the splitting tree from the root to the shard's leaf. A node holds exact block quotas of a run of shards; its
    left half gets a multivariate-hypergeometric sample of them, seeded by the node, and the right half the rest. Each
    shard walks alone, so the tree is never held anywhere, and all walks agree on the nodes they share.
    """
    counts, start, lo, hi = np.asarray(quotas, np.int64).copy(), np.zeros(len(quotas), np.int64), 0, shards
    while hi - lo > 1:
        mid, total = (lo + hi) // 2, int(counts.sum())
        sample = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, sample, method="marginals") if total else counts
        if shard < mid:
            counts, hi = left, mid
        else:
            start, counts, lo = start + left, counts - left, mid
    return start, counts


def _source_key(source: str) -> Column:
    """Joins need NULL sources as a value: '1' and the name, or '0'."""
    return F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))


def _tagged(docs: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    return docs.withColumns({
        "_sk": _source_key(source), "_size": word_count(F.col(text)), "_h": F.xxhash64(F.lit(seed), F.col(key), F.col(text)),
    })


class Draw:
    """What a mix takes of each source, as small tables.

    Sources in code-point order, NULL last, have ``weights`` in turn, repeating. Their targets share out all words of the
    table by weight, none above ``epochs`` times its source (see :func:`water_fill`). The rows of a source are dealt into
    blocks by a seeded hash, the blocks permuted by another. A source draws whole passes over its blocks while its target
    lasts, then permuted blocks; in the last one, permuted rows; the last row is cut at the word that completes the target,
    rounded. The splitting tree deals the drawn blocks to ``shards`` output shards.

    ``sources``: number ``s``, size, target and blocks of each. ``blocks``: for each ``s``, ``block`` how often it is drawn
    whole (``spins``) and, if the target ends in it, the order value of the row that is cut (``edge``) and what that row
    gives (``rest``). ``draws``: ``s``, ``block``, ``pass``, ``shard`` of each drawn block. The driver reads the catalogue of
    sources, a row each, and nothing else; block and shard counts follow the number of words.

    NULL, empty and blank texts have size 0 and are never drawn; a source of only such rows has target 0. Rows equal in
    key and text are drawn alike, and share a cut evenly. An empty table gives empty results. Reruns agree.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 7, shards: int | None = None,
                 key: str = "doc_id", text: str = "text", source: str = "source"):
        spark, self.seed, self.key, self.text, self.source = docs.sparkSession, seed, key, text, source
        rows = _tagged(docs.select(key, text, source), seed, key, text, source)
        self.rows = rows = cut(rows.select(F.col(key), F.col(source).cast("string").alias("_source"), "_sk", "_size", "_h"), "mix-rows")
        found = rows.groupBy("_sk", "_source").agg(F.sum("_size").alias("size")).collect()
        found.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode("utf-32-be")))
        sizes = np.array([r["size"] for r in found], np.int64)
        target = water_fill(sizes, np.resize(np.asarray(weights, float), len(found)), epochs)
        words = np.minimum(np.rint(target).astype(np.int64), epochs * sizes)
        total = int(sizes.sum())
        shards = shards or max(LEAST_SHARDS, -(-total // SHARD_WORDS))
        per_block = max(1, total // (shards * BLOCKS_PER_SHARD))
        self.sources = spark.createDataFrame(
            pd.DataFrame({
                "_sk": [r["_sk"] for r in found], "s": np.arange(len(found), dtype=np.int64), "source_size": sizes, "target": target,
                "passes": words // np.maximum(sizes, 1), "quota": words % np.maximum(sizes, 1), "n_blocks": np.maximum(1, sizes // per_block),
            }),
            "_sk string, s long, source_size long, target double, passes long, quota long, n_blocks long",
        )
        self.n_sources, self.n_blocks = len(found), len(found) + shards * BLOCKS_PER_SHARD
        placed = self._placed(rows)
        # Where each block ends in the permuted order of its source's blocks: a row per block.
        order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
        # Blocks of empty texts alone have no place, so drawn places are the first ones.
        blocks = placed.groupBy("s", "block", "passes", "quota").agg(F.sum("_size").alias("words")).filter("words > 0")
        blocks = (
            blocks.withColumn("place", F.row_number().over(order) - 1)
            .withColumn("n", F.count("*").over(Window.partitionBy("s")))
            .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("room", F.greatest(F.least(F.col("quota") - F.col("before"), F.col("words")), F.lit(0)))
        )
        blocks = cut(blocks, "mix-blocks")
        # In the one block of a source where the quota ends, rows count in permuted order; equal rows come as one.
        inside = blocks.filter(F.col("room").between(F.lit(1), F.col("words") - 1)).select("s", "block", "room")
        each = placed.join(inside, ["s", "block"]).groupBy("s", "block", "room", self._order().alias("edge"))
        each = each.agg(F.sum("_size").alias("w"), F.count("*").alias("m"))
        upto = F.sum("w").over(Window.partitionBy("s", "block").orderBy("edge"))
        edges = each.withColumn("upto", upto).filter((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("w") < F.col("room")))
        edges = edges.select("s", "block", "edge", F.expr("(room - upto + w) div m").alias("rest"))
        drawn = F.col("passes") + (F.col("room") == F.col("words")).cast("long")
        self.blocks = cut(blocks.join(edges, ["s", "block"], "left").select("s", "block", drawn.alias("spins"), "edge", "rest"), "mix-edges")

        turns = F.col("passes") + (F.col("room") > 0).cast("long")
        quotas = np.zeros(len(found), np.int64)
        for r in blocks.groupBy("s").agg(F.sum(turns).alias("q")).collect():  # a row per source
            quotas[r["s"]] = r["q"]
        self.n_draws = int(quotas.sum())

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    start, count = split_quotas(quotas, shards, int(shard), seed)
                    s = np.flatnonzero(count)
                    yield pd.DataFrame({"s": s.astype(np.int64), "start": start[s], "count": count[s], "shard": int(shard)})

        dealt = spark.range(shards).mapInPandas(walk, "s long, start long, count long, shard long")
        dealt = dealt.select("s", "shard", F.explode(F.expr("sequence(start, start + count - 1)")).alias("turn"))
        # Turn t of a source is block t mod n of its permuted order, in pass t div n.
        times = blocks.filter(turns > 0).select("s", "block", "place", "n", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)).alias("pass"))
        times = times.withColumn("turn", F.col("pass") * F.col("n") + F.col("place"))
        self.draws = cut(times.join(dealt, ["s", "turn"]).select("s", "block", "pass", "shard"), "mix-draws")

    @staticmethod
    def _near(small: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(small) if rows <= BROADCAST_ROWS else small

    def _order(self) -> Column:
        return F.xxhash64(F.lit(self.seed + 2), "_h")

    def _placed(self, tagged: DataFrame) -> DataFrame:
        return tagged.join(self._near(self.sources, self.n_sources), "_sk").withColumn("block", F.pmod(F.col("_h"), F.col("n_blocks")))

    def applied(self, tagged: DataFrame) -> DataFrame:
        """Adds to each row ``_spins``, how often it is drawn whole, and ``_rest``, the words of a last, cut draw."""
        at = self._placed(tagged).join(self._near(self.blocks, self.n_blocks), ["s", "block"], "left")
        before = (self._order() < F.col("edge")).cast("long")
        spins = F.col("spins") + F.when(F.col("edge").isNull(), 0).otherwise(before)
        return at.withColumns({
            "_spins": F.when(F.col("_size") > 0, spins).otherwise(0),
            "_rest": F.when(self._order() == F.col("edge"), F.col("rest")).otherwise(0),
        })


def taken(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each input row: key, ``size``, ``source_size``, ``target``, ``taken`` and ``shards``.

    ``taken`` counts repeats; ``shards`` lists the output shards of the row's draws, by pass. See :class:`Draw`.
    """
    d = Draw(docs, **options)
    shards = d.draws.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("at"))
    rows = d.applied(d.rows).join(shards, ["s", "block"], "left")
    times = F.col("_spins") + (F.col("_rest") > 0).cast("long")
    return rows.select(
        d.key, F.col("_size").alias("size"), "source_size", "target", (F.col("_spins") * F.col("_size") + F.col("_rest")).alias("taken"),
        F.slice(F.coalesce(F.col("at.shard"), F.array().cast("array<long>")), F.lit(1), times.cast("int")).alias("shards"),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    runs = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(runs, F.lit(1), words.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: all columns of ``docs``, then ``mix_shard`` and ``mix_pass``.

    A row comes once per draw, the last one with its text cut if the target ends inside it; rows that no draw takes are
    left out. Rows go to a partition by output shard and are shuffled there by a seeded order. Columns of ``docs`` named
    like those two are left out. See :class:`Draw` for the rest.
    """
    d = Draw(docs, **options)
    columns = [c for c in docs.columns if c not in ("mix_shard", "mix_pass")]
    own = docs.select(*(F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"_use_{c}") for c in dict.fromkeys([d.key, d.text, d.source])))
    rows = d.applied(_tagged(own, d.seed, f"_use_{d.key}", f"_use_{d.text}", f"_use_{d.source}"))
    rows = rows.select(*(f"_own_{i}" for i in range(len(columns))), "s", "block", "_h", "_spins", "_rest")
    rows = rows.filter((F.col("_spins") > 0) | (F.col("_rest") > 0))
    drawn = rows.join(d._near(d.draws, d.n_draws), ["s", "block"]).filter(F.col("pass") < F.col("_spins") + (F.col("_rest") > 0).cast("long"))
    drawn = drawn.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(d.seed + 3), "_h", "pass"))
    whole = F.col("pass") < F.col("_spins")
    own_text = F.col(f"_own_{columns.index(d.text)}")
    text = F.when(whole, own_text).otherwise(first_words(own_text, F.col("_rest")))
    return drawn.select(
        *(text.alias(c) if c == d.text else F.col(f"_own_{i}").alias(c) for i, c in enumerate(columns)),
        F.col("shard").alias("mix_shard"), F.col("pass").alias("mix_pass"),
    )
