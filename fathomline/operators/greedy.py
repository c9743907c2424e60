"""Greedy choice in order, in parallel: a row stays unless it is like one that stays before it.

That is the lexicographically first maximal independent set of the graph of likeness. Rows whose likeness needs a share of common tokens
meet only if the heads of their token lists do, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.sources.folders import cut, shuffled

#: Rounds of leaders go on while each takes out this share of the rows that are left.
WORTH = 0.1


def first_independent(
    rows: DataFrame, by: Sequence[str], order: str, tokens: str, share: float, like: Callable[[Column, Column], Column], item: str | None = None, stats: dict[str, int] | None = None
) -> DataFrame:
    """``by`` and ``order`` of the rows that stay.

    ``tokens`` is an array of different values in an order that all rows share, rare ones first; of two rows that are alike, the tokens have a Jaccard
    likeness of at least ``share``, so they share one of their first ``n - ceil(share * n) + 1``. ``like(a, b)`` decides on the columns ``item`` (else
    the tokens) of the later row ``a`` and the earlier row ``b``. ``order`` is unique within ``by``, and may be a struct. Rows without tokens stay.

    First come rounds of leaders: a row that is the first of all that is left in each token of its head has nothing left before it that it could be
    like, so it stays, and what is like it goes. A token has one leader at most, so a round costs the tokens once, and a large group of
    near copies goes with its first row. When rounds take out little, pairs of those left are made by heads, lengths and places, and
    rows stay once all earlier ones that they are like are out. Tables are written between rounds. ``stats`` counts ``rounds``, ``met`` and
    ``edges`` (pairs compared in rounds of leaders and after them).
    """
    stats = {} if stats is None else stats
    stats |= {"rounds": 0, "met": 0, "edges": 0}
    by = list(by)
    slim = cut(rows.select(*by, F.col(order).alias("_o"), F.col(tokens).alias("_tokens"), F.col(item or tokens).alias("_item")), "greedy-rows")
    n = F.size("_tokens")
    head = (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    heads = slim.select(*by, "_o", n.alias("_n"), F.posexplode(F.slice("_tokens", F.lit(1), F.greatest(head, F.lit(0)))).alias("_i", "_token"))
    items = lambda names: slim.select(*by, *(F.col(c).alias(a) for c, a in names.items()))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of pairs ``_a`` after ``_b``, those that are alike."""
        sides = pairs.join(shuffled(items({"_o": "_a", "_item": "_x"})), [*by, "_a"]).join(shuffled(items({"_o": "_b", "_item": "_y"})), [*by, "_b"])
        return sides.filter(like(F.col("_x"), F.col("_y"))).select(*by, "_a", "_b")

    kept = [slim.filter(n <= 0).select(*by, "_o")]
    left = cut(slim.filter(n > 0).select(*by, "_o"), "greedy-left")
    before = left.count()
    while before:
        own = heads.join(shuffled(left), [*by, "_o"], "left_semi")
        first = own.groupBy(*by, "_token").agg(F.min("_o").alias("_b"))
        behind = cut(own.join(shuffled(first), [*by, "_token"]).filter("_b < _o").select(*by, F.col("_o").alias("_a"), "_b").distinct(), "greedy-behind")
        leaders = cut(left.join(shuffled(behind.select(*by, F.col("_a").alias("_o")).distinct()), [*by, "_o"], "left_anti"), "greedy-leaders")
        out = alike(behind.join(shuffled(leaders.select(*by, F.col("_o").alias("_b"))), [*by, "_b"])).select(*by, F.col("_a").alias("_o")).distinct()
        left = cut(left.join(shuffled(leaders.unionByName(out)), [*by, "_o"], "left_anti"), "greedy-left")
        kept.append(leaders)
        after, chosen = left.count(), leaders.count()
        stats["rounds"] += 1
        stats["met"] += behind.count()
        gone, before = before - after - chosen, after
        if gone < WORTH * (after + gone):
            break
    if before:
        own = heads.join(shuffled(left), [*by, "_o"], "left_semi")
        later = own.select(*by, "_token", F.col("_o").alias("_a"), F.col("_n").alias("_na"), F.col("_i").alias("_ia"))
        earlier = own.select(*by, "_token", F.col("_o").alias("_b"), F.col("_n").alias("_nb"), F.col("_i").alias("_ib"))
        # Common tokens: at most those up to this place, and those behind it.
        most = F.least("_ia", "_ib") + 1 + F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) - 1
        room = most >= (F.col("_na") + F.col("_nb")) * (share / (1 + share)) - 1e-9
        pairs = later.join(shuffled(earlier), [*by, "_token"]).filter((F.col("_b") < F.col("_a")) & (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * share - 1e-9) & room)
        edges = cut(alike(pairs.select(*by, "_a", "_b").distinct()), "greedy-edges")
        stats["edges"] = edges.count()
        while edges.count():
            waiting = edges.select(*by, F.col("_a").alias("_b")).distinct()
            free = edges.join(shuffled(waiting), [*by, "_b"], "left_anti")  # edges from rows with no row before them
            out = cut(free.select(*by, F.col("_a").alias("_o")).distinct(), "greedy-out")
            left = cut(left.join(shuffled(out), [*by, "_o"], "left_anti"), "greedy-left")
            for end in ("_a", "_b"):
                edges = edges.join(shuffled(out.select(*by, F.col("_o").alias(end))), [*by, end], "left_anti")
            settled = free.select(*by, "_b").distinct()
            edges = cut(edges.join(shuffled(settled), [*by, "_b"], "left_anti"), "greedy-edges")
        kept.append(left)
    return reduce(DataFrame.unionByName, kept).withColumnRenamed("_o", order)
