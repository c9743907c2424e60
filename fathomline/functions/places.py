"""Where patterns match in texts, as rows: lengths of what stands between the matches add up to places, in code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _placed(rows: DataFrame, keys: Sequence[str], parts: Column) -> DataFrame:
    """``keys``, ``start`` and ``end`` from an array of structs ``gap`` and ``size``, lengths before each match and of it."""
    long = rows.select(*keys, F.posexplode(parts).alias("_i", "_p"))
    end = F.sum(F.col("_p.gap") + F.col("_p.size")).over(W.partitionBy(*keys).orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    return long.withColumn("end", end).select(*keys, (F.col("end") - F.col("_p.size")).alias("start"), "end")


def match_places(rows: DataFrame, keys: Sequence[str], content: str, pattern: Column) -> DataFrame:
    """All leftmost matches that don't overlap, ends exclusive; ``keys`` tell rows apart. Patterns match a character at least; NULL matches nothing."""
    found, between = F.regexp_extract_all(content, pattern, F.lit(0)), F.split(F.col(content), pattern, -1)
    return _placed(rows, keys, F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))))


def phrase_places(rows: DataFrame, keys: Sequence[str], content: str, phrase: Column) -> DataFrame:
    """Every place where a phrase stands, in either case, overlapping ones too. Texts are split ahead of each of them."""
    here = F.concat(F.lit(r"(?iu)(?=\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(F.col(content), here, -1)
    # A split at the very start leaves no empty piece.
    first = F.when(F.rlike(F.col(content), F.concat(F.lit("^"), here)), F.array(F.struct(F.lit(0).alias("gap"), F.lit(0).alias("size")))).otherwise(F.array().cast("array<struct<gap:int,size:int>>"))
    others = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(F.length(p).alias("gap"), F.lit(0).alias("size")))
    return _placed(rows, keys, F.concat(first, others)).select(*keys, "start")


#: Lengths that are summed in one array: an append copies it.
RUN = 256


def places_of(content: Column, pattern: Column) -> Column:
    """All leftmost matches that don't overlap, as an array of structs ``start`` and ``end`` (exclusive), in order; none where the text or pattern is NULL.

    Gaps and matches add up in runs, so the work is linear in the text.
    """
    found, between = F.regexp_extract_all(content, pattern, F.lit(0)), F.split(content, pattern, -1)
    sizes = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    last = lambda a: F.element_at(a, -1)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(a: Column, x: Column) -> Column:
        at = last(a)["end"] + x["gap"]
        return F.array_append(a, F.struct(at.alias("start"), (at + x["size"]).alias("end")))

    def summed(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda i: F.slice(s, i * RUN + 1, F.lit(RUN)))
        # Each run begins with the last place of the run before, which goes in the end.
        zero = F.array(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))))
        ends = F.aggregate(runs, zero, lambda all_, run: F.array_append(all_, F.aggregate(run, F.array(last(last(all_))), placed)))
        return F.flatten(F.transform(F.slice(ends, F.lit(2), F.size(runs)), lambda run: F.slice(run, F.lit(2), F.lit(RUN))))

    made = F.element_at(F.transform(F.array(sizes), lambda s: F.when(F.size(s) > 0, summed(s)).otherwise(none)), 1)
    return F.coalesce(made, none)
