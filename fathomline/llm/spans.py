"""Native regular-expression spans: where the matches of a pattern are, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,rank:int,end:long,match:string,left:string>>"
#: Code points of the text before a match that are kept as its left context.
LEFT = 48
#: Elements that an array gets one by one; then it counts as a whole. Appending copies, so longer arrays would cost their square.
CHUNK = 256


def matches(text: Column, pattern: str, rank: int) -> Column:
    """All leftmost non-overlapping matches as structs ``start, rank, end, match, left``; ends are exclusive.

    ``split`` gives what stands between the matches, so lengths add up to offsets. Greater cost only where there are
    matches. ``left`` is the end of what stands before the match, since the last one.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    add = lambda a, b: a + b

    def span(z: Column, end: Column) -> Column:
        return F.struct(
            (end - F.length(z["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), z["m"].alias("match"), F.right(z["gap"], F.lit(LEFT)).alias("left"),
        )

    def placed(zipped: Column) -> Column:
        ends = running(F.transform(zipped, lambda z: (F.length(z["gap"]) + F.length(z["m"])).cast("long")), add)
        return F.zip_with(zipped, F.slice(ends, F.lit(2), F.size(zipped)), span)

    return let(found, lambda m: let(F.arrays_zip(F.slice(between, F.lit(1), F.size(m)).alias("gap"), m.alias("m")), placed))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside lambda functions, what is named twice is computed twice."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` makes of 0 and the first ``i`` of an array of longs, for each ``i`` from 0 to its size.

    An array grows by copying, so chunks are merged first, then what stands before each chunk, then inside chunks: no
    growing array holds more than a chunk, or an element a chunk.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def grown(items: Column, start: Column) -> Column:
        first = F.struct(start.alias("last"), none.alias("all"))
        add = lambda acc, x: F.struct(merge(acc["last"], x).alias("last"), F.array_append(acc["all"], merge(acc["last"], x)).alias("all"))
        return F.aggregate(items, first, add, lambda acc: acc["all"])

    def cut_up(of: Column) -> Column:
        count = F.ceil(F.size(of) / CHUNK).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda c: F.slice(of, (c - 1) * CHUNK + 1, CHUNK))).otherwise(F.array().cast("array<array<long>>"))

    def merged(chunks: Column) -> Column:
        before = F.concat(F.array(zero), grown(F.transform(chunks, lambda c: F.aggregate(c, zero, merge)), zero))
        return F.concat(F.array(zero), F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), grown)))

    return let(values, lambda of: let(cut_up(of), merged))


def only_if(condition: Column, spans: Column) -> Column:
    """``spans`` where a cheap condition holds that every match needs, else none."""
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then rank, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
