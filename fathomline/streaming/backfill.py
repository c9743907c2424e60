"""Backfill of disclosures: names to codes, pages from each code's cursor, documents, and only then the cursors (SRC20, STR03)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.joins import company_codes
from fathomline.schema import CURSOR
from fathomline.sources.deltas import KeyedTable
from fathomline.sources.folders import cut
from fathomline.sources.listing import PAGE, advanced, backfill_window

#: Rows that a task holds before it passes them on.
HELD = 5_000
LISTED = "company_code string, position long, ann_id string, title string, date string, ended boolean"


def listed(cursors: DataFrame, fetch: Callable[[str, int], list[dict]]) -> DataFrame:
    """Announcements of each code (``company_code``, ``next_offset``, ``done``) in its window of pages, with their ``position``, and one row without a position that
    says whether the listing ``ended``: a page was short. Codes are fetched where they are; ``fetch`` takes a code and a page.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists by column: a frame of rows would be cut into columns again.
        kinds = pa.schema([("company_code", pa.string()), ("position", pa.int64()), ("ann_id", pa.string()), ("title", pa.string()), ("date", pa.string()), ("ended", pa.bool_())])
        out: list[list] = [[] for _ in kinds]
        codes, positions, ids, titles, days, ends = out
        batch = lambda: pa.record_batch([pa.array(c, k.type) for c, k in zip(out, kinds, strict=True)], kinds)
        for b in batches:
            for code, offset, done in zip(*(b.column(c).to_pylist() for c in ("company_code", "next_offset", "done")), strict=True):
                first, skip, pages = backfill_window(offset, done)
                ended = False
                for page in range(first, first + pages):
                    rows = fetch(code, page)
                    told = rows[skip:] if page == first else rows
                    start = (page - 1) * PAGE + len(rows) - len(told)
                    positions += range(start, start + len(told))
                    ids += [r["ann_id"] for r in told]
                    titles += [r["title"] for r in told]
                    days += [r["date"] for r in told]
                    if ended := len(rows) < PAGE:
                        break
                for column in (positions, ids, titles, days):
                    column.append(None)
                n = len(positions) - len(codes)
                codes += [code] * n
                ends += [None] * (n - 1) + [ended]
                if len(codes) > HELD:
                    yield batch()
                    for column in out:
                        column.clear()
        if codes:
            yield batch()

    some = cursors.select("company_code", F.coalesce("next_offset", F.lit(0)).cast("long").alias("next_offset"), F.coalesce("done", F.lit(False)).alias("done"))
    # Codes are few bytes and many pages: without a number, adaptive execution would put millions of them into a task.
    tasks = int(cursors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return some.repartition(tasks, "company_code").mapInArrow(read, LISTED)


class Backfill:
    """Runs over listings, each from where the last one ended.

    What a run has read is written before it is handled, so nothing is fetched twice in it. Cursors are one commit of a keyed table, made after the handler has
    returned: a run that stops before reads its pages again, and none is left out; the handler's rows should be kept by ``ann_id``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.cursors = KeyedTable(spark, path, CURSOR, "company_code")

    def run(self, queries: DataFrame, codes: DataFrame, fetch: Callable[[str, int], list[dict]], handle: Callable[[DataFrame], None], now: str) -> int:
        """One run for the companies that ``queries`` (``query``) name, by JON06 over ``codes``; names without a code go. The number of announcements handled."""
        wanted = company_codes(queries, codes).filter("code <> ''").select(F.col("code").alias("company_code")).distinct()
        mine = cut(wanted.join(self.cursors.read(), "company_code", "left"), "backfill-cursors")
        rows = cut(listed(mine, fetch), "backfill-rows")
        handle(rows.filter(F.col("position").isNotNull()).drop("ended"))
        processed = rows.groupBy("company_code").agg(F.count("position").alias("n"), F.max("ended").alias("exhausted"))
        self.cursors.change(advanced(mine, processed, now))
        return rows.filter(F.col("position").isNotNull()).count()
