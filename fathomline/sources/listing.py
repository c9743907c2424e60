"""A paged listing as a Python data source, with the offset cursor of a backfill (SRC20, STR03)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, PAGES_A_RUN = 20, 2


def backfill_window(next_offset: int, done: bool, page: int = PAGE, pages: int = PAGES_A_RUN) -> tuple[int, int, int]:
    """First page (from 1), rows to skip on it, and pages of a run; after the end, one page from the start."""
    offset = max(0, int(next_offset or 0))
    return (1, 0, 1) if done else (offset // page + 1, offset % page, pages)


def advanced(cursors: DataFrame, processed: DataFrame, now: str) -> DataFrame:
    """Cursors after a run: ``processed`` has ``company_code``, ``n`` rows handled (blocked and empty ones too) and ``exhausted``."""
    keys = cursors.join(processed, "company_code", "full")
    at = F.coalesce("next_offset", F.lit(0)).cast("long")
    done, ended = F.coalesce("done", F.lit(False)), F.coalesce("exhausted", F.lit(False))
    moved = F.when(done | F.col("n").isNull(), at).when(ended, F.lit(0).cast("long")).otherwise(F.greatest(at, F.lit(0)) + F.col("n"))
    stamp = F.when(F.col("n").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    return keys.select("company_code", moved.cast("long").alias("next_offset"), (done | ended).alias("done"), stamp.alias("updated_at"))


def listing_source(name: str, fetch: Callable[[str, int], list[dict]], cursors: dict[str, tuple[int, bool]]) -> type[DataSource]:
    """A batch source of announcements: a partition for each company code of the bounded ``cursors``, pages by its cursor.

    ``fetch`` takes a code and a page and returns rows with ``ann_id``, ``title`` and ``date``. Rows come with ``position`` in the
    listing; a code's pages end at the first short one.
    """

    class Part(InputPartition):
        def __init__(self, code: str, offset: int, done: bool):
            self.code, self.offset, self.done = code, offset, done

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Part(code, offset, done) for code, (offset, done) in sorted(cursors.items())]

        def read(self, part: Part) -> Iterator[tuple]:
            first, skip, pages = backfill_window(part.offset, part.done)
            for page in range(first, first + pages):
                rows = fetch(part.code, page)
                for i, r in enumerate(rows):
                    if page > first or i >= skip:
                        yield (part.code, (page - 1) * PAGE + i, r["ann_id"], r["title"], r["date"])
                if len(rows) < PAGE:
                    return

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "company_code string, position int, ann_id string, title string, date string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Listing
