"""Named sources of documents (SRC22): callables from queries to documents."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Source = Callable[[DataFrame], DataFrame]


class Registry:
    def __init__(self):
        self._sources: dict[str, Source] = {}

    def add(self, name: str, source: Source) -> None:
        self._sources[name] = source

    def active(self, wanted: Collection[str] | None = None, disabled: Collection[str] = ()) -> dict[str, Source]:
        """JON13, SRC22: registered sources that are wanted (all, by default) and not disabled."""
        return {n: s for n, s in self._sources.items() if (wanted is None or n in wanted) and n not in disabled}

    def fetch(self, queries: DataFrame, base_only: Collection[str] = (), wanted: Collection[str] | None = None) -> DataFrame | None:
        """STR07, SET01: documents of all active sources; those in ``base_only`` are asked the base query alone."""
        parts = []
        for i, (name, source) in enumerate(self.active(wanted).items()):
            asked = queries.filter("is_base") if name in base_only else queries
            parts.append(source(asked).withColumns({"retriever": F.lit(name), "source_pos": F.lit(i)}))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
