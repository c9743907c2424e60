"""Date expressions. Results are DATE, NULL for what is no valid date from 1900 to 2100."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import collapse, text

# Date tokens, by priority; month names.
TOKENS = [
    r"(\d{4}-\d{2}-\d{2})",
    r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
    r"(\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})",
    r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})",
    r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})",
]
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def _once(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, which is evaluated once however often ``body`` names it; the cascades below would else repeat it hundredfold."""
    return F.element_at(F.transform(F.array(c), body), 1)


def valid(year: Column, month: Column, day: Column) -> Column:
    joined = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    date = F.try_to_timestamp(joined, F.lit("yyyy-MM-dd")).cast("date")
    return _once(date, lambda d: F.when(F.year(d).between(1900, 2100), d))


def _groups(s: Column, pattern: str, *order: int) -> Column:
    return _once(s, lambda x: F.when(x.rlike(pattern), valid(*(F.regexp_extract(x, pattern, i) for i in order))))


def iso(c: Column) -> Column:
    """DAT01: the first ten characters as year, month, day."""
    return _groups(F.left(F.trim(text(c)), F.lit(10)), r"^(\d{4})-(\d{2})-(\d{2})$", 1, 2, 3)


def day_first(c: Column) -> Column:
    """DAT02."""
    return _groups(F.trim(text(c)), r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", 3, 2, 1)


def year_first(c: Column) -> Column:
    """DAT03."""
    return _groups(F.trim(text(c)), r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$", 1, 2, 3)


def month_name(c: Column) -> Column:
    """DAT04: ``d Mon yyyy`` or ``Mon d, yyyy`` by the month's first three letters."""
    first, second = r"^(\d{1,2}) ([A-Za-z]{3,}) (\d{4})$", r"^([A-Za-z]{3,}) (\d{1,2}),? (\d{4})$"
    numbers = F.create_map(*(F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))))

    def named(s: Column, pattern: str, year: int, month: int, day: int) -> Column:
        number = F.try_element_at(numbers, F.lower(F.left(F.regexp_extract(s, pattern, month), F.lit(3))))
        return F.when(s.rlike(pattern) & number.isNotNull(), valid(F.regexp_extract(s, pattern, year), number, F.regexp_extract(s, pattern, day)))

    return _once(collapse(c), lambda s: F.coalesce(named(s, first, 3, 2, 1), named(s, second, 3, 1, 2)))


def parsed(c: Column) -> Column:
    """DAT05: the first form that fits."""
    return _once(text(c), lambda s: F.coalesce(iso(s), day_first(s), year_first(s), month_name(s)))


def first_token(c: Column) -> Column:
    """DAT06: the first date token, by priority of patterns and not by place; NULL without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text(c), p, 1), F.lit("")) for p in TOKENS))


def midnight(c: Column) -> Column:
    """DAT07: the session's zone should be UTC."""
    return iso(c).cast("timestamp")


def best_date(source: Column, indexed: Column) -> Column:
    """ORD02."""
    return F.coalesce(iso(source), iso(indexed))


def time_ago(seconds: Column) -> Column:
    """DAT09."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m ago")).when(seconds < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def shown(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")
