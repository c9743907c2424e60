"""The seed loop: names, rounds and jobs as functions of what is stored and of time, so any scheduler can drive them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import strip
from fathomline.operators.dedupe import first_wins
from fathomline.params import DEFAULT, Params
from fathomline.schema import CANDIDATE

# Openings and words of reply lines that are no names.
NO_NAME_OPENINGS = ["here is", "here are"]
NO_NAME_WORDS = ["queries", "json"]


def reply_name(c: Column) -> Column:
    """A name as a reply lists it, without slashes, one quote at either end and closing commas; NULL for openings and pieces of JSON."""
    s = strip(c)
    low = F.lower(s)
    other = [F.startswith(low, F.lit(x)) for x in NO_NAME_OPENINGS] + [F.contains(low, F.lit(x)) for x in NO_NAME_WORDS]
    for pattern in (r"^\\+|\\+$", '^"', '"$', ",+$"):
        s = strip(F.regexp_replace(s, pattern, ""))
    drop = (s == "") | s.rlike(r"[{}\[\]]")
    for x in other:
        drop = drop | x
    return F.when(~drop, s)


def merged_names(existing: DataFrame, listed: DataFrame) -> DataFrame:
    """AGG22: the names there are (``name``, ``pos``) and those of a reply's list that are new, in either case; ``is_new`` tells them apart.

    The first of equal names stays. New names come after all others, which an order of two columns says without a global number.
    """
    old = existing.select(strip(F.col("name")).alias("name"), F.lit(False).alias("is_new"), F.col("pos").cast("long").alias("pos"))
    new = listed.select(reply_name(F.col("name")).alias("name"), F.lit(True).alias("is_new"), F.col("pos").cast("long").alias("pos"))
    rows = old.unionByName(new).filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return first_wins(rows, [F.lower("name")], ["is_new", "pos"])


def stored_candidates(raw: DataFrame, column: str = "value") -> DataFrame:
    """SRC26: candidates of JSON texts, each a list; other values, and members that are no objects, give no row. ``pos`` numbers a list's."""
    items = F.from_json(F.when(F.startswith(strip(F.col(column)), F.lit("[")), F.col(column)), "array<string>")
    rows = raw.select(F.posexplode(items).alias("pos", "_c")).filter(F.startswith(strip(F.col("_c")), F.lit("{")))
    schema = ", ".join(f for f in CANDIDATE.split(", ") if f != "pos long")
    rows = rows.select("pos", F.from_json("_c", schema).alias("_c")).filter("_c IS NOT NULL")
    return rows.select("_c.*", F.col("pos").cast("long").alias("pos"))


@dataclass(frozen=True)
class Job:
    """A job of the scheduler: ``every`` minutes, 0 for never."""

    name: str
    every: int
    enabled: bool = True


# The jobs and their minutes.
JOBS = [Job("seed", 20), Job("update_entities", 15, enabled=False), Job("promote", 10)]


def due(jobs: list[Job], last: dict[str, datetime], started: datetime, now: datetime, at_once: bool = True) -> list[str]:
    """STR06: the jobs to run at ``now``. A job that never ran is due at the start, or an interval after it without ``at_once``.

    Missed intervals give one run. ``last`` holds when each job last began.
    """
    out = []
    for j in jobs:
        if not j.enabled or j.every <= 0:
            continue
        step = timedelta(minutes=j.every)
        first = started if at_once else started + step
        if now >= (last[j.name] + step if j.name in last else first):
            out.append(j.name)
    return out


@dataclass
class Loop:
    """What the seed loop asks of the outside.

    ``promote`` promotes names and gives their number; ``more`` gives promoted names, latest first; ``plan`` makes the items of all seeds anew and says
    whether there are any; ``queries`` gives a name's own items, base query first; ``draw`` gives the n-th draw of the planned items, or None;
    ``run`` fetches, embeds and appends a batch of items and gives the number of documents.
    """

    promote: Callable[[], int]
    more: Callable[[], list[str]]
    plan: Callable[[], bool]
    queries: Callable[[str], list[str]]
    draw: Callable[[int], str | None]
    run: Callable[[list[str]], int]


def seed_rounds(loop: Loop, rounds: int = 0, promote_every: int = 1, reload_every: int = 3, reload: bool = True, p: Params = DEFAULT) -> list[dict]:
    """STR01, STR05: the rounds of one run, at most ``p.max_rounds``; a row a batch with what was done. A batch of n items counts as n rounds.

    At every round number that ``promote_every`` divides names are promoted first, and promoted ones join the queue: fifty wait at most, none comes
    twice. Where ``reload_every`` divides it, and after a promotion, the plan is made anew; an empty new plan leaves the old one. Slots of
    a batch take the first queued name's items, eight a name, then drawn ones; the slot that finds a name exhausted takes a drawn one. The run
    ends where a batch would be empty.
    """
    total = min(rounds, p.max_rounds) if rounds > 0 else p.max_rounds
    planned = loop.plan()
    queue: list[str] = []
    mine: dict[str, list[str]] = {}
    met: set[str] = set()

    def join() -> None:
        for name in loop.more():
            if len(queue) >= p.priority_entities:
                break
            if name.strip() and name.lower() not in met:
                met.add(name.lower())
                queue.append(name)

    join()
    report, at, draws = [], 1, 0
    while at <= total:
        promoted = 0
        if promote_every > 0 and at % promote_every == 0:
            promoted = loop.promote()
            join()
        fresh = reload and reload_every > 0 and (promoted > 0 or at % reload_every == 0)
        if fresh:
            planned = loop.plan() or planned
        batch: list[str] = []
        for _ in range(min(p.batch_items, total - at + 1)):
            item = None
            if queue:
                left = mine.setdefault(queue[0], loop.queries(queue[0])[: p.priority_queries] if queue[0] not in mine else [])
                item = left.pop(0) if left else None
                if item is None:
                    del mine[queue.pop(0)]
            if item is None and planned:
                item, draws = loop.draw(draws), draws + 1
            if item is None:
                break
            batch.append(item)
        if not batch:
            break
        report.append({"round": at, "promoted": promoted, "reloaded": fresh, "items": batch, "stored": loop.run(batch)})
        at += len(batch)
    return report
