"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm import spans

#: Kinds in listed order; ``entropy`` is what the windows add.
KINDS = ["assign", "access", "hex", "entropy"]
# Fixed patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Candidate strings of the entropy scan: runs of base64, base64url and hexadecimal characters, with padding. An equals sign that more
#: characters follow separates a name from its value; both are candidates.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_-]))?+"
#: Characters of a window.
WINDOW = 20
#: By class of the candidate's characters: the pattern that all of it fits, and the least entropy, in bits a character, of its
#: richest window. The first class that fits counts.
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9),
    "alphanumeric": (r"^[A-Za-z0-9]+$", 3.6),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.8),
}
#: Candidates that fit one of these are never flagged. Repeated groups are possessive: Java's other ones recurse for each repeat.
ALLOWED = (
    r"^[0-9+/_=-]++$",  # numbers
    r"^[A-Za-z+/_=-]++$",  # words, paths and names without a digit
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^(?:[A-Za-z]++[0-9]{0,4}+|[0-9]{1,4}+)(?:[-_/+](?:[A-Za-z]++[0-9]{0,4}+|[0-9]{1,4}+))*+$",  # names with parts and versions
    r"^(.{1,8})\1++.{0,8}$",  # repetitions
    r"(?i)0123456789|abcdefgh|example|placeholder|changeme|xxxx",  # stand-ins
)
#: Where a candidate falls into parts, which are looked at too: a key may stand in a path or behind a prefix.
SEPARATORS = "[-+/_]"


def entropy(s: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any ``window`` characters in a row of ``s``; 0 if ``s`` is shorter.

    The entropy of a window is ``log2(w) - sum(c * log2(c)) / w`` over its character counts ``c``. The counts of the string's
    different characters go along: from one window to the next one character leaves and one comes, so two counts and their
    two terms of the sum change. Time grows with length times the number of different characters.
    """
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    term = lambda n: F.get(terms, n)

    def walk(came: Column, letters: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gone, counts = F.coalesce(F.get(came, acc["n"] - window), F.lit(0)), acc["counts"]  # 0 stands before the string
            more, less = F.element_at(counts, x), F.get(counts, gone - 1)
            left = F.when(gone > 0, term(less) - term(less - 1)).otherwise(0.0)
            total = F.when(x == gone, acc["sum"]).otherwise(acc["sum"] + term(more + 1) - term(more) - left)
            moved = F.when(x == gone, counts).otherwise(F.transform(counts, lambda c, i: c + (i + 1 == x).cast("int") - (i + 1 == gone).cast("int")))
            bits = F.log2(F.lit(float(window))) - total / window
            best = F.when(acc["n"] >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(moved.alias("counts"), total.alias("sum"), best.alias("best"), (acc["n"] + 1).alias("n"))

        start = F.struct(F.array_repeat(F.lit(0), letters).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))
        return F.aggregate(came, start, step, lambda acc: acc["best"])

    def coded(chars: Column) -> Column:
        # Each character as its place in the alphabet, from 1.
        places = lambda alphabet: F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
        return spans.let(F.array_distinct(chars), lambda alphabet: spans.let(places(alphabet), lambda came: walk(came, F.size(alphabet))))

    return F.when(F.length(s) >= window, spans.let(F.split(s, ""), coded)).otherwise(0.0)


def _suspect_alone(s: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(s.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(F.coalesce(entropy(s) >= least, F.lit(False)))


def _suspect(s: Column) -> Column:
    """Whether a candidate as a whole, or one of its parts of a window or more, is rich enough and not on the allow-list."""
    parts = F.filter(F.split(s, SEPARATORS), lambda p: (F.length(p) >= WINDOW) & (p != s))
    return F.exists(F.concat(F.array(s), parts), _suspect_alone)


def find(text: Column) -> tuple[Column, Column]:
    """``(base, added)`` spans of a text that isn't NULL."""
    lower = F.lower(text)
    named = (F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api")))
    named = named & (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    value = lambda s: F.length(F.regexp_extract(s["match"], "^" + ASSIGN, 1)) >= 12
    assign = spans.only_if(named, F.filter(spans.matches(text, ASSIGN, 0), value))
    access = F.filter(spans.matches(text, ACCESS, 1), lambda s: F.length(s["match"]) >= 18)
    # A run is taken whole, so shorter runs need not be found to be dropped.
    runs = text.rlike("[0-9a-f]{16}")
    base = F.concat(
        assign, spans.only_if(F.contains(text, F.lit("AKIA")), access), spans.only_if(runs, spans.matches(text, "(?<![0-9a-f])[0-9a-f]{16,}+", 2)),
    )
    strings = F.filter(spans.matches(text, CANDIDATE, 3), lambda s: _suspect(s["match"]))
    return base, spans.only_if(text.rlike("[A-Za-z0-9+/_-]{20}"), strings)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``found`` to ``docs``: arrays of spans, ``found`` with those that entropy adds.

    Base spans are matches of the fixed patterns, leftmost and non-overlapping by kind, that meet their length. Candidate
    strings with a rich enough window (:func:`entropy`, :data:`CLASSES`) are added unless :data:`ALLOWED` or inside a base
    span. Offsets count code points of the whole text; ends are exclusive; a span holds ``start``, ``rank`` (place in
    :data:`KINDS`), ``end``, ``match`` and ``left``. NULL texts count as empty and have none. Rows are looked at one by one, so
    ties and repeats don't matter; columns named ``base`` and ``found`` are replaced.
    """
    base, added = find(F.coalesce(F.col(text), F.lit("")))
    outside = F.filter(
        F.col("_added"), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    )
    found = docs.withColumns({"base": base, "_added": added})
    return found.withColumn("found", F.concat("base", outside)).drop("_added")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every found span in ``text`` by ``mark``; overlapping spans become one mark. Other columns stay."""
    rows = scan(docs, text)

    part = lambda start, end: F.substring(F.col(text), start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))

    def piece(s: Column, at: Column) -> Column:
        # What stands between the end so far and this span, then a mark unless the span continues the last.
        return F.when(s["end"] <= at, F.lit("")).otherwise(F.concat(part(at, s["start"]), F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit(""))))

    def replaced(slim: Column, reached: Column) -> Column:
        pieces = F.array_join(F.zip_with(slim, F.slice(reached, F.lit(1), F.size(slim)), piece), "")
        return F.concat(pieces, F.substring(F.col(text), F.element_at(reached, -1).cast("int") + 1, F.length(F.col(text))))

    slim = F.transform(F.array_sort("found"), lambda s: F.struct(s["start"], s["end"]))
    marked = spans.let(slim, lambda s: spans.let(spans.running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda reached: replaced(s, reached)))
    clean = F.when(F.size("found") > 0, marked).otherwise(F.col(text))
    return rows.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_assign``, ``n_access``, ``n_hex`` (base spans by kind), ``base_sha256``, ``spans``. See :func:`scan`."""
    rows = scan(docs.select(F.col(key), F.col(text).alias("_text")), "_text")
    return rows.select(
        key, *(spans.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(spans.listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), spans.listed(F.col("found"), KINDS).alias("spans"),
    )
