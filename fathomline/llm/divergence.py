"""Source divergence audit: which sources of a language differ from one another, and by which terms.

Two passes over the texts: document frequencies say which terms are kept, then automata of the kept terms recount their occurrences.
What follows works on sparse postings, a row for each term and source where it occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut, small_batches, tidy

#: Bytes that belong to terms stay, A-Z in lower case; all others become a blank.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of one automaton, bytes of text that one automaton reads in one task, bytes of a block of texts.
SLICE, PART, BLOCK = 65_536, 32 << 20, 1 << 20
#: Counters go out when they hold so many terms, buffers of text when they hold so many bytes.
HELD_TERMS, HELD_BYTES = 300_000, 48 << 20
#: Pairs of one step of the pair sums.
PAIRS = 1 << 20
#: Unit of probabilities.
UNIT = 1_000_000_000


def _grouped(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang``, ``source`` and the UTF-8 ``text``, NULL as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def frequencies(rows: DataFrame) -> DataFrame:
    """First pass: ``lang``, ``term`` and the number ``df`` of its documents, counted in each task before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for name, terms in found.items():
                parts = [pa.array([name] * len(terms), pa.string()), pa.array(terms.keys(), pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(parts, ["lang", "term", "n"])
            found.clear()

        for b in tidy(batches):
            for name, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found[name].update(set(text.as_buffer().to_pybytes().translate(TERMS).split()))
            if sum(map(len, found.values())) > HELD_TERMS:
                yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks of text for the automata: ``lang``, ``slice``, ``part``, ``source``, ``text``.

    Each term of a text goes to the slice that its hash says, padded with blanks; what a task has for a slice and source goes out in blocks,
    dealt to the slice's parts in turn. ``rows`` has the ``slices`` and ``parts`` of its language.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, str], list[bytes]] = defaultdict(list)
        sizes: Counter = Counter()
        parts_of: dict[str, int] = {}
        turn: Counter = Counter()
        start = TaskContext.get().partitionId()

        def out(keys: list[tuple[str, int, str]]) -> pa.RecordBatch:
            made = []
            for name, s, source in keys:
                made.append((name, s, (start + turn[name, s]) % parts_of[name], source, b" ".join([b"", *held.pop((name, s, source)), b""])))
                turn[name, s] += 1
                del sizes[name, s, source]
            columns = list(zip(*made, strict=True))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "slice", "part", "source", "text"])

        for b in tidy(batches):
            full = []
            for name, source, n, parts, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "slices", "parts", "text")), strict=True):
                parts_of[name] = parts
                text = text.translate(TERMS)
                if n == 1:
                    shares = [(0, text)]
                else:
                    by: list[list[bytes]] = [[] for _ in range(n)]
                    for t in text.split():
                        by[crc32(t) % n].append(t)
                    shares = [(s, b" ".join(ts)) for s, ts in enumerate(by) if ts]
                for s, share in shares:
                    at = name, s, source
                    held[at].append(share)
                    sizes[at] += len(share) + 1
                    if sizes[at] >= BLOCK:
                        full.append(at)
            if full:
                yield out(list(dict.fromkeys(full)))
            if sizes.total() > HELD_BYTES:
                yield out(list(held))
        if held:
            yield out(list(held))

    return rows.mapInArrow(deal, "lang string, slice int, part int, source string, text binary")


def occurrences(terms: list[str], texts: list[tuple[str, str]]) -> dict[str, Counter]:
    """How often each of ``terms`` occurs in the texts of each source; terms stand between blanks there.

    One automaton of all terms, each padded with a blank on both sides, walks each text once: terms next to one another share their blank, and a
    part of a longer term never matches.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(f" {t} ", i)
    automaton.make_automaton()
    found: dict[str, Counter] = defaultdict(Counter)
    if terms:
        for source, text in texts:
            found[source].update(map(itemgetter(1), automaton.iter(text)))
    return {source: Counter({terms[i]: n for i, n in c.items()}) for source, c in found.items()}


def _recounted(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Second pass: ``lang``, ``source``, ``term`` and ``n`` of the blocks of each slice and part, by one automaton."""

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("term").to_pylist()
        texts = ((s, t.as_buffer().to_pybytes().decode(errors="replace")) for s, t in zip(left.column("source").to_pylist(), left.column("text"), strict=True))
        found = occurrences(names, texts)
        size = [len(c) for c in found.values()]
        parts = [
            pa.array([key[0].as_py()] * sum(size), pa.string()), pa.array(np.repeat(list(found), size).tolist() if found else [], pa.string()),
            pa.array([t for c in found.values() for t in c], pa.string()), pa.array([n for c in found.values() for n in c.values()], pa.int64()),
        ]
        return pa.Table.from_arrays(parts, ["lang", "source", "term", "n"])

    by = ["lang", "slice", "part"]
    return blocks.groupBy(*by).cogroup(terms.groupBy(*by)).applyInArrow(count, "lang string, source string, term string, n long")


def _floored(a: str, b: str) -> Column:
    return F.expr(f"({a}) div ({b})")


def _probability(df: DataFrame, name: str, count: str, words: str, terms: str) -> DataFrame:
    """Adds ``1 + floor(UNIT * (count + 1) / (words + terms))``; digits come out three at a time, so no product leaves a long."""
    whole = f"{words} + {terms}"
    df = df.withColumns({name: _floored(f"{count} + 1", whole), "_left": F.expr(f"({count} + 1) % ({whole})")})
    for _ in range(3):
        df = df.withColumns({name: F.expr(f"{name} * 1000") + _floored("_left * 1000", whole), "_left": F.expr(f"(_left * 1000) % ({whole})")})
    return df.withColumn(name, F.col(name) + 1).drop("_left")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _summed(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """A row for each pair, values of equal pairs added up."""
    keys, at = np.unique((a.astype(np.int64) << 32) | b.astype(np.int64), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, value)
    parts = [pa.array([lang] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(total)]
    return pa.RecordBatch.from_arrays(parts, ["lang", "a", "b", "value"])


PAIR = "lang string, a int, b int, value long"


def _met(postings: DataFrame) -> DataFrame:
    """What the terms that two sources share add to their pairs, beyond what each source adds alone (:func:`_alone`)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            names, of = batch.column("lang").to_pylist(), batch.column("of")
            if not names:
                continue
            ends = np.concatenate([[0], np.cumsum(of.value_lengths().to_numpy())])
            rows = of.flatten()
            source, p, p0 = (rows.field(i).to_numpy() for i in range(3))
            degree, names = np.diff(ends), np.array(names, object)
            for name in dict.fromkeys(names):
                for d in np.unique(degree[names == name]):
                    chosen = np.flatnonzero((names == name) & (degree == d))
                    step, tile = max(1, PAIRS // int(d) ** 2), max(1, PAIRS // int(d))
                    for i in range(0, len(chosen), step):
                        at = ends[chosen[i : i + step]][:, None] + np.arange(d)
                        s, x, x0 = source[at], p[at], p0[at]
                        for j in range(0, int(d), tile):
                            q, q0, t = x[:, j : j + tile, None], x0[:, j : j + tile, None], s[:, j : j + tile, None]
                            y, y0, u = x[:, None, :], x0[:, None, :], s[:, None, :]
                            value = _distance(q, y) - _distance(q, y0) - _distance(q0, y) + _distance(q0, y0)
                            t, u = np.broadcast_arrays(t, u)
                            own = t != u
                            yield _summed(name, t[own], u[own], value[own])

    return postings.filter(F.size("of") > 1).mapInArrow(sums, PAIR)


def _alone(sources: DataFrame) -> DataFrame:
    """What each source's terms add to its pairs when the other source lacks them.

    ``sources`` has, for each source ``a``, its distinct probabilities with how many terms have them, and the probability of an absent term for
    every other source of the language.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for r in batch.to_pylist():
                p, m = (np.array([x[c] for x in r["held"]], np.int64) for c in ("p", "m"))
                b, q0 = (np.array([x[c] for x in r["others"]], np.int64) for c in ("b", "p0"))
                b, q0 = b[b != r["a"]], q0[b != r["a"]]
                there, back = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                step = max(1, PAIRS // max(len(b), 1))
                for i in range(0, len(p), step):
                    x, n = p[i : i + step, None], m[i : i + step, None]
                    there += (n * _distance(x, q0[None, :])).sum(0)
                    back += (n * _distance(q0[None, :], x)).sum(0)
                a = np.full(len(b), r["a"])
                yield _summed(r["lang"], np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([there, back]))

    return sources.mapInArrow(sums, PAIR)


def audit(docs: DataFrame, least: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How each source's use of terms differs from that of the other sources of its language, and which terms make it stand out.

    Terms are runs of letters A-Z (lower-cased) and of anything beyond ASCII. A language keeps the terms of at least ``least`` of its documents.
    In a group, a language and source or a language, a term has the probability ``p = 1 + floor(10^9 (count + 1) / (N + V))``, with N the
    occurrences of kept terms there and V their number. Part ``pair``: for each source, every other ``item`` of its language, by the sum of
    ``(p - q)^2 // q`` over all kept terms. Part ``term``: for each source, the kept terms it uses more than its language does, by the same
    value, to rank ``ranks``. Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` (value descending, then item).

    Work follows the occurrences: kept terms are dealt to slices of some :data:`SLICE` terms by hash, and the texts' terms with them, so an
    automaton and what it reads are bounded in a task, whatever the vocabulary and however large a language or source is. Pairs come from the
    postings: a term costs the square of the number of sources that have it, a source the number of its distinct counts for each
    other source; terms that both lack cost nothing. What is collected in a row is at most a row per source of a language, whose square is the
    result. All arithmetic is on integers.

    NULL text, language and source count as empty, and so are languages and sources of their own. Groups without terms have pairs too (0 if
    the language keeps no term). Repeated rows count each time. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = _grouped(docs, text, lang, source)
    groups = cut(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "audit-groups")
    terms = cut(frequencies(rows).filter(F.col("df") >= least).select("lang", "term"), "audit-terms")
    sizes = groups.groupBy("lang").agg(F.sum("bytes").alias("bytes")).join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    slices = F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / SLICE), F.lit(1))
    sizes = sizes.select("lang", F.coalesce("v", F.lit(0)).alias("v"), slices.cast("int").alias("slices"), F.greatest(F.ceil(F.col("bytes") / slices / PART), F.lit(1)).cast("int").alias("parts"))
    sizes = cut(sizes.coalesce(1), "audit-sizes")

    blocks = _dealt(rows.join(sizes.filter("v > 0"), "lang").select("lang", "source", "slices", "parts", "text"))
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.col("slices").cast("long")).cast("int")
    padded = terms.join(sizes, "lang").select("lang", slot.alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "term")
    counted = _recounted(blocks, padded).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "term"))), "audit-counts")

    words = counted.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    sources = groups.join(words, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang")
    sources = sources.select("lang", "source", number.alias("a"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("terms", F.lit(0)).alias("terms"), "v")
    sources = sources.withColumn("all_words", F.sum("words").over(Window.partitionBy("lang")))
    # A language without kept terms has no probabilities; 1 keeps the division defined, and 0 terms make its values 0.
    sources = cut(_probability(sources.withColumn("_v", F.greatest("v", F.lit(1))).withColumn("_none", F.lit(0)), "p0", "_none", "words", "_v").drop("_v", "_none"), "audit-sources")

    known = counted.join(sources.drop("terms", "p0"), ["lang", "source"])
    known = _probability(_probability(known, "p", "n", "words", "v"), "q", "total", "all_words", "v")
    found = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _floored("(p - q) * (p - q)", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)

    postings = _probability(counted.join(sources.drop("terms", "all_words"), ["lang", "source"]), "p", "n", "words", "v")
    shared = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("a", "p", "p0")).alias("of"))
    held = postings.groupBy("lang", "a", "p").agg(F.count("*").alias("m")).groupBy("lang", "a").agg(F.collect_list(F.struct("p", "m")).alias("held"))
    others = sources.groupBy("lang").agg(F.collect_list(F.struct(F.col("a").alias("b"), "p0")).alias("others"))
    one, two = sources.select("lang", "source", "a", "terms", "p0", "v"), sources.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("terms").alias("terms_b"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").filter("a <> b").withColumn("value", F.expr("(v - terms - terms_b)") * _floored("(p0 - q0) * (p0 - q0)", "q0"))
    more = _met(shared).unionByName(_alone(held.join(others, "lang"))).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    pairs = pairs.join(more, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.coalesce("more", F.lit(0))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
