"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import WORD, cut, small_batches, tidy

#: A set member is a 48-bit hash of a shingle, kept in so many bytes.
WIDTH = 6
#: Slots of the frequency sketch, as a power of two; it is what the driver gets, a byte a slot.
SKETCH_BITS = 20
#: Bits of a bitmap for each member of its set, about.
DENSITY = 2
#: Bits of the filter of wanted texts, as a power of two. It has this size for any input and only spares moving texts that a join drops.
FILTER_BITS = 25
#: Members of a tree's leaf, children of a node, members of a target in verification, askers of one, and of a bundle's part.
LEAF, FAN, TARGET, ASKERS, PART = 16, 8, 512, 512, 2048
#: Members of other components that a class asks in each bundle, at most, before components as wholes are asked.
FEW = 4

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct hashed shingles of whole texts. A word's hash is a polynomial over its bytes, from prefix sums of the text."""

    def __init__(self, words: int = 5):
        self.words, self.table = words, mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
        self.size, self.up, self.down = 0, None, None

    def _word_hashes(self, data: np.ndarray) -> np.ndarray:
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).view(np.int8)))
        start, end = edges[::2], edges[1::2]
        if len(data) > self.size:
            self.size = max(len(data), 1 << 16)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INVERSE, self.size)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, text: str) -> np.ndarray:
        """Sorted, different; lower-cases A-Z. Fewer words than a shingle has are one together; no words, none."""
        data = text.encode().lower()  # of bytes, so ASCII alone
        if not data:
            return np.zeros(0, np.uint64)
        h = self._word_hashes(np.frombuffer(data, np.uint8))
        n = len(h) - self.words + 1
        if not len(h):
            return h
        if n < 1:
            n, of = 1, len(h)
        else:
            of = self.words
        out = np.full(n, of, np.uint64)
        for i in range(of):
            out = mixed(out * _MIX[1] + h[i : i + n])
        return np.unique(out >> np.uint64(64 - 8 * WIDTH))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _bits(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: :data:`DENSITY` a member, rounded up to a power of two, 64 at least."""
    return max(64, DENSITY << (int(n) - 1).bit_length())


def bitmap(values: np.ndarray) -> bytes:
    m = _bits(len(values))
    bits = np.zeros(m, np.uint8)
    bits[(values & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps with half the bits, until ``words`` 64-bit words are left: low bits of the hash alone decide."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows that agree in ``by``, over the borders of batches. Cheap for many small groups."""
    held: list[dict[str, np.ndarray]] = []

    def whole(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        keys = np.stack([columns[c] for c in by])
        bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        if held and any(held[-1][c][-1] != columns[c][0] for c in by):
            yield whole(held)
            held = []
        for start, end in itertools.pairwise(bounds):
            held.append({c: v[start:end] for c, v in columns.items()})
            if end < len(batch):
                yield whole(held)
                held = []
    if held:
        yield whole(held)


class Tree:
    """A signature tree over sets, given as sizes and bitmaps: nodes hold OR- and AND-combined bitmaps, size range and group.

    Members are in order of size, then bitmap, so nodes have narrow size ranges and like members together.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((maps[:, 0], groups, sizes))
        self.sizes, self.maps, self.groups = sizes[self.order], maps[self.order], groups[self.order]
        n = len(sizes)
        starts = np.arange(0, n, LEAF)
        ends = np.minimum(starts + LEAF, n)
        self.levels = []
        any_, all_ = np.bitwise_or.reduceat(self.maps, starts), np.bitwise_and.reduceat(self.maps, starts)
        low, high = self.sizes[starts], self.sizes[ends - 1]
        least, most = np.minimum.reduceat(self.groups, starts), np.maximum.reduceat(self.groups, starts)
        while True:
            self.levels.append((any_, all_, low, high, least, most, starts, ends))
            if len(starts) == 1:
                break
            up = np.arange(0, len(starts), FAN)
            any_, all_ = np.bitwise_or.reduceat(any_, up), np.bitwise_and.reduceat(all_, up)
            low, high = np.minimum.reduceat(low, up), np.maximum.reduceat(high, up)
            least, most = np.minimum.reduceat(least, up), np.maximum.reduceat(most, up)
            starts, ends = starts[up], ends[np.minimum(up + FAN, len(ends)) - 1]


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of sizes ``a`` and ``b`` with ``100 * intersection >= percent * union``."""
    return -(-percent * (a + b) // (100 + percent))


def _misses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of each of ``a`` that each of ``b`` lacks."""
    return np.bitwise_count(a[:, None, :] & ~b[None, :, :]).sum(2, dtype=np.int64)


def dual_traversal(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members, as places in what the trees were made of, that may link and are of different groups.

    Descends both trees together. A pair of nodes goes no further when all members of both are of one group, or when no
    two sizes in their ranges are near enough, or when the greatest possible overlap is too small: a member of one shares
    at most its size less the bits that all members of its node set and no member of the other node sets.
    """
    level, i, j = max(len(x.levels), len(y.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64)
    at = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    out_i, out_j = [], []
    while True:
        a, b = at(x, level), at(y, level)
        lo_a, hi_a, lo_b, hi_b = a[2][i], a[3][i], b[2][j], b[3][j]
        near = (100 * hi_a >= percent * lo_b) & (100 * hi_b >= percent * lo_a)
        one = (a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j])
        i, j = i[near & ~one], j[near & ~one]
        if x is y:
            i, j = i[i <= j], j[i <= j]
        keep = []
        for s in range(0, len(i), 4096):
            p, q = i[s : s + 4096], j[s : s + 4096]
            miss_a = np.bitwise_count(a[1][p] & ~b[0][q]).sum(1, dtype=np.int64)
            miss_b = np.bitwise_count(b[1][q] & ~a[0][p]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(a[3][p], b[3][q]), np.minimum(a[3][p] - miss_a, b[3][q] - miss_b))
            keep.append(most >= overlap_needed(a[2][p], b[2][q], percent))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if level == 0 or not len(i):
            break
        level -= 1

        def children(t: Tree, k: np.ndarray, level: int = level) -> tuple[np.ndarray, np.ndarray]:
            """First child and number of children; a tree that has no such level yet stays at its root."""
            if level + 1 > len(t.levels) - 1:
                return k, np.ones(len(k), np.int64)
            n = len(t.levels[level][0])
            return k * FAN, np.minimum(FAN, n - k * FAN)

        (fi, ni), (fj, nj) = children(x, i), children(y, j)
        total = ni * nj
        step = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nj, total)
        i, j = np.repeat(fi, total) + step // width, np.repeat(fj, total) + step % width
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        sa, ea, sb, eb = x.levels[0][6][p], x.levels[0][7][p], y.levels[0][6][q], y.levels[0][7][q]
        na, nb = x.sizes[sa:ea, None], y.sizes[None, sb:eb]
        most = np.minimum(na - _misses(x.maps[sa:ea], y.maps[sb:eb]), nb - _misses(y.maps[sb:eb], x.maps[sa:ea]).T)
        fit = (most >= overlap_needed(na, nb, percent)) & (x.groups[sa:ea, None] != y.groups[None, sb:eb])
        u, v = np.nonzero(fit)
        if x is y:
            u, v = u[sa + u < sb + v], v[sa + u < sb + v]
        out_i.append(x.order[sa + u])
        out_j.append(y.order[sb + v])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i) if out_i else none, np.concatenate(out_j) if out_j else none


def candidates(sizes: np.ndarray, maps: list[bytes], groups: np.ndarray, percent: int, parts: tuple[np.ndarray, np.ndarray] | None = None):
    """Pairs that may link, by signature trees: one per bitmap width, each held against itself and the next wider.

    Sizes of linked sets differ by less than two, so their widths are equal or next to one another. ``parts`` names the members
    of two sides, when only pairs between them are asked for.
    """
    widths = np.array([len(m) // 8 for m in maps])
    sides = parts or (np.arange(len(sizes)),)
    trees: dict[tuple[int, int, int], tuple[Tree, np.ndarray]] = {}

    def tree(side: int, width: int, fold: int) -> tuple[Tree, np.ndarray] | None:
        if (side, width, fold) not in trees:
            of = sides[side][widths[sides[side]] == width]
            if not len(of):
                return None
            at = np.frombuffer(b"".join(maps[k] for k in of), "<u8").reshape(len(of), -1)
            trees[side, width, fold] = Tree(sizes[of], np.ascontiguousarray(_folded(at, fold)), groups[of]), of
        return trees[side, width, fold]

    last = len(sides) - 1
    for w in np.unique(widths):
        meets = [((0, w), (last, w)), ((0, w), (last, 2 * w))] + ([((0, 2 * w), (last, w))] if last else [])
        for (s, a), (t, b) in meets:
            x, y = tree(s, a, w), tree(t, b, w)
            if x and y:
                i, j = dual_traversal(x[0], y[0], percent)
                yield x[1][i], y[1][j]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(text).alias("_h"))


def _class(members: np.ndarray) -> int:
    """A hash of a whole set: documents of one class have equal sets."""
    return int(mixed(mixed(members).sum(keepdims=True) ^ np.uint64(len(members))).view(np.int64)[0])


def _surveyed(docs: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, np.ndarray]:
    """A row per document - text hash ``h``, set size ``n``, class ``k``, bitmap ``map`` - and the ranks of the frequency sketch.

    Sets themselves aren't kept, they take more room than texts. The sketch counts all members of all sets in slots by hash;
    each task gives its counts in pieces, after its rows, and the driver gets their sums. The rank of a slot is how much more
    than usual its members are met, as a power of two, at most 15: only frequent members stand out.
    """
    slots, piece = 1 << SKETCH_BITS, 1 << 14

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, total = Shingler(words), np.zeros(slots, np.int64)
        for b in tidy(batches):
            n, k, maps = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), []
            for i, t in enumerate(b["_text"]):
                s = shingler.shingles(t)
                maps.append(bitmap(s) if len(s) else b"")
                if len(s):
                    n[i], k[i] = len(s), _class(s)
                    np.add.at(total, (s >> np.uint64(8 * WIDTH - SKETCH_BITS)).astype(np.int64), 1)
            yield pd.DataFrame({key: b[key].to_numpy(), "h": b["_h"].to_numpy(), "n": n, "k": k, "map": maps, "piece": -1})
        for i in range(0, slots, piece) if total.any() else ():
            yield pd.DataFrame({key: [None], "h": 0, "n": 0, "k": 0, "map": [total[i : i + piece].astype("<u4").tobytes()], "piece": i // piece})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in tidy(batches):
            for i, c in zip(b["piece"], b["map"], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        for i, c in sums.items():
            yield pd.DataFrame({"piece": [i], "counts": [c.astype("<i8").tobytes()]})

    kind = docs.schema[key].dataType.simpleString()
    found = cut(_texts(docs, key, text).mapInPandas(rows, f"`{key}` {kind}, h long, n long, k long, map binary, piece int"), "jaccard-survey")
    summed = found.filter("piece >= 0").select("piece", "map").repartition(16, "piece").mapInPandas(add, "piece int, counts binary")
    total = np.zeros(slots, np.int64)
    for r in cut(summed, "jaccard-sketch").toLocalIterator():  # a fixed number of rows
        total[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], "<i8")
    middle = float(np.median(total))
    usual = max(1.0, middle + 4 * middle**0.5)
    ranks = np.clip(np.floor(np.log2(np.maximum(total / usual, 1))) + (total > usual), 0, 15).astype(np.uint8)
    return found.filter("piece < 0").drop("piece"), ranks


def _prefixes(texts: DataFrame, ranks: np.ndarray, percent: int, words: int) -> DataFrame:
    """``k`` and ``ms``, the prefix of its set, of each different text of a batch.

    In a global order of members, rare ones first, two sets that link share one of the first ``n - ceil(n * percent / 100) + 1``
    of each.
    """
    shift, top = np.uint64(8 * WIDTH - SKETCH_BITS), np.uint64(8 * WIDTH)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, low = Shingler(words), np.uint64((1 << (8 * WIDTH)) - 1)
        for b in tidy(batches):
            ks, ms = [], []
            for t in b["_text"].drop_duplicates():
                v = shingler.shingles(t)
                if len(v):
                    ks.append(_class(v))
                    v |= ranks[(v >> shift).astype(np.int64)].astype(np.uint64) << top
                    take = len(v) - -(-len(v) * percent // 100) + 1
                    ms.append(((np.partition(v, take - 1)[:take] if take < len(v) else v) & low).view(np.int64))
            yield pd.DataFrame({"k": np.array(ks, np.int64), "ms": pd.Series(ms, dtype=object)})

    return texts.select("_text").mapInPandas(rows, "k long, ms array<long>")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap by the first bits of the hashes ``h``: says for certain of some others that they aren't there."""
    piece = F.shiftrightunsigned("h", 64 - FILTER_BITS + 15).cast("int")

    def one(b: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << 15, np.uint8)
        part[((b["h"].to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)) & np.uint64((1 << 15) - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"piece": b["piece"].iloc[:1], "bits": [np.packbits(part).tobytes()]})

    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    one_each = hashes.groupBy(slot.alias("slot")).agg(F.first("h").alias("h")).select("h", piece.alias("piece"))
    for r in cut(one_each.groupBy("piece").applyInPandas(one, "piece int, bits binary"), "jaccard-filter").toLocalIterator():
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _members(wanted: DataFrame, texts: DataFrame, key: str, words: int) -> DataFrame:
    """``k`` and ``set`` of the classes in ``wanted`` (``k``, and ``doc``: key and text hash of one document that has the set)."""
    seen = _filter(wanted.select("doc.h"))
    kinds = f"`{key}` {texts.schema[key].dataType.simpleString()}, _text string, _h long"

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in tidy(batches):
            at = b["_h"].to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            yield b[(seen[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]

    own = wanted.select(F.col("doc.key").alias("_key"), F.col("doc.h").alias("_own"))
    some = texts.mapInPandas(likely, kinds)
    some = some.join(own, (F.col("_h") == F.col("_own")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi").select("_text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in tidy(batches):
            sets = [shingler.shingles(t) for t in b["_text"].drop_duplicates()]
            yield pd.DataFrame({"k": np.array([_class(s) for s in sets], np.int64), "set": [packed(s) for s in sets]})

    # Rows that repeat key and text may give a class more than once.
    return cut(some.mapInPandas(rows, "k long, set binary").dropDuplicates(["k"]), "jaccard-sets")


def verify(asks: DataFrame, targets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links found between askers and members of targets: for each asker and target the first, as ``a``, ``b``.

    ``asks``: ``a`` (class), ``t``, different rows; ``targets``: ``t``, ``k`` (at most :data:`TARGET` a target); ``members``: ``k``, ``set``. Each task
    holds a target's sets as one inverted list and counts the overlaps of up to about :data:`ASKERS` askers with all of them
    exactly. A target that more ask is held in as many tasks.
    """
    counts = asks.groupBy("t").agg(F.count("*").alias("asked"))
    parts = cut(counts.select("t", F.ceil(F.col("asked") / ASKERS).cast("int").alias("parts")), "jaccard-parts")
    own = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    asks = asks.join(parts, "t").select("t", own.alias("part"), F.col("a").alias("k"), F.lit(True).alias("asks"))
    held = targets.join(parts, "t").select("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k", F.lit(False).alias("asks"))
    both = asks.unionByName(held).join(members.select("k", "set"), "k")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, c = [], []
        for g in _groups(tidy(batches), ["t", "part"]):
            own = ~g["asks"].astype(bool)
            sets, ks = [unpacked(s) for s in g["set"][own]], g["k"][own]
            if not len(sets) or own.all():
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            if len(sets) > 1:
                order = np.argsort(values, kind="stable")
                values, of = values[order], of[order]
            for k, data in zip(g["k"][~own], g["set"][~own], strict=True):
                v = unpacked(data)
                low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                common = np.bincount(of[at], minlength=len(sets))
                linked = np.flatnonzero((100 * common >= percent * (sizes + len(v) - common)) & (ks != k))
                if len(linked):
                    a.append(k)
                    c.append(ks[linked[0]])
            if len(a) >= 10_000:
                yield pd.DataFrame({"a": a, "b": c}, dtype="int64")
                a, c = [], []
        yield pd.DataFrame({"a": a, "b": c}, dtype="int64")

    return both.repartition("t", "part").sortWithinPartitions("t", "part", "asks").mapInPandas(found, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``k`` and ``c``, the least ``k`` reachable by ``links`` (``a``, ``b``). Labels spread along links and jump to their label's label."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    linked = edges.select(F.col("a").alias("k")).distinct()
    labels = cut(linked.withColumn("c", F.col("k")), "jaccard-labels")
    while True:
        spread = edges.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("s"))
        new = labels.join(spread, "k").select("k", F.col("c").alias("was"), F.least("c", "s").alias("c"))
        jump = labels.select(F.col("k").alias("c"), F.col("c").alias("far"))
        # What a label points to may have moved this round already; the last round's pointer is enough to converge.
        new = new.join(jump, "c", "left").select("k", "was", F.least("c", F.coalesce("far", "c")).alias("c"))
        new = cut(new, "jaccard-labels")
        labels = new.select("k", "c")
        if new.filter("c < was").isEmpty():
            break
    return nodes.join(labels, "k", "left").select("k", F.coalesce("c", "k").alias("c"))


def _dealt(bundles: DataFrame, known: DataFrame) -> DataFrame:
    """The members of bundles ``b``, ``k`` with what is known of them, sorted by bundle in tasks; a bundle of several parts of at most about
    :data:`PART` comes as pairs ``i``, ``j`` of parts ``p``, and each member in all pairs that hold its own."""
    parts = cut(bundles.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "jaccard-open")
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    spread = bundles.join(parts, "b").select("b", "k", own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    spread = spread.select("b", "k", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j")).join(known, "k")
    return spread.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")


def _sides(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    i, j = g["i"][0], g["j"][0]
    return (np.flatnonzero(g["p"] == i), np.flatnonzero(g["p"] == j)) if i != j else None


def _gathered(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Different rows, many small frames as one."""
    held, size = [], 0
    for f in found:
        held.append(f)
        size += len(f)
        if size >= 10_000:
            yield pd.concat(held).drop_duplicates()
            held, size = [], 0
    if held:
        yield pd.concat(held).drop_duplicates()


def _first_asks(bundles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """By signature trees over bundles and their centres: ``a``, ``t`` of each class that may link with its centre ``t``, and ``a``, ``a`` of each
    that may link with any other of a bundle."""
    every = bundles.unionByName(bundles.select("b", F.col("b").alias("k")).distinct())

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(tidy(batches), ["b", "i", "j"]):
            k, b, own = g["k"], g["b"][0], np.arange(len(g["k"]))
            for x, y in candidates(g["n"], g["map"], own, percent, _sides(g)):
                some = k[np.unique(np.concatenate([x, y]))]
                star = np.concatenate([k[x[k[y] == b]], k[y[k[x] == b]]])
                yield pd.DataFrame({"a": np.concatenate([some, star]), "t": np.concatenate([some, np.full(len(star), b)])})

    return cut(_dealt(every, classes).mapInPandas(lambda x: _gathered(asks(x)), "a long, t long").distinct(), "jaccard-asks")


def _tree_asks(bundles: DataFrame, known: DataFrame, percent: int, few: int | None) -> DataFrame:
    """Who asks whom inside bundles, found by signature trees over their members: different rows ``a``, ``t``.

    ``bundles``: ``b`` and ``k``; ``known``: ``k``, ``n``, ``map``, its component ``c`` and how many classes that has, ``members``. Pairs of different
    components that may link come from :func:`candidates`; the class of the smaller component asks. With ``few``, each asks at most so many
    classes of a bundle (of a pair of its parts), those of least hash, so many ask the same ones. Without, it asks components: ``t`` is ``c``.
    """
    sides = bundles.join(known.select("k", "c"), "k").groupBy("b").agg(F.min("c").alias("x"), F.max("c").alias("y"))
    wide = cut(bundles.join(sides.filter("x < y").select("b"), "b", "left_semi"), "jaccard-wide")

    def asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(tidy(batches), ["b", "i", "j"]):
            k, c, members = g["k"], g["c"], g["members"]
            for x, y in candidates(g["n"], g["map"], c, percent, _sides(g)):
                swap = (members[x] > members[y]) | ((members[x] == members[y]) & (c[x] < c[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                out = pd.DataFrame({"a": k[x], "t": c[y] if few is None else k[y]}).drop_duplicates()
                if few is not None and len(out) > few:
                    out = out.iloc[np.argsort(mixed(out["t"].to_numpy().view(np.uint64)), kind="stable")].groupby("a").head(few)
                yield out

    return cut(_dealt(wide, known).mapInPandas(lambda x: _gathered(asks(x)), "a long, t long").distinct(), "jaccard-asks")


def grouped(docs: DataFrame, percent: int = 80, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``h`` (hash of the text), ``n_shingles``, ``c`` (component, NULL for sets without members), ``component_id``. See :func:`join`."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, key, text)
    survey, ranks = _surveyed(docs, key, text, words)
    doc = F.min(F.struct(F.col(key).alias("key"), "h")).alias("doc")
    classes = cut(survey.filter("n > 0").groupBy("k").agg(F.min(key).alias("least"), doc, F.first("n").alias("n"), F.first("map").alias("map")), "jaccard-classes")

    # Who shares a prefix member: its run's class of least number, the centre, and all others of the run make a bundle.
    entries = cut(_prefixes(texts, ranks, percent, words), "jaccard-prefixes").select("k", F.explode("ms").alias("m"))
    runs = entries.groupBy("m").agg(F.min("k").alias("b"), F.max("k").alias("z")).filter("b < z").select("m", "b")
    bundles = cut(entries.join(cut(runs, "jaccard-runs"), "m").filter("k != b").select("b", "k").distinct(), "jaccard-bundles")
    # Trees tell who may link at all. All of those ask their centre: that joins most groups of near copies, and settles all pairs with a centre.
    asks = _first_asks(bundles, classes.select("k", "n", "map"), percent)
    nodes = cut(asks.select(F.col("a").alias("k")).distinct(), "jaccard-nodes")
    bundles = cut(bundles.join(nodes, "k", "left_semi"), "jaccard-bundles")
    members = _members(cut(nodes.join(classes, "k").select("k", "doc"), "jaccard-wanted"), texts, key, words)
    stars = asks.filter("a != t")
    links = cut(verify(stars, stars.select("t", F.col("t").alias("k")).distinct(), members, percent), "jaccard-found")
    for few in (FEW, None):
        comps = cut(components(nodes, links), "jaccard-comps")
        size = comps.groupBy("c").agg(F.count("*").alias("members"))
        known = cut(comps.join(size, "c").join(classes.select("k", "n", "map"), "k"), "jaccard-known")
        asks = _tree_asks(bundles, known, percent, few)
        if asks.isEmpty():
            break
        if few is not None:
            targets = asks.select("t", F.col("t").alias("k")).distinct()
        else:
            # Components in parts of bounded size; who asks a component asks all its parts.
            asked = comps.join(asks.select(F.col("t").alias("c")).distinct(), "c").join(size, "c")
            place = F.pmod(F.xxhash64(F.lit(1), "k"), F.ceil(F.col("members") * 2 / TARGET))
            targets = cut(asked.select("k", "c", F.xxhash64("c", place).alias("t")), "jaccard-targets")
            asks = cut(asks.withColumnRenamed("t", "c").join(targets.select("c", "t").distinct(), "c").select("a", "t"), "jaccard-asks")
        links = cut(links.unionByName(verify(asks, targets.select("t", "k"), members, percent)), "jaccard-found")
    else:
        comps = components(nodes, links)
    return _labelled(survey, classes, comps, key)


def _labelled(survey: DataFrame, classes: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """Each row of the survey with its component and the component's least key."""
    merged = classes.join(comps, "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = merged.groupBy("c").agg(F.min("least").alias("component_id"))
    by_class = cut(merged.join(least, "c").select("k", "c", "component_id"), "jaccard-classes")
    found = survey.select(key, "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("k")).alias("k")).join(by_class, "k", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    return found.select(key, "h", "n_shingles", "c", own.alias("component_id"))


def join(docs: DataFrame, percent: int = 80, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles link: ``100 * intersection >= percent * union``.

    Documents with equal sets are one class, so copies cost nothing. Classes that share a rare enough shingle
    (:func:`_prefixes`) may link. Those of one shingle, its run, form a bundle around the run's class of least number; runs
    with the same such centre are one bundle, so a pair is met once and not once a shingle. All of a bundle ask its centre.
    Then signature trees over a bundle's members give pairs of different components that may link (:func:`candidates`),
    twice: first each class asks a few others, which leaves few components even in large groups of near copies;
    then each that still may link asks the others' components as wholes, in parts, exactly (:func:`verify`). Nothing is sampled
    or capped: large bundles are split into parts whose pairs are all searched.

    Set members are 48-bit hashes of shingles and classes 64-bit hashes of sets: two sets of ``n`` members meet by chance in one
    with probability near ``n**2 / 2**48``, and any two of ``d`` different sets are taken for equal with ``d**2 / 2**65``.

    Returns ``key``, ``n_shingles``, ``component_id`` (least ``key`` reachable, itself included) for each row. NULL and blank texts
    have no shingles and are linked with nothing; fewer words than a shingle has are one together. Rows are told apart by
    place, so repeated keys give a row each; a NULL key counts in no minimum, and a component of only those has NULL. An
    empty table gives no rows. Other columns are ignored.
    """
    return grouped(docs, percent, words, key, text).select(key, "n_shingles", "component_id")


def dedupe(docs: DataFrame, percent: int = 80, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least key, NULL last, then text hash. See :func:`join`.

    Rows without shingles are linked with nothing and all stay. Of rows equal in key and text one stays. All columns are kept;
    one named ``_turn`` is left out.
    """
    found = grouped(docs, percent, words, key, text).filter(F.col("c").isNotNull())
    first = found.groupBy("c").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), "h")).alias("x")).select(F.col("x.k").alias("_first_key"), F.col("x.h").alias("_first_hash"))
    columns = [c for c in docs.columns if c != "_turn"]
    rows = docs.select(*(F.col(f"`{c}`") for c in columns), F.xxhash64(text).alias("_turn"), F.col(key).alias("_turn_key"))
    empty = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) == 0
    kept = rows.join(first, F.col("_turn_key").eqNullSafe(F.col("_first_key")) & (F.col("_turn") == F.col("_first_hash")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_turn_key", "_turn").orderBy(F.lit(0)))
    kept = kept.withColumn("_turn", turn).filter("_turn = 1").select(*(F.col(f"`{c}`") for c in columns))
    return kept.unionByName(docs.select(*(F.col(f"`{c}`") for c in columns)).filter(empty))
