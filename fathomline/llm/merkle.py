"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut
from fathomline.llm.spans import let

#: Words of a leaf; paragraphs of fewer code points than this have a leaf for each word.
LEAF_WORDS, SHORT_PARAGRAPH = 4, 64
#: Code points of the texts of one shuffle partition, about.
PARTITION_CHARS = 4 << 20
SECTION = r"(?:[^\n]++|\n(?!\n))++\n*+|\n++"
PARAGRAPH = r"[^\n]++\n*+|\n++"
LEAF = r"(?:[^\x20\n]++\x20*+){1,%d}\n*+|[\x20\n]++"


def tree(text: Column) -> Column:
    """The tree of a text that isn't NULL: an array of sections ``h``, ``p``; ``p`` holds paragraphs ``h``, ``l``; ``l`` holds leaves.

    A section ends with blank lines, a paragraph with its line, a leaf after four words, or one in a short paragraph. Each level
    takes all of its text. A leaf is the low 32 bits of a hash of its text, ``h`` of an inner node 64 bits of the 64-bit hashes below.
    """
    runs = lambda p, n: F.regexp_extract_all(p, F.lit(LEAF % n), F.lit(0))
    cut_up = lambda p: F.when(F.length(p) < SHORT_PARAGRAPH, runs(p, 1)).otherwise(runs(p, LEAF_WORDS))
    low = lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")
    node = lambda leaves: F.struct(F.xxhash64(leaves).alias("h"), F.transform(leaves, low).alias("l"))
    paragraph = lambda p: let(F.transform(cut_up(p), lambda x: F.xxhash64(x)), node)
    section = lambda ps: F.struct(F.xxhash64(F.transform(ps, lambda p: p["h"])).alias("h"), ps.alias("p"))
    return F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), lambda s: let(F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), paragraph), section)
    )


def root(tree: Column) -> Column:
    """The root in hexadecimal: two hashes of the sections' hashes. Different texts share a root with probability near 2**-64."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.transform(tree, lambda s: s["h"])))), 16, "0")
    return F.concat(half("a"), half("b"))


def written(tree: Column) -> Column:
    """The fingerprint as text: the root, a colon, and 8 hexadecimal digits for each leaf, with ``,`` between paragraphs and
    ``/`` between sections."""
    leaf = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")
    paragraph = lambda p: F.array_join(F.transform(p["l"], leaf), "")
    section = lambda s: F.array_join(F.transform(s["p"], paragraph), ",")
    return F.concat(root(tree), F.lit(":"), F.array_join(F.transform(tree, section), "/"))


def leaves(tree: Column) -> Column:
    """How many leaves a tree has."""
    total = lambda items, of: F.aggregate(items, F.lit(0), lambda n, x: n + of(x))
    return total(tree, lambda s: total(s["p"], lambda p: F.size(p["l"])))


def _aligned(a: Column, b: Column, same, weight, opened) -> Column:
    """Leaves that two lists of branches share: equal ones at both ends count whole, unopened; what lies between goes to ``opened``."""

    def first(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(same(u, v), F.lit(False))), F.lit(False)).cast("int")
        return F.when(differs == 0, F.size(x)).otherwise(differs - 1)

    rest = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda n, x: n + weight(x))

    def ends(n: Column) -> Column:
        def middle(m: Column) -> Column:
            of = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n - m, F.lit(0)))
            return total(F.slice(a, F.lit(1), n)) + total(F.slice(a, F.size(a) - m + 1, m)) + opened(of(a), of(b))

        return let(first(F.reverse(rest(a, n)), F.reverse(rest(b, n))), middle)

    return let(first(a, b), ends)


def _in_place(opened):
    """Opens branches of the same place, one of each tree."""
    return lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 0.0).otherwise(opened(x, y))), F.lit(0.0), lambda n, x: n + x)


def _loose(a: Column, b: Column) -> Column:
    """Of two differing runs of leaves, those that stand beside the same one in both: by different pairs of neighbours, ends included."""
    def pairs(x: Column) -> Column:
        none = F.array(F.lit(None).cast("int"))
        beside = F.zip_with(F.concat(none, x), F.concat(x, none), lambda u, v: F.xxhash64(u, v, u.isNull()))
        return F.array_distinct(beside)

    def share(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y)) * 2.0 / (F.size(x) + F.size(y)) * F.least(F.size(a), F.size(b))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(pairs(a), lambda x: let(pairs(b), lambda y: share(x, y))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two trees, 0 to 1: twice the leaves that they share, in order, over the leaves of both.

    Descends both trees from the root. Equal roots are alike. Of two lists of branches, equal ones at either end are shared
    whole and not opened; between them, sections and then paragraphs of the same place are opened. In a paragraph, leaves between
    the equal ends are shared as far as they have the same neighbours (:func:`_loose`). Different trees are below 1.
    """
    same = lambda x, y: x["h"] == y["h"]
    one = lambda x: F.lit(1.0)
    paragraph = lambda x, y: _aligned(x["l"], y["l"], lambda u, v: u == v, one, _loose)
    section = lambda x, y: _aligned(x["p"], y["p"], same, lambda p: F.size(p["l"]).cast("double"), _in_place(paragraph))
    weight = lambda s: F.aggregate(s["p"], F.lit(0.0), lambda n, p: n + F.size(p["l"]))
    shared = _aligned(a, b, same, weight, _in_place(section))
    total = (leaves(a) + leaves(b)).cast("double")
    equal = F.transform(a, lambda s: s["h"]) == F.transform(b, lambda s: s["h"])
    return F.when(equal, 1.0).otherwise(F.least(shared * 2 / total, 1 - 1 / total))


def differences(a: Column, b: Column) -> Column:
    """Where two trees differ, as structs ``section``, ``paragraph`` and ``leaf``, from 0: descends only into differing branches.

    Children are compared by place; those that one tree lacks differ whole, with NULL for the places below. Equal trees give
    an empty array.
    """
    place = lambda s, p, x: F.struct(s.alias("section"), p.cast("int").alias("paragraph"), x.cast("int").alias("leaf"))
    none = F.lit(None)

    def below(x: Column, y: Column, inside) -> Column:
        both = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
        of = lambda i: inside(F.get(x, i), F.get(y, i), i)
        return F.when(F.greatest(F.size(x), F.size(y)) > 0, F.flatten(F.transform(both, of)))

    kind = "array<struct<section:int,paragraph:int,leaf:int>>"
    empty = F.array().cast(kind)
    leaf = lambda s, p: lambda x, y, i: F.when(x.eqNullSafe(y), empty).otherwise(F.array(place(s, p, i)))
    para = lambda s: lambda x, y, i: F.when(x["h"] == y["h"], empty).when(x.isNull() | y.isNull(), F.array(place(s, i, none))).otherwise(below(x["l"], y["l"], leaf(s, i)))  # noqa: E731, E501
    sect = lambda x, y, i: F.when(x["h"] == y["h"], empty).when(x.isNull() | y.isNull(), F.array(place(i, none, none))).otherwise(below(x["p"], y["p"], para(i)))  # noqa: E731, E501
    return F.coalesce(below(a, b, sect), empty)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the written fingerprint of each whole text. NULL texts count as empty; equal texts get equal fingerprints."""
    return docs.withColumn(name, written(tree(F.coalesce(F.col(text), F.lit("")))))


def _joinable(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))


def chain(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each different row by ``key`` and text hash, its size and the row before it in descending order of ``key``.

    NULL keys come last, rows of one key by text hash; before the first comes the last. ``u`` (the key as text that is never
    NULL, so that joins and windows share a partitioning), ``t``, ``n`` and ``pu``, ``pt``, ``pn``. Ordered by a range sort: rows are
    numbered by partition, and the first of each is tied to the last before it.
    """
    ids = docs.select(F.col(key).alias("k"), _joinable(key).alias("u"), F.xxhash64(text).alias("t"), F.length(text).alias("n")).dropDuplicates(["u", "t"])
    ids = ids.orderBy(F.desc_nulls_last("k"), "t").withColumn("at", F.monotonically_increasing_id()).drop("k")
    ids = cut(ids, "merkle-order")
    ends = ids.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")  # a row per partition
    before = F.coalesce(F.lag("last").over(every), F.max("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = ends.select(F.col("first").alias("at"), before.alias("tied"))
    tied = ids.join(heads, "at", "left").withColumn("at", F.coalesce("tied", F.col("at") - 1)).drop("tied")
    return cut(tied.join(ids.select("at", F.col("u").alias("pu"), F.col("t").alias("pt"), F.col("n").alias("pn")), "at").drop("at"), "merkle-chain")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and its edit: its last half replaced by the head of the next document, descending ``key``.

    Returns ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``, ``next_id``. The edit
    replaces the last ``floor(n / 2)`` code points by the first as many, or all, of the next document; the one after the last is
    the first. Texts are shuffled by key once, and heads of half a text once more.

    NULL texts count as empty: two empty texts are alike, and like no other. Rows equal in key and text are one in the
    order, but each gives a row; rows of one key follow one another by text hash; NULL keys are last. One row is its own
    next. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = chain(rows, "k", "text")
    # Partitions follow the size of the texts, so that a task holds a bounded part of them whatever the session's number is.
    chars = order.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PARTITION_CHARS))
    rows = rows.withColumns({"u": _joinable("k"), "t": F.xxhash64("text")})
    # The window, and the join after it, need the rows as this join has dealt them; both read the same columns, so texts are dealt once.
    placed = rows.repartition(parts, "u", "t").join(order.repartition(parts, "u", "t").hint("merge"), ["u", "t"])
    once = F.row_number().over(Window.partitionBy("u", "t").orderBy("n"))
    heads = placed.withColumn("turn", once).filter("turn = 1").select(
        F.col("pu").alias("u"), F.col("pt").alias("t"), F.substring("text", F.lit(1), F.floor(F.col("pn") / 2).cast("int")).alias("head"), tree(F.col("text")).alias("z"), F.col("k").alias("next_key"),
    )
    both = placed.select("u", "t", "k", "n", "text").join(heads.repartition(parts, "u", "t").hint("merge"), ["u", "t"])
    kept = F.col("n") - F.floor(F.col("n") / 2).cast("int")
    both = both.withColumn("edit", F.concat(F.substring("text", F.lit(1), kept), F.col("head")))
    both = both.select("k", "n", "next_key", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("x"), tree(F.col("edit")).alias("y"), "z")
    return both.select(
        F.col("k").alias(key), F.col("n").cast("long").alias("n_chars"), "edited_sha256", written(F.col("x")).alias("fingerprint"), written(F.col("y")).alias("edited_fingerprint"),
        likeness(F.col("x"), F.col("y")).alias("near_edited"), likeness(F.col("x"), F.col("z")).alias("near_next"), F.col("next_key").alias("next_id"),
    )
