"""Elimination of repeated rows. Every operator takes its order explicitly; equal rows keep the first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from fathomline.functions.scores import jaccard
from fathomline.functions.text import text
from fathomline.operators.greedy import first_independent
from fathomline.operators.retrieval import ranked
from fathomline.params import DEFAULT, Params
from fathomline.sources.folders import shuffled


def first_wins(df: DataFrame, keys: Sequence[Column], order: Sequence) -> DataFrame:
    """SRC25, AGG05, AGG16, AGG17, SET05: the first row of each key."""
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.withColumns(dict(zip(names, keys, strict=True)))
    return ranked(rows, names, order, 1, "_turn").drop("_turn", *names)


def keep_best_per_url(docs: DataFrame, by: Sequence[str] = ("query_id",), arrival: str = "pos") -> DataFrame:
    """AGG01, AGG02: of each URL the document of greatest rank, the first to arrive on ties; all those without a URL.

    Rank is ``relevance_score``, else ``score``, else 0. ``order`` numbers the result by rank; ties go by when their URL was first
    seen, documents without one last.
    """
    rank = F.coalesce("relevance_score", "score", F.lit(0.0)).cast("double")
    rows = docs.withColumns({"doc_rank": rank, "_url": text(F.col("url"))})
    url = W.partitionBy(*by, "_url")
    rows = rows.withColumn("_seen", F.min(arrival).over(url)).withColumn("_best", F.row_number().over(url.orderBy(F.desc("doc_rank"), arrival)))
    rows = rows.filter((F.col("_url") == "") | (F.col("_best") == 1)).withColumn("_last", (F.col("_url") == "").cast("int"))
    seen = F.when(F.col("_url") == "", F.col(arrival)).otherwise(F.col("_seen"))
    rows = rows.withColumn("_seen", seen)
    return ranked(rows, by, [F.desc("doc_rank"), "_last", "_seen"], name="order").drop("_url", "_seen", "_best", "_last")


#: Words of three letters or digits or more between characters that no word holds: of any alphabet, or of ASCII alone, where ``übung`` holds ``bung``.
WORDS, ASCII_WORDS = r"\b[a-z0-9]{3,}\b", r"(?<![A-Za-z0-9_])[a-z0-9]{3,}(?![A-Za-z0-9_])"


def word_set(content: Column, most: int = DEFAULT.dedupe_chars, words: str = WORDS) -> Column:
    """Different words of three letters or digits or more in the head of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.left(text(content), F.lit(most))), F.lit(words), F.lit(0)))


def greedy_near_duplicates(docs: DataFrame, by: Sequence[str] = ("query_id",), order: str = "order", p: Params = DEFAULT, words: str = WORDS) -> DataFrame:
    """AGG03: keeps a document unless its word set is too like that of one kept before; empty sets are like nothing.

    The result depends on the order and isn't transitive: it is what a fold over each group of ``by`` in order gives, made in parallel
    (:func:`~fathomline.operators.greedy.first_independent`). Of equal sets only the first can stay. Long words come first in the heads: they are rare.
    ``words`` is what a word is.
    """
    rows = docs.withColumn("_words", word_set(F.col("content"), p.dedupe_chars, words))
    long_first = F.transform(F.array_sort(F.transform("_words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    slim = rows.select(*by, order, long_first.alias("_words"))
    some = first_wins(slim.filter(F.size("_words") > 0), [*(F.col(c) for c in by), F.col("_words")], [order])
    kept = first_independent(some, by, order, "_words", p.dedupe_jaccard, lambda a, b: jaccard(a, b) >= p.dedupe_jaccard)
    return rows.join(shuffled(kept.withColumn("_kept", F.lit(True))), [*by, order], "left").filter((F.size("_words") == 0) | F.col("_kept")).select(*docs.columns)


# Letters of English by how rare they are; all other characters count as rarer.
RARE_LETTERS = "zqxjkvbpgywfmucldrhsinoate "


def letters(name: Column) -> Column:
    """The characters of a name with their turn among equal ones, rare ones first: the common ones of two names bound what can match."""
    chars = F.split(name, "")
    turned = F.transform(chars, lambda c, i: F.struct(F.instr(F.lit(RARE_LETTERS), c).alias("r"), c.alias("c"), (-F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))).alias("k")))
    return F.transform(F.array_sort(turned), lambda x: F.concat(x["c"], x["k"].cast("string")))


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of pairs of names."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def distinct_entities(entities: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """AGG04: entities (``name``, ``type``, ``score``, ``pos``) by score, less those whose name is like a kept one of the type.

    Likeness is the Ratcliff-Obershelp ratio of lower-cased names, above ``p.entity_ratio``: twice the characters in matching pieces, by those of both.
    Pieces can't match more than the letters that both names have, and a ratio of r of those is a Jaccard likeness of r / (2 - r), so
    only names with enough letters in common are compared, by Arrow batches; the choice is made in parallel as in AGG03. Rows without a name or type
    go. NULL scores come last. Of equal names the first can stay.
    """
    rows = entities.filter((F.trim(text(F.col("name"))) != "") & (F.trim(text(F.col("type"))) != ""))
    rows = rows.withColumn("_name", F.lower("name")).withColumn("_at", F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("score"), "pos"))
    keys = [*by, "type"]
    some = first_wins(rows.select(*keys, "_at", "_name"), [*(F.col(c) for c in keys), F.col("_name")], ["_at"])
    some = some.withColumns({"_letters": letters(F.col("_name")), "_item": F.struct("_name", letters(F.col("_name")).alias("of"))})
    share = p.entity_ratio / (2 - p.entity_ratio)

    def like(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a["of"], b["of"]))
        enough = 2 * common > p.entity_ratio * (F.size(a["of"]) + F.size(b["of"])) - 1e-9
        return enough & (name_ratio(F.when(enough, a["_name"]).otherwise(""), F.when(enough, b["_name"]).otherwise("")) > p.entity_ratio)

    kept = first_independent(some, keys, "_at", "_letters", share, like, "_item")
    return rows.join(shuffled(kept), [*keys, "_at"], "left_semi").select(*entities.columns)


def distinct_relations(relations: DataFrame, by: Sequence[str] = ("query_id",), order: str = "pos", p: Params = DEFAULT) -> DataFrame:
    """AGG05, FLT11: relations that are sure enough, between valid different names, one of each source, target and type."""
    from fathomline.operators.filters import valid_entity

    a, b = F.col("source"), F.col("target")
    rows = relations.filter((F.col("confidence") >= p.relation_confidence) & valid_entity(a) & valid_entity(b) & (F.lower(a) != F.lower(b)))
    return first_wins(rows, [*(F.col(c) for c in by), F.lower(a), F.lower(b), F.col("relationship_type")], [order])


def with_embeddings(df: DataFrame, embed, content: str = "content", name: str = "embedding") -> DataFrame:
    """VEC02: adds vectors of texts; ``embed`` takes a list of texts and returns vectors, loaded once in each worker."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([list(map(float, v)) for v in embed(b.fillna("").tolist())])

    return df.withColumn(name, vectors(F.col(content)))
