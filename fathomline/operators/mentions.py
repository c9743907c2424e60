"""Entity mentions, their contexts, and candidates gathered from profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathomline.functions.places import places_of
from fathomline.functions.scores import candidate_score
from fathomline.functions.text import collapse, entity_key, entity_name, text
from fathomline.operators.dedupe import first_wins
from fathomline.operators.joins import same_key
from fathomline.operators.retrieval import numbered, ranked
from fathomline.params import CUSTOMER_KEYWORDS, DEFAULT, GUARANTOR_KEYWORDS, HIGH_RISK_KEYWORDS, Params
from fathomline.sources.folders import shuffled

KEYWORDS = {"customer": CUSTOMER_KEYWORDS, "corporate_guarantor": GUARANTOR_KEYWORDS, "high_risk": HIGH_RISK_KEYWORDS}


def mention_pattern(name: Column) -> Column:
    """The words of a name, of the letters a to z and digits, joined by any run of signs and spaces, at word boundaries, in either case; NULL for no words."""
    words = F.regexp_extract_all(F.lower(text(name)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?iU)\b"), F.array_join(words, r"[\s\W]+"), F.lit(r"\b")))


def mention_count(content: Column, name: Column) -> Column:
    """AGG06."""
    return F.coalesce(F.regexp_count(text(content), mention_pattern(name)), F.lit(0))


#: Characters of the pieces that windows are cut from: a cut looks at a few pieces and not at all of the text before it.
PIECE = 1_024


def near_keywords(content: Column, places: Column, words: Column, p: Params = DEFAULT) -> Column:
    """AGG07: how many of the ``places`` (structs ``start``, ``end``) have one of the lower-case ``words`` in the text around, ``p.window_chars`` on both sides."""
    whole = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    # Pieces are code points, as places are; a variable holds them, so the text is cut once.
    def near(pieces: Column) -> Column:
        def window(m: Column) -> Column:
            at, to = F.greatest(m["start"] - p.window_chars, F.lit(0)), m["end"] + p.window_chars
            first, last = F.floor(at / PIECE).cast("int"), F.floor((to - 1) / PIECE).cast("int")
            return F.lower(F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (at % PIECE + 1).cast("int"), (to - at).cast("int")))

        texts = F.transform(places, window)
        return F.size(F.filter(texts, lambda t: F.exists(words, lambda k: F.contains(t, k))))

    return F.element_at(F.transform(F.array(whole), near), 1)


def context_hits(rows: DataFrame, keys: Sequence[str], p: Params = DEFAULT) -> DataFrame:
    """AGG07: ``keys`` and ``hits``, how many mentions of ``name`` in ``content`` have one of ``keywords`` near, or within; no row for none.

    Mentions and their windows are made where the text is; nothing is shuffled.
    """
    usual = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.lower(collapse(k))), lambda k: k != ""))
    content = text(F.col("content"))
    hits = near_keywords(content, places_of(content, mention_pattern(F.col("name"))), usual, p)
    return rows.select(*keys, hits.alias("hits")).filter("hits > 0")


def may_mention(folded: Column, name: Column) -> Column:
    """Whether all words of a name stand in a text of :func:`folded`; a cheap test, which every text that mentions the name passes."""
    words = F.regexp_extract_all(F.lower(text(name)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.forall(words, lambda w: F.contains(folded, w))


def folded(content: Column) -> Column:
    """Lower case, with the four letters that a pattern takes for ASCII ones in either case but lower case keeps."""
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        content = F.replace(content, F.lit(odd), F.lit(plain))
    return F.lower(content)


def scored_candidates(docs: DataFrame, names: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """JON08, AGG09: for each name (``name``, ``role``, ``keywords``) the mentions and context hits in its query's documents, its evidence
    (different documents that mention it, in order) and score; names with too few of either go.

    Names and documents meet by query; ``doc_index`` numbers a query's documents. Documents that lack a word of the name leave before its pattern is
    tried. Mentions are found once; windows are looked at where the text is. Evidence is different if its fields are, white space aside; the first
    document of each stays.
    """
    usual = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.lower(collapse(k))), lambda k: k != ""))
    held = docs.withColumn("_text", text(F.col("content"))).withColumn("_folded", folded(F.col("_text")))
    asked = names.select(*by, "name", "role", usual.alias("_set"), mention_pattern(F.col("name")).alias("_pattern"))
    rows = held.join(shuffled(asked), list(by)).filter(may_mention(F.col("_folded"), F.col("name")))
    # A variable holds the places, so a text is searched once for both counts.
    counts = lambda m: F.struct(F.size(m).alias("mentions"), near_keywords(F.col("_text"), m, F.col("_set"), p).alias("hits"))
    rows = rows.withColumn("_c", F.explode(F.filter(F.transform(F.array(places_of(F.col("_text"), F.col("_pattern"))), counts), lambda x: x["mentions"] > 0)))
    fields = ("url", "title", "source", "source_date")
    evidence = F.struct(*(text(F.col(c)).alias(c) for c in fields))
    told = rows.select(*by, "doc_index", "name", "role", "_c.mentions", "_c.hits", evidence.alias("_e"), F.struct(*(collapse(F.col(c)).alias(c) for c in fields)).alias("_key"))
    told = told.groupBy(*by, "name", "role", "_key").agg(F.sum("mentions").alias("mentions"), F.sum("hits").alias("hits"), F.min(F.struct("doc_index", "_e")).alias("_e"))
    found = told.groupBy(*by, "name", "role").agg(
        F.sum("mentions").cast("long").alias("mentions"), F.sum("hits").cast("long").alias("context_hits"), F.transform(F.array_sort(F.collect_list("_e")), lambda x: x["_e"]).alias("evidence")
    )
    found = found.filter((F.col("mentions") >= p.min_mentions) & (F.col("context_hits") >= p.min_context))
    return found.withColumn("score", F.round(candidate_score(F.col("mentions"), F.col("context_hits"), p), 3))


def candidate_names(profiles: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """AGG10: names to look for of each profile, with ``role`` and ``keywords``: customer, guarantor, then high-risk items.

    Names like the query's own go, and names like one taken before in this order. Caps hold by role and over all.
    """
    item = lambda role, c: F.struct(F.lit(role).alias("role"), text(c).alias("name"), entity_key(c).alias("key"))
    one = lambda role, c: F.array(item(role, F.col(c)))
    risks = F.transform("high_risk_entities", lambda x: item("high_risk", x["name"]))
    every = F.concat(one("customer", "customer.name"), one("corporate_guarantor", "corporate_guarantor.name"), risks)
    # Keys are made once a name: an array in a lambda's variable holds them, where a column's expression would be pasted into each use.
    asked = F.array(F.struct(every.alias("names"), entity_key(F.col("query")).alias("own")))

    def step(kept: Column, x: Column) -> Column:
        of_role = F.size(F.filter(kept, lambda k: k["role"] == x["role"]))
        most = F.when(x["role"] == "high_risk", p.max_high_risk).otherwise(p.max_party)
        known = F.exists(kept, lambda k: same_key(k["key"], x["key"]))
        return F.when(known | (of_role >= most) | (F.size(kept) >= p.max_candidates), kept).otherwise(F.array_append(kept, x))

    none = F.array().cast("array<struct<role:string,name:string,key:string>>")
    chosen = lambda a: F.aggregate(F.filter(a["names"], lambda x: (x["key"] != "") & ~same_key(x["key"], a["own"])), none, step)
    kept = F.element_at(F.transform(asked, chosen), 1)
    keys = F.create_map(*(x for role, words in KEYWORDS.items() for x in (F.lit(role), F.array(*(F.lit(w) for w in words)))))
    rows = profiles.select(*by, F.posexplode(kept).alias("pos", "_c")).select(*by, "pos", "_c.role", entity_name(F.col("_c.name")).alias("name"))
    return rows.withColumn("keywords", keys[F.col("role")])


def upsert_candidates(stored: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """AGG11: ``(candidates, counts)`` after merging ``new`` (with ``pos``) into ``stored`` by entity key.

    Scores, mentions and hits become the greatest, roles and evidence a union in order, ``first_seen_at`` and ``promoted_at`` stay,
    ``last_seen_at`` is ``now``. Counts: ``added``, ``updated``, ``total``; a key's repeats in one batch are updates. Both sides are
    aggregated by key once, which is also what makes a full outer join needless.
    """
    parts = stored.withColumns({"_new": F.lit(0), "_pos": F.col("pos").cast("long")}), new.withColumns({"_new": F.lit(1), "_pos": F.col("pos").cast("long")})
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).withColumn("_key", entity_key(F.col("name"))).filter("_key != ''")
    both = both.withColumn("_roles", F.array_compact(F.concat(F.array("role"), F.coalesce("roles", F.array().cast("array<string>")))))
    at = F.struct("_new", "_pos")
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_new", "_pos", c))), lambda x: x[c])))
    merged = both.groupBy("_key").agg(
        F.min_by("name", at).alias("name"), ordered("_roles").alias("roles"), F.round(F.max("score"), 3).alias("score"), F.max("mentions").alias("mentions"),
        F.max("context_hits").alias("context_hits"), ordered("evidence").alias("evidence"), F.min_by("source_query", at).alias("source_query"),
        F.coalesce(F.min_by("first_seen_at", F.when(F.col("_new") == 0, F.col("_pos"))), F.lit(now)).alias("first_seen_at"),
        F.when(F.max("_new") == 1, F.lit(now)).otherwise(F.max("last_seen_at")).alias("last_seen_at"),
        F.min_by("promoted_at", F.when(F.col("_new") == 0, F.col("_pos"))).alias("promoted_at"),
        F.min("_new").alias("_added"), F.sum("_new").alias("_batch"), F.min(at).alias("_first"),
    )
    counts = merged.agg(
        F.coalesce(F.sum("_added"), F.lit(0)).cast("long").alias("added"),
        F.coalesce(F.sum(F.col("_batch") - F.col("_added")), F.lit(0)).cast("long").alias("updated"), F.count("*").alias("total"),
    )
    return numbered(merged, [F.desc("score"), "_first", "_key"]).withColumn("role", F.try_element_at("roles", F.lit(1))).drop("_key", "_added", "_batch", "_first"), counts


def promote(candidates: DataFrame, seeds: DataFrame, now: str, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """AGG12: ``(candidates, seeds)`` after promotion, in stored order (``pos``).

    Candidates that aren't promoted yet and score enough join the seeds, at most twenty; those whose name is a seed already are
    only stamped, up to where the cap was reached.
    """
    key = F.lower(entity_name(F.col("name")))
    seeded = seeds.select(F.lower(entity_name(F.col("name"))).alias("_key")).distinct().withColumn("_seeded", F.lit(True))
    open_ = candidates.filter((text(F.col("promoted_at")) == "") & (F.col("score") >= p.promote_score)).withColumn("_key", key).filter("_key != ''")
    open_ = open_.join(seeded, "_key", "left").withColumn("_seeded", F.coalesce("_seeded", F.lit(False)))
    # A later candidate of the same name finds the first one seeded.
    first = F.row_number().over(W.partitionBy("_key").orderBy("pos")) == 1
    open_ = open_.withColumn("_adds", ~F.col("_seeded") & first)
    # Up to the row that fills the cap; the first rows that add are found in tasks.
    filling = open_.filter("_adds").select("pos").orderBy("pos").limit(p.max_promotions)
    edge = filling.agg(F.when(F.count("*") == p.max_promotions, F.max("pos")).alias("edge"))
    chosen = open_.withColumn("_edge", edge.scalar()).filter(F.col("_edge").isNull() | (F.col("pos") <= F.col("_edge"))).drop("_edge")
    stamped = chosen.select("pos", F.lit(now).alias("_now"))
    after = candidates.join(stamped, "pos", "left").withColumn("promoted_at", F.coalesce("_now", "promoted_at")).drop("_now")
    more = chosen.filter("_adds").select(F.col("name"), (F.col("pos") + F.lit(1 << 40)).cast("long").alias("pos"))
    grown = seeds.select("name", F.col("pos").cast("long").alias("pos")).unionByName(more)
    return after, first_wins(grown, [F.col("name")], ["pos"])
