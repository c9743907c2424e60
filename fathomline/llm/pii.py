"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm import spans
from fathomline.llm.shared import cut

#: Kinds in listed order.
KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns. A run of one class is entered at its start or where the last match ended, which changes no match.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A digit group of a number written with spaces: it starts where a group ended, and signs may follow at its end.
_GROUP = r"(?<=[0-9)])\x20\(?[0-9][0-9().-]*+[^\s\p{L}0-9@]*+(?!\S)"
#: Strings that may identify someone: tokens with a digit or an at sign, and up to 19 digit groups joined by single spaces.
CANDIDATE = rf"(?<!\S)[^\s0-9@]*+(?:(?<!\p{{L}})[0-9][0-9().-]*+(?:{_GROUP}){{1,18}}+|[0-9@]\S*+)"


@dataclass(frozen=True)
class Settings:
    """Rounds of bootstrapping; the least confidence and number of different believed instances of a pattern; least code points of a find."""

    rounds: int = 3
    confidence: float = 0.8
    support: int = 3
    shortest: int = 5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns in a text that isn't NULL, in no order."""
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9][\x20-]?[0-9]")
    small = lambda s: F.forall(F.split(s["match"], r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^[0-9]{0,3}$") & (F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255))  # noqa: E731, E501
    long = lambda s: F.length(_digits(s["match"])).between(14, 19) & _luhn(_digits(s["match"]))
    called = lambda s: F.length(_digits(s["match"])).between(10, 15)
    cards = F.filter(spans.matches(text, CARD, 2), lambda s: F.when(F.length(s["match"]).between(14, 40), long(s)).otherwise(False))
    return F.concat(
        spans.only_if(at, spans.matches(text, EMAIL, 0)),
        spans.only_if(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans.matches(text, IP, 1), small)),
        spans.only_if(digit, cards),
        spans.only_if(F.contains(text, F.lit("+")), F.filter(spans.matches(text, PHONE, 3), called)),
    )


def _contexts(left: Column) -> Column:
    """Lexical patterns of a place: the last word before it, and the last two; letters in lower case, and signs that lead to a value."""
    words = F.filter(
        F.transform(F.split(F.lower(left), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}:=#]", "")), lambda w: w != ""
    )
    last, two = F.try_element_at(words, F.lit(-1)), F.concat_ws(" ", F.slice(words, -2, 2))
    return F.when(F.size(words) >= 2, F.array(last, two)).when(F.size(words) == 1, F.array(last)).otherwise(F.array().cast("array<string>"))


def _plausible(match: Column, rank: Column) -> Column:
    """What a find must look like to be of the pattern's kind, less strict than the fixed patterns."""
    digits = F.length(_digits(match))
    return (
        F.when(rank == 0, F.contains(match, F.lit("@"))).when(rank == 1, match.rlike(r"[0-9][^0-9]+[0-9]+[^0-9]+[0-9]"))
        .when(rank == 2, digits >= 12).otherwise(digits.between(7, 15))
    )


def _longest(match: Column, rank: Column) -> Column:
    """The first digit groups of a find, as many as still look like the kind; NULL if not even the first does.

    Mail and network addresses have no spaces. Beyond 19 digits, a card is one token.
    """
    groups = F.split(match, " ")
    starts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    fits = lambda s: _plausible(s, rank) & (~F.contains(s, F.lit(" ")) | (rank >= 2) & (F.length(_digits(s)) <= 19))
    return F.get(F.filter(starts, fits), 0)


def score_patterns(edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Bootstraps patterns from ``edges`` of ``pattern``, ``instance``, ``rank`` (-1: not known) and ``fits``, the kinds that an instance looks like.

    Known instances are believed for their kind. In each round a pattern's confidence for a kind is the belief in its
    instances over their number; with ``support`` believed instances and ``confidence`` it is accepted. What else stands after accepted
    patterns, and looks the part, is believed as much as the best of them, and is a seed of the next round: so patterns come in
    that had no seed at first. A pattern gains nothing from what it made believed itself: there the best other pattern
    counts. Returns ``pattern``, ``rank``, ``confidence`` of accepted ones.
    """
    graph = cut(edges.groupBy("pattern", "instance").agg(F.max("rank").alias("rank"), F.first("fits").alias("fits")), "pii-graph")
    degree = cut(graph.groupBy("pattern").agg(F.count("*").alias("n")), "pii-degrees")
    known = cut(graph.filter("rank >= 0").groupBy("pattern", "rank").agg(F.count("*").cast("double").alias("sum"), F.count("*").alias("seeds")), "pii-known")
    unknown = graph.filter("rank < 0").select("pattern", "instance", F.explode("fits").alias("rank"))
    believed = known
    for turn in range(settings.rounds):
        summed = believed.groupBy("pattern", "rank").agg(F.sum("sum").alias("sum"), F.sum("seeds").alias("seeds")).filter(F.col("seeds") >= settings.support)
        scored = summed.join(degree, "pattern").withColumn("confidence", F.col("sum") / F.col("n")).filter(F.col("confidence") >= settings.confidence)
        accepted = cut(scored.select("pattern", "rank", "confidence"), "pii-patterns")
        if turn == settings.rounds - 1:
            break
        found = unknown.join(accepted, ["pattern", "rank"])
        best = cut(found.groupBy("instance", "rank").agg(F.max(F.struct("confidence", "pattern")).alias("best")), "pii-best")
        second = found.join(best, ["instance", "rank"]).filter(F.col("pattern") != F.col("best.pattern"))
        second = second.groupBy("instance", "rank").agg(F.max("confidence").alias("second"))
        belief = best.join(second, ["instance", "rank"], "left")
        gained = unknown.join(belief, ["instance", "rank"])
        outside = F.when(F.col("pattern") == F.col("best.pattern"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best.confidence"))
        gained = gained.groupBy("pattern", "rank").agg(F.sum(outside).alias("sum"), F.sum((outside > 0).cast("long")).alias("seeds"))
        believed = known.unionByName(gained)
    return accepted


def _places(rows: DataFrame) -> DataFrame:
    """``row``, ``start``, ``match``, ``left`` and ``rank`` of each token; -1 where it touches no base span, else the kind and match of the one that
    starts in it. Tokens inside a base span that started before go. Of digit groups with a base span behind the first, what stands before it is left.

    Tokens and base spans of a document meet in order, so the time doesn't grow with the product of their numbers.
    """
    both = F.concat(F.transform("tokens", lambda t: F.struct(t["start"], F.lit(0).alias("base"), t["rank"], t["end"], t["match"], t["left"])),
                    F.transform("base", lambda b: F.struct(b["start"], F.lit(1).alias("base"), b["rank"], b["end"], b["match"], F.lit("").alias("left"))))
    each = rows.filter(F.size("tokens") > 0).select("row", F.explode(both).alias("s")).select("row", "s.*")
    order = Window.partitionBy("row").orderBy("start", "base", "rank")
    token, sofar = F.col("base") == 0, order.rowsBetween(Window.unboundedPreceding, 0)
    # The first digit group decides whether a token is in a base span.
    head = F.col("start") + F.length(F.substring_index("match", " ", 1))
    each = each.withColumns({
        "turn": F.sum(token.cast("int")).over(sofar), "head": F.last(F.when(token, head), True).over(sofar), "to": F.last(F.when(token, F.col("end")), True).over(sofar),
        "reached": F.max(F.when(~token, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    })
    inside = F.when(~token & (F.col("start") < F.col("head")), F.struct("start", "rank", "match"))
    later = F.when(~token & (F.col("start") >= F.col("head")) & (F.col("start") < F.col("to")), F.col("start"))
    found = each.filter("turn > 0").groupBy("row", "turn").agg(
        F.max(F.when(token, F.struct("start", "end", "match", "left", F.coalesce(F.col("reached") > F.col("start"), F.lit(False)).alias("covered")))).alias("t"),
        F.min(inside).alias("b"), F.min(later).alias("later"),
    ).filter(F.col("b").isNotNull() | ~F.col("t.covered"))
    whole = F.rtrim(F.substring(F.col("t.match"), F.lit(1), (F.coalesce("later", F.col("t.end")) - F.col("t.start")).cast("int")))
    return found.select("row", F.col("t.start").alias("start"), F.coalesce(F.col("b.match"), whole).alias("match"), F.col("t.left").alias("left"), F.coalesce(F.col("b.rank"), F.lit(-1)).alias("rank"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``key``, ``row``, ``base`` and ``found`` spans of each row.

    Base spans are the matches of the fixed patterns. They are the seeds: the words before them, :func:`_contexts`, are
    patterns, and every token with a digit or at sign is an instance of the patterns before it; digit groups with single spaces
    between them are one instance. :func:`score_patterns` finds patterns that are followed by personal data nearly always; other
    instances after those are added to ``found`` with the kind of the pattern, if they look the part and touch no base span: of
    digit groups, as many as do (:func:`_longest`). Texts are read once; what goes on is spans and counts. Contexts are words
    since the last token, of the last :data:`spans.LEFT` code points; a token right behind another has none.

    Offsets count code points of the whole text; ends are exclusive. NULL texts count as empty. Repeated rows are rows of
    their own but one instance of their patterns. An empty table gives no rows. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = spans.only_if(F.col("_text").rlike("[0-9@]"), spans.matches(F.col("_text"), CANDIDATE, -1))
    rows = docs.select(F.col(key), body.alias("_text")).select(key, base_spans(F.col("_text")).alias("base"), tokens.alias("tokens"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    fits = F.filter(F.array(*(F.when(_longest(F.col("match"), F.lit(k)).isNotNull(), F.lit(k)) for k in range(len(KINDS)))), lambda k: k.isNotNull())
    places = _places(rows).withColumn("fits", F.when(F.col("rank") < 0, fits).otherwise(F.array().cast("array<int>")))
    places = cut(places.select("row", "start", "match", "rank", "fits", F.explode(_contexts(F.col("left"))).alias("pattern")), "pii-places")
    accepted = score_patterns(places.select("pattern", F.xxhash64("match").alias("instance"), "rank", "fits"), settings)
    lead, tail = F.length(F.regexp_extract("match", r"^[^\p{L}0-9+]*", 0)), F.length(F.regexp_extract("match", r"[^\p{L}0-9]*$", 0))
    start, end = F.col("start") + lead, F.col("start") + F.length("match") - tail
    new = (
        places.filter("rank < 0").drop("rank", "fits").join(accepted, "pattern").withColumn("match", _longest(F.col("match"), F.col("rank")))
        .filter(F.col("match").isNotNull() & (end - start >= settings.shortest))
        .groupBy("row", start.alias("start"), end.alias("end"))
        .agg(F.max_by("rank", F.struct("confidence", -F.col("rank"))).alias("rank"))
        .withColumns({"match": F.lit(""), "left": F.lit("")})
        .groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end", "match", "left")).alias("new"))
    )
    none = F.array().cast(spans.SPAN)
    return rows.join(new, "row", "left").select(key, "row", "base", F.concat("base", F.coalesce("new", none)).alias("found"))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``key``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans by kind), ``base_sha256``, ``spans``. See :func:`scan`."""
    rows = scan(docs, key, text, settings)
    return rows.select(
        key, *(spans.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(spans.listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), spans.listed(F.col("found"), KINDS).alias("spans"),
    )
