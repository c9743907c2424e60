"""Claims against evidence, and the profile's own score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathomline.functions.scores import support
from fathomline.functions.text import strip, text
from fathomline.operators.retrieval import ranked
from fathomline.params import DEFAULT, Params
from fathomline.sources.folders import shuffled


def checked_claims(nli: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """AGG13, AGG14: ``claim_id``, ``confidence``, ``rejected`` and the rank of the ``contradiction`` for each claim.

    ``nli`` has a row for each claim and piece of evidence (``evidence_rank``, ``entailment``, ``neutral``, ``contradiction``). The first
    evidence that contradicts surely, and hardly entails, rejects the claim; others have the mean support.
    """
    against = (F.col("contradiction") >= p.contradiction) & (F.col("entailment") <= p.entailment_max)
    out = nli.groupBy(*by, "claim_id").agg(
        F.avg(support(F.col("entailment"), F.col("neutral"), p.neutral_weight)).alias("confidence"), F.bool_or(against).alias("rejected"),
        F.min(F.when(against, F.col("evidence_rank"))).alias("contradiction_rank"),
    )
    return out.withColumn("confidence", F.when(F.col("rejected"), None).otherwise(F.col("confidence")))


def fact_check_score(claims: DataFrame, by: Sequence[str] = ("query_id",), p: Params = DEFAULT) -> DataFrame:
    """AGG13: the mean confidence of accepted claims, or a fixed score without any."""
    return claims.groupBy(*by).agg(F.coalesce(F.avg("confidence"), F.lit(p.unverified)).alias("fact_check_score"))


def verified_snapshot(claims: DataFrame, snapshots: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """AGG15: accepted claims (``claim``) in order, or the snapshot as it was."""
    kept = claims.filter(~F.col("rejected")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["claim"]), " ")
    return snapshots.join(shuffled(kept), list(by), "left").withColumn("snapshot", F.coalesce(F.nullif(joined, F.lit("")), "snapshot")).drop("c")


def budgeted_text(docs: DataFrame, budget: int, by: Sequence[str] = ("query_id",), order: str = "order", separator: str = "\n\n", content: str = "content") -> DataFrame:
    """AGG19: contents in order until ``budget`` characters, the last one cut; separators don't count."""
    before = F.coalesce(F.sum(F.length(content)).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = docs.filter(text(F.col(content)) != "").withColumn("_room", budget - before).filter("_room > 0")
    piece = F.struct(order, F.left(F.col(content), F.col("_room").cast("int")).alias("t"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), separator).alias("text"))


def prompt_block(docs: DataFrame, by: Sequence[str] = ("query_id",), order: str = "order", p: Params = DEFAULT) -> DataFrame:
    """TXT27: for each of the first documents in order a numbered header, the content's head on one line, and a rule."""
    rows = ranked(docs, by, [order], p.max_docs, "_n")
    # The fields of a header and what stands for a missing one.
    fields = [("Source", "source", "Unknown"), ("Title", "title", "Untitled"), ("Date", "source_date", "N/A"), ("URL", "url", "#")]
    named = F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit(other))) for n, c, other in fields))
    head = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), named)
    body = F.concat(F.lit("    Content: "), strip(F.replace(F.left(text(F.col("content")), F.lit(p.prompt_doc_chars)), F.lit("\n"), F.lit(" "))))
    item = F.struct("_n", F.concat_ws("\n", head, body, F.lit("---")).alias("t"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("documents_block"))


def prompt(template: str, **parts: Column) -> Column:
    """TXT28: ``template`` with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), text(value))
    return out


def stored_documents(documents: Column, p: Params = DEFAULT) -> Column:
    """SNK12: the first documents of an array of structs, contents cut."""
    cut = lambda d: d.withField("content", F.left(text(d["content"]), F.lit(p.stored_chars)))
    return F.transform(F.slice(documents, 1, p.stored_docs), cut)


def distinct_citations(citations: DataFrame, by: Sequence[str] = ("query_id",), order: str = "pos") -> DataFrame:
    """AGG17: citations with a title, one of each title, URL and date."""
    from fathomline.operators.dedupe import first_wins

    rows = citations.filter(F.trim(text(F.col("title"))) != "")
    return first_wins(rows, [*(F.col(c) for c in by), F.lower("title"), text(F.col("url")), text(F.col("source_date"))], [order])


def shown_and_hidden(items: Column, limit: int = 3) -> tuple[Column, Column]:
    """ORD09."""
    return F.slice(items, 1, limit), F.when(F.size(items) > limit, F.slice(items, F.lit(limit + 1), F.size(items))).otherwise(F.slice(items, 1, 0))


def per_source_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    """SNK07."""
    name = F.coalesce(F.nullif(F.trim(text(F.col(source))), F.lit("")), F.lit("unknown"))
    return docs.groupBy(name.alias("source")).agg(F.count("*").alias("passed")).orderBy(F.lower("source"))


def best_relations(relations: DataFrame, most: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    return ranked(relations, by, [F.desc("confidence"), "pos"], most)


def retrieved_counts(docs: DataFrame, by: Sequence[str] = ("query_id",), retriever: str = "retriever") -> DataFrame:
    """AGG18: documents of each query, summed over retrievers, and how many of those found any."""
    each = docs.groupBy(*by, retriever).agg(F.count("*").alias("_n"))
    return each.groupBy(*by).agg(F.sum("_n").alias("documents"), F.count("*").alias("retrievers"))
