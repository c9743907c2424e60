"""From a query's chosen chunks to its checked, cited profile. One row a query; models run on a query's few chunks only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import json as js
from fathomline.functions.scores import profile_confidence
from fathomline.functions.text import claims, evidence_text, strip, strip_preface, text, to_full_sentence, without_fences, without_parentheses, without_possessive
from fathomline.models import Models, entailed, found_entities, found_relations, generated
from fathomline.operators.dedupe import distinct_entities, distinct_relations, with_embeddings
from fathomline.operators.filters import high_risk_others
from fathomline.operators.joins import cited, located_entities, profile_values, ranked_evidence, resolved_spans
from fathomline.operators.mentions import candidate_names, scored_candidates
from fathomline.operators.rank import context_block, prefer_names
from fathomline.operators.verify import budgeted_text, checked_claims, fact_check_score, prompt, prompt_block, verified_snapshot
from fathomline.params import DEFAULT, Params
from fathomline.schema import PARTY, RISKS
from fathomline.sources.folders import cut, shuffled

SNAPSHOT_PROMPT = "Write a short factual account of {company}, from these documents alone.\n\n{documents_block}"
PROFILE_PROMPT = (
    "Fill in the profile of {company} from these documents and findings alone. Reply with one JSON object with the keys customer, "
    "corporate_guarantor and high_risk_entities.\n\n{documents_block}\n\n{context_block}"
)


@dataclass(frozen=True)
class Profiled:
    """``profiles``: a row a query. ``claims``: each checked claim. ``citations``: documents of each value. ``candidates``: scored names."""

    profiles: DataFrame
    claims: DataFrame
    citations: DataFrame
    candidates: DataFrame


def snapshots(blocks: DataFrame, models: Models, template: str = SNAPSHOT_PROMPT) -> DataFrame:
    """``query_id``, ``query``, ``snapshot``: the reply without its opening, up to the last sentence end (TXT14, TXT13)."""
    asked = prompt(template, company=F.col("query"), documents_block=F.col("documents_block"))
    return blocks.select("query_id", "query", to_full_sentence(strip_preface(generated(asked, models.generate))).alias("snapshot"))


def checked(written: DataFrame, chunks: DataFrame, models: Models, p: Params = DEFAULT) -> DataFrame:
    """The claims of each snapshot (TXT11) against their best evidence (JON02, JON03, AGG13, AGG14); claims without evidence don't count.

    Evidence texts are embedded once a chunk. Pairs are at most ten claims by three chunks of a query.
    """
    said = written.select("query_id", F.posexplode(claims(F.col("snapshot"), p.max_claims, p.min_claim)).alias("claim_id", "claim"))
    said = with_embeddings(said, models.embed, "claim", "claim_vec")
    have = chunks.select("query_id", (F.col("order") - 1).cast("int").alias("doc_index"), strip(F.col("content")).alias("_premise"))
    vectors = with_embeddings(have.withColumn("_text", evidence_text(F.col("_premise"), p.prompt_doc_chars)), models.embed, "_text", "evidence_vec").drop("_text")
    pairs = ranked_evidence(said, vectors, p=p).filter(F.length("_premise") >= p.min_content)
    nli = pairs.withColumn("_n", entailed(F.left("_premise", F.lit(p.prompt_doc_chars)), F.col("claim"), models.entail)).select("query_id", "claim_id", "claim", "evidence_rank", "_n.*")
    # A claim has one text, which goes along: a join for it would run all of the above twice.
    return checked_claims(nli, ("query_id", "claim"), p)


def entities(chunks: DataFrame, models: Models, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(texts, entities)``: each query's text for the models (AGG19, TXT29) and its different entities (AGG04)."""
    texts = budgeted_text(chunks.withColumn("content", strip(F.col("content"))), p.entity_text_chars).withColumn("text", without_parentheses(F.col("text")))
    texts = cut(texts, "profile-texts")
    rows = texts.select("query_id", F.posexplode(found_entities(F.col("text"), models.entities)).alias("pos", "_e"))
    rows = rows.select("query_id", F.coalesce("_e.name", F.lit("")).alias("name"), F.coalesce("_e.type", F.lit("")).alias("type"), F.round(F.coalesce("_e.score", F.lit(0.0)), 2).alias("score"), "pos")
    return texts, distinct_entities(cut(rows, "profile-entities"), p=p)


def relations(texts: DataFrame, found: DataFrame, models: Models, p: Params = DEFAULT) -> DataFrame:
    """Different sure relations between entities that are in the head of the text (JON09, TXT30, FLT11, AGG05); needs two located ones."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "name", "type")))
    rows = texts.join(shuffled(found.groupBy("query_id").agg(each.alias("_all"))), "query_id").filter(F.size("_all") > 1)
    tokens = F.slice(F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda t: t != ""), 1, p.relation_tokens)
    spans = F.transform(located_entities(F.col("_t"), F.col("_all"), ("type",)), lambda s: F.struct(s["name"].alias("name"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type")))
    # Written, since places are read three times.
    rows = cut(rows.select("query_id", tokens.alias("_t"), "_all").select("query_id", "_t", spans.alias("_s")), "profile-spans").filter(F.size("_s") > 1)
    known = rows.select("query_id", F.posexplode("_s").alias("pos", "_x")).select("query_id", "pos", "_x.name", "_x.start", "_x.end")
    got = rows.select("query_id", F.posexplode(found_relations(F.col("_t"), F.col("_s"), models.relations)).alias("pos", "_r")).select("query_id", "pos", "_r.*")
    named = resolved_spans(got, known)
    clean = lambda c: F.regexp_replace(without_possessive(strip(F.col(c))), "^[ \t\n\r\"']+|[ \t\n\r\"']+$", "")
    named = named.select("query_id", "pos", clean("source").alias("source"), clean("target").alias("target"), "relationship_type", "confidence")
    return distinct_relations(named, p=p).withColumn("confidence", F.round("confidence", 2))


def parsed_profile(reply: Column) -> Column:
    """A struct of both parties and the high-risk list from a reply (JSN04, JSN02, JSN03, JSN06); what isn't there, or of another type, is empty."""
    first = js.first_object(without_fences(strip(reply)))
    whole = F.when(js.is_object(first), first)
    part = lambda name, schema, empty: js.typed(F.get_json_object(whole, f"$.{name}"), schema, empty).alias(name)
    return F.struct(part("customer", PARTY, "{}"), part("corporate_guarantor", PARTY, "{}"), part("high_risk_entities", RISKS, "[]"))


def profiles(
    queries: DataFrame, docs: DataFrame, chunks: DataFrame, models: Models, p: Params = DEFAULT,
    templates: Sequence[str] = (SNAPSHOT_PROMPT, PROFILE_PROMPT),
) -> Profiled:
    """Stages 9 to 14 of a search, and its citations.

    ``queries``: ``query_id``, ``query``. ``docs``: the chosen documents, ``chunks``: the chosen chunks, both with ``order``; contents are those of
    ``fathomline.plans.search``. A query without chunks has an empty profile and confidence 0. Everything is keyed by query; chunks, replies
    and entities are kept, since several steps read them and models should run once.
    """
    chunks = chunks.persist()
    blocks = prompt_block(chunks, p=p).join(shuffled(queries.select("query_id", "query")), "query_id")
    written = snapshots(blocks, models, templates[0]).persist()
    results = checked(written, chunks, models, p).persist()
    texts, found = entities(chunks, models, p)
    found = found.persist()
    linked = relations(texts, found, models, p)
    # The names of the query's own company decide which relations are direct.
    context = context_block(found, linked.join(shuffled(queries.select("query_id", F.col("query").alias("company"))), "query_id"), p=p)
    asked = blocks.join(shuffled(context), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("none")))
    reply = generated(prompt(templates[1], company=F.col("query"), documents_block=F.col("documents_block"), context_block=F.col("context")), models.generate)
    filled = asked.select("query_id", reply.alias("_reply")).select("query_id", parsed_profile(F.col("_reply")).alias("_p")).select("query_id", "_p.*")

    scores = fact_check_score(results, p=p)
    final = verified_snapshot(results, written).join(shuffled(scores), "query_id", "left").join(shuffled(filled), "query_id")
    checked_score = F.when(F.col("snapshot") != "", F.coalesce("fact_check_score", F.lit(p.unverified)))
    final = final.withColumn("fact_check_score", checked_score).withColumn("high_risk_entities", high_risk_others(F.col("high_risk_entities"), F.col("query"), F.col("customer.name"), p))
    confidence = profile_confidence(strip(F.col("snapshot")), F.col("customer"), F.col("corporate_guarantor"), F.col("high_risk_entities"), F.col("fact_check_score"))
    final = final.withColumn("confidence", confidence).persist()

    names = F.concat(F.array("customer.name", "corporate_guarantor.name"), F.transform("high_risk_entities", lambda x: x["name"]))
    ordered = prefer_names(docs.drop("query").join(shuffled(final.select("query_id", F.array_compact(names).alias("names"))), "query_id")).drop("names")
    fields = ("title", "url", "source", "source_date", "snippet", "content")
    shown = F.struct("order", *(text(F.col(c)).alias(c) for c in fields))
    listed = ordered.filter(F.col("order") <= p.stored_docs).groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("_d"))
    as_map = lambda d: F.create_map(*(x for c in fields for x in (F.lit(c), F.left(d[c], F.lit(p.stored_chars)) if c == "content" else d[c])))
    listed = listed.select("query_id", F.transform("_d", as_map).alias("documents"))
    none = lambda c, schema, empty: F.coalesce(F.col(c), F.from_json(F.lit(empty), schema)).alias(c)
    out = queries.select("query_id", "query").join(shuffled(final.drop("query")), "query_id", "left").join(shuffled(listed), "query_id", "left").select(
        "query_id", F.col("query").alias("company"), text(F.col("snapshot")).alias("snapshot"), none("customer", PARTY, "{}"), none("corporate_guarantor", PARTY, "{}"),
        none("high_risk_entities", RISKS, "[]"), none("documents", "array<map<string,string>>", "[]"), "fact_check_score", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    numbered = ordered.withColumn("doc_index", (F.col("order") - 1).cast("int"))
    citations = cited(profile_values(final), numbered)
    wanted = candidate_names(final, p=p)
    candidates = scored_candidates(chunks.drop("query").withColumn("doc_index", F.col("order")), wanted, p=p)
    return Profiled(out, results, citations, candidates)
