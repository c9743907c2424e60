"""Thresholds, caps and word lists of the engine. Fixed values; override them by ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # retrieval
    retrieval_limit: int = 25
    min_content: int = 50
    max_index_docs: int = 40
    max_queries: int = 6
    snippet_chars: int = 300
    # near-duplicate elimination
    dedupe_jaccard: float = 0.85
    dedupe_chars: int = 2000
    # reranking and selection
    max_docs: int = 15
    rerank_chars: int = 2000
    min_relevance: float = 0.5
    diversity_penalty: float = 0.9
    diverse_top: int = 5
    top_results: int = 10
    chunk_candidates: int = 80
    score_is_logit: bool = True
    recency_weight: float = 0.15
    recency_days: float = 30.0
    cache_weight: float = 0.20
    carry_index_meta: bool = False
    phrase_min_chars: int = 6
    self_min_chars: int = 6
    # documents
    split_sentences: int = 100
    split_overlap: int = 20
    prompt_doc_chars: int = 1500
    entity_text_chars: int = 8000
    context_entities: int = 30
    context_relations: int = 40
    # claims
    max_claims: int = 10
    min_claim: int = 20
    evidence_per_claim: int = 3
    neutral_weight: float = 0.5
    contradiction: float = 0.9
    entailment_max: float = 0.05
    unverified: float = 0.25
    # entities and relations
    entity_ratio: float = 0.75
    relation_confidence: float = 0.8
    relation_tokens: int = 512
    # candidates
    max_party: int = 6
    max_high_risk: int = 8
    max_candidates: int = 12
    min_mentions: int = 1
    min_context: int = 1
    window_chars: int = 140
    promote_score: float = 0.5
    max_promotions: int = 20
    priority_entities: int = 50
    priority_queries: int = 8
    batch_items: int = 3
    max_rounds: int = 60
    # web content
    content_min: int = 100
    pdf_min: int = 50
    content_enough: int = 1000
    content_max: int = 20000
    date_chars: int = 2000
    stored_docs: int = 25
    stored_chars: int = 2000
    feed_entries: int = 30
    source_results: int = 10


DEFAULT = Params()

# English and Malay stopwords.
ENGLISH_STOPWORDS = (
    "a an the i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves am is are was were be been being have has had having do does did doing will would could "
    "should might must shall can need dare ought used in on at by for with about against between into through during before after above "
    "below to from up down out off over under again further then once and but or nor so yet both either neither not only own same than "
    "too very what which who whom this that these those when where why how all each every few more most other some such no any if because "
    "as until while of also just now here there"
).split()
MALAY_STOPWORDS = (
    "dan yang di ke dari pada untuk dengan adalah ini itu atau juga akan tetapi oleh serta dalam sebagai tidak telah sudah dapat bagi antara "
    "setelah bila jika agar supaya bahawa kerana walau walaupun namun seperti iaitu yakni sehingga hingga sambil ketika semasa sejak sebelum "
    "sesudah selama apabila manakala sedangkan maka lalu kemudian saya kami kita anda mereka dia beliau nya pun lah kah"
).split()
# Words that make no entity name on their own.
NAME_STOPWORDS = ["the", "of", "in", "a", "an", "and", "or", "-", "–", "—", "'", '"', ",", ".", ":", ";", "dan", "yang", "di", "ke", "dari"]
# Tokens dropped from note queries.
NOTE_DROP_TOKENS = ["berhad", "bhd", "sdn", "malaysia"]
# Context keywords by role.
CUSTOMER_KEYWORDS = [
    "customer", "borrower", "issuer", "obligor", "facility", "financing", "loan", "term loan", "sukuk", "programme", "information memorandum",
]
GUARANTOR_KEYWORDS = ["guarantor", "guarantee", "corporate guarantee", "penjamin", "jaminan", "jaminan korporat"]
HIGH_RISK_KEYWORDS = [
    "investigation", "charged", "lawsuit", "court", "fraud", "corruption", "money laundering", "enforcement action", "regulatory action",
    "disciplinary", "sanction", "penalty", "fine", "convicted", "arrested", "macc", "sprm", "pdrm", "bnm enforcement", "sc malaysia",
    "bursa enforcement",
]
# Query suffixes of profiles and of loan cases, in order.
QUERY_SUFFIXES = [
    "credit rating", "rating action", "ram ratings", "marc ratings", "annual report", "sustainability report", "sustainability statement", "esg report",
    "financing", "financing facility", "term loan", "loan facility", "facility agreement", "corporate guarantee", "guarantor", "issuer", "programme", "sukuk",
    "sukuk programme", "trust deed", "information memorandum", "principal terms", "bursa announcement", "kemudahan pembiayaan", "kemudahan kredit",
    "perjanjian kemudahan", "jaminan korporat", "penjamin", "terbitan sukuk", "board changes", "director appointment",
]
LOAN_CASE_SUFFIXES = [
    "corporate guarantee", "guarantor", "facility agreement", "term loan", "loan facility", "financing facility", "sukuk programme", "information memorandum",
    "trust deed", "rating action", "credit rating", "issuer", "programme", "sukuk", "principal terms", "bursa announcement", "jaminan korporat", "penjamin",
    "perjanjian kemudahan", "kemudahan pembiayaan", "kemudahan kredit", "terbitan sukuk",
]
# Sites whose pages are never fetched, marks of files and of enforcement pages.
SKIP_DOMAINS = ["twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "reddit.com", "linkedin.com", "tiktok.com"]
PDF_URL_KEYWORDS = ["disclosure.bursamalaysia.com/fileaccess/apbursaweb/download", "/fileaccess/apbursaweb/download", "ea_ds_attachments"]
ENFORCEMENT_URL_KEYWORDS = ["/enforcement/", "/regulation/enforcement", "/regulation/disciplinary", "/enf/", "/actions/", "/enforcement-actions"]
# Meta keys that results leave out.
INTERNAL_META = ["source_id", "split_id", "split_idx_start", "_split_overlap"]
# Sources that go to the index without reranking.
UNRANKED_SOURCES = ["RAM Ratings", "MARC Ratings"]
