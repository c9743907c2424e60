"""Schemas of the data model, as DDL."""

PARTY = "struct<name:string,rating:string,esg_scorecard:string,new_director:string,appointment_date:string>"
RISKS = "array<struct<name:string,position:string,relationship:string>>"
PROFILE = (
    "profile_id long, company string, snapshot string, customer_json string, corporate_guarantor_json string, high_risk_entities_json string, "
    "documents_json string, confidence double, created_at string"
)
DOCUMENT = (
    "doc_id long, content string, title string, url string, snippet string, source string, source_date string, indexed_at string, "
    "is_from_db boolean, relevance_score double, score double, profile_confidence double, extra map<string,string>"
)
EVIDENCE = "array<struct<url:string,title:string,source:string,source_date:string>>"
CANDIDATE = (
    "name string, role string, roles array<string>, score double, mentions long, context_hits long, "
    f"evidence {EVIDENCE}, source_query string, first_seen_at string, last_seen_at string, promoted_at string, pos long"
)
SEEN_URL = "url string"
SEED = "name string, pos long"
CURSOR = "company_code string, next_offset long, done boolean, updated_at string"
CACHE = "source string, query string, saved_at timestamp, docs array<map<string,string>>"
