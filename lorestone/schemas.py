"""Explicit schemas of the stored tables."""

NOTE = (
    "id string, title string, content string, keywords array<string>, source string, created string, "
    "updated string, links array<struct<target:string,type:string,similarity:double,shared_entities:array<string>>>, "
    "supersedes string, superseded_by string, entities array<string>, prospective_queries array<string>, "
    "confidence double, confirmation_count int, contradiction_count int, last_confirmed string, source_quality string"
)
TRIGGER = "id string, condition string, action string, created string, fired array<string>, active boolean"
ENTITY = "id string, type string, label string, first_seen string, trace_count int"
RELATION = "source string, target string, type string, weight double, evidence array<string>"
EVENT = "date string, text string, source string, paragraph_idx int"
COMPILED_FACT = (
    "fact_id string, fact_type string, subject string, fact string, source string, valid_from string, "
    "valid_to string, scope string, truth_mode string, priority double, aliases array<string>, schema_version int"
)
LEDGER = (
    "kind string, event_id string, ts double, `by` string, query string, top_k int, project string, "
    "returned_ids array<string>, found boolean, score double, abstained boolean, was_used boolean, was_correct boolean"
)
FEED = "ty string, s string, t string, p string, i string, h string"
HISTORY = "query string, timestamp double, results array<struct<trace:string,score:double>>"
HYPOTHESIS = (
    "question_id string, question_type string, judge_label boolean, judge_model string, hypothesis string, "
    "retrieval_diagnostics struct<answer_session_recall:double,missing_answer_session_ids:array<string>,"
    "session_limited_answer_session_ids:array<string>,budget_dropped_answer_session_ids:array<string>>"
)
SESSIONS = (
    "question_id string, question string, question_type string, question_date string, "
    "answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string>>>"
)
STIMULUS = (
    "text string, content string, project string, actor string, source string, timestamp string, "
    "entities array<string>, kind string, source_ref string"
)
VECTOR = "chunk_id string, text string, source string, content_hash string, metadata map<string,string>, embedding array<double>"
