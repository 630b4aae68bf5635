"""Table layouts, written as DDL, and closed value lists."""

from __future__ import annotations

# --- Fixed values: the names are part of the data contract. -------------------------------
BLOCK_TYPES = (
    "heading", "paragraph", "table", "checkbox", "signature", "empty",
    "handwriting", "page_label", "stamp",
)
BODY_TYPES = ("heading", "paragraph", "table")
BLOCK_SOURCES = ("text_layer", "ocr", "vision", "template")
ELIGIBLE_ROLES = ("exam", "visit", "session", "surgery", "signature", "report")
INELIGIBLE_ROLES = ("event", "received", "fax", "print", "birth", "death")
DATE_ROLES = (*ELIGIBLE_ROLES, *INELIGIBLE_ROLES, "unknown")
ROW_STATUSES = ("resolved", "inferred", "ambiguous", "undated", "illegible", "manual")
LEGIBILITY = ("legible", "degraded", "illegible")
EPISTEMIC_TAGS = ("KEY", "INF-H", "INF-L", "PROP", "GAP")
UNIT_KINDS = ("primary", "referenced")
VERDICTS = ("identical", "same_doc_different_artifact", "related", "different")
CHANGES = (
    "new", "unchanged", "gained_locator", "content_changed", "date_changed", "dropped",
)
#: Share of the lowest line confidence a row keeps, by the status of its date.
STATUS_FACTOR = {
    "resolved": 1.0, "manual": 1.0, "inferred": 0.9,
    "ambiguous": 0.7, "undated": 0.6, "illegible": 0.3,
}
#: A row at or under this confidence is marked for review.
WARN_AT = 0.75
# -------------------------------------------------------------------------------------------

CASES = (
    "case_id string, name string, primary_pack string, created_at timestamp"
)
BUNDLES = (
    "bundle_id string, case_id string, filename string, folder_label string,"
    " content_hash string, page_count long"
)
PAGES = (
    "case_id string, bundle_id string, pdf_index int, width double, height double"
)
LINES = (
    "case_id string, bundle_id string, pdf_index int, ord int, text string,"
    " font_size double, body_size double, x0 double, y0 double, x1 double, y1 double,"
    " page_height double"
)
BLOCKS = (
    "case_id string, bundle_id string, pdf_index int, ord int, block_id string, type string,"
    " text string, x0 double, y0 double, x1 double, y1 double, page_height double,"
    " source string, confidence double, level int, field string, label_rule string,"
    " label string, degenerate boolean, font_size double, alpha int, good int"
)
DATE_FACTS = (
    "case_id string, unit_id string, block_id string, pdf_index int, ord int, start int,"
    " end int, kind int, role string, readings array<date>, raw string, confidence double,"
    " century_inferred boolean"
)
RECORDS = (
    "case_id string, unit_id string, stage string, field string, value string,"
    " confidence double, block_id string, span_start int, span_end int, derived boolean,"
    " rule string, epistemic_tag string"
)
CORRECTIONS = (
    "correction_id string, case_id string, subject_type string, subject_id string,"
    " field string, old_value string, new_value string, rule string, actor string,"
    " created_at timestamp"
)
AUDIT = (
    "audit_id string, ts timestamp, actor string, run_id string, subject_type string,"
    " subject_id string, action string, rule string, epistemic_tag string, detail string"
)
RUNS = (
    "run_id string, case_id string, settings map<string,string>, pack_versions"
    " map<string,string>, created_at timestamp, finished_at timestamp, approved boolean"
)
SELECTIONS = (
    "unit_id string, part int, seq int, block_id string, start int, end int, field string"
)
TRANSCRIPT = (
    "lines array<struct<text:string,kind:string,legible:boolean>>"
)
OCR_WORDS = (
    "level int, page_num int, block_num int, par_num int, line_num int, word_num int,"
    " left int, top int, width int, height int, conf double, text string"
)
GOLD = (
    "gold_version string, bundles map<string,string>,"
    " units array<struct<pages:array<int>,class:string,row_date:string,status:string,"
    "excluded_by:string,regime:string,cue_fields:map<string,string>>>,"
    " printed_labels map<string,string>, proposed array<int>, unresolved array<int>"
)
