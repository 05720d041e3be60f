"""Schemas of the tables that are read and written."""

from __future__ import annotations

#: Files may lack columns or order them differently; they are read by name.
SUPREME_COURT = (
    "title string, petitioner string, respondent string, description string, judge string, "
    "citation string, cnr string, decision_date string, disposal_nature string, "
    "nc_display string, path string, year string"
)
HIGH_COURT = (
    "title string, description string, judge string, pdf_link string, cnr string, "
    "date_of_registration string, decision_date string, disposal_nature string, "
    "pdf_exists boolean, year string, court string, bench string"
)
HARVESTED = (
    "court string, year int, bench string, title string, description string, judge string, "
    "citation string, decision_date string, pdf_link string, source_url string"
)
ACT = (
    "slug string, title string, short_title string, year int, act_number string, "
    "aliases array<string>, coverage string, text_kind string, source string, "
    "india_code_url string, note string, "
    "sections array<struct<number string, heading string, text string, chapter string, "
    "text_kind string, url string>>"
)
UPSTREAM_SECTION = (
    "section string, Section string, chapter_title string, chapter string, "
    "section_title string, section_desc string"
)
HOLIDAYS = "map<string, map<string, array<struct<date string, occasion string>>>>"

MATTERS = (
    "id bigint, reference string, title string, matter_type string, status string, court string, "
    "case_number string, cnr string, parties string, cause_of_action_date date, filing_date date, "
    "limitation_expiry date, claim_value decimal(38,2), opposing_counsel string, notes string, "
    "created_at timestamp, updated_at timestamp"
)
HEARINGS = (
    "id bigint, matter_id bigint, hearing_date date, purpose string, bench string, "
    "outcome string, next_date date, created_at timestamp"
)
MATTER_EVENTS = (
    "id bigint, matter_id bigint, event_date date, event_type string, description string, "
    "created_at timestamp"
)
DOCUMENTS = (
    "id bigint, matter_id bigint, title string, doc_type string, source_path string, "
    "sha256 string, page_count int, char_count int, full_text string, metadata string, "
    "created_at timestamp"
)
DOCUMENT_CHUNKS = (
    "id bigint, document_id bigint, chunk_index int, heading_path string, content string, "
    "tokens array<string>, embedding array<float>"
)
SAVED_RESEARCH = (
    "id bigint, matter_id bigint, issue string, payload string, created_at timestamp"
)
PARTIES = "array<struct<name string, role string>>"
