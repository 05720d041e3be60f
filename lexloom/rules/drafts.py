"""Checks a draft must pass before it is used."""

# Fixed values: (issue key, pattern of a placeholder left in the text).
PLACEHOLDERS = [
    ("unrendered_placeholder", r"\{\{.*?\}\}"),
    ("bracketed_placeholder", r"\[\s*(?:insert|name|address|date|amount|xxx)[^\]]*\]"),
    ("literal_xxx", r"\bXXX+\b"),
    ("to_be_decided", r"\bTBD\b|\bTO BE (?:FILLED|DECIDED)\b"),
    ("filler_text", r"\bLorem ipsum\b"),
]
PLACEHOLDER_EXCERPT_CHARS = 80

# What marks a pleading, and what a pleading must then contain.
# (issue key, severity, any of these words satisfies it, excerpt shown)
PLEADING = r"\b(?:complaint|petition|plaint|application)\b"
PLEADING_NEEDS = [
    ("no_verification", "high", ["verification", "verify"], "(no verification clause found)"),
    ("no_prayer", "high", ["prayer", "pleased to"], "(no prayer clause found)"),
    ("no_limitation", "medium", ["limitation", "within two years"], "(no limitation averment found)"),
    ("no_jurisdiction", "medium", ["jurisdiction"], "(no jurisdiction averment found)"),
]

# Remaining checks.
AFFIDAVIT, AFFIRMATION = "affidavit", "solemnly affirm"
NOTICE, SERVICE_MODE = r"\bnotice\b", "registered post"
DATE_LABEL = r"\bdate[d]?\s*[:\-]"
DATE_FIGURES = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"

# Chunk sizes in characters and the start of a structural unit.
MAX_CHUNK_CHARS = 1800
MIN_CHUNK_CHARS = 200
HEADING_CHARS = 180
STRUCTURE_BREAK = (
    r"^\s*(?:"
    r"\d{1,2}(?:\.\d{1,2}){0,3}[.)]?\s+[A-Z(]"
    r"|\([a-z]{1,3}\)\s+[A-Z]"
    r"|(?:CLAUSE|Clause|SECTION|Section|ARTICLE|Article)\s+[\dIVXLC]+"
    r"|[A-Z][A-Z \-]{6,60}$"
    r")"
)
PARAGRAPH_BREAK = r"\n\s*\n"

# Rank-fusion constant, hits per leg and passage limits.
RRF_K = 60
LEG_FACTOR = 3
PASSAGE_CONTEXT = 300
PASSAGE_LIMIT = 20
SNIPPET_CHARS = 400
