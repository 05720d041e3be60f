"""Contract review, forums, translation, site indexes, listings and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lexloom.functions.text import (
    indian_grouping,
    loose_date,
    section_key,
    start_year,
    strip_markup,
)
from lexloom.operators import courts, review, translation
from lexloom.rules import clauses, drafts
from lexloom.rules.courts import (
    COURT_ALIASES,
    COURT_DIRECTORY,
    FORUM_DEFAULT,
    FORUM_RULES,
    HIGH_COURTS,
)
from lexloom.session import shared_folder
from lexloom.sources import html_index, listing
from lexloom.streaming import ingest
from workload.case_queries import FOLD
from workload.tables import Tables, wide, with_tables

MIN_DATE = date(1996, 1, 1)
OLDEST = date(1995, 1, 4)

RECORDS = {
    "disputes": """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'Dishonoured cheque' WHEN 2 THEN 'DEFECTIVE goods' WHEN 3 THEN 'arbitration of ' || l_shipmode_like
  WHEN 4 THEN 'Writ against government' WHEN 5 THEN 'eviction of tenant' WHEN 6 THEN 'winding up of company' ELSE 'recovery of money' END AS subject,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE 'Place ' || CAST(l_suppkey % 5 AS STRING) END AS cause_place, CASE WHEN l_linestatus = 'O' THEN 'Town' ELSE NULL END AS defendant_place
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM {lineitem}) x""",
    "court_mentions": f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN split_part('{','.join(COURT_ALIASES)}', ',', CAST(o_orderkey % 39 AS INT) + 1)
  WHEN 1 THEN ' Registry of the ' || upper(split_part('{','.join(COURT_ALIASES)}', ',', CAST(o_orderkey % 39 AS INT) + 1)) || ' bench'
  WHEN 2 THEN split_part('{','.join(HIGH_COURTS)}', ',', CAST(o_orderkey % 25 AS INT) + 1) ELSE 'Tribunal ' || o_orderpriority END AS name
FROM {{orders}}""",
    "notices_to_pay": """
SELECT o_orderkey, 'Sir/Madam,' || chr(10) || 'That you were and continue to be legally liable to pay a sum of Rs ' || CAST(o_orderkey AS STRING) || '/- (Rupees ' || o_orderpriority || ' only) to my client.' || chr(10) ||
  'within fifteen (15) days from the date' || chr(10) || 'IN THE HIGH COURT OF JUDICATURE AT LAND' || CAST(o_custkey AS STRING) || chr(10) || 'pass $5 and ' || chr(92) || ' signs; and' || chr(10) ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'Verification' ELSE 'Yours faithfully,' END AS text
FROM {orders}""",
    # One page of a paged table per customer; a page lists that customer's orders.
    "index_rows": """
SELECT o_custkey AS page_no, o_orderkey, '<tr class="r"><td>' || CAST(o_orderkey AS STRING) || '</td><td> WP/' || CAST(o_orderkey AS STRING) || ' </td><td>' ||
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '<b>Party ' || CAST(o_custkey AS STRING) || '</b>  v State' END || '</td>' || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '<td>J. ' || o_orderpriority || '</td>' END ||
  '<td><a href="order-pdf/CN' || CAST(o_orderkey % 700 AS STRING) || '/' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '?path=p' || CAST(o_orderkey AS STRING) || '&x">' ||
  lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING) || '</a></td></tr>' AS row_html
FROM {orders}""",
    "index_pages": "SELECT page_no, o_orderkey AS row_no, '<table>' || row_html || '</table>' AS html FROM {index_rows}",
    "order_lists": """
SELECT o_orderkey AS page_id, '<ul><li> <a href="https://www.sci.gov.in/view-pdf/?diary_no=' || CAST(o_orderkey % 4000 AS STRING) || '&type=' || CASE WHEN o_orderkey % 2 = 0 THEN 'j' ELSE 'o' END || '&order_date=' || CAST(CAST(o_orderdate AS DATE) AS STRING) ||
  '&from=x" target="_blank">M/S <i>Party' || CAST(o_custkey AS STRING) || '</i> vs. Union - C.A. No. ' || CAST(o_orderkey AS STRING) || ' - Diary Number 7 / 1999 - 05-Jan-2024 (Uploaded On 1)</a> </li></ul>' AS html
FROM {orders}""",
    "volume_pages": """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Vol ' ELSE '' END || CAST(year(o_orderdate) - 130 AS STRING) || '-66' AS label,
  '<table><tr><td><A class="x" href="dir/case' || CAST(o_orderkey AS STRING) || '.pdf">Reg. &amp; Co v. <i>Person' || CAST(o_custkey AS STRING) || '</i></A> ' ||
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '1862-1865 (' || CAST(o_orderkey % 9 + 1 AS STRING) || ') BHCR A' || CAST(o_orderkey % 90 + 1 AS STRING) END || ' decided &lt; <b>soon</b></td></tr></table><a href="bhcrvol2.html">next</a>' AS html
FROM {orders}""",
    "law_report_pages": """
SELECT o_orderkey AS page_id, CAST(year(o_orderdate) - 120 AS STRING) AS label, '<a target="_blank" href="v1/1Bom' || CAST(o_orderkey AS STRING) || '.pdf">Case &quot;' || o_orderpriority || '&quot;</a><a href="v1/other%20' || CAST(o_orderkey AS STRING) || '.pdf"></a>' AS html
FROM {orders}""",
    "listing_pages": f"""
SELECT o_orderkey, '<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Contents><Key>metadata/parquet/year=' || CAST(year(o_orderdate) AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '/sc' || CAST(o_orderkey AS STRING) || '.parquet'
  ELSE '/court=' || split_part('{','.join(HIGH_COURTS)}', ',', CAST(o_orderkey % 25 AS INT) + 1) || '/bench=b' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN '/mobile.parquet' ELSE '/metadata.parquet' END END ||
  '</Key><Size>' || CAST(o_orderkey * 10 AS STRING) || '</Size></Contents><Contents><Key>readme.txt</Key><Size>1</Size></Contents><IsTruncated>false</IsTruncated>' || CASE WHEN o_orderkey % 11 = 0 THEN '<NextContinuationToken>t' || CAST(o_orderkey AS STRING) || '</NextContinuationToken>' ELSE '' END || '</ListBucketResult>' AS body
FROM {{orders}}""",
    "page_edges": """
SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) AS src, 'c' || CAST(o_orderkey % (SELECT count(*) FROM {customer}) AS STRING) AS dst FROM {orders}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'd' || CAST(c_custkey AS STRING) FROM {customer} WHERE c_custkey = 1
UNION ALL SELECT 'd' || CAST(c_custkey AS STRING), 'd' || CAST(c_custkey + 1 AS STRING) FROM {customer} WHERE c_custkey < 16""",
    "written_dates": """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 1 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
  WHEN 2 THEN ' ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || CAST(year(o_orderdate) AS STRING) || ' '
  WHEN 3 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '-' || split_part('Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec', ',', CAST(month(o_orderdate) AS INT)) || '-' || CAST(year(o_orderdate) AS STRING)
  ELSE 'on ' || o_orderpriority END AS written, 'v' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' ' END || CAST(year(o_orderdate) AS STRING) || '-99' AS label
FROM {orders}""",
    "amounts": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey * 37 AS STRING) WHEN 1 THEN '-' || CAST(o_orderkey * 9973 AS STRING) || '.5' WHEN 2 THEN CAST(o_orderkey AS STRING) || '.25' ELSE 'about ' || o_orderpriority END AS amount FROM {orders}""",
}


class Records(Tables):
    """Tables with the records of this group."""

    texts = RECORDS


# --- review --------------------------------------------------------------------------------


def _contracts(spark, folder):
    return wide(Records(spark, folder)["contracts"])


def missing_clauses(spark, folder):
    """Expected clause types each contract lacks."""
    rows = review.missing_clauses(_contracts(spark, folder), "doc_id", "text")
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"))


def clause_hits(spark, folder):
    """Clauses found in each contract, with excerpts."""
    return review.clause_hits(_contracts(spark, folder), "doc_id", "text")


def clause_map(spark, folder):
    """Clause types of each contract."""
    rows = review.clause_map(review.clause_hits(_contracts(spark, folder), "doc_id", "text"), "doc_id")
    return rows.select("doc_id", "clause", "occurrences", "first_position", F.array_join("excerpts", " | ").alias("excerpts"))


def risk_flags(spark, folder):
    """Risks of each contract."""
    return review.risk_flags(_contracts(spark, folder), "doc_id", "text")


def risk_summary(spark, folder):
    """Risks of each contract by severity."""
    return review.flags_by_severity(review.risk_flags(_contracts(spark, folder), "doc_id", "text"), "doc_id")


def draft_issues(spark, folder):
    """Defects of each draft."""
    return review.draft_issues(_contracts(spark, folder), "doc_id", "text")


def draft_summary(spark, folder):
    """Defects counted per draft."""
    return review.draft_summary(review.draft_issues(_contracts(spark, folder), "doc_id", "text"), "doc_id")


def dispute_forums(spark, folder):
    """Forum of every dispute, and the places it may be brought."""
    rows = Records(spark, folder)["disputes"].select(
        courts.forum(F.col("subject")).alias("f"),
        F.size(courts.territorial_options(F.col("cause_place"), F.col("defendant_place"))).alias("options"),
    )
    return rows.groupBy("f.forum", "f.basis", "options").agg(F.count("*").alias("disputes"))


def directory_use(spark, folder):
    """Directory entries per court type, with the disputes that point to a tribunal."""
    t = Records(spark, folder)
    kinds = t["disputes"].select(
        F.when(courts.forum(F.col("subject"))["forum"].contains("Tribunal"), "tribunal").otherwise("district_court").alias("court_type")
    ).groupBy("court_type").agg(F.count("*").alias("disputes"))
    listed = courts.court_directory(spark).groupBy("court_type").agg(F.count("*").alias("courts"))
    return listed.join(kinds, "court_type", "left").select("court_type", "courts", F.coalesce("disputes", F.lit(0).cast("bigint")).alias("disputes"))


def court_codes(spark, folder):
    """Court meant by every mention."""
    rows = Records(spark, folder)["court_mentions"]
    return rows.select("o_orderkey", courts.court_code(F.col("name")).alias("code"))


def translated_notices(spark, folder):
    """Notices with their standard phrases in Hindi."""
    rows = translation.translate(wide(Records(spark, folder)["notices_to_pay"]), "text", "hi-IN")
    return rows.select("o_orderkey", "translated", "sentences_translated")


# --- site indexes ----------------------------------------------------------------------------


def page_links(spark, folder):
    """Links of every page."""
    return html_index.links(Records(spark, folder)["pages"], "page_id", "html")


def page_text(spark, folder):
    """Text of every page without markup."""
    rows = Records(spark, folder)["pages"]
    return rows.select("page_id", F.md5(strip_markup(F.col("html"))).alias("digest"))


def recent_judgments(spark, folder):
    """Judgments of paged tables down to a date."""
    pages = Records(spark, folder)["index_pages"].select(F.struct("page_no", "row_no").alias("page"), "html")
    rows = html_index.recent_judgments(pages, "page", "html", OLDEST)
    return rows.select("cnr", F.col("page.row_no").alias("row_no"), "matter", "title", "judge", "decision_date", "pdf_path")


def latest_orders(spark, folder):
    """Entries of link lists."""
    rows = html_index.latest_orders(Records(spark, folder)["order_lists"], "page_id", "html", MIN_DATE)
    return rows.select("doc_name", "decision_date", "title", "citation", "description")


def volume_cases(spark, folder):
    """Cases of archive volumes."""
    rows = html_index.volume_cases(Records(spark, folder)["volume_pages"], "page_id", "html", "label")
    return rows.select("page_id", "href", "title", "citation", "description", "year", "decision_date")


def law_report_cases(spark, folder):
    """Cases of law-report indexes."""
    rows = html_index.law_report_cases(Records(spark, folder)["law_report_pages"], "page_id", "html", "label")
    return rows.select("page_id", "href", "title", "citation", "year", "decision_date")


def ledger_cases(spark, folder):
    """Cases of ledger pages."""
    rows = html_index.ledger_cases(Records(spark, folder)["law_report_pages"], "page_id", "html", "diwani", 1825)
    return rows.select("page_id", "href", "title", "citation", "year", "decision_date")


def reachable_pages(spark, folder):
    """Pages reachable from the first, level by level."""
    t = Records(spark, folder)
    start = t["customer"].agg(F.concat(F.lit("c"), F.min("c_custkey")).alias("url"))
    return html_index.reachable_pages(start, t["page_edges"])


# --- listings ----------------------------------------------------------------------------------


def _plan(t):
    found = listing.parse_listing(wide(t["listing_pages"]), "body")
    wanted = listing.wanted_keys(found, ["SC", *list(HIGH_COURTS)[:12]], 1996, 1999)
    held = wanted.where("size % 400 = 0").select("target", F.when(F.col("size") % 800 == 0, 0).otherwise(F.col("size")).alias("size"))
    return listing.fetch_plan(wanted, held)


def fetch_plan(spark, folder):
    """Listed files that are wanted, and whether they must be fetched."""
    return _plan(Records(spark, folder)).select("key", "size", "year", "court", "bench", "target", "fetch")


def sync_totals(spark, folder):
    """Fetched and skipped files per court and in total."""
    return listing.sync_totals(_plan(Records(spark, folder)))


def listing_tokens(spark, folder):
    """Continuation tokens of listing pages."""
    return listing.next_tokens(Records(spark, folder)["listing_pages"], "body")


def written_dates(spark, folder):
    """Dates in the formats court sites use, and years of volume labels."""
    rows = Records(spark, folder)["written_dates"]
    return rows.select("o_orderkey", loose_date(F.col("written")).alias("iso"), F.coalesce(start_year(F.col("label")), F.lit(0)).alias("year"))


def grouped_amounts(spark, folder):
    """Amounts with Indian digit grouping."""
    rows = Records(spark, folder)["amounts"]
    return rows.select("o_orderkey", indian_grouping(F.col("amount")).alias("grouped"))


def section_keys(spark, folder):
    """Lookup keys of section numbers as people write them."""
    rows = Records(spark, folder).sql(
        "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Section ' || CAST(p_size AS STRING) WHEN 1 THEN ' s. ' || CAST(p_size AS STRING) || '-A.' "
        "WHEN 2 THEN 'Sec. ' || CAST(p_size AS STRING) || ' (2)(b)' ELSE CAST(p_size AS STRING) || ' C.' END AS section FROM {part}"
    )
    return rows.select("p_partkey", section_key(F.col("section")).alias("key"))


# --- streams -----------------------------------------------------------------------------------


def stream_daily_totals(spark, folder):
    """Daily totals kept by a stream that drains the event files."""
    import uuid

    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = ingest.read_table_files(spark, folder, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    run = f"{shared_folder(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    priced = stream.withColumn("paise", F.round(F.col("value") * 100).cast("bigint"))
    ingest.run_daily_totals(priced, "ts", "paise", f"{run}/out", f"{run}/checkpoint").awaitTermination()
    rows = ingest.read_daily_totals(spark, f"{run}/out")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "total")


def stream_documents(spark, folder):
    """Documents a stream stored, each content once."""
    import uuid

    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    stream = ingest.read_table_files(spark, folder, "documents.parquet", schema)
    run = f"{shared_folder(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    ingest.ingest_documents(stream, f"{run}/out", f"{run}/checkpoint", "doc_id", "text").awaitTermination()
    return spark.read.parquet(f"{run}/out").select("doc_id", "sha256")


def stream_documents_batches(spark, folder):
    """Contents stored by a stream of several batches, each of which skips what the earlier ones stored."""
    import uuid

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    run = f"{shared_folder(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    docs.repartitionByRange(4, "doc_id").write.parquet(f"{run}/in")
    stream = ingest.read_new_files(spark, f"{run}/in", docs.schema, files_per_batch=1)
    ingest.ingest_documents(stream, f"{run}/out", f"{run}/checkpoint", "doc_id", "text").awaitTermination()
    return spark.read.parquet(f"{run}/out").groupBy("sha256").agg(F.count("*").alias("stored"))


QUERIES = {
    f.__name__: f
    for f in (
        missing_clauses, clause_hits, clause_map, risk_flags, risk_summary, draft_issues, draft_summary,
        dispute_forums, directory_use, court_codes, translated_notices, page_links, page_text,
        recent_judgments, latest_orders, volume_cases, law_report_cases, ledger_cases, reachable_pages,
        fetch_plan, sync_totals, listing_tokens, written_dates, grouped_amounts, section_keys,
        stream_daily_totals, stream_documents, stream_documents_batches,
    )
}

# --- the same answers in SQL ---------------------------------------------------------------------


def _q(text):
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _match(text, pattern):
    return f"regexp_matches({text}, {_q('(?i)(?:' + pattern + ')')})"


_PRESENT = {
    key: " OR ".join(_match("f", p) for p in patterns) for key, _, _, patterns in clauses.CLAUSE_TYPES
}
_MISSING = ", ".join(
    f"CASE WHEN NOT ({_PRESENT[key]}) THEN '{key}' END" for key, _, expected, _ in clauses.CLAUSE_TYPES if expected
)
_CLAUSE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, text, f, '{key}' AS clause, {j} AS pattern_no, regexp_extract_all(f, {_q('(?i)' + p)}) AS raws, regexp_split_to_array(f, {_q('(?i)' + p)}) AS gaps FROM {{folded}} WHERE regexp_matches(f, {_q('(?i)' + p)})"
    for key, _, _, patterns in clauses.CLAUSE_TYPES for j, p in enumerate(patterns)
)
_SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _around(pos, end, before, after):
    return _SQUASH.format(
        f"substring(text, greatest({pos} - {before}, 0) + 1, least({end} + {after}, length(text)) - greatest({pos} - {before}, 0))"
    )


_RISK_ROWS = " UNION ALL ".join(
    (
        f"SELECT doc_id, text, {i} AS n, NULL AS raw, -1 AS position FROM {{folded}} WHERE NOT regexp_matches(f, {_q('(?is)(?:' + pattern + ')')})"
        + (f" AND {_match('f', gate)}" if gate else "")
        if absent else
        f"SELECT doc_id, text, {i} AS n, regexp_extract(f, {_q('(?is)(?:' + pattern + ')')}) AS raw, length(regexp_split_to_array(f, {_q('(?is)(?:' + pattern + ')')})[1]) AS position FROM {{folded}} WHERE regexp_matches(f, {_q('(?is)(?:' + pattern + ')')})"
    )
    for i, (_, _, _, pattern, absent, gate, _) in enumerate(clauses.RISK_RULES)
)
_RISK_VALUES = ", ".join(
    f"({i}, {_q(k)}, {_q(s)}, {clauses.SEVERITY_ORDER[s]}, {_q(t)}, {_q(a)})" for i, (k, s, t, _, _, _, a) in enumerate(clauses.RISK_RULES)
)
_NEEDS = " ".join(
    f"UNION ALL SELECT doc_id, '{name}', '{severity}', {_q(excerpt)} FROM {{folded}} WHERE regexp_matches(lower(f), {_q(drafts.PLEADING)})"
    + "".join(f" AND NOT contains(lower(f), '{w}')" for w in wanted)
    for name, severity, wanted, excerpt in drafts.PLEADING_NEEDS
)
_HOLDERS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS issue, 'high' AS severity, substring(regexp_extract(text, {_q('(?i)' + p)}), 1, {drafts.PLACEHOLDER_EXCERPT_CHARS}) AS excerpt FROM {{folded}} WHERE regexp_matches(text, {_q('(?i)' + p)})"
    for name, p in drafts.PLACEHOLDERS
)
_ISSUES = f"""{_HOLDERS} {_NEEDS}
UNION ALL SELECT doc_id, 'no_affirmation', 'high', '(no affirmation clause found)' FROM {{folded}} WHERE contains(lower(f), '{drafts.AFFIDAVIT}') AND NOT contains(lower(f), '{drafts.AFFIRMATION}')
UNION ALL SELECT doc_id, 'no_service_mode', 'low', '(no service mode stated)' FROM {{folded}} WHERE regexp_matches(lower(f), {_q(drafts.NOTICE)}) AND NOT contains(lower(f), '{drafts.SERVICE_MODE}')
UNION ALL SELECT doc_id, 'no_date', 'medium', '(no date found)' FROM {{folded}} WHERE NOT regexp_matches(lower(f), {_q(drafts.DATE_LABEL)}) AND NOT regexp_matches(f, {_q(drafts.DATE_FIGURES)})"""
_FORUM_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(subject), '{w}')" for w in words) + f" THEN {{pick{i}}}" for i, (words, _, _) in enumerate(FORUM_RULES)
)


def _forum(column):
    text = _FORUM_CASE
    for i, rule in enumerate(FORUM_RULES):
        text = text.replace(f"{{pick{i}}}", _q(rule[1 + column]))
    return f"CASE {text} ELSE {_q(FORUM_DEFAULT[column])} END"


_ALIAS_VALUES = ", ".join(f"({i}, {_q(a)}, {_q(c)})" for i, (a, c) in enumerate(COURT_ALIASES.items()))
_CODES = ", ".join(_q(c) for c in [*HIGH_COURTS, "SC"])
_DIRECTORY = ", ".join(f"({_q(t)}, {_q(n)})" for t, n, _ in COURT_DIRECTORY)


def _translated():
    """Each phrase replaced in its turn; a step is one column pair."""
    sql, counted = "text", []
    steps = "SELECT o_orderkey, text AS t0, 0 AS n0 FROM {notices_to_pay}"
    import re

    for i, (english, target) in enumerate(translation.phrases_for("hi")):
        parts = re.split(r"\{\{\s*(\w+)\s*\}\}", english)
        pattern = "".join("(.*?)" if k % 2 else re.escape(p).replace("\\ ", " ") for k, p in enumerate(parts))
        names = parts[1::2]
        replacement = re.sub(
            r"\{\{\s*(\w+)\s*\}\}", lambda m: f"\\{names.index(m.group(1)) + 1}" if m.group(1) in names else m.group(0),
            target.replace("\\", "\\\\"),
        )
        steps = (
            f"SELECT o_orderkey, regexp_replace(t{i}, {_q('(?i)' + pattern)}, {_q(replacement)}, 'g') AS t{i + 1}, "
            f"n{i} + len(regexp_extract_all(t{i}, {_q('(?i)' + pattern)})) AS n{i + 1} FROM ({steps})"
        )
    last = len(translation.phrases_for("hi"))
    return f"SELECT o_orderkey, t{last} AS translated, CAST(n{last} AS INT) AS sentences_translated FROM ({steps})"


def _html(pattern, group, flags="(?s)"):
    return f"regexp_extract_all(html, {_q(flags + pattern)}, {group})"


_TAGS = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_ENTITIES = "replace(replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_CLEAN = _TAGS.format(_ENTITIES)
_WANTED_COURTS = ", ".join(_q(c) for c in list(HIGH_COURTS)[:12])
_COURT_NAME = " ".join(f"WHEN '{c}' THEN {_q(n)}" for c, n in HIGH_COURTS.items())

EXTRA = {
    **RECORDS,
    "folded": f"SELECT doc_id, text, {FOLD.format('text')} AS f FROM {{contracts}}",
    "clause_raw": _CLAUSE_ROWS,
    "clause_found": """
SELECT doc_id, text, clause, pattern_no, i, raw, CAST(sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id, clause, pattern_no ORDER BY i) - length(raw) AS INT) AS position
FROM (SELECT doc_id, text, clause, pattern_no, unnest(raws) AS raw, unnest(list_slice(gaps, 1, len(raws))) AS gap, generate_subscripts(raws, 1) AS i FROM {clause_raw})""",
    "clause_rows": f"""
SELECT doc_id, clause, CAST(row_number() OVER (PARTITION BY doc_id, clause ORDER BY pattern_no, i) AS INT) AS hit, position,
  {_around('position', '(position + length(raw))', clauses.CLAUSE_BEFORE, clauses.CLAUSE_AFTER)} AS excerpt FROM {{clause_found}} QUALIFY hit <= 5""",
    "risks": f"""
SELECT r.doc_id, v.rule, v.severity, v.severity_order, v.title, v.authority,
  CASE WHEN r.position < 0 THEN {_q(clauses.ABSENT_EXCERPT)} ELSE {_around('r.position', '(r.position + length(r.raw))', clauses.RISK_BEFORE, clauses.RISK_AFTER)} END AS excerpt, CAST(r.position AS INT) AS position
FROM ({_RISK_ROWS}) r JOIN (VALUES {_RISK_VALUES}) AS v(n, rule, severity, severity_order, title, authority) ON v.n = r.n""",
    "issues": _ISSUES,
    "listed": """
SELECT 'metadata/parquet/year=' || y || rest AS key, CAST(o_orderkey * 10 AS BIGINT) AS size, CAST(y AS INT) AS year, court, bench FROM (
  SELECT o_orderkey, regexp_extract(body, 'year=(\\d+)', 1) AS y, regexp_extract(body, 'year=\\d+([^<]*)<', 1) AS rest,
    CASE WHEN contains(body, 'court=') THEN regexp_extract(body, 'court=([^/]+)/', 1) ELSE 'SC' END AS court, regexp_extract(body, 'bench=([^/<]+)/', 1) AS bench FROM {listing_pages})""",
    "wanted": f"""
SELECT *, CASE court WHEN 'SC' THEN 'sc/metadata/year=' || year || '/metadata.parquet' ELSE 'hc/metadata/year=' || year || '/court=' || court || '/bench=' || bench || '/metadata.parquet' END AS target
FROM {{listed}} WHERE year BETWEEN 1996 AND 1999 AND (court = 'SC' OR (court IN ({_WANTED_COURTS}) AND key LIKE '%metadata.parquet'))""",
    "planned": "SELECT *, target NOT IN (SELECT target FROM {wanted} WHERE size % 400 = 0 AND size % 800 <> 0) AS \"fetch\" FROM {wanted}",
    "table_rows": """
SELECT page_no, row_no, regexp_extract_all(html, '<td[^>]*>(.*?)</td>', 1) AS td FROM {index_pages}""",
    "table_fields": f"""
SELECT page_no, row_no, {_TAGS.format('td[2]')} AS matter, {_TAGS.format('td[3]')} AS title, {_TAGS.format('td[4]')} AS judge,
  regexp_extract(td[-1], 'order-pdf/([A-Z0-9]+)/', 1) AS cnr, regexp_extract(td[-1], '\\?path=([^"&\\s]+)', 1) AS pdf_path,
  strftime(strptime(regexp_extract(td[-1], '(\\d\\d/\\d\\d/\\d\\d\\d\\d)', 1), '%d/%m/%Y'), '%Y-%m-%d') AS decision_date
FROM {{table_rows}} WHERE len(td) >= 4""",
}
_SQL = {
    "missing_clauses": f"SELECT doc_id, array_to_string(list_filter([{_MISSING}], lambda x: x IS NOT NULL), ',') AS missing FROM {{folded}}",
    "clause_hits": "SELECT * FROM {clause_rows}",
    "clause_map": """
SELECT doc_id, clause, count(*) AS occurrences, max(position) FILTER (hit = 1) AS first_position, string_agg(excerpt, ' | ' ORDER BY hit) FILTER (hit <= 2) AS excerpts FROM {clause_rows} GROUP BY doc_id, clause""",
    "risk_flags": "SELECT * FROM {risks}",
    "risk_summary": "SELECT doc_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in clauses.SEVERITY_ORDER) + ", count(*) AS flag_count FROM {risks} GROUP BY doc_id",
    "draft_issues": "SELECT * FROM {issues}",
    "draft_summary": "SELECT doc_id, count(*) AS issue_count, count(*) FILTER (severity = 'high') AS high_severity_count FROM {issues} GROUP BY doc_id",
    "dispute_forums": f"""
SELECT {_forum(0)} AS forum, {_forum(1)} AS basis, CAST(CASE WHEN cause_place <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(defendant_place, '') <> '' THEN 1 ELSE 0 END AS INT) AS options, count(*) AS disputes FROM {{disputes}} GROUP BY ALL""",
    "directory_use": f"""
SELECT court_type, count(DISTINCT name) AS courts, CASE court_type WHEN 'tribunal' THEN (SELECT count(*) FROM {{disputes}} WHERE contains({_forum(0)}, 'Tribunal'))
  WHEN 'district_court' THEN (SELECT count(*) FROM {{disputes}} WHERE NOT contains({_forum(0)}, 'Tribunal')) ELSE 0 END AS disputes FROM (VALUES {_DIRECTORY}) AS d(court_type, name) GROUP BY court_type""",
    "court_codes": f"""
SELECT o_orderkey, coalesce((SELECT code FROM (VALUES {_ALIAS_VALUES}) AS a(i, alias, code) WHERE alias = lower(trim(name))), CASE WHEN name IN ({_CODES}) THEN name END,
  (SELECT arg_min(code, i) FROM (VALUES {_ALIAS_VALUES}) AS a(i, alias, code) WHERE length(alias) > 3 AND contains(lower(trim(name)), alias))) AS code FROM {{court_mentions}}""",
    "translated_notices": _translated(),
    "page_links": f"""
SELECT page_id, CAST(i - 1 AS INT) AS i, href, {_TAGS.format('label')} AS label FROM (SELECT page_id, unnest(hrefs) AS href, unnest(labels) AS label, generate_subscripts(hrefs, 1) AS i FROM (
  SELECT page_id, {_html('<a[ \\t\\n][^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, '(?is)')} AS hrefs, {_html('<a[ \\t\\n][^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2, '(?is)')} AS labels FROM {{pages}}))""",
    "page_text": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS digest FROM {pages}",
    "recent_judgments": f"""
SELECT cnr, row_no, matter, title, judge, decision_date, pdf_path FROM (SELECT *, (SELECT min((page_no, row_no)) FROM {{table_fields}} WHERE title <> '' AND decision_date < '{OLDEST}') AS stop FROM {{table_fields}} WHERE title <> '')
WHERE stop IS NULL OR (page_no, row_no) < stop QUALIFY row_number() OVER (PARTITION BY cnr ORDER BY page_no, row_no) = 1""",
    "latest_orders": f"""
SELECT 'sc' || CAST(o_orderkey % 4000 AS VARCHAR) || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'j' ELSE 'o' END || '.pdf' AS doc_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS decision_date,
  'M/S Party' || o_custkey || ' vs. Union - C.A. No. ' || o_orderkey AS title, 'C.A. No. ' || o_orderkey AS citation,
  'M/S Party' || o_custkey || ' vs. Union - C.A. No. ' || o_orderkey || ' - Diary Number 7 / 1999 - 05-Jan-2024 (Uploaded On 1)' AS description
FROM {{orders}} WHERE o_orderdate >= DATE '{MIN_DATE}' QUALIFY row_number() OVER (PARTITION BY o_orderkey % 4000, o_orderkey % 2 ORDER BY o_orderkey) = 1""",
    "volume_cases": """
SELECT o_orderkey AS page_id, 'dir/case' || o_orderkey || '.pdf' AS href, 'Reg. & Co v. Person' || o_custkey AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Vol ' ELSE '' END || (year(o_orderdate) - 130) || '-66' ELSE '1862-1865 (' || (o_orderkey % 9 + 1) || ') BHCR A' || (o_orderkey % 90 + 1) END AS citation,
  'decided soon' AS description, CAST(year(o_orderdate) - 130 AS INT) AS year, (year(o_orderdate) - 130) || '-01-01' AS decision_date FROM {orders}""",
    "law_report_cases": """
SELECT o_orderkey AS page_id, 'v1/1Bom' || o_orderkey || '.pdf' AS href, 'Case "' || o_orderpriority || '"' AS title, 'ILR Bombay ' || (year(o_orderdate) - 120) || ' p.' || o_orderkey AS citation,
  CAST(year(o_orderdate) - 120 AS INT) AS year, (year(o_orderdate) - 120) || '-01-01' AS decision_date FROM {orders}""",
    "ledger_cases": """
SELECT o_orderkey AS page_id, 'v1/1Bom' || o_orderkey || '.pdf' AS href, 'Case "' || o_orderpriority || '"' AS title, 'Diwani Case "' || o_orderpriority || '"' AS citation, 1825 AS year, '1825-01-01' AS decision_date FROM {orders}
UNION ALL SELECT o_orderkey, 'v1/other%20' || o_orderkey || '.pdf', 'Diwani decision other ' || o_orderkey || '.pdf', 'Diwani Diwani decision other ' || o_orderkey || '.pdf', 1825, '1825-01-01' FROM {orders}""",
    "fetch_plan": "SELECT key, size, year, court, bench, target, \"fetch\" FROM {planned}",
    "sync_totals": f"""
SELECT CASE WHEN court IS NULL THEN 'all courts' WHEN court = 'SC' THEN 'Supreme Court of India' ELSE CASE court {_COURT_NAME} END END AS court, count(*) FILTER ("fetch") AS files,
  CAST(coalesce(sum(size) FILTER ("fetch"), 0) AS BIGINT) AS bytes, round_even(CAST(coalesce(sum(size) FILTER ("fetch"), 0) AS DOUBLE) / (1024 * 1024), 1) AS megabytes, count(*) FILTER (NOT "fetch") AS skipped
FROM {{planned}} GROUP BY ROLLUP (court)""",
    "listing_tokens": "SELECT 't' || o_orderkey AS token FROM {orders} WHERE o_orderkey % 11 = 0",
    "written_dates": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS iso, CAST(year(o_orderdate) AS INT) AS year FROM {orders}""",
    "grouped_amounts": """
SELECT o_orderkey, CASE WHEN n IS NULL THEN amount WHEN length(d) <= 3 THEN s || d
  ELSE s || regexp_replace(CASE WHEN length(d) % 2 = 0 THEN substring(d, 1, 1) || ',' || regexp_replace(substring(d, 2, length(d) - 4), '(..)', '\\1,', 'g') || right(d, 3)
    ELSE regexp_replace(left(d, length(d) - 3), '(..)', '\\1,', 'g') || right(d, 3) END, '^,', '') END AS grouped
FROM (SELECT o_orderkey, amount, n, CASE WHEN round_even(n, 0) < 0 THEN '-' ELSE '' END AS s, CAST(abs(CAST(round_even(n, 0) AS BIGINT)) AS VARCHAR) AS d FROM (SELECT *, TRY_CAST(amount AS DOUBLE) AS n FROM {amounts}))""",
    "section_keys": "SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_size % 4 WHEN 1 THEN 'a' WHEN 3 THEN 'c' ELSE '' END AS key FROM {part}",
    "stream_daily_totals": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM {events} GROUP BY 1",
    "stream_documents_batches": "SELECT DISTINCT sha256(text) AS sha256, CAST(1 AS BIGINT) AS stored FROM {documents} WHERE text IS NOT NULL",
    "stream_documents": "SELECT doc_id, sha256(text) AS sha256 FROM {documents} QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
}
ORACLE = {name: with_tables(sql, EXTRA) for name, sql in _SQL.items()}
_EDGES = with_tables("SELECT * FROM {page_edges}", EXTRA)
_EDGE_CTES = _EDGES[len("WITH ") : _EDGES.rindex("\n")]
ORACLE["reachable_pages"] = f"""WITH RECURSIVE {_EDGE_CTES},
walk AS (SELECT 'c' || min(c_custkey) AS url, 0 AS depth FROM customer
UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN page_edges e ON e.src = w.url WHERE w.depth < 32)
SELECT url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY url"""
