"""Statute book, concordance, limitation and court calendars."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from lexloom.operators import calendar, limitation, statutes
from lexloom.rules import concordance
from lexloom.rules.calendar import FIXED_NATIONAL_HOLIDAYS
from lexloom.rules.limitation import LIMITATION_RULES
from lexloom.session import shared_folder
from lexloom.sources import schemas
from lexloom.sources.calendars import published_holidays
from lexloom.sources.statutes import (
    acts_table, alias_table, normalised_act, read_acts, sections_table, upstream_rows, well_formed, write_acts,
)
from workload.tables import Tables, wide, with_tables

AS_ON = date(1999, 6, 15)


def _iso(*names):
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


# --- records -----------------------------------------------------------------------

_RULE_KEYS = ",".join(r[0] for r in LIMITATION_RULES)

#: Some claims lie decades before the others, some decades after.
_SHIFTED = (
    "(CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 23 WHEN 0 THEN 14600 WHEN 1 THEN -20000 ELSE 0 END AS INT))"
)

RECORDS = {
    "claims": f"""
SELECT o_orderkey AS claim_id, split_part('{_RULE_KEYS}', ',', CAST(o_orderkey % 31 AS INT) + 1) AS rule_key,
  {_SHIFTED} AS start_date,
  CASE WHEN o_orderkey % 7 = 0 THEN {_SHIFTED} + CAST(o_orderkey % 1500 AS INT) ELSE NULL END AS acknowledged,
  CASE WHEN o_orderkey % 5 = 0 THEN {_SHIFTED} + 3 ELSE NULL END AS copy_applied,
  CASE WHEN o_orderkey % 5 = 0 THEN {_SHIFTED} + 3 + CAST(o_orderkey % 30 AS INT) ELSE NULL END AS copy_ready,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 50 ELSE 0 END AS INT) AS wrong_forum_days,
  'Court ' || CAST(o_custkey % 40 AS STRING) AS court
FROM {{orders}}""",
    "cheques": """
SELECT o_orderkey AS cheque_id, CAST(o_orderdate AS DATE) AS dishonour_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) END AS notice_date,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) + 5 ELSE NULL END AS served_date
FROM {orders}""",
    # A calendar document per court and year: its days are at most those of a year.
    "notices": """
SELECT DISTINCT 'Court ' || CAST(o_custkey % 20 AS STRING) AS court, CAST(year(o_orderdate) AS INT) AS year,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, 'Vacation ' || CAST(month(o_orderdate) AS STRING) AS occasion
FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "calendar_documents": """
SELECT court, '{"' || court || '": {"' || CAST(year AS STRING) || '": [{"date": "' || day || '", "occasion": "' || occasion || '"}, {"date": "not a day"}], "soon": []}}' AS body
FROM {notices}""",
    "act_documents": """
SELECT p_partkey, '{"slug": "act-' || CAST(p_partkey AS STRING) || '", ' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '"title": "' || p_name || ' Act, 1950", ' END ||
  CASE WHEN p_size % 2 = 0 THEN '"coverage": "full", ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '"text_kind": "summary", ' ELSE '' END ||
  '"short_title": "' || p_brand || '", "aliases": ["' || p_type || ' ' || CAST(p_partkey AS STRING) || '"], "sections": [{"number": "' || CAST(p_size AS STRING) || '", "heading": "' || p_name ||
  '", "text": "First"}, {"number": 7, "heading": "Seven"}, {"number": "Section ' || CAST(p_size AS STRING) || '-", "heading": "' || p_type || '", "text": "Later"}' ||
  CASE WHEN p_partkey % 15 = 0 THEN ', {"heading": "no number"}' ELSE '' END || ']}' AS body
FROM {part}""",
    "asked_sections": """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_partkey % 520 AS STRING) WHEN 1 THEN CAST(l_suppkey % 500 AS STRING) || 'A'
  WHEN 2 THEN ' ' || CAST(l_partkey % 400 AS STRING) || '(1). ' ELSE CAST(l_partkey % 60 AS STRING) || ' - b' END AS section
FROM {lineitem}""",
    "claim_texts": """
SELECT o_orderkey AS claim_id, CASE o_orderkey % 6 WHEN 0 THEN 'Money lent to a friend on demand' WHEN 1 THEN 'appeal from the DECREE of a high court'
  WHEN 2 THEN 'unpaid price of goods delivered' WHEN 3 THEN 'criminal breach of trust and cheating' WHEN 4 THEN 'hurt by dangerous weapons or acid'
  ELSE 'an of to' END || ' ' || lower(o_orderpriority) AS text
FROM {orders}""",
}


class Records(Tables):
    """Tables with the records of this group."""

    texts = RECORDS


def _published(t):
    return t["notices"].select("court", F.col("day").cast("date").alias("day"), "occasion")


def _calendar(t, rows, *days):
    return calendar.calendar_over(rows, [F.col(d) if isinstance(d, str) else d for d in days], _published(t))


# --- queries -------------------------------------------------------------------------


def limitation_positions(spark, folder):
    """Limitation position of every claim, rolled to an open day."""
    t = Records(spark, folder)
    claims = calendar.calendar_name(t["claims"], "court", _published(t))
    ends = limitation.positions(t["claims"].drop("court"))
    rows = limitation.standing(limitation.positions(claims, _calendar(t, ends, "unadjusted_expiry")), AS_ON)
    return rows.select(
        "claim_id", *_iso("base_expiry", "expiry"), "restarted", "days_remaining", "expired", "urgency",
        F.array_join(F.transform("exclusions", lambda e: e["provision"]), ",").alias("exclusions"),
        F.size("reasoning").alias("reasons"),
    )


def limitation_by_rule(spark, folder):
    """Claims per rule and urgency."""
    t = Records(spark, folder)
    rows = limitation.standing(limitation.positions(t["claims"].drop("court")), AS_ON)
    return rows.groupBy("rule_key", "source_act", "urgency").agg(F.count("*").alias("claims"))


def rules_in_use(spark, folder):
    """Rules of each Act that some claim uses."""
    t = Records(spark, folder)
    used = limitation.rule_table(spark).join(t["claims"].select("rule_key").distinct(), "rule_key", "left_semi")
    return limitation.rules_by_act(used)


def cheque_timelines(spark, folder):
    """Clocks of every dishonoured cheque."""
    rows = limitation.cheque_timeline(Records(spark, folder)["cheques"], AS_ON)
    return rows.select(
        "cheque_id", *_iso("notice_deadline", "payment_deadline", "cause_of_action_date", "complaint_deadline"),
        "complete", F.coalesce("next_step", F.lit(0)).alias("next_step"),
        F.coalesce("days_remaining", F.lit(99999)).alias("days_remaining"), "urgency",
        F.element_at("steps", 1)["status"].alias("first_status"),
    )


def next_open_days(spark, folder):
    """Next open day of every claim's start."""
    t = Records(spark, folder)
    claims = calendar.calendar_name(t["claims"], "court", _published(t))
    rows = calendar.with_next_open(claims, "start_date", _calendar(t, claims, "start_date"), "open_day")
    return rows.select("claim_id", *_iso("open_day"), F.coalesce("open_day_reason", F.lit("")).alias("reason"))


def working_days_added(spark, folder):
    """The n-th working day after every claim's start."""
    t = Records(spark, folder)
    claims = calendar.calendar_name(t["claims"], "court", _published(t)).withColumn(
        "n", (F.col("claim_id") % 25).cast("int")
    )
    span = _calendar(t, claims, "start_date", calendar.working_days_limit(F.col("start_date"), F.col("n")))
    rows = calendar.add_working_days(claims, "start_date", "n", span, "due")
    return rows.select("claim_id", "n", *_iso("due"))


def working_days_between(spark, folder):
    """Working days from order to shipment of every line."""
    t = Records(spark, folder)
    spans = t.sql(
        "SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, "
        "'Court ' || CAST(o_custkey % 40 AS STRING) AS court FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"
    )
    named = calendar.calendar_name(spans, "court", _published(t))
    rows = calendar.working_days_between(named, "a", "b", _calendar(t, spans, "a", "b"), "working_days")
    return rows.groupBy("l_orderkey").agg(F.sum("working_days").alias("working_days"), F.count("*").alias("lines"))


def court_deadlines(spark, folder):
    """Two months from every claim's start, moved off closed days."""
    t = Records(spark, folder)
    claims = calendar.calendar_name(t["claims"], "court", _published(t)).withColumn("n", F.lit(2))
    span = _calendar(t, claims, "start_date", F.add_months("start_date", 2))
    rows = calendar.deadlines(claims, "start_date", "n", "months", span)
    return rows.select("claim_id", *_iso("deadline", "moved_from"), "closure_reason", "day_of_week")


def closures_by_year(spark, folder):
    """Closures of each court and year that claims fall in."""
    t = Records(spark, folder)
    years = t["claims"].select("court", F.year("start_date").alias("year")).distinct()
    return calendar.known_closures(years, _published(t)).select("court", "year", *_iso("day"), "occasion")


def calendar_cover(spark, folder):
    """Whether each claim's court and year have a published calendar."""
    t = Records(spark, folder)
    rows = calendar.calendar_confidence(t["claims"], "court", "start_date", _published(t))
    return rows.groupBy("calendar_installed", "year_covered", "basis").agg(F.count("*").alias("claims"))


def holiday_documents(spark, folder):
    """Holidays read from calendar documents."""
    rows = published_holidays(Records(spark, folder)["calendar_documents"], "body")
    return rows.select("court", *_iso("day"), "occasion")


def _acts(t):
    return well_formed(
        t["act_documents"].select(F.from_json("body", schemas.ACT).alias("a"), "p_partkey").select("a.*", "p_partkey")
    )


def act_documents(spark, folder):
    """Acts read from nested documents, malformed ones left out."""
    return acts_table(_acts(Records(spark, folder))).select("slug", "title", "short_title", "coverage", "source", "url")


def act_sections(spark, folder):
    """Sections read from nested documents; of equal numbers the last stays."""
    return sections_table(_acts(Records(spark, folder))).select("slug", "act_title", "number", "heading", "text", "text_kind")


def act_names(spark, folder):
    """Names the Acts answer to; a name claimed twice belongs to the later Act."""
    names = alias_table(_acts(Records(spark, folder)), F.col("p_partkey"))
    return names.select("alias", "slug", F.col("ordinal.place").alias("place"), F.col("ordinal.i").alias("i"))


def act_coverage(spark, folder):
    """Acts and sections held."""
    t = Records(spark, folder)
    return statutes.coverage(t["acts"], t["sections"])


def act_titles(spark, folder):
    """Titles of the complete and of the partial Acts, each list in order."""
    return statutes.coverage_titles(Records(spark, folder)["acts"])


def acts_by_title(spark, folder):
    """Acts with the number of sections held of each."""
    t = Records(spark, folder)
    rows = statutes.acts_by_title(t["acts"], t["sections"])
    return rows.select("slug", "title", "coverage", "section_count")


def acts_written(spark, folder):
    """Sections of Acts that were put together from upstream entries, written as JSON and read again."""
    t = Records(spark, folder)
    entries = t["sections"].select(
        "slug", F.col("number").cast("int").alias("ordinal"),
        F.when(F.col("number") % 2 == 0, F.concat(F.lit(" "), "number")).alias("section"), F.when(F.col("number") % 2 == 1, F.col("number")).alias("Section_"),
        F.col("heading").alias("section_title"), F.col("text").alias("section_desc"),
        F.when(F.col("number") % 3 == 0, "").otherwise(F.concat(F.lit("C"), "number")).alias("chapter_title"), F.lit("I").alias("chapter"),
    )
    rows = upstream_rows(entries, F.coalesce("section", "Section_"), ["slug", "ordinal"])
    path = f"{shared_folder(spark).rstrip('/')}/acts-{uuid.uuid4().hex}"
    write_acts(normalised_act(rows, t["acts"].select("slug", "title")), path)
    read = sections_table(read_acts(spark, path, lines=True))
    return read.select("slug", "act_title", "number", "heading", "text", "chapter", "text_kind")


def section_search(spark, folder):
    """Best sections for a query."""
    t = Records(spark, folder)
    rows = statutes.search_sections(t["sections"], "red widget economy goods", 60)
    return rows.select("slug", "number", "heading", "score")


def section_cards(spark, folder):
    """Sections as shown to a reader."""
    return statutes.section_cards(sections_table(_acts(Records(spark, folder)))).select(
        "slug", "number", "excerpt", "text_kind", F.col("caveat").isNotNull().alias("has_caveat")
    )


def concordance_map(spark, folder):
    """Counterparts of every section asked for, in both directions."""
    rows = statutes.map_sections(Records(spark, folder)["asked_sections"], "section")
    return rows.groupBy("section", "direction", "domain", "old_section", "new_section", "subject").agg(
        F.count("*").alias("asked")
    )


def concordance_totals(spark, folder):
    """Matches per domain and in total."""
    return statutes.concordance_coverage(
        statutes.map_sections(Records(spark, folder)["asked_sections"], "section", "old_to_new")
    )


def governing_regime(spark, folder):
    """Codes that govern offences, by date."""
    dated = Records(spark, folder).sql("SELECT CAST(o_orderdate AS DATE) + 9862 AS offence_date FROM {orders}")
    rows = dated.select(F.date_format("offence_date", "yyyy-MM").alias("month"), statutes.governing_regime(F.col("offence_date")).alias("r"))
    return rows.groupBy("month", "r.regime", "r.penal_code").agg(F.count("*").alias("offences"))


def rule_suggestions(spark, folder):
    """Limitation rules suggested for every claim text."""
    t = Records(spark, folder)
    best = wide(t["claim_texts"]).select("claim_id", F.posexplode(statutes.best_rules(F.col("text"), LIMITATION_RULES, 8)).alias("i", "b"))
    return best.select("claim_id", (F.col("i") + 1).alias("place"), "b.score", "b.key")


def subject_suggestions(spark, folder):
    """Concordance pairs suggested for every claim text."""
    t = Records(spark, folder)
    pairs = list(concordance.all_pairs())
    best = wide(t["claim_texts"]).select("claim_id", F.posexplode(statutes.best_subjects(F.col("text"), pairs, 10)).alias("i", "b"))
    return best.select("claim_id", (F.col("i") + 1).alias("place"), "b.score", "b.key")


QUERIES = {
    f.__name__: f
    for f in (
        limitation_positions, limitation_by_rule, rules_in_use, cheque_timelines, next_open_days,
        working_days_added, working_days_between, court_deadlines, closures_by_year, calendar_cover,
        holiday_documents, act_documents, act_sections, act_names, act_coverage, act_titles, acts_by_title,
        acts_written, section_search,
        section_cards, concordance_map, concordance_totals, governing_regime, rule_suggestions,
        subject_suggestions,
    )
}

# --- the same answers in SQL -----------------------------------------------------------


def _q(text):
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


_RULES = ", ".join(
    f"({_q(k)}, {_q(c)}, {v}, {_q(u)}, {_q(s)}, {_q(a)}, {_q(act)})" for k, c, v, u, s, a, act, _ in LIMITATION_RULES
)
_PAIRS = ", ".join(f"({_q(d)}, {_q(o)}, {_q(n)}, {_q(s)})" for d, o, n, s, _ in concordance.all_pairs())
_FIXED = " ".join(
    f"WHEN month(day) = {m} AND dayofmonth(day) = {d} THEN {_q(o)}" for m, d, o in FIXED_NATIONAL_HOLIDAYS
)
_FIXED_ROWS = ", ".join(f"({m}, {d}, {_q(o)})" for m, d, o in FIXED_NATIONAL_HOLIDAYS)


def _plus(start, value, unit):
    return (
        f"CAST(CASE {unit} WHEN 'days' THEN {start} + to_days(CAST({value} AS INT)) WHEN 'months' THEN {start} + to_months(CAST({value} AS INT)) "
        f"ELSE {start} + to_years(CAST({value} AS INT)) END AS DATE)"
    )


EXTRA = {
    **RECORDS,
    "rules": f"SELECT * FROM (VALUES {_RULES}) AS r(rule_key, claim, v, u, start_text, authority, source_act)",
    "pairs": f"SELECT * FROM (VALUES {_PAIRS}) AS p(domain, old_section, new_section, subject)",
    "fixed": f"SELECT * FROM (VALUES {_FIXED_ROWS}) AS f(m, d, o)",
    "courts": "SELECT DISTINCT court FROM {notices} UNION ALL SELECT ''",
    "days": """
SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day
FROM (SELECT min(start_date) AS first, CAST(max(start_date) + INTERVAL 40 YEAR AS DATE) AS last FROM {claims})""",
    "calendar": f"""
SELECT c.court, d.day, CASE dayofweek(d.day) WHEN 0 THEN 'Sunday' WHEN 6 THEN 'Saturday' ELSE CASE {_FIXED.replace('(day)', '(d.day)')} ELSE n.occasion END END AS reason
FROM {{courts}} c CROSS JOIN {{days}} d LEFT JOIN {{notices}} n ON n.court = c.court AND CAST(n.day AS DATE) = d.day""",
    "opens": "SELECT court, day, row_number() OVER (PARTITION BY court ORDER BY day) AS n FROM {calendar} WHERE reason IS NULL",
    "claim_courts": "SELECT *, CASE WHEN court IN (SELECT court FROM {notices}) THEN court ELSE '' END AS cal FROM {claims}",
    "limits": f"""
SELECT *, CASE WHEN acknowledged <= first_expiry THEN {_plus('acknowledged + 1', 'v', 'u')} - 1 ELSE first_expiry END AS base_expiry, coalesce(acknowledged <= first_expiry, FALSE) AS restarted
FROM (SELECT c.*, r.v, r.u, r.source_act, {_plus('start_date + 1', 'v', 'u')} - 1 AS first_expiry FROM {{claim_courts}} c JOIN {{rules}} r USING (rule_key))""",
    "ends": "SELECT *, base_expiry + CAST(coalesce(copy_ready - copy_applied, 0) + wrong_forum_days AS INT) AS before_roll FROM {limits}",
    "rolled": """
SELECT e.*, CASE WHEN o.day IS NULL OR o.day > e.before_roll + 59 THEN e.before_roll + 60 ELSE o.day END AS expiry
FROM {ends} e ASOF LEFT JOIN {opens} o ON o.court = e.cal AND o.day >= e.before_roll""",
    "found_acts": """
SELECT p_partkey, json_extract_string(body, '$.slug') AS slug, json_extract_string(body, '$.title') AS title, json_extract_string(body, '$.short_title') AS short_title,
  coalesce(json_extract_string(body, '$.coverage'), 'partial') AS coverage, json_extract_string(body, '$.text_kind') AS text_kind, body
FROM {act_documents} WHERE p_partkey % 10 <> 0 AND p_partkey % 15 <> 0""",
    "found_sections": """
SELECT slug, act_title, number, heading, text, text_kind FROM (
  SELECT slug, title AS act_title, json_extract_string(s, '$.number') AS number, json_extract_string(s, '$.heading') AS heading,
    coalesce(json_extract_string(s, '$.text'), '') AS text, coalesce(text_kind, 'authentic') AS text_kind, i
  FROM (SELECT *, unnest(json_extract(body, '$.sections[*]')) AS s, generate_subscripts(json_extract(body, '$.sections[*]'), 1) AS i FROM {found_acts}))
QUALIFY row_number() OVER (PARTITION BY slug, replace(regexp_replace(lower(number), '^section ', ''), '-', '') ORDER BY i DESC) = 1""",
    "suggest_terms": "SELECT claim_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2)) AS w FROM {claim_texts}",
}

_KEY = "rtrim(replace(replace(lower(trim({})), ' ', ''), '-', ''), '.')"
_SQL = {
    "limitation_positions": f"""
SELECT claim_id, strftime(base_expiry, '%Y-%m-%d') AS base_expiry, strftime(expiry, '%Y-%m-%d') AS expiry, restarted,
  CAST(expiry - DATE '{AS_ON}' AS INT) AS days_remaining, DATE '{AS_ON}' > expiry AS expired,
  CASE WHEN DATE '{AS_ON}' > expiry THEN 'EXPIRED' WHEN expiry - DATE '{AS_ON}' <= 30 THEN 'CRITICAL' WHEN expiry - DATE '{AS_ON}' <= 90 THEN 'SOON' ELSE 'IN_TIME' END AS urgency,
  array_to_string(list_filter([CASE WHEN restarted THEN 'section 18' END, CASE WHEN copy_applied IS NOT NULL THEN 'section 12(2)' END,
    CASE WHEN wrong_forum_days > 0 THEN 'section 14' END, CASE WHEN expiry <> before_roll THEN 'section 4' END], lambda x: x IS NOT NULL), ',') AS exclusions,
  CAST(2 + CASE WHEN acknowledged IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN copy_ready > copy_applied THEN 1 ELSE 0 END
    + CASE WHEN wrong_forum_days > 0 THEN 1 ELSE 0 END + CASE WHEN expiry <> before_roll THEN 1 ELSE 0 END AS INT) AS reasons
FROM {{rolled}}""",
    "limitation_by_rule": f"""
SELECT rule_key, source_act, CASE WHEN DATE '{AS_ON}' > before_roll THEN 'EXPIRED' WHEN before_roll - DATE '{AS_ON}' <= 30 THEN 'CRITICAL'
  WHEN before_roll - DATE '{AS_ON}' <= 90 THEN 'SOON' ELSE 'IN_TIME' END AS urgency, count(*) AS claims FROM {{ends}} GROUP BY ALL""",
    "rules_in_use": """
SELECT source_act, count(*) AS rule_count, string_agg(rule_key, ',' ORDER BY rule_key) AS rule_keys
FROM {rules} WHERE rule_key IN (SELECT rule_key FROM {claims}) GROUP BY source_act""",
    "cheque_timelines": f"""
SELECT cheque_id, strftime(nd, '%Y-%m-%d') AS notice_deadline, strftime(pd, '%Y-%m-%d') AS payment_deadline, strftime(pd + 1, '%Y-%m-%d') AS cause_of_action_date,
  strftime(cd, '%Y-%m-%d') AS complaint_deadline, pd IS NOT NULL AS complete, step AS next_step, coalesce(CAST(due - DATE '{AS_ON}' AS INT), 99999) AS days_remaining,
  CASE WHEN late OR due < DATE '{AS_ON}' THEN 'MISSED' WHEN step = 0 THEN 'NONE' WHEN due - DATE '{AS_ON}' <= 7 THEN 'CRITICAL' WHEN due - DATE '{AS_ON}' <= 21 THEN 'SOON' ELSE 'IN_TIME' END AS urgency,
  CASE WHEN late THEN 'MISSED' WHEN notice_date IS NULL THEN 'pending' ELSE 'done' END AS first_status
FROM (SELECT *, CAST(pd + 1 + INTERVAL 1 MONTH AS DATE) - 1 AS cd, coalesce(notice_date > nd, FALSE) AS late,
    CASE WHEN notice_date IS NULL THEN 1 WHEN pd IS NOT NULL THEN 2 ELSE 0 END AS step, CASE WHEN notice_date IS NULL THEN nd ELSE pd END AS due
  FROM (SELECT *, dishonour_date + 30 AS nd, coalesce(served_date, notice_date) + 15 AS pd FROM {{cheques}}))""",
    "next_open_days": """
SELECT claim_id, strftime(CASE WHEN o.day IS NULL OR o.day > start_date + 59 THEN start_date + 60 ELSE o.day END, '%Y-%m-%d') AS open_day, coalesce(k.reason, '') AS reason
FROM {claim_courts} c ASOF LEFT JOIN {opens} o ON o.court = c.cal AND o.day >= c.start_date JOIN {calendar} k ON k.court = c.cal AND k.day = c.start_date""",
    "working_days_added": """
SELECT claim_id, CAST(claim_id % 25 AS INT) AS n, strftime(CASE WHEN claim_id % 25 = 0 THEN start_date
  ELSE least((SELECT min(o.day) FROM {opens} o WHERE o.court = c.cal AND o.n = coalesce(b.n, 0) + claim_id % 25), start_date + CAST(claim_id % 25 * 5 + 60 AS INT)) END, '%Y-%m-%d') AS due
FROM {claim_courts} c ASOF LEFT JOIN {opens} b ON b.court = c.cal AND b.day <= c.start_date""",
    "working_days_between": """
SELECT l_orderkey, CAST(sum(CASE WHEN b > a THEN coalesce(ob.n, 0) - coalesce(oa.n, 0) ELSE 0 END) AS BIGINT) AS working_days, count(*) AS lines
FROM (SELECT l_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b,
    CASE WHEN 'Court ' || CAST(o_custkey % 40 AS VARCHAR) IN (SELECT court FROM {notices}) THEN 'Court ' || CAST(o_custkey % 40 AS VARCHAR) ELSE '' END AS cal
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey) s
ASOF LEFT JOIN {opens} oa ON oa.court = s.cal AND oa.day <= s.a ASOF LEFT JOIN {opens} ob ON ob.court = s.cal AND ob.day <= s.b GROUP BY l_orderkey""",
    "court_deadlines": """
SELECT claim_id, strftime(d, '%Y-%m-%d') AS deadline, CASE WHEN d <> e THEN strftime(e, '%Y-%m-%d') END AS moved_from, CASE WHEN d <> e THEN reason END AS closure_reason, dayname(d) AS day_of_week
FROM (SELECT c.claim_id, c.e, k.reason, CASE WHEN o.day IS NULL OR o.day > c.e + 59 THEN c.e + 60 ELSE o.day END AS d
  FROM (SELECT *, CAST(start_date + INTERVAL 2 MONTH AS DATE) AS e FROM {claim_courts}) c ASOF LEFT JOIN {opens} o ON o.court = c.cal AND o.day >= c.e
  JOIN {calendar} k ON k.court = c.cal AND k.day = c.e)""",
    "closures_by_year": """
SELECT court, year, strftime(day, '%Y-%m-%d') AS day, occasion FROM (
  SELECT y.court, y.year, CAST(n.day AS DATE) AS day, n.occasion, 0 AS p FROM {years} y JOIN {notices} n ON n.court = y.court AND n.year = y.year
  UNION ALL SELECT court, year, make_date(CAST(year AS BIGINT), m, d), o, 1 FROM {years}, {fixed})
QUALIFY row_number() OVER (PARTITION BY court, day ORDER BY p) = 1""",
    "calendar_cover": """
SELECT calendar_installed, year_covered, CASE WHEN year_covered THEN 'weekends, fixed holidays and the court calendar' ELSE 'weekends and fixed holidays only' END AS basis, count(*) AS claims
FROM (SELECT court IN (SELECT court FROM {notices}) AS calendar_installed, EXISTS (SELECT 1 FROM {notices} n WHERE n.court = c.court AND n.year = year(c.start_date)) AS year_covered FROM {claims} c) GROUP BY ALL""",
    "holiday_documents": "SELECT court, day, occasion FROM {notices}",
    "act_documents": "SELECT slug, title, short_title, coverage, 'unknown' AS source, '' AS url FROM {found_acts}",
    "act_sections": "SELECT * FROM {found_sections}",
    "act_names": """
SELECT alias, arg_max(slug, (p_partkey, i)) AS slug, min(p_partkey) AS place, CAST(arg_min(i, (p_partkey, i)) AS INT) AS i FROM (
  SELECT slug, p_partkey, trim(regexp_replace(replace(replace(regexp_replace(lower(name), '^the\\s+', ''), '.', ''), ',', ''), '\\s+', ' ', 'g')) AS alias, i FROM (
    SELECT slug, p_partkey, short_title AS name, 0 AS i FROM {found_acts} UNION ALL SELECT slug, p_partkey, title, 1 FROM {found_acts}
    UNION ALL SELECT slug, p_partkey, replace(slug, '-', ' '), 2 FROM {found_acts} UNION ALL SELECT slug, p_partkey, json_extract_string(body, '$.aliases[0]'), 3 FROM {found_acts})) GROUP BY alias""",
    "act_coverage": """
SELECT (SELECT count(*) FROM {acts}) AS act_count, (SELECT count(*) FROM {sections}) AS section_count,
  (SELECT count(*) FROM {acts} WHERE coverage = 'full') AS complete_acts, (SELECT count(*) FROM {acts} WHERE coverage <> 'full') AS partial_acts""",
    "act_titles": """
SELECT held, row_number() OVER (PARTITION BY held ORDER BY title, slug) - 1 AS place, title
FROM (SELECT *, CASE WHEN coverage = 'full' THEN 'complete' ELSE 'partial' END AS held FROM {acts})""",
    "acts_by_title": "SELECT slug, title, coverage, (SELECT count(*) FROM {sections} s WHERE s.slug = a.slug) AS section_count FROM {acts} a",
    "acts_written": """
SELECT slug, act_title, number, trim(heading) AS heading, trim(text) AS text, CASE WHEN CAST(number AS INT) % 3 = 0 THEN 'I' ELSE 'C' || number END AS chapter,
  'authentic' AS text_kind FROM {sections}""",
    "section_search": """
SELECT slug, number, heading, CAST(score AS INT) AS score FROM (SELECT *, """
    + " + ".join(
        f"CASE WHEN contains(lower(heading), '{w}') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END"
        for w in ("red", "widget", "economy", "goods")
    )
    + " AS score FROM {sections}) WHERE score > 0 ORDER BY score DESC, act_title, number LIMIT 60",
    "section_cards": "SELECT slug, number, substring(text, 1, 400) AS excerpt, text_kind, text_kind <> 'authentic' AS has_caveat FROM {found_sections}",
    "concordance_map": f"""
SELECT section, direction, domain, old_section, new_section, subject, count(*) AS asked FROM (
  SELECT a.section, 'old_to_new' AS direction, p.* FROM {{asked_sections}} a JOIN {{pairs}} p ON {_KEY.format('a.section')} = {_KEY.format('p.old_section')}
  UNION ALL SELECT a.section, 'new_to_old', p.* FROM {{asked_sections}} a JOIN {{pairs}} p ON {_KEY.format('a.section')} IN ({_KEY.format('p.new_section')}, split_part({_KEY.format('p.new_section')}, '(', 1))) GROUP BY ALL""",
    "concordance_totals": f"""
SELECT coalesce(domain, 'total') AS domain, count(*) AS pairs FROM {{asked_sections}} a JOIN {{pairs}} p ON {_KEY.format('a.section')} = {_KEY.format('p.old_section')} GROUP BY ROLLUP (domain)""",
    "governing_regime": """
SELECT strftime(d, '%Y-%m') AS month, CASE WHEN d >= DATE '2024-07-01' THEN 'new' ELSE 'old' END AS regime,
  CASE WHEN d >= DATE '2024-07-01' THEN 'Bharatiya Nyaya Sanhita, 2023' ELSE 'Indian Penal Code, 1860' END AS penal_code, count(*) AS offences
FROM (SELECT CAST(o_orderdate AS DATE) + 9862 AS d FROM {orders}) GROUP BY ALL""",
    "rule_suggestions": """
SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, key) AS place, CAST(score AS INT) AS score, key FROM (
  SELECT claim_id, rule_key AS key, sum(CASE WHEN contains(lower(claim), w) THEN 2 WHEN contains(lower(rule_key || ' ' || claim || ' ' || start_text), w) THEN 1 ELSE 0 END) AS score
  FROM {suggest_terms}, {rules} GROUP BY ALL) WHERE score > 0 QUALIFY place <= 8""",
    "subject_suggestions": """
SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, key) AS place, CAST(score AS INT) AS score, key FROM (
  SELECT claim_id, old_section || ' ' || domain AS key, sum(CASE WHEN contains(lower(subject), w) THEN 1 ELSE 0 END) AS score
  FROM {suggest_terms}, {pairs} GROUP BY ALL) WHERE score > 0 QUALIFY place <= 10""",
}
EXTRA["years"] = "SELECT DISTINCT court, CAST(year(start_date) AS INT) AS year FROM {claims}"
ORACLE = {name: with_tables(sql, EXTRA) for name, sql in _SQL.items()}
