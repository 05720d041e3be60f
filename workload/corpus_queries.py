"""Case-law corpus: union, search, ranking, citations and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.functions.dates import iso_date
from lexloom.functions.text import party_terms
from lexloom.operators import citations, corpus, ranking, search, verification
from lexloom.operators.ordering import dense_number
from lexloom.operators.statutes import find_sections, resolve_acts
from lexloom.plans import research
from lexloom.rules.citation_forms import PARTY_STOP_WORDS
from lexloom.rules.courts import HC_ENDPOINT, HIGH_COURTS, SC_ENDPOINT
from lexloom.session import shared_folder
from workload.tables import Tables, wide, with_tables


class Filed(Tables):
    """Tables with whole documents that cite."""

    texts = {
        "filed_texts": """
SELECT d.doc_id, coalesce(d.text, '') || chr(10) || '* * *' || chr(10) || b.text AS text FROM {documents} d JOIN {brief_texts} b ON b.brief_id = d.doc_id"""
    }


def _corpus(spark, folder, scope=corpus.ALL_COURTS):
    return corpus.uniform_view(Tables(spark, folder).corpus_sources(), scope)


def corpus_union(spark, folder):
    """All four sources in the uniform columns."""
    return _corpus(spark, folder)


def corpus_hits(spark, folder):
    """Every row as a search hit."""
    return corpus.hits(_corpus(spark, folder))


def doc_id_parts(spark, folder):
    """Document ids taken apart again."""
    rows = _corpus(spark, folder).select(corpus.doc_id().alias("doc_id"))
    return rows.select("doc_id", corpus.parse_doc_id(F.col("doc_id")).alias("p")).select("doc_id", "p.*")


def metadata_by_id(spark, folder):
    """Metadata found again by document id."""
    rows = _corpus(spark, folder)
    ids = rows.select(corpus.doc_id().alias("doc_id"))
    return corpus.find_by_doc_id(rows, ids).select("doc_id", "title", "decision_date", "src")


def search_terms_page(spark, folder):
    """Third page of a two-term search, newest first."""
    page = search.search(_corpus(spark, folder), "bail state", 25, 2)
    return page.select(corpus.doc_id().alias("doc_id"), "title", "decision_date")


def search_filtered(spark, folder):
    """Supreme Court rows by term, judge and date bounds."""
    rows = search.matching(
        _corpus(spark, folder, "SC"), "state", judge="Rao", from_date="1996-03-01", to_date="2016-06-30"
    )
    return rows.select(corpus.doc_id().alias("doc_id"), "judge", "decision_date")


def search_wildcards(spark, folder):
    """Matches with SQL wildcards allowed in a term."""
    rows = search.matching(_corpus(spark, folder), "b_il%priority", wildcards=True)
    return rows.select(corpus.doc_id().alias("doc_id"))


def search_next_page(spark, folder):
    """The page after a given hit."""
    rows = search.search_after(_corpus(spark, folder), "land", 40, ("1999-06-30", "sc:"))
    return rows.select(corpus.doc_id().alias("doc_id"), "decision_date")


def search_total(spark, folder):
    """Number of matches of a search."""
    return search.count_matches(_corpus(spark, folder), "land bail")


def years_per_court(spark, folder):
    """Years held per court."""
    years = corpus.years_per_court(_corpus(spark, folder))
    return years.select("court_code", F.array_join("years", ",").alias("years"))


def courts_present(spark, folder):
    """Courts that have rows."""
    return corpus.courts_present(_corpus(spark, folder))


BM25_QUERY = "the que license released"


def bm25_scan(spark, folder):
    """Best documents for a query, scored in one pass."""
    ranked = ranking.rank_query(wide(Tables(spark, folder)["documents"]), BM25_QUERY, ["text"])
    top = ranked.select("doc_id", F.round("score", 6).alias("score"))
    return top.orderBy(F.desc("score"), "doc_id").limit(100)


def bm25_postings(spark, folder):
    """Score of every document with a query term, from postings."""
    index = ranking.build_index(wide(Tables(spark, folder)["documents"]), "doc_id", ["text"])
    scored = ranking.rank_index(index, BM25_QUERY)
    return scored.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def term_frequencies(spark, folder):
    """Documents per term of the whole collection."""
    index = ranking.build_index(wide(Tables(spark, folder)["documents"]), "doc_id", ["text"])
    return index.terms.select("term", "df")


def ranked_search(spark, folder):
    """A page of ranked search over the corpus."""
    page = research.ranked_search(_corpus(spark, folder), "bail LandBC priority", 50)
    return page.select(corpus.doc_id().alias("doc_id"), F.round("score", 6).alias("score"))


def _stored_index(spark, folder):
    """An index of the corpus, written to the shared folder and read back."""
    keyed = _corpus(spark, folder).withColumn("id", corpus.doc_id())
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    ranking.write_index(ranking.build_index(keyed, "id", research.TEXT, buckets=8), path, shares=2)
    return ranking.read_index(spark, path)


def indexed_search(spark, folder):
    """The page of ``ranked_search``, scored from the stored index."""
    rows = _corpus(spark, folder)
    page = research.indexed_search(rows, _stored_index(spark, folder), "bail LandBC priority", 50)
    return page.select(corpus.doc_id().alias("doc_id"), F.round("score", 6).alias("score"))


def index_staleness(spark, folder):
    """Whether the tables are newer than the index made from them."""
    source = spark.read.parquet(f"{folder.rstrip('/')}/orders.parquet")
    return ranking.index_is_stale(source, _stored_index(spark, folder).stats)


def research_memo(spark, folder):
    """Authorities of several searches, each once."""
    queries = ["bail building", "tax landab", "service notice", "bail"]
    rows = research.research_memo(_corpus(spark, folder), queries, 25, 10)
    return rows.select("query_no", "doc_id", "title", F.date_format("decided", "yyyy-MM-dd").alias("decided"))


def memo_status(spark, folder):
    """Matches per query of a memo."""
    return research.memo_status(_corpus(spark, folder), ["bail building", "tax landab", "no such words"])


def related_proceedings(spark, folder):
    """Newest ten proceedings that share the parties of each judgment."""
    return research.related_in_corpus(_corpus(spark, folder), 10)


def numbered_corpus(spark, folder):
    """The corpus with consecutive ids, as a ranked table stores it."""
    rows = _corpus(spark, folder).select(corpus.doc_id().alias("doc_id"), "title", "description", "judge")
    return dense_number(rows, ["doc_id"], "id").select("id", "doc_id", "title")


def party_words(spark, folder):
    """Party words of every title."""
    rows = _corpus(spark, folder)
    return rows.select(
        corpus.doc_id().alias("doc_id"), F.array_join(party_terms(F.col("title")), " ").alias("terms")
    )


# --- citations -------------------------------------------------------------------


def _found(tables, families=citations.CASES + citations.STATUTES):
    return citations.extract(wide(tables["brief_texts"]), "brief_id", "text", families)


def citation_extract(spark, folder):
    """Citations of every brief."""
    return _found(Tables(spark, folder)).select(
        "brief_id", "kind", "family", "position", "raw", "normalized", "citation_key",
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "reporter", "volume", "page",
        "case_name", "section", "statute",
    )


def citation_single(spark, folder):
    """The longest citation of every brief."""
    tables = Tables(spark, folder)
    return citations.parse_single(tables["brief_texts"], "brief_id", "text").select(
        "brief_id", "family", "normalized"
    )


def citation_lookup(spark, folder):
    """Judgments per cited key."""
    tables = Tables(spark, folder)
    cases = _found(tables, citations.CASES)
    rows = verification.exact_matches(cases, corpus.uniform_view(tables.corpus_sources()))
    return rows.select("citation_key", "exact", "match")


def citation_verdicts(spark, folder):
    """Verdict on every distinct case citation."""
    tables = Tables(spark, folder)
    return verification.verify_cases(_found(tables, citations.CASES), corpus.uniform_view(tables.corpus_sources()))


def statute_verdicts(spark, folder):
    """Verdict on every distinct statutory citation."""
    t = Tables(spark, folder)
    rows = verification.verify_statutes(_found(t, citations.STATUTES), t["acts"], t["sections"], t["aliases"])
    return rows.select("statute", "section", "slug", "verdict", "match")


def _sweep(t, budget=1, texts="brief_texts", key="brief_id"):
    return research.verify_texts(
        wide(t[texts]), key, "text", corpus.uniform_view(t.corpus_sources()),
        t["acts"], t["sections"], t["aliases"], budget=budget,
    )


def citation_sweep(spark, folder):
    """Verdict on every citation of every brief, one case check per brief."""
    return _sweep(Tables(spark, folder)).select("brief_id", "kind", "position", "normalized", "verdict", "confidence")


def citation_sweep_whole(spark, folder):
    """Verdict on every citation of every brief; the budget covers all of them."""
    return _sweep(Tables(spark, folder), 20).select("brief_id", "kind", "position", "normalized", "verdict", "confidence")


def document_sweep(spark, folder):
    """Verdict on every citation of whole documents, each with a citing passage after its own text."""
    rows = _sweep(Filed(spark, folder), 20, "filed_texts", "doc_id")
    return rows.select("doc_id", "kind", "position", "normalized", "verdict", "confidence")


def verification_summary(spark, folder):
    """Verdicts summed up per kind of citation and brief form, every citation checked."""
    rows = _sweep(Tables(spark, folder), None).withColumn("form", F.col("brief_id") % 4)
    return verification.summarise(rows, ["kind", "form"])


def verification_total(spark, folder):
    """Verdicts summed up over everything, every citation checked; briefs of an unknown form give the empty case."""
    rows = _sweep(Tables(spark, folder), None)
    empty = verification.summarise(rows.where("kind = 'none'")).withColumn("part", F.lit("empty"))
    return verification.summarise(rows).withColumn("part", F.lit("all")).unionByName(empty)


def act_resolution(spark, folder):
    """Act meant by each cited statute name."""
    t = Tables(spark, folder)
    names = t["briefs"].select((F.concat("act", F.lit(", 1881"))).alias("name"))
    return resolve_acts(names, t["aliases"])


def section_lookup(spark, folder):
    """Sections asked for by the briefs."""
    t = Tables(spark, folder)
    asked = t["briefs"].select(
        "brief_id", F.concat("act", F.lit(", 1881")).alias("statute"),
        F.concat(F.lit("Section "), "sec", F.lit("(1)")).alias("section"),
    )
    return find_sections(asked, t["sections"], t["aliases"]).select(
        "brief_id", "slug", "outcome", "number", "heading"
    )


QUERIES = {
    f.__name__: f
    for f in (
        corpus_union, corpus_hits, doc_id_parts, metadata_by_id, search_terms_page, search_filtered,
        search_wildcards, search_next_page, search_total, years_per_court, courts_present, bm25_scan,
        bm25_postings, term_frequencies, ranked_search, indexed_search, index_staleness, research_memo, memo_status, related_proceedings,
        numbered_corpus, party_words, citation_extract, citation_single, citation_lookup, citation_verdicts,
        statute_verdicts, citation_sweep, citation_sweep_whole, document_sweep, verification_summary, verification_total, act_resolution,
        section_lookup,
    )
}

# --- the same answers in SQL ---------------------------------------------------------

_HC_LABEL = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in HIGH_COURTS.items())
_STOP = ", ".join(f"'{w}'" for w in PARTY_STOP_WORDS)
_COLUMNS = ", ".join(corpus.COLUMNS)

EXTRA = {
    "corpus": """
SELECT 'SC' AS court_code, year, CAST(NULL AS VARCHAR) AS bench, title, coalesce(description, '') AS description,
  coalesce(judge, '') AS judge, citation, nc_display AS neutral_citation, cnr, disposal_nature,
  coalesce(strftime(try_strptime(decision_date, '%d-%m-%Y'), '%Y-%m-%d'), decision_date) AS decision_date,
  path AS locator, 'od' AS src, CAST(NULL AS VARCHAR) AS source_url FROM {sc_raw}
UNION ALL SELECT court, year, bench, title, coalesce(description, ''), coalesce(judge, ''), NULL, NULL, cnr,
  disposal_nature, decision_date, pdf_link, 'od', NULL FROM {hc_raw}
UNION ALL SELECT court, CAST(year AS VARCHAR), bench, title, coalesce(description, ''), coalesce(judge, ''),
  coalesce(citation, ''), NULL, NULL, NULL, decision_date, pdf_link, 'hist', source_url FROM {historical_raw}
UNION ALL SELECT court, CAST(year AS VARCHAR), bench, title, coalesce(description, ''), coalesce(judge, ''),
  coalesce(citation, ''), NULL, NULL, NULL, decision_date, pdf_link, 'recent', source_url FROM {recent_raw}""",
    "named": """
SELECT *, regexp_extract(locator, '[^/]*$') AS name,
  CASE WHEN regexp_full_match(decision_date, '\\d\\d\\d\\d-\\d+-\\d+') THEN TRY_CAST(decision_date AS DATE) END AS decided,
  CASE WHEN src = 'hist' THEN 'hist:' || court_code || ':' || bench || ':' || year || ':' || regexp_extract(locator, '[^/]*$')
    WHEN src = 'recent' THEN 'rc:' || court_code || ':' || bench || ':' || year || ':' || regexp_extract(locator, '[^/]*$')
    WHEN court_code = 'SC' THEN 'sc:' || year || ':' || locator
    ELSE 'hc:' || court_code || ':' || bench || ':' || year || ':' || regexp_extract(locator, '[^/]*$') END AS doc_id
FROM {corpus}""",
    "titled": """
SELECT *, list_slice(flatten(list_transform(
    list_slice(regexp_split_to_array(regexp_replace(title, '^[A-Z]+/\\d+/\\d+\\s+of\\s+', ''), '(?i)\\s+(?:versus|vs\\.?|v\\.?)\\s+'), 1, 2),
    lambda s: list_slice(list_filter(regexp_extract_all(s, '[A-Za-z]{4,}'), lambda w: lower(w) NOT IN (STOP_WORDS)), 1, 2)
  )), 1, 3) AS terms FROM {named}""".replace("STOP_WORDS", _STOP),
    "doc_tokens": """
SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM {documents}""",
    "doc_stats": "SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM {doc_tokens}",
    "doc_tf": "SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(t) AS term, len(t) AS l FROM {doc_tokens}) GROUP BY doc_id, term",
    "doc_df": "SELECT term, count(*) AS df FROM {doc_tf} GROUP BY term",
    "bm25": """
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
FROM {doc_tf} JOIN {doc_df} USING (term), {doc_stats} WHERE term IN ('the', 'que', 'license', 'released') GROUP BY doc_id""",
    "corpus_tokens": """
SELECT doc_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, description, judge)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM {named}""",
    "corpus_tf": "SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(t) AS term, len(t) AS l FROM {corpus_tokens}) GROUP BY doc_id, term",
    "corpus_scores": """
SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score
FROM {corpus_tf} JOIN (SELECT term, count(*) AS df FROM {corpus_tf} GROUP BY term) USING (term),
  (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean FROM {corpus_tokens})
WHERE term IN ('bail', 'landbc', 'priority') GROUP BY doc_id""",
    # What each brief is known to cite, from how its text is put together.
    "cited": """
SELECT brief_id, parties, text, 1 AS slot, 'case' AS kind, CASE form WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 1 END AS family,
  CASE form WHEN 0 THEN '(' || y || ') ' || v || ' SCC ' || p WHEN 1 THEN '[' || y || '] ' || v || ' S.C.R. ' || p
    WHEN 2 THEN y || ' (' || v || ') ALL MR ' || p ELSE 'AIR ' || y || ' SC ' || p END AS raw,
  CASE form WHEN 0 THEN '(' || y || ') ' || v || ' SCC ' || p WHEN 1 THEN '(' || y || ') ' || v || ' SCR ' || p
    WHEN 2 THEN y || ' (' || v || ') ALL MR ' || p ELSE 'AIR ' || y || ' SC ' || p END AS normalized,
  y AS year, CASE form WHEN 0 THEN 'SCC' WHEN 1 THEN 'SCR' WHEN 2 THEN 'ALL MR' ELSE 'AIR' END AS reporter,
  CASE WHEN form < 3 THEN v END AS volume, p AS page, parties AS case_name, NULL AS section, NULL AS statute
FROM {briefs} JOIN {brief_texts} USING (brief_id)
UNION ALL SELECT brief_id, parties, text, 2, 'case', 6, y || 'INSC' || num, y || 'INSC' || num, y, 'INSC (neutral)', NULL, num, NULL, NULL, NULL
FROM {briefs} JOIN {brief_texts} USING (brief_id) WHERE y >= '2000'
UNION ALL SELECT brief_id, parties, text, 3, 'statute', 7, 'Section ' || sec || ' of the ' || act || ', 1881', 'Section ' || sec || ', ' || act || ', 1881',
  '', NULL, NULL, NULL, NULL, sec, act || ', 1881' FROM {briefs} JOIN {brief_texts} USING (brief_id)
UNION ALL SELECT brief_id, parties, text, 4, 'statute', 8, 'Order VII Rule ' || v || ' CPC', 'Order VII Rule ' || v || ', Code of Civil Procedure, 1908',
  '', NULL, NULL, NULL, NULL, 'Order VII Rule ' || v, 'Code of Civil Procedure, 1908' FROM {briefs} JOIN {brief_texts} USING (brief_id)
UNION ALL SELECT brief_id, parties, text, 5, 'constitution', 9, 'Article ' || art, 'Article ' || art || ', Constitution of India',
  '', NULL, NULL, NULL, NULL, art, 'Constitution of India' FROM {briefs} JOIN {brief_texts} USING (brief_id)""",
    "found": """
SELECT brief_id, kind, family, CAST(strpos(text, raw) - 1 AS INT) AS position, raw, normalized,
  CASE WHEN kind = 'case' THEN regexp_replace(lower(normalized), '[\\s.\\[\\]()]+', '', 'g') ELSE lower(normalized) END AS citation_key,
  year, reporter, volume, page, case_name, section, statute FROM {cited}""",
    "corpus_keys": """
SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, regexp_replace(lower(coalesce(citation, '')), '[\\s.\\[\\]()]+', '', 'g') AS k FROM {named}
  UNION ALL SELECT doc_id, regexp_replace(lower(coalesce(neutral_citation, '')), '[\\s.\\[\\]()]+', '', 'g') FROM {named}) WHERE k <> ''""",
    "exact": """
SELECT citation_key, count(doc_id) AS exact, min(doc_id) AS match
FROM (SELECT DISTINCT citation_key FROM {found} WHERE kind = 'case') LEFT JOIN {corpus_keys} ON k = citation_key GROUP BY citation_key""",
    "asked_cases": "SELECT DISTINCT citation_key, normalized, case_name FROM {found} WHERE kind = 'case'",
    # Every open name against every judgment, by plain containment.
    "candidates": """
SELECT case_name, doc_id, lower(coalesce(title, '')) AS title, lower(coalesce(citation, '')) AS citation, lower(coalesce(neutral_citation, '')) AS neutral
FROM (SELECT DISTINCT case_name, lower(split_part(case_name, ' ', 1)) AS t1, lower(split_part(case_name, ' ', 2)) AS t2,
    lower(regexp_extract(case_name, 'LAND[A-J]+')) AS t3
  FROM {asked_cases} JOIN {exact} USING (citation_key) WHERE exact = 0 AND case_name IS NOT NULL)
JOIN {named} ON contains(lower(title || chr(10) || description), t1) AND contains(lower(title || chr(10) || description), t2)
  AND contains(lower(title || chr(10) || description), t3)""",
    "weighed": """
SELECT a.citation_key, a.normalized, a.case_name, count(*) AS found,
  count(*) FILTER (contains(c.title, lower(a.normalized)) OR contains(c.citation, lower(a.normalized)) OR contains(c.neutral, lower(a.normalized))) AS strong,
  min(c.doc_id) FILTER (contains(c.title, lower(a.normalized)) OR contains(c.citation, lower(a.normalized)) OR contains(c.neutral, lower(a.normalized))) AS hit
FROM {asked_cases} a JOIN {exact} e ON e.citation_key = a.citation_key AND e.exact = 0 JOIN {candidates} c ON c.case_name = a.case_name
GROUP BY a.citation_key, a.normalized, a.case_name""",
    "case_verdicts": """
SELECT a.citation_key, a.normalized, a.case_name,
  CASE WHEN e.exact = 1 THEN 'VERIFIED' WHEN e.exact > 1 THEN 'AMBIGUOUS' WHEN coalesce(w.found, 0) = 0 THEN 'NOT_FOUND'
    WHEN w.strong = 1 THEN 'VERIFIED' ELSE 'AMBIGUOUS' END AS verdict,
  CASE WHEN e.exact > 0 THEN 'citation' ELSE 'party names' END AS basis,
  CASE WHEN e.exact = 1 THEN e.match WHEN e.exact = 0 AND w.strong = 1 THEN w.hit END AS match
FROM {asked_cases} a JOIN {exact} e USING (citation_key) LEFT JOIN {weighed} w
  ON w.citation_key = a.citation_key AND w.normalized = a.normalized AND w.case_name IS NOT DISTINCT FROM a.case_name""",
    "asked_statutes": "SELECT DISTINCT statute, section FROM {found} WHERE kind <> 'case'",
    "statute_names": "SELECT DISTINCT statute AS name FROM {asked_statutes} UNION SELECT act || ', 1881' FROM {briefs}",
    # Every name against every alias, stage by stage.
    "resolved": """
SELECT name, slug, stage FROM (
  SELECT name, slug, ordinal, CASE WHEN k = alias THEN 0
      WHEN (contains(alias, k) OR contains(k, alias)) AND abs(length(k) - length(alias)) < 25 THEN 1
      WHEN 100 * (1 - levenshtein(k, alias) / greatest(length(k), length(alias))) >= 88 THEN 2 END AS stage,
    CASE WHEN k = alias OR ((contains(alias, k) OR contains(k, alias)) AND abs(length(k) - length(alias)) < 25) THEN 0.0
      ELSE round(100 - 100 * (1 - levenshtein(k, alias) / greatest(length(k), length(alias))), 9) END AS loss
  FROM (SELECT name, trim(regexp_replace(replace(replace(regexp_replace(lower(name), '^the\\s+', ''), '.', ''), ',', ''), '\\s+', ' ', 'g')) AS k FROM {statute_names}), {aliases})
WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY stage, loss, ordinal) = 1""",
    "statute_results": """
SELECT q.statute, q.section, r.slug,
  CASE WHEN r.slug IS NULL THEN 'UNCHECKED' WHEN s.number IS NOT NULL THEN 'VERIFIED'
    WHEN q.section LIKE 'Order %' OR a.coverage <> 'full' THEN 'UNCHECKED' ELSE 'NOT_FOUND' END AS verdict, s.number AS match
FROM {asked_statutes} q LEFT JOIN {resolved} r ON r.name = q.statute LEFT JOIN {acts} a ON a.slug = r.slug
LEFT JOIN {sections} s ON s.slug = r.slug AND s.number = q.section""",
    "swept": """
SELECT f.brief_id, f.kind, f.position, f.normalized,
  CASE WHEN f.kind <> 'case' THEN s.verdict WHEN f.case_no > 1 THEN 'UNCHECKED' ELSE v.verdict END AS verdict
FROM (SELECT *, count(*) FILTER (kind = 'case') OVER (PARTITION BY brief_id ORDER BY position) AS case_no FROM {found}) f
LEFT JOIN {case_verdicts} v ON f.kind = 'case' AND v.citation_key = f.citation_key AND v.normalized = f.normalized AND v.case_name IS NOT DISTINCT FROM f.case_name
LEFT JOIN {statute_results} s ON f.kind <> 'case' AND s.statute = f.statute AND s.section = f.section""",
    # The same with every case citation checked.
    "swept_whole": """
SELECT f.brief_id, f.kind, f.position, f.normalized, CASE WHEN f.kind <> 'case' THEN s.verdict ELSE v.verdict END AS verdict
FROM {found} f
LEFT JOIN {case_verdicts} v ON f.kind = 'case' AND v.citation_key = f.citation_key AND v.normalized = f.normalized AND v.case_name IS NOT DISTINCT FROM f.case_name
LEFT JOIN {statute_results} s ON f.kind <> 'case' AND s.statute = f.statute AND s.section = f.section""",
    "scored_whole": """
SELECT *, CASE verdict WHEN 'VERIFIED' THEN 1.0 WHEN 'NOT_FOUND' THEN 0.2 WHEN 'AMBIGUOUS' THEN 0.5 ELSE 0.0 END AS confidence FROM {swept_whole}""",
    "scored": """
SELECT *, CASE verdict WHEN 'VERIFIED' THEN 1.0 WHEN 'NOT_FOUND' THEN 0.2 WHEN 'AMBIGUOUS' THEN 0.5 ELSE 0.0 END AS confidence FROM {swept}""",
}
_MEMO = """
SELECT {n} AS query_no, doc_id, title, decided FROM {{named}} WHERE {where}
QUALIFY row_number() OVER (ORDER BY decided DESC NULLS LAST, doc_id) <= 10"""


def has_terms(*terms):
    return " AND ".join(
        f"(contains(lower(title), '{t}') OR contains(lower(description), '{t}'))" for t in terms
    )


_MEMO_ALL = " UNION ALL ".join(
    _MEMO.format(n=i, where=has_terms(*q.split())).replace("{{", "{").replace("}}", "}")
    for i, q in enumerate(["bail building", "tax landab", "service notice", "bail"])
)
_SUMMARY = """count(*) AS total, count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict = 'NOT_FOUND') AS not_found,
  count(*) FILTER (verdict = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (verdict = 'UNCHECKED') AS unchecked,
  CAST(coalesce(round_even(CAST(sum(CAST(confidence * 10 AS INT)) AS DOUBLE) / 10 / count(*), 3), 1.0) AS DOUBLE) AS avg_confidence,
  count(*) FILTER (verdict = 'VERIFIED') = count(*) AS all_verified"""

_SQL = {
    "corpus_union": f"SELECT {_COLUMNS} FROM {{corpus}}",
    "corpus_hits": f"""
SELECT doc_id, trim(title) AS title, CASE court_code WHEN 'SC' THEN 'Supreme Court of India' {_HC_LABEL} ELSE court_code END AS court,
  nullif(substring(decision_date, 1, 10), '') AS date, substring(trim(description), 1, 400) AS snippet,
  CASE WHEN src = 'hist' THEN coalesce(nullif(source_url, ''), '/historical/' || bench || '/pdfs')
    WHEN src = 'recent' THEN coalesce(nullif(source_url, ''), '/recent/' || court_code || '/pdfs')
    WHEN court_code = 'SC' THEN '{SC_ENDPOINT}/data/pdf/year=' || year || '/english/' || locator || '_EN.pdf'
    ELSE '{HC_ENDPOINT}/data/pdf/year=' || year || '/court=' || court_code || '/bench=' || bench || '/' || name END AS url,
  citation, neutral_citation, nullif(trim(judge), '') AS judge, disposal_nature AS disposal, cnr FROM {{named}}""",
    "doc_id_parts": """
SELECT doc_id, CASE src WHEN 'hist' THEN 'hist' WHEN 'recent' THEN 'rc' ELSE CASE court_code WHEN 'SC' THEN 'sc' ELSE 'hc' END END AS source,
  court_code, coalesce(bench, '') AS bench, year, CASE WHEN src = 'od' AND court_code = 'SC' THEN locator ELSE name END AS locator FROM {named}""",
    "metadata_by_id": "SELECT doc_id, title, decision_date, src FROM {named}",
    "search_terms_page": f"""
SELECT doc_id, title, decision_date FROM {{named}} WHERE {has_terms('bail', 'state')}
ORDER BY decided DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50""",
    "search_filtered": f"""
SELECT doc_id, judge, decision_date FROM {{named}} WHERE court_code = 'SC' AND {has_terms('state')} AND contains(lower(judge), 'rao')
  AND decided BETWEEN DATE '1996-03-01' AND DATE '2016-06-30'""",
    "search_wildcards": "SELECT doc_id FROM {named} WHERE lower(title) LIKE '%b_il%priority%' OR lower(description) LIKE '%b_il%priority%'",
    "search_next_page": f"""
SELECT doc_id, decision_date FROM {{named}} WHERE {has_terms('land')}
  AND (decided IS NULL OR decided < DATE '1999-06-30' OR (decided = DATE '1999-06-30' AND doc_id > 'sc:'))
ORDER BY decided DESC NULLS LAST, doc_id LIMIT 40""",
    "search_total": f"SELECT count(*) AS total_found FROM {{named}} WHERE {has_terms('land', 'bail')}",
    "years_per_court": "SELECT court_code, string_agg(DISTINCT year, ',' ORDER BY year) AS years FROM {corpus} GROUP BY court_code",
    "courts_present": "SELECT DISTINCT court_code FROM {corpus}",
    "bm25_scan": "SELECT doc_id, score FROM {bm25} ORDER BY score DESC, doc_id LIMIT 100",
    "bm25_postings": "SELECT doc_id, score FROM {bm25}",
    "term_frequencies": "SELECT term, df FROM {doc_df}",
    "ranked_search": f"""
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM {{named}} LEFT JOIN {{corpus_scores}} USING (doc_id) WHERE {has_terms('bail', 'landbc', 'priority')}
ORDER BY score DESC, decided DESC NULLS LAST, doc_id LIMIT 50""",
    "indexed_search": f"""
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM {{named}} LEFT JOIN {{corpus_scores}} USING (doc_id) WHERE {has_terms('bail', 'landbc', 'priority')}
ORDER BY score DESC, decided DESC NULLS LAST, doc_id LIMIT 50""",
    "index_staleness": "SELECT FALSE AS stale",
    "research_memo": f"""
SELECT query_no, doc_id, title, strftime(decided, '%Y-%m-%d') AS decided FROM (
  SELECT * FROM ({_MEMO_ALL}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_no) = 1)
ORDER BY query_no, decided DESC NULLS LAST, doc_id LIMIT 25""",
    "memo_status": " UNION ALL ".join(
        f"SELECT {i} AS query_no, '{q}' AS query, count(*) AS matches, CASE WHEN count(*) > 0 THEN 'success' ELSE 'not_found' END AS status "
        f"FROM {{named}} WHERE {has_terms(*q.split())}"
        for i, q in enumerate(["bail building", "tax landab", "no such words"])
    ),
    # Every set of terms against every judgment, by plain containment.
    "related_proceedings": """
SELECT seed_id, doc_id, row_number() OVER (PARTITION BY seed_id ORDER BY decided DESC NULLS LAST, doc_id) AS rank FROM (
  SELECT s.doc_id AS seed_id, m.doc_id, m.decided FROM {titled} s JOIN (
    SELECT q.terms, t.doc_id, t.decided FROM (SELECT DISTINCT terms FROM {titled} WHERE len(terms) > 0) q JOIN {titled} t
      ON contains(lower(t.title || chr(10) || t.description), lower(q.terms[1]))
      AND contains(lower(t.title || chr(10) || t.description), lower(coalesce(q.terms[2], '')))
      AND contains(lower(t.title || chr(10) || t.description), lower(coalesce(q.terms[3], '')))) m
  ON m.terms = s.terms AND m.doc_id <> s.doc_id)
QUALIFY rank <= 10""",
    "numbered_corpus": "SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, title FROM {named}",
    "party_words": "SELECT doc_id, array_to_string(terms, ' ') AS terms FROM {titled}",
    "citation_extract": "SELECT * FROM {found}",
    "citation_single": """
SELECT brief_id, family, normalized FROM {found}
QUALIFY row_number() OVER (PARTITION BY brief_id ORDER BY length(raw) DESC, position, family) = 1""",
    "citation_lookup": "SELECT citation_key, exact, match FROM {exact}",
    "citation_verdicts": "SELECT * FROM {case_verdicts}",
    "statute_verdicts": "SELECT * FROM {statute_results}",
    "citation_sweep": "SELECT brief_id, kind, position, normalized, verdict, CAST(confidence AS DOUBLE) AS confidence FROM {scored}",
    "citation_sweep_whole": "SELECT brief_id, kind, position, normalized, verdict, CAST(confidence AS DOUBLE) AS confidence FROM {scored_whole}",
    "document_sweep": """
SELECT d.doc_id, kind, CAST(position + length(coalesce(d.text, '')) + 7 AS INT) AS position, normalized, verdict, CAST(confidence AS DOUBLE) AS confidence
FROM {scored_whole} w JOIN {documents} d ON d.doc_id = w.brief_id""",
    "verification_summary": f"SELECT kind, brief_id % 4 AS form, {_SUMMARY} FROM {{scored_whole}} GROUP BY ALL",
    "verification_total": f"SELECT 'all' AS part, {_SUMMARY} FROM {{scored_whole}} UNION ALL SELECT 'empty', {_SUMMARY} FROM {{scored_whole}} WHERE kind = 'none'",
    "act_resolution": "SELECT r.* FROM {resolved} r WHERE name IN (SELECT act || ', 1881' FROM {briefs})",
    "section_lookup": """
SELECT b.brief_id, r.slug, CASE WHEN r.slug IS NULL THEN 'act unknown' WHEN s.number IS NULL THEN 'section missing' ELSE 'found' END AS outcome,
  s.number, s.heading
FROM {briefs} b LEFT JOIN {resolved} r ON r.name = b.act || ', 1881' LEFT JOIN {sections} s ON s.slug = r.slug AND s.number = b.sec""",
}
ORACLE = {name: with_tables(sql, EXTRA) for name, sql in _SQL.items()}
