"""Legal records derived from the driver's tables.

Orders stand for judgments, hearings and briefs; customers for matters; events
for matter events and paid calls; documents for own documents; parts for Acts.
The SQL is plain enough to run on Spark and on the checking engine alike, so both
start from the same records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lexloom.rules.courts import HIGH_COURTS
from lexloom.rules.matters import MATTER_STATUSES, MATTER_TYPES

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_DIGITS = "'0123456789', 'ABCDEFGHIJ'"


def wide(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores.

    The given tables are single files, so one task each. A caller whose files are split by
    their scan already leaves this out: operators never move texts on their own.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _pick(values: list[str], index: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST({index} AS INT) + 1)"


_NAME_A = f"translate(lpad(CAST(o.o_custkey AS STRING), 6, '0'), {_DIGITS}) || ' ' || c.c_mktsegment"
_NAME_B = f"'THE STATE OF LAND' || translate(lpad(CAST(n.n_nationkey AS STRING), 2, '0'), {_DIGITS})"
_YEAR = "CAST(year(o.o_orderdate) AS STRING)"
_ISO = "CAST(CAST(o.o_orderdate AS DATE) AS STRING)"
_VOLUME = "CAST(o.o_orderkey % 12 + 1 AS STRING)"
_PAGE = "CAST(o.o_orderkey % 997 + 1 AS STRING)"
_NUMBER = "CAST(o.o_orderkey % 50000 + 1 AS STRING)"
_KEY = "CAST(o.o_orderkey AS STRING)"
_TOPIC = _pick(["bail", "land acquisition", "service of notice", "tax assessment", "breach of contract"], "o.o_orderkey % 5")
_JUDGE = "'JUSTICE ' || " + _pick(["RAO", "SEN", "DAS", "IYER", "KHAN", "MEHTA", "PATIL"], "o.o_orderkey % 7")
_COURT = _pick(list(HIGH_COURTS), "n.n_nationkey % 25")
_FROM = (
    "FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey "
    "JOIN {nation} n ON n.n_nationkey = c.c_nationkey"
)
_DMY = (
    f"CASE WHEN o.o_orderkey % 50 = 0 THEN 'undated' "
    f"WHEN o.o_orderkey % 50 = 1 THEN CAST(day(o.o_orderdate) AS STRING) || '-' || CAST(month(o.o_orderdate) AS STRING) || '-' || {_YEAR} "
    f"ELSE lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '-' || {_YEAR} END"
)

DERIVED = {
    "sc_raw": f"""
SELECT {_NAME_A} || ' versus ' || {_NAME_B} AS title, {_NAME_A} AS petitioner, {_NAME_B} AS respondent,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 'Appeal on ' || {_TOPIC} || ', priority ' || o.o_orderpriority END AS description,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE {_JUDGE} END AS judge,
  '[' || {_YEAR} || '] ' || {_VOLUME} || ' S.C.R. ' || {_PAGE} AS citation, 'SC' || {_KEY} AS cnr,
  {_DMY} AS decision_date, CASE WHEN o.o_orderkey % 2 = 0 THEN 'Allowed' ELSE 'Dismissed' END AS disposal_nature,
  {_YEAR} || 'INSC' || {_NUMBER} AS nc_display, {_YEAR} || '_' || {_VOLUME} || '_' || {_PAGE} || '_' || {_KEY} AS path,
  {_YEAR} AS year
{_FROM} WHERE o.o_orderstatus = 'O'""",
    "hc_raw": f"""
SELECT 'WP/' || {_KEY} || '/' || {_YEAR} || ' of ' || {_NAME_A} || ' Vs ' || {_NAME_B} AS title,
  'Petition about ' || {_TOPIC} AS description, {_JUDGE} AS judge,
  'court/orders/' || {_KEY} || '_' || {_ISO} || '.pdf' AS pdf_link, 'HC' || {_KEY} AS cnr, {_ISO} AS decision_date,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'Allowed' ELSE 'Rejected' END AS disposal_nature, TRUE AS pdf_exists,
  {_YEAR} AS year, {_COURT} AS court, 'bench' || CAST(o.o_custkey % 3 AS STRING) AS bench
{_FROM} WHERE o.o_orderstatus = 'F'""",
    "historical_raw": f"""
SELECT {_COURT} AS court, CAST(year(o.o_orderdate) - 100 AS INT) AS year, 'bhcr' AS bench,
  {_NAME_A} || ' v. ' || {_NAME_B} AS title, CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS judge,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'ILR Bombay ' || {_VOLUME} || ' p.' || {_PAGE} END AS citation,
  CAST(year(o.o_orderdate) - 100 AS STRING) || '-01-01' AS decision_date, 'historical/bhcr/' || {_KEY} || '.pdf' AS pdf_link,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'http://archive.example/' || {_KEY} ELSE NULL END AS source_url
{_FROM} WHERE o.o_orderstatus = 'P' AND o.o_orderpriority <> '1-URGENT'""",
    "recent_raw": f"""
SELECT CASE WHEN o.o_orderkey % 10 = 0 THEN 'SC' ELSE {_COURT} END AS court, CAST(year(o.o_orderdate) + 20 AS INT) AS year,
  'bombay' AS bench, {_NAME_A} || ' Vs ' || {_NAME_B} AS title, 'Order on ' || {_TOPIC} AS description,
  {_JUDGE} AS judge, 'WP/' || {_KEY} AS citation,
  CAST(year(o.o_orderdate) + 20 AS STRING) || '-06-15' AS decision_date, 'recent/pdfs/' || {_KEY} || '.pdf' AS pdf_link,
  'http://recent.example/' || {_KEY} AS source_url
{_FROM} WHERE o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT'""",
    "matters": f"""
SELECT c_custkey + 1 AS id, 'M-' || CAST(c_custkey AS STRING) AS reference, c_name AS title,
  {_pick(MATTER_TYPES, 'c_custkey % 17')} AS matter_type, {_pick(MATTER_STATUSES, 'c_custkey % 7')} AS status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Court ' || CAST(c_nationkey AS STRING) END AS court,
  'CN/' || CAST(c_custkey AS STRING) AS case_number,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 1500 AS INT) END AS cause_of_action_date,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '1996-01-01' + CAST(c_custkey % 1800 AS INT) END AS filing_date,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '1997-01-01' + CAST((c_custkey * 7) % 2000 AS INT) END AS limitation_expiry,
  DATE '1998-01-01' + CAST(c_custkey % 300 AS INT) AS updated_at, CAST(c_acctbal AS DOUBLE) AS claim_value
FROM {{customer}}""",
    "hearings": """
SELECT o_orderkey + 1 AS id, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 100000000001 ELSE o_custkey + 1 END AS matter_id,
  CAST(o_orderdate AS DATE) AS hearing_date, CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN NULL ELSE 'For ' || o_orderpriority END AS purpose,
  'Bench ' || CAST(o_orderkey % 5 AS STRING) AS bench, CASE WHEN o_orderkey % 3 = 0 THEN 'Adjourned' ELSE NULL END AS outcome,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) ELSE NULL END AS next_date
FROM {orders}""",
    "matter_events": """
SELECT event_id + 1 AS id, user_id + 1 AS matter_id, CAST(ts AS DATE) AS event_date, event_type, 'Noted: ' || props AS description
FROM {events}""",
    "own_documents": """
SELECT doc_id + 1 AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 200 + 1 END AS matter_id,
  'Document ' || CAST(doc_id AS STRING) AS title, source AS doc_type, text AS full_text,
  DATE '1999-01-01' + CAST(doc_id % 700 AS INT) AS created_at
FROM {documents}""",
    "paid_calls": f"""
SELECT event_id AS id, ts, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'view' THEN 50 + CAST(event_id % 7 AS INT) WHEN 'click' THEN 20 WHEN 'purchase' THEN 40 + CAST(event_id % 11 AS INT) ELSE 5 END AS cost_paise
FROM {{events}}""",
    # Each order cites its own judgment, a neighbour's or a made-up one.
    "briefs": f"""
SELECT o.o_orderkey AS brief_id, {_NAME_A} || ' v. ' || {_NAME_B} AS parties, {_YEAR} AS y, {_VOLUME} AS v,
  CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderkey % 997 + 5000 AS STRING) ELSE {_PAGE} END AS p, {_NUMBER} AS num,
  CAST(o.o_orderkey % 300 + 1 AS STRING) AS sec, CAST(o.o_orderkey % 40 + 1 AS STRING) AS art, o.o_orderkey % 4 AS form,
  CASE o.o_orderkey % 5 WHEN 3 THEN 'Unlisted Code' WHEN 4 THEN 'Contracts Act'
    WHEN 2 THEN 'Brand' || translate(CAST(o.o_orderkey % 30 AS STRING), {_DIGITS}) || ' Contract Act'
    ELSE 'Brand' || translate(CAST(o.o_orderkey % 30 AS STRING), {_DIGITS}) || ' Contracts Act' END AS act
{_FROM}""",
    "brief_texts": """
SELECT brief_id, 'In ' || parties || ', ' ||
  CASE form WHEN 0 THEN '(' || y || ') ' || v || ' SCC ' || p WHEN 1 THEN '[' || y || '] ' || v || ' S.C.R. ' || p
    WHEN 2 THEN y || ' (' || v || ') ALL MR ' || p ELSE 'AIR ' || y || ' SC ' || p END ||
  ', the court applied Section ' || sec || ' of the ' || act || ', 1881; it followed Article ' || art ||
  ' and Order VII Rule ' || v || ' CPC. It was reported at ' || y || 'INSC' || num || ' as well.' AS text
FROM {briefs}""",
    "acts": f"""
SELECT lower(replace(p_brand, '#', '-')) AS slug, 'The ' || translate(replace(p_brand, '#', ''), {_DIGITS}) || ' Contracts Act, 1881' AS title,
  CASE WHEN min(p_size) % 2 = 0 THEN 'full' ELSE 'partial' END AS coverage, min(p_partkey) AS ordinal
FROM {{part}} GROUP BY p_brand""",
    "sections": f"""
SELECT lower(replace(p_brand, '#', '-')) AS slug, 'The ' || translate(replace(p_brand, '#', ''), {_DIGITS}) || ' Contracts Act, 1881' AS act_title,
  CAST(p_partkey % 400 + 1 AS STRING) AS number, min(p_name) AS heading, min('Of ' || p_type || ' goods and ' || p_name) AS text
FROM {{part}} GROUP BY p_brand, p_partkey % 400""",
    "alias_names": """
SELECT lower(replace(title, ',', '')) AS full_name, slug, ordinal FROM {acts}""",
    # Titles lose the article, as in the alias table; slugs are names too.
    "aliases": """
SELECT substring(full_name, 5) AS alias, slug, ordinal * 2 AS ordinal FROM {alias_names}
UNION ALL SELECT replace(slug, '-', ' ') AS alias, slug, ordinal * 2 + 1 AS ordinal FROM {acts}""",
    "contracts": """
SELECT doc_id, text || chr(10) || CASE doc_id % 6
  WHEN 0 THEN '1. TERM' || chr(10) || 'This Agreement shall automatically renew for successive periods unless either party gives notice.' || chr(10) || '2. INDEMNITY' || chr(10) || 'The Consultant shall indemnify and hold harmless the Company against all claims, losses and damages.'
  WHEN 1 THEN 'For a period of 24 months after termination of this Agreement, the Consultant shall not directly or indirectly compete with the Company.' || chr(10) || chr(10) || 'ARBITRATION CLAUSE' || chr(10) || 'Any dispute between the parties and their heirs shall be referred to arbitration. The venue shall be Mumbai.'
  WHEN 2 THEN 'This Agreement is governed by the laws of India and is duly stamped. The seat of arbitration shall be Pune before a sole arbitrator. Aggregate liability shall be capped. Either party may terminate on notice sent to the address below.'
  WHEN 3 THEN 'COMPLAINT' || chr(10) || 'The petition of {{ name }} dated: 01/02/2020 prays for relief. [insert amount] The affidavit is attached. Notice was given. XXXX'
  WHEN 4 THEN '4. PAYMENT' || chr(10) || 'The consideration is payable against invoice; invoice dates matter. Termination and termination again, termination, termination, termination, termination. The Company may at any time modify these terms without notice. Liquidated damages apply. The courts at Mumbai shall have exclusive jurisdiction.'
  ELSE '' END AS text
FROM {documents}""",
}

# A table name in single braces; {{ }} inside texts is left alone.
_PLACE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Tables:
    """Base and derived tables of one data folder as DataFrames."""

    #: SQL of further records, by name.
    texts: dict[str, str] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._made[name] = self.sql({**DERIVED, **self.texts}[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose ``{name}`` placeholders are tables."""
        used = {name: self[name] for name in set(_PLACE.findall(text))}
        for name, df in used.items():
            df.createOrReplaceTempView(f"lexloom_{name}")
        return self.spark.sql(_PLACE.sub(r"lexloom_\1", text))

    def corpus_sources(self) -> dict[str, DataFrame]:
        """The four raw case-law sources."""
        return {
            "sc": self["sc_raw"], "hc": self["hc_raw"],
            "historical": self["historical_raw"], "recent": self["recent_raw"],
        }


def with_tables(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` for the checking engine, with the derived tables it uses as CTEs."""
    known = {**DERIVED, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _PLACE.findall(text):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(query)
    plain = lambda text: _PLACE.sub(r"\1", text)
    if not ordered:
        return plain(query)
    # Derived tables are computed once each.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({plain(known[name])})" for name in ordered)
    return f"WITH {ctes}\n{plain(query)}"
