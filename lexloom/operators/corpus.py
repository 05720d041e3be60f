"""The uniform corpus: four sources with one column set."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.errors import CorpusNotSynced, InvalidRequest
from lexloom.functions.dates import dmy_to_iso
from lexloom.functions.text import basename, lookup, strip
from lexloom.rules.courts import (
    HC_ENDPOINT,
    HIGH_COURTS,
    SC_ENDPOINT,
    SUPREME_COURT,
    SUPREME_COURT_LABEL,
)
from lexloom.rules.drafts import SNIPPET_CHARS

COLUMNS = [
    "court_code", "year", "bench", "title", "description", "judge", "citation",
    "neutral_citation", "cnr", "disposal_nature", "decision_date", "locator", "src",
    "source_url",
]
SOURCES = ("sc", "hc", "historical", "recent")
ALL_COURTS = "all"


def _null() -> Column:
    return F.lit(None).cast("string")


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def supreme_court_rows(raw: DataFrame) -> DataFrame:
    """Supreme Court metadata in the uniform columns."""
    return raw.select(
        F.lit(SUPREME_COURT).alias("court_code"),
        F.col("year").cast("string").alias("year"),
        _null().alias("bench"),
        "title",
        _or_empty("description").alias("description"),
        _or_empty("judge").alias("judge"),
        "citation",
        F.col("nc_display").alias("neutral_citation"),
        "cnr",
        "disposal_nature",
        dmy_to_iso(F.col("decision_date")).alias("decision_date"),
        F.col("path").alias("locator"),
        F.lit("od").alias("src"),
        _null().alias("source_url"),
    )


def high_court_rows(raw: DataFrame) -> DataFrame:
    """High Court metadata in the uniform columns."""
    return raw.select(
        F.col("court").alias("court_code"),
        F.col("year").cast("string").alias("year"),
        "bench",
        "title",
        _or_empty("description").alias("description"),
        _or_empty("judge").alias("judge"),
        _null().alias("citation"),
        _null().alias("neutral_citation"),
        "cnr",
        "disposal_nature",
        F.col("decision_date").cast("string").alias("decision_date"),
        F.col("pdf_link").alias("locator"),
        F.lit("od").alias("src"),
        _null().alias("source_url"),
    )


def harvested_rows(raw: DataFrame, src: str) -> DataFrame:
    """Rows harvested from the courts' own sites (``hist`` or ``recent``)."""
    return raw.select(
        F.col("court").alias("court_code"),
        F.col("year").cast("string").alias("year"),
        "bench",
        "title",
        _or_empty("description").alias("description"),
        _or_empty("judge").alias("judge"),
        _or_empty("citation").alias("citation"),
        _null().alias("neutral_citation"),
        _null().alias("cnr"),
        _null().alias("disposal_nature"),
        F.col("decision_date").cast("string").alias("decision_date"),
        F.col("pdf_link").alias("locator"),
        F.lit(src).alias("src"),
        "source_url",
    )


_PROJECTIONS = {
    "sc": supreme_court_rows,
    "hc": high_court_rows,
    "historical": lambda raw: harvested_rows(raw, "hist"),
    "recent": lambda raw: harvested_rows(raw, "recent"),
}


def uniform_view(sources: Mapping[str, DataFrame], scope: str = ALL_COURTS) -> DataFrame:
    """Union of the sources a scope needs; raises when none of them exists.

    ``scope`` is ``"all"`` or a court code. The court filter applies to every
    branch: it prunes partitions of the High Court files, and the optimizer drops
    the Supreme Court branch when its literal code cannot match.
    """
    unknown = set(sources) - set(SOURCES)
    if unknown:
        raise InvalidRequest(f"unknown sources: {sorted(unknown)}")
    wanted = [
        name
        for name in SOURCES
        if name in sources
        and not (name == "hc" and scope == SUPREME_COURT)
        and not (name == "sc" and scope not in (SUPREME_COURT, ALL_COURTS))
    ]
    if not wanted:
        raise CorpusNotSynced(f"no local case-law metadata for scope {scope!r}")
    branches = [_PROJECTIONS[name](sources[name]) for name in wanted]
    corpus = reduce(lambda a, b: a.unionByName(b), branches)
    return corpus if scope == ALL_COURTS else corpus.where(F.col("court_code") == scope)


def doc_id() -> Column:
    """Reversible document id of a uniform row."""
    name = basename(F.col("locator"))
    located = F.concat_ws(
        ":", F.col("court_code"), F.coalesce("bench", F.lit("None")), F.col("year"), name
    )
    return (
        F.when(F.col("src") == "hist", F.concat(F.lit("hist:"), located))
        .when(F.col("src") == "recent", F.concat(F.lit("rc:"), located))
        .when(
            F.col("court_code") == SUPREME_COURT,
            F.concat_ws(":", F.lit("sc"), F.col("year"), F.col("locator")),
        )
        .otherwise(F.concat(F.lit("hc:"), located))
    )


def parse_doc_id(c: Column) -> Column:
    """Parts of a document id; a malformed id fails the query."""
    parts = F.split(c, ":", -1)
    kind, size = F.element_at(parts, 1), F.size(parts)

    def struct(source, court, bench, year, locator):
        return F.struct(
            source.alias("source"),
            court.alias("court_code"),
            bench.alias("bench"),
            year.alias("year"),
            locator.alias("locator"),
        )

    def at(i):
        return F.try_element_at(parts, F.lit(i))

    five = struct(kind, at(2), at(3), at(4), at(5))
    three = struct(kind, F.lit(SUPREME_COURT), F.lit(""), at(2), at(3))
    return (
        F.when(kind.isin("hist", "rc", "hc") & (size == 5), five)
        .when((kind == "sc") & (size == 3), three)
        .otherwise(F.raise_error(F.concat(F.lit("malformed document id: "), c)))
    )


def public_url(archive_root: str = "") -> Column:
    """Where the judgment can be read."""
    own = F.coalesce(
        F.nullif(F.col("source_url"), F.lit("")),
        F.concat(
            F.lit(f"{archive_root}/"),
            F.when(F.col("src") == "hist", F.concat(F.lit("historical/"), F.coalesce("bench", F.lit(""))))
            .otherwise(F.concat(F.lit("recent/"), F.coalesce("court_code", F.lit("")))),
            F.lit("/pdfs"),
        ),
    )
    supreme = F.format_string(
        f"{SC_ENDPOINT}/data/pdf/year=%s/english/%s_EN.pdf", F.col("year"), F.col("locator")
    )
    high = F.format_string(
        f"{HC_ENDPOINT}/data/pdf/year=%s/court=%s/bench=%s/%s",
        F.col("year"), F.col("court_code"), F.col("bench"), basename(F.col("locator")),
    )
    return (
        F.when(F.col("src").isin("hist", "recent"), own)
        .when(F.col("court_code") == SUPREME_COURT, supreme)
        .otherwise(high)
    )


def court_label(code: Column) -> Column:
    """Court name of a code; an unknown code is its own label."""
    labels = {**HIGH_COURTS, SUPREME_COURT: SUPREME_COURT_LABEL}
    return F.coalesce(lookup(labels, code), code, F.lit("Unknown court"))


def hits(corpus: DataFrame) -> DataFrame:
    """Uniform rows as search hits."""
    return corpus.select(
        doc_id().alias("doc_id"),
        strip(F.coalesce("title", F.lit(""))).alias("title"),
        court_label(F.col("court_code")).alias("court"),
        F.nullif(F.substring("decision_date", 1, 10), F.lit("")).alias("date"),
        F.substring(strip(F.col("description")), 1, SNIPPET_CHARS).alias("snippet"),
        public_url().alias("url"),
        "citation",
        "neutral_citation",
        F.nullif(strip(F.col("judge")), F.lit("")).alias("judge"),
        F.col("disposal_nature").alias("disposal"),
        "cnr",
    )


def years_per_court(corpus: DataFrame) -> DataFrame:
    """Courts with the sorted years held for each; a set of years stays small."""
    return corpus.groupBy("court_code").agg(
        F.sort_array(F.collect_set("year")).alias("years")
    )


def courts_present(corpus: DataFrame) -> DataFrame:
    """Distinct court codes."""
    return corpus.select("court_code").distinct()


def find_by_doc_id(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata of the judgments named in ``ids.doc_id``.

    All parts of the id are matched, so two judgments that share a file name in
    different courts, benches or years are not confused.
    """
    parsed = ids.select("doc_id", parse_doc_id(F.col("doc_id")).alias("p"))
    wanted = parsed.select(
        "doc_id",
        F.when(F.col("p.source") == "hist", "hist")
        .when(F.col("p.source") == "rc", "recent")
        .otherwise("od").alias("w_src"),
        F.col("p.court_code").alias("w_court"),
        F.col("p.bench").alias("w_bench"),
        F.col("p.year").alias("w_year"),
        F.col("p.locator").alias("w_name"),
    )
    named = corpus.withColumn(
        "__name",
        F.when(
            (F.col("src") == "od") & (F.col("court_code") == SUPREME_COURT), F.col("locator")
        ).otherwise(basename(F.col("locator"))),
    ).withColumn(
        "__bench",
        F.when(
            (F.col("src") == "od") & (F.col("court_code") == SUPREME_COURT), F.lit("")
        ).otherwise(F.coalesce("bench", F.lit("None"))),
    )
    joined = wanted.join(
        named,
        (named.src == F.col("w_src"))
        & (named.court_code == F.col("w_court"))
        & (named["__bench"] == F.col("w_bench"))
        & (named.year == F.col("w_year"))
        & (named["__name"] == F.col("w_name")),
    )
    return joined.select("doc_id", *COLUMNS)
