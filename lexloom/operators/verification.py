"""Verdicts on citations: joins against the corpus and the statute book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.dates import iso_date
from lexloom.functions.text import party_terms, section_key
from lexloom.operators.citations import CASE
from lexloom.operators.corpus import doc_id
from lexloom.operators.ordering import top_per_group
from lexloom.operators.search import with_citation_keys
from lexloom.operators.statutes import resolve_acts
from lexloom.operators.terms import match_all_terms
from lexloom.rules.citation_forms import VERDICT_CONFIDENCE
from lexloom.session import durable

VERIFIED, NOT_FOUND, AMBIGUOUS, UNCHECKED = "VERIFIED", "NOT_FOUND", "AMBIGUOUS", "UNCHECKED"

#: What a sweep reads of a citation.
READ = ["kind", "family", "position", "normalized", "citation_key", "case_name", "section", "statute"]

#: What verdicts on cases read of a judgment.
JUDGMENT = [
    "court_code", "year", "bench", "title", "description", "citation", "neutral_citation", "decision_date", "locator", "src",
]

#: A display of candidates shows this many newest ones; verdicts weigh all.
CANDIDATES = 10


def confidence(verdict: Column) -> Column:
    """Confidence of a verdict."""
    result = F.lit(0.0)
    for name, value in VERDICT_CONFIDENCE.items():
        result = F.when(verdict == name, value).otherwise(result)
    return result


def exact_matches(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct citation keys with the number of judgments that carry them."""
    held = (
        with_citation_keys(corpus)
        .groupBy("citation_key")
        .agg(F.count("*").alias("exact"), F.min(doc_id()).alias("match"))
    )
    keys = citations.select("citation_key").distinct()
    return keys.join(held, "citation_key", "left").withColumn(
        "exact", F.coalesce("exact", F.lit(0))
    )


def title_candidates(names: DataFrame, corpus: DataFrame, k: int | None = CANDIDATES) -> DataFrame:
    """Newest ``k`` judgments, or all, whose title or description has all party terms.

    ``names`` has ``case_name``. Each distinct set of terms is looked up once.
    """
    terms = F.array_sort(F.array_distinct(F.transform(party_terms(F.col("case_name")), F.lower)))
    sets = durable(
        names.select("case_name").distinct().withColumn("terms", terms)
        .withColumn("query_id", F.array_join("terms", " "))
    )
    keyed = corpus.select(
        doc_id().alias("doc_id"),
        F.concat_ws("\n", "title", "description").alias("body"),
        F.lower(F.coalesce("title", F.lit(""))).alias("title"),
        F.lower(F.coalesce("citation", F.lit(""))).alias("citation"),
        F.lower(F.coalesce("neutral_citation", F.lit(""))).alias("neutral"),
        iso_date(F.col("decision_date")).alias("decided"),
    )
    matched = match_all_terms(
        sets.select("query_id", "terms").distinct(), keyed, "doc_id", "body"
    ).drop("body")
    order = [F.col("decided").desc_nulls_last(), F.col("doc_id")]
    if k is None:
        best, shown = matched, ["case_name", "doc_id", "title", "citation", "neutral"]
    else:
        best = top_per_group(matched, ["query_id"], order, k, "rank")
        shown = ["case_name", "doc_id", "rank", "title", "citation", "neutral"]
    return sets.select("case_name", "query_id").join(best, "query_id").select(*shown)


def verify_cases(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Verdict for each distinct (citation_key, normalized, case_name).

    A key carried by one judgment is VERIFIED, by several AMBIGUOUS. Otherwise the
    party names are looked up: no judgment means NOT_FOUND; exactly one of all that match
    and shows the citation in its title or citation fields means VERIFIED; anything
    else is AMBIGUOUS.
    """
    asked = durable(
        citations.where(F.col("kind") == CASE)
        .select("citation_key", "normalized", "case_name")
        .distinct()
    )
    # Four readers: keys, words, the words asked for, and the rows found.
    corpus = durable(corpus.select(*JUDGMENT))
    exact = durable(asked.join(exact_matches(asked, corpus), "citation_key"))
    # Keys the corpus lacks go on to the fallback; the others are settled here.
    settled = exact.where("exact > 0").select(
        "citation_key", "normalized", "case_name",
        F.when(F.col("exact") == 1, VERIFIED).otherwise(AMBIGUOUS).alias("verdict"),
        F.lit("citation").alias("basis"),
        F.when(F.col("exact") == 1, F.col("match")).alias("match"),
    )
    open_ = exact.where("exact = 0").select("citation_key", "normalized", "case_name")
    named = open_.where(F.col("case_name").isNotNull())
    candidates = title_candidates(named, corpus, None)
    needle = F.lower("normalized")
    weighed = (
        named.join(candidates, "case_name")
        .withColumn(
            "strong",
            F.contains("title", needle)
            | F.contains("citation", needle)
            | F.contains("neutral", needle),
        )
        .groupBy("citation_key", "normalized", "case_name")
        .agg(
            F.count("*").alias("found"),
            F.count_if("strong").alias("strong"),
            F.min(F.when(F.col("strong"), F.col("doc_id"))).alias("match"),
        )
    )
    same = (
        (F.col("o.citation_key") == F.col("w.citation_key"))
        & (F.col("o.normalized") == F.col("w.normalized"))
        & F.col("o.case_name").eqNullSafe(F.col("w.case_name"))
    )
    fallback = (
        open_.alias("o").join(weighed.alias("w"), same, "left")
        .select(
            "o.citation_key", "o.normalized", "o.case_name",
            F.when(F.coalesce("w.found", F.lit(0)) == 0, NOT_FOUND)
            .when(F.col("w.strong") == 1, VERIFIED)
            .otherwise(AMBIGUOUS).alias("verdict"),
            F.lit("party names").alias("basis"),
            F.when(F.col("w.strong") == 1, F.col("w.match")).alias("match"),
        )
    )
    return settled.unionByName(fallback)


def verify_statutes(citations: DataFrame, acts: DataFrame, sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """Verdict for each distinct (statute, section).

    An unknown Act is UNCHECKED. A missing section is NOT_FOUND only when the Act
    is held in full; in a partial Act, and for "Order x Rule y" (which the
    section numbers do not index), it is UNCHECKED.
    """
    asked = durable(
        citations.where(F.col("kind") != CASE).select("statute", "section").distinct()
    )
    resolved = resolve_acts(asked.select(F.col("statute").alias("name")), aliases)
    held = sections.select(
        "slug", section_key(F.col("number")).alias("section_key"), F.col("number").alias("match")
    )
    joined = (
        asked.join(resolved.withColumnRenamed("name", "statute"), "statute", "left")
        .join(acts.select("slug", "coverage"), "slug", "left")
        .withColumn("section_key", section_key(F.col("section")))
        .join(held, ["slug", "section_key"], "left")
    )
    ordered = F.col("section").startswith("Order ")
    return joined.select(
        "statute", "section", "slug",
        F.when(F.col("slug").isNull(), UNCHECKED)
        .when(F.col("match").isNotNull(), VERIFIED)
        .when(ordered | (F.col("coverage") != "full"), UNCHECKED)
        .otherwise(NOT_FOUND).alias("verdict"),
        "match",
    )


def within_budget(citations: DataFrame, key: str, budget: int | None) -> DataFrame:
    """Add ``checked``: the first ``budget`` case citations of each text are, without a budget all.

    The window holds the citations of one text, which one row held before.
    """
    if budget is None:
        return citations.withColumn("checked", F.lit(True))
    order = Window.partitionBy(key).orderBy("position", "family")
    cases = F.sum((F.col("kind") == CASE).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    return citations.withColumn(
        "checked", (F.col("kind") != CASE) | (cases <= F.lit(max(0, budget)))
    )


def summarise(checked: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts per verdict, mean confidence and whether everything is verified.

    An empty set counts as fully verified with confidence one.
    """
    def n(verdict):
        return F.count_if(F.col("verdict") == verdict)

    total = F.count("verdict")
    # A sum of exact tenths, so that the mean does not depend on row order.
    tenths = F.sum((confidence(F.col("verdict")) * 10).cast("int"))
    mean = F.coalesce(F.bround(tenths / 10.0 / total, 3), F.lit(1.0)) if group else F.when(
        total == 0, F.lit(1.0)
    ).otherwise(F.bround(tenths / 10.0 / F.greatest(total, F.lit(1)), 3))
    return checked.groupBy(*(group or [])).agg(
        total.alias("total"),
        n(VERIFIED).alias("verified"),
        n(NOT_FOUND).alias("not_found"),
        n(AMBIGUOUS).alias("ambiguous"),
        n(UNCHECKED).alias("unchecked"),
        mean.alias("avg_confidence"),
        (n(VERIFIED) == total).alias("all_verified"),
    )


def sweep(
    citations: DataFrame,
    key: str,
    corpus: DataFrame,
    acts: DataFrame,
    sections: DataFrame,
    aliases: DataFrame,
    budget: int | None,
) -> DataFrame:
    """Verdict on every citation of every text.

    Each distinct citation is verified once, however many texts cite it.
    """
    marked = durable(within_budget(citations, key, budget))
    cases = verify_cases(marked.where("checked"), corpus)
    statutes = verify_statutes(marked, acts, sections, aliases)
    case_rows = marked.where(F.col("kind") == CASE)
    same = (
        (case_rows.citation_key == cases.citation_key)
        & (case_rows.normalized == cases.normalized)
        & case_rows.case_name.eqNullSafe(cases.case_name)
        & case_rows.checked
    )
    left = case_rows.join(cases, same, "left").select(
        case_rows[key], "kind", "position", case_rows.normalized,
        F.coalesce("verdict", F.lit(UNCHECKED)).alias("verdict"),
    )
    right = (
        marked.where(F.col("kind") != CASE)
        .join(statutes, ["statute", "section"], "left")
        .select(
            key, "kind", "position", "normalized",
            F.coalesce("verdict", F.lit(UNCHECKED)).alias("verdict"),
        )
    )
    return left.unionByName(right).withColumn("confidence", confidence(F.col("verdict")))
