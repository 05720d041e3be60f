"""Acts, sections, code concordance and the scoring of fixed rule tables."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest
from lexloom.functions.text import act_key, concordance_key, contains_count, section_key
from lexloom.rules import concordance
from lexloom.rules.drafts import SNIPPET_CHARS
from lexloom.session import durable

AUTHENTIC = "authentic"
SUMMARY_CAVEAT = "This is a summary, not the words of the statute; read the official text."

#: Longest difference in length at which one name may contain the other.
CONTAINMENT_GAP = 25
#: Least similarity, in hundredths, at which a misspelt name is accepted.
SIMILARITY = 88

_EXACT, _CONTAINED, _SIMILAR = 0, 1, 2


def _substrings(text: Column, shortest: int, longest: int) -> Column:
    """Distinct substrings of the given lengths."""
    def of_length(n):
        count = F.length(text) - (n - 1)
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                lambda i: F.substring(text, i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(shortest, longest + 1)]))


def _pieces(text: Column) -> Column:
    """``text`` cut into one piece more than the edits a similar name may have.

    Two names with that few edits share a piece unchanged, so a join on pieces
    finds every similar pair.
    """
    size = F.length(text)
    edits = F.floor(size * (100 - SIMILARITY) / SIMILARITY).cast("int")
    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.substring(
            text,
            F.floor(i * size / (edits + 1)).cast("int") + 1,
            (F.floor((i + 1) * size / (edits + 1)) - F.floor(i * size / (edits + 1))).cast("int"),
        ),
    )


def similarity(a: Column, b: Column) -> Column:
    """100 for equal names, less for each edit relative to the longer name."""
    longest = F.greatest(F.length(a), F.length(b))
    return 100 * (1 - F.levenshtein(a, b) / longest)


def resolve_acts(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, slug, stage) for each distinct ``names.name`` that resolves.

    Stages: the alias itself; one contains the other with a length gap under 25
    (first alias in table order); at least 88 % similar (best, then first). Each
    stage is an equi-join: on the key, on short substrings, on pieces.
    """
    keyed = durable(
        names.select("name").distinct()
        .withColumn("key", act_key(F.col("name")))
        .where("key <> ''")
    )
    keys = keyed.select("key").distinct()
    table = durable(aliases.select("alias", "slug", "ordinal").where("alias <> ''"))

    exact = keys.join(table, F.col("key") == F.col("alias")).select(
        "key", "slug", F.lit(_EXACT).alias("stage"), F.lit(0.0).alias("loss"), "ordinal"
    )
    rest = keys.join(exact.select("key"), "key", "left_anti")

    def head(c):
        return F.substring(c, 1, 4)

    key_inside = rest.withColumn("gram", head("key")).join(
        table.withColumn("gram", F.explode(_substrings(F.col("alias"), 1, 4))), "gram"
    ).where(F.contains("alias", "key"))
    alias_inside = rest.withColumn("gram", F.explode(_substrings(F.col("key"), 1, 4))).join(
        table.withColumn("gram", head("alias")), "gram"
    ).where(F.contains("key", "alias"))
    contained = (
        key_inside.select("key", "alias", "slug", "ordinal")
        .unionByName(alias_inside.select("key", "alias", "slug", "ordinal"))
        .where(F.abs(F.length("key") - F.length("alias")) < CONTAINMENT_GAP)
        .select("key", "slug", F.lit(_CONTAINED).alias("stage"), F.lit(0.0).alias("loss"), "ordinal")
    )
    similar = (
        rest.withColumn("piece", F.explode(_substrings(F.col("key"), 4, 7)))
        .join(table.withColumn("piece", F.explode(_pieces(F.col("alias")))), "piece")
        .select("key", "alias", "slug", "ordinal").distinct()
        .withColumn("score", similarity(F.col("key"), F.col("alias")))
        .where(F.col("score") >= SIMILARITY)
        .select(
            "key", "slug", F.lit(_SIMILAR).alias("stage"), (100 - F.col("score")).alias("loss"), "ordinal"
        )
    )
    best = (
        exact.unionByName(contained).unionByName(similar)
        .groupBy("key")
        .agg(F.min_by(F.struct("slug", "stage"), F.struct("stage", "loss", "ordinal")).alias("r"))
        .select("key", "r.slug", "r.stage")
    )
    return keyed.join(best, "key").select("name", "slug", "stage")


def find_sections(requests: DataFrame, sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """Sections for (statute, section) requests, with act-unknown kept apart.

    ``outcome`` is ``found``, ``section missing`` or ``act unknown``.
    """
    resolved = resolve_acts(requests.select(F.col("statute").alias("name")), aliases)
    held = sections.withColumn("section_key", section_key(F.col("number")))
    return (
        requests.withColumn("section_key", section_key(F.col("section")))
        .join(resolved.select(F.col("name").alias("statute"), "slug"), "statute", "left")
        .join(held, ["slug", "section_key"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("slug").isNull(), "act unknown")
            .when(F.col("number").isNull(), "section missing")
            .otherwise("found"),
        )
    )


def section_cards(sections: DataFrame) -> DataFrame:
    """Sections as shown to a reader: summaries carry a caveat, text is cut."""
    return sections.select(
        "slug", "number", "heading",
        F.substring("text", 1, SNIPPET_CHARS).alias("excerpt"),
        "text_kind",
        F.when(F.col("text_kind") != AUTHENTIC, F.lit(SUMMARY_CAVEAT)).alias("caveat"),
        "chapter", "url",
    )


def search_sections(
    sections: DataFrame, query: str, limit: int = 10, heading: str = "heading", text: str = "text"
) -> DataFrame:
    """Sections by score: five per term in the heading, one per term in the body."""
    terms = [t for t in re.split(r"\W+", query.lower()) if len(t) > 2]
    if not terms:
        return sections.withColumn("score", F.lit(0)).limit(0)
    score = F.lit(0)
    for term in terms:
        score = score + F.when(F.lower(F.col(heading)).contains(term), 5).otherwise(0)
        score = score + F.when(F.lower(F.col(text)).contains(term), 1).otherwise(0)
    scored = sections.withColumn("score", score).where("score > 0")
    return scored.orderBy(F.desc("score"), "act_title", "number").limit(limit)


def coverage(acts: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: acts, sections, and how many acts are complete or partial."""
    counts = sections.groupBy("slug").agg(F.count("*").alias("n"))
    return acts.join(counts, "slug", "left").agg(
        F.count("*").alias("act_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("section_count"),
        F.count_if(F.col("coverage") == "full").alias("complete_acts"),
        F.count_if(F.coalesce("coverage", F.lit("partial")) != "full").alias("partial_acts"),
    )


def acts_by_title(acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Acts in the order of their titles, with the number of sections held of each."""
    counts = sections.groupBy("slug").agg(F.count("*").alias("section_count"))
    return acts.join(counts, "slug", "left").withColumn("section_count", F.coalesce("section_count", F.lit(0))).orderBy("title", "slug")


def coverage_titles(acts: DataFrame) -> DataFrame:
    """(held, place, title): titles of the complete Acts and of the partial ones, each list in order from 0.

    The two lists of a coverage report, as rows; an Act that does not say is partial.
    """
    held = F.when(F.col("coverage") == "full", "complete").otherwise("partial")
    order = Window.partitionBy("held").orderBy("title", "slug")
    listed = acts.select(held.alias("held"), "title", "slug")
    return listed.withColumn("place", F.row_number().over(order) - 1).select("held", "place", "title")


# --- old and new criminal codes ------------------------------------------------


def concordance_table(spark: SparkSession) -> DataFrame:
    """The fixed concordance, one row per pair."""
    rows = [
        (d, *concordance.CODE_TITLES[d], old, new, subject, note)
        for d, old, new, subject, note in concordance.all_pairs()
    ]
    return spark.createDataFrame(
        rows,
        "domain string, old_code string, new_code string, old_section string, "
        "new_section string, subject string, note string",
    )


def map_sections(
    requests: DataFrame, section: str, direction: str = "auto", domain: str | None = None
) -> DataFrame:
    """Counterparts of each requested section, one row per match and direction.

    The new code is also found by its bare number: 318 finds 318(4).
    """
    if direction not in ("auto", "old_to_new", "new_to_old"):
        raise InvalidRequest("direction must be auto, old_to_new or new_to_old")
    if domain is not None and domain not in concordance.CODE_TITLES:
        raise InvalidRequest(f"domain must be one of {sorted(concordance.CODE_TITLES)}")
    table = concordance_table(requests.sparkSession)
    if domain:
        table = table.where(F.col("domain") == domain)
    old = table.select(
        F.lit("old_to_new").alias("direction"),
        concordance_key(F.col("old_section")).alias("__key"), "*",
    )
    new_key = concordance_key(F.col("new_section"))
    new = table.select(
        F.lit("new_to_old").alias("direction"),
        F.explode(F.array_distinct(F.array(new_key, F.substring_index(new_key, "(", 1)))).alias("__key"),
        "*",
    )
    index = {"old_to_new": old, "new_to_old": new, "auto": old.unionByName(new)}[direction]
    # A fixed table of a few hundred rows: broadcasting it is always safe.
    keyed = requests.withColumn("__key", concordance_key(F.col(section)))
    return keyed.join(F.broadcast(index), "__key").drop("__key")


def concordance_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs per domain and in total."""
    return pairs.rollup("domain").agg(F.count("*").alias("pairs")).select(
        F.coalesce("domain", F.lit("total")).alias("domain"), "pairs"
    )


def governing_regime(offence_date: Column) -> Column:
    """Codes that govern an offence by its date."""
    titles = concordance.CODE_TITLES

    def codes(regime, i):
        return F.struct(
            F.lit(regime).alias("regime"),
            F.lit(titles["penal"][i]).alias("penal_code"),
            F.lit(titles["procedure"][i]).alias("procedure_code"),
            F.lit(titles["evidence"][i]).alias("evidence_act"),
        )

    commencement: date = concordance.COMMENCEMENT
    return F.when(offence_date >= F.lit(commencement), codes("new", 1)).when(
        offence_date.isNotNull(), codes("old", 0)
    )


# --- scoring a text against a fixed table ----------------------------------------


def search_words(text: Column) -> Column:
    """Whitespace-separated words longer than two characters, lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda w: F.length(w) > 2)


def best_rules(text: Column, rules: list[tuple], limit: int = 8) -> Column:
    """Limitation rules for a description: array of ``struct<score, key>``, best first.

    A word found in the claim counts two, elsewhere in the rule one.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(r[0]).alias("key"),
                F.lit(r[1].lower()).alias("claim"),
                F.lit(f"{r[0]} {r[1]} {r[4]}".lower()).alias("all"),
            )
            for r in rules
        ]
    )
    terms = search_words(text)

    def scored(rule):
        total = F.aggregate(
            terms, F.lit(0),
            lambda acc, w: acc
            + F.when(F.contains(rule["claim"], w), 2)
            .when(F.contains(rule["all"], w), 1).otherwise(0),
        )
        return F.struct((-total).alias("minus"), rule["key"].alias("key"))

    return _ranked(F.transform(table, scored), limit)


def best_subjects(text: Column, pairs: list[tuple], limit: int = 10) -> Column:
    """Concordance pairs for a description: array of ``struct<score, key>``, best first.

    One point per word found in the subject; the key is the old section, with the
    domain to tell equal numbers apart.
    """
    table = F.array(
        *[
            F.struct(
                F.concat_ws(" ", F.lit(old), F.lit(domain)).alias("key"),
                F.lit(subject.lower()).alias("subject"),
            )
            for domain, old, _, subject, _ in pairs
        ]
    )
    terms = search_words(text)

    def scored(row):
        return F.struct((-contains_count(row["subject"], terms)).alias("minus"), row["key"].alias("key"))

    return _ranked(F.transform(table, scored), limit)


def _ranked(scored: Column, limit: int) -> Column:
    kept = F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"] < 0)), 1, limit)
    return F.transform(
        kept, lambda s: F.struct((-s["minus"]).alias("score"), s["key"].alias("key"))
    )
