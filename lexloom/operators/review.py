"""Contract clauses, contract risks and defects of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import around, flagged, required_text, with_located_each
from lexloom.functions.text import squash
from lexloom.rules import drafts
from lexloom.rules.clauses import (
    ABSENT_EXCERPT,
    CLAUSE_AFTER,
    CLAUSE_BEFORE,
    CLAUSE_MAX_HITS,
    CLAUSE_TYPES,
    RISK_AFTER,
    RISK_BEFORE,
    RISK_RULES,
    SEVERITY_ORDER,
)


def _clause(pattern: str) -> str:
    return flagged(pattern, ignore_case=True)


def _risk(pattern: str) -> str:
    return flagged(f"(?:{pattern})", ignore_case=True, dotall=True)


# --- clauses ---------------------------------------------------------------------


def clause_presence(text: Column) -> dict[str, Column]:
    """For each clause type, whether any of its patterns occurs."""
    return {
        key: text.rlike(_clause("|".join(f"(?:{p})" for p in patterns)))
        for key, _, _, patterns in CLAUSE_TYPES
    }


def missing_clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``missing``: expected clause types that a document lacks, in table order."""
    present = clause_presence(F.col(text))
    absent = F.array_compact(
        F.array(*[F.when(~present[k], k) for k, _, expected, _ in CLAUSE_TYPES if expected])
    )
    return df.select(key, absent.alias("missing"))


def clause_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """Up to five hits per clause type: key, clause, hit, position, excerpt.

    Hits are listed pattern by pattern, so hit 1 is the first hit of the first
    pattern that occurs, not always the smallest offset.
    """
    names = {
        f"p{i}_{j}": _clause(p)
        for i, (_, _, _, patterns) in enumerate(CLAUSE_TYPES)
        for j, p in enumerate(patterns)
    }
    required = {
        f"p{i}_{j}": required_text(p).lower()
        for i, (_, _, _, patterns) in enumerate(CLAUSE_TYPES)
        for j, p in enumerate(patterns)
    }
    located = with_located_each(
        df.select(key, text), text, names, CLAUSE_MAX_HITS, required
    )
    per_type = []
    for i, (clause, _, _, patterns) in enumerate(CLAUSE_TYPES):
        every = ", ".join(f"p{i}_{j}" for j in range(len(patterns)))
        per_type.append(
            f"transform(slice(concat({every}), 1, {CLAUSE_MAX_HITS}), "
            f"(m, n) -> named_struct('clause', '{clause}', 'hit', n + 1, 'm', m))"
        )
    rows = located.selectExpr(key, text, f"inline(concat({', '.join(per_type)}))")
    end = F.col("m.pos") + F.length("m.raw")
    return rows.select(
        key, "clause", "hit", F.col("m.pos").alias("position"),
        squash(around(F.col(text), F.col("m.pos"), end, CLAUSE_BEFORE, CLAUSE_AFTER)).alias("excerpt"),
    )


def clause_map(hits: DataFrame, key: str) -> DataFrame:
    """Occurrences, first position and first two excerpts of each clause type.

    A (document, clause) group holds at most five hits.
    """
    def nth(n):
        return F.max(F.when(F.col("hit") == n, F.col("excerpt")))

    return hits.groupBy(key, "clause").agg(
        F.count("*").alias("occurrences"),
        F.max(F.when(F.col("hit") == 1, F.col("position"))).alias("first_position"),
        F.array_compact(F.array(nth(1), nth(2))).alias("excerpts"),
    )


# --- risks -----------------------------------------------------------------------


def risk_flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per risk found; absence flags have position -1."""
    found = {
        f"r{i}": _risk(rule[3]) for i, rule in enumerate(RISK_RULES) if not rule[4]
    }
    located = with_located_each(df.select(key, text), text, found, 1)
    flags = []
    for i, (rule, severity, title, pattern, when_absent, gate, authority) in enumerate(RISK_RULES):
        if when_absent:
            applies = ~F.col(text).rlike(_risk(pattern))
            position, end = F.lit(-1), F.lit(-1)
        else:
            applies = F.size(f"r{i}") > 0
            first = F.try_element_at(F.col(f"r{i}"), F.lit(1))
            position, end = first["pos"], first["pos"] + F.length(first["raw"])
        if gate:
            applies = F.col(text).rlike(_clause(f"(?:{gate})")) & applies
        flags.append(
            F.when(
                applies,
                F.struct(
                    F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                    F.lit(SEVERITY_ORDER[severity]).alias("severity_order"),
                    F.lit(title).alias("title"), F.lit(authority).cast("string").alias("authority"),
                    position.alias("position"), end.alias("end"),
                ),
            )
        )
    rows = located.select(key, text, F.inline(F.array_compact(F.array(*flags))))
    excerpt = squash(around(F.col(text), F.col("position"), F.col("end"), RISK_BEFORE, RISK_AFTER))
    return rows.select(
        key, "rule", "severity", "severity_order", "title", "authority",
        F.when(F.col("position") < 0, F.lit(ABSENT_EXCERPT)).otherwise(excerpt).alias("excerpt"),
        "position",
    )


def flags_by_severity(flags: DataFrame, key: str) -> DataFrame:
    """Flags per severity of each document; at most one row per rule is counted."""
    return flags.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_ORDER],
        F.count("*").alias("flag_count"),
    )


# --- drafts ------------------------------------------------------------------------


def draft_issues(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per defect of each draft: issue, severity, excerpt."""
    body, lowered = F.col(text), F.lower(F.col(text))

    def issue(condition, name, severity, excerpt):
        return F.when(
            condition,
            F.struct(
                F.lit(name).alias("issue"), F.lit(severity).alias("severity"), excerpt.alias("excerpt")
            ),
        )

    checks = []
    for name, pattern in drafts.PLACEHOLDERS:
        found = F.regexp_extract(body, _clause(pattern), 0)
        checks.append(
            issue(found != "", name, "high", F.substring(found, 1, drafts.PLACEHOLDER_EXCERPT_CHARS))
        )
    pleading = lowered.rlike("(?U)" + drafts.PLEADING)
    for name, severity, wanted, excerpt in drafts.PLEADING_NEEDS:
        lacks = pleading
        for word in wanted:
            lacks = lacks & ~lowered.contains(word)
        checks.append(issue(lacks, name, severity, F.lit(excerpt)))
    checks.append(
        issue(
            lowered.contains(drafts.AFFIDAVIT) & ~lowered.contains(drafts.AFFIRMATION),
            "no_affirmation", "high", F.lit("(no affirmation clause found)"),
        )
    )
    checks.append(
        issue(
            lowered.rlike("(?U)" + drafts.NOTICE) & ~lowered.contains(drafts.SERVICE_MODE),
            "no_service_mode", "low", F.lit("(no service mode stated)"),
        )
    )
    checks.append(
        issue(
            ~lowered.rlike("(?U)" + drafts.DATE_LABEL) & ~body.rlike("(?U)" + drafts.DATE_FIGURES),
            "no_date", "medium", F.lit("(no date found)"),
        )
    )
    return df.select(key, F.inline(F.array_compact(F.array(*checks))))


def draft_summary(issues: DataFrame, key: str) -> DataFrame:
    """Issues and high-severity issues per draft."""
    return issues.groupBy(key).agg(
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
    )


def parameter_gaps(required: Column, optional: Column, supplied: Column) -> Column:
    """``struct<missing, unknown>`` for the facts supplied to a template."""
    return F.struct(
        F.array_except(required, supplied).alias("missing"),
        F.array_except(supplied, F.array_union(required, optional)).alias("unknown"),
    )
