"""Citations in prose: located, parsed and deduplicated with built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import apart, sql_string, with_located_each
from lexloom.functions.text import citation_key, lookup, squash, strip, strip_chars, word_list, words
from lexloom.rules import citation_forms as forms

CASE, STATUTE, CONSTITUTION = "case", "statute", "constitution"

# Families in the order they are applied; the first to give a key wins.
_CASE_FAMILIES = [
    (1, forms.BRACKETED_YEAR),
    (2, forms.YEAR_THEN_VOLUME),
    (3, forms.YEAR_THEN_REPORTER),
    (4, forms.REPORTER_THEN_YEAR),
    (5, forms.NEUTRAL_COLON),
    (6, forms.NEUTRAL_COMPACT),
]
_STATUTE_FAMILIES = [(7, forms.SECTION_OF_ACT), (8, forms.ORDER_AND_RULE), (9, forms.ARTICLE)]

FIELDS = [
    "kind", "family", "position", "raw", "normalized", "citation_key", "year", "reporter",
    "volume", "page", "case_name", "section", "statute", "known_reporter",
]


def _pattern(pattern: str) -> str:
    if pattern.startswith("(?i)"):
        return "(?Uid)" + pattern[4:]
    return "(?Ud)" + pattern


def _reporter_key(raw: Column) -> Column:
    return F.lower(squash(F.replace(raw, F.lit("."))))


def known_reporter(raw: Column) -> Column:
    """Canonical spelling of a reporter, NULL for an unknown one."""
    return lookup(forms.REPORTERS, _reporter_key(raw))


def canonical_reporter(raw: Column, known: Column | None = None) -> Column:
    """Canonical spelling of a reporter; an unknown one is only tidied. ``known`` is its :func:`known_reporter`, if at hand."""
    return F.coalesce(known_reporter(raw) if known is None else known, strip_chars(squash(raw), " .,"))


def expand_statute(raw: Column) -> Column:
    """Full title of an abbreviated statute; any other name is only tidied."""
    cleaned = F.regexp_replace(strip_chars(strip(raw), ".,"), r"(?Ui)^the\s+", "")
    key = strip(F.lower(F.replace(cleaned, F.lit("."))))
    return F.coalesce(lookup(forms.STATUTE_ABBREVIATIONS, key), cleaned)


def trim_lead_ins(name: Column) -> Column:
    """Drop narrative words before a party name, keeping two words and "In re"."""
    lead_ins = word_list(forms.CASE_NAME_LEAD_INS)

    def bare(word):
        return F.btrim(F.lower(word), F.lit(".,"))

    def kept(parts, first):
        run = F.when(first == 0, F.size(parts)).otherwise(first - 1).cast("int")
        drop = F.least(run, F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.array_join(F.slice(parts, drop + 1, F.greatest(F.size(parts), F.lit(1))), " ")

    def trimmed(parts):
        narrative = F.transform(
            parts,
            lambda w, i: F.array_contains(lead_ins, bare(w))
            & ~(
                (F.lower(w) == "in")
                & (F.coalesce(bare(F.try_element_at(parts, i + 2)), F.lit("")) == "re")
            ),
        )
        return F.transform(F.array(F.array_position(narrative, F.lit(False))), lambda first: kept(parts, first))[0]

    # The words, and the place of the first that stays, are arguments of inner functions, so they are worked out once.
    return F.transform(F.array(words(name)), trimmed)[0]


# Marks around what a pattern found. A text's own such characters are first
# replaced by another control character, which the patterns treat alike.
_OPEN, _BETWEEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003", "\u0004"


def _unmarked(text: str) -> str:
    for mark in (_OPEN, _BETWEEN, _CLOSE):
        text = f"replace({text}, '{mark}', '{_OTHER}')"
    return text


def with_case_name(rows: DataFrame, window: str, out: str) -> DataFrame:
    """Add ``out``: the case name that ends at most 30 characters before the end of ``window``.

    One replacement marks every name, the text after the last mark is the gap.
    Only windows with a "v." between blanks are searched.
    """
    versus = sql_string(r"(?Uid)\s(?:v\.?|vs\.?|versus)\s")
    marked = rows.selectExpr(
        "*",
        f"CASE WHEN {window} RLIKE {versus} THEN regexp_replace({_unmarked(window)}, "
        f"{sql_string(_pattern(forms.CASE_NAME))}, '{_OPEN}$1{_BETWEEN}$2{_CLOSE}') END AS __marked",
    )
    gap = F.substring_index("__marked", _CLOSE, -1)
    pair = F.substring_index(F.substring_index("__marked", _OPEN, -1), _CLOSE, 1)
    name = squash(
        F.concat(
            trim_lead_ins(F.substring_index(pair, _BETWEEN, 1)), F.lit(" v. "),
            F.substring_index(pair, _BETWEEN, -1),
        )
    )
    near = F.contains("__marked", F.lit(_CLOSE)) & (F.length(gap) <= forms.CASE_NAME_GAP)
    return marked.withColumn(out, F.when(near, name)).drop("__marked")


def _with_groups(rows: DataFrame) -> DataFrame:
    """Add g1 to g4: the groups of each match, by its family's pattern."""
    branches = []
    for family, pattern in _CASE_FAMILIES + _STATUTE_FAMILIES:
        groups = _BETWEEN.join(f"${i + 1}" for i in range(re.compile(pattern).groups))
        branches.append(
            f"WHEN {family} THEN regexp_replace({_unmarked('raw')}, {sql_string(_pattern(pattern))}, '{groups}')"
        )
    # Cut once, as an argument of the inner function.
    cut = f"transform(array(CASE family {' '.join(branches)} END), x -> split(x, '{_BETWEEN}', -1))[0]"
    return rows.selectExpr("*", f"{cut} AS __groups").selectExpr(
        "*", *[f"CASE WHEN get(__groups, {i}) <> '' THEN get(__groups, {i}) END AS g{i + 1}" for i in range(4)]
    ).drop("__groups")


def _with_parts(rows: DataFrame) -> DataFrame:
    """Name the groups: which is the year, the reporter and so on, by family."""
    family = F.col("family")
    order_and_rule = F.concat(F.lit("Order "), F.col("g1"), F.lit(" Rule "), F.col("g2"))
    act = F.when(family == 7, F.col("g2")).when(family == 8, F.coalesce("g3", F.lit("CPC")))
    named = rows.select(
        *[c for c in rows.columns if not c.startswith("g")],
        F.when(family == 4, F.col("g2")).when(family <= 6, F.col("g1")).alias("year"),
        F.when(family <= 2, F.col("g3")).when(family == 3, F.col("g2"))
        .when(family == 4, F.col("g1")).alias("written"),
        F.when(family.isin(5, 6), F.upper("g2")).when(family.isin(3, 4), F.col("g3")).alias("court"),
        F.when(family <= 2, F.col("g2")).alias("volume"),
        F.when(family <= 4, F.col("g4")).when(family <= 6, F.col("g3")).alias("page"),
        F.when(family == 5, F.col("g4")).alias("suffix"),
        F.when(family == 8, order_and_rule).when(family.isin(7, 9), squash(F.col("g1"))).alias("section"),
        F.when(family == 9, "Constitution of India").when(family >= 7, expand_statute(act)).alias("statute"),
    )
    # Apart from the others' code, as in ``regex.apart``.
    known = named.withColumn("known", F.transform(F.array("written"), lambda w: F.when(family <= 4, known_reporter(w)))[0])
    return known.withColumn(
        "reporter",
        F.when(family.isin(5, 6), F.concat("court", F.lit(" (neutral)")))
        .when(family <= 4, canonical_reporter(F.col("written"), F.col("known"))),
    )


def _normalized() -> Column:
    family, gap = F.col("family"), F.lit(" ")
    return (
        F.when(
            family == 1,
            F.concat_ws(" ", F.concat(F.lit("("), "year", F.lit(")")), "volume", "reporter", "page"),
        )
        .when(family == 2, F.concat("year", F.lit(" ("), "volume", F.lit(") "), "reporter", gap, "page"))
        .when(family == 3, F.concat_ws(" ", "year", "reporter", "court", "page"))
        .when(family == 4, F.concat_ws(" ", "reporter", "year", "court", "page"))
        .when(family == 5, F.concat_ws(":", "year", "court", "page", "suffix"))
        .when(family == 6, F.concat("year", "court", "page"))
        .when(family == 7, F.concat(F.lit("Section "), "section", F.lit(", "), "statute"))
        .when(family == 8, F.concat("section", F.lit(", "), "statute"))
        .otherwise(F.concat(F.lit("Article "), "section", F.lit(", "), "statute"))
    )


CASES = tuple(f for f, _ in _CASE_FAMILIES)
STATUTES = tuple(f for f, _ in _STATUTE_FAMILIES)
#: The only family whose matches can end in blanks; none begins with one.
ORDERS = 8


def occurrences(
    df: DataFrame, key: str, text: str, families: tuple[int, ...] = CASES + STATUTES
) -> DataFrame:
    """Every match of the families: ``key`` and the citation fields, repeats included."""
    wanted = [(f, p) for f, p in _CASE_FAMILIES + _STATUTE_FAMILIES if f in families]
    located = with_located_each(
        df.select(F.col(key), F.col(text).alias("__text")),
        "__text",
        {f"m{family}": _pattern(p) for family, p in wanted},
    )

    tagged = ", ".join(
        f"transform(m{family}, m -> named_struct('family', {family}, 'm', m))"
        for family, _ in wanted
    )
    start = f"greatest(m.pos - {forms.CASE_NAME_WINDOW}, 0)"
    rows = located.selectExpr(key, "__text", f"inline(concat({tagged}))").selectExpr(
        key, "family", "m.pos AS position", "m.raw AS raw",
        f"CASE WHEN family <= 6 THEN substring(__text, {start} + 1, m.pos - {start}) END AS before",
    ).withColumn("raw", F.when(F.col("family") == ORDERS, strip(F.col("raw"))).otherwise(F.col("raw")))

    # One row per match from here on.
    named = with_case_name(rows, "before", "case_name").drop("before")
    parts = _with_parts(_with_groups(named)).withColumn("normalized", _normalized())
    is_case = F.col("family") <= 6
    return parts.select(
        key,
        F.when(is_case, CASE).when(F.col("family") == 9, CONSTITUTION).otherwise(STATUTE).alias("kind"),
        "family", "position", "raw", "normalized",
        F.when(is_case, citation_key(F.col("normalized")))
        .otherwise(F.lower("normalized")).alias("citation_key"),
        F.col("year").cast("int").alias("year"),
        "reporter", "volume", "page",
        "case_name", "section", "statute",
        F.when(
            is_case,
            F.col("family").isin(3, 4, 5, 6) | F.col("known").isNotNull(),
        ).alias("known_reporter"),
    )


def extract(
    df: DataFrame, key: str, text: str, families: tuple[int, ...] = CASES + STATUTES, fields: list[str] = FIELDS
) -> DataFrame:
    """Distinct citations of each text, cases and statutes deduplicated apart.

    Of several matches with one key, the lowest family and then the first position
    is kept. Spaced and compact neutral citations have the same key. A caller that
    reads some of the ``fields`` only names them, so that the others are not moved.
    """
    rows = occurrences(df, key, text, families).withColumn("is_case", F.col("kind") == CASE)
    best = F.min_by(F.struct(*[f for f in fields if f != "citation_key"]), F.struct("family", "position"))
    return (
        rows.groupBy(key, "is_case", "citation_key")
        .agg(best.alias("c"))
        .select(key, "c.*", "citation_key")
        .select(key, *fields)
    )


def parse_single(df: DataFrame, key: str, text: str) -> DataFrame:
    """The citation that covers most of each text; the earliest on ties."""
    found = extract(df, key, text)
    order = F.struct(-F.length("raw"), F.col("position"), F.col("family"))
    return (
        found.groupBy(key).agg(F.min_by(F.struct(*FIELDS), order).alias("c")).select(key, "c.*")
    )
