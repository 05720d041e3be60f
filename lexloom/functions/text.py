"""Text clean-up, lookup keys and number formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions.regex import sql_string
from lexloom.rules.citation_forms import PARTY_STOP_WORDS

_SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Collapse every run of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` (regex-class syntax) from both ends."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.array_remove(F.split(c, _SPACE, -1), "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; no stemming, no stop words."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+", -1), "")


def with_tokens(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``: the tokens of ``text``, worked out once per row.

    A generator keeps later filters from being pushed below it, where they would
    split the text again for every term.
    """
    made = F.inline(F.array(F.struct(tokens(text).alias(out))))
    return df.select("*", made)


def count_token(token_array: Column, token: str) -> Column:
    """How often a token occurs in an array of tokens."""
    return F.size(token_array) - F.size(F.array_remove(token_array, token))


def tags_to_spaces(c: Column) -> Column:
    """Replace markup tags by spaces and collapse whitespace."""
    return squash(F.regexp_replace(c, r"<[^>]+>", " "))


def strip_markup(c: Column) -> Column:
    """Line breaks become spaces, other tags vanish; NULL gives ''."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"<br\s*/?>", " ")
    return squash(F.regexp_replace(spaced, r"<[^>]+>", ""))


@F.pandas_udf(StringType())
def unescape_entities(c: pd.Series) -> pd.Series:
    """Decode every HTML entity (Arrow-batched; Spark has no such function)."""
    import html

    return c.map(lambda value: None if value is None else html.unescape(value))


def basename(path: Column) -> Column:
    """The part after the last slash; NULL gives ''."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/]*$", 0)


def citation_key(c: Column) -> Column:
    """Separator-free key: every punctuation style of a citation gives one key."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s.\[\]()]+", "")


def section_key(c: Column) -> Column:
    """Section number without prefix, sub-sections, dashes, spaces or final dot."""
    text = F.lower(strip(c))
    text = F.regexp_replace(text, r"(?U)^(section|sec\.?|s\.)\s*", "")
    text = F.regexp_replace(text, r"\(.*?\)", "")
    text = F.regexp_replace(text, r"[- ]", "")
    return F.regexp_replace(text, r"\.+$", "")


def concordance_key(c: Column) -> Column:
    """Section number as the concordance keys it: sub-sections are kept."""
    text = F.regexp_replace(F.lower(strip(c)), r"[- ]", "")
    return F.regexp_replace(text, r"\.+$", "")


def act_key(c: Column) -> Column:
    """Act name without article, dots, commas or extra spaces."""
    text = F.regexp_replace(F.lower(strip(c)), r"(?U)^the\s+", "")
    return squash(F.regexp_replace(text, r"[.,]", ""))


def party_terms(title: Column) -> Column:
    """At most three words that identify the parties of a case title.

    The registry prefix goes, the title is split at "versus", and each of the
    first two sides gives its first two words of four or more letters that are
    not stop words.
    """
    cleaned = F.regexp_replace(
        F.coalesce(title, F.lit("")), r"(?U)^[A-Z]+/\d+/\d+\s+of\s+", ""
    )
    sides = F.slice(F.split(cleaned, r"(?Ui)\s+(?:versus|vs\.?|v\.?)\s+", -1), 1, 2)
    stop = word_list(PARTY_STOP_WORDS)
    per_side = F.transform(
        sides,
        lambda side: F.slice(
            F.filter(
                F.regexp_extract_all(side, F.lit("[A-Za-z]{4,}"), F.lit(0)),
                lambda w: ~F.array_contains(stop, F.lower(w)),
            ),
            1,
            2,
        ),
    )
    return F.slice(F.flatten(per_side), 1, 3)


def start_year(label: Column) -> Column:
    """First four-digit run of a volume label such as ``1862-65``; else NULL."""
    found = F.regexp_extract(label, r"(?:^|[^\d])(\d{4})", 1)
    return F.when(found != "", found.cast("int"))


def loose_date(c: Column) -> Column:
    """ISO date from the four formats court sites use; '' when none fits."""
    text = strip(c)
    parsed = F.coalesce(
        F.try_to_date(text, "d/M/yyyy"),
        F.try_to_date(text, "d-M-yyyy"),
        F.try_to_date(text, "yyyy-M-d"),
        F.try_to_date(text, "d-MMM-yyyy"),
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(""))


def indian_grouping(c: Column) -> Column:
    """Whole rupees with the last three digits, then pairs; else the input text."""
    text = c.cast("string")
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(1e37))
    whole = F.bround(number).cast("decimal(38,0)").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.when(finite, grouped).otherwise(text)


def contains_count(haystack: Column, needles: Column, weight: int = 1) -> Column:
    """``weight`` for every needle found as a substring."""
    return F.aggregate(
        needles,
        F.lit(0),
        lambda total, w: total + F.when(F.contains(haystack, w), weight).otherwise(0),
    )


def word_list(values: list[str]) -> Column:
    """A fixed list of strings as one array literal."""
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a fixed table, NULL when absent."""
    pairs = ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)
