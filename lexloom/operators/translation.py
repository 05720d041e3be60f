"""Standard phrases of a draft in another language."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.regex import flagged, quote
from lexloom.rules.phrases import DEFAULT_LANGUAGE, LANGUAGES, PHRASES

_FACT = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def language_code(value: str | None) -> str:
    """Bare language code; missing or unknown input means English."""
    code = (value or "").strip().lower()
    for candidate in (code, code[:2]):
        if candidate in LANGUAGES:
            return candidate
    return DEFAULT_LANGUAGE


def phrase_pattern(english: str) -> tuple[str, list[str]]:
    """Pattern that matches a phrase with its facts filled in, and the fact names."""
    parts = _FACT.split(english)
    pattern = "".join("(.*?)" if i % 2 else quote(part) for i, part in enumerate(parts))
    return pattern, parts[1::2]


def phrase_replacement(target: str, names: list[str]) -> str:
    """Target phrase with ``$n`` for captured facts; unknown facts stay as written."""
    out, last = "", 0
    for m in _FACT.finditer(target):
        out += re.sub(r"([\\$])", r"\\\1", target[last:m.start()])
        name = m.group(1)
        out += f"${names.index(name) + 1}" if name in names else re.sub(r"([\\$])", r"\\\1", m.group(0))
        last = m.end()
        if name in names and target[last:last + 1].isdigit():
            out += "\\"  # keep a following digit out of the group number
    return out + re.sub(r"([\\$])", r"\\\1", target[last:])


def phrases_for(language: str) -> list[tuple[str, str]]:
    """(English, target) pairs that have a translation into ``language``."""
    code = language_code(language)
    if code == "en":
        return [(english, english) for _, english, _ in PHRASES]
    return [(english, hindi) for _, english, hindi in PHRASES] if code == "hi" else []


def translate(df: DataFrame, text: str, language: str, out: str = "translated") -> DataFrame:
    """Add the translated text and ``sentences_translated``.

    Phrases are replaced one after another, in table order, ignoring case. The
    English phrase is what is looked for, whatever the draft's own language.
    """
    df = df.withColumn(out, F.col(text)).withColumn("sentences_translated", F.lit(0))
    for english, target in phrases_for(language):
        pattern, names = phrase_pattern(english)
        regex = flagged(pattern, ignore_case=True)
        # Most phrases are absent; their longest fixed part is looked for first.
        fixed = max(_FACT.split(english)[::2], key=len).lower()
        present = F.contains(F.lower(F.col(out)), F.lit(fixed))
        df = df.withColumns(
            {
                "sentences_translated": F.col("sentences_translated")
                + F.when(present, F.regexp_count(F.col(out), F.lit(regex))).otherwise(0),
                out: F.when(
                    present, F.regexp_replace(F.col(out), regex, phrase_replacement(target, names))
                ).otherwise(F.col(out)),
            }
        )
    return df
