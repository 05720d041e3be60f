"""Regular expressions with offsets, as built-in column expressions.

Patterns are written for Unicode text and ``\\n`` line ends, so they are prefixed
with Java's ``U`` (Unicode classes) and ``d`` (only ``\\n`` ends a line) flags.

``regexp_extract_all`` gives the matches and ``split`` the text between them; the
running length of both is the offset of each match, in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(pattern: str, *, ignore_case=False, dotall=False, multiline=False) -> str:
    """``pattern`` with inline flags for Unicode text."""
    flags = "U" + "d" + ("i" if ignore_case else "")
    flags += ("s" if dotall else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def required_text(pattern: str) -> str:
    """The longest fixed text every match of ``pattern`` contains, '' if none is sure.

    Only plain characters outside groups, classes and alternatives count.
    """
    best, run, depth, i = "", "", 0, 0
    while i <= len(pattern):
        ch = pattern[i] if i < len(pattern) else ""
        if ch == "|" and depth == 0:
            return ""
        plain = depth == 0 and (ch.isalnum() or ch == " ")
        following = pattern[i + 1 : i + 2]
        if plain and (not following or following not in "?*{"):
            run += ch
        else:
            best, run = max(best, run, key=len), ""
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = pattern.index("]", i + 2)
        elif ch == "{":
            i = pattern.index("}", i)
        elif ch in ("(", ")"):
            depth += 1 if ch == "(" else -1
        i += 1
    return best


def sql_string(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quote(text: str) -> str:
    """``text`` as a literal inside a pattern."""
    special = set("\\.[]{}()*+-?^$|&#~ \t\n\r\v\f")
    return "".join("\\" + ch if ch in special else ch for ch in text)


def apart(expression: str) -> str:
    """SQL for the value of ``expression``, in a projection that is not merged with the ones around it into one method.

    The JVM never compiles a method of over 8,000 bytes. With a lambda in it, a projection is made as many short methods.
    """
    return f"transform(array({expression}), x -> x)[0]"


def with_located(
    df: DataFrame, text: str, pattern: str, out: str, limit: int | None = None
) -> DataFrame:
    """Add ``out``: array of ``struct<pos, raw>`` for every match of ``pattern``.

    ``pos`` is the 0-based character offset. With ``limit`` only the first
    ``limit`` matches are kept.
    """
    return with_located_each(df, text, {out: pattern}, limit)


def folded(text: str) -> str:
    """SQL for ``text`` in lower case as a case-blind pattern sees it."""
    return f"replace(lower({text}), '\u017f', 's')"


def with_located_each(
    df: DataFrame, text: str, patterns: dict[str, str], limit: int | None = None,
    required: dict[str, str] | None = None,
) -> DataFrame:
    """:func:`with_located` for several patterns, as six projections in all; linear in the matches.

    Most texts hold one match of a pattern at most. In an ASCII text the pattern is searched for once more, in another the
    match is where its text occurs, if once only; the sums over the text between matches are for the others.

    ``required`` gives, for case-blind patterns, lower-case text without which they
    cannot match; a pattern is only tried on texts that contain it.
    """
    raws, once, gaps, steps, sums, located = [], [], [], [], [], []
    columns = df.columns
    # Few patterns make short methods as they are; of many, the first keeps each projection apart.
    kept = lambda expression: apart(expression) if len(patterns) > 3 and out == next(iter(patterns)) else expression
    if required:
        df = df.selectExpr("*", f"{folded(text)} AS __folded")
    for out, pattern in patterns.items():
        literal = sql_string(pattern)
        found = f"regexp_extract_all({text}, {literal}, 0)"
        needed = (required or {}).get(out)
        if needed:
            found = f"CASE WHEN contains(__folded, {sql_string(needed)}) THEN {found} ELSE array() END"
        found = f"slice({found}, 1, {limit})" if limit else found
        raws.append(f"{kept(found)} AS __{out}_raws")
        # Java and Spark count alike from the start of an ASCII text.
        at = (
            f"CASE WHEN size(__{out}_raws) <> 1 THEN NULL WHEN __ascii THEN regexp_instr({text}, {literal}) - 1 "
            f"ELSE {_only_place(text, f'__{out}_raws')} END"
        )
        once.append(f"{kept(at)} AS __{out}_only")
        # Summed up: neither without a match nor with one in its only place.
        summed = f"size(__{out}_raws) > 0 AND __{out}_only IS NULL"
        cut = f"CASE WHEN {summed} THEN split({text}, {literal}, {limit + 1 if limit else -1}) END"
        gaps.append(f"{kept(cut)} AS __{out}_gaps")
        summed = f"__{out}_gaps IS NOT NULL"
        steps.append(f"CASE WHEN {summed} THEN {_blocks(f'__{out}_raws', f'__{out}_gaps')} END AS __{out}_blocks")
        sums.append(f"CASE WHEN {summed} THEN {_bases(f'__{out}_blocks')} END AS __{out}_bases")
        located.append(
            f"CASE WHEN __{out}_only IS NOT NULL THEN array(named_struct('pos', __{out}_only, 'raw', get(__{out}_raws, 0))) "
            f"WHEN {summed} THEN {_offsets(f'__{out}_raws', f'__{out}_gaps', f'__{out}_blocks', f'__{out}_bases')} "
            f"WHEN __{out}_raws IS NOT NULL THEN array() END AS {out}"
        )
    return (
        df.selectExpr("*", *raws, f"octet_length({text}) = length({text}) AS __ascii")
        .selectExpr("*", *once)
        .selectExpr("*", *gaps)
        .selectExpr("*", *steps)
        .selectExpr("*", *sums)
        .selectExpr(*columns, *located)
    )


def _only_place(text: str, raws: str) -> str:
    """Offset of a single match whose text occurs nowhere else, not even as part of something that does not match."""
    raw = f"get({raws}, 0)"
    first = f"instr({text}, {raw})"
    return f"CASE WHEN size({raws}) = 1 AND locate({raw}, {text}, {first} + 1) = 0 THEN {first} - 1 END"


#: Running sums copy what they have so far, so they are made within blocks of this many matches.
_BLOCK = 256
_RUNNING = "aggregate({}, array(0), (done, n) -> concat(done, array(element_at(done, -1) + n)))"


def _blocks(raws: str, gaps: str) -> str:
    """Blocks of the lengths of each match with the text before it."""
    step = f"zip_with({raws}, slice({gaps}, 1, size({raws})), (raw, gap) -> length(gap) + length(raw))"
    # The steps are an argument of the inner function, so they are worked out once.
    return (
        f"transform(array({step}), steps -> transform(sequence(0, greatest(size(steps) - 1, 0) div {_BLOCK}), "
        f"b -> slice(steps, b * {_BLOCK} + 1, {_BLOCK})))[0]"
    )


def _bases(blocks: str) -> str:
    """Text before each block, and the whole."""
    return _RUNNING.format(f"transform({blocks}, x -> aggregate(x, 0, (total, n) -> total + n))")


def _offsets(raws: str, gaps: str, blocks: str, bases: str) -> str:
    """Text before a match: before its block, before it within the block, and its own gap."""
    before = (
        f"flatten(zip_with({blocks}, slice({bases}, 1, size({blocks})), "
        f"(x, base) -> transform(slice({_RUNNING.format('x')}, 1, size(x)), n -> n + base)))"
    )
    starts = f"zip_with({before}, slice({gaps}, 1, size({raws})), (n, gap) -> n + length(gap))"
    return f"zip_with({raws}, {starts}, (raw, pos) -> named_struct('pos', pos, 'raw', raw))"


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """Characters ``[start - before, end + after)`` of ``text``, clipped to it."""
    first = F.greatest(start - before, F.lit(0))
    last = F.least(end + after, F.length(text))
    return F.substring(text, first + 1, last - first)
