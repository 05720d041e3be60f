"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

The patterns (``base_spans``) find plain e-mail addresses, network addresses, card and telephone numbers. Whatever they find in
a bounded sample of the texts teaches the model (``semi_crf``), together with rewritten forms of it: numbers without a plus
sign, cards with other gaps or side by side, addresses with spelt-out signs, and spoilt ones that are not personal data. The model then
scores candidate spans of every text as wholes and chooses boundaries and kinds jointly. A span
is added where it lies on the best path, has a probability of ``least`` or more, and touches no span of the patterns.

A null or empty text has no spans. A text of any length is read whole; candidates hold at most 19 digits or twelve labels, so
the work is linear. Repeated rows are treated each on its own. Without a single pattern match in the whole table there is nothing to
learn from and nothing is added. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices
from lexloom.llm.semi_crf import Candidate, SemiCrf, components, fit

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Texts without any of these hold neither a pattern match nor a candidate.
TRIGGER = r"[0-9@＠]|[\[({<]\s?[aA][tT]\s?[\])}>]"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += (n * 2 - 9 if n > 4 else n * 2) if i % 2 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    small = part.lstrip("0")
    return len(small) <= 3 and int(small or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    cursor, at = 0, text.find("@")
    while at >= 0:
        local = text[cursor:at]
        start = cursor + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        cursor = at + 1
        if found:
            yield start, found.end()
            cursor = found.end()
        at = text.find("@", cursor)


def base_spans(text: str) -> list[Candidate]:
    """(start, end, kind) of every pattern match, by kind and place.

    Of each kind the leftmost, without overlaps; one that fails its test (parts of an address, digits of a number) is passed over whole.
    """
    out = [(a, b, EMAIL) for a, b in _emails(text)]
    out += [(m.start(), m.end(), IP) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), CARD))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((m.start(), m.end(), PHONE))
    return out


# Candidates ---------------------------------------------------------------------------------------------------------------

_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/+\[\]]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
_AT = re.compile(r" ?[@＠] ?|\s?[\[({<]\s?[aA][tT]\s?[\])}>]\s?")
_DOT = r"(?:\.|\s?[\[({<]\s?(?:[dD][oO][tT]|\.)\s?[\])}>]\s?|\s[dD][oO][tT]\s)"
_BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,40}}{_DOT}){{0,5}}[A-Za-z0-9_%+-]{{1,40}}\Z")
_LABEL = re.compile(r"[A-Za-z0-9_%+-]+")
_DOMAIN_LABEL = re.compile(r"[A-Za-z0-9-]{1,40}")
_A_DOT = re.compile(_DOT)
_MOST_LABELS = 6
_MOST_DIGITS = 19


def _touches(text: str, start: int, end: int) -> bool:
    """Whether a letter, digit or address sign stands right beside the span."""
    left, right = text[start - 1 : start], text[end : end + 1]
    return left.isalnum() or right.isalnum() or left in ("_", "@") or right in ("_", "@")


def _numbers(text: str) -> Iterator[Candidate]:
    for chain in _CHAIN.finditer(text):
        if len(chain[0]) < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        for i, (first, _) in enumerate(groups):
            start = first
            if text[start - 1 : start] == "(" and ")" in text[first : first + 8]:
                start -= 1
            if text[start - 1 : start] == "+":
                start -= 1
            digits = 0
            for j in range(i, len(groups)):
                low, end = groups[j]
                digits += end - low
                if digits > _MOST_DIGITS:
                    break
                if digits < 4 or _touches(text, start, end):
                    continue
                if j - i == 3 and digits <= 12:
                    yield first, end, IP
                if digits >= 12:
                    yield first, end, CARD
                if 7 <= digits <= 15:
                    yield start, end, PHONE


def _addresses(text: str) -> Iterator[Candidate]:
    for at in _AT.finditer(text):
        low = max(0, at.start() - 160)
        local = _BEFORE.search(text[low : at.start()])
        if not local:
            continue
        starts = [low + local.start() + m.start() for m in _LABEL.finditer(local[0])][-_MOST_LABELS:]
        ends, here = [], at.end()
        while len(ends) < _MOST_LABELS and (label := _DOMAIN_LABEL.match(text, here)):
            ends.append(label.end())
            dot = _A_DOT.match(text, label.end())
            if not dot:
                break
            here = dot.end()
        for start in starts:
            for end in ends:
                if not (text[start - 1 : start].isalnum() if start else False) and not text[end : end + 1].isalnum():
                    yield start, end, EMAIL


def candidates(text: str, taken: list[Candidate] = ()) -> list[Candidate]:
    """All spans that the model may choose: number groups side by side, and labels around a sign for "at".

    Spans that overlap one of ``taken`` are left out.
    """
    found = set(_numbers(text))
    found.update(_addresses(text))
    if not found or not taken:
        return sorted(found)
    blocked = sorted((a, b) for a, b, _ in taken)
    starts, upto = [a for a, _ in blocked], list(accumulate((b for _, b in blocked), max))
    out, k = [], 0
    for c in sorted(found):
        # Of the taken spans up to here only the farthest end counts.
        while k < len(starts) and starts[k] <= c[0]:
            k += 1
        later = k < len(starts) and starts[k] < c[1]
        if not later and (k == 0 or upto[k - 1] <= c[0]):
            out.append(c)
    return out


# Features -----------------------------------------------------------------------------------------------------------------

_BINS = (4, 6, 7, 8, 9, 10, 11, 12, 15, 16, 19)
_GAPS = " ().-/+[]"
N_FEATURES = 58


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 4) : start], text[end : end + 4]


@lru_cache(maxsize=1 << 15)
def _features(span: str, left: str, right: str) -> tuple[float, ...]:
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    n, k = len(digits), len(groups)
    gaps = _GROUP.sub("", span).lstrip("+(")
    kinds = set(gaps)
    sign = _AT.search(span)
    out = [1.0]
    out += [float(sum(n > b for b in _BINS) == i) for i in range(len(_BINS) + 1)]
    out += [float(min(k, 6) == i) for i in range(1, 7)]
    out += [float(c in kinds) for c in " .-()/[+"]
    lengths = [len(g) for g in groups]
    plain = sign is None
    out += [
        float(not kinds),
        float(len(kinds) == 1),
        float(plain and 13 <= n <= 19 and luhn(digits)),
        float(plain and 13 <= n <= 19 and not luhn(digits)),
        float(span.startswith("+")),
        float(span.startswith("(")),
        float(digits.startswith("00")),
        float(k > 1 and set(lengths[:-1]) == {4}),
        float(lengths[-1:] == [4]),
        float(lengths[-2:] == [3, 4]),
        float(lengths[-3:] == [3, 3, 4]),
        float(k == 4 and all(map(_octet, groups))),
        float(k == 4 and not all(map(_octet, groups))),
        float(max(lengths, default=0) > 4),
        float(k == 3 and sorted(lengths)[:2] == [2, 2] and max(lengths) == 4),
        float(k == 4 and kinds == {"."}),
        float(k == 4 and kinds == {"[", ".", "]"}),
    ]
    if sign:
        domain = re.split(_DOT, span[sign.end() :])
        local = span[: sign.start()]
        out += [
            1.0,
            float("@" in sign[0] and sign[0] == "@"),
            float(sign[0] != "@"),
            *(float(min(len(domain), 4) == i) for i in range(1, 5)),
            float(domain[-1].isalpha() and 2 <= len(domain[-1]) <= 6),
            float(len(local) > 40),
        ]
    else:
        out += [0.0] * 9
    near = left.rstrip(_GAPS)[-1:], right.lstrip(_GAPS)[:1]
    out += [
        float(near[0].isdigit()),
        float(near[1].isdigit()),
        float(bool(sign) and left[-1:] in (".", "-", "+", "_", "%") and left != ""),
        float(bool(sign) and bool(re.match(rf"{_DOT}[A-Za-z0-9]", right))),
        float(left[-1:].isspace() or not left),
    ]
    return tuple(out)


def features(text: str, found: list[Candidate]) -> np.ndarray:
    """A row of features of the whole span for each candidate."""
    rows = [_features(text[a:b], *_context(text, a, b)) for a, b, _ in found]
    return np.array(rows, np.float64).reshape(len(rows), N_FEATURES)


# Learning -----------------------------------------------------------------------------------------------------------------

_MARGIN = 16


def windows(text: str, most_chars: int = 240) -> Iterator[tuple[str, list[Candidate]]]:
    """Stretches to learn from: groups of candidates with some text around, and the pattern matches in them.

    Stretches without a match teach nothing, since they may hold personal data that no pattern finds; nor do those in which matches
    overlap, or are cut off or not among the candidates.
    """
    base = sorted(base_spans(text))
    found = candidates(text)
    for group in components(found):
        low, high = min(found[i][0] for i in group), max(found[i][1] for i in group)
        a, b = max(0, low - _MARGIN), min(len(text), high + _MARGIN)
        if b - a > most_chars:
            continue
        inside = [s for s in base if s[0] < b and s[1] > a]
        whole = [s for s in inside if low <= s[0] and s[1] <= high]
        apart = all(x[1] <= y[0] for x, y in zip(whole, whole[1:]))
        mine = {found[i] for i in group}
        if whole and apart and len(whole) == len([s for s in inside if s[1] > low and s[0] < high]) and mine.issuperset(whole):
            yield text[a:b], [(s - a, e - a, k) for s, e, k in whole]


def rewritten(span: str, kind: int, rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Other forms of a match, with the places of the personal data in them (none if it is spoilt)."""

    def whole(s: str) -> tuple[str, list[tuple[int, int]]]:
        return s, [(0, len(s))]

    digits = _NOT_DIGIT.sub("", span)
    if kind == EMAIL:
        local, domain = span.rsplit("@", 1)
        at = rng.choice([" [at] ", "[at]", "(at)", " (at) ", " @ ", "＠", " {at} "])
        dot = rng.choice([".", "[dot]", " [dot] ", "(dot)", " dot "])
        yield whole(local + at + domain.replace(".", dot))
        yield f"{local}@{domain.split('.')[0]}", []
        yield f"{local}{at}{domain.split('.')[0]}", []
    elif kind == IP:
        yield whole(span.replace(".", rng.choice(["[.]", "(.)"])) if rng.random() < 0.7 else span)
        parts = span.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        yield ".".join(parts), []
        yield ".".join(span.split(".")[:3]), []
        yield f"{span} {span}", [(0, len(span)), (len(span) + 1, 2 * len(span) + 1)]
    elif kind == CARD:
        gap = rng.choice([".", "  ", " - ", "/"])
        cut = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        yield whole(gap.join(cut))
        yield f"{digits} {digits}", [(0, len(digits)), (len(digits) + 1, 2 * len(digits) + 1)]
        spoilt = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        yield rng.choice([spoilt, " ".join(spoilt[i : i + 4] for i in range(0, len(spoilt), 4))]), []
        yield digits[: rng.randint(5, 11)], []
    else:
        last = digits[-10:]
        area, mid, end = last[:3], last[3:6], last[6:]
        gap = rng.choice(["-", ".", " "])
        yield whole(rng.choice([f"({area}) {mid}-{end}", f"({area}) {mid} {end}"]))
        yield whole(rng.choice([gap.join((area, mid, end)), f"1{gap}{area}{gap}{mid}{gap}{end}"]))
        yield whole(f"00{digits[:-10] or '1'} {area} {mid} {end}")
        yield f"{mid}-{end}"[: rng.randint(5, 8)], []
        year = 1900 + int(end[-2:])
        yield rng.choice([f"{year}-{1 + int(area) % 12:02d}-{1 + int(mid) % 28:02d}", f"{year}-{year + 3}", f"{1 + int(mid) % 28:02d}.{1 + int(area) % 12:02d}.{year}", f"{area},{mid}.{end[:2]}"]), []
        yield digits, []


def lessons(stretches: list[tuple[str, list[Candidate]]], seed: int = 7) -> list[tuple[str, list[Candidate]]]:
    """The stretches, and each match once more in rewritten and in spoilt forms."""
    rng, out = random.Random(seed), list(stretches)
    for text, spans in stretches:
        if len(spans) != 1:
            continue
        a, b, kind = spans[0]
        # Short matches have no rewritten forms with the same number of digits.
        if kind == PHONE and sum(c.isdigit() for c in text[a:b]) < 11:
            continue
        left, right = text[:a], text[b:]
        if left[-1:].isdigit() or right[:1].isdigit():
            continue
        for form, places in rewritten(text[a:b], kind, rng):
            out.append((left + form + right, [(a + s, a + e, kind) for s, e in places]))
    return out


def train(stretches: list[tuple[str, list[Candidate]]], **options) -> SemiCrf | None:
    """A model of the stretches and their rewritten forms; none without stretches."""
    lattices, rows = [], []
    for text, spans in lessons(stretches):
        found = candidates(text)
        place = {c: i for i, c in enumerate(found)}
        if found and all(s in place for s in spans):
            lattices.append((found, [place[s] for s in spans]))
            rows.append(features(text, found))
    if not lattices:
        return None
    return fit(lattices, np.concatenate(rows), len(KINDS), **options)


def spans_of(text: str, model: SemiCrf | None, least: float) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, by pattern) of all spans, by kind and place."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if model is not None:
        found = candidates(text, base)
        chosen = model.decode(found, features(text, found), least) if found else []
        out += [(*found[i], False) for i in chosen]
    return sorted(out, key=lambda s: (s[2], s[0]))


# On tables ----------------------------------------------------------------------------------------------------------------


def learning_sample(docs: DataFrame, text: str = "text", most: int = 800) -> list[tuple[str, list[Candidate]]]:
    """At most ``most`` different stretches of all texts to learn from, those of least hash."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text"):
            found = {(w, tuple(s)) for t in some["text"].to_pylist() for w, s in windows(t)}
            rows = [[dict(zip(("start", "end", "kind"), s)) for s in spans] for _, spans in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.string()), pa.array(rows, pa.list_(kind))], ["stretch", "spans"]
            )

    triggered = docs.where(F.col(text).cast("string").rlike(TRIGGER)).select(F.col(text).cast("string").alias("text"))
    found = triggered.mapInArrow(run, "stretch string, spans array<struct<start:int, end:int, kind:int>>").distinct()
    rows = found.orderBy(F.xxhash64("stretch"), "stretch").limit(most).toArrow().to_pylist()
    return [(r["stretch"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in rows]


def find_personal(
    docs: DataFrame,
    text: str = "text",
    columns: list[str] | None = None,
    out: str = "spans",
    most: int = 800,
    least: float = 0.8,
    model: SemiCrf | None = None,
) -> DataFrame:
    """``columns`` of ``docs`` (all, unless named) with ``out``: array of (kind, start, end, base), by kind and place.

    Places are code points, ends exclusive; ``base`` says whether a pattern found the span. Without a ``model`` one is learnt from
    at most ``most`` stretches of the texts. Every text is searched whole.
    """
    if model is None:
        model = train(learning_sample(docs, text, most))
    kept = [c for c in (columns if columns is not None else docs.columns) if c != out]
    fields = "".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "__searched"):
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in spans_of(t, model, least)] if t else []
                for t in some["__searched"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), pa.array(rows, kind)], [*kept, out])

    whole = F.col(f"`{text}`").cast("string")
    # Other texts stay where they are: only these cross to Python.
    searched = docs.select(*(F.col(f"`{c}`") for c in kept), F.when(whole.rlike(TRIGGER), whole).alias("__searched"))
    return searched.mapInArrow(run, f"{fields}`{out}` array<struct<kind:string, start:bigint, end:bigint, base:boolean>>")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
