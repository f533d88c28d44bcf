"""Reading numbers, units and comparisons out of rule expressions. Pure Python, no Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Factors to the common unit of each kind of quantity (hours, rupees, basis points, plain count).
STATES: dict[str, dict[str, float]] = {
    "time": {"minute": 1 / 60, "hour": 1, "day": 24, "week": 7 * 24, "fortnight": 14 * 24, "month": 30 * 24, "quarter": 90 * 24, "year": 360 * 24},
    "money": {"rupee": 1, "thousand rupees": 1e3, "lakh rupees": 1e5, "million rupees": 1e6, "crore rupees": 1e7, "billion rupees": 1e9},
    "ratio": {"basis point": 1, "percent": 100, "ratio": 10_000},
    "count": {"one": 1, "thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9},
}

#: Spellings of scales and of base units.
SCALES = {
    "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "000s": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7, "billion": 1e9, "billions": 1e9, "bn": 1e9,
}
UNITS = {
    "time": {
        "minute": "minute", "minutes": "minute", "min": "minute", "mins": "minute", "hour": "hour", "hours": "hour", "hr": "hour", "hrs": "hour", "h": "hour",
        "day": "day", "days": "day", "d": "day", "week": "week", "weeks": "week", "wk": "week", "wks": "week", "fortnight": "fortnight", "fortnights": "fortnight",
        "month": "month", "months": "month", "mth": "month", "mths": "month", "quarter": "quarter", "quarters": "quarter", "qtr": "quarter", "qtrs": "quarter",
        "year": "year", "years": "year", "yr": "year", "yrs": "year",
    },
    "money": {"rs": "rupee", "inr": "rupee", "₹": "rupee", "rupee": "rupee", "rupees": "rupee"},
    "ratio": {"bps": "basis point", "bp": "basis point", "%": "percent", "percent": "percent", "pct": "percent", "percentage": "percent", "ratio": "ratio", "fraction": "ratio"},
    "count": {"nos": "one", "number": "one", "numbers": "one", "count": "one", "units": "one"},
}
_BASE = {word: (kind, STATES[kind][state]) for kind, words in UNITS.items() for word, state in words.items()}
_FILLERS = {"of", "in", "a", "an", "the", "calendar", "completed", "plain", "as", "are", "given", "figures", "amounts", "shown", "quoted", "stated", "reported", "counted", "measured", "expressed", "one", "s"}
#: Words that name a quantity rather than its unit when they end an attribute's name.
_NOT_A_SUFFIX = {"count", "number", "ratio", "fraction", "units", "percentage", "h", "d", "s"}

#: Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_WORDS = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}
_DIGITS = re.compile(r"[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?(?![\d.])")
_CURRENCY = re.compile(r"(?:rs\.?|inr|₹)\s*")


def read_unit(text: str | None) -> tuple[str, float] | None:
    """(kind, factor to the common unit), kind 'scale' for a bare scale word; None where the text is no unit."""
    if not text:
        return None
    text = text.lower().replace("’", "'").replace("per cent", "percent").replace("basis point", "bps ")
    tokens = [t for t in re.findall(r"'000|000s|[a-z]+|%|₹|\S", text) if t not in _FILLERS and t not in ".,()-/"]
    kind, factor, seen = "scale", 1.0, False
    for token in tokens:
        if token in SCALES:
            factor *= SCALES[token]
        elif token in _BASE:
            base, by = _BASE[token]
            if kind not in ("scale", base):
                return None
            kind, factor = base, factor * by
        else:
            return None
        seen = True
    return (kind, factor) if seen else None


def attribute_unit(unit: str | None, name: str | None, description: str | None) -> tuple[str, float] | None:
    """The unit an attribute is kept in: from its unit, else the end of its name, else the end of its description."""
    if found := read_unit(unit):
        return found
    stem, _, last = (name or "").lower().rpartition("_")
    if stem and last not in _NOT_A_SUFFIX and (found := read_unit(last)):
        return found
    _, comma, tail = (description or "").rpartition(",")
    return read_unit(tail) if comma else None


def stem_of(name: str | None) -> str:
    """The name without a unit at its end: what the attribute measures."""
    head, _, last = (name or "").lower().rpartition("_")
    return head if head and last not in _NOT_A_SUFFIX and read_unit(last) else (name or "").lower()


def _words_number(text: str) -> tuple[float, str] | None:
    total, used = 0, 0
    for m in re.finditer(r"([a-z]+)([\s-]*)", text):
        if m.start() != used:
            break
        if (word := m[1]) in _WORDS:
            total += _WORDS[word]
        elif word == "hundred" and used:
            total *= 100
        elif word != "and" or not used:
            break
        used = m.end()
    return (float(total), text[used:]) if used else None


def read_quantity(text: str) -> tuple[float, tuple[str, float] | None] | None:
    """(number, unit or None); None where the text is not a number with at most a unit."""
    text = text.strip().lower()
    front = ""
    if m := _CURRENCY.match(text):
        front, text = "rs ", text[m.end():]
    if m := _DIGITS.match(text):
        try:
            number = float(m[0].replace(",", ""))
        except ValueError:
            return None
        rest = text[m.end():]
    elif found := _words_number(text):
        number, rest = found
    else:
        return None
    rest = rest.strip().removesuffix("/-").strip(" .")
    if not front and not rest:
        return number, None
    unit = read_unit(front + rest)
    return (number, unit) if unit else None


@dataclass(frozen=True)
class Comparison:
    category: str
    name: str
    function: str | None
    number: float
    unit: tuple[str, float] | None


_MASK = re.compile(r"'[^']*'|\"[^\"]*\"|\[[^\]]*\]")
_JOINT = re.compile(r"&&|\|\||\b(?:and|or)\b", re.I)
_OP = re.compile(r"<=|>=|==|!=|<>|≤|≥|≠|=|<|>")
_SINCE = re.compile(r"^(\w+?)_since\s*\(\s*(\x01\d+\x01)\s*\)$", re.I)


def comparisons(expression: str | None) -> list[Comparison]:
    """Every number that one attribute is compared with. Comparisons with another attribute, with strings that are not
    quantities, and the text of `attest:` rules give nothing; an unreadable part is passed over."""
    if not expression or expression.strip().lower().startswith("attest"):
        return []
    held: list[str] = []

    def mask(m: re.Match[str]) -> str:
        held.append(m[0])
        sign = "\x01" if m[0][0] == "[" else "\x02"
        return f"{sign}{len(held) - 1}{sign}"

    parts, out = _JOINT.split(_MASK.sub(mask, expression)), []
    while parts:
        part = parts.pop(0).strip()
        if m := re.match(r"(.*?)\bbetween\b(.*)$", part, re.I | re.S):
            sides = [(m[1], m[2])] + ([(m[1], parts.pop(0))] if parts else [])
        elif len(pieces := _OP.split(part)) == 2:
            sides = [(pieces[0], pieces[1])]
        else:
            continue
        for left, right in sides:
            left, right = _bare(left), _bare(right)
            for side, value in ((left, right), (right, left)):
                function = None
                if m := _SINCE.match(side):
                    function, side = m[1].lower(), m[2]
                if not re.fullmatch(r"\x01\d+\x01", side) or "\x01" in value:
                    continue
                if m := re.fullmatch(r"\x02(\d+)\x02", value):
                    value = held[int(m[1])][1:-1]
                category, dot, name = held[int(side.strip("\x01"))][1:-1].partition(".")
                if dot and (quantity := read_quantity(value)):
                    out.append(Comparison(category.strip().lower(), name.strip().lower(), function, *quantity))
                break
    return out


_REVERSED = {"<=": ">=", ">=": "<=", "<": ">", ">": "<", "==": "==", "!=": "!="}
_SIGNS = {"≤": "<=", "≥": ">=", "≠": "!=", "<>": "!=", "=": "=="}


def _split(text: str, joint: str) -> list[str]:
    """Parts between connectives that stand in no brackets; the `and` of a BETWEEN joins nothing."""
    parts, depth, last, between = [], 0, 0, False
    for m in re.finditer(rf"[()]|\x01\d+\x01|\x02\d+\x02|\bbetween\b|{joint}", text, re.I):
        word = m[0].lower()
        if word in "()":
            depth += 1 if word == "(" else -1
        elif word == "between":
            between |= depth == 0
        elif depth == 0 and word[0] not in "\x01\x02":
            if between and word in ("and", "&&"):
                between = False
            else:
                parts.append(text[last : m.start()])
                last = m.end()
    return [*parts, text[last:]]


def required(expression: str | None) -> list[tuple[str, Comparison]]:
    """(operator, comparison), the attribute on the left, of every comparison of one attribute with a number that must
    hold for the rule to hold: joined by and, not under an or and not under a not. Else as `comparisons`."""
    if not expression or expression.strip().lower().startswith("attest"):
        return []
    held: list[str] = []

    def mask(m: re.Match[str]) -> str:
        held.append(m[0])
        sign = "\x01" if m[0][0] == "[" else "\x02"
        return f"{sign}{len(held) - 1}{sign}"

    def whole(text: str) -> str:
        return re.sub(r"\x01(\d+)\x01|\x02(\d+)\x02", lambda m: held[int(m[1] or m[2])], text)

    def read(text: str) -> list[tuple[str, Comparison]]:
        text = text.strip()
        while text.startswith("(") and text.endswith(")") and _closes(text):
            text = text[1:-1].strip()
        if len(_split(text, r"\|\||\bor\b")) > 1:
            return []
        parts = _split(text, r"&&|\band\b")
        if len(parts) > 1:
            return [x for part in parts for x in read(part)]
        if re.match(r"not\b", text, re.I):
            return []
        if re.search(r"\bbetween\b", text, re.I):
            ends = comparisons(whole(text))
            return list(zip((">=", "<="), ends)) if len(ends) == 2 else []
        found, signs = comparisons(whole(text)), _OP.findall(text)
        if len(found) != 1 or len(signs) != 1:
            return []
        sign = _SIGNS.get(signs[0], signs[0])
        return [(sign if "\x01" in _OP.split(text)[0] else _REVERSED[sign], found[0])]

    return read(_MASK.sub(mask, expression))


def _closes(text: str) -> bool:
    """The first bracket is closed by the last character."""
    depth = 0
    for at, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return at == len(text) - 1
    return False


def _bare(text: str) -> str:
    """Without `not` in front and unmatched brackets around."""
    text = re.sub(r"^\s*(?:not\b\s*)?", "", text, flags=re.I).strip()
    while text.startswith("(") and text.count("(") > text.count(")"):
        text = text[1:].strip()
    while text.endswith(")") and text.count(")") > text.count("("):
        text = text[:-1].strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    return text
