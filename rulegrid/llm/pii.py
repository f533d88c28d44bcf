"""Problem 9: personal information inside free text.

A character-level bidirectional LSTM with CRF transitions (rulegrid.llm.tagger), trained in numpy from labelled spans
(rulegrid.llm.pii_train), reads each text in windows of WINDOW characters that overlap by 2 * MARGIN. Each window is
decoded by Viterbi; where windows overlap, a character keeps the tag of the window in which it lies further inside,
and spans are then read off the whole text. Every window is read. An exact check follows: where the text under a span has
the usual shape of its kind, that shape sets its ends; any other span stands as the model found it, on word borders,
unless it is too short for its kind. A name is dropped where it is that of a firm or a place, or only half a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrid.llm import tagger
from rulegrid.runtime import spread

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: Tag 0 is outside; kind k has 2k+1 for its first character and 2k+2 for the others.
TAGS = 1 + 2 * len(KINDS)
WINDOW, MARGIN = 512, 32
BATCH = 512
MODEL = Path(__file__).with_name("pii_model.npz")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

_STREET = r"(?:Cross[ \xa0]Road|Road|Street|Lane|Marg|Avenue|Close|Terrace|Square|Path|Nagar|Drive|Way|Court|Gardens|Crescent|Place|Row|Rd\.?|St\.?|Ave\.?)"
_CAP = r"(?:(?i:near|opp\.?|off|behind)[ \xa0]+)?[A-Z][\w'’.]*"
_SHAPES = {
    "email": re.compile(
        r"[\w.+'-]*\w(?:[ \xa0]?[@＠][ \xa0]?|[ \xa0]?[(\[{][ ]?at[ ]?[)\]}][ \xa0]?|[ \xa0]at[ \xa0](?=[\w-]+(?:[ \xa0]dot[ \xa0]|\.)))"
        r"[\w-]+(?:(?:\.|[ \xa0]?[(\[{][ ]?dot[ ]?[)\]}][ \xa0]?|[ \xa0]dot[ \xa0])[\w-]+)+", re.I),
    "phone": re.compile(r"(?<![\w.+/-])(?:\+|\((?=\d))?\d(?:[ \xa0.\-‐‑–]{0,2}[()]?[ \xa0.\-‐‑–]?\d){8,13}(?![\w/]|[.-]\d)"),
    "id_number": re.compile(r"(?<![\w-])(?:\d{4}([ \xa0-]?)\d{4}\1\d{4}|[A-Za-z]{5}[ \xa0-]?\d{4}[ \xa0-]?[A-Za-z]|[A-Za-z]\d{7})(?![\w-])"),
    "address": re.compile(
        r"(?<![\w/.-])(?:(?i:flat|plot|h\.?[ ]?no\.?|house(?:[ ]no\.?)?|door(?:[ ]no\.?)?|no\.|unit|apt\.?|apartment|shop|room|villa|suite)[ \xa0]*)?\d+[A-Za-z]?(?:[/-][\dA-Za-z]{1,4})?,?[ \xa0]*\n?"
        rf"(?:{_CAP}[ \xa0]+){{0,4}}(?:{_CAP},\s*)?(?:{_CAP},?\s+){{0,3}}?(?i:{_STREET})\b(?:,?[ \xa0\n\r]*[A-Z][\w'’]+(?:[ \xa0]*[-–,]?[ \xa0\n\r]*\d{{6}}\b)?)?"),
    "person_name": re.compile(r"(?:[A-Z][a-z'’]+|[A-Z]{2,}|[A-Z]\.?)(?:(?:,?[ \xa0]+|,?[ \xa0]*\r?\n|(?<=\.))(?:[A-Z][a-z'’]+|[A-Z]{2,}|[A-Z]\.?)(?![\w]))+"),
}
_TITLES = re.compile(r"(?:(?:mr|mrs|ms|miss|dr|shri|sri|smt|prof|kum|sir|madam|attn|present|contact|name)\b\.?:?\s*)+", re.I)
_FIRM_WORDS = r"(?:Custodians?|Securities|Brokers?|Broking|Advis[eo]rs?|Managers?|Funds?|Depository|Clearing|House|Bank|Ltd|Limited|LLP|Capital|Services|Holdings|Associates|Board|Exchange)"
_FIRM = re.compile(rf"[ \xa0]+(?:&|and[ \xa0]+(?:Sons|Co)\b|{_FIRM_WORDS}\b)")
_FIRM_WORD = re.compile(rf"{_FIRM_WORDS}", re.I)
_PLACE_WORD = re.compile(rf"{_STREET}|Vale|Valley|Hollow|Reach|Spur|Dock|Bay|Hill|River|Terminal", re.I)
_WORD = re.compile(r"\w[\w'’]*\.?")

#: Least letters and digits of a span of an unusual shape.
_LEAST = {"email": 8, "phone": 8, "id_number": 6, "address": 8}


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def phone_shaped(text: str) -> bool:
    """Ten to eleven digits, more with an international prefix; not twelve in a row, which is an identity number."""
    n = _digits(text)
    if text.startswith("+"):
        return 10 <= n <= 14
    return 12 <= n <= 15 if text.startswith("00") else n in (10, 11)


def shaped(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The stretch of the kind's shape that overlaps text[start:end] most, as (start, end)."""
    low = max(0, start - 48)
    near, best = text[low : end + 64], None
    for m in _SHAPES[kind].finditer(near):
        a, b = low + m.start(), low + m.end()
        shared = min(b, end) - max(a, start)
        if shared > 0 and (kind != "phone" or phone_shaped(m[0])) and (best is None or shared > best[0]):
            best = (shared, a, b)
    return best and best[1:]


def standing(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """A span of no usual shape, widened to word borders and without outer punctuation; None if it is too short, or lacks
    the digits (phone, id_number, address) or the at sign or dot, spelt or not, (email) without which it is none."""
    while start and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    piece = text[start:end]
    fits = _digits(piece) >= {"phone": 7, "id_number": 4, "address": 1}.get(kind, 0) and (kind != "email" or re.search(r"[@＠]|\bat\b", piece, re.I))
    return (start, end) if fits and sum(c.isalnum() for c in piece) >= _LEAST[kind] else None


def person(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Start and end of the name in text[start:end], on word borders, without titles; None if it is no full name or a firm's."""
    while start and (text[start - 1].isalnum() and text[start].isalnum()):
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    if m := _TITLES.match(text, start, end):
        start = m.end()
    found = [m for m in _WORD.finditer(text, start, min(len(text), end + 1)) if m.start() < end]
    found = [m for m in found if m[0][0].isupper()]
    if len(found) == 1 and len(found[0][0]) > 1:  # the other half may lie just outside
        one = found[0]
        if after := re.compile(r",?[ \xa0]*\r?\n?[ \xa0]*([A-Z][\w'’]+)").match(text, one.end()):
            found.append(re.compile(r"\w+").match(text, after.start(1)))
        elif before := re.search(r"([A-Z][\w'’]*\.?)[ \xa0]+$", text[max(0, one.start() - 24) : one.start()]):
            at = max(0, one.start() - 24) + before.start(1)
            found.insert(0, _WORD.match(text, at))
    if found and len(found[0][0].rstrip(".")) == 1:  # an initial may be a middle one
        before = re.search(r"([A-Z][\w'’]+)[ \xa0]+$", text[max(0, found[0].start() - 24) : found[0].start()])
        if before and not _TITLES.fullmatch(before[1]):
            found.insert(0, _WORD.match(text, max(0, found[0].start() - 24) + before.start(1)))
    if found and len(found[-1][0].rstrip(".")) == 1 and (after := re.compile(r"[ \xa0]*\r?\n?([A-Z][\w'’]+)").match(text, found[-1].end())):
        found.append(re.compile(r"\w+").match(text, after.start(1)))
    if len(found) < 2 or max(len(m[0].rstrip(".")) for m in found) < 3:
        return None
    a, b = found[0].start(), found[-1].end()
    if any(_FIRM_WORD.fullmatch(m[0].rstrip(".")) or _PLACE_WORD.fullmatch(m[0].rstrip(".")) for m in found):
        return None
    if _FIRM.match(text, b) or re.search(r"&[ \xa0]+$", text[max(0, a - 3) : a]) or "@" in text[b : b + 1] + text[max(0, a - 1) : a]:
        return None
    return a, b - (text[b - 1] == "." and len(found[-1][0]) > 3)


class Finder:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Reconciled tags of every character of each text."""
        codes = [tagger.encode(t) for t in texts]
        out = [np.zeros(len(c), "i1") for c in codes]
        places = [(i, s) for i, t in enumerate(texts) for s in self.starts(len(t))]
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            grid = np.zeros((len(part), WINDOW), "u1")
            for r, (i, s) in enumerate(part):
                piece = codes[i][s : s + WINDOW]
                grid[r, : len(piece)] = piece
            best = tagger.viterbi(self.weights, tagger.scores(self.weights, grid.T)).T
            for (i, s), row in zip(part, best):
                n = len(codes[i])
                low = s + MARGIN if s else 0
                high = min(n, s + WINDOW - MARGIN if s + WINDOW < n else s + WINDOW)
                out[i][low:high] = row[low - s : high - s]
        return out

    @staticmethod
    def starts(n: int) -> range:
        step = WINDOW - 2 * MARGIN
        return range(0, max(1, n - 2 * MARGIN), step) if n else range(0)

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text its mentions (kind, start, end) in order, none overlapping another."""
        return [self.mentions(t, tags) for t, tags in zip(texts, self.tags(texts))]

    @staticmethod
    def mentions(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
        kind = (tags + 1) // 2
        opens = (kind > 0) & ((np.append(0, kind[:-1]) != kind) | (tags % 2 == 1) & (np.append(0, tags[:-1]) != tags))
        spans = []
        for s in np.flatnonzero(opens).tolist():
            e = s + 1
            while e < len(kind) and kind[e] == kind[s] and not opens[e]:
                e += 1
            name = KINDS[kind[s] - 1]
            hit = person(text, s, e) if name == "person_name" else shaped(name, text, s, e) or standing(name, text, s, e)
            if hit:
                spans.append((name, *hit))
        # An exact shape outranks a name; of two that overlap the longer stays.
        taken: list[tuple[str, int, int]] = []
        for span in sorted(set(spans), key=lambda x: (x[0] == "person_name", x[1] - x[2])):
            if all(span[2] <= t[1] or span[1] >= t[2] for t in taken):
                taken.append(span)
        return sorted(taken, key=lambda x: x[1])


def load(path: Path = MODEL) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype("f4") for k in z.files}


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in found:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(parts) + text[at:]


_GROUP = 64


def _scan(weights: dict[str, np.ndarray], whole: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(weights)
        for pdf in batches:
            for at in range(0, len(pdf), _GROUP):
                part = pdf.iloc[at : at + _GROUP]
                texts = part["text"].tolist()
                found = finder.find(texts)
                if whole:
                    yield pd.DataFrame({"doc_id": part["doc_id"], "redacted": [redact(t, f) for t, f in zip(texts, found)], "mentions": [len(f) for f in found]})
                else:
                    rows = [(d, k, s, e) for d, f in zip(part["doc_id"], found) for k, s, e in f]
                    yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"])

    return scan


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")


def mentions(documents: DataFrame, model: Path = MODEL) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of every email, phone, id_number, address and person_name in the texts.

    documents: doc_id, text. Positions are 0-based characters, without titles and labels; end_pos is exclusive. Null
    and empty texts have none, repeated rows count once, texts of any length are read whole, line breaks of any kind
    count as they stand; an empty table gives no rows.
    """
    found = _texts(documents).mapInPandas(_scan(load(model), False), "doc_id long, kind string, start_pos int, end_pos int")
    return found.distinct()


def redacted(documents: DataFrame, model: Path = MODEL) -> DataFrame:
    """(doc_id, redacted, mentions): the texts with each mention replaced by [KIND], one row per different text of a doc_id."""
    return _texts(documents).mapInPandas(_scan(load(model), True), "doc_id long, redacted string, mentions int").dropDuplicates(["doc_id", "redacted"])
