"""Reading references to clauses, annexures and statutes out of a text. Pure Python, no Spark.

The text is cut into tokens once; a scanner then walks over them with one token of state at a time: a cue word, the
number after it, further numbers of a list, and what the whole is said to be part of.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Cue words by what they point at.
CUES = {
    "internal": "para paras paragraph paragraphs clause clauses subclause subclauses sub-clause sub-clauses point points item items",
    "statute": "regulation regulations section sections rule rules article articles",
    "annexure": "annexure annexures schedule schedules appendix appendices form forms table tables",
}
#: Words that head a part of a circular besides the annexures, and words that end the name of a statute.
PARTS = "chapter chapters part parts"
STATUTES = "regulation regulations act rules guidelines bye-law bye-laws byelaws"

#: Kinds of link a sentence implies, the first that matches wins; * stands for one word.
LINK_PHRASES = {
    "supersedes": [
        "stand withdrawn", "stands withdrawn", "hereby withdrawn", "stand repealed", "stands repealed", "rescind", "supersed",
        "shall cease to be in force", "shall cease to apply", "stand deleted", "stands deleted", "is hereby deleted",
    ],
    "amends": [
        "partial modification", "partially modif", "is amended", "is substituted", "is modified", "is revised", "is replaced", "is hereby amended",
        "is hereby substituted", "is hereby modified", "is hereby revised", "is hereby replaced", "shall be amended", "shall be substituted",
        "shall be modified", "shall be replaced", "shall be read as", "stand amended", "stands amended", "stand substituted", "stands substituted",
        "stand modified", "stands modified", "has been amended", "prior to substitution", "read as under",
    ],
    "definitional": ["meaning assigned", "meaning ascribed", "as defined in", "defined under", "shall have the meaning", "shall have the same meaning"],
    "exemption": [
        "nothing in", "nothing contained in", "shall not apply", "exempt from", "exempted from", "exemption from", "notwithstanding anything",
        "save as provided", "save as otherwise provided",
    ],
    "trigger": [
        "unable to compl", "not able to compl", "not in a position to compl", "fail to meet", "fails to meet", "fail to compl", "fails to compl",
        "fail to satisf", "fails to satisf", "fail to adhere", "fails to adhere", "fail to maintain", "fails to maintain", "failure to meet",
        "failure to compl", "failure to satisf", "event of non-compliance", "event of non compliance", "event of noncompliance", "event of breach",
        "event of default", "event of any non-compliance", "event of any non compliance", "event of any noncompliance", "event of any breach", "event of any default",
        "non-compliance with", "non compliance with", "noncompliance with", "in case of non-compliance", "in case of non compliance", "in case of noncompliance",
        "in case non-compliance", "in case the * fails", "only if", "only where", "only after", "subject to compliance with", "subject to fulfil",
        "upon satisfying", "upon meeting", "upon complying",
    ],
}
LINK_KINDS = tuple((kind, "|".join(re.escape(p).replace(r"\*", r"\w+").replace(r"\ ", " ").replace(r"\-", "-") for p in phrases)) for kind, phrases in LINK_PHRASES.items())
#: How much of the text on either side decides the kind; kinds that become links; the longest context kept.
BEFORE, AFTER, LINKING, CONTEXT = 160, 90, ("trigger", "amends", "supersedes"), 240

_FAMILY = {w: family for family, words in CUES.items() for w in words.split()}
_HEADS = {*CUES["annexure"].split(), *PARTS.split()}
_ENDS = set(STATUTES.split())
_TOKEN = re.compile(r"\d+[A-Za-z]?(?:\.\d+[A-Za-z]?)*|[^\W\d_](?:[\w&.'-]*\w)?|\([A-Za-z0-9]{1,6}\)|\S")
_CIRCULAR = re.compile(r"\b[A-Za-z]{2,6}(?:/[A-Za-z0-9][\w.-]*){2,}")
_KIND = [(kind, re.compile(pattern)) for kind, pattern in LINK_KINDS]


@dataclass(frozen=True)
class Citation:
    cue: str
    number: str
    kind: str
    target: str
    container: str | None
    target_doc: str | None
    range_to: str | None
    start: int
    end: int


def kind_of(context: str) -> str:
    low = " ".join(context.split()).lower()
    return next((kind for kind, pattern in _KIND if pattern.search(low)), "reference")


class _Scanner:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def word(self, i: int) -> str:
        return self.tokens[i][0].lower() if 0 <= i < len(self.tokens) else ""

    def number(self, i: int, loose: bool) -> tuple[str, int] | None:
        """(number, token after it): digits with what hangs on them in brackets; `loose`, also I, IV or a single letter."""
        if not 0 <= i < len(self.tokens):
            return None
        raw = self.tokens[i][0]
        if raw[0].isdigit():
            j = i + 1
            while loose and self.word(j).startswith("(") and self.word(j).endswith(")"):
                raw, j = raw + self.tokens[j][0], j + 1
            return raw, j
        if loose and (len(raw) == 1 and raw.isalpha() and raw.isascii() or re.fullmatch(r"[IVXivx]{1,4}", raw)):
            return raw, i + 1
        return None

    def label(self, i: int) -> tuple[str, int] | None:
        """(heading word and label, token after it) of a part of a circular that begins here."""
        if self.word(i) in _HEADS and self.word(i + 1)[:1].isalnum():
            return f"{self.tokens[i][0]} {self.tokens[i + 1][0]}", i + 2
        return None

    def whole(self, i: int) -> tuple[str, str, int] | None:
        """(what, name, token after it) of `of (the) ...` after a number: a part of the circular or a statute."""
        i += self.word(i) == ","
        if self.word(i) != "of":
            return None
        i += 1 + (self.word(i + 1) == "the")
        if found := self.label(i):
            return "container", *found
        for j in range(i + 1, min(i + 9, len(self.tokens))):
            if not (self.word(j)[0].isalnum() or self.word(j)[0] in "()"):
                break
            if self.word(j) in _ENDS:
                return "statute", self.text[self.tokens[i][1] : self.tokens[j][2]], j + 1
        return None

    def before(self, i: int) -> str | None:
        """The part of the circular named right before a cue."""
        j = i - 1 - (self.word(i - 1) in (",", "-"))
        found = self.label(j - 1)
        return found[0] if found else None

    def more(self, i: int) -> tuple[str, str, int, int] | None:
        """(separator, number, its token, token after it) of a further member of a list."""
        sign = self.word(i)
        if sign not in (",", "and", "&", "to"):
            return None
        j = i + 1 + (sign == "," and self.word(i + 1) == "and")
        found = self.number(j, loose=False)
        return (sign, found[0], j, found[1]) if found else None


def read_citations(text: str | None) -> list[Citation]:
    """Every citation in order; members of a list share cue, kind and target, and the end of a range stands in range_to."""
    scan, out, i = _Scanner(text or ""), [], 0
    while i < len(scan.tokens):
        cue, begin = scan.word(i), i
        family = _FAMILY.get(cue)
        i += 1
        if family is None:
            continue
        at = i + (scan.word(i) == ".")
        if scan.word(at) in ("no", "nos", "number"):
            at += 1 + (scan.word(at + 1) == ".")
        found = scan.number(at, loose=True)
        if found is None:
            continue
        number, i = found
        start, end = scan.tokens[begin][1], scan.tokens[i - 1][2]
        whole = scan.whole(i)
        target = "statute" if family == "internal" and whole and whole[0] == "statute" else family
        container = doc = None
        after = i
        if target == "statute":
            doc = whole[1] if whole and whole[0] == "statute" else None
        else:
            if whole and whole[0] == "container":
                container, after = whole[1], whole[2]
            else:
                container = scan.before(begin)
            near = _CIRCULAR.search(text[end : end + 60]) or _CIRCULAR.search(text[max(0, start - 80) : start])
            doc = near[0].rstrip(" .,") if near else None
        kind = kind_of(text[max(0, start - BEFORE) : end + AFTER])
        first = Citation(cue, number, kind, target, container and " ".join(container.split()), doc and " ".join(doc.split()), None, start, end)
        listed: list[Citation] = []
        while member := scan.more(i):
            sign, further, j, i = member
            if sign == "to" and not listed and first.range_to is None:
                first = replace(first, range_to=further)
            else:
                listed.append(replace(first, number=further, range_to=None, start=scan.tokens[j][1], end=scan.tokens[j][2]))
        i = max(i, after)
        out += [first, *listed]
    return out
