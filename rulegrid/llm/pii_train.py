"""Trains the tagger of rulegrid.llm.pii: python -m rulegrid.llm.pii_train DOCUMENTS NAME_LIST OUT [START [DOCS [EPOCHS]]]

The labelled spans come from a bounded sample of DOCS documents (the smallest hashes of doc_id): shapes label the
structured kinds, and pairs with a listed name label the names. In a second copy of each document with mentions these are
replaced by made-up ones of other forms (names, street words, places, mail domains, groupings of digits, patterns of
codes), so that the model learns where mentions stand and not only how the usual ones read. With START
training goes on from the weights in that file.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np

from rulegrid.llm import pii, tagger

DOCS, EPOCHS, SEED = 8000, 16, 11
#: Characters of a training window.
SIZE = 128
_SYLLABLES = "ar bel cor dan el fen gal har is jor kan lor mar nor ol par quil ras sel tor ur val wen yor zan thi mo ra ve lin da sto ri hal ken pra sha vi nu ta ka de su".split()


def label(text: str, listed: set[str]) -> list[tuple[str, int, int]]:
    """Spans of a text by shape and by listed names."""
    spans: list[tuple[str, int, int]] = []
    for kind in ("email", "id_number", "phone", "address"):
        for m in pii._SHAPES[kind].finditer(text):
            if (kind != "phone" or pii.phone_shaped(m[0])) and all(m.end() <= s or m.start() >= e for _, s, e in spans):
                spans.append((kind, m.start(), m.end()))
    for m in pii._SHAPES["person_name"].finditer(text):
        at = m.start() + (t.end() if (t := pii._TITLES.match(m[0])) else 0)
        end = m.end()
        words = [w for w in pii._WORD.finditer(text, at, end)]
        while words and words[0][0].rstrip(".").lower() not in listed and not (len(words) > 1 and words[1][0].rstrip(".").lower() in listed):
            words = words[1:]
        known = [i for i, w in enumerate(words) if w[0].rstrip(".").lower() in listed]
        if not known:
            continue
        last = known[-1]
        inverted = "," in text[words[0].start() : words[0].end() + 1]
        keep = words[: max(last + 1, min(len(words), 3 if len(words) > 1 and len(words[1][0].rstrip(".")) == 1 else 2))] if not inverted else words[:2]
        if any(pii._FIRM_WORD.fullmatch(w[0].rstrip(".")) for w in keep):
            continue
        if len({w[0].isupper() for w in keep if len(w[0].rstrip(".")) > 1}) > 1 and "," not in text[keep[0].start() : keep[-1].end()]:
            continue
        if len(keep) < 2 or "\n\n" in text[keep[0].start() : keep[-1].end()]:
            continue
        a, b = keep[0].start(), keep[-1].end()
        if keep[-1][0].endswith(".") and len(keep[-1][0]) > 2:
            b -= 1
        firm = pii._FIRM.match(text, b) or re.search(r"&[ \xa0]+$", text[max(0, a - 3) : a])
        if not firm and all(b <= s or a >= e for _, s, e in spans):
            spans.append(("person_name", a, b))
    return sorted(spans, key=lambda x: x[1])


def _made_up(rng: np.random.Generator, like: str) -> str:
    name = "".join(rng.choice(_SYLLABLES) for _ in range(int(rng.integers(2, 4)))).capitalize()
    return name.upper() if like.isupper() else name


def _code(rng: np.random.Generator) -> str:
    pattern = rng.choice(["AA999999", "999-999-999", "A99-99999", "9999 999 999", "AAA-9999-99", "99AA9999A9", "AA 99 99 99 A"])
    return "".join(chr(65 + rng.integers(26)) if c == "A" else str(rng.integers(10)) if c == "9" else c for c in pattern)


def _grouped(rng: np.random.Generator, digits: str) -> str:
    out, at, gap = "", 0, str(rng.choice([" ", "-", ".", "/", " - "]))
    while at < len(digits):
        n = int(rng.integers(2, 6))
        out += (gap if out else "") + digits[at : at + n]
        at += n
    return ("+" if rng.random() < 0.3 else "") + out


def made_up(kind: str, piece: str, rng: np.random.Generator) -> str:
    """Another mention of the kind, often in another form."""
    if kind == "person_name":
        return re.sub(r"[A-Za-z]{2,}", lambda m: _made_up(rng, m[0]), piece)
    if kind == "address":
        return re.sub(r"[A-Z][a-z]{2,}", lambda m: _made_up(rng, m[0]) if rng.random() < 0.6 else m[0], piece)
    if kind == "phone":
        return _grouped(rng, "".join(str(rng.integers(10)) for _ in range(int(rng.integers(9, 13))))) if rng.random() < 0.5 else re.sub(r"\d", lambda m: str(rng.integers(10)), piece)
    if kind == "id_number":
        return _code(rng) if rng.random() < 0.5 else re.sub(r"\d", lambda m: str(rng.integers(10)), piece)
    return re.sub(r"[A-Za-z]{3,}", lambda m: _made_up(rng, m[0]).lower() if m[0].lower() not in ("dot",) else m[0], piece)


def renamed(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with made-up mentions in place of its own, and its spans."""
    out, moved, at, size = [], [], 0, 0
    for kind, a, b in spans:
        out.append(text[at:a])
        size += a - at
        piece = made_up(kind, text[a:b], rng)
        out.append(piece)
        moved.append((kind, size, size + len(piece)))
        size += len(piece)
        at = b
    return "".join(out) + text[at:], moved


def windows(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), "i1")
    for kind, a, b in spans:
        k = pii.KINDS.index(kind)
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    codes = tagger.encode(text)
    grid, gold = [], []
    for s in range(0, max(1, len(text) - SIZE // 4), 3 * SIZE // 4):
        x, y = np.zeros(SIZE, "u1"), np.zeros(SIZE, "i1")
        piece = codes[s : s + SIZE]
        x[: len(piece)], y[: len(piece)] = piece, tags[s : s + SIZE]
        grid.append(x)
        gold.append(y)
    return np.array(grid), np.array(gold)


def main(documents: str, names: str, out: str, start: str | None = None, docs_: str = str(DOCS), epochs: str = str(EPOCHS)) -> None:
    import pandas as pd

    rng = np.random.default_rng(SEED)
    listed = set(pd.read_parquet(names)["token"].str.lower())
    docs = pd.read_parquet(documents, columns=["doc_id", "text"]).dropna().drop_duplicates()
    docs["h"] = [zlib.crc32(str(d).encode()) for d in docs["doc_id"]]
    docs = docs.sort_values(["h", "doc_id"]).head(int(docs_))
    xs, ys = [], []
    for text in docs["text"]:
        spans = label(text, listed)
        for t, s in ((text, spans), renamed(text, spans, rng)) if spans else ((text, spans),):
            if len(t):
                x, y = windows(t, s)
                full = y.any(1)
                pick = full | (rng.random(len(x)) < 0.1)
                xs.append(x[pick])
                ys.append(y[pick])
    x, y = np.concatenate(xs), np.concatenate(ys)
    print(len(docs), "documents", len(x), "windows", int(y.any(1).sum()), "with spans", flush=True)
    weights = tagger.train(x, y, pii.TAGS, int(epochs), batch=64, rate=4e-3 if start is None else 1.5e-3, start=pii.load(start) if start else None, said=lambda s: print(s, flush=True))
    np.savez_compressed(out, **{k: v.astype("f2") for k, v in weights.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
