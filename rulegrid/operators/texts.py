"""Text to structure: repeated lines, normative sentences, duplicates, numbers and citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.functions.citations import LINK_KINDS, LINKING, read_citations
from rulegrid.functions.quantities import SCALES, read_quantity
from rulegrid.functions.quantities import _WORDS as WORDS
from rulegrid.functions.quantities import _words_number as words_number

NORMATIVE = r"(?i)\b(?:shall|must|should|ought to|is required to|are required to|is directed to|may not)\b"
CUES = "paragraphs?|paras?|clauses?|points?|items?|regulations?|sections?|rules?|articles?|annexures?|schedules?|forms?|tables?"
PERIODS = {"half[- ]?yearly|semi[- ]?annual|once in each half year|every six months": (6, 180), "quarterly|every quarter|at the end of every quarter": (3, 90), "annual|yearly|every year": (1, 12, 360, 365), "monthly|every month": (1, 30), "weekly|every week": (1, 7), "daily|every day": (1,)}


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the non-blank lines, trimmed, whatever the line ends; numbered from 0 as they stand."""
    rows = documents.select("doc_id", "text").distinct()
    return rows.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw")).select("doc_id", "line_no", F.trim(F.regexp_replace("raw", r"[\s\x{a0}]+", " ")).alias("line")).where("line <> ''")


def repeated_lines(documents: DataFrame, least: int) -> DataFrame:
    """(shape, documents): line shapes (digits as #) that stand in at least `least` documents: headers and footers."""
    shape = F.regexp_replace(F.lower("line"), r"\d+", "#").alias("shape")
    return lines(documents).select(shape, "doc_id").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least)


def link_kind(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    out = None
    for kind, pattern in LINK_KINDS:
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return out.otherwise("reference")


def cited_numbers(text: Column) -> Column:
    """All `cue number` strings of a text, built in; lists after one cue are read by `citations`."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\b({CUES}) (\d+(\.\d+)*)"), F.lit(0))


_CITED = "id int, cue string, number string, kind string, target string, container string, target_doc string, range_to string, char_start int, char_end int"


def _cite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, c.cue, c.number, c.kind, c.target, c.container, c.target_doc, c.range_to, c.start, c.end) for i, t in zip(pdf["id"], pdf["text"]) for c in read_citations(t)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CITED.split(", ")])


def citations(clauses: DataFrame) -> DataFrame:
    """(id, cue, number, kind, target, container, target_doc, range_to, char_start, char_end) of each citation in the texts.

    `para 3 of Annexure B` and `Annexure B, para 3` are one citation with a container; `paras 4.1, 4.2 and 4.5` are
    three; `4.1 to 4.9` is one with 4.9 in range_to. Rows with a true `is_junk`, if there is such a column, and null
    texts have none; repeated rows count once.
    """
    kept = clauses.where("NOT coalesce(is_junk, false)") if "is_junk" in clauses.columns else clauses
    return kept.where("text IS NOT NULL").select("id", "text").distinct().mapInPandas(_cite, _CITED)


def citation_summary(cited: DataFrame) -> DataFrame:
    """(target, kind, citations, clauses, edge_candidates) of citations as above; candidates are internal and of a linking kind."""
    edge = (F.col("target") == "internal") & F.col("kind").isin(*LINKING)
    return cited.groupBy("target", "kind").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("id").alias("clauses"), F.count_if(edge).alias("edge_candidates"))


def number_pool(text: Column) -> Column:
    """Numbers a rule drawn from the text may use: those written in digits (references and years apart) and those that
    period phrases stand for; sorted, distinct."""
    low = F.lower(text)
    bare = F.regexp_replace(F.regexp_replace(low, rf"\b({CUES}|circular|no\.?|chapter|part) [0-9]+(\.[0-9]+)*", " "), r"\b(19|20)[0-9][0-9]\b", " ")
    digits = F.transform(F.regexp_extract_all(bare, F.lit(r"[0-9]+(,[0-9]{2,3})*(\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    pools = [digits] + [F.when(low.rlike(p), F.array(*[F.lit(float(v)) for v in vs])).otherwise(F.array().cast("array<double>")) for p, vs in PERIODS.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*pools))))


_NUMBER_WORD = "|".join(sorted([*WORDS, "hundred"], key=len, reverse=True))
_SPOKEN = re.compile(rf"(?<![\w.])(?:(\d[\d,]*(?:\.\d+)?|\.\d+)|((?:{'|'.join(sorted(WORDS, key=len, reverse=True))})(?:(?:[\s-]+|\s+and\s+)(?:{_NUMBER_WORD}))*)\b)(?:[\s-]*({'|'.join(sorted(SCALES, key=len, reverse=True))})\b)?(?:\s*(%|per ?cent\b))?")


def spoken_numbers(text: str, pool: bool = False) -> list[float]:
    """Numbers in digits or words, times the scale beside them. For a pool also without the scale, and percents as shares."""
    found = []
    for digits, words, scale, percent in _SPOKEN.findall(text.lower()):
        number = float(digits.replace(",", "")) if digits else words_number(words)[0]
        found.append(number * SCALES[scale] if scale else number)
        if pool:
            found += [number] * bool(scale) + [found[-1] / 100] * bool(percent)
    return sorted(set(found))


def rule_literals(expression: str) -> list[float]:
    """The numbers of a rule, without names in brackets and without strings that are not quantities."""
    keep = lambda m: m[0][1:-1] if m[0][0] != "[" and read_quantity(m[0][1:-1]) else " "
    return spoken_numbers(re.sub(r"\[[^\]]*\]|'[^']*'|\"[^\"]*\"", keep, expression))


def _fidelity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["id", "text"]].assign(literals=[rule_literals(x) for x in pdf["rule_expression"]], spoken=[spoken_numbers(x, pool=True) for x in pdf["text"]])


def fidelity(rules: DataFrame) -> DataFrame:
    """(id, unexplained): the literals of each rule that its clause's text does not account for.

    rules: id, rule_expression, text. Numbers may be in digits or words and scaled on either side. Text of `attest:`
    rules is no computable rule; null expressions or texts give nothing.
    """
    computable = rules.where("text IS NOT NULL AND NOT lower(ltrim(rule_expression)) LIKE 'attest%'").select("id", "rule_expression", "text")
    read = computable.mapInPandas(_fidelity, "id int, text string, literals array<double>, spoken array<double>")
    return read.select("id", unexplained(F.col("literals"), F.array_union(number_pool(F.col("text")), F.col("spoken"))).alias("unexplained"))


def unexplained(literals: Column, pool: Column) -> Column:
    """The literals that neither are 0 or 1, nor stand in the pool, nor are a unit's multiple of a number that does."""
    factors = (24.0, 7.0, 30.0, 12.0, 360.0, 365.0, 1 / 24, 1 / 7, 1 / 30, 1 / 12)
    near = lambda x, y: F.abs(x - y) < 1e-6
    explained = lambda x: near(x, F.lit(0.0)) | near(x, F.lit(1.0)) | F.exists(pool, lambda n: near(x, n) | F.exists(F.array(*[F.lit(f) for f in factors]), lambda f: near(x, n * f)))
    return F.filter(literals, lambda x: ~explained(x))


#: Patterns of rules that hold whatever the facts.
VACUOUS = (
    r"\b(?:days|months|years)_since\([^)]*\)\s*>=\s*0(?![\d.])", r"\bcount\([^)]*\)\s*>=\s*0(?![\d.])",
    r"(\[[\w.]+\])\s*(?:==|<=|>=)\s*\1(?![\w.])", r"exists\((\[[\w.]+\])\)\s*(?:==|>=|<=)\s*exists\(\1\)",
)


def vacuous(expression: Column) -> Column:
    """The expression has a part that is true of anything."""
    out = F.lit(False)
    for pattern in VACUOUS:
        out = out | expression.rlike(pattern)
    return out


def own_multiple(expression: Column) -> Column:
    """The expression compares an attribute with a multiple of itself."""
    return expression.rlike(r"(\[[\w.]+\])\s*(?:==|!=|<=|>=|<|>|≤|≥|≠)\s*\d+(?:\.\d+)?\s*\*\s*\1")


def without_number(expression: Column, value: Column) -> tuple[Column, Column]:
    """(expression with its only number replaced by value, note): left as it is, with a note, unless it has exactly one."""
    numbers = F.regexp_extract_all(expression, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"), F.lit(0))
    one = F.size(numbers) == 1
    return F.when(one, F.regexp_replace(expression, r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])", value)).otherwise(expression), F.when(~one, F.concat(F.lit("has "), F.size(numbers).cast("string"), F.lit(" numbers")))
