"""Drafting without a model: rules, modifiers, definitions and preconditions read off a clause's text by fixed shapes.

All are built-in expressions over one text column; a shape that comes first in its list wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulegrid.operators.audiences import HEADING_PROPERTIES

#: Number words, stop words of slugs, lengths of titles, terms and meanings, and the confidence of a draft.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30}
STOP_WORDS = "a an and any at be by every for from in into is it its may must no not of on or shall should such that the their this to under which with".split()
TITLE, TERM_WORDS, MEANING, CONFIDENCE, SURE, BATCH = 140, 4, 200, 0.55, 0.75, 25
_N = r"(\d{1,4}|" + "|".join(NUMBERS) + ")"
PERIOD = rf"(?i)\b(?:once in every|once every|every) {_N} (day|month|year)s?\b"
WITHIN = rf"(?i)\b(?:within|not later than|no later than) {_N} (?:working |calendar |trading )?(day|hour|month)s?\b"
LEAST = r"(?i)\b(?:at least|not less than|a minimum of|minimum of) (?:rs\.? ?)?(\d[\d,]*(?:\.\d+)?)"
MOST = r"(?i)\b(?:at most|not more than|not exceeding|a maximum of|maximum of) (?:rs\.? ?)?(\d[\d,]*(?:\.\d+)?)"
TURNS = {r"(?i)\bhalf[- ]?year": 6, r"(?i)\bquarter(?:ly)?\b": 3, r"(?i)\bannual(?:ly)?\b|\byearly\b": 12}
EFFECTS = (
    ("exempt", r"(?i)\b(?:nothing in|notwithstanding) (?:clause|para) (\d+(?:\.\d+)*)"), ("restrict", r"(?i)\bsubject to (?:clause|para) (\d+(?:\.\d+)*)"),
    ("extend", r"(?i)\b(?:clause|para) (\d+(?:\.\d+)*) shall also apply"), ("override", r"(?i)\binstead of (?:clause|para) (\d+(?:\.\d+)*)"), ("restrict", r"(?i)\bread with (?:clause|para) (\d+(?:\.\d+)*)"),
)
DEFINES = r"\b([A-Z][A-Za-z]*(?: [A-Za-z]+){0,3}) means ([^.;]{1,200})"
LEAD_IN = r"(?i)\b(?:where|if|in case|for) (?:a|an|the|any|every)\b"
CLIENTS = r"(?i)\bmore than (\d[\d,]*) (?:active )?clients\b"


def number(text: Column) -> Column:
    """The whole number that digits or a number word stand for."""
    words = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return F.coalesce(text.try_cast("int"), F.try_element_at(words, F.lower(text)))


def slug(text: Column, words: int = 3) -> Column:
    """The first words of three letters or more that are no stop words, joined by underscores."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    return F.coalesce(F.nullif(F.array_join(F.slice(found, 1, words), "_"), F.lit("")), F.lit("duty"))


def title(text: Column) -> Column:
    return F.substring(F.regexp_extract(F.trim(text), r"^([^.;]*[.;]?)", 1), 1, TITLE)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def rule(text: Column) -> tuple[Column, Column]:
    """(expression, obligation type) of a clause's text: a period, a time limit, a turn of the calendar, a least or a most;
    evidence of it where none is told."""
    name = slug(text)
    since = F.concat(F.lower(_part(text, PERIOD, 2)), F.lit("s_since("), name, F.lit("_last_date) <= "), number(_part(text, PERIOD, 1)).cast("string"))
    between = F.concat(F.lower(_part(text, WITHIN, 2)), F.lit("s_between("), name, F.lit("_event_date, "), name, F.lit("_action_date) <= "), number(_part(text, WITHIN, 1)).cast("string"))
    turns = [F.when(text.rlike(p), F.concat(F.lit("months_since("), name, F.lit(f"_last_date) <= {n}"))) for p, n in TURNS.items()]
    bare = lambda p: F.regexp_replace(_part(text, p, 1), ",", "")
    least, most = F.concat(name, F.lit("_value >= "), bare(LEAST)), F.concat(name, F.lit("_value <= "), bare(MOST))
    told = F.coalesce(since, between, *turns, least, most)
    return F.coalesce(told, F.concat(F.lit("exists("), name, F.lit("_evidence)"))), F.when(told.isNull(), "attestable").otherwise("computable")


def modifier(text: Column) -> tuple[Column, Column]:
    """(effect, number of the clause it changes) by the first shape that the text has; null for none."""
    effect = F.coalesce(*[F.when(text.rlike(p), F.lit(e)) for e, p in EFFECTS])
    return effect, F.coalesce(*[_part(text, p, 1) for _, p in EFFECTS])


def firm_condition(text: Column) -> Column:
    """The condition on the firm that prose states; null where it states none."""
    clients = F.concat(F.lit("active_clients > "), F.regexp_replace(_part(text, CLIENTS, 1), ",", ""))
    return F.coalesce(clients, *[F.when(F.lower(text).contains(p), F.lit(c)) for p, c in HEADING_PROPERTIES.items()])


def precondition(text: Column) -> Column:
    """The firm's condition of a text that is led in by one (where, if, in case, for a ...); else null."""
    return F.when(text.rlike(LEAD_IN), firm_condition(text))


def definition(text: Column) -> tuple[Column, Column, Column]:
    """(term, meaning, whether it has arithmetic) of `X means Y`; null where there is none."""
    meaning = F.substring(F.trim(_part(text, DEFINES, 2)), 1, MEANING)
    return F.lower(F.replace(_part(text, DEFINES, 1), F.lit(" "), F.lit("_"))), meaning, meaning.rlike(r"(?i)[+*/]|\b(?:sum|difference|product|ratio|divided|less|plus|minus)\b")


def state(valid: Column, confidence: Column) -> Column:
    """ACTIVE for a readable expression of enough confidence, else REVIEW."""
    return F.when(valid & (confidence >= SURE), "ACTIVE").otherwise("REVIEW")
