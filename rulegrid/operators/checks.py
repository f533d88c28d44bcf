"""Checks of drafted rules: what a rule restates, how it uses exists(), what a verifier may correct, how sure it may be."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.operators.drafting import STOP_WORDS

#: Fixed value: the most confidence of a draft that a check has found wanting.
CAP = 0.4


def rewritten(rules: DataFrame) -> DataFrame:
    """(id, expression) with each whole word of `tokens` (a map of token to Category.name) put as [Category.name].

    One pass over the text, longest token first, so that nothing put in is read again; null expressions stay null."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, tokens in zip(pdf["expression"], pdf["tokens"]):
                names = dict(tokens) if tokens is not None else {}
                if text is not None and names:
                    pattern = r"\[[^\]]*\]|\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b"
                    text = re.sub(pattern, lambda m, names=names: f"[{names[m[0]]}]" if m[0] in names else m[0], text)
                out.append(text)
            yield pd.DataFrame({"id": pdf["id"], "expression": out})

    return rules.select("id", "expression", "tokens").mapInPandas(rewrite, "id int, expression string")


def exists_use(expression: Column, data_type: Column) -> tuple[Column, Column]:
    """(expression, needs_review) of `exists(x)` by the type of x: a boolean is compared with true, a date or number is for
    review, the rest is right as it is."""
    alone = r"exists\s*\(\s*(\[[\w.]+\]|\w+)\s*\)"
    uses = expression.rlike(alone)
    return F.when(uses & (data_type == "boolean"), F.regexp_replace(expression, alone, "$1 == true")).otherwise(expression), uses & F.coalesce(data_type.isin("date", "number"), F.lit(False))


def words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def restates(token: Column, title: Column) -> Column:
    """Every word of the token is one of the title, which has two at least: the rule says no more than its heading."""
    asked, told = words(F.regexp_replace(token, "_", " ")), words(title)
    return (F.size(asked) > 0) & (F.size(told) >= 2) & (F.size(F.array_except(asked, told)) == 0)


def corrected(expression: Column, verdict: Column, replacement: Column, pool: Column) -> tuple[Column, Column]:
    """(expression, outcome) after a verifier's verdict (justified, wrong, cannot_tell): a wrong number is replaced once, by
    one that stands in the text's pool; anything else is left with its outcome."""
    one = F.size(F.regexp_extract_all(expression, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"), F.lit(0))) == 1
    allowed = (verdict == "wrong") & replacement.isNotNull() & F.array_contains(pool, replacement.cast("double")) & one
    fixed = F.regexp_replace(expression, r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])", replacement)
    return F.when(allowed, fixed).otherwise(expression), F.when(verdict == "justified", "kept").when(allowed, "corrected").when(verdict == "wrong", "refused").otherwise("unsettled")


def capped(confidence: Column, *flags: Column) -> Column:
    """No more than CAP where any flag is true."""
    wanting = F.coalesce(flags[0], F.lit(False))
    for f in flags[1:]:
        wanting = wanting | F.coalesce(f, F.lit(False))
    return F.when(wanting, F.least(confidence, F.lit(CAP))).otherwise(confidence)
