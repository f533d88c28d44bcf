"""Predicate algebra: a predicate is a conjunction of conditions `property op value`.

A condition is a struct (prop, op, value, number, members); an empty predicate holds for everyone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONDITION = r"^\s*(\w+)\s*(<=|>=|==|!=|<|>|\bin\b)\s*(.+?)\s*$"


def conditions(text: Column) -> Column:
    """The parsed conditions of `a == 'x' && b > 5 && c in ['p', 'q']`; unreadable parts are dropped."""
    parts = F.filter(F.split(text, r"\s*(?:&&|\bAND\b)\s*"), lambda p: p.rlike(_CONDITION))

    def one(part: Column) -> Column:
        op, raw = F.regexp_extract(part, _CONDITION, 2), F.regexp_extract(part, _CONDITION, 3)
        bare = F.regexp_replace(raw, r"^['\"]|['\"]$", "")
        members = F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_replace(raw, r"[\[\]{}]", ""), r"\s*,\s*"), lambda m: F.regexp_replace(F.trim(m), r"^['\"]|['\"]$", ""))))
        return F.struct(
            F.regexp_extract(part, _CONDITION, 1).alias("prop"), op.alias("op"), bare.alias("value"),
            bare.try_cast("double").alias("number"), F.when(op == "in", members).otherwise(F.array(bare)).alias("members"),
        )

    return F.transform(parts, one)


def text_of(condition: Column) -> Column:
    """The one spelling of a condition."""
    quoted = lambda v: F.concat(F.lit("'"), v, F.lit("'"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(condition["members"], quoted), ", "), F.lit("]"))
    plain = F.when(condition["number"].isNotNull() | F.lower(condition["value"]).isin("true", "false"), F.lower(condition["value"])).otherwise(quoted(condition["value"]))
    return F.concat_ws(" ", condition["prop"], condition["op"], F.when(condition["op"] == "in", listed).otherwise(plain))


def normalised(conds: Column, implied: dict[str, str] | None = None) -> Column:
    """Sorted distinct spellings joined by &&, with the terms that `prop == true` implies."""
    texts = F.transform(conds, text_of)
    for prop, term in (implied or {}).items():
        texts = F.when(F.array_contains(texts, f"{prop} == true"), F.array_append(texts, F.lit(term))).otherwise(texts)
    return F.array_join(F.array_sort(F.array_distinct(texts)), " && ")


def implies_one(a: Column, b: Column) -> Column:
    """Condition a implies condition b."""
    same = text_of(a) == text_of(b)
    member = (a["op"] == "==") & (b["op"] == "in") & F.array_contains(b["members"], a["value"])
    subset = (a["op"] == "in") & (b["op"] == "in") & (F.size(F.array_except(a["members"], b["members"])) == 0)
    low = a["op"].isin(">", ">=") & b["op"].isin(">", ">=") & ((a["number"] > b["number"]) | (a["number"] == b["number"]) & ((a["op"] == ">") | (b["op"] == ">=")))
    high = a["op"].isin("<", "<=") & b["op"].isin("<", "<=") & ((a["number"] < b["number"]) | (a["number"] == b["number"]) & ((a["op"] == "<") | (b["op"] == "<=")))
    return F.coalesce((a["prop"] == b["prop"]) & (same | member | subset | low | high), F.lit(False))


def implies(a: Column, b: Column) -> Column:
    """Every condition of b follows from some condition of a."""
    return F.forall(b, lambda y: F.exists(a, lambda x: implies_one(x, y)))


def compared(a: Column, b: Column) -> Column:
    """identical, narrower (a within b), broader or unrelated."""
    ab, ba = implies(a, b), implies(b, a)
    return F.when(ab & ba, "identical").when(ab, "narrower").when(ba, "broader").otherwise("unrelated")


def contradictory(conds: Column) -> Column:
    """Two == conditions of one property with different values."""
    return F.exists(conds, lambda x: F.exists(conds, lambda y: (x["op"] == "==") & (y["op"] == "==") & (x["prop"] == y["prop"]) & (x["value"] != y["value"])))
