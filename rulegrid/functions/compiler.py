"""Compiles a rule expression into one Spark Column, so that evaluation stays in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulegrid.functions.expressions import Tree, parse


def compile_rule(expression: str, columns: dict[str, Column], as_of: Column) -> Column:
    """True, false or null (a fact is missing, and the rest does not decide) of the expression over `columns`.

    Time since is whole days, months of the calendar rounded down, and years of twelve such months, up to `as_of`.
    """

    def time(name: str, start: Column, end: Column) -> Column:
        unit = name.split("_")[0]
        if unit == "days":
            return F.datediff(end, start)
        if unit == "hours":
            return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600)
        months = F.floor(F.months_between(end, start))
        return F.floor(months / 12) if unit == "years" else months

    def build(tree: Tree) -> Column:
        kind, head, children = tree
        if kind == "ref":
            return as_of if head == "today" else columns[head]
        if kind in ("num", "str", "bool"):
            return F.lit(head)
        if kind == "in":
            return build(children[0]).isin(*[c[1] for c in children[1][2]])
        args = [build(c) for c in children]
        if kind == "not":
            return ~args[0]
        if kind in ("and", "or"):
            whole = args[0]
            for a in args[1:]:
                whole = whole & a if kind == "and" else whole | a
            return whole
        if kind == "call":
            if head.endswith("_since"):
                return time(head, args[0], as_of)
            if head.endswith("_between"):
                return time(head, args[0], args[1])
            simple = {"exists": lambda a: a.isNotNull(), "abs": F.abs, "count": lambda *a: sum((x.isNotNull().cast("int") for x in a), F.lit(0)), "sum": lambda *a: sum(a[1:], a[0])}
            return simple[head](*args) if head in simple else (F.greatest if head == "max" else F.least)(*args)
        a, b = args
        return {"<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b, "==": a == b, "!=": a != b}[head] if kind == "cmp" else {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[head]

    return build(parse(expression))
