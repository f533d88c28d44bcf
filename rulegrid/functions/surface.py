"""Functions for SQL: register(spark) makes them known to a session under the names below.

parse_rule(text) -> struct(valid, error, canonical, functions, identifiers, literals); rule_nodes(text) and
citations_in(text) are table functions, used LATERAL; dot_product(a, b), cosine_distance(a, b) and jaccard(a, b)
are SQL functions, so they stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rulegrid.functions.citations import read_citations
from rulegrid.functions.expressions import RuleError, canonical, leaves, parse, written

_PARSED = "valid boolean, error string, canonical string, functions array<string>, identifiers array<string>, literals array<string>"


def _calls(tree) -> set[str]:
    return ({tree[1]} if tree[0] == "call" else set()).union(*map(_calls, tree[2])) if tree[2] or tree[0] == "call" else set()


@F.pandas_udf(_PARSED)
def parse_rule(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            tree = parse(text or "")
            rows.append((True, None, written(canonical(tree), {}), sorted(_calls(tree)), list(dict.fromkeys(leaves(tree, "ref"))), [str(v) for v in leaves(tree, "num", "str")]))
        except RuleError as e:
            rows.append((False, str(e), None, [], [], []))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


@F.udtf(returnType="node int, parent int, kind string, head string")
class RuleNodes:
    """The nodes of an expression's tree in the order of reading; none for a text that is no expression."""

    def eval(self, text: str) -> Iterator[tuple[int, int | None, str, str | None]]:
        try:
            todo = [(None, parse(text or ""))]
        except RuleError:
            return
        node = 0
        while todo:
            parent, (kind, head, children) = todo.pop()
            yield node, parent, kind, None if head is None else str(head)
            todo += [(node, c) for c in reversed(children)]
            node += 1


@F.udtf(returnType="cue string, number string, kind string, target string, container string, range_to string, char_start int, char_end int")
class CitationsIn:
    """The citations of a text, as rulegrid.operators.texts.citations."""

    def eval(self, text: str):
        for c in read_citations(text):
            yield c.cue, c.number, c.kind, c.target, c.container, c.range_to, c.start, c.end


#: name, parameters, type and body of the functions that are SQL themselves.
SQL_FUNCTIONS = (
    ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("cosine_distance", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN dot_product(a, a) > 0 AND dot_product(b, b) > 0 THEN 1 - dot_product(a, b) / (sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))) ELSE 1D END"),
    ("jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END"),
)


def register(spark: SparkSession) -> None:
    spark.udf.register("parse_rule", parse_rule)
    spark.udtf.register("rule_nodes", RuleNodes)
    spark.udtf.register("citations_in", CitationsIn)
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
