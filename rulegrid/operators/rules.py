"""Rule expressions as columns: fingerprints and constraints of whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.functions.expressions import RuleError, fingerprint, leaves, parse
from rulegrid.operators.resolution import names


def plain_operators(expression: Column) -> Column:
    """The language's own spelling of connectives and comparison signs."""
    out = expression
    for other, own in (("&&", " AND "), (r"\|\|", " OR "), ("≤", "<="), ("≥", ">="), ("≠", "!=")):
        out = F.regexp_replace(out, other, own)
    return out


def _refs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["expression"]):
            try:
                rows += [(i, r) for r in dict.fromkeys(leaves(parse(text), "ref"))]
            except RuleError:
                pass
        yield pd.DataFrame(rows, columns=["id", "ref"])


_PRINT = "id int, canonical string, error string, identity_core string, full_core string, constraints array<struct<attribute_ids:array<int>,shape:string,op:string,value:double>>"


def _print(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, audience, pairs in zip(pdf["id"], pdf["expression"], pdf["audience_id"], pdf["ids"]):
            f = fingerprint(text, None if pd.isna(audience) else int(audience), dict(pairs) if pairs is not None else {})
            rows.append((i, f["canonical"], f["error"], f["identity_core"], f["full_core"], [{"attribute_ids": a, "shape": s, "op": o, "value": v} for a, s, o, v in f["constraints"]]))
        yield pd.DataFrame(rows, columns=["id", "canonical", "error", "identity_core", "full_core", "constraints"])


def fingerprints(rules: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, canonical, error, constraints, identity_hash, full_hash) of each rule's expression.

    References are resolved by category and name or alias; an unknown one stays by name. An expression the grammar
    does not accept has an error, no canonical form and the hash of its words. The hashing itself is built in.
    """
    kept = rules.where("rule_expression IS NOT NULL").groupBy("id").agg(F.min(F.struct("rule_expression", "audience_id")).alias("r"))
    texts = kept.select("id", "r.audience_id", plain_operators(F.col("r.rule_expression")).alias("expression"))
    refs = texts.select("id", "expression").mapInPandas(_refs, "id int, ref string")
    split = refs.select("id", "ref", F.lower(F.substring_index("ref", ".", 1)).alias("category"), F.lower(F.substring_index("ref", ".", -1)).alias("name"))
    known = split.join(names(attributes).withColumnRenamed("id", "attribute_id"), ["category", "name"])
    ids = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "attribute_id"))).alias("ids"))
    printed = texts.join(ids, "id", "left").select("id", "expression", F.col("audience_id").cast("double").alias("audience_id"), "ids").mapInPandas(_print, _PRINT)
    return printed.select("id", "canonical", "error", "constraints", F.sha2("identity_core", 256).alias("identity_hash"), F.sha2("full_core", 256).alias("full_hash"))
