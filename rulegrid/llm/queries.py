"""The pN_ queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrid.llm import leakage, mixing, neighbours, pii
from rulegrid.plans.registry import Query
from rulegrid.runtime import table


def p6_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "source_clauses"))


def p6_neighbours(spark, d):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return neighbours.nearest(table(spark, d, "source_clauses"), asked=F.col("id") % 20 == 0)


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark, d):
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_selection(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return pii.mentions(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark, d):
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {
    "p6_found": Query(p6_found),
    "p6_neighbours": Query(p6_neighbours),
    "p7_found": Query(p7_found),
    "p7_items": Query(p7_items),
    "p8_found": Query(p8_found),
    "p8_selection": Query(p8_selection),
    "p8_shares": Query(p8_shares),
    "p9_found": Query(p9_found),
    "p9_redacted": Query(p9_redacted),
}
