"""Links between rules: what a citation names, the edges it gives, their grade, their admission and the retry of the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrid.operators.orphans import clause_key, container_key, doc_key
from rulegrid.runtime import checkpointed

#: Confidence of an edge by how its target was found, of one from a retry, and the attempts after which a
#: citation is given up.
CONFIDENCE = {"unique": 0.9, "container": 0.9, "scoped": 0.7, "ambiguous": 0.4}
RETRIED, ATTEMPTS = 0.8, 5
#: Types of which one target rule must be meant; the others link to every rule of the clauses named.
PRECISE = ("amends", "supersedes")


def keyed_clauses(clauses: DataFrame) -> DataFrame:
    """(id, doc, box, no) of the citable clauses with a number, by the keys of rulegrid.operators.orphans."""
    keys = clauses.where("citable").select("id", doc_key(F.col("doc_id")).alias("doc"), container_key(F.col("container")).alias("box"), clause_key(F.col("clause_no")).alias("no"))
    return keys.where("no IS NOT NULL").distinct()


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per id: of differing ones the least by these columns."""
    return rows.groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")


def keyed_citations(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """(citation_id, from_clause_id, from_obligation_id, type, state, attempts, doc, box, no); a null target_doc means the
    circular of from_clause_id."""
    homes = clauses.groupBy("id").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("d")).select(F.col("id").alias("from_clause_id"), doc_key(F.col("d")).alias("home"))
    cites = once(citations, "from_clause_id", "from_obligation_id", "edge_type", "state", "attempts", "target_doc", "target_container", "target_clause_no")
    return cites.join(homes, "from_clause_id", "left").select(
        F.col("id").alias("citation_id"), "from_clause_id", "from_obligation_id", F.col("edge_type").alias("type"), "state", "attempts",
        F.coalesce(doc_key(F.col("target_doc")), "home").alias("doc"), container_key(F.col("target_container")).alias("box"), clause_key(F.col("target_clause_no")).alias("no"),
    )


def resolved(citations: DataFrame, clauses: DataFrame, paths: DataFrame) -> DataFrame:
    """(citation_id, result, clause_id, candidates): the clause a citation with a number names.

    result: `container` or `unique` (the only one, with or without a container named), `scoped` (of several, the only one
    below the nearest ancestor of the citing clause that has any below it, the citing clause itself apart), `ambiguous`,
    `absent`, or `external` (no clause number). clause_id is null for the last three. paths: (id, path) with the ids from
    the root down, joined by slashes. Counts per key are aggregated before they are joined; only ambiguous citations are
    compared with the candidates of their number, by ancestor.
    """
    cites, keyed = keyed_citations(citations, clauses), checkpointed(keyed_clauses(clauses))
    targets = keyed.groupBy("doc", "box", "no").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("first"))
    found = cites.join(targets, ["doc", "box", "no"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    found = checkpointed(found)
    several = found.where("candidates > 1 AND from_clause_id IS NOT NULL")
    above = paths.select("id", F.posexplode(F.split("path", "/")).alias("depth", "ancestor"))
    asking = several.select("citation_id", "from_clause_id", "doc", "box", "no").join(above.withColumnRenamed("id", "from_clause_id"), "from_clause_id")
    below = keyed.join(several.select("doc", "box", "no").distinct(), ["doc", "box", "no"], "left_semi").join(above.drop("depth"), "id")
    near = asking.join(below, ["doc", "box", "no", "ancestor"]).where("id <> from_clause_id").groupBy("citation_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    scope = near.groupBy("citation_id").agg(F.max(F.struct("depth", "n", "one")).alias("s")).where("s.n = 1").select("citation_id", F.col("s.one").alias("scoped"))
    result = (
        F.when(F.col("no").isNull(), "external").when(F.col("candidates") == 0, "absent").when(F.col("candidates") == 1, F.when(F.col("box") != "", "container").otherwise("unique"))
        .when(F.col("scoped").isNotNull(), "scoped").otherwise("ambiguous")
    )
    return found.join(scope, "citation_id", "left").select(
        "citation_id", result.alias("result"), F.when(F.col("candidates") == 1, F.col("first")).otherwise(F.col("scoped")).alias("clause_id"),
        F.when(F.col("no").isNull(), 0).otherwise(F.col("candidates")).alias("candidates"),
    )


def proposed(citations: DataFrame, clauses: DataFrame, rules: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, parked) of citations as `resolved` found them.

    edges: citation_id, from_id, to_id, type, result, state, confidence. The rules a citation stands in are
    from_obligation_id or else all drawn from from_clause_id; a rule does not point at itself. depends_on and the other
    types that fan out link to all rules of the clause, of every clause where it is ambiguous, and are ACTIVE where the
    target is exact; amends and supersedes link to one rule, for REVIEW. parked: citation_id, reason - external, absent,
    no_source_rule, ambiguous, target_has_no_rules or target_not_precise, the first that holds.
    """
    cites = keyed_citations(citations, clauses).join(found, "citation_id")
    drawn = rules.where("source_clause_id IS NOT NULL").select("source_clause_id", F.col("id").alias("rule_id")).distinct()
    own = cites.where("from_obligation_id IS NOT NULL").select("citation_id", F.col("from_obligation_id").alias("from_id"))
    by_clause = cites.where("from_obligation_id IS NULL").join(drawn.withColumnsRenamed({"source_clause_id": "from_clause_id", "rule_id": "from_id"}), "from_clause_id").select("citation_id", "from_id")
    sources = own.unionByName(by_clause)
    exact = cites.where("clause_id IS NOT NULL").select("citation_id", "clause_id")
    spread = cites.where("result = 'ambiguous'").join(keyed_clauses(clauses).withColumnRenamed("id", "named"), ["doc", "box", "no"]).select("citation_id", F.col("named").alias("clause_id"))
    ends = exact.unionByName(spread).join(drawn.withColumnsRenamed({"source_clause_id": "clause_id", "rule_id": "to_id"}), "clause_id").select("citation_id", "to_id").distinct()
    counts = cites.select("citation_id", "type", "result").join(sources.groupBy("citation_id").agg(F.count(F.lit(1)).alias("sources")), "citation_id", "left").join(ends.groupBy("citation_id").agg(F.count(F.lit(1)).alias("targets")), "citation_id", "left")
    precise = F.coalesce(F.col("type").isin(*PRECISE), F.lit(False))
    reason = (
        F.when(F.col("result").isin("external", "absent"), F.col("result")).when(F.col("sources").isNull(), "no_source_rule").when(precise & (F.col("result") == "ambiguous"), "ambiguous")
        .when(F.col("targets").isNull(), "target_has_no_rules").when(precise & (F.col("targets") > 1), "target_not_precise")
    )
    judged = counts.withColumn("reason", reason)
    grade = F.col("result").isin("unique", "container") & ~precise
    confidence = F.try_element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("result"))
    edges = judged.where("reason IS NULL").join(sources, "citation_id").join(ends, "citation_id").where("from_id <> to_id")
    edges = edges.select("citation_id", "from_id", "to_id", "type", "result", F.when(grade, "ACTIVE").otherwise("REVIEW").alias("state"), confidence.alias("confidence"))
    return edges, judged.where("reason IS NOT NULL").select("citation_id", "reason")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of (from_id, to_id) is connected with, by hash-to-min with doubling.

    The rounds grow with the logarithm of the longest way; each moves one row per edge.
    """
    both = checkpointed(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"))).distinct())
    least = both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("component"))
    least = checkpointed(least)
    while True:
        around = both.join(least.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        jumped = least.join(least.select(F.col("id").alias("component"), F.col("component").alias("far")), "component", "left")
        now = jumped.join(around, "id", "left").select("id", F.least("component", "far", "near").alias("component"))
        now = checkpointed(now)
        if not now.join(least.withColumnRenamed("component", "was"), "id").where("component <> was").limit(1).count():
            return now
        least = now


def _reaches(out: dict[int, list[int]], start: int, goal: int) -> bool:
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        if x == goal:
            return True
        fresh = [y for y in out.get(x, ()) if y not in seen]
        seen.update(fresh)
        todo += fresh
    return False


def _admit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["first_citation", "from_id", "to_id"], ignore_index=True)
    pairs = list(zip(pdf["from_id"].tolist(), pdf["to_id"].tolist()))
    whole: dict[int, list[int]] = {}
    for a, b in pairs:
        whole.setdefault(a, []).append(b)
    taken: dict[int, list[int]] = {}
    admitted = []
    for a, b in pairs:
        admitted.append(not _reaches(taken, b, a))
        if admitted[-1]:
            taken.setdefault(a, []).append(b)
    return pd.DataFrame({"from_id": pdf["from_id"], "to_id": pdf["to_id"], "in_cycle": [_reaches(whole, b, a) for a, b in pairs], "admitted": admitted})


#: Rounds of trimming ahead of the exact decision.
TRIMS = 3


def admitted(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, type, first_citation, in_cycle, admitted): distinct edges without self-edges.

    edges: citation_id, from_id, to_id, type. in_cycle: the edge lies on a loop of depends_on edges. admitted: taken one
    at a time in the order of the first citation, then of the ends, a depends_on edge is refused if it would close a loop
    with those taken before; other types always are admitted. Rules without an edge in, or out, cannot lie on a loop and
    are trimmed TRIMS times; what is left is decided per connected component, which holds little but loops.
    """
    clean = checkpointed(edges.where("from_id <> to_id").groupBy("from_id", "to_id", "type").agg(F.min("citation_id").alias("first_citation")))
    left = clean.where("type = 'depends_on'").drop("type")
    for _ in range(TRIMS):
        ins, outs = left.select(F.col("to_id").alias("from_id")).distinct(), left.select(F.col("from_id").alias("to_id")).distinct()
        # Each round stands on a written table: its plan would otherwise hold the one before three times.
        left = checkpointed(left.join(ins, "from_id", "left_semi").join(outs, "to_id", "left_semi").select("from_id", "to_id", "first_citation"))
    verdict = left.limit(0).select("from_id", "to_id", F.lit(True).alias("in_cycle"), F.lit(True).alias("admitted"))
    if left.limit(1).count():
        placed = left.join(components(left).withColumnRenamed("id", "from_id"), "from_id")
        verdict = placed.groupBy("component").applyInPandas(_admit, "from_id int, to_id int, in_cycle boolean, admitted boolean")
    kept = verdict.withColumn("type", F.lit("depends_on"))
    return clean.join(kept, ["from_id", "to_id", "type"], "left").select("from_id", "to_id", "type", "first_citation", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce("admitted", F.lit(True)).alias("admitted"))


def swept(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """(citation_id, type, state, attempts, clause_id) of the pending citations after one more attempt.

    One clause of the number in the container named, or without one in any container, resolves a citation; else, and with
    ATTEMPTS attempts, it is abandoned. A citation of amends or supersedes with a single hit stays pending, as only
    depends_on edges come from a sweep.
    """
    pending = keyed_citations(citations, clauses).where("state = 'PENDING'")
    keyed = keyed_clauses(clauses)
    inside = keyed.groupBy("doc", "no", "box").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    anywhere = keyed.groupBy("doc", "no").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one")).withColumn("box", F.lit(""))
    hits = inside.where("box <> ''").unionByName(anywhere)
    tried = pending.join(hits, ["doc", "no", "box"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    held = single & F.coalesce(F.col("type").isin(*PRECISE), F.lit(False))
    state = F.when(held, "PENDING").when(single, "RESOLVED").when(F.col("attempts") >= ATTEMPTS, "ABANDONED").otherwise("PENDING")
    return tried.select("citation_id", "type", state.alias("state"), "attempts", F.when(state == "RESOLVED", F.col("one")).alias("clause_id"), "from_obligation_id")


def swept_edges(sweep: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): the depends_on edges that a sweep adds."""
    drawn = rules.where("source_clause_id IS NOT NULL").select(F.col("source_clause_id").alias("clause_id"), F.col("id").alias("to_id")).distinct()
    rows = sweep.where("state = 'RESOLVED' AND type = 'depends_on' AND from_obligation_id IS NOT NULL").join(drawn, "clause_id")
    return rows.where("from_obligation_id <> to_id").select(F.col("from_obligation_id").alias("from_id"), "to_id").distinct().withColumn("confidence", F.lit(RETRIED))


def shared_evidence(rules: DataFrame, least: int = 1) -> DataFrame:
    """(centre, rule_id): rules with exactly the same set of `least` or more attributes, linked to the smallest id of the group."""
    return _star(rules.where(F.size("attribute_ids") >= least).select("id", F.array_join(F.array_sort(F.array_distinct("attribute_ids")), ",").alias("key")))


def split_of(rules: DataFrame) -> DataFrame:
    """(centre, rule_id): rules drawn from one clause, linked to the smallest id of them."""
    return _star(rules.where("source_clause_id IS NOT NULL").select("id", F.col("source_clause_id").cast("string").alias("key")))


def _star(keyed: DataFrame) -> DataFrame:
    keyed = keyed.distinct()
    centres = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(centres, "key").where("id <> centre").select("centre", F.col("id").alias("rule_id"))
