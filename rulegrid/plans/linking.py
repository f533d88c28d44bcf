"""Queries of links between rules, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrid.operators import hierarchy, links
from rulegrid.plans.problems import _TREES, _keyed
from rulegrid.plans.registry import Query
from rulegrid.runtime import checkpointed, table


def _tables(spark, d):
    return table(spark, d, "unresolved_citations"), table(spark, d, "source_clauses")


def _paths(spark, d):
    return checkpointed(hierarchy.hierarchy(table(spark, d, "source_clauses")).select(F.col("id").cast("int").alias("id"), "path"))


def _resolved(spark, d):
    return links.resolved(*_tables(spark, d), _paths(spark, d))


def _proposed(spark, d):
    return links.proposed(*_tables(spark, d), table(spark, d, "obligations"), checkpointed(_resolved(spark, d)))


def lnk_resolve_target(spark, d):
    return _resolved(spark, d)


def lnk_propose(spark, d):
    return _proposed(spark, d)[0]


def lnk_parked(spark, d):
    return _proposed(spark, d)[1]


def lnk_grades(spark, d):
    edges = _proposed(spark, d)[0]
    return edges.groupBy("type", "result", "state", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_id").alias("rules"))


def lnk_admit_edges(spark, d):
    return links.admitted(_proposed(spark, d)[0])


def lnk_cycle_edges(spark, d):
    """Edges of loops in a graph with loops: rules that cite one another's clauses, and the citation's number back."""
    edges = _ring(spark, d)
    return links.admitted(edges).where("in_cycle").select("from_id", "to_id")


def _ring(spark, d):
    """Each rule points at the next rule of its clause, the last of every third clause at the first, and clauses at the next clause's first."""
    rules = table(spark, d, "obligations").where("source_clause_id IS NOT NULL").select("id", "source_clause_id").distinct()
    ends = rules.groupBy("source_clause_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    along = ends.where("low < high").select(F.col("low").alias("from_id"), F.col("high").alias("to_id"))
    back = ends.where("low < high AND source_clause_id % 3 = 0").select(F.col("high").alias("from_id"), F.col("low").alias("to_id"))
    over = ends.join(ends.select((F.col("source_clause_id") - 1).alias("source_clause_id"), F.col("low").alias("to_id")), "source_clause_id").select(F.col("high").alias("from_id"), "to_id")
    every = along.unionByName(back).unionByName(over).where("from_id <> to_id")
    return every.select(F.least("from_id", "to_id").alias("citation_id"), "from_id", "to_id", F.lit("depends_on").alias("type"))


def lnk_sweep(spark, d):
    return links.swept(*_tables(spark, d)).drop("from_obligation_id")


def lnk_sweep_edges(spark, d):
    return links.swept_edges(links.swept(*_tables(spark, d)), table(spark, d, "obligations"))


def lnk_shared_evidence(spark, d):
    return links.shared_evidence(table(spark, d, "obligations"))


def lnk_split_of(spark, d):
    return links.split_of(table(spark, d, "obligations"))


def lnk_report(spark, d):
    rows = links.once(table(spark, d, "unresolved_citations"), "edge_type", "state", "attempts")
    return rows.groupBy("edge_type", "state").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("attempts") >= 5).alias("worn_out"))


def lnk_waiting(spark, d):
    """The 25 targets that most pending citations wait for (a top-k report)."""
    rows = links.once(table(spark, d, "unresolved_citations"), "state", "target_doc", "target_container", "target_clause_no").where("state = 'PENDING'")
    counted = rows.groupBy("target_doc", "target_container", "target_clause_no").agg(F.count(F.lit(1)).alias("citations"))
    return counted.orderBy(F.desc("citations"), F.asc_nulls_first("target_doc"), F.asc_nulls_first("target_container"), F.asc_nulls_first("target_clause_no")).limit(25)


_KEYS = """
homes AS (SELECT id, arg_max(doc_id, (created_at, doc_id)) AS doc_id FROM source_clauses GROUP BY id),
cites AS (
  SELECT DISTINCT u.id AS citation_id, u.from_clause_id, u.from_obligation_id, u.edge_type AS type, u.state, u.attempts, coalesce(dockey(u.target_doc), dockey(h.doc_id)) AS doc, coalesce(boxkey(u.target_container), '') AS box, nokey(u.target_clause_no) AS no
  FROM unresolved_citations u LEFT JOIN homes h ON h.id = u.from_clause_id
),
keyed AS (SELECT DISTINCT id, dockey(doc_id) AS doc, coalesce(boxkey(container), '') AS box, nokey(clause_no) AS no FROM source_clauses WHERE citable AND nokey(clause_no) IS NOT NULL)
"""
_RESOLVE = _TREES.strip() + ",\n" + _keyed(_KEYS + """,
targets AS (SELECT doc, box, no, count(*) AS candidates, min(id) AS first FROM keyed GROUP BY ALL),
hit AS (SELECT c.*, coalesce(candidates, 0) AS candidates, first FROM cites c LEFT JOIN targets t ON t.doc = c.doc AND t.box = c.box AND t.no = c.no),
above AS (SELECT t.id, CAST(p.a AS INTEGER) AS ancestor, p.i AS depth FROM tree t, LATERAL (SELECT unnest(string_split(t.path, '/')) AS a, generate_subscripts(string_split(t.path, '/'), 1) AS i) p),
near AS (
  SELECT h.citation_id, a.depth, count(*) AS n, min(k.id) AS one FROM hit h JOIN above a ON a.id = h.from_clause_id
  JOIN keyed k ON k.doc = h.doc AND k.box = h.box AND k.no = h.no AND k.id <> h.from_clause_id JOIN above b ON b.id = k.id AND b.ancestor = a.ancestor WHERE h.candidates > 1 GROUP BY ALL
),
scope AS (SELECT citation_id, arg_max(n, depth) AS n, arg_max(one, depth) AS one FROM near GROUP BY 1),
resolved AS (
  SELECT h.citation_id, CASE WHEN h.no IS NULL THEN 'external' WHEN h.candidates = 0 THEN 'absent' WHEN h.candidates = 1 THEN CASE WHEN h.box <> '' THEN 'container' ELSE 'unique' END WHEN s.n = 1 THEN 'scoped' ELSE 'ambiguous' END AS result,
         CASE WHEN h.candidates = 1 THEN h.first WHEN s.n = 1 THEN s.one END AS clause_id, CASE WHEN h.no IS NULL THEN 0 ELSE h.candidates END AS candidates
  FROM hit h LEFT JOIN scope s ON s.citation_id = h.citation_id
)
""")
_PROPOSE = _RESOLVE + """,
drawn AS (SELECT DISTINCT source_clause_id, id AS rule_id FROM obligations WHERE source_clause_id IS NOT NULL),
sources AS (SELECT citation_id, from_obligation_id AS from_id FROM cites WHERE from_obligation_id IS NOT NULL UNION ALL SELECT c.citation_id, d.rule_id FROM cites c JOIN drawn d ON d.source_clause_id = c.from_clause_id WHERE c.from_obligation_id IS NULL),
named AS (SELECT citation_id, clause_id FROM resolved WHERE clause_id IS NOT NULL UNION ALL SELECT c.citation_id, k.id FROM cites c JOIN resolved r USING (citation_id) JOIN keyed k ON k.doc = c.doc AND k.box = c.box AND k.no = c.no WHERE r.result = 'ambiguous'),
ends AS (SELECT DISTINCT n.citation_id, d.rule_id AS to_id FROM named n JOIN drawn d ON d.source_clause_id = n.clause_id),
judged AS (
  SELECT c.citation_id, c.type, r.result, coalesce(c.type IN ('amends', 'supersedes'), false) AS precise,
         (SELECT count(*) FROM sources s WHERE s.citation_id = c.citation_id) AS ns, (SELECT count(*) FROM ends e WHERE e.citation_id = c.citation_id) AS nt
  FROM cites c JOIN resolved r USING (citation_id)
),
reasoned AS (
  SELECT *, CASE WHEN result IN ('external', 'absent') THEN result WHEN ns = 0 THEN 'no_source_rule' WHEN precise AND result = 'ambiguous' THEN 'ambiguous' WHEN nt = 0 THEN 'target_has_no_rules' WHEN precise AND nt > 1 THEN 'target_not_precise' END AS reason FROM judged
),
edges AS (
  SELECT citation_id, from_id, to_id, type, result, CASE WHEN result IN ('unique', 'container') AND NOT precise THEN 'ACTIVE' ELSE 'REVIEW' END AS state,
         CAST(CASE result WHEN 'scoped' THEN 0.7 WHEN 'ambiguous' THEN 0.4 ELSE 0.9 END AS DOUBLE) AS confidence
  FROM reasoned JOIN sources USING (citation_id) JOIN ends USING (citation_id) WHERE reason IS NULL AND from_id <> to_id
)
"""
_SWEEP = _keyed("WITH " + _KEYS + """,
boxed AS (SELECT doc, no, box, count(*) AS n, min(id) AS one FROM keyed WHERE box <> '' GROUP BY ALL UNION ALL SELECT doc, no, '', count(*), min(id) FROM keyed GROUP BY ALL),
tried AS (
  SELECT c.citation_id, c.type, c.from_obligation_id, coalesce(c.attempts, 0) + 1 AS attempts, coalesce(b.n, 0) = 1 AS single, b.one FROM cites c LEFT JOIN boxed b ON b.doc = c.doc AND b.no = c.no AND b.box = c.box WHERE c.state = 'PENDING'
),
swept AS (SELECT *, CASE WHEN single AND coalesce(type IN ('amends', 'supersedes'), false) THEN 'PENDING' WHEN single THEN 'RESOLVED' WHEN attempts >= 5 THEN 'ABANDONED' ELSE 'PENDING' END AS state FROM tried)
""")
_RING = """
WITH RECURSIVE r AS (SELECT DISTINCT id, source_clause_id AS c FROM obligations WHERE source_clause_id IS NOT NULL), e AS (SELECT c, min(id) AS low, max(id) AS high FROM r GROUP BY c),
g AS (SELECT low AS a, high AS b FROM e WHERE low < high UNION SELECT high, low FROM e WHERE low < high AND c % 3 = 0 UNION SELECT x.high, y.low FROM e x JOIN e y ON y.c = x.c + 1 WHERE x.high <> y.low),
w AS (SELECT a AS s, b AS t FROM g UNION SELECT w.s, g.b FROM w JOIN g ON g.a = w.t)
SELECT g.a AS from_id, g.b AS to_id FROM g JOIN w ON w.s = g.b AND w.t = g.a
"""

QUERIES = {
    "lnk_resolve_target": Query(lnk_resolve_target, f"WITH {_RESOLVE} SELECT * FROM resolved"),
    "lnk_propose": Query(lnk_propose, f"WITH {_PROPOSE} SELECT * FROM edges"),
    "lnk_parked": Query(lnk_parked, f"WITH {_PROPOSE} SELECT citation_id, reason FROM reasoned WHERE reason IS NOT NULL"),
    "lnk_grades": Query(lnk_grades, f"WITH {_PROPOSE} SELECT type, result, state, confidence, count(*) AS edges, count(DISTINCT from_id) AS rules FROM edges GROUP BY ALL"),
    "lnk_admit_edges": Query(lnk_admit_edges),
    "lnk_cycle_edges": Query(lnk_cycle_edges, _RING),
    "lnk_sweep": Query(lnk_sweep, f"{_SWEEP} SELECT citation_id, type, state, attempts, CASE WHEN state = 'RESOLVED' THEN one END AS clause_id FROM swept"),
    "lnk_sweep_edges": Query(lnk_sweep_edges, f"{_SWEEP} SELECT DISTINCT from_obligation_id AS from_id, o.id AS to_id, 0.8::DOUBLE AS confidence FROM swept JOIN obligations o ON o.source_clause_id = swept.one WHERE swept.state = 'RESOLVED' AND type = 'depends_on' AND from_obligation_id IS NOT NULL AND from_obligation_id <> o.id"),
    "lnk_shared_evidence": Query(lnk_shared_evidence, "WITH k AS (SELECT DISTINCT id, list_sort(list_distinct(attribute_ids)) AS key FROM obligations WHERE len(attribute_ids) >= 1), c AS (SELECT *, min(id) OVER (PARTITION BY key) AS centre FROM k) SELECT centre, id AS rule_id FROM c WHERE id <> centre"),
    "lnk_split_of": Query(lnk_split_of, "WITH k AS (SELECT DISTINCT id, source_clause_id FROM obligations WHERE source_clause_id IS NOT NULL), c AS (SELECT *, min(id) OVER (PARTITION BY source_clause_id) AS centre FROM k) SELECT centre, id AS rule_id FROM c WHERE id <> centre"),
    "lnk_report": Query(lnk_report, "WITH u AS (SELECT DISTINCT id, edge_type, state, attempts FROM unresolved_citations) SELECT edge_type, state, count(*) AS citations, count(*) FILTER (WHERE attempts >= 5) AS worn_out FROM u GROUP BY ALL"),
    "lnk_waiting": Query(lnk_waiting, "WITH u AS (SELECT DISTINCT id, target_doc, target_container, target_clause_no FROM unresolved_citations WHERE state = 'PENDING') SELECT target_doc, target_container, target_clause_no, count(*) AS citations FROM u GROUP BY ALL ORDER BY citations DESC, target_doc NULLS FIRST, target_container NULLS FIRST, target_clause_no NULLS FIRST LIMIT 25"),
}
