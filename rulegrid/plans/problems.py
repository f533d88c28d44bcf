"""The pN_ queries of the general training-data problems."""

from __future__ import annotations

from rulegrid.operators import changes, hierarchy, history, orphans, units
from rulegrid.plans.registry import Query
from rulegrid.runtime import table

_TREES = """
RECURSIVE cur AS (
  SELECT id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, parent_id DESC NULLS LAST) AS rn FROM source_clauses) WHERE rn = 1
),
edge AS (SELECT c.id, c.parent_id FROM cur c JOIN cur p ON p.id = c.parent_id),
walk AS (SELECT id, parent_id AS spot FROM edge UNION SELECT w.id, e.parent_id FROM walk w JOIN edge e ON e.id = w.spot),
looped AS (SELECT id FROM walk WHERE id = spot),
caught AS (SELECT w.id, min(w.spot) AS cycle_id FROM walk w JOIN looped l ON l.id = w.spot GROUP BY w.id),
tree AS (
  SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM cur WHERE id NOT IN (SELECT id FROM edge) OR id IN (SELECT id FROM looped)
  UNION ALL
  SELECT e.id, t.root, t.depth + 1, t.path || '/' || e.id FROM tree t JOIN edge e ON e.parent_id = t.id WHERE e.id NOT IN (SELECT id FROM looped)
)
"""

P1_SQL = f"WITH {_TREES} SELECT id AS clause_id, cycle_id FROM caught"
P1_HIERARCHY_SQL = f"""
WITH {_TREES}, pairs AS (SELECT t.id, unnest(string_split(t.path, '/')) AS above FROM tree t),
sizes AS (SELECT CAST(above AS BIGINT) AS id, count(*) - 1 AS n_descendants FROM pairs GROUP BY above)
SELECT t.id, t.root, t.depth, s.n_descendants, c.cycle_id, t.path FROM tree t JOIN sizes s ON s.id = t.id LEFT JOIN caught c ON c.id = t.id
"""
P1_DESCENDANTS_SQL = f"""
WITH {_TREES}, pairs AS (SELECT id, depth, unnest(string_split(path, '/')) AS above, generate_subscripts(string_split(path, '/'), 1) AS pos FROM tree)
SELECT CAST(above AS BIGINT) AS ancestor_id, id AS descendant_id, depth + 1 - pos AS distance FROM pairs WHERE pos <= depth
"""

_LIVE = """
live AS (
  SELECT DISTINCT seq, lower(trim(identity_hash)) AS identity_hash, lower(trim(full_hash)) AS full_hash, lower(trim(verdict)) AS verdict,
         effective_from, payload, clause_id, obligation_id, audience_id
  FROM rule_assertions
  WHERE identity_hash IS NOT NULL AND lower(verdict) IN ('new', 'amendment', 'repeal')
    AND seq NOT IN (SELECT corrects_seq FROM rule_assertions WHERE corrects_seq IS NOT NULL)
),
based AS (
  SELECT *, sum(CASE WHEN verdict = 'amendment' THEN 0 ELSE 1 END) OVER w AS span,
         max(CASE WHEN verdict = 'amendment' THEN 0 ELSE 1 END) OVER (PARTITION BY identity_hash) AS any_base
  FROM live WINDOW w AS (PARTITION BY identity_hash ORDER BY effective_from, seq ROWS UNBOUNDED PRECEDING)
),
last_span AS (
  SELECT *, max(span) OVER (PARTITION BY identity_hash) AS top,
         first_value(verdict) OVER (PARTITION BY identity_hash, span ORDER BY effective_from, seq) AS opened
  FROM based
)
"""

P3_SQL = f"""
WITH {_LIVE}
SELECT identity_hash, full_hash FROM (
  SELECT identity_hash, full_hash, row_number() OVER (PARTITION BY identity_hash ORDER BY effective_from DESC, seq DESC) AS rn
  FROM last_span WHERE span = top AND opened = 'new' AND full_hash IS NOT NULL
) WHERE rn = 1
"""

#: The same as of a date: only rows that had arrived.
AS_BELIEVED_SQL = P3_SQL.replace("rule_assertions", "(SELECT * FROM rule_assertions WHERE created_at < TIMESTAMPTZ '2020-01-01 00:00:00+00')")

P3_STATE_SQL = f"""
WITH {_LIVE},
now_in_force AS (SELECT * FROM last_span WHERE span = top AND opened = 'new')
SELECT identity_hash, arg_max(full_hash, pos) AS full_hash, arg_max(clause_id, pos) FILTER (WHERE verdict = 'new' OR clause_id IS NOT NULL) AS clause_id,
       arg_max(obligation_id, pos) FILTER (WHERE verdict = 'new' OR obligation_id IS NOT NULL) AS obligation_id,
       arg_max(audience_id, pos) FILTER (WHERE verdict = 'new' OR audience_id IS NOT NULL) AS audience_id,
       CAST(min(effective_from) AS VARCHAR) AS in_force_from
FROM (SELECT *, row_number() OVER (PARTITION BY identity_hash ORDER BY effective_from, seq) AS pos FROM now_in_force)
GROUP BY identity_hash
"""
P3_STATE_SQL = P3_STATE_SQL.replace("arg_max(", "arg_max_null(")

_P4_KEYS = """
cites AS (
  SELECT DISTINCT u.id, u.state, u.created_at,
         coalesce(dockey(u.target_doc), (SELECT min(dockey(c.doc_id)) FROM source_clauses c WHERE c.id = u.from_clause_id), '') AS doc,
         coalesce(boxkey(u.target_container), '') AS box, nokey(u.target_clause_no) AS no
  FROM unresolved_citations u WHERE dockey(u.target_doc) IS NOT NULL OR nokey(u.target_clause_no) IS NOT NULL
),
parents AS (SELECT dockey(doc_id) AS doc, coalesce(boxkey(container), '') AS box, nokey(clause_no) AS no, citable, min(created_at) AS first_at FROM source_clauses GROUP BY ALL),
per_clause AS (SELECT doc, box, no, min(first_at) AS first_at FROM parents WHERE citable AND no IS NOT NULL GROUP BY ALL),
per_doc AS (SELECT doc, min(first_at) AS first_at FROM parents GROUP BY ALL),
per_run AS (SELECT DISTINCT dockey(doc_id) AS doc FROM ingestion_runs WHERE status = 'completed'),
judged AS (
  SELECT c.id AS citation_id, c.state, c.created_at, CASE WHEN c.no IS NULL THEN 'circular' ELSE 'clause' END AS target,
         CASE WHEN c.no IS NOT NULL AND k.doc IS NOT NULL THEN CASE WHEN k.first_at > c.created_at THEN 'late' END
              WHEN c.no IS NULL AND d.doc IS NOT NULL THEN CASE WHEN d.first_at > c.created_at THEN 'late' END
              WHEN d.doc IS NOT NULL THEN 'no_clause' WHEN r.doc IS NOT NULL THEN 'deleted' ELSE 'never' END AS kind
  FROM cites c LEFT JOIN per_clause k ON k.doc = c.doc AND k.box = c.box AND k.no = c.no LEFT JOIN per_doc d ON d.doc = c.doc LEFT JOIN per_run r ON r.doc = c.doc
)
"""


def _keyed(sql: str) -> str:
    """Writes out dockey(x), boxkey(x) and nokey(x); RE2 has no look-around, so zeros go by a captured neighbour."""
    import re

    labels = {"dockey": orphans.DOC_LABELS, "boxkey": orphans.CONTAINER_LABELS, "nokey": orphans.CLAUSE_LABELS}
    def out(m: "re.Match[str]") -> str:
        runs = rf"trim(regexp_replace(upper({m[2]}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        bare = rf"regexp_replace(regexp_replace({runs} || ' ', '^(({labels[m[1]]}) )+', ''), '^({labels[m[1]]})([0-9])', '\2')"
        return rf"nullif(trim(regexp_replace(' ' || {bare}, ' 0+([0-9])', ' \1', 'g')), '')"
    return re.sub(r"(dockey|boxkey|nokey)\(([\w.]+)\)", out, sql)


P4_SQL = _keyed(f"WITH {_P4_KEYS} SELECT citation_id, kind FROM judged WHERE kind IS NOT NULL")
P4_REPORT_SQL = _keyed(
    f"WITH {_P4_KEYS} SELECT target, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, kind, state, count(*) AS citations FROM judged WHERE kind IS NOT NULL GROUP BY ALL"
)

_P5_PARTS = """
readable AS (SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS doc FROM live WHERE effective_from IS NOT NULL),
nested AS (
  SELECT r.*, k.key AS outer_key, json_extract(doc, '$."' || k.key || '"') AS inner_doc
  FROM readable r, unnest(json_keys(doc)) AS k(key)
),
named AS (
  SELECT seq, identity_hash, lower(replace(outer_key, '_', '')) AS k, inner_doc AS v, 0 AS deep FROM nested
  UNION ALL
  SELECT n.seq, n.identity_hash, lower(replace(i.key, '_', '')), json_extract(inner_doc, '$."' || i.key || '"'), 1
  FROM nested n, unnest(json_keys(inner_doc)) AS i(key) WHERE json_type(inner_doc) = 'OBJECT'
),
spelled AS (
  SELECT seq, identity_hash, k, deep, trim(lower(CASE WHEN json_type(v) = 'NULL' THEN NULL ELSE v ->> '$' END)) AS t FROM named
  WHERE k IN ('limitvalue', 'limitunit', 'frequency', 'ownerdesk', 'severity')
),
fields AS (
  SELECT DISTINCT seq, identity_hash, k, CASE WHEN TRY_CAST(replace(t, ',', '') AS DOUBLE) IS NOT NULL THEN CAST(TRY_CAST(replace(t, ',', '') AS DOUBLE) AS VARCHAR) ELSE t END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY seq, identity_hash, k ORDER BY deep) AS rn FROM spelled) WHERE rn = 1
),
long AS (
  SELECT l.identity_hash, l.seq, l.effective_from, l.span, l.verdict, l.opened, f.k, f.k IS NOT NULL AS present, f.v
  FROM (SELECT DISTINCT identity_hash, seq, effective_from, span, verdict, opened FROM last_span WHERE effective_from IS NOT NULL) l
  CROSS JOIN (SELECT unnest(['limitvalue', 'limitunit', 'frequency', 'ownerdesk', 'severity']) AS name) n
  LEFT JOIN fields f ON f.seq = l.seq AND f.identity_hash = l.identity_hash AND f.k = n.name
)
"""

P5_SQL = f"""
WITH {_LIVE}, {_P5_PARTS},
wide AS (
  SELECT identity_hash, seq, effective_from, span, verdict, opened,
         max(CASE WHEN k = 'limitvalue' THEN coalesce(v, '-') END) AS a, max(CASE WHEN k = 'limitunit' THEN coalesce(v, '-') END) AS b, max(CASE WHEN k = 'frequency' THEN coalesce(v, '-') END) AS c,
         max(CASE WHEN k = 'ownerdesk' THEN coalesce(v, '-') END) AS d, max(CASE WHEN k = 'severity' THEN coalesce(v, '-') END) AS e
  FROM long GROUP BY ALL
),
filled AS (
  SELECT *, concat_ws('|', coalesce(last_value(a IGNORE NULLS) OVER w, '-'), coalesce(last_value(b IGNORE NULLS) OVER w, '-'), coalesce(last_value(c IGNORE NULLS) OVER w, '-'),
         coalesce(last_value(d IGNORE NULLS) OVER w, '-'), coalesce(last_value(e IGNORE NULLS) OVER w, '-')) AS version
  FROM wide WINDOW w AS (PARTITION BY identity_hash, span ORDER BY effective_from, seq ROWS UNBOUNDED PRECEDING)
),
daily AS (
  SELECT identity_hash, effective_from, CASE WHEN opened = 'new' THEN version END AS version
  FROM (SELECT *, row_number() OVER (PARTITION BY identity_hash, effective_from ORDER BY seq DESC) AS rn FROM filled) WHERE rn = 1
),
starts AS (
  SELECT * FROM (SELECT *, lag(version) OVER (PARTITION BY identity_hash ORDER BY effective_from) AS prior FROM daily) WHERE version IS DISTINCT FROM prior
),
spans AS (SELECT *, lead(effective_from) OVER (PARTITION BY identity_hash ORDER BY effective_from) AS until FROM starts)
SELECT identity_hash, strftime(effective_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(until, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM spans WHERE version IS NOT NULL
"""


_P5_FIELDS = ", ".join(f"nullif(regexp_replace(split_part(version, '|', {i}), '^(-?[0-9]+)\\.0$', '\\1'), '-') AS {n}" for i, n in enumerate(history.FIELDS, 1))
P5_HISTORY_SQL = P5_SQL.replace("AS valid_to FROM spans", f"AS valid_to, {_P5_FIELDS}, until IS NULL AS is_current FROM spans")


def _log(spark, d):
    return table(spark, d, "rule_assertions")


def _citations(spark, d):
    return table(spark, d, "unresolved_citations"), table(spark, d, "source_clauses"), table(spark, d, "ingestion_runs")


def p1_found(spark, d):
    trees = hierarchy.hierarchy(table(spark, d, "source_clauses"), with_paths=False)
    return trees.where("cycle_id IS NOT NULL").selectExpr("CAST(id AS INT) AS clause_id", "CAST(cycle_id AS INT) AS cycle_id")


def p1_hierarchy(spark, d):
    trees = hierarchy.hierarchy(table(spark, d, "source_clauses")).drop("entry", "exit")
    return trees.withColumns({c: trees[c].cast("int") for c in ("id", "root", "cycle_id")})


def p1_descendants(spark, d):
    pairs = hierarchy.closure(table(spark, d, "source_clauses"))
    return pairs.selectExpr("ancestor_id", "CAST(descendant_id AS INT) AS descendant_id", "CAST(distance AS BIGINT) AS distance")


def _limits(spark, d):
    return units.common_units(table(spark, d, "obligations"), table(spark, d, "attributes"))


def p2_found(spark, d):
    return _limits(spark, d).where("stated").select("obligation_id", "attribute_id", "common_value").distinct()


def p2_units(spark, d):
    return _limits(spark, d)


def p3_found(spark, d):
    return changes.in_force(_log(spark, d))


def p3_state(spark, d):
    state = changes.current_state(_log(spark, d), ["full_hash", "clause_id", "obligation_id", "audience_id"])
    return state.selectExpr("identity_hash", "lower(trim(full_hash)) AS full_hash", "clause_id", "obligation_id", "audience_id", "CAST(in_force_from AS STRING) AS in_force_from")


def p4_found(spark, d):
    return orphans.dangling(*_citations(spark, d)).select("citation_id", "kind")


def p4_report(spark, d):
    return orphans.dangling_report(*_citations(spark, d))


def p5_found(spark, d):
    return history.versions(_log(spark, d)).select("identity_hash", "valid_from", "valid_to")


def p5_history(spark, d):
    return history.versions(_log(spark, d))


QUERIES = {
    "p1_found": Query(p1_found, P1_SQL),
    "p1_hierarchy": Query(p1_hierarchy, P1_HIERARCHY_SQL),
    "p1_descendants": Query(p1_descendants, P1_DESCENDANTS_SQL),
    "p2_found": Query(p2_found),
    "p2_units": Query(p2_units),
    "p3_found": Query(p3_found, P3_SQL),
    "p3_state": Query(p3_state, P3_STATE_SQL),
    "p4_found": Query(p4_found, P4_SQL),
    "p4_report": Query(p4_report, P4_REPORT_SQL),
    "p5_found": Query(p5_found, P5_SQL),
    "p5_history": Query(p5_history, P5_HISTORY_SQL),
}
