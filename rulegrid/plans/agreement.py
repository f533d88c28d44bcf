"""Queries of audiences and of the consistency of rules, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrid.functions import predicates
from rulegrid.operators import audiences, consistency, hierarchy, links
from rulegrid.plans.linking import _PROPOSE, _proposed
from rulegrid.plans.reference import _CURRENT, _WALKED, _current
from rulegrid.plans.registry import Query
from rulegrid.runtime import checkpointed, table

_CATS = ("stock_broker", "investment_adviser", "depository", "custodian")


def _register(spark, d):
    """(audience_id, predicate) of every audience that clauses or rules name; their predicates follow from the id by a rule."""
    ids = table(spark, d, "source_clauses").select("audience_id").union(table(spark, d, "obligations").select("audience_id")).where("audience_id IS NOT NULL").distinct()
    a = F.col("audience_id")
    cats = F.element_at(F.array(*map(F.lit, _CATS)), a % 4 + 1)
    text = F.concat(
        F.when(a % 7 != 0, F.concat(F.lit("category == '"), cats, F.lit("'"))).otherwise("regulator == 'sebi'"), F.when(a % 3 == 0, " && is_qsb == true").otherwise(""),
        F.when(a % 5 < 2, F.concat(F.lit(" && active_clients > "), (a * 100).cast("string"))).otherwise(""),
    )
    return ids.select("audience_id", text.alias("predicate"))


def _parsed(spark, d):
    """The register with its conditions, written once: an expression that is used several times would be read as often."""
    return checkpointed(_register(spark, d).select("audience_id", audiences.parsed(F.col("predicate")).alias("conditions")))


def aud_normalise(spark, d):
    normal = predicates.normalised(predicates.conditions(F.col("predicate")), audiences.IMPLIED)
    return _register(spark, d).select("audience_id", normal.alias("predicate"), F.sha2(normal, 256).alias("predicate_hash"))


def aud_lattice(spark, d):
    return audiences.relations(_parsed(spark, d))


def aud_overlaps(spark, d):
    return audiences.overlaps(_parsed(spark, d))


def aud_resolve(spark, d):
    """Each audience stated again in another order and spelling, or with a bound of its own, or with a property nobody knows."""
    a, p = F.col("audience_id"), F.col("predicate")
    other = F.when(a % 4 == 1, F.concat(p, F.lit(" AND aum > "), (a * 7).cast("string"))).when(a % 4 == 2, F.concat(p, F.lit(" && shoe_size > 4"))).otherwise(F.concat(p, F.lit(" AND "), p))
    return audiences.laddered(_register(spark, d).select(a.alias("key"), other.alias("predicate")), _register(spark, d))


def aud_compose(spark, d):
    """The audience of each clause with a parent, composed of its parent's and its own."""
    rows = _current(spark, d, "audience_id", "parent_id").where("audience_id IS NOT NULL AND parent_id IS NOT NULL")
    up = _current(spark, d, "audience_id").select(F.col("id").alias("parent_id"), F.col("audience_id").alias("above")).where("above IS NOT NULL")
    pairs = rows.join(up, "parent_id").groupBy("above", "audience_id").agg(F.count(F.lit(1)).alias("clauses"))
    own = _register(spark, d)
    both = pairs.join(own, "audience_id").join(own.withColumnsRenamed({"audience_id": "above", "predicate": "wider"}), "above")
    return audiences.composed(both, "wider", "predicate").select("above", "audience_id", "clauses", "composed", "refused")


def aud_promote(spark, d):
    """Rules whose context is a condition on the firm, promoted to an audience of their own: distinct pairs of audience and condition."""
    rows = table(spark, d, "obligations").where("audience_id IS NOT NULL AND context IS NOT NULL").select("id", "audience_id", "context").distinct()
    pairs = rows.groupBy("audience_id", "context").agg(F.count(F.lit(1)).alias("rules"))
    condition = audiences.heading_audience(F.col("context"))
    told = audiences.composed(pairs.withColumn("condition", condition).join(_register(spark, d), "audience_id"), "predicate", "condition")
    state = F.when(F.col("condition").isNull(), "REVIEW").when(F.col("refused"), "REFUSED").otherwise("PROMOTED")
    return told.select(state.alias("state"), "rules", F.when(state == "PROMOTED", F.col("composed")).alias("p")).groupBy("state").agg(F.count(F.lit(1)).alias("pairs"), F.sum("rules").alias("rules"), F.countDistinct("p").alias("audiences"))


def aud_document(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "title", F.substring("text", 1, 600).alias("opening")).distinct()
    return rows.groupBy(audiences.document_audience(F.col("title"), F.col("opening")).alias("predicate")).agg(F.count(F.lit(1)).alias("documents"))


def aud_heading_class(spark, d):
    rows = _current(spark, d, "heading").where("heading IS NOT NULL")
    return rows.groupBy("heading").agg(F.count(F.lit(1)).alias("clauses")).select("heading", "clauses", audiences.heading_audience(F.col("heading")).alias("conditions"))


def aud_vocabulary(spark, d):
    used = _parsed(spark, d).select(F.explode(F.transform("conditions", lambda c: c["prop"])).alias("property"))
    known = spark.createDataFrame([(p,) for p in audiences.PROPERTIES], "property string")
    return used.union(known).distinct()


def aud_floor(spark, d):
    """Every clause's audience: its own or its nearest ancestor's, else that of its circular's title clause (source C)."""
    held = hierarchy.inherited(table(spark, d, "source_clauses"), F.col("id"), F.col("audience_id")).select(F.col("id").cast("int").alias("id"), F.col("value").cast("int").alias("inherited"), "distance")
    rows = _current(spark, d, "doc_id", "audience_id", "is_title")
    floor = rows.where("is_title AND audience_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("audience_id", "id").alias("floor"))
    source = F.when(F.col("distance") == 0, "own").when(F.col("inherited").isNotNull(), "inherited").when(F.col("floor").isNotNull(), "C")
    return rows.join(held, "id").join(floor, "doc_id", "left").select("id", F.coalesce("inherited", "floor").alias("audience_id"), source.alias("source"))


def aud_tier(spark, d):
    thresholds = spark.createDataFrame([(s, r, least, t) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for r, least, t in ((1, -1e9, "small_size"), (2, 2000.0, "mid_size"), (3, 7000.0, "qualified"))], "type string, rank int, least double, tier string")
    firms = table(spark, d, "customer").select(F.col("c_custkey").alias("firm_id"), F.trim("c_mktsegment").alias("type"), F.col("c_acctbal").alias("size"))
    return audiences.tiered(firms, thresholds)


_REGISTER = """
ids AS (SELECT audience_id AS a FROM source_clauses WHERE audience_id IS NOT NULL UNION SELECT audience_id FROM obligations WHERE audience_id IS NOT NULL),
reg AS (
  SELECT a AS audience_id, CASE WHEN a % 7 <> 0 THEN ['stock_broker', 'investment_adviser', 'depository', 'custodian'][a % 4 + 1] END AS cat, a % 3 = 0 AS qsb, CASE WHEN a % 5 < 2 THEN a * 100 END AS clients FROM ids
),
terms AS (
  SELECT *, list_distinct(list_filter([cat, CASE WHEN qsb THEN 'stock_broker' END], lambda x: x IS NOT NULL)) AS cats, cat IS NULL AS sebi FROM reg
),
spelt AS (
  SELECT *, array_to_string(list_sort(list_filter([CASE WHEN clients IS NOT NULL THEN 'active_clients > ' || clients END, CASE WHEN cats[1] IS NOT NULL THEN 'category == ''' || cats[1] || '''' END,
         CASE WHEN cats[2] IS NOT NULL THEN 'category == ''' || cats[2] || '''' END, CASE WHEN qsb THEN 'is_qsb == true' END, CASE WHEN sebi THEN 'regulator == ''sebi''' END], lambda x: x IS NOT NULL)), ' && ') AS predicate FROM terms
)
"""
_IMPLIES = "(len(list_filter({b}.cats, lambda x: NOT list_contains({a}.cats, x))) = 0 AND ({a}.qsb OR NOT {b}.qsb) AND ({a}.sebi OR NOT {b}.sebi) AND ({b}.clients IS NULL OR coalesce({a}.clients >= {b}.clients, false)))"
_NARROWER = f"pairs AS (SELECT x.audience_id AS narrower, y.audience_id AS broader FROM spelt x JOIN spelt y ON x.audience_id <> y.audience_id WHERE {_IMPLIES.format(a='x', b='y')} AND NOT {_IMPLIES.format(a='y', b='x')})"
_NAMED = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({{t}}, '')), '\\b{name}s?\\b') THEN '{c}' END" for c, name in audiences.NAMES.items()) + "], lambda c: c IS NOT NULL))"
_HEADED = "CASE " + " ".join(f"WHEN contains(lower({{t}}), '{p}') THEN '{c}'" for p, c in audiences.HEADING_PROPERTIES.items()) + " ELSE CASE WHEN len(" + _NAMED + ") = 1 THEN 'category == ''' || " + _NAMED + "[1] || '''' END END"
_CAT_TEXT = "CASE WHEN len({c}) = 1 THEN 'category == ''' || {c}[1] || '''' WHEN len({c}) > 1 THEN 'category in [''' || array_to_string({c}, ''', ''') || ''']' END"
DOCUMENT_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, title, substr(text, 1, 600) AS opening FROM documents), n AS (SELECT *, {_NAMED.format(t='title')} AS bt, {_NAMED.format(t='opening')} AS bo FROM d),
p AS (SELECT CASE WHEN regexp_matches(title, '(?i)\bregulated entit(?:y|ies)\b') THEN 'regulator == ''sebi''' WHEN len(bt) > 0 THEN {_CAT_TEXT.format(c='bt')} WHEN coalesce(regexp_matches(opening, '(?i)\bregulated entit(?:y|ies)\b'), false) OR len(bo) >= 8 THEN 'regulator == ''sebi''' ELSE {_CAT_TEXT.format(c='bo')} END AS predicate FROM n)
SELECT predicate, count(*) AS documents FROM p GROUP BY 1
"""
FLOOR_SQL = _WALKED + """, stamp AS (SELECT id, audience_id, distance FROM (SELECT u.*, f.audience_id, row_number() OVER (PARTITION BY u.id ORDER BY u.distance) AS rn FROM up u JOIN full_rows f ON f.id = u.above WHERE f.audience_id IS NOT NULL) WHERE rn = 1),
floors AS (SELECT doc_id, arg_min(audience_id, id) AS floor FROM full_rows WHERE is_title AND audience_id IS NOT NULL GROUP BY 1)
SELECT t.id, coalesce(s.audience_id, g.floor) AS audience_id, CASE WHEN s.distance = 0 THEN 'own' WHEN s.audience_id IS NOT NULL THEN 'inherited' WHEN g.floor IS NOT NULL THEN 'C' END AS source
FROM tree t JOIN full_rows f ON f.id = t.id LEFT JOIN stamp s ON s.id = t.id LEFT JOIN floors g ON g.doc_id = f.doc_id
"""


# Consistency ---------------------------------------------------------------------------------------------------------
def _rules(spark, d):
    return table(spark, d, "obligations")


def _constraints(spark, d):
    """The constraints of the checked rules, read once."""
    rules = _rules(spark, d).where(F.col("state").isin(*consistency.CHECKED))
    return checkpointed(consistency.constraints(rules, table(spark, d, "attributes")))


def con_interval_build(spark, d):
    rows = _constraints(spark, d)
    return rows.select("rule_id", "attribute", "op", "value", F.nullif(F.col("lo"), F.lit(float("-inf"))).alias("lo"), F.nullif(F.col("hi"), F.lit(float("inf"))).alias("hi"), "lo_open", "hi_open")


def con_contradictions(spark, d):
    return consistency.conflicts(_constraints(spark, d))


def con_contradictions_overlap(spark, d):
    """With constraints of rules whose audiences overlap, not only of one audience."""
    return consistency.conflicts(_constraints(spark, d), audiences.overlaps(_parsed(spark, d)))


def con_dead_rules(spark, d):
    return consistency.dead_rules(_rules(spark, d), _constraints(spark, d), _parsed(spark, d))


def con_redundant_identity(spark, d):
    return consistency.redundant(_rules(spark, d))


def con_redundant_versions(spark, d):
    """Identities of the log under which more than one text was filed: the same grouping over rows that do repeat."""
    log = table(spark, d, "rule_assertions").select(F.col("clause_id").alias("id"), F.col("identity_hash"), F.lit("ACTIVE").alias("state")).where("id IS NOT NULL")
    return consistency.redundant(log)


def con_subsumption(spark, d):
    return consistency.subsumed(_constraints(spark, d), audiences.relations(_parsed(spark, d)))


def con_integrity(spark, d):
    edges = checkpointed(_proposed(spark, d)[0])
    loops = links.admitted(edges).where("in_cycle").select("from_id", "to_id", "in_cycle")
    marked = edges.select("from_id", "to_id", "type", "state").distinct().join(loops, ["from_id", "to_id"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    approved = _register(spark, d).where("audience_id % 4 <> 0").select("audience_id")
    return consistency.integrity(_rules(spark, d), table(spark, d, "source_clauses"), marked, approved)


def con_dangling_clauses(spark, d):
    known = table(spark, d, "source_clauses").select((F.col("id")).alias("clause_id")).distinct()
    rows = table(spark, d, "rule_assertions").select("seq", "clause_id").where("clause_id IS NOT NULL").distinct()
    return rows.join(known, "clause_id", "left_anti").groupBy("clause_id").agg(F.count(F.lit(1)).alias("assertions"))


def con_report_by_cause(spark, d):
    rows = _constraints(spark, d)
    found = consistency.conflicts(rows).select("rule_id", F.lit("contradiction").alias("cause"), "severity")
    dead = consistency.dead_rules(_rules(spark, d), rows, _parsed(spark, d))
    return consistency.rolled_up(found.unionByName(dead))


def con_not_checkable(spark, d):
    """Checked rules, those with a constraint and those without any, by type."""
    held = _constraints(spark, d).select(F.col("rule_id").alias("id")).distinct().withColumn("has", F.lit(True))
    rows = _rules(spark, d).where(F.col("state").isin(*consistency.CHECKED)).select("id", "obligation_type").distinct().join(held, "id", "left")
    return rows.groupBy("obligation_type").agg(F.count(F.lit(1)).alias("checked"), F.count_if("has").alias("with_constraints"), F.count_if(F.col("has").isNull()).alias("not_checkable"))


def sp_bound_merge(spark, d):
    return consistency.tightest(_constraints(spark, d))


def sp_bound_tighten(spark, d):
    """Strict bounds on order quantities and prices as closed ones: whole quantities tighten, prices do not."""
    rows = table(spark, d, "lineitem").select(F.explode(F.array(
        F.struct(F.lit("quantity").alias("property"), F.lit(">").alias("op"), F.col("l_quantity").cast("double").alias("value"), F.lit(True).alias("whole")),
        F.struct(F.lit("price").alias("property"), F.lit("<").alias("op"), F.round(F.col("l_extendedprice").cast("double") / 1000).alias("value"), F.lit(False).alias("whole")),
    )).alias("b")).select("b.*")
    op, value = consistency.tightened(F.col("value"), F.col("op"), F.col("whole"))
    return rows.select("property", op.alias("op"), value.alias("value")).groupBy("property", "op", "value").agg(F.count(F.lit(1)).alias("bounds"))


_INTEGRITY = f"""
WITH {_PROPOSE}, {_REGISTER}
SELECT 'no_source_span' AS kind, count(DISTINCT id) AS rules, min(id) AS first_rule FROM obligations WHERE coalesce(len(source_spans), 0) = 0
UNION ALL SELECT 'dangling_clause', count(DISTINCT id), min(id) FROM obligations WHERE source_clause_id IS NOT NULL AND source_clause_id NOT IN (SELECT id FROM source_clauses)
UNION ALL SELECT 'unapproved_audience', count(DISTINCT id), min(id) FROM obligations WHERE audience_id IS NOT NULL AND audience_id % 4 = 0
UNION ALL SELECT 'edge_into_superseded', count(DISTINCT o.id), min(o.id) FROM edges e JOIN obligations o ON o.id = e.to_id WHERE e.state = 'ACTIVE' AND o.state = 'SUPERSEDED'
UNION ALL SELECT 'depends_on_loop', count(DISTINCT a), min(a) FROM (WITH RECURSIVE g AS (SELECT DISTINCT from_id AS a, to_id AS b FROM edges WHERE type = 'depends_on'), w AS (SELECT a AS s, b AS t FROM g UNION SELECT w.s, g.b FROM w JOIN g ON g.a = w.t) SELECT DISTINCT s AS a FROM w WHERE s = t)
"""

QUERIES = {
    "aud_normalise": Query(aud_normalise, f"WITH {_REGISTER} SELECT audience_id, predicate, sha256(predicate) AS predicate_hash FROM spelt"),
    "aud_lattice": Query(aud_lattice, f"WITH {_REGISTER}, {_NARROWER} SELECT * FROM pairs"),
    "aud_overlaps": Query(aud_overlaps, f"WITH {_REGISTER}, {_NARROWER} SELECT narrower AS audience_id, broader AS other_id FROM pairs UNION SELECT broader, narrower FROM pairs UNION SELECT x.audience_id, y.audience_id FROM spelt x JOIN spelt y ON x.predicate = y.predicate AND x.audience_id <> y.audience_id"),
    "aud_resolve": Query(aud_resolve, f"WITH {_REGISTER}, h AS (SELECT predicate, min(audience_id) AS m FROM spelt GROUP BY 1) SELECT s.audience_id AS key, CASE s.audience_id % 4 WHEN 1 THEN 'created' WHEN 2 THEN 'refused' ELSE 'hash' END AS rung, CASE WHEN s.audience_id % 4 IN (0, 3) THEN h.m END AS audience_id FROM spelt s JOIN h USING (predicate)"),
    "aud_compose": Query(aud_compose, f"""WITH {_CURRENT}, {_REGISTER}, p AS (SELECT u.audience_id AS above, c.audience_id, count(*) AS clauses FROM cur c JOIN cur u ON u.id = c.parent_id WHERE c.audience_id IS NOT NULL AND u.audience_id IS NOT NULL GROUP BY ALL),
        b AS (SELECT p.*, list_sort(list_distinct(list_concat(string_split(x.predicate, ' && '), string_split(y.predicate, ' && ')))) AS ts FROM p JOIN spelt x ON x.audience_id = p.above JOIN spelt y ON y.audience_id = p.audience_id),
        r AS (SELECT *, len(list_filter(ts, lambda t: starts_with(t, 'category =='))) > 1 AS refused FROM b)
        SELECT above, audience_id, clauses, CASE WHEN NOT refused THEN array_to_string(ts, ' && ') END AS composed, refused FROM r"""),
    "aud_promote": Query(aud_promote),
    "aud_document": Query(aud_document, DOCUMENT_SQL),
    "aud_heading_class": Query(aud_heading_class, f"WITH {_CURRENT} SELECT heading, count(*) AS clauses, {_HEADED.format(t='heading')} AS conditions FROM cur WHERE heading IS NOT NULL GROUP BY heading"),
    "aud_vocabulary": Query(aud_vocabulary, "SELECT unnest([" + ", ".join(f"'{p}'" for p in audiences.PROPERTIES) + "]) AS property"),
    "aud_floor": Query(aud_floor, FLOOR_SQL),
    "aud_tier": Query(aud_tier, "SELECT c_custkey AS firm_id, CASE WHEN c_acctbal >= 7000 THEN 'qualified' WHEN c_acctbal >= 2000 THEN 'mid_size' ELSE 'small_size' END AS tier FROM customer"),
    "con_interval_build": Query(con_interval_build),
    "con_contradictions": Query(con_contradictions),
    "con_contradictions_overlap": Query(con_contradictions_overlap),
    "con_dead_rules": Query(con_dead_rules),
    "con_redundant_identity": Query(con_redundant_identity, "WITH r AS (SELECT DISTINCT id, lower(identity_hash) AS identity_hash FROM obligations WHERE identity_hash IS NOT NULL AND state IN ('ACTIVE', 'REVIEW')) SELECT identity_hash, count(*) AS rules, min(id) AS first_rule FROM r GROUP BY 1 HAVING count(*) > 1"),
    "con_redundant_versions": Query(con_redundant_versions, "WITH r AS (SELECT DISTINCT clause_id AS id, lower(identity_hash) AS identity_hash FROM rule_assertions WHERE identity_hash IS NOT NULL AND clause_id IS NOT NULL) SELECT identity_hash, count(*) AS rules, min(id) AS first_rule FROM r GROUP BY 1 HAVING count(*) > 1"),
    "con_subsumption": Query(con_subsumption),
    "con_integrity": Query(con_integrity, _INTEGRITY),
    "con_dangling_clauses": Query(con_dangling_clauses, "SELECT clause_id, count(*) AS assertions FROM (SELECT DISTINCT seq, clause_id FROM rule_assertions WHERE clause_id IS NOT NULL AND clause_id NOT IN (SELECT id FROM source_clauses)) GROUP BY 1"),
    "con_report_by_cause": Query(con_report_by_cause),
    "con_not_checkable": Query(con_not_checkable),
    "sp_bound_merge": Query(sp_bound_merge),
    "sp_bound_tighten": Query(sp_bound_tighten, "WITH b AS (SELECT 'quantity' AS property, '>=' AS op, CAST(l_quantity AS DOUBLE) + 1 AS value FROM lineitem UNION ALL SELECT 'price', '<', round(CAST(l_extendedprice AS DOUBLE) / 1000) FROM lineitem) SELECT property, op, value, count(*) AS bounds FROM b GROUP BY ALL"),
}
