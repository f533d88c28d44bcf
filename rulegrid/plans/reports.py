"""Queries of drafting, checks, evaluation, filing lanes, integrity and reports, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulegrid.operators import audiences, checks, drafting, evaluation, filing, links, texts
from rulegrid.plans.agreement import _IMPLIES, _REGISTER
from rulegrid.plans.agreement import _register as _audiences
from rulegrid.plans.linking import _KEYS
from rulegrid.plans.problems import _keyed
from rulegrid.plans.reference import _CURRENT, _current, _register, _rules
from rulegrid.plans.registry import Query
from rulegrid.runtime import table


def _clauses(spark, d):
    return _current(spark, d, "doc_id", "text").where("text IS NOT NULL")


# Drafting ------------------------------------------------------------------------------------------------------------
def drf_rules(spark, d):
    expression, kind = drafting.rule(F.col("text"))
    return _clauses(spark, d).select("id", expression.alias("expression"), kind.alias("obligation_type"), drafting.title(F.col("text")).alias("title"))


def drf_modifiers(spark, d):
    rows = table(spark, d, "unresolved_citations").select("id", "raw_text").distinct()
    effect, target = drafting.modifier(F.col("raw_text"))
    return rows.select("id", effect.alias("effect"), target.alias("target")).where("effect IS NOT NULL")


def drf_conditions(spark, d):
    rows = _rules(spark, d).where("context IS NOT NULL").select("id", "context").distinct()
    return rows.groupBy("context").agg(F.count(F.lit(1)).alias("rules")).select("context", "rules", drafting.firm_condition(F.col("context")).alias("condition"), drafting.precondition(F.col("context")).alias("precondition"))


def drf_definitions(spark, d):
    """Definitions in documents; the register's descriptions are put as definitions beside them."""
    told = _register(spark, d).select(F.concat(F.initcap(F.replace("canonical_name", F.lit("_"), F.lit(" "))), F.lit(" means "), "description").alias("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("text").distinct().unionByName(told)
    term, meaning, arithmetic = drafting.definition(F.col("text"))
    found = rows.select(term.alias("term"), meaning.alias("meaning"), arithmetic.alias("has_arithmetic")).where("term IS NOT NULL")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("times"), F.min("meaning").alias("meaning"), F.bool_or("has_arithmetic").alias("has_arithmetic"))


def drf_batches(spark, d):
    """Clauses of a circular in batches of BATCH for one drafting call each."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1
    rows = _clauses(spark, d).select("id", "doc_id", F.floor(at / drafting.BATCH).cast("int").alias("batch"))
    return rows.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("windows"), F.min("id").alias("first_id"))


def drf_cross_check(spark, d):
    """Modifiers whose target is, or is not, among the numbers cited in the same text."""
    rows = table(spark, d, "unresolved_citations").select("id", "raw_text").distinct()
    effect, target = drafting.modifier(F.col("raw_text"))
    cited = F.regexp_extract_all("raw_text", F.lit(r"(?:clause|para) (\d+(?:\.\d+)*)"), F.lit(1))
    found = rows.select(effect.alias("effect"), target.alias("target"), cited.alias("cited")).where("effect IS NOT NULL")
    return found.groupBy("effect", F.array_contains("cited", F.col("target")).alias("confirmed")).agg(F.count(F.lit(1)).alias("modifiers"))


def drf_states(spark, d):
    """Rules by the state that a draft of them would get."""
    from rulegrid.operators.rules import fingerprints

    valid = fingerprints(_rules(spark, d), table(spark, d, "attributes")).select("id", F.col("error").isNull().alias("valid"))
    rows = links.once(_rules(spark, d), "confidence", "state").join(valid, "id")
    return rows.groupBy(drafting.state(F.col("valid"), F.col("confidence")).alias("drafted"), "state").agg(F.count(F.lit(1)).alias("rules"))


def drf_outcomes(spark, d):
    """What drafting makes of each clause: a modifier, a definition, a rule with a precondition, a rule, or nothing."""
    effect, _ = drafting.modifier(F.col("text"))
    term, _, _ = drafting.definition(F.col("text"))
    outcome = F.when(effect.isNotNull(), "modifier").when(term.isNotNull(), "definition").when(drafting.precondition(F.col("text")).isNotNull(), "precondition rule").when(F.col("text").rlike(texts.NORMATIVE), "rule").otherwise("decline")
    return _clauses(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("clauses"))


_WORDS = "CASE lower({t}) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in drafting.NUMBERS.items()) + " END"
_SLUG = "coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower({t}), '[a-z]{{3,}}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in drafting.STOP_WORDS) + "], w))[1:3], '_'), ''), 'duty')"
_X = lambda p, g, t="text": f"nullif(regexp_extract({t}, '{p}', {g}), '')"
_NUM = lambda p, t="text": f"coalesce(TRY_CAST({_X(p, 1, t)} AS INTEGER), {_WORDS.format(t=_X(p, 1, t))})"
_TURNS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN 'months_since(' || slug || '_last_date) <= {n}' END" for p, n in drafting.TURNS.items())
DRAFT_SQL = rf"""
WITH {_CURRENT}, s AS (SELECT id, text, {_SLUG.format(t='text')} AS slug FROM cur WHERE text IS NOT NULL),
e AS (SELECT id, text, slug, coalesce(lower({_X(drafting.PERIOD, 2)}) || 's_since(' || slug || '_last_date) <= ' || {_NUM(drafting.PERIOD)}, lower({_X(drafting.WITHIN, 2)}) || 's_between(' || slug || '_event_date, ' || slug || '_action_date) <= ' || {_NUM(drafting.WITHIN)}, {_TURNS},
  slug || '_value >= ' || replace({_X(drafting.LEAST, 1)}, ',', ''), slug || '_value <= ' || replace({_X(drafting.MOST, 1)}, ',', '')) AS told FROM s)
SELECT id, coalesce(told, 'exists(' || slug || '_evidence)') AS expression, CASE WHEN told IS NULL THEN 'attestable' ELSE 'computable' END AS obligation_type, substr(regexp_extract(trim(text), '^([^.;]*[.;]?)', 1), 1, 140) AS title FROM e
"""
_EFFECT = lambda t: "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{e}'" for e, p in drafting.EFFECTS) + " END"
_TARGET = lambda t: "coalesce(" + ", ".join(_X(p, 1, t) for _, p in drafting.EFFECTS) + ")"
_FIRM = lambda t: f"coalesce('active_clients > ' || replace({_X(drafting.CLIENTS, 1, t)}, ',', ''), " + ", ".join(f"CASE WHEN contains(lower({t}), '{p}') THEN '{c}' END" for p, c in audiences.HEADING_PROPERTIES.items()) + ")"


# Checks --------------------------------------------------------------------------------------------------------------
def exp_restates_title(spark, d):
    rows = _rules(spark, d).where("rule_expression IS NOT NULL").select("id", "title", "rule_expression").distinct()
    token = F.regexp_extract("rule_expression", r"\[\w+\.(\w+)\]", 1)
    told = F.concat_ws(" ", "title", F.when(F.col("id") % 4 == 0, F.replace(token, F.lit("_"), F.lit(" "))))
    return rows.where(token != "").where(checks.restates(token, told)).select("id", token.alias("token"))


def exp_exists_use(spark, d):
    """Each entry of the register in an exists(): what its type makes of that."""
    rows = _register(spark, d).select("id", "data_type", F.concat(F.lit("exists(["), "category", F.lit("."), "canonical_name", F.lit("])")).alias("e"))
    expression, review = checks.exists_use(F.col("e"), F.lower(F.trim("data_type")))
    return rows.select("id", expression.alias("expression"), review.alias("needs_review"))


def exp_confidence(spark, d):
    """Confidence after the checks: vacuous rules, and those whose text is their own heading, may not be sure."""
    rows = _rules(spark, d).where("rule_expression IS NOT NULL").select("id", "rule_expression", F.col("confidence").cast("decimal(9,3)").cast("double").alias("confidence"), "attribute_ids").distinct()
    after = checks.capped(F.col("confidence"), texts.vacuous(F.col("rule_expression")), F.size("attribute_ids") == 0)
    return rows.groupBy((after < F.col("confidence")).alias("capped")).agg(F.count(F.lit(1)).alias("rules"), F.round(F.sum(after), 3).alias("confidence"))


def exp_corrections(spark, d):
    """A verifier's verdict by id, with another number each, against the numbers of the clause's text."""
    rows = links.once(_rules(spark, d).where("rule_expression IS NOT NULL"), "rule_expression", "source_clause_id").join(_clauses(spark, d).select(F.col("id").alias("source_clause_id"), "text"), "source_clause_id")
    verdict = F.element_at(F.array(*map(F.lit, ("justified", "wrong", "cannot_tell", "wrong"))), F.col("id") % 4 + 1)
    pool = texts.number_pool(F.col("text"))
    other = F.when(F.col("id") % 4 == 1, F.try_element_at(pool, F.lit(1)).cast("decimal(20,2)").cast("string")).otherwise("98765")
    expression, outcome = checks.corrected(F.col("rule_expression"), verdict, other, pool)
    return rows.select(outcome.alias("outcome"), (expression != F.col("rule_expression")).alias("changed")).groupBy("outcome", "changed").agg(F.count(F.lit(1)).alias("rules"))


def exp_rule_audience(spark, d):
    """The audience a rule is fingerprinted with: its own, else its clause's, else none."""
    rows = links.once(_rules(spark, d), "audience_id", "source_clause_id")
    clause = _current(spark, d, "audience_id").select(F.col("id").alias("source_clause_id"), F.col("audience_id").alias("by_clause"))
    source = F.when(F.col("audience_id").isNotNull(), "own").when(F.col("by_clause").isNotNull(), "clause").otherwise("none")
    return rows.join(clause, "source_clause_id", "left").select("id", F.coalesce("audience_id", "by_clause").alias("audience_id"), source.alias("source"))


def exp_rewrite(spark, d):
    """Expressions with their names in brackets taken out and put back: what comes back differs nowhere."""
    rows = links.once(_rules(spark, d).where("rule_expression IS NOT NULL AND NOT lower(rule_expression) LIKE 'attest%'"), "rule_expression")
    found = F.array_distinct(F.regexp_extract_all("rule_expression", F.lit(r"\[(\w+\.\w+)\]"), F.lit(1)))
    token = lambda n: F.concat(F.lit("tok_"), F.replace(n, F.lit("."), F.lit("_")))
    bare = F.aggregate(found, F.col("rule_expression"), lambda s, n: F.replace(s, F.concat(F.lit("["), n, F.lit("]")), token(n)))
    asked = rows.select("id", bare.alias("expression"), F.map_from_arrays(F.transform(found, token), found).alias("tokens"), "rule_expression")
    back = checks.rewritten(asked.select("id", "expression", "tokens")).withColumnRenamed("expression", "back")
    return asked.join(back, "id").groupBy((F.col("back") == F.col("rule_expression")).alias("same"), F.size("tokens").alias("names")).agg(F.count(F.lit(1)).alias("rules"))


# Evaluation ----------------------------------------------------------------------------------------------------------
_AS_OF = "1998-08-02"
RULES = {"large": "[Order.total] >= 50000", "fresh": "days_since([Order.date]) <= 400", "open": "NOT [Order.status] == 'F'"}
CHANGED = {**RULES, "large": "[Order.total] >= 150000"}


def _firms(spark, d):
    """Each customer with the facts of its last order; without one they are missing."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct(F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").cast("double").alias("total"), F.trim("o_orderstatus").alias("status_"))).alias("o"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.trim("c_mktsegment").alias("segment")).join(last, "c_custkey", "left").select(F.col("c_custkey").alias("firm"), F.col("c_nationkey").alias("area"), "segment", "o.date", "o.total", "o.status_")


def _statuses(spark, d, rules=None):
    facts = {"Order.total": F.col("total"), "Order.date": F.col("date"), "Order.status": F.col("status_")}
    return evaluation.evaluated(_firms(spark, d), rules or RULES, facts, F.lit(_AS_OF).cast("date"), ["firm", "area", "segment"])


def eval_status(spark, d):
    return _statuses(spark, d).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("firms"))


def eval_applicability(spark, d):
    """Which audiences each kind of firm passes: all conditions of the audience hold for its profile."""
    cats = F.create_map(*[F.lit(x) for pair in (("AUTOMOBILE", "stock_broker"), ("BUILDING", "investment_adviser"), ("FURNITURE", "depository"), ("HOUSEHOLD", "custodian"), ("MACHINERY", "bank")) for x in pair])
    firms = table(spark, d, "customer").groupBy(cats[F.trim("c_mktsegment")].alias("category")).agg(F.count(F.lit(1)).alias("firms"))
    register = _audiences(spark, d).select("audience_id", F.regexp_extract("predicate", "category == '([^']*)'", 1).alias("category"), F.col("predicate").contains("is_qsb").alias("needs_more"))
    return register.join(firms, "category").where("NOT needs_more").select("audience_id", "category", "firms")


def rep_network(spark, d):
    return evaluation.worst(_statuses(spark, d), "area").orderBy("area")


def rep_obligations(spark, d):
    return evaluation.shares(_statuses(spark, d), "rule")


def rep_health(spark, d):
    """Share of rules met by area, those without data apart, with the whole under a null area."""
    rows = _statuses(spark, d).where("status <> 'GREY'")
    per = rows.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "GREEN").alias("met"))
    return per.rollup("area").agg(F.sum("n").alias("n"), F.round(F.sum("met") / F.sum("n"), 6).alias("health"))


def rep_worklist(spark, d):
    """Gaps of each firm: how many rules it fails or is about to, the worst, and its score."""
    rows = _statuses(spark, d).groupBy("firm").agg(F.count_if(F.col("status") == "RED").alias("gaps"), F.count_if(F.col("status") == "AMBER").alias("due"), F.count_if(F.col("status") == "GREEN").alias("met"), F.min(evaluation.rank(F.col("status"))).cast("int").alias("worst"))
    return rows.where("gaps + due > 0").withColumn("score", F.round(F.try_divide(F.col("met"), F.col("met") + F.col("gaps") + F.col("due")), 4))


def rep_impact(spark, d):
    """What an amendment of one rule does: firms by status before and after."""
    pick = lambda rules: _statuses(spark, d, rules).where("rule = 'large'").select("firm", "status")
    return evaluation.transitions(pick(RULES), pick(CHANGED), ["firm"])


def rep_document(spark, d):
    """What each circular holds: its clauses, and the rules of which a source span names it."""
    clauses = _current(spark, d, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"))
    spans = _rules(spark, d).select("id", F.explode(F.array_distinct(F.transform("source_spans", lambda s: s["doc_id"]))).alias("doc_id")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"))
    return clauses.join(spans, "doc_id", "full").select("doc_id", F.coalesce("clauses", F.lit(0)).alias("clauses"), F.coalesce("rules", F.lit(0)).alias("rules"))


_STATUS = f"""
last AS (SELECT o_custkey, arg_max(CAST(o_orderdate AS DATE), (CAST(o_orderdate AS DATE), o_orderkey)) AS date, arg_max(CAST(o_totalprice AS DOUBLE), (CAST(o_orderdate AS DATE), o_orderkey)) AS total, arg_max(trim(o_orderstatus), (CAST(o_orderdate AS DATE), o_orderkey)) AS st FROM orders GROUP BY 1),
firms AS (SELECT c_custkey AS firm, c_nationkey AS area, date, total, st, date_diff('day', date, DATE '{_AS_OF}') AS days FROM customer LEFT JOIN last ON o_custkey = c_custkey),
statuses AS (
  SELECT firm, area, 'large' AS rule, CASE WHEN total IS NULL THEN 'GREY' WHEN total < 50000 THEN 'RED' ELSE 'GREEN' END AS status, CASE WHEN total IS NULL THEN 'GREY' WHEN total < 150000 THEN 'RED' ELSE 'GREEN' END AS later FROM firms
  UNION ALL SELECT firm, area, 'fresh', CASE WHEN days IS NULL THEN 'GREY' WHEN days > 400 THEN 'RED' WHEN days + 30 > 400 THEN 'AMBER' ELSE 'GREEN' END, NULL FROM firms
  UNION ALL SELECT firm, area, 'open', CASE WHEN st IS NULL THEN 'GREY' WHEN st = 'F' THEN 'RED' ELSE 'GREEN' END, NULL FROM firms
)
"""
_RANK = "list_position(['RED', 'AMBER', 'GREY', 'GREEN'], status)"


# Filing, integrity, specials ------------------------------------------------------------------------------------------
def _log(spark, d):
    return table(spark, d, "rule_assertions")


def fil_lanes(spark, d):
    return filing.classified(_log(spark, d)).groupBy("lane", "verdict").agg(F.count(F.lit(1)).alias("assertions"), F.countDistinct("identity_hash").alias("identities"))


def fil_overlaps(spark, d):
    return filing.overlapping(_log(spark, d))


def aud_aliases(spark, d):
    labels = _current(spark, d, "audience_id", "heading").where("audience_id IS NOT NULL").select("audience_id", F.col("heading").alias("label"))
    return audiences.with_labels(_audiences(spark, d), labels).select("audience_id", F.array_join("aliases", "|").alias("aliases"))


def aud_approve(spark, d):
    """Every fourth audience is proposed; those with an even id are asked to be approved."""
    register = _audiences(spark, d).select("audience_id", F.when(F.col("audience_id") % 4 == 0, "PROPOSED").when(F.col("audience_id") % 4 == 1, "RETIRED").otherwise("APPROVED").alias("state"))
    return audiences.approved(register, register.where("audience_id % 2 = 0 AND audience_id % 8 <> 0").select("audience_id"))


def fil_provenance(spark, d):
    """Rules with the circulars that restated them, each once."""
    rows = filing.classified(_log(spark, d)).where("verdict = 'restatement'").join(_log(spark, d).select("seq", "doc_id").distinct(), "seq")
    return rows.groupBy("identity_hash").agg(F.countDistinct("doc_id").alias("restated_by"), F.min("doc_id").alias("first_doc"))


def fil_log_read(spark, d):
    """The log of each circular in the order of effect: the first and last of it."""
    rows = _log(spark, d).select("seq", "doc_id", "effective_from").distinct()
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("assertions"), F.min(F.struct("effective_from", "seq"))["seq"].alias("first_seq"), F.max(F.struct("effective_from", "seq"))["seq"].alias("last_seq"))


def chk_constraints(spark, d):
    """Rows against the keys of the tables: ids given twice with different rows, references to nothing, edges to themselves."""
    o, c, u, a = (table(spark, d, t) for t in ("obligations", "source_clauses", "unresolved_citations", "attributes"))
    ids = c.select("id").distinct()
    counts = {
        "clause_id_twice": c.select("id", "created_at").distinct().groupBy("id").count().where("count > 1"),
        "clause_parent_missing": c.where("parent_id IS NOT NULL").select("id", "parent_id").distinct().join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti"),
        "rule_clause_missing": o.where("source_clause_id IS NOT NULL").select("id", F.col("source_clause_id").alias("c")).distinct().join(ids.withColumnRenamed("id", "c"), "c", "left_anti"),
        "rule_attribute_missing": o.select("id", F.explode("attribute_ids").alias("a")).distinct().join(a.select(F.col("id").alias("a")).distinct(), "a", "left_anti"),
        "citation_rule_missing": u.where("from_obligation_id IS NOT NULL").select("id", F.col("from_obligation_id").alias("r")).distinct().join(o.select(F.col("id").alias("r")).distinct(), "r", "left_anti"),
        "clause_is_its_parent": c.where("id = parent_id").select("id").distinct(),
    }
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def audit_chain_verify(spark, d):
    """Chains of hashes over the payloads of each identity in the order of arrival; where seq ends in 97 a payload is altered afterwards."""
    rows = _log(spark, d).where("identity_hash IS NOT NULL").groupBy("seq", F.lower("identity_hash").alias("chain")).agg(F.min(F.coalesce("payload", F.lit(""))).alias("payload"))
    before = F.lag("payload").over(Window.partitionBy("chain").orderBy("seq"))
    prev = F.coalesce(F.sha2(before, 256), F.lit(""))
    kept = rows.withColumn("prev_hash", prev).withColumn("row_hash", F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256))
    altered = kept.withColumn("payload", F.when(F.col("seq") % 100 == 97, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    again = F.coalesce(F.sha2(F.lag("payload").over(Window.partitionBy("chain").orderBy("seq")), 256), F.lit(""))
    checked = altered.withColumns({"broken_back": again != F.col("prev_hash"), "broken_row": F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256) != F.col("row_hash")})
    return checked.where("broken_back OR broken_row").select("seq", "broken_back", "broken_row")


def sp_why_me(spark, d):
    """For each category of firm the rules that reach it, through every audience that it passes."""
    passed = eval_applicability(spark, d).select("audience_id", "category")
    rules = _rules(spark, d).where("audience_id IS NOT NULL").select("id", "audience_id").distinct()
    return rules.join(passed, "audience_id").groupBy("category").agg(F.countDistinct("id").alias("rules"), F.countDistinct("audience_id").alias("audiences"))


def sp_audit_pack(spark, d):
    """Clause, rule, attributes and assertions joined: what stands behind each rule."""
    rules = links.once(_rules(spark, d), "title", "source_clause_id", "state")
    clause = _current(spark, d, "doc_id", "clause_no").select(F.col("id").alias("source_clause_id"), "doc_id", "clause_no")
    facts = _rules(spark, d).select("id", F.explode("attribute_ids").alias("attribute_id")).distinct().join(_register(spark, d).select(F.col("id").alias("attribute_id")), "attribute_id").groupBy("id").agg(F.count(F.lit(1)).alias("attributes"))
    log = _log(spark, d).where("obligation_id IS NOT NULL").groupBy(F.col("obligation_id").alias("id")).agg(F.countDistinct("seq").alias("assertions"), F.max("effective_from").cast("string").alias("last_effective"))
    whole = rules.join(clause, "source_clause_id", "left").join(facts, "id", "left").join(log, "id", "left")
    return whole.select("id", "state", "doc_id", "clause_no", F.coalesce("attributes", F.lit(0)).alias("attributes"), F.coalesce("assertions", F.lit(0)).alias("assertions"), "last_effective")


def sp_evidence(spark, d):
    """Line items as evidence, valid from shipping to receipt: orders with valid evidence at a date."""
    at = F.lit("1995-06-17").cast("date")
    valid = evaluation.valid_at(F.to_date("l_shipdate"), F.to_date("l_receiptdate"), at) if "l_receiptdate" in table(spark, d, "lineitem").columns else evaluation.valid_at(F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 30), at)
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(valid).alias("valid"))
    return rows.withColumn("status", F.when(F.col("valid") > 0, "GREEN").otherwise("RED"))


def sp_cross_document(spark, d):
    """Citations that would change a rule of another circular: proposals of an amendment, not part of the assembly."""
    from rulegrid.operators.orphans import doc_key

    rows = links.keyed_citations(table(spark, d, "unresolved_citations"), table(spark, d, "source_clauses"))
    homes = _current(spark, d, "doc_id").select(F.col("id").alias("from_clause_id"), doc_key(F.col("doc_id")).alias("home"))
    kind = F.when(F.col("home").isNull(), "unknown").when(F.col("doc") == F.col("home"), "assembly").otherwise("proposal")
    return rows.join(homes, "from_clause_id", "left").groupBy("type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("citations"))


def sp_step_out(spark, d):
    """Children's audiences against their parent's: inside it, the same, wider, or beside it."""
    from rulegrid.functions import predicates

    rows = _current(spark, d, "audience_id", "parent_id").where("audience_id IS NOT NULL AND parent_id IS NOT NULL")
    up = _current(spark, d, "audience_id").select(F.col("id").alias("parent_id"), F.col("audience_id").alias("above")).where("above IS NOT NULL")
    pairs = rows.join(up, "parent_id").groupBy("above", "audience_id").agg(F.count(F.lit(1)).alias("clauses"))
    conds = _audiences(spark, d).select("audience_id", audiences.parsed(F.col("predicate")).alias("c"))
    both = pairs.join(conds, "audience_id").join(conds.withColumnsRenamed({"audience_id": "above", "c": "up"}), "above")
    return both.groupBy(predicates.compared(F.col("c"), F.col("up")).alias("relation")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("clauses").alias("clauses"))


def met_detection(spark, d):
    """Numbers planted into every seventh rule: how many the vacuity and number checks catch, and how many sound rules they trip."""
    rows = links.once(_rules(spark, d).where("rule_expression IS NOT NULL"), "rule_expression")
    planted = F.col("id") % 7 == 0
    text = F.when(planted, F.concat("rule_expression", F.lit(" AND days_since([A.b]) >= 0"))).otherwise(F.col("rule_expression"))
    return rows.select(planted.alias("planted"), texts.vacuous(text).alias("tripped")).groupBy("planted").agg(F.count(F.lit(1)).alias("rules"), F.count_if("tripped").alias("caught"), F.round(F.avg(F.col("tripped").cast("double")), 6).alias("rate"))


def met_usage_cost(spark, d):
    """Events as calls of a model, by kind: tokens in and out, cached ones at half the price, with the total under null."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").cast("double").alias("v"), (F.col("event_id") % 3 == 0).alias("cached"))
    price = F.when(F.col("cached"), F.col("v") / 2).otherwise(F.col("v"))
    return rows.withColumn("price", price).rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.round(F.sum("price"), 2).alias("cost"))


_CLASSIFIED = """
rows AS (SELECT seq, arg_min(effective_from, h) AS effective_from, arg_min(identity_hash, h) AS identity_hash, arg_min(full_hash, h) AS full_hash, arg_min(citations, h) AS citations FROM (
  SELECT DISTINCT seq, effective_from, lower(identity_hash) AS identity_hash, lower(full_hash) AS full_hash, citations, (effective_from, lower(identity_hash), lower(full_hash)) AS h FROM rule_assertions WHERE identity_hash IS NOT NULL) GROUP BY seq),
cited AS (SELECT *, len(list_distinct(list_transform(list_filter(coalesce(citations, []), lambda c: c.kind IN ('repeals', 'supersedes', 'amends')), lambda c: c.target_identity_hash))) AS n, len(list_filter(coalesce(citations, []), lambda c: c.kind IN ('repeals', 'supersedes'))) AS ends,
  row_number() OVER (PARTITION BY identity_hash ORDER BY effective_from, seq) AS rn, first_value(full_hash) OVER (PARTITION BY identity_hash ORDER BY effective_from, seq) AS first_full FROM rows),
classified AS (SELECT seq, identity_hash, CASE WHEN n > 0 THEN 'citation' ELSE 'fingerprint' END AS lane, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND ends > 0 THEN 'repeal' WHEN n = 1 THEN 'amendment' WHEN rn = 1 THEN 'new' WHEN full_hash IS NOT DISTINCT FROM first_full THEN 'restatement' ELSE 'amendment' END AS verdict FROM cited)
"""
_CHAIN = """
WITH r AS (SELECT seq, lower(identity_hash) AS chain, min(coalesce(payload, '')) AS payload FROM rule_assertions WHERE identity_hash IS NOT NULL GROUP BY ALL),
b AS (SELECT *, lag(seq) OVER (PARTITION BY chain ORDER BY seq) AS before FROM r)
SELECT seq, coalesce(before % 100 = 97, false) AS broken_back, seq % 100 = 97 AS broken_row FROM b WHERE coalesce(before % 100 = 97, false) OR seq % 100 = 97
"""

QUERIES = {
    "drf_rules": Query(drf_rules, DRAFT_SQL),
    "drf_modifiers": Query(drf_modifiers, f"WITH r AS (SELECT DISTINCT id, raw_text FROM unresolved_citations) SELECT id, {_EFFECT('raw_text')} AS effect, {_TARGET('raw_text')} AS target FROM r WHERE {_EFFECT('raw_text')} IS NOT NULL"),
    "drf_conditions": Query(drf_conditions, f"WITH r AS (SELECT DISTINCT id, context FROM obligations WHERE context IS NOT NULL) SELECT context, count(*) AS rules, {_FIRM('context')} AS condition, CASE WHEN regexp_matches(context, '{drafting.LEAD_IN}') THEN {_FIRM('context')} END AS precondition FROM r GROUP BY context"),
    "drf_definitions": Query(drf_definitions),
    "drf_batches": Query(drf_batches, f"WITH {_CURRENT}, r AS (SELECT id, doc_id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1) // 25 AS INTEGER) AS batch FROM cur WHERE text IS NOT NULL) SELECT doc_id, batch, count(*) AS windows, min(id) AS first_id FROM r GROUP BY ALL"),
    "drf_cross_check": Query(drf_cross_check, rf"WITH r AS (SELECT DISTINCT id, raw_text FROM unresolved_citations) SELECT {_EFFECT('raw_text')} AS effect, list_contains(regexp_extract_all(raw_text, '(?:clause|para) (\d+(?:\.\d+)*)', 1), {_TARGET('raw_text')}) AS confirmed, count(*) AS modifiers FROM r WHERE {_EFFECT('raw_text')} IS NOT NULL GROUP BY ALL"),
    "drf_states": Query(drf_states),
    "drf_outcomes": Query(drf_outcomes, f"WITH {_CURRENT} SELECT CASE WHEN {_EFFECT('text')} IS NOT NULL THEN 'modifier' WHEN regexp_matches(text, '{drafting.DEFINES}') THEN 'definition' WHEN regexp_matches(text, '{drafting.LEAD_IN}') AND {_FIRM('text')} IS NOT NULL THEN 'precondition rule' WHEN regexp_matches(text, '{texts.NORMATIVE}') THEN 'rule' ELSE 'decline' END AS outcome, count(*) AS clauses FROM cur WHERE text IS NOT NULL GROUP BY 1"),
    "exp_restates_title": Query(exp_restates_title, rf"""WITH r AS (SELECT DISTINCT id, title, regexp_extract(rule_expression, '\[\w+\.(\w+)\]', 1) AS token FROM obligations WHERE rule_expression IS NOT NULL),
        w AS (SELECT id, token, list_distinct(list_filter(regexp_extract_all(replace(token, '_', ' '), '[a-z]{{3,}}'), lambda w: NOT list_contains({drafting.STOP_WORDS}, w))) AS asked, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, CASE WHEN id % 4 = 0 THEN replace(token, '_', ' ') END)), '[a-z]{{3,}}'), lambda w: NOT list_contains({drafting.STOP_WORDS}, w))) AS told FROM r WHERE token <> '')
        SELECT id, token FROM w WHERE len(asked) > 0 AND len(told) >= 2 AND len(list_filter(asked, lambda x: NOT list_contains(told, x))) = 0"""),
    "exp_exists_use": Query(exp_exists_use, "SELECT DISTINCT id, CASE WHEN data_type = 'boolean' THEN '[' || category || '.' || canonical_name || '] == true' ELSE 'exists([' || category || '.' || canonical_name || '])' END AS expression, data_type IN ('date', 'number') AS needs_review FROM attributes"),
    "exp_confidence": Query(exp_confidence, rf"WITH r AS (SELECT DISTINCT id, rule_expression, CAST(CAST(confidence AS DECIMAL(9, 3)) AS DOUBLE) AS c, attribute_ids FROM obligations WHERE rule_expression IS NOT NULL), x AS (SELECT *, CASE WHEN regexp_matches(rule_expression, '\b(days|months|years)_since\([^)]*\)\s*>=\s*0([^\d.]|$)') OR len(attribute_ids) = 0 THEN least(c, 0.4) ELSE c END AS after FROM r) SELECT after < c AS capped, count(*) AS rules, round(sum(after), 3) AS confidence FROM x GROUP BY 1"),
    "exp_corrections": Query(exp_corrections),
    "exp_rule_audience": Query(exp_rule_audience, f"WITH {_CURRENT}, r AS (SELECT DISTINCT id, audience_id, source_clause_id FROM obligations) SELECT r.id, coalesce(r.audience_id, c.audience_id) AS audience_id, CASE WHEN r.audience_id IS NOT NULL THEN 'own' WHEN c.audience_id IS NOT NULL THEN 'clause' ELSE 'none' END AS source FROM r LEFT JOIN cur c ON c.id = r.source_clause_id"),
    "exp_rewrite": Query(exp_rewrite, r"WITH r AS (SELECT DISTINCT id, rule_expression AS e FROM obligations WHERE rule_expression IS NOT NULL AND NOT lower(rule_expression) LIKE 'attest%') SELECT true AS same, CAST(len(list_distinct(regexp_extract_all(e, '\[(\w+\.\w+)\]', 1))) AS INTEGER) AS names, count(*) AS rules FROM r GROUP BY ALL"),
    "eval_status": Query(eval_status, f"WITH {_STATUS} SELECT rule, status, count(*) AS firms FROM statuses GROUP BY ALL"),
    "eval_applicability": Query(eval_applicability, f"WITH {_REGISTER}, f AS (SELECT CASE trim(c_mktsegment) WHEN 'AUTOMOBILE' THEN 'stock_broker' WHEN 'BUILDING' THEN 'investment_adviser' WHEN 'FURNITURE' THEN 'depository' WHEN 'HOUSEHOLD' THEN 'custodian' ELSE 'bank' END AS category, count(*) AS firms FROM customer GROUP BY 1) SELECT r.audience_id, f.category, f.firms FROM reg r JOIN f ON f.category = r.cat WHERE NOT r.qsb"),
    "rep_network": Query(rep_network, f"WITH {_STATUS} SELECT area, arg_min(status, {_RANK}) AS status FROM statuses GROUP BY area"),
    "rep_obligations": Query(rep_obligations, f"WITH {_STATUS}, c AS (SELECT rule, count(*) AS firms, count(*) FILTER (WHERE status = 'GREY') AS no_data, count(*) FILTER (WHERE status = 'GREEN') AS met FROM statuses GROUP BY 1) SELECT *, CASE WHEN no_data >= firms * 0.5 THEN 'GREY' WHEN met / (firms - no_data) >= 0.9 THEN 'GREEN' WHEN met / (firms - no_data) >= 0.7 THEN 'AMBER' ELSE 'RED' END AS status FROM c"),
    "rep_health": Query(rep_health, f"WITH {_STATUS} SELECT area, count(*) AS n, round(count(*) FILTER (WHERE status = 'GREEN') / count(*), 6) AS health FROM statuses WHERE status <> 'GREY' GROUP BY ROLLUP (area)"),
    "rep_worklist": Query(rep_worklist, f"WITH {_STATUS}, w AS (SELECT firm, count(*) FILTER (WHERE status = 'RED') AS gaps, count(*) FILTER (WHERE status = 'AMBER') AS due, count(*) FILTER (WHERE status = 'GREEN') AS met, CAST(min({_RANK}) AS INTEGER) AS worst FROM statuses GROUP BY 1) SELECT *, round(met / (met + gaps + due), 4) AS score FROM w WHERE gaps + due > 0"),
    "rep_impact": Query(rep_impact, f"WITH {_STATUS} SELECT status AS was, later AS now, count(*) AS firms FROM statuses WHERE rule = 'large' GROUP BY ALL"),
    "rep_document": Query(rep_document, f"WITH {_CURRENT}, c AS (SELECT doc_id, count(*) AS clauses FROM cur GROUP BY 1), s AS (SELECT doc_id, count(*) AS rules FROM (SELECT DISTINCT id, unnest(list_transform(source_spans, lambda s: s.doc_id)) AS doc_id FROM obligations) GROUP BY 1) SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, coalesce(clauses, 0) AS clauses, coalesce(rules, 0) AS rules FROM c FULL JOIN s ON s.doc_id = c.doc_id"),
    "fil_lanes": Query(fil_lanes, f"WITH {_CLASSIFIED} SELECT lane, verdict, count(*) AS assertions, count(DISTINCT identity_hash) AS identities FROM classified GROUP BY ALL"),
    "fil_overlaps": Query(fil_overlaps, f"WITH {_CLASSIFIED}, u AS (SELECT DISTINCT seq, identity_hash, audience_id, attribute_id FROM (SELECT seq, lower(identity_hash) AS identity_hash, audience_id, unnest(attribute_ids) AS attribute_id FROM rule_assertions WHERE identity_hash IS NOT NULL AND audience_id IS NOT NULL)), h AS (SELECT audience_id, attribute_id, count(DISTINCT identity_hash) AS n FROM u GROUP BY ALL HAVING count(DISTINCT identity_hash) > 1) SELECT u.seq, u.identity_hash, max(h.n) - 1 AS candidates FROM u JOIN classified c ON c.seq = u.seq AND c.identity_hash = u.identity_hash JOIN h ON h.audience_id = u.audience_id AND h.attribute_id = u.attribute_id WHERE c.lane = 'fingerprint' AND c.verdict = 'new' GROUP BY ALL"),
    "aud_aliases": Query(aud_aliases, rf"WITH {_CURRENT}, {_REGISTER}, t AS (SELECT audience_id, trim(regexp_replace(heading, '\s+', ' ', 'g')) AS label FROM cur WHERE audience_id IS NOT NULL AND heading IS NOT NULL), o AS (SELECT audience_id, min(label) AS label FROM t GROUP BY audience_id, lower(label)), g AS (SELECT audience_id, string_agg(label, '|' ORDER BY label) AS aliases FROM o GROUP BY 1) SELECT r.audience_id, coalesce(g.aliases, '') AS aliases FROM reg r LEFT JOIN g ON g.audience_id = r.audience_id"),
    "aud_approve": Query(aud_approve, f"WITH {_REGISTER} SELECT audience_id, CASE WHEN audience_id % 4 = 1 THEN 'RETIRED' WHEN audience_id % 4 = 0 AND audience_id % 8 = 0 THEN 'PROPOSED' ELSE 'APPROVED' END AS state, audience_id % 4 = 0 AND audience_id % 8 <> 0 AS changed FROM reg"),
    "fil_provenance": Query(fil_provenance, f"WITH {_CLASSIFIED} SELECT c.identity_hash, count(DISTINCT l.doc_id) AS restated_by, min(l.doc_id) AS first_doc FROM classified c JOIN rule_assertions l ON l.seq = c.seq WHERE c.verdict = 'restatement' GROUP BY 1"),
    "fil_log_read": Query(fil_log_read, "SELECT doc_id, count(*) AS assertions, arg_min(seq, (coalesce(effective_from, DATE '0001-01-01'), seq)) AS first_seq, arg_max(seq, (coalesce(effective_from, DATE '0001-01-01'), seq)) AS last_seq FROM (SELECT DISTINCT seq, doc_id, effective_from FROM rule_assertions) GROUP BY doc_id"),
    "chk_constraints": Query(chk_constraints, """SELECT 'clause_id_twice' AS "check", count(*) AS rows FROM (SELECT id FROM (SELECT DISTINCT id, created_at FROM source_clauses) GROUP BY id HAVING count(*) > 1)
        UNION ALL SELECT 'clause_parent_missing', count(*) FROM (SELECT DISTINCT id, parent_id FROM source_clauses WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM source_clauses))
        UNION ALL SELECT 'rule_clause_missing', count(*) FROM (SELECT DISTINCT id, source_clause_id FROM obligations WHERE source_clause_id IS NOT NULL AND source_clause_id NOT IN (SELECT id FROM source_clauses))
        UNION ALL SELECT 'rule_attribute_missing', count(*) FROM (SELECT DISTINCT id, a FROM (SELECT id, unnest(attribute_ids) AS a FROM obligations) WHERE a NOT IN (SELECT id FROM attributes))
        UNION ALL SELECT 'citation_rule_missing', count(*) FROM (SELECT DISTINCT id, from_obligation_id FROM unresolved_citations WHERE from_obligation_id IS NOT NULL AND from_obligation_id NOT IN (SELECT id FROM obligations))
        UNION ALL SELECT 'clause_is_its_parent', count(DISTINCT id) FROM source_clauses WHERE id = parent_id"""),
    "audit_chain_verify": Query(audit_chain_verify, _CHAIN),
    "sp_why_me": Query(sp_why_me, f"WITH {_REGISTER} SELECT r.cat AS category, count(DISTINCT o.id) AS rules, count(DISTINCT o.audience_id) AS audiences FROM obligations o JOIN reg r ON r.audience_id = o.audience_id WHERE NOT r.qsb AND r.cat IS NOT NULL GROUP BY 1"),
    "sp_audit_pack": Query(sp_audit_pack, f"""WITH {_CURRENT}, r AS (SELECT DISTINCT id, state, source_clause_id FROM obligations), f AS (SELECT id, count(DISTINCT a) AS n FROM (SELECT id, unnest(attribute_ids) AS a FROM obligations) WHERE a IN (SELECT id FROM attributes) GROUP BY 1),
        l AS (SELECT obligation_id, count(DISTINCT seq) AS n, CAST(max(effective_from) AS VARCHAR) AS last_effective FROM rule_assertions WHERE obligation_id IS NOT NULL GROUP BY 1)
        SELECT r.id, r.state, c.doc_id, c.clause_no, coalesce(f.n, 0) AS attributes, coalesce(l.n, 0) AS assertions, l.last_effective FROM r LEFT JOIN cur c ON c.id = r.source_clause_id LEFT JOIN f ON f.id = r.id LEFT JOIN l ON l.obligation_id = r.id"""),
    "sp_evidence": Query(sp_evidence),
    "sp_cross_document": Query(sp_cross_document, _keyed(f"WITH {_CURRENT}, {_KEYS}, own AS (SELECT id, dockey(doc_id) AS home FROM cur) SELECT c.type, CASE WHEN o.home IS NULL THEN 'unknown' WHEN c.doc = o.home THEN 'assembly' ELSE 'proposal' END AS kind, count(*) AS citations FROM cites c LEFT JOIN own o ON o.id = c.from_clause_id GROUP BY ALL")),
    "sp_step_out": Query(sp_step_out, f"""WITH {_CURRENT}, {_REGISTER}, p AS (SELECT u.audience_id AS above, c.audience_id, count(*) AS clauses FROM cur c JOIN cur u ON u.id = c.parent_id WHERE c.audience_id IS NOT NULL AND u.audience_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT p.*, {_IMPLIES.format(a='x', b='y')} AS down, {_IMPLIES.format(a='y', b='x')} AS up FROM p JOIN spelt x ON x.audience_id = p.audience_id JOIN spelt y ON y.audience_id = p.above)
        SELECT CASE WHEN down AND up THEN 'identical' WHEN down THEN 'narrower' WHEN up THEN 'broader' ELSE 'unrelated' END AS relation, count(*) AS pairs, CAST(sum(clauses) AS BIGINT) AS clauses FROM r GROUP BY 1"""),
    "met_detection": Query(met_detection, r"WITH r AS (SELECT DISTINCT id, rule_expression AS e FROM obligations WHERE rule_expression IS NOT NULL), t AS (SELECT id % 7 = 0 AS planted, id % 7 = 0 OR regexp_matches(e, '\b(days|months|years)_since\([^)]*\)\s*>=\s*0([^\d.]|$)') AS tripped FROM r) SELECT planted, count(*) AS rules, count(*) FILTER (WHERE tripped) AS caught, round(avg(CAST(tripped AS DOUBLE)), 6) AS rate FROM t GROUP BY 1"),
    "met_usage_cost": Query(met_usage_cost, "SELECT event_type AS model, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS cached, round(sum(CASE WHEN event_id % 3 = 0 THEN value / 2 ELSE value END), 2) AS cost FROM events GROUP BY ROLLUP (event_type)"),
}
