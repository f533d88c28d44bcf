"""Queries of the rule-graph operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrid.functions import citations
from rulegrid.functions.compiler import compile_rule
from rulegrid.operators import assembly, filing, hierarchy, links, ordered, resolution, rules, texts
from rulegrid.plans.problems import AS_BELIEVED_SQL, _TREES, _keyed
from rulegrid.plans.registry import Query
from rulegrid.runtime import table

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, parent_id DESC NULLS LAST) AS rn FROM source_clauses) WHERE rn = 1)"


def _current(spark, d, *columns):
    """The current row of each clause with these columns; only they, and what orders the deliveries, are read."""
    rows = table(spark, d, "source_clauses").select("id", "created_at", "parent_id", *[c for c in columns if c != "parent_id"])
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "parent_id")).alias("c")).select("id", "c.*")


# Trees ---------------------------------------------------------------------------------------------------------------
def tree_prev_sibling(spark, d):
    rows = _current(spark, d, "doc_id", "parent_id").where("parent_id IS NOT NULL")
    return ordered.previous(rows, ["doc_id", "parent_id"], "id", F.col("id"), "previous_id").select("id", "previous_id")


def tree_leaf(spark, d):
    rows = _current(spark, d, "doc_id", "parent_id").select("id", "parent_id", "doc_id")
    leaves = rows.join(rows.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    return leaves.groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"))


def tree_offsets(spark, d):
    rows = _current(spark, d, "doc_id", "text").select("id", "doc_id", F.length("text").alias("n"))
    return ordered.running_sum(rows, ["doc_id"], "id", F.col("n") + 2, "char_start").select("id", "char_start", (F.col("char_start") + F.coalesce("n", F.lit(0))).alias("char_end"))


def tree_gap_audit(spark, d):
    rows = _current(spark, d, "doc_id", "clause_no", "container").where("clause_no IS NOT NULL AND container IS NULL")
    last = F.regexp_extract("clause_no", r"^(?:\d+\.)*(\d+)$", 1)
    head = F.regexp_extract("clause_no", r"^((?:\d+\.)*)\d+$", 1)
    return ordered.gaps(rows.select("doc_id", head.alias("stem"), F.nullif(last, F.lit("")).cast("int").alias("n")), ["doc_id", "stem"], "n", 3)


def tree_path(spark, d):
    label = F.coalesce("clause_no", "heading")
    return hierarchy.inherited(table(spark, d, "source_clauses"), label, F.col("container")).select(F.col("id").cast("int").alias("id"), "path")


def aud_stamp_tree(spark, d):
    out = hierarchy.inherited(table(spark, d, "source_clauses"), F.col("id"), F.col("audience_id"))
    return out.select(F.col("id").cast("int").alias("id"), F.col("value").cast("int").alias("audience_id"), F.col("holder").alias("from_id"), "distance").where("from_id IS NOT NULL")


def lnk_container(spark, d):
    out = hierarchy.inherited(table(spark, d, "source_clauses"), F.col("id"), F.col("container"))
    return out.select(F.col("id").cast("int").alias("id"), F.col("value").alias("container")).where("container IS NOT NULL")


_WALKED = f"""
WITH {_TREES}, full_rows AS ({_CURRENT.removeprefix('cur AS (').removesuffix(')')}),
up AS (
  SELECT t.id, CAST(p.a AS BIGINT) AS above, t.depth + 1 - p.i AS distance
  FROM tree t, LATERAL (SELECT unnest(string_split(t.path, '/')) AS a, generate_subscripts(string_split(t.path, '/'), 1) AS i) p
)
"""
TREE_PATH_SQL = _WALKED + "SELECT u.id, string_agg(coalesce(f.clause_no, f.heading, ''), '/' ORDER BY u.distance DESC) AS path FROM up u JOIN full_rows f ON f.id = u.above GROUP BY u.id"
STAMP_SQL = _WALKED + "SELECT id, audience_id, above AS from_id, distance FROM (SELECT u.*, f.audience_id, row_number() OVER (PARTITION BY u.id ORDER BY u.distance) AS rn FROM up u JOIN full_rows f ON f.id = u.above WHERE f.audience_id IS NOT NULL) WHERE rn = 1"
CONTAINER_SQL = _WALKED + "SELECT id, container FROM (SELECT u.id, f.container, row_number() OVER (PARTITION BY u.id ORDER BY u.distance) AS rn FROM up u JOIN full_rows f ON f.id = u.above WHERE f.container IS NOT NULL) WHERE rn = 1"


# Texts ---------------------------------------------------------------------------------------------------------------
def text_repeated_lines(spark, d):
    return texts.repeated_lines(table(spark, d, "documents"), 3)


def text_normative_share(spark, d):
    rows = _current(spark, d, "doc_id", "text")
    tagged = (F.length("text") >= 60) & F.col("text").rlike(texts.NORMATIVE)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.count_if(tagged).alias("normative"), F.count_if(F.length("text") < 15).alias("stubs"))


def text_window_dedupe(spark, d):
    rows = _current(spark, d, "text").where("text IS NOT NULL").select("id", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("content"))
    return rows.groupBy("content").agg(F.count(F.lit(1)).alias("clauses"), F.min("id").alias("first_id")).where("clauses > 1")


def text_number_pool(spark, d):
    rows = _current(spark, d, "text").where("text IS NOT NULL").select("id", F.explode(texts.number_pool(F.col("text"))).alias("number"))
    return rows.groupBy("number").agg(F.count(F.lit(1)).alias("clauses"))


def cit_extract_summary(spark, d):
    rows = _current(spark, d, "text").where("text IS NOT NULL").select("id", F.explode(texts.cited_numbers(F.col("text"))).alias("c"))
    return rows.groupBy(F.substring_index("c", " ", 1).alias("cue"), F.substring_index("c", " ", -1).alias("number")).agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("id").alias("clauses"))


def cit_extract(spark, d):
    return texts.citations(_current(spark, d, "text"))


def cit_summary(spark, d):
    return texts.citation_summary(texts.citations(_current(spark, d, "text")))


def cit_kinds(spark, d):
    rows = table(spark, d, "unresolved_citations").select("id", "raw_text").distinct()
    return rows.groupBy(texts.link_kind(F.col("raw_text")).alias("kind")).agg(F.count(F.lit(1)).alias("citations"))


_POOL_CASES = " || ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {[float(v) for v in vs]}::DOUBLE[] ELSE []::DOUBLE[] END" for p, vs in texts.PERIODS.items())
POOL_SQL = rf"""
WITH {_CURRENT}, low AS (SELECT id, lower(text) AS low FROM cur WHERE text IS NOT NULL),
bare AS (SELECT id, low, regexp_replace(regexp_replace(low, '\b({texts.CUES}|circular|no\.?|chapter|part) [0-9]+(\.[0-9]+)*', ' ', 'g'), '\b(19|20)[0-9][0-9]\b', ' ', 'g') AS bare FROM low),
nums AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(bare, '[0-9]+(?:,[0-9]{{2,3}})*(?:\.[0-9]+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) || {_POOL_CASES})) AS number FROM bare)
SELECT number, count(*) AS clauses FROM nums GROUP BY number
"""
_KIND_CASES = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in citations.LINK_KINDS)


def _rules(spark, d):
    return table(spark, d, "obligations")


# Resolution ----------------------------------------------------------------------------------------------------------
def _register(spark, d):
    return table(spark, d, "attributes").groupBy("id").agg(F.min(F.struct("category", "canonical_name", "data_type", "unit", "description", "aliases", "vector", "is_derived")).alias("a")).select("id", "a.*")


def _near(spark, d, k=10):
    rows = _register(spark, d)
    return resolution.nearest(rows.select(F.col("id").alias("query_id"), "data_type", "vector"), rows.select("id", "data_type", "vector"), k)


def res_knn(spark, d):
    return _near(spark, d).select("query_id", "id", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def res_radius(spark, d):
    rows = _register(spark, d)
    near = resolution.nearest(rows.select(F.col("id").alias("query_id"), "data_type", "vector"), rows.select("id", "data_type", "vector"), 3, 0.35)
    return near.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def res_bands(spark, d):
    return resolution.bands(_near(spark, d, 1)).groupBy("decision").agg(F.count(F.lit(1)).alias("attributes"))


def _mentions(spark, d):
    rows = _rules(spark, d).where("rule_expression IS NOT NULL").select("id", "rule_expression", F.to_date("created_at").alias("date")).distinct()
    hit = F.explode(F.regexp_extract_all(F.lower("rule_expression"), F.lit(r"\[(\w+\.\w+)\]"), F.lit(1))).alias("m")
    return rows.select(hit, "date").select(F.substring_index("m", ".", 1).alias("category"), F.substring_index("m", ".", -1).alias("name"), "date")


def res_tripwire(spark, d):
    return resolution.tripwire(_mentions(spark, d).drop("date"), _register(spark, d))


_AS_OF = "2026-01-01"


def res_name_choice(spark, d):
    found = resolution.tripwire(_mentions(spark, d).drop("date"), _register(spark, d)).where("id IS NOT NULL")
    spread = _mentions(spark, d).join(found.select("category", "name", "id"), ["category", "name"]).select(F.col("id").alias("group"), F.col("name").alias("token"), "date")
    return resolution.named_best(spread, F.lit(_AS_OF).cast("date"))


def _queries(spark, d):
    """Every entry of the register asked for again under its first alias, if it has one."""
    rows = _register(spark, d)
    return rows.select(F.col("id").alias("query_id"), "category", F.coalesce(F.try_element_at("aliases", F.lit(1)), "canonical_name").alias("name"), "data_type", "unit", "vector")


def res_gate(spark, d):
    return resolution.candidates(_queries(spark, d), _register(spark, d), resolution.JUDGE).select("query_id", "id", F.round("distance", 4).alias("distance"), "rejected")


def res_funnel(spark, d):
    return resolution.funnel(_queries(spark, d), _register(spark, d))


def res_alias_provenance(spark, d):
    heard = resolution.tripwire(_mentions(spark, d).drop("date"), _register(spark, d)).where("id IS NOT NULL").select("id", "name")
    return resolution.with_alias(_register(spark, d), heard).select("id", F.array_join("aliases", "|").alias("aliases"))


def res_composites(spark, d):
    """Distinct texts to embed, with how many entries share each, batched by 128."""
    text = resolution.composite(F.regexp_replace("canonical_name", "_", " "), F.col("description"), F.col("category"))
    one = _register(spark, d).groupBy(text.alias("composite")).agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("first_id"))
    # Batches are numbered over the texts of a data dictionary, a bounded table.
    from pyspark.sql import Window

    return one.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("first_id")) - 1) / 128).cast("int"))


def res_types(spark, d):
    rows = _register(spark, d)
    return rows.groupBy("data_type", resolution.data_type(F.col("data_type")).alias("type"), resolution.dimension(F.lower(F.trim("unit"))).alias("dimension")).agg(F.count(F.lit(1)).alias("attributes"))


def exp_formula_leaves(spark, d):
    """Derived entries rest on the derived one before them in their category and on the category's first entry."""
    from pyspark.sql import Window

    rows = _register(spark, d).select("id", "category", "is_derived")
    first = rows.groupBy("category").agg(F.min("id").alias("first"))
    derived = rows.where("is_derived").withColumn("before", F.lag("id").over(Window.partitionBy("category").orderBy("id"))).join(first, "category")
    formulas = derived.select(F.col("id").alias("attribute_id"), F.array_compact(F.array("before", "first")).alias("input_ids"))
    return resolution.formula_inputs(formulas)


def res_jaccard_judge(spark, d):
    return resolution.judged(_register(spark, d), 0.55)


def res_blast_radius(spark, d):
    return resolution.blast_radius(_rules(spark, d), _register(spark, d).where("is_derived"))


def res_repoint(spark, d):
    rows = _register(spark, d).where("data_type = 'number'")
    moves = rows.join(rows.groupBy("canonical_name").agg(F.min("id").alias("new")), "canonical_name").where("id <> new").select(F.col("id").alias("old"), "new")
    return resolution.repointed(_rules(spark, d), moves)


def res_cluster(spark, d):
    return resolution.clustered(_register(spark, d))


_NAMES = "names AS (SELECT lower(category) AS category, lower(trim(n)) AS name, min(id) AS id FROM (SELECT id, category, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS n FROM (SELECT DISTINCT id, category, canonical_name, aliases FROM attributes)) GROUP BY ALL)"
_MENTIONED = r"mentioned AS (SELECT split_part(m, '.', 1) AS category, split_part(m, '.', 2) AS name FROM (SELECT unnest(regexp_extract_all(lower(rule_expression), '\[(\w+\.\w+)\]', 1)) AS m FROM (SELECT DISTINCT id, rule_expression FROM obligations WHERE rule_expression IS NOT NULL)))"
_NEAR = """
reg AS (SELECT DISTINCT ON (id) id, data_type, CAST(vector AS DOUBLE[]) AS v FROM attributes WHERE len(vector) > 0),
near AS (
  SELECT a.id AS query_id, b.id, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS distance FROM reg a JOIN reg b ON a.data_type = b.data_type AND a.id <> b.id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM near)
"""
_DATED = r"mentioned AS (SELECT split_part(m, '.', 1) AS category, split_part(m, '.', 2) AS name, date FROM (SELECT unnest(regexp_extract_all(lower(rule_expression), '\[(\w+\.\w+)\]', 1)) AS m, date FROM (SELECT DISTINCT id, rule_expression, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS date FROM obligations WHERE rule_expression IS NOT NULL)))"
NAME_CHOICE_SQL = f"""
WITH {_NAMES}, {_DATED}, counted AS (SELECT n.id AS grp, m.name AS token, count(*) AS n, min(m.date) AS first, max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(1 - date_diff('day', m.date, DATE '{_AS_OF}') / 365.25::DOUBLE / 10, 0.5::DOUBLE)))) AS recent FROM mentioned m JOIN names n USING (category, name) GROUP BY ALL),
parts AS (SELECT *, list_filter(regexp_split_to_array(token, '[_\\s]+'), lambda w: length(w) > 0) AS ws FROM counted),
scored AS (
  SELECT grp, token, n, first, round(log2(n + 1.0) * 3 + recent * 1.5::DOUBLE + least(len(ws), 4) * 2.0::DOUBLE + greatest(len(ws) - 4, 0) * 0.25::DOUBLE - len(list_filter(ws, lambda w: length(w) <= 3 OR NOT regexp_matches(w, '[aeiou]'))) * 3.0::DOUBLE
         - len(list_filter(ws, lambda w: regexp_matches(w, '{resolution.NOISE}'))) * 4.0::DOUBLE + least(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 8.0::DOUBLE) / 4, 6) AS score FROM parts
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, first NULLS LAST, token) AS rn FROM scored),
other AS (SELECT grp, arg_min(token, (-n, token)) AS runner_up FROM ranked WHERE rn > 1 GROUP BY grp)
SELECT r.grp AS "group", r.token, r.score, r.n AS uses, o.runner_up FROM ranked r LEFT JOIN other o ON o.grp = r.grp WHERE rn = 1
"""
_DIMENSION = "CASE " + " ".join(f"WHEN {{u}} IN ({', '.join(repr(w) for w in words.split())}) THEN '{k}'" for k, words in resolution.DIMENSIONS.items()) + " END"
_ALL = "reg AS (SELECT DISTINCT ON (id) id, category, canonical_name, aliases, data_type, lower(trim(coalesce(unit, ''))) AS unit, description, is_derived, CAST(vector AS DOUBLE[]) AS v FROM attributes)"
_GATE = f"""
{_ALL}, asked AS (SELECT id AS query_id, lower(category) AS category, coalesce(aliases[1], canonical_name) AS name, data_type, unit, v FROM reg),
pairs AS (
  SELECT a.query_id, b.id, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS distance, a.name AS an, b.canonical_name AS bn,
         coalesce(lower(trim(a.data_type)), '') AS ta, coalesce(lower(trim(b.data_type)), '') AS tb, a.unit AS au, b.unit AS bu
  FROM asked a JOIN reg b ON a.category = lower(b.category) AND a.query_id <> b.id WHERE len(a.v) > 0 AND len(b.v) > 0
),
gate AS (
  SELECT query_id, id, distance, CASE WHEN NOT (ta = '' OR tb = '' OR ta = tb OR ta = 'string' OR tb = 'string') THEN 'type' WHEN NOT (au = '' OR bu = '' OR au = bu OR coalesce({_DIMENSION.format(u='au')} = {_DIMENSION.format(u='bu')}, false)) THEN 'unit'
         WHEN an <> bn AND regexp_replace(an, '_?\\d+$', '') = regexp_replace(bn, '_?\\d+$', '') AND regexp_matches(an, '\\d$') AND regexp_matches(bn, '\\d$') THEN 'index' END AS rejected FROM pairs WHERE distance <= 0.45
)
"""
FUNNEL_SQL = f"""
WITH {_GATE}, {_NAMES}, wire AS (SELECT a.query_id, min(n.id) AS wired FROM asked a JOIN names n ON n.category = a.category AND n.name = lower(trim(a.name)) AND n.id <> a.query_id JOIN reg b ON b.id = n.id
  WHERE coalesce(lower(trim(a.data_type)), '') IN ('', 'string', coalesce(lower(trim(b.data_type)), '')) OR coalesce(lower(trim(b.data_type)), '') IN ('', 'string') GROUP BY 1),
near AS (SELECT query_id, min(round(distance, 9)) AS distance, arg_min(id, (round(distance, 9), id)) AS id FROM gate WHERE rejected IS NULL GROUP BY 1)
SELECT a.query_id, CASE WHEN w.wired IS NOT NULL THEN 'tripwire' WHEN n.id IS NULL THEN 'new' WHEN n.distance < 0.15 THEN 'reuse' ELSE 'judge' END AS decision, coalesce(w.wired, n.id) AS id FROM asked a LEFT JOIN wire w USING (query_id) LEFT JOIN near n USING (query_id)
"""
LEAVES_SQL = f"""
WITH RECURSIVE {_ALL}, f AS (SELECT id, lag(id) OVER (PARTITION BY category ORDER BY id) AS before, first FROM (SELECT r.*, min(id) OVER (PARTITION BY category) AS first FROM reg r) WHERE is_derived),
e AS (SELECT id AS a, before AS b FROM f WHERE before IS NOT NULL UNION SELECT id, first FROM f), w AS (SELECT a AS root, b, 1 AS depth FROM e UNION SELECT w.root, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.b WHERE w.root <> w.b AND w.depth < 64)
SELECT root AS attribute_id, b AS leaf_id, min(depth) AS depth FROM w WHERE b NOT IN (SELECT a FROM e) GROUP BY ALL
"""


# Filing --------------------------------------------------------------------------------------------------------------
def _log(spark, d):
    return table(spark, d, "rule_assertions")


def fil_project(spark, d):
    return filing.verdicts(_log(spark, d)).groupBy("replayed").agg(F.count(F.lit(1)).alias("assertions"), F.countDistinct("identity_hash").alias("identities"))


def fil_verdicts(spark, d):
    return filing.verdicts(_log(spark, d))


def fil_as_believed(spark, d):
    return filing.as_believed(_log(spark, d), "2020-01-01 00:00:00")


def fil_log_checks(spark, d):
    return filing.log_violations(_log(spark, d))


_FIRST = """
rows AS (SELECT DISTINCT seq, effective_from, lower(identity_hash) AS identity_hash, lower(full_hash) AS full_hash FROM rule_assertions WHERE identity_hash IS NOT NULL),
placed AS (SELECT *, row_number() OVER w AS rn, first_value(full_hash) OVER w AS first_full FROM rows WINDOW w AS (PARTITION BY identity_hash ORDER BY effective_from, seq)),
judged AS (SELECT seq, identity_hash, CASE WHEN rn = 1 THEN 'new' WHEN full_hash IS NOT DISTINCT FROM first_full THEN 'restatement' ELSE 'amendment' END AS replayed FROM placed)
"""


# Expressions and evaluation ------------------------------------------------------------------------------------------
def expr_fingerprint(spark, d):
    return rules.fingerprints(_rules(spark, d), table(spark, d, "attributes")).drop("constraints")


def expr_constraints(spark, d):
    rows = rules.fingerprints(_rules(spark, d), table(spark, d, "attributes"))
    return rows.select("id", F.explode("constraints").alias("c")).select("id", F.array_join("c.attribute_ids", ",").alias("attribute_ids"), "c.shape", "c.op", "c.value")


EVALUATED = {
    "large": "[Order.total] >= 100000 AND NOT [Order.status] == 'F'",
    "stale": "days_since([Order.date]) > 180 OR months_since([Order.date]) > 60",
    "urgent": "[Order.priority] IN {'1-URGENT', '2-HIGH'} AND [Order.total] * 2 > 50000",
}


def eval_rules(spark, d):
    facts = {"Order.total": F.col("o_totalprice"), "Order.status": F.col("o_orderstatus"), "Order.date": F.to_date("o_orderdate"), "Order.priority": F.col("o_orderpriority")}
    as_of = F.lit("2001-08-02").cast("date")
    held = table(spark, d, "orders").agg(*[F.count_if(compile_rule(e, facts, as_of)).alias(n) for n, e in EVALUATED.items()])
    return held.unpivot([], list(EVALUATED), "rule", "holds")


EVAL_SQL = """
WITH o AS (SELECT o_totalprice AS t, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, DATE '2001-08-02' AS now FROM orders)
SELECT 'large' AS rule, count(*) FILTER (WHERE t >= 100000 AND NOT s = 'F') AS holds FROM o
UNION ALL SELECT 'stale', count(*) FILTER (WHERE date_diff('day', d, now) > 180 OR date_sub('month', d, now) > 60) FROM o
UNION ALL SELECT 'urgent', count(*) FILTER (WHERE p IN ('1-URGENT', '2-HIGH') AND t * 2 > 50000) FROM o
"""


def eval_cascade(spark, d):
    """For each derived attribute, the rules to evaluate again when it changes, by state."""
    changed = _register(spark, d).where("is_derived").select(F.col("id").alias("attribute_id"))
    uses = _rules(spark, d).select("id", "state", F.explode("attribute_ids").alias("attribute_id")).distinct()
    return uses.join(changed, "attribute_id").groupBy("attribute_id", "state").agg(F.count(F.lit(1)).alias("rules"))


def exp_lints(spark, d):
    rows = _rules(spark, d).where("rule_expression IS NOT NULL").select("id", "rule_expression", "attribute_ids", "audience_id").distinct()
    return rows.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(texts.vacuous(F.col("rule_expression"))).alias("vacuous"), F.count_if(texts.own_multiple(F.col("rule_expression"))).alias("own_multiple"),
        F.count_if(F.size("attribute_ids") == 0).alias("no_attribute"), F.count_if(F.col("audience_id").isNull()).alias("no_audience"),
    )


def exp_fidelity(spark, d):
    """Literals of a rule that its clause's text does not account for, by number of such literals."""
    rules_ = _rules(spark, d).select("id", "rule_expression", "source_clause_id").distinct()
    clauses = _current(spark, d, "text").select(F.col("id").alias("source_clause_id"), "text")
    left = texts.fidelity(rules_.join(clauses, "source_clause_id"))
    return left.groupBy(F.size("unexplained").alias("unexplained")).agg(F.count(F.lit(1)).alias("rules"))


def res_reference_drift(spark, d):
    return resolution.reference_drift(_rules(spark, d), _register(spark, d))


def res_consolidation(spark, d):
    return resolution.consolidation(_rules(spark, d), _register(spark, d))


def res_fragmented(spark, d):
    return resolution.fragmented(_register(spark, d))


def asm_applicability(spark, d):
    """Citations that restrict (subject to) or exempt (notwithstanding) rules, laid over each rule's audience."""
    from rulegrid.plans.linking import _resolved

    cites = links.once(table(spark, d, "unresolved_citations"), "raw_text", "from_clause_id")
    at = _resolved(spark, d).where("clause_id IS NOT NULL").join(cites.select(F.col("id").alias("citation_id"), "raw_text", "from_clause_id"), "citation_id")
    kind = F.when(F.lower("raw_text").startswith("notwithstanding"), "exempt").when(F.lower("raw_text").startswith("subject to"), "restrict")
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    modifiers = at.withColumn("effect", kind).where("effect IS NOT NULL").select(key("from_clause_id").alias("from_clause_no"), key("clause_id").alias("target"), "effect", F.concat(F.lit("clause "), F.col("from_clause_id").cast("string")).alias("condition"), F.lit(None).cast("string").alias("value"))
    held = links.once(_rules(spark, d), "source_clause_id", "audience_id").where("source_clause_id IS NOT NULL")
    base = F.when(F.col("audience_id").isNotNull(), F.array(F.concat(F.lit("audience "), F.col("audience_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = held.select("id", key("source_clause_id").alias("clause_no"), F.col("source_clause_id").alias("clause_id"), base.alias("base"))
    out = assembly.applied(rows, modifiers)
    return out.groupBy(F.size(F.regexp_extract_all("applicability", F.lit("not\\("), F.lit(0))).alias("exemptions"), F.col("conditions").isNull().alias("nested")).agg(F.count(F.lit(1)).alias("rules"))


# Reports -------------------------------------------------------------------------------------------------------------
def met_corpus(spark, d):
    rows = _current(spark, d, "doc_id", "clause_no", "heading", "is_title", "text")
    per = rows.rollup("doc_id").agg(
        F.count(F.lit(1)).alias("clauses"), F.count("clause_no").alias("numbered"), F.count("heading").alias("headings"), F.count_if("is_title").alias("titles"),
        F.count_if(F.length("text") < 60).alias("short"), F.grouping("doc_id").cast("int").alias("is_total"),
    )
    return per


def met_duplicate_numbers(spark, d):
    rows = _current(spark, d, "doc_id", "container", "clause_no").where("clause_no IS NOT NULL")
    twice = rows.groupBy("doc_id", F.coalesce("container", F.lit("")).alias("container"), "clause_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.sum("n").alias("clauses"))


def rep_trend(spark, d):
    from pyspark.sql import Window

    rows = _log(spark, d).groupBy("seq").agg(F.min(F.struct("created_at", "verdict")).alias("r")).select("seq", "r.*").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("assertions"), F.count_if(F.col("verdict") == "new").alias("opened"))
    # One row a month: the window is over a calendar, not over the log.
    before = F.lag("assertions").over(Window.orderBy("month"))
    return rows.select("month", "assertions", "opened", (F.col("assertions") - before).alias("change"))


def rep_runs(spark, d):
    """The last run of each circular and how many it took."""
    from rulegrid.operators.orphans import doc_key

    rows = links.once(table(spark, d, "ingestion_runs"), "doc_id", "status", "started_at").withColumn("doc", doc_key(F.col("doc_id")))
    last = rows.groupBy("doc").agg(F.max_by("status", F.struct("started_at", "id")).alias("last_status"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"))
    return last.groupBy("last_status").agg(F.count(F.lit(1)).alias("circulars"), F.sum("runs").alias("runs"), F.sum("completed").alias("completed"))


QUERIES = {
    "tree_prev_sibling": Query(tree_prev_sibling, f"WITH {_CURRENT} SELECT id, lag(id) OVER (PARTITION BY doc_id, parent_id ORDER BY id) AS previous_id FROM cur WHERE parent_id IS NOT NULL"),
    "tree_leaf": Query(tree_leaf, f"WITH {_CURRENT} SELECT doc_id, count(*) AS leaves FROM cur WHERE id NOT IN (SELECT parent_id FROM cur WHERE parent_id IS NOT NULL) GROUP BY doc_id"),
    "tree_offsets": Query(tree_offsets, f"WITH {_CURRENT}, s AS (SELECT id, coalesce(length(text), 0) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM cur) SELECT id, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + n AS BIGINT) AS char_end FROM s"),
    "tree_gap_audit": Query(tree_gap_audit, rf"""WITH {_CURRENT}, p AS (SELECT DISTINCT doc_id, regexp_extract(clause_no, '^((?:\d+\.)*)\d+$', 1) AS stem, CAST(nullif(regexp_extract(clause_no, '^(?:\d+\.)*(\d+)$', 1), '') AS INTEGER) AS n FROM cur WHERE clause_no IS NOT NULL AND container IS NULL),
        l AS (SELECT *, lead(n) OVER (PARTITION BY doc_id, stem ORDER BY n) AS nx FROM p WHERE n IS NOT NULL)
        SELECT doc_id, stem, n AS after, CAST(unnest(range(n + 1, nx)) AS INTEGER) AS missing FROM l WHERE nx - n BETWEEN 2 AND 4"""),
    "tree_path": Query(tree_path, TREE_PATH_SQL),
    "aud_stamp_tree": Query(aud_stamp_tree, STAMP_SQL),
    "text_repeated_lines": Query(text_repeated_lines, r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents), l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))), '[\s\x{00a0}]+', ' ', 'g')) AS line FROM d)
        SELECT regexp_replace(lower(line), '[0-9]+', '#', 'g') AS shape, count(DISTINCT doc_id) AS documents FROM l WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3"""),
    "text_normative_share": Query(text_normative_share, f"WITH {_CURRENT} SELECT doc_id, count(*) AS clauses, count(*) FILTER (WHERE length(text) >= 60 AND regexp_matches(text, '{texts.NORMATIVE}')) AS normative, count(*) FILTER (WHERE length(text) < 15) AS stubs FROM cur GROUP BY doc_id"),
    "text_window_dedupe": Query(text_window_dedupe, rf"WITH {_CURRENT} SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content, count(*) AS clauses, min(id) AS first_id FROM cur WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "text_number_pool": Query(text_number_pool, POOL_SQL),
    "cit_extract_summary": Query(cit_extract_summary, rf"WITH {_CURRENT}, c AS (SELECT id, unnest(regexp_extract_all(lower(text), '\b(?:{texts.CUES}) (?:\d+(?:\.\d+)*)')) AS c FROM cur WHERE text IS NOT NULL) SELECT split_part(c, ' ', 1) AS cue, split_part(c, ' ', 2) AS number, count(*) AS citations, count(DISTINCT id) AS clauses FROM c GROUP BY ALL"),
    "cit_extract": Query(cit_extract),
    "cit_summary": Query(cit_summary),
    "cit_kinds": Query(cit_kinds, rf"WITH r AS (SELECT DISTINCT id, lower(regexp_replace(raw_text, '\s+', ' ', 'g')) AS low FROM unresolved_citations) SELECT CASE {_KIND_CASES} ELSE 'reference' END AS kind, count(*) AS citations FROM r GROUP BY 1"),
    "res_knn": Query(res_knn, f"WITH {_NEAR} SELECT query_id, id, round(distance, 4) AS distance, rank FROM ranked WHERE rank <= 10"),
    "res_radius": Query(res_radius, f"WITH {_NEAR} SELECT query_id, id, rank FROM ranked WHERE rank <= 3 AND distance <= 0.35"),
    "res_bands": Query(res_bands, f"WITH {_NEAR} SELECT CASE WHEN distance < 0.15 THEN 'reuse' WHEN distance <= 0.45 THEN 'judge' ELSE 'new' END AS decision, count(*) AS attributes FROM ranked WHERE rank = 1 GROUP BY 1"),
    "res_tripwire": Query(res_tripwire, f"WITH {_NAMES}, {_MENTIONED}, c AS (SELECT category, name, count(*) AS mentions FROM mentioned GROUP BY ALL) SELECT c.category, c.name, c.mentions, n.id FROM c LEFT JOIN names n ON n.category = c.category AND n.name = c.name"),
    "res_name_choice": Query(res_name_choice, NAME_CHOICE_SQL),
    "res_gate": Query(res_gate, f"WITH {_GATE} SELECT query_id, id, round(distance, 4) AS distance, rejected FROM gate"),
    "res_funnel": Query(res_funnel, FUNNEL_SQL),
    "res_alias_provenance": Query(res_alias_provenance, f"WITH {_ALL}, {_NAMES}, {_MENTIONED}, h AS (SELECT n.id, list_sort(list_distinct(list(m.name))) AS heard FROM mentioned m JOIN names n USING (category, name) GROUP BY n.id) SELECT reg.id, array_to_string(list_concat(coalesce(list_filter(aliases, lambda x, i: list_position(aliases, x) = i), []), list_filter(coalesce(h.heard, []), lambda x: x <> canonical_name AND NOT list_contains(list_transform(coalesce(aliases, []), lambda y: lower(y)), lower(x)))), '|') AS aliases FROM reg LEFT JOIN h ON h.id = reg.id"),
    "res_composites": Query(res_composites, f"WITH {_ALL}, c AS (SELECT concat_ws(' ', CASE WHEN length(trim(replace(canonical_name, '_', ' '))) > 0 THEN 'name: ' || trim(replace(canonical_name, '_', ' ')) END, CASE WHEN length(trim(description)) > 0 THEN 'meaning: ' || trim(description) END, CASE WHEN length(trim(category)) > 0 THEN 'topic: ' || trim(category) END) AS composite, count(*) AS entries, min(id) AS first_id FROM reg GROUP BY 1) SELECT *, CAST((row_number() OVER (ORDER BY first_id) - 1) // 128 AS INTEGER) AS batch FROM c"),
    "res_types": Query(res_types, f"WITH {_ALL} SELECT data_type, CASE WHEN lower(trim(data_type)) IN ('number', 'date', 'boolean', 'string', 'document') THEN lower(trim(data_type)) ELSE 'string' END AS type, {_DIMENSION.format(u='unit')} AS dimension, count(*) AS attributes FROM reg GROUP BY ALL"),
    "exp_formula_leaves": Query(exp_formula_leaves, LEAVES_SQL),
    "res_jaccard_judge": Query(res_jaccard_judge, "WITH r AS (SELECT DISTINCT id, canonical_name, category, list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z]+'), lambda w: length(w) > 2)) AS w FROM attributes), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM r a JOIN r b ON a.canonical_name = b.canonical_name AND a.id < b.id AND a.category <> b.category) SELECT a, b, round(i / u, 6) AS similarity FROM p WHERE round(i / u, 6) >= 0.55"),
    "res_blast_radius": Query(res_blast_radius, "WITH u AS (SELECT DISTINCT id AS rule_id, unnest(attribute_ids) AS id FROM obligations), d AS (SELECT DISTINCT id FROM attributes WHERE is_derived) SELECT d.id, count(u.rule_id) AS rules FROM d LEFT JOIN u ON u.id = d.id GROUP BY 1"),
    "res_repoint": Query(res_repoint, "WITH n AS (SELECT DISTINCT id, canonical_name FROM attributes WHERE data_type = 'number'), m AS (SELECT id AS old, min(id) OVER (PARTITION BY canonical_name) AS nw FROM n), o AS (SELECT DISTINCT id, attribute_ids FROM obligations), u AS (SELECT id, unnest(attribute_ids) AS old FROM o), x AS (SELECT u.id, string_agg(DISTINCT CAST(coalesce(m.nw, u.old) AS VARCHAR), ',' ORDER BY CAST(coalesce(m.nw, u.old) AS VARCHAR)) AS unsorted, list_sort(list_distinct(list(coalesce(m.nw, u.old)))) AS ids FROM u LEFT JOIN m ON m.old = u.old GROUP BY u.id) SELECT o.id AS rule_id, coalesce(array_to_string(x.ids, ','), '') AS attribute_ids FROM (SELECT DISTINCT id FROM o) o LEFT JOIN x ON x.id = o.id"),
    "res_cluster": Query(res_cluster),
    "fil_project": Query(fil_project, f"WITH {_FIRST} SELECT replayed, count(*) AS assertions, count(DISTINCT identity_hash) AS identities FROM judged GROUP BY 1"),
    "fil_verdicts": Query(fil_verdicts, f"WITH {_FIRST} SELECT * FROM judged"),
    "fil_as_believed": Query(fil_as_believed, AS_BELIEVED_SQL),
    "fil_log_checks": Query(fil_log_checks, "SELECT 'repeated_seq' AS \"check\", count(*) AS rows FROM (SELECT seq FROM rule_assertions GROUP BY seq HAVING count(*) > 1) UNION ALL SELECT 'corrects_unknown', count(*) FROM (SELECT DISTINCT seq, corrects_seq FROM rule_assertions WHERE corrects_seq IS NOT NULL AND corrects_seq NOT IN (SELECT seq FROM rule_assertions)) UNION ALL SELECT 'corrects_later', count(*) FROM (SELECT DISTINCT seq, corrects_seq FROM rule_assertions WHERE corrects_seq >= seq) UNION ALL SELECT 'no_identity', count(*) FROM rule_assertions WHERE identity_hash IS NULL"),
    "expr_fingerprint": Query(expr_fingerprint),
    "expr_constraints": Query(expr_constraints),
    "eval_rules": Query(eval_rules, EVAL_SQL),
    "eval_cascade": Query(eval_cascade, "WITH u AS (SELECT DISTINCT id, state, unnest(attribute_ids) AS attribute_id FROM obligations) SELECT attribute_id, state, count(*) AS rules FROM u WHERE attribute_id IN (SELECT id FROM attributes WHERE is_derived) GROUP BY ALL"),
    "exp_lints": Query(exp_lints, r"""WITH o AS (SELECT DISTINCT id, rule_expression AS e, attribute_ids, audience_id FROM obligations WHERE rule_expression IS NOT NULL),
        m AS (SELECT id, bool_or(split_part(x, '|', 1) = split_part(x, '|', 2)) AS own FROM (SELECT id, unnest(list_transform(regexp_extract_all(e, '\[[\w.]+\]\s*(?:==|!=|<=|>=|<|>|≤|≥|≠)\s*\d+(?:\.\d+)?\s*\*\s*\[[\w.]+\]'), lambda h: regexp_extract(h, '^(\[[\w.]+\])', 1) || '|' || regexp_extract(h, '(\[[\w.]+\])$', 1))) AS x FROM o) GROUP BY id)
        SELECT count(*) AS rules, count(*) FILTER (WHERE regexp_matches(e, '(days|months|years)_since\([^)]*\)\s*>=\s*0([^\d.]|$)')) AS vacuous, count(*) FILTER (WHERE m.own) AS own_multiple,
               count(*) FILTER (WHERE len(attribute_ids) = 0) AS no_attribute, count(*) FILTER (WHERE audience_id IS NULL) AS no_audience FROM o LEFT JOIN m USING (id)"""),
    "exp_fidelity": Query(exp_fidelity),
    "res_reference_drift": Query(res_reference_drift, f"""WITH {_NAMES}, r AS (SELECT DISTINCT id AS rule_id, rule_expression, attribute_ids FROM obligations WHERE rule_expression IS NOT NULL),
        refs AS (SELECT DISTINCT rule_id, unnest(regexp_extract_all(lower(rule_expression), '\\[(\\w+\\.\\w+)\\]', 1)) AS ref FROM r),
        named AS (SELECT f.rule_id, n.id FROM refs f LEFT JOIN names n ON n.category = split_part(f.ref, '.', 1) AND n.name = split_part(f.ref, '.', 2)),
        listed AS (SELECT DISTINCT rule_id, unnest(attribute_ids) AS id FROM r WHERE rule_expression LIKE '%[%')
        SELECT 'unlisted' AS kind, count(DISTINCT rule_id) AS rules FROM named WHERE id IS NOT NULL AND (rule_id, id) NOT IN (SELECT (rule_id, id) FROM listed)
        UNION ALL SELECT 'unused', count(DISTINCT rule_id) FROM listed WHERE (rule_id, id) NOT IN (SELECT (rule_id, id) FROM named WHERE id IS NOT NULL)
        UNION ALL SELECT 'unknown', count(DISTINCT rule_id) FROM named WHERE id IS NULL"""),
    "res_consolidation": Query(res_consolidation),
    "res_fragmented": Query(res_fragmented, "WITH r AS (SELECT DISTINCT id, data_type, canonical_name, regexp_replace(regexp_replace(lower(canonical_name), '^(is|has|the|total|current|last)_', ''), '_(date|flag|count|amount|value|nos|inr|mn|cr|lakh|pct|bps|days|months|hrs|yrs|thousands)$', '') AS stem FROM attributes) SELECT data_type, stem, count(DISTINCT canonical_name) AS entries, min(id) AS first_id FROM r WHERE length(stem) > 6 GROUP BY ALL HAVING count(DISTINCT canonical_name) > 1"),
    "asm_applicability": Query(asm_applicability),
    "met_corpus": Query(met_corpus, f"WITH {_CURRENT} SELECT doc_id, count(*) AS clauses, count(clause_no) AS numbered, count(heading) AS headings, count(*) FILTER (WHERE is_title) AS titles, count(*) FILTER (WHERE length(text) < 60) AS short, CAST(grouping(doc_id) AS INTEGER) AS is_total FROM cur GROUP BY ROLLUP (doc_id)"),
    "met_duplicate_numbers": Query(met_duplicate_numbers, f"WITH {_CURRENT}, t AS (SELECT doc_id, coalesce(container, '') AS c, clause_no, count(*) AS n FROM cur WHERE clause_no IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, count(*) AS numbers, CAST(sum(n) AS BIGINT) AS clauses FROM t GROUP BY doc_id"),
    "rep_trend": Query(rep_trend, "WITH r AS (SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS assertions, count(*) FILTER (WHERE verdict = 'new') AS opened FROM (SELECT DISTINCT seq, created_at, verdict FROM rule_assertions) GROUP BY 1) SELECT month, assertions, opened, assertions - lag(assertions) OVER (ORDER BY month) AS change FROM r"),
    "rep_runs": Query(rep_runs, _keyed("WITH r AS (SELECT DISTINCT id, dockey(doc_id) AS doc, status, started_at FROM ingestion_runs), l AS (SELECT doc, arg_max(status, (started_at, id)) AS last_status, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed FROM r GROUP BY doc) SELECT last_status, count(*) AS circulars, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(completed) AS BIGINT) AS completed FROM l GROUP BY 1")),
}
