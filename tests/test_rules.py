"""The rule language, predicates, graph, text and ordering operators."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from rulegrid.functions import predicates, vectors
from rulegrid.functions.citations import read_citations
from rulegrid.functions.compiler import compile_rule
from rulegrid.functions.expressions import RuleError, canonical, compared_literals, constraints, fingerprint, parse, written
from rulegrid.operators import audiences, consistency, links, ordered, resolution, rules, segment, texts

IDS = {"Cyber.last_audit_date": 4471, "Cyber.scope": 5120, "Broker.net_worth": 991, "today": 1}


def cores(text, audience=7):
    f = fingerprint(text, audience, IDS)
    return f["identity_core"], f["full_core"]


@pytest.mark.parametrize(
    "a, b, identity, full",
    [
        ("180 >= days_since([Cyber.last_audit_date])", "days_since([Cyber.last_audit_date]) <= 180", True, True),
        ("[Broker.net_worth] > 1 AND [Cyber.scope] == 'x'", "[Cyber.scope] == 'x' AND [Broker.net_worth] > 1", True, True),
        ("days_since([Cyber.last_audit_date]) <= 180", "days_since([Cyber.last_audit_date]) <= 120", True, False),
        ("[Cyber.scope] == 'cloud'", "[Cyber.scope] == 'onprem'", True, False),
        ("[Broker.net_worth] > 5", "[Broker.net_worth] < 5", False, False),
        ("months_since([Cyber.last_audit_date]) <= 6", "days_since([Cyber.last_audit_date]) <= 180", True, True),
        ("[Cyber.scope] IN {'b', 'a'}", "[Cyber.scope] IN {'a', 'b'}", True, True),
    ],
)
def test_fingerprint_pairs(a, b, identity, full):
    assert (cores(a)[0] == cores(b)[0], cores(a)[1] == cores(b)[1]) == (identity, full)


def test_fingerprint_fallback_and_audience():
    assert cores("[Broker.net_worth] > 5", 7)[0] != cores("[Broker.net_worth] > 5", 8)[0]
    f = fingerprint("shall keep  Adequate systems", 7, {"a": 2, "b": 1})
    assert f["canonical"] is None and f["identity_core"].startswith("a:7|attestable|ids:[1, 2]|") and f["identity_core"] == f["full_core"]


@pytest.mark.parametrize("text, error", [("", "empty expression"), ("[A.b] ~ 3", "bad character at 6: '~'"), ("foo(1) > 2", "unknown function 'foo'"), ("1 2", "trailing input from '2'"), ("AND", "unexpected keyword 'AND'"), ("(1", "unexpected end of expression")])
def test_errors(text, error):
    with pytest.raises(RuleError, match="^" + __import__("re").escape(error)):
        parse(text)


def test_constraints_only_where_they_always_hold():
    tree = canonical(parse("[Broker.net_worth] >= 9 AND NOT [Broker.net_worth] <= 3 AND ([Cyber.scope] == 1 OR [Broker.net_worth] < 2)"))
    assert constraints(tree, IDS) == [([991], "#991", ">=", 9.0)]
    assert written(parse("a + 1 * 2 <= 3"), {}) == "cmp:<=(arith:+(?a,arith:*(n:1,n:2)),n:3)" and compared_literals(parse("years_since(a) < 0.5")) == [180]


def test_compiled_rules_follow_three_valued_logic(spark):
    df = spark.createDataFrame([(5.0, dt.date(2024, 1, 31)), (None, None)], "x double, d date")
    cols, now = {"A.x": F.col("x"), "A.d": F.col("d")}, F.lit("2024-03-30").cast("date")
    both = df.select(compile_rule("[A.x] > 4 AND months_since([A.d]) == 1", cols, now), compile_rule("exists([A.x]) OR [A.x] > 1", cols, now), compile_rule("NOT [A.x] IN {4, 6}", cols, now), compile_rule("days_between([A.d], today) >= 59", cols, now)).collect()
    assert [tuple(r) for r in both] == [(True, True, True, True), (None, None, None, None)]


def test_fingerprints_of_tables(spark):
    r = spark.createDataFrame([(1, 7, "[A.x] ≤ 5 && [A.y] == 'q'"), (1, 7, "[A.x] ≤ 5 && [A.y] == 'q'"), (2, None, "prose only"), (3, 7, None)], "id int, audience_id int, rule_expression string").selectExpr("*", "'z' AS ids")
    a = spark.createDataFrame([(40, "A", "x", ["ex"]), (41, "a", "why", ["Y"])], "id int, category string, canonical_name string, aliases array<string>")
    got = {x.id: x for x in rules.fingerprints(r, a).collect()}
    assert set(got) == {1, 2} and got[1].canonical == "and(cmp:<=(#40,n:5),cmp:==(#41,s:q))" and got[2].error and got[1].constraints[0].attribute_ids == [40]


def test_predicates(spark):
    cases = [("category == 'b' && is_qsb == true", "category == 'b'", "narrower"), ("n > 50000", "n > 10000", "narrower"), ("n >= 5", "n > 5", "broader"), ("a == 'x'", "a in ['x', 'y']", "narrower"), ("a in ['y','x']", "a in ['x', 'y']", "identical"), ("a == 'x'", "b == 'x'", "unrelated")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    ab = [predicates.conditions(F.col(c)) for c in "ab"]
    assert all(r[0] == r.want for r in df.select(predicates.compared(*ab).alias("got"), "want").collect())
    assert spark.range(1).select(predicates.normalised(predicates.conditions(F.lit("n > 5 && is_qsb == TRUE && c == \"x\"")), {"is_qsb": "category == 's'"})).first()[0] == "c == 'x' && category == 's' && is_qsb == true && n > 5"
    assert spark.range(1).select(predicates.contradictory(predicates.conditions(F.lit("a == 'x' && a == 'y'")))).first()[0]


def test_conflict_counts_equal_all_pairs(spark):
    ops = ["<=", "<", ">=", ">", "=="]
    rows = [(i, 1, "a", op, float(v)) for i, (op, v) in enumerate(itertools.product(ops, (90, 180, 365)))]
    df = spark.createDataFrame(rows, "rule_id int, audience_id int, attribute string, op string, value double").withColumn("i", consistency.intervals(F.col("value"), F.col("op"))).selectExpr("rule_id", "audience_id", "'ACTIVE' AS state", "attribute", "op", "value", "i.*")
    holds = {"<=": lambda x, v: x <= v, "<": lambda x, v: x < v, ">=": lambda x, v: x >= v, ">": lambda x, v: x > v, "==": lambda x, v: x == v}
    points = [p / 2 for p in range(0, 1000)]
    want = {i: sum(not any(holds[o](x, v) and holds[p](x, w) for x in points) for j, (p, w) in enumerate((r[3], r[4]) for r in rows)) for i, (o, v) in enumerate((r[3], r[4]) for r in rows)}
    assert {r.rule_id: r.conflicts for r in consistency.conflicts(df).collect()} == {i: n for i, n in want.items() if n}


def test_stars(spark):
    df = spark.createDataFrame([(1, [3, 2], 9), (2, [2, 3, 3], 9), (3, [2], None), (4, None, 9), (2, [2, 3, 3], 9)], "id int, attribute_ids array<int>, source_clause_id int")
    assert [tuple(r) for r in links.shared_evidence(df, 2).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in links.shared_evidence(df.union(df.sparkSession.createDataFrame([(9, [2], 1)], df.schema))).collect()) == [(1, 2), (3, 9)]
    assert sorted(tuple(r) for r in links.split_of(df).collect()) == [(1, 2), (1, 4)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0]), ([], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.4, 1.0, 1.0]


def test_clusters_are_led_by_the_first(spark):
    unit = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    rows = [(1, "A", "net_worth", "number", "lakh", unit(1.0)), (2, "A", "networth", "number", "crore", unit(0.9)), (3, "A", "limit_1", "number", None, [0.0, 0.0, 1.0]), (4, "A", "limit_2", "number", None, [0.0, 0.0, 1.0]), (5, "A", "gap", "number", "days", unit(0.95)), (6, "A", "far", "number", None, unit(0.75)), (7, "B", "net_worth", "number", None, unit(1.0))]
    df = spark.createDataFrame(rows, "id int, category string, canonical_name string, data_type string, unit string, vector array<float>")
    assert {r.id: (r.leader, r.borderline) for r in resolution.clustered(df).collect()} == {1: (1, False), 2: (1, False), 3: (3, False), 4: (4, False), 5: (5, False), 6: (5, True), 7: (7, False)}
    got = {r.canonical_name: (r.c, r.t) for r in df.select("canonical_name", resolution.clarity(F.col("canonical_name")).alias("c"), resolution.data_type(F.lit("Currency")).alias("t")).collect()}
    assert got["net_worth"] == (2 * 2 - 3 + 4 / 4, "number") and got["gap"][0] == 2 - 3 + 3 / 4
    near = spark.createDataFrame([(9, "A", "net_worth", "date", None, unit(1.0)), (10, "A", "other", "number", None, unit(0.99)), (11, "A", "zzz", "number", None, unit(0.7)), (12, "A", "yyy", "number", "hours", [0.0, 1.0, 0.0])], "query_id int, category string, name string, data_type string, unit string, vector array<float>")
    reg = df.where("id IN (1, 2)").withColumn("aliases", F.array().cast("array<string>"))
    assert {r.query_id: (r.decision, r.id) for r in resolution.funnel(near, reg).collect()} == {9: ("new", None), 10: ("reuse", 1), 11: ("reuse", 2), 12: ("new", None)}


def test_running_sum_and_gaps(spark):
    df = spark.createDataFrame([("a", i, i if i % 3 else None) for i in range(40)] + [("b", 7, 5), (None, 1, 2)], "k string, o int, v int")
    got = {(r.k, r.o): r.s for r in ordered.running_sum(df, ["k"], "o", F.col("v"), "s", block=8).collect()}
    assert got == {**{("a", i): sum(j for j in range(i) if j % 3) for i in range(40)}, ("b", 7): 0, (None, 1): 0}
    back = {(r.k, r.o): r.p for r in ordered.previous(df, ["k"], "o", F.col("v"), "p", block=8).collect()}
    assert back == {**{("a", i): (i - 1 if (i - 1) % 3 else None) if i else None for i in range(40)}, ("b", 7): None, (None, 1): None}
    holes = ordered.gaps(spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("a", 3), ("a", None)], "k string, n int"), ["k"], "n", 3)
    assert [(r.after, r.missing) for r in holes.collect()] == [(1, 2)]


def test_citations():
    read = lambda t: [(c.cue, c.number, c.target, c.container, c.range_to) for c in read_citations(t)]
    assert read("as per para 9.5 of Annexure B and section 4 of the Securities Act") == [("para", "9.5", "internal", "Annexure B", None), ("section", "4", "statute", None, None)]
    assert [c[1] for c in read("paras 55.13, 55.14 and 55.20")] == ["55.13", "55.14", "55.20"]
    assert [(c[1], c[4]) for c in read("clauses 4.1 to 4.9, 4.11 & 5")] == [("4.1", "4.9"), ("4.11", None), ("5", None)]
    assert read("") == [] == read(None) and read("paragraph without number") == []
    assert read("Annexure A, para 3 (ii)") == [("annexure", "A", "annexure", None, None), ("para", "3(ii)", "internal", "Annexure A", None)]
    (c,) = read_citations("A firm unable to comply with clause No. 9.5 of circular HSB/DEP/2015/000039 shall report")
    assert (c.kind, c.target, c.number, c.target_doc) == ("trigger", "internal", "9.5", "HSB/DEP/2015/000039")
    (c,) = read_citations("clause 4 of the SEBI (Intermediaries) Regulations, 2008")
    assert (c.target, c.target_doc) == ("statute", "SEBI (Intermediaries) Regulations")
    kinds = ["para 3 stands withdrawn", "para 3 is hereby amended", "as defined in para 3", "nothing contained in para 3", "in case the broker fails under para 3", "see para 3"]
    assert [read_citations(t)[0].kind for t in kinds] == ["supersedes", "amends", "definitional", "exemption", "trigger", "reference"]
    assert len(read_citations("see clause 4 " * 5000)) == 5000


def test_operators_bind_as_told():
    form = lambda t: written(parse(t), {})
    assert form("a + 1 * 2 <= 3 AND b == 1 AND NOT c IN {1, 2} OR d") == "or(and(cmp:<=(arith:+(?a,arith:*(n:1,n:2)),n:3),cmp:==(?b,n:1),not(in(?c,set(n:1,n:2)))),?d)"
    assert form("(a AND b) AND c") == "and(and(?a,?b),?c)" and form("a - 1 - 2 * 3 > 4") == "cmp:>(arith:-(arith:-(?a,n:1),arith:*(n:2,n:3)),n:4)"
    for text, error in (("a < b < c", "trailing input from '<'"), ("NOT NOT a", "unexpected keyword 'NOT'"), ("NOT a == b == c", "trailing input from '=='"), ("a + NOT b", "unexpected keyword 'NOT'"), ("a AND", "unexpected end of expression")):
        with pytest.raises(RuleError, match="^" + __import__("re").escape(error)):
            parse(text)


def test_segments(spark):
    lines = ["Subject: Conduct of audits by firms.", "CHAPTER I", "1. Audit of firms", "that hold re-", "cords", "1.1 Firms shall audit.", "CHAPTER II", "1.1 Orphan number here"] + [f"{i}. Entry {i} {i}" for i in range(2, 8)]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)] + [("e", 0, None), ("f", 0, "plain")], "doc_id string, line_no int, line string")
    cut = segment.marked(segment.parented(segment.islands(df)))
    rows = {r.idx: r for r in cut.where("doc_id = 'd'").collect()}
    assert rows[2].text == "Audit of firms that hold records" and rows[3].parent_idx == 2 and rows[5].parent_idx == 4 and rows[0].kind == "preamble"
    assert {i for i, r in rows.items() if r.is_toc} == {6, 7, 8, 9, 10, 11} and rows[1].is_junk
    assert segment.title(cut).where("doc_id = 'd'").first().title == "Conduct of audits by firms" and cut.where("doc_id = 'e'").count() == 0
    assert segment.windows(cut).where("doc_id = 'd' AND idx = 3").first().window.startswith("[CHAPTER I › Audit of firms")
    script = spark.createDataFrame([("अधिसूचना / Notice (सूचना) to firms",), ("केवल हिंदी",), ("English",)], "l string").select(segment.without_second_script(F.col("l"))).collect()
    assert [r[0] for r in script] == ["Notice to firms", None, "English"]


def test_modifiers_are_routed_and_folded(spark):
    from rulegrid.operators import assembly

    r = spark.createDataFrame([(1, "9.5.1", 11, ["qsb"]), (2, "12.3", 12, []), (3, "4", 13, ["b", "a"]), (4, "4", 14, None)], "id int, clause_no string, clause_id int, base array<string>")
    m = [("1", "9.5.1", "restrict", "n > 5", None), ("2", "9.5.1", "extend", "cm", None), ("3", "12.3", "exempt", "n < 500", None), ("8", "3", "exempt", "x", None), ("5", "99", "exempt", "x", None), ("6", "4", "exempt", "x", None), ("7", "9.5.1", "override", "qsb", "90"), ("1", "9.5.1", "restrict", "n > 5", None)]
    mods = spark.createDataFrame(m, "from_clause_no string, target string, effect string, condition string, value string")
    assert {x.from_clause_no: x.route for x in assembly.routed(mods, r).collect()} == {"1": "indexed", "2": "indexed", "3": "indexed", "8": "chained", "5": "orphaned", "6": "ambiguous", "7": "indexed"}
    got = {x.rule_id: x for x in assembly.applied(r, mods).collect()}
    assert got[1].applicability == "or(and(n > 5, qsb), cm)" and got[1].overrides == ["90@qsb"] and got[1].conditions is None
    assert got[2].applicability == "and(not(n < 500))" and got[3].conditions == ["a", "b"]


def test_edges_on_loops_and_between_them(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6), (1, 2), (7, 8), (8, 9), (9, 7)]
    rows = [(i, a, b, "depends_on") for i, (a, b) in enumerate(pairs)] + [(50, 2, 1, "amends")]
    got = {(r.from_id, r.to_id, r.type): (r.in_cycle, r.admitted) for r in links.admitted(spark.createDataFrame(rows, "citation_id int, from_id int, to_id int, type string")).collect()}
    loops = {(1, 2), (2, 1), (4, 5), (5, 4), (7, 8), (8, 9), (9, 7)}
    assert {k[:2] for k, v in got.items() if v[0]} == loops and got[2, 1, "amends"] == (False, True)
    assert {k for k, v in got.items() if not v[1]} == {(2, 1, "depends_on"), (5, 4, "depends_on"), (9, 7, "depends_on")}
    assert links.admitted(spark.createDataFrame(rows[:1], "citation_id int, from_id int, to_id int, type string").limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_edges_are_admitted_in_order(spark, seed):
    rng = __import__("random").Random(seed)
    rows = [(i, rng.randrange(30), rng.randrange(30), "depends_on") for i in range(70)]
    taken, want = {}, {}
    for _, a, b, _ in rows:
        if a != b and (a, b) not in want:
            seen, todo = {b}, [b]
            while todo:
                todo += [y for y in taken.get(todo.pop(), ()) if y not in seen and not seen.add(y)]
            want[a, b] = a not in seen
            if want[a, b]:
                taken.setdefault(a, []).append(b)
    df = spark.createDataFrame(rows, "citation_id int, from_id int, to_id int, type string").repartition(7)
    assert {(r.from_id, r.to_id): r.admitted for r in links.admitted(df).collect()} == want and not all(want.values())


def test_links_of_the_fixture(spark):
    when = dt.datetime(2020, 1, 1)
    tree = [(1, "9", None, False, None), (2, "9.5", 1, True, None), (3, "9.5.3", 2, True, None), (4, "9.5.3.1", 3, True, None), (5, "9.5.3.2", 3, True, None), (6, None, None, False, "Annexure A"), (7, "1", 6, True, "Annexure A"), (8, "2", 6, True, "Annexure A"), (9, "1", 1, True, None), (10, "9.5.3.1", None, False, None), (11, "1", 1, True, None)]
    paths = {1: "1", 2: "1/2", 3: "1/2/3", 4: "1/2/3/4", 5: "1/2/3/5", 6: "6", 7: "6/7", 8: "6/8", 9: "1/9", 10: "10", 11: "1/11"}
    clauses = spark.createDataFrame([(i, "D", no, p, ok, box, when) for i, no, p, ok, box in tree], "id int, doc_id string, clause_no string, parent_id int, citable boolean, container string, created_at timestamp")
    cites = [(1, 5, None, "depends_on", "D", None, "9.5.3.1"), (2, 8, None, "depends_on", "D", "Annexure A", "1"), (3, 5, None, "depends_on", "D", None, "1"), (4, 5, None, "depends_on", "D", None, None), (5, 5, None, "depends_on", "D", None, "99.9"), (6, 9, None, "amends", "D", None, "1"), (7, 5, None, "amends", "D", None, "9.5"), (8, 3, None, "depends_on", "D", None, "9.5")]
    c = spark.createDataFrame([(*x[:4], "PENDING", 4 if x[0] == 5 else 0, *x[4:]) for x in cites], "id int, from_clause_id int, from_obligation_id int, edge_type string, state string, attempts int, target_doc string, target_container string, target_clause_no string")
    p = spark.createDataFrame(list(paths.items()), "id int, path string")
    found = links.resolved(c, clauses, p)
    got = {r.citation_id: (r.result, r.clause_id) for r in found.collect()}
    assert got == {1: ("unique", 4), 2: ("container", 7), 3: ("ambiguous", None), 4: ("external", None), 5: ("absent", None), 6: ("scoped", 11), 7: ("unique", 2), 8: ("unique", 2)}
    rules = spark.createDataFrame([(50, 5), (51, 4), (52, 4), (53, 2), (54, 9), (55, 11), (56, 2)], "id int, source_clause_id int")
    edges, parked = links.proposed(c, clauses, rules, found)
    assert {(r.citation_id, r.from_id, r.to_id, r.state, r.confidence) for r in edges.collect()} == {(1, 50, 51, "ACTIVE", 0.9), (1, 50, 52, "ACTIVE", 0.9), (3, 50, 54, "REVIEW", 0.4), (3, 50, 55, "REVIEW", 0.4), (6, 54, 55, "REVIEW", 0.7)}
    assert {r.citation_id: r.reason for r in parked.collect()} == {2: "no_source_rule", 4: "external", 5: "absent", 7: "target_not_precise", 8: "no_source_rule"}
    sweep = {r.citation_id: (r.state, r.attempts, r.clause_id) for r in links.swept(c, clauses).collect()}
    assert sweep[1] == ("RESOLVED", 1, 4) and sweep[2] == ("RESOLVED", 1, 7) and sweep[3] == ("PENDING", 1, None) and sweep[5] == ("ABANDONED", 5, None) and sweep[7] == ("PENDING", 1, None)


def test_dead_and_subsumed_rules_and_overlapping_audiences(spark):
    reg = spark.createDataFrame([(7, "category == 'stock_broker' && is_qsb == true"), (8, "category == 'stock_broker'"), (9, "category == 'investment_adviser'"), (3, "category == 'bank' && is_qsb == true")], "audience_id int, predicate string")
    parsed = reg.select("audience_id", audiences.parsed(F.col("predicate")).alias("conditions"))
    assert {(r.narrower, r.broader) for r in audiences.relations(parsed).collect()} == {(7, 8), (3, 8), (3, 7)}
    rules = spark.createDataFrame([(1, 7, "ACTIVE"), (2, 8, "ACTIVE"), (3, 9, "REVIEW"), (4, None, "REVIEW"), (5, 3, "SUPERSEDED"), (6, 7, "ACTIVE")], "id int, audience_id int, state string")
    con = [(1, 7, "ACTIVE", "a", ">=", 9.0), (2, 8, "ACTIVE", "a", "<=", 5.0), (3, 9, "REVIEW", "a", "<=", 5.0), (3, 9, "REVIEW", "a", ">", 5.0), (6, 7, "ACTIVE", "a", "<=", 5.0)]
    rows = spark.createDataFrame(con, "rule_id int, audience_id int, state string, attribute string, op string, value double").withColumn("i", consistency.intervals(F.col("value"), F.col("op"))).select("rule_id", "audience_id", "state", "attribute", "op", "value", "i.*")
    alone = {(r.rule_id, r.op): (r.conflicts, r.example, r.severity) for r in consistency.conflicts(rows).collect()}
    assert alone == {(1, ">="): (1, 6, "high"), (6, "<="): (1, 1, "high"), (3, "<="): (1, 3, "medium"), (3, ">"): (1, 3, "medium")}
    over = {(r.rule_id, r.op): r.conflicts for r in consistency.conflicts(rows, audiences.overlaps(parsed)).collect()}
    assert over[1, ">="] == 2 and over[2, "<="] == 1 and over[6, "<="] == 1
    assert {(r.rule_id, r.cause, r.severity) for r in consistency.dead_rules(rules, rows, parsed).collect()} == {(3, "own_conflict", "medium"), (4, "no_audience", "low")}
    assert [(r.narrower, r.broader, r.first_rule, r.broader_rule) for r in consistency.subsumed(rows, audiences.relations(parsed)).collect()] == [(7, 8, 6, 2)]


def test_many_rules_are_compared_without_pairs(spark):
    """50,000 rules over 5,000 attributes and three planted ones; the plan holds no product of rules."""
    rules = spark.range(50_000).selectExpr("CAST(id AS INT) AS id", "1 AS audience_id", "'ACTIVE' AS state", "concat('[A.x', id % 5000, '] <= ', 100 + id % 7) AS rule_expression")
    bad = spark.createDataFrame([(60_000 + i, 1, "ACTIVE", f"[A.x{i}] >= 9999") for i in range(3)], "id int, audience_id int, state string, rule_expression string")
    reg = spark.createDataFrame([], "id int, category string, canonical_name string, aliases array<string>, data_type string, unit string, description string")
    began = __import__("time").perf_counter()
    found = consistency.conflicts(consistency.constraints(rules.unionByName(bad), reg))
    got = found.collect()
    assert __import__("time").perf_counter() - began < 30 and len(got) == 33 and {r.conflicts for r in got if r.rule_id >= 60_000} == {10}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_audience_texts(spark):
    cases = [("Circular to all stock brokers and depositories", "x", "category in ['depository', 'stock_broker']"), ("Note", "for every Custodian", "category == 'custodian'"), ("For Regulated Entities", None, "regulator == 'sebi'"), (None, None, None)]
    df = spark.createDataFrame([(t, o, w) for t, o, w in cases], "t string, o string, w string")
    for r in df.select(audiences.document_audience(F.col("t"), F.col("o")).alias("g"), "w", "t").collect():
        assert r.g == r.w or r.t.startswith("Circular") and r.g == "category == 'stock_broker'"
    heads = {r[0]: r[1] for r in spark.createDataFrame([("Duties of Qualified Stock Brokers",), ("Custodians of assets",), ("Net worth",), (None,)], "h string").select("h", audiences.heading_audience(F.col("h"))).collect()}
    assert heads == {"Duties of Qualified Stock Brokers": "is_qsb == true", "Custodians of assets": "category == 'custodian'", "Net worth": None, None: None}
    rungs = audiences.laddered(
        spark.createDataFrame([(1, "category == 'bank'"), (2, "bogus == 1"), (3, ""), (4, "aum > 5"), (5, "aum > 6")], "key int, predicate string"),
        spark.createDataFrame([(10, "category == 'bank'"), (11, "aum > 7")], "audience_id int, predicate string"),
        spark.createDataFrame([(4, 11, 0.2, 0.9), (5, 11, 0.2, 0.4)], "key int, audience_id int, distance double, judgement double"),
    )
    assert {r.key: (r.rung, r.audience_id) for r in rungs.collect()} == {1: ("hash", 10), 2: ("refused", None), 3: ("refused", None), 4: ("judged", 11), 5: ("created", None)}


def test_lints_and_fidelity(spark):
    df = spark.createDataFrame([("days_since([A.d]) >= 0", True, False), ("[A.x] >= 2 * [A.x]", False, True), ("[A.x] == [A.x]", True, False), ("[A.x] <= [A.xy] AND count([A.x]) >= 05", False, False)], "e string, v boolean, o boolean")
    assert all(r[0] == r.v and r[1] == r.o for r in df.select(texts.vacuous(F.col("e")), texts.own_multiple(F.col("e")), "v", "o").collect())
    pool = texts.number_pool(F.lit("submit half-yearly within 12 days under clause 77 from 2021, up to 1,50,000"))
    left = spark.range(1).select(texts.unexplained(F.array(*[F.lit(float(x)) for x in (0, 1, 6, 180, 12, 84, 288, 77, 150000, 13)]), pool)).first()[0]
    assert left == [77.0, 13.0]
    out = spark.createDataFrame([("[A.x1] <= 180",), ("[A.x] BETWEEN 1 AND 2",)], "e string").select(*texts.without_number(F.col("e"), F.lit("90"))).collect()
    assert [tuple(r) for r in out] == [("[A.x1] <= 90", None), ("[A.x] BETWEEN 1 AND 2", "has 2 numbers")]


def test_register_reports(spark):
    a = spark.createDataFrame([(1, "A", "net_worth_mn", ["nw"], "number"), (2, "B", "net_worth_lakh", None, "number"), (3, "A", "gap", None, "number")], "id int, category string, canonical_name string, aliases array<string>, data_type string")
    r = spark.createDataFrame([(1, "[A.nw] > 1", [1]), (2, "[A.gap] > 1 AND [A.zz] > 1", [1]), (3, None, None)], "id int, rule_expression string, attribute_ids array<int>")
    assert {x.kind: x.rules for x in resolution.reference_drift(r, a).collect()} == {"unlisted": 1, "unused": 1, "unknown": 1}
    assert [(x.stem, x.entries) for x in resolution.fragmented(a).collect()] == [("net_worth", 2)]


def test_fidelity_reads_every_computable_rule_and_number_words(spark):
    rows = [
        (1, "5 lakh > [Custody.deposit_balance]", "a deposit below Rs. 5,00,000 shall"), (2, "7 <= [Grievance.retper]", "kept for nine years"),
        (3, "([Custody.uptlev] <= 34 days)", "within thirty-four days"), (4, "[A.b] <= twelve hrs", "at once"), (5, "[A.b] <= 'twelve hours'", "within twelve hours"),
        (6, "attest: within 99 days", "at once"), (7, "[A.b] >= Rs.400,000,000", "of forty crore rupees"), (8, None, "at once"), (9, "[A.b] <= 0.25", "25 per cent of it"), (10, "[A.b] == 'class 3'", "at once"),
    ]
    df = spark.createDataFrame(rows, "id int, rule_expression string, text string")
    got = {r.id: r.unexplained for r in texts.fidelity(df).collect()}
    assert got == {1: [], 2: [7.0], 3: [], 4: [12.0], 5: [], 7: [], 9: [], 10: []}


def test_constraints_in_every_spelling_conflict_in_common_units(spark):
    texts_ = [
        "[Cat.Window] <= seven days", "200 <= [cat.win]", "([Cat.window] BETWEEN 5 days AND 300 hours)", "[Cat.window] >= 2 weeks OR [Cat.debt] > 1", "NOT ([Cat.window] > 10)",
        "[Cat.debt] <= 5 lakh && days_since([Cat.window]) > 3", "Rs.600,000 <= [Cat.debt]", "months_since([Cat.window]) < 0.05", "attest: [Cat.debt] > 9 crore",
    ]
    rows = [(i, 1, e, "ACTIVE") for i, e in enumerate(texts_)]
    df = spark.createDataFrame(rows, "id int, audience_id int, rule_expression string, state string")
    reg = spark.createDataFrame([(1, "Cat", "window", ["win"], "number", "hours", ""), (2, "Cat", "debt", None, "number", "rupees", "")], "id int, category string, canonical_name string, aliases array<string>, data_type string, unit string, description string")
    full = consistency.constraints(df, reg)
    got = {(r.rule_id, r.attribute, r.op, r.value) for r in full.collect()}
    assert got == {
        (0, "1 time", "<=", 168.0), (1, "1 time", ">=", 200.0), (2, "1 time", ">=", 120.0), (2, "1 time", "<=", 300.0),
        (5, "2 money", "<=", 500000.0), (5, "1 since time", ">", 72.0), (6, "2 money", ">=", 600000.0), (7, "1 since time", "<", 36.0),
    }
    rows = full.collect()
    apart = lambda x, y: x.hi < y.lo or x.hi == y.lo and (x.hi_open or y.lo_open)
    want = {(a.rule_id, a.attribute, a.op): n for a in rows if (n := sum(a.attribute == b.attribute and (apart(a, b) or apart(b, a)) for b in rows))}
    assert {(r.rule_id, r.attribute, r.op): r.conflicts for r in consistency.conflicts(full).collect()} == want and len(want) == 6
