"""Drafting shapes, checks, evaluation and filing lanes on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulegrid.operators import audiences, checks, drafting, evaluation, filing, segment


@pytest.mark.parametrize(
    "text, expression, kind",
    [
        ("Brokers shall audit systems every six months.", "months_since(brokers_audit_systems_last_date) <= 6", "computable"),
        ("The report is filed within fifteen working days of the event", "days_between(report_filed_within_event_date, report_filed_within_action_date) <= 15", "computable"),
        ("Half-yearly returns of clients", "months_since(half_yearly_returns_last_date) <= 6", "computable"), ("Audit is done annually", "months_since(audit_done_annually_last_date) <= 12", "computable"),
        ("Net worth of at least Rs. 5,00,000 is kept", "net_worth_least_value >= 500000", "computable"), ("Fees not exceeding 25 per cent", "fees_exceeding_per_value <= 25", "computable"),
        ("Adequate records are kept", "exists(adequate_records_are_evidence)", "attestable"), ("", "exists(duty_evidence)", "attestable"),
    ],
)
def test_rules(spark, text, expression, kind):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(*drafting.rule(F.col("t"))).first()) == (expression, kind)


def test_modifiers_conditions_and_definitions(spark):
    rows = [("Notwithstanding clause 4.1, x", "exempt", "4.1"), ("subject to para 7", "restrict", "7"), ("clause 3 shall also apply to", "extend", "3"), ("instead of clause 2.2", "override", "2.2"), ("see clause 9", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, e string, n string")
    assert all((r[0], r[1]) == (r.e, r.n) for r in df.select(*[c.alias(x) for c, x in zip(drafting.modifier(F.col("t")), "ab")], "e", "n").collect())
    df = spark.createDataFrame([("if a broker has more than 5,000 active clients", "active_clients > 5000", True), ("Clearing members shall", "is_clearing_member == true", False), ("where a firm uses cloud services", "uses_cloud_services == true", True), ("x", None, False)], "t string, c string, p boolean")
    assert all(r[0] == r.c and (r[1] is not None) == r.p for r in df.select(drafting.firm_condition(F.col("t")).alias("a"), drafting.precondition(F.col("t")).alias("b"), "c", "p").collect())
    got = spark.createDataFrame([("Here Net Worth means capital plus free reserves; and so on",)], "t string").select(*drafting.definition(F.col("t"))).first()
    assert got[1] == "capital plus free reserves" and got[0].endswith("net_worth") and got[2]


def test_checks(spark):
    df = spark.createDataFrame([(1, "net_worth >= 5 AND worth > 1", {"worth": "A.worth", "net_worth": "A.net_worth"}), (2, None, None)], "id int, expression string, tokens map<string,string>")
    assert {r.id: r.expression for r in checks.rewritten(df).collect()} == {1: "[A.net_worth] >= 5 AND [A.worth] > 1", 2: None}
    lit = lambda x: F.lit(x)
    one = spark.range(1)
    assert tuple(one.select(*checks.exists_use(lit("exists([A.x]) AND 1 == 1"), lit("boolean"))).first()) == ("[A.x] == true AND 1 == 1", False)
    assert one.select(checks.exists_use(lit("exists(x)"), lit("date"))[1]).first()[0]
    assert one.select(checks.restates(lit("audit_report"), lit("Report of audit")), checks.restates(lit("audit"), lit("Audit")), checks.restates(lit("board_report"), lit("Report of audit"))).first()[:] == (True, False, False)
    pool = F.array(F.lit(120.0))
    cases = [("[A.x1] <= 180", "wrong", "120", ("[A.x1] <= 120", "corrected")), ("[A.x] <= 180", "wrong", "77", ("[A.x] <= 180", "refused")), ("[A.x] <= 180", "justified", None, ("[A.x] <= 180", "kept")), ("[A.x] <= 1 + 2", "wrong", "120", ("[A.x] <= 1 + 2", "refused")), ("[A.x] <= 1", "cannot_tell", None, ("[A.x] <= 1", "unsettled"))]
    for e, v, r, want in cases:
        assert tuple(one.select(*checks.corrected(lit(e), lit(v), lit(r).cast("string"), pool)).first()) == want
    assert one.select(checks.capped(lit(0.9), lit(True), lit(None).cast("boolean")), checks.capped(lit(0.9), lit(False))).first()[:] == (0.4, 0.9)


def test_statuses(spark):
    rows = [(1, 5.0, dt.date(2024, 1, 1)), (2, None, dt.date(2024, 1, 1)), (3, 1.0, dt.date(2023, 1, 1)), (4, 5.0, dt.date(2023, 9, 1))]
    df = spark.createDataFrame(rows, "firm int, x double, d date")
    facts = {"A.x": F.col("x"), "A.d": F.col("d")}
    out = evaluation.evaluated(df, {"r": "[A.x] > 2 AND days_since([A.d]) <= 200"}, facts, F.lit("2024-03-01").cast("date"), ["firm"])
    assert {r.firm: r.status for r in out.collect()} == {1: "GREEN", 2: "GREY", 3: "RED", 4: "AMBER"}
    assert [(r.rule, r.status) for r in evaluation.worst(out, "rule").collect()] == [("r", "RED")]
    assert [(r.firms, r.no_data, r.met, r.status) for r in evaluation.shares(out, "rule").collect()] == [(4, 1, 1, "RED")]
    later = out.withColumn("status", F.lit("RED"))
    assert {(r.was, r.now): r.firms for r in evaluation.transitions(out.drop("rule"), later.drop("rule"), ["firm"]).collect()}[("GREEN", "RED")] == 1
    at = F.lit("2024-03-01").cast("date")
    assert spark.range(1).select(evaluation.valid_at(F.lit("2024-01-01").cast("date"), F.lit(None).cast("date"), at), evaluation.valid_at(F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date"), at)).first()[:] == (True, False)


def test_lanes(spark):
    day = dt.date
    c = lambda *x: [{"kind": k, "target_identity_hash": t, "raw": ""} for k, t in x]
    rows = [(1, "A", "f", day(2024, 1, 1), c()), (2, "a", "F", day(2024, 2, 1), None), (3, "a", "g", day(2024, 3, 1), c()), (4, "b", "f", day(2024, 3, 1), c(("amends", "a"))), (5, "c", "f", day(2024, 3, 1), c(("repeals", "a"), ("amends", "a"))), (6, "d", "f", day(2024, 3, 1), c(("amends", "a"), ("amends", "b"))), (7, None, "f", day(2024, 3, 1), None), (1, "A", "f", day(2024, 1, 1), c())]
    df = spark.createDataFrame(rows, "seq long, identity_hash string, full_hash string, effective_from date, citations array<struct<kind:string,target_identity_hash:string,raw:string>>")
    assert {r.seq: (r.lane, r.verdict) for r in filing.classified(df).collect()} == {1: ("fingerprint", "new"), 2: ("fingerprint", "restatement"), 3: ("fingerprint", "amendment"), 4: ("citation", "amendment"), 5: ("citation", "repeal"), 6: ("citation", "ambiguous")}


def test_headings_carving_and_dates(spark):
    df = spark.createDataFrame([("d", "Scope", 12.0, False), ("d", "text", 10.0, False), ("d", "more", 10.0, None), ("d", "Bold", 10.0, True), ("d", "x" * 100, 14.0, True), ("e", None, None, None)], "doc_id string, line string, size double, bold boolean")
    assert {r.line for r in segment.headings(df).where("is_heading").collect()} == {"Scope", "Bold"}
    lines = ["1. The following firms are covered:", "1.1 Brokers", "1.2 Depositories", "1.3 it", "2. Other text of the clause here", "2.1 Alone"]
    cut = segment.carved(segment.parented(segment.islands(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line_no int, line string"))))
    assert {r.text for r in cut.where("is_carved").collect()} == {"Brokers", "Depositories"} and {r.text for r in segment.marked(cut).where("is_junk").collect()} == {"it", "Alone"}
    repeated = ["ANNEXURE A", "1. First clause of it", "CHAPTER I", "2. Second clause of it", "ANNEXURE A", "3. Third clause of it"]
    tree = segment.parented(segment.islands(spark.createDataFrame([("d", i, t) for i, t in enumerate(repeated)], "doc_id string, line_no int, line string")))
    assert {r.idx: r.parent_idx for r in tree.where("kind = 'clause'").collect()} == {2: 1, 4: 3, 6: 5}
    one = spark.range(1)
    assert one.select(segment.unglued(F.lit("18.6The firm")), segment.effective_date(F.lit("Circular of March 5, 2021 on audits"), F.lit("2026-01-01").cast("date")).cast("string"), segment.effective_date(F.lit("May 99, 2021"), F.lit("2026-01-01").cast("date")).cast("string")).first()[:] == ("18.6 The firm", "2021-03-05", "2026-01-01")


def test_labels_approval_and_overlaps(spark):
    reg = spark.createDataFrame([(1, "PROPOSED"), (2, "APPROVED"), (3, "PROPOSED")], "audience_id int, state string")
    labels = spark.createDataFrame([(1, "Stock  Brokers"), (1, "stock brokers"), (1, "Audit"), (2, None), (9, "x")], "audience_id int, label string")
    assert {r.audience_id: r.aliases for r in audiences.with_labels(reg, labels).collect()} == {1: ["Audit", "Stock Brokers"], 2: [], 3: []}
    asked = spark.createDataFrame([(1,), (1,), (2,), (7,)], "audience_id int")
    assert {r.audience_id: (r.state, r.changed) for r in audiences.approved(reg, asked).collect()} == {1: ("APPROVED", True), 2: ("APPROVED", False), 3: ("PROPOSED", False)}
    schema = "seq long, identity_hash string, full_hash string, effective_from date, audience_id int, attribute_ids array<int>, citations array<struct<kind:string,target_identity_hash:string,raw:string>>"
    rows = [(1, "a", "f", dt.date(2024, 1, 1), 7, [1, 2], None), (2, "b", "f", dt.date(2024, 1, 1), 7, [2], []), (3, "c", "f", dt.date(2024, 1, 1), 8, [2], []), (4, "d", "f", dt.date(2024, 1, 1), None, [2], []), (5, "A", "g", dt.date(2025, 1, 1), 7, [2], [])]
    log = spark.createDataFrame(rows, schema)
    assert {r.seq: r.candidates for r in filing.overlapping(log).collect()} == {1: 1, 2: 1} and filing.overlapping(log.limit(0)).collect() == []
