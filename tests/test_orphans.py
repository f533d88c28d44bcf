"""Problem 4: keys, kinds and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulegrid.operators import links, orphans

T = dt.datetime


@pytest.fixture
def tables(spark):
    clauses = [(1, "HSB/X/2020/000007", "1.2", None, True, T(2020, 1, 1)), (2, "HSB/X/2020/000007", "3", "Annexure A", True, T(2022, 1, 1)), (3, "HSB/X/2020/000007", "9", None, False, T(2020, 1, 1)), (4, "HSB/X/2020/000007", "1.2", None, True, T(2024, 1, 1)), (4, "HSB/X/2020/000007", "1.2", None, True, T(2024, 1, 1))]
    runs = [("r1", " hsb-x-2019-8", "completed"), ("r2", "HSB/X/2018/000009", "failed")]
    cites = [
        (1, 1, "Circular No. hsb x 2020 7", None, "Sr. No. 01. 2)", "PENDING"), (2, 1, None, "ANNEXURE-a", "(3)", "PENDING"), (3, 1, "HSB/X/2020/7", None, "9", None), (4, 1, "HSB/X/2019/000008;", None, "1", "X"),
        (5, 1, "HSB/X/2018/000009", None, None, "X"), (6, 1, None, None, None, "X"), (7, 99, None, None, "4", "X"), (8, 1, "HSB/X/2020/000007", None, None, "X"), (1, 1, "Circular No. hsb x 2020 7", None, "Sr. No. 01. 2)", "PENDING"),
    ]
    c = spark.createDataFrame([(*x, T(2021, 1, 1)) for x in cites], "id int, from_clause_id int, target_doc string, target_container string, target_clause_no string, state string, created_at timestamp").selectExpr("*", "CAST(NULL AS INT) AS from_obligation_id", "'depends_on' AS edge_type", "0 AS attempts", "'x' AS doc", "1 AS salt", "'x' AS kind")
    return c, spark.createDataFrame(clauses, "id int, doc_id string, clause_no string, container string, citable boolean, created_at timestamp"), spark.createDataFrame(runs, "id string, doc_id string, status string")


def test_kinds(tables):
    got = {r.citation_id: r.kind for r in orphans.dangling(*tables).collect()}
    assert got == {2: "late", 3: "no_clause", 4: "deleted", 5: "never", 7: "never"}
    report = orphans.dangling_report(*tables).collect()
    assert sum(r.citations for r in report) == 5 and {r.month for r in report} == {"2021-01"}


def test_resolution(spark, tables):
    paths = spark.createDataFrame([(1, "1")], "id int, path string")
    got = {r.citation_id: (r.result, r.clause_id) for r in links.resolved(*tables[:2], paths).collect()}
    assert got[1] == ("ambiguous", None) and got[2] == ("container", 2) and got[5] == ("external", None) and got[3] == ("absent", None)


def test_empty_tables(tables):
    c, k, r = tables
    assert orphans.dangling(c.limit(0), k, r).collect() == []
    assert {x.kind for x in orphans.dangling(c, k.limit(0), r.limit(0)).collect()} == {"never"}


@pytest.mark.parametrize("text, key", [("Circular No. HSB/DEP/2015/000039;", "HSB DEP 2015 39"), ("Hsb/Dep/2015–000039", "HSB DEP 2015 39"), ("circular no: HSB_DEP_2015_39", "HSB DEP 2015 39"), ("  ", None), (None, None)])
def test_doc_keys(spark, text, key):
    assert spark.createDataFrame([(text,)], "t string").select(orphans.doc_key(F.col("t"))).first()[0] == key
