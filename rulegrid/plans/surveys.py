"""Further queries over clauses, rules and citations: audits, snapshots and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrid.operators import ordered
from rulegrid.plans.linking import _RESOLVE, _resolved
from rulegrid.plans.reference import _CURRENT, _current, _rules
from rulegrid.plans.registry import Query
from rulegrid.runtime import table

TEETH = r"(?i)\b[0-9]+ (?:working |calendar |trading )?(?:days?|months?|hours?|cases)\b|\b(?:Rs|INR)\b"


def seg_recall_audit(spark, d):
    """Clauses with a number that binds from which no rule was drawn, by circular."""
    drawn = _rules(spark, d).select(F.col("source_clause_id").alias("id")).where("id IS NOT NULL").distinct()
    rows = _current(spark, d, "doc_id", "text", "is_title").where(F.col("text").rlike(TEETH) & ~F.col("is_title"))
    return rows.join(drawn, "id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.min("id").alias("first_id"))


def seg_effective_date(spark, d):
    """The first date written in each document; documents counted by its year, without one under null."""
    rows = table(spark, d, "documents").select("doc_id", "text").distinct()
    first = F.nullif(F.regexp_extract("text", r"\b((?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])\b", 1), F.lit("")).try_cast("date")
    return rows.groupBy(F.year(first).alias("year")).agg(F.count(F.lit(1)).alias("documents"))


def seg_sibling_context(spark, d):
    """Clauses that refer back ("such", "the said", "aforesaid"), with the length of the sibling text they lean on."""
    rows = _current(spark, d, "doc_id", "parent_id", "text").where("parent_id IS NOT NULL")
    looks_back = F.col("text").rlike(r"(?i)\b(?:such|the said|aforesaid|the above)\b")
    marked = rows.select("id", "doc_id", "parent_id", F.length(F.substring("text", 1, 400)).alias("n"), looks_back.alias("looks_back"))
    return ordered.previous(marked, ["doc_id", "parent_id"], "id", F.col("n"), "context").where("looks_back").select("id", "context")


def aud_queue_report(spark, d):
    """Audiences with how many clauses and rules they have; each side is counted before the join."""
    clauses = _current(spark, d, "audience_id").where("audience_id IS NOT NULL").groupBy("audience_id").agg(F.count(F.lit(1)).alias("clauses"))
    rules = _rules(spark, d).select("id", "audience_id").distinct().where("audience_id IS NOT NULL").groupBy("audience_id").agg(F.count(F.lit(1)).alias("rules"))
    return clauses.join(rules, "audience_id", "full").select("audience_id", F.coalesce("clauses", F.lit(0)).alias("clauses"), F.coalesce("rules", F.lit(0)).alias("rules"))


def aud_headings(spark, d):
    """Distinct headings of a circular whatever the case and blanks, with the first clause that has each."""
    rows = _current(spark, d, "doc_id", "heading").where("heading IS NOT NULL")
    return rows.groupBy("doc_id", F.lower(F.trim(F.regexp_replace("heading", r"\s+", " "))).alias("heading")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("clauses"))


def met_clause_grep(spark, d):
    """Where a phrase stands: in headings or in bodies, by circular."""
    rows = _current(spark, d, "doc_id", "heading", "text")
    hit = lambda c: F.coalesce(F.col(c).rlike(r"(?i)\baudit"), F.lit(False))
    return rows.groupBy("doc_id").agg(F.count_if(hit("heading")).alias("in_headings"), F.count_if(hit("text")).alias("in_bodies"))


_LINE = ("clause_no", "heading", "container", "text")


def met_snapshot(spark, d):
    """A fingerprint of each circular's clauses that does not depend on their order and adds up over partitions."""
    rows = _current(spark, d, "doc_id", *_LINE)
    line = F.concat_ws("|", F.col("id").cast("string"), *[F.coalesce(F.col(c), F.lit("")) for c in _LINE])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")).alias("fingerprint"))


def met_snapshot_diff(spark, d):
    """Rows that the last deliveries have and the first had not, and the other way, by circular."""
    rows = table(spark, d, "source_clauses").select("id", "created_at", "doc_id", "parent_id", "heading")
    value = F.struct("doc_id", "parent_id", "heading")
    ends = rows.groupBy("id").agg(F.max(F.struct("created_at", value.alias("v"))).alias("last"), F.min(F.struct("created_at", value.alias("v"))).alias("first"))
    sides = [ends.select("id", f"{s}.v.*") for s in ("last", "first")]
    added, gone = sides[0].exceptAll(sides[1]), sides[1].exceptAll(sides[0])
    both = added.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("g")).unionAll(gone.select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("g")))
    return both.groupBy("doc_id").agg(F.sum("a").alias("added"), F.sum("g").alias("gone"))


def met_citation_funnel(spark, d):
    return _resolved(spark, d).groupBy("result").agg(F.count(F.lit(1)).alias("citations"), F.sum("candidates").alias("candidates"))


_GREP = r"(?i)\baudit"

QUERIES = {
    "seg_recall_audit": Query(seg_recall_audit, f"WITH {_CURRENT} SELECT doc_id, count(*) AS clauses, min(id) AS first_id FROM cur WHERE regexp_matches(text, '{TEETH}') AND NOT is_title AND id NOT IN (SELECT source_clause_id FROM obligations WHERE source_clause_id IS NOT NULL) GROUP BY doc_id"),
    "seg_effective_date": Query(seg_effective_date, r"WITH r AS (SELECT DISTINCT doc_id, text FROM documents) SELECT CAST(year(TRY_CAST(nullif(regexp_extract(text, '\b((?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])\b', 1), '') AS DATE)) AS INTEGER) AS year, count(*) AS documents FROM r GROUP BY 1"),
    "seg_sibling_context": Query(seg_sibling_context, rf"WITH {_CURRENT}, p AS (SELECT id, text, lag(substr(text, 1, 400)) OVER (PARTITION BY doc_id, parent_id ORDER BY id) AS before FROM cur WHERE parent_id IS NOT NULL) SELECT id, CAST(length(before) AS INTEGER) AS context FROM p WHERE regexp_matches(text, '(?i)\b(?:such|the said|aforesaid|the above)\b')"),
    "aud_queue_report": Query(aud_queue_report, f"WITH {_CURRENT}, c AS (SELECT audience_id, count(*) AS n FROM cur WHERE audience_id IS NOT NULL GROUP BY 1), r AS (SELECT audience_id, count(DISTINCT id) AS n FROM obligations WHERE audience_id IS NOT NULL GROUP BY 1) SELECT coalesce(c.audience_id, r.audience_id) AS audience_id, coalesce(c.n, 0) AS clauses, coalesce(r.n, 0) AS rules FROM c FULL JOIN r ON c.audience_id = r.audience_id"),
    "aud_headings": Query(aud_headings, rf"WITH {_CURRENT} SELECT doc_id, lower(trim(regexp_replace(heading, '\s+', ' ', 'g'))) AS heading, min(id) AS first_id, count(*) AS clauses FROM cur WHERE heading IS NOT NULL GROUP BY 1, 2"),
    "met_clause_grep": Query(met_clause_grep, f"WITH {_CURRENT} SELECT doc_id, count(*) FILTER (WHERE regexp_matches(heading, '{_GREP}')) AS in_headings, count(*) FILTER (WHERE regexp_matches(text, '{_GREP}')) AS in_bodies FROM cur GROUP BY doc_id"),
    "met_snapshot": Query(met_snapshot, f"WITH {_CURRENT} SELECT doc_id, count(*) AS clauses, CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|' || {" || '|' || ".join(f"coalesce({c}, '')" for c in _LINE)}), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM cur GROUP BY doc_id"),
    "met_snapshot_diff": Query(met_snapshot_diff, """WITH r AS (SELECT DISTINCT id, created_at, doc_id, parent_id, heading FROM source_clauses),
        o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, doc_id DESC NULLS LAST, parent_id DESC NULLS LAST, heading DESC NULLS LAST) AS a, row_number() OVER (PARTITION BY id ORDER BY created_at, doc_id NULLS FIRST, parent_id NULLS FIRST, heading NULLS FIRST) AS b FROM r),
        l AS (SELECT id, doc_id, parent_id, heading FROM o WHERE a = 1), f AS (SELECT id, doc_id, parent_id, heading FROM o WHERE b = 1),
        u AS (SELECT doc_id, 1 AS a, 0 AS g FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM f) UNION ALL SELECT doc_id, 0, 1 FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM l))
        SELECT doc_id, CAST(sum(a) AS BIGINT) AS added, CAST(sum(g) AS BIGINT) AS gone FROM u GROUP BY doc_id"""),
    "met_citation_funnel": Query(met_citation_funnel, f"WITH {_RESOLVE} SELECT result, count(*) AS citations, CAST(sum(candidates) AS BIGINT) AS candidates FROM resolved GROUP BY result"),
}
