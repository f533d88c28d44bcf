"""Queries from the lines of documents to trees of clauses, and of sources, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulegrid.operators import segment, texts
from rulegrid.plans.problems import _keyed
from rulegrid.plans.reference import _CURRENT, _current
from rulegrid.plans.registry import Query
from rulegrid.runtime import table


def _islands(spark, d):
    return segment.islands(texts.lines(table(spark, d, "documents").select("doc_id", "text")))


def _tree(spark, d):
    return segment.carved(segment.parented(_islands(spark, d)))


def seg_islands(spark, d):
    rows = _islands(spark, d)
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "kind", "clause_no", "container", F.md5("text").alias("text"), "n_lines")


def seg_parents(spark, d):
    return _tree(spark, d).where("parent_idx IS NOT NULL").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("parent_idx").cast("long").alias("parent_idx"))


def seg_junk(spark, d):
    rows = segment.marked(_tree(spark, d))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_toc").alias("toc"), F.count_if("is_junk").alias("junk"), F.count_if("is_carved").alias("carved"))


def seg_titles(spark, d):
    return segment.title(_islands(spark, d)).where("title IS NOT NULL")


def seg_windows(spark, d):
    rows = segment.windows(_tree(spark, d))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("windows"), F.min("doc_id").alias("first_doc"), F.max(F.length("window")).alias("length"))


def seg_unglued(spark, d):
    """Lines that begin with a number stuck to a word, made so by taking a blank out, and read again after the repair."""
    lines = texts.lines(table(spark, d, "documents").select("doc_id", "text")).withColumn("line", F.regexp_replace("line", r"^(\d+) ([A-Z])", "$1.1$2"))
    again = segment.unglued(F.col("line"))
    return lines.where(again != F.col("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("repaired"), F.min(again).alias("first_line"))


def seg_effective(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "title", "published_at").distinct()
    told = F.concat_ws(", ", "title", F.when(F.col("doc_id") % 3 != 0, F.date_format("published_at", "MMMM d, yyyy")))
    return rows.select("doc_id", segment.effective_date(told, F.lit("2026-01-01").cast("date")).cast("string").alias("effective_from"))


def seg_second_script(spark, d):
    lines = texts.lines(table(spark, d, "documents").select("doc_id", "text"))
    bare = segment.without_second_script(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bare.isNull()).alias("dropped"), F.count_if(bare != F.col("line")).alias("stripped")).where("dropped + stripped > 0")


def seg_back_references(spark, d):
    """What a clause's back-reference leans on: a named noun, an opaque word, or a continuation; and where it is explained."""
    rows = _current(spark, d, "doc_id", "parent_id", "text").where("parent_id IS NOT NULL AND text IS NOT NULL")
    up = _current(spark, d, "heading", "text").select(F.col("id").alias("parent_id"), "heading", F.col("text").alias("above"))
    noun = F.nullif(F.regexp_extract(F.lower("text"), r"\b(?:such|said|aforesaid) ([a-z]{3,})", 1), F.lit(""))
    kind = F.when(noun.isNotNull(), "named").when(F.lower("text").rlike(r"\b(?:the same|the above|aforesaid|hereinabove)\b"), "opaque").when(F.col("text").rlike(r"^(?:[a-z]|Provided|Further)"), "continuation")
    both = rows.withColumns({"noun": noun, "kind": kind}).where("kind IS NOT NULL").join(up, "parent_id", "left")
    by = F.when(F.lower("heading").contains(F.col("noun")), "label").when(F.lower("above").contains(F.col("noun")), "parent").otherwise("sibling")
    return both.groupBy("kind", by.alias("explained_by")).agg(F.count(F.lit(1)).alias("clauses"))


def seg_gap_classes(spark, d):
    """Numbers missing between siblings of the main body: cited somewhere in the circular, glued into a text, or flagged."""
    rows = _current(spark, d, "doc_id", "clause_no", "container", "text").where("clause_no IS NOT NULL AND container IS NULL")
    last = F.nullif(F.regexp_extract("clause_no", r"^(?:\d+\.)*(\d+)$", 1), F.lit("")).cast("int")
    stem = F.regexp_extract("clause_no", r"^((?:\d+\.)*)\d+$", 1)
    from rulegrid.operators import ordered

    holes = ordered.gaps(rows.select("doc_id", stem.alias("stem"), last.alias("n")), ["doc_id", "stem"], "n", 3).select("doc_id", F.concat("stem", F.col("missing").cast("string")).alias("number")).distinct()
    said = rows.where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?:clause|para) ([0-9]+(?:\.[0-9]+)*)"), F.lit(1))).alias("number")).distinct().withColumn("cited", F.lit(True))
    glued = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)+)[A-Z]"), F.lit(1))).alias("number")).distinct().withColumn("glued", F.lit(True))
    kind = F.when(F.col("glued"), "re_split").when(F.col("cited"), "cross_reference").otherwise("flagged")
    return holes.join(said, ["doc_id", "number"], "left").join(glued, ["doc_id", "number"], "left").select("doc_id", "number", kind.alias("kind"))


_LINES = r"""
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM d),
l AS (SELECT doc_id, trim(regexp_replace(raw, '[\s\x{00a0}]+', ' ', 'g')) AS line, line_no FROM (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS line_no FROM n)),
lines AS (SELECT * FROM l WHERE line <> '')
"""
_TREE = _LINES + rf""",
k AS (SELECT *, CASE WHEN regexp_matches(line, '{segment.CONTAINER}') AND length(line) <= 90 THEN 'container' WHEN regexp_matches(line, '{segment.NUMBERED}') THEN 'clause' END AS kind FROM lines),
i AS (SELECT *, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS idx, CASE WHEN kind = 'clause' THEN regexp_extract(line, '{segment.NUMBERED}', 2) ELSE line END AS body FROM k),
g AS (SELECT doc_id, CAST(idx AS BIGINT) AS idx, coalesce(min(kind), 'preamble') AS kind, arg_min(line, line_no) AS head, replace(regexp_replace(string_agg(body, chr(10) ORDER BY line_no), '-\n([a-z])', '\1', 'g'), chr(10), ' ') AS text, count(*) AS n_lines FROM i GROUP BY doc_id, idx),
s AS (SELECT *, last_value(CASE WHEN kind = 'container' THEN head END IGNORE NULLS) OVER w AS container, last_value(CASE WHEN kind = 'container' THEN idx END IGNORE NULLS) OVER w AS container_idx,
      CASE WHEN kind = 'clause' THEN regexp_extract(head, '{segment.NUMBERED}', 1) END AS clause_no FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
pre AS (SELECT c.doc_id, c.idx, arg_max(p.idx, (length(p.clause_no), p.idx)) AS by_number FROM s c JOIN s p ON p.doc_id = c.doc_id AND p.kind = 'clause' AND c.kind = 'clause' AND coalesce(p.container_idx, -1) = coalesce(c.container_idx, -1) AND p.idx < c.idx AND starts_with(c.clause_no, p.clause_no || '.') GROUP BY ALL),
p AS (SELECT s.*, coalesce(by_number, CASE WHEN kind <> 'container' THEN container_idx END) AS parent_idx FROM s LEFT JOIN pre USING (doc_id, idx)),
q AS (SELECT c.*, coalesce(c.kind = 'clause' AND length(c.text) < 15 AND regexp_matches(c.text, '{segment.NAME_LIKE}') AND regexp_matches(rtrim(u.text), ':$|(?i:\b(?:following|as under|namely)\b)'), false) AS looks FROM p c LEFT JOIN p u ON u.doc_id = c.doc_id AND u.idx = c.parent_idx),
v AS (SELECT *, looks AND count(*) FILTER (WHERE looks) OVER (PARTITION BY doc_id, parent_idx) >= 2 AS carved, kind = 'clause' AND length(text) <= 160 AND regexp_matches(text, '\s\d{{1,3}}$') AS tocish FROM q),
r AS (SELECT *, sum(CASE WHEN tocish THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM v),
t AS (SELECT *, tocish AND count(*) FILTER (WHERE tocish) OVER (PARTITION BY doc_id, run) >= 5 AS is_toc FROM r)
"""
_BACK = rf"""
WITH {_CURRENT}, b AS (SELECT id, parent_id, text, nullif(regexp_extract(lower(text), '\b(?:such|said|aforesaid) ([a-z]{{3,}})', 1), '') AS noun FROM cur WHERE parent_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT *, CASE WHEN noun IS NOT NULL THEN 'named' WHEN regexp_matches(lower(text), '\b(?:the same|the above|aforesaid|hereinabove)\b') THEN 'opaque' WHEN regexp_matches(text, '^(?:[a-z]|Provided|Further)') THEN 'continuation' END AS kind FROM b)
SELECT k.kind, CASE WHEN contains(lower(u.heading), k.noun) THEN 'label' WHEN contains(lower(u.text), k.noun) THEN 'parent' ELSE 'sibling' END AS explained_by, count(*) AS clauses FROM k LEFT JOIN cur u ON u.id = k.parent_id WHERE k.kind IS NOT NULL GROUP BY ALL
"""
_GAPS = rf"""
WITH {_CURRENT}, m AS (SELECT * FROM cur WHERE clause_no IS NOT NULL AND container IS NULL),
p AS (SELECT DISTINCT doc_id, regexp_extract(clause_no, '^((?:\d+\.)*)\d+$', 1) AS stem, CAST(nullif(regexp_extract(clause_no, '^(?:\d+\.)*(\d+)$', 1), '') AS INTEGER) AS n FROM m),
l AS (SELECT *, lead(n) OVER (PARTITION BY doc_id, stem ORDER BY n) AS nx FROM p WHERE n IS NOT NULL),
h AS (SELECT DISTINCT doc_id, stem || unnest(range(n + 1, nx)) AS number FROM l WHERE nx - n BETWEEN 2 AND 4),
c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '(?:clause|para) ([0-9]+(?:\.[0-9]+)*)', 1)) AS number FROM m),
g AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)+)[A-Z]', 1)) AS number FROM m)
SELECT h.doc_id, h.number, CASE WHEN g.number IS NOT NULL THEN 're_split' WHEN c.number IS NOT NULL THEN 'cross_reference' ELSE 'flagged' END AS kind FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.number = h.number LEFT JOIN g ON g.doc_id = h.doc_id AND g.number = h.number
"""


# Sources -------------------------------------------------------------------------------------------------------------
def src_upload_gate(spark, d):
    """Documents as uploads: the slug of each, and why one is refused."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("circular_no", F.lit("no number")).alias("name"), F.length("text").alias("size")).distinct()
    slug = F.substring(F.regexp_replace("name", r"[^\w.-]+", "-"), 1, 120)
    refused = F.when(F.col("size").isNull() | (F.col("size") == 0), "empty").when(F.col("size") > 4000, "too large")
    return rows.groupBy(slug.alias("slug"), refused.alias("refused")).agg(F.count(F.lit(1)).alias("uploads"))


def src_whole_dedupe(spark, d):
    """Copies of a text: the first document keeps it; copies are skipped where a run of their circular is completed, else flagged."""
    from rulegrid.operators.orphans import doc_key

    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content"), doc_key(F.col("circular_no")).alias("doc")).distinct()
    first = rows.groupBy("content").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    done = table(spark, d, "ingestion_runs").where("lower(trim(status)) = 'completed'").select(doc_key(F.col("doc_id")).alias("doc")).distinct().withColumn("done", F.lit(True))
    found = rows.join(first, "content").where("doc_id <> first_doc").join(done, "doc", "left")
    return found.select("doc_id", "first_doc", F.when(F.col("done"), "skip").otherwise("flag").alias("verdict"))


def src_tree_store(spark, d):
    """Clauses numbered within their circular, and each parent's number by a join on the id."""
    rows = _current(spark, d, "doc_id", "parent_id")
    idx = rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))
    up = idx.select(F.col("id").alias("parent_id"), "doc_id", F.col("idx").alias("parent_idx"))
    return idx.join(up, ["parent_id", "doc_id"], "left").select("id", "doc_id", F.col("idx").cast("long").alias("idx"), F.col("parent_idx").cast("long").alias("parent_idx"))


def src_delete_document(spark, d):
    """Rules that stay when the circular most rules stem from is deleted, by how many circulars they still stem from."""
    rules = table(spark, d, "obligations").select("id", F.transform("source_spans", lambda s: s["doc_id"]).alias("docs")).distinct()
    most = rules.select("id", F.explode(F.array_distinct("docs")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "doc"))["doc"].alias("gone"))
    left = rules.join(F.broadcast(most)).where(~F.coalesce(F.array_contains("docs", F.col("gone")), F.lit(False)))
    return left.groupBy(F.coalesce(F.size(F.array_distinct("docs")), F.lit(-1)).alias("circulars")).agg(F.count(F.lit(1)).alias("rules"))


def src_progress(spark, d):
    """Stages of the runs and how they ended."""
    rows = table(spark, d, "ingestion_runs").select("id", "stages").distinct()
    return rows.select(F.explode(F.from_json("stages", "map<string,string>")).alias("stage", "outcome")).groupBy("stage", "outcome").agg(F.count(F.lit(1)).alias("runs"))


_HASHED = "coalesce(substr(concat_ws(chr(10), CASE WHEN length(header) > 0 THEN '[' || header || ']' END, text), 1, 4500), '') AS win, sha256(concat_ws(chr(10), CASE WHEN length(header) > 0 THEN '[' || header || ']' END, text)) AS content_hash"
QUERIES = {
    "seg_islands": Query(seg_islands, f"WITH {_TREE} SELECT doc_id, idx, kind, clause_no, container, md5(text) AS text, n_lines FROM s"),
    "seg_parents": Query(seg_parents, f"WITH {_TREE} SELECT doc_id, idx, parent_idx FROM p WHERE parent_idx IS NOT NULL"),
    "seg_junk": Query(seg_junk, f"WITH {_TREE} SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE is_toc) AS toc, count(*) FILTER (WHERE is_toc OR kind = 'container' OR (length(text) < 15 AND NOT carved)) AS junk, count(*) FILTER (WHERE carved) AS carved FROM t GROUP BY doc_id"),
    "seg_titles": Query(seg_titles, rf"WITH {_TREE}, x AS (SELECT doc_id, idx, nullif(trim(regexp_extract(text, '(?i)(?:subject|sub)\s*[:.-]\s*(.{{10,200}}?)(?:\s*(?:dear|sir|madam|\.)|$)', 1)), '') AS title FROM s WHERE kind = 'preamble') SELECT doc_id, title FROM x WHERE title IS NOT NULL"),
    "seg_windows": Query(seg_windows, f"WITH {_TREE}, u AS (SELECT c.doc_id, c.idx, c.text, concat_ws(' › ', c.container, CASE WHEN substr(a.text, 1, 80) <> c.container OR c.container IS NULL AND a.text IS NOT NULL THEN CASE WHEN c.container IS NOT NULL THEN substr(a.text, 1, 80) END END) AS header FROM p c LEFT JOIN p a ON a.doc_id = c.doc_id AND a.idx = c.parent_idx WHERE c.kind = 'clause'), w AS (SELECT doc_id, {_HASHED} FROM u) SELECT content_hash, count(*) AS windows, min(doc_id) AS first_doc, CAST(max(length(win)) AS INTEGER) AS length FROM w GROUP BY 1"),
    "seg_unglued": Query(seg_unglued, rf"WITH {_LINES}, g AS (SELECT doc_id, regexp_replace(line, '^(\d+) ([A-Z])', '\1.1\2') AS line FROM lines), f AS (SELECT doc_id, line, regexp_replace(line, '^(\d{{1,2}}(?:\.\d{{1,3}})+)([A-Z][a-z])', '\1 \2') AS again FROM g) SELECT doc_id, count(*) AS repaired, min(again) AS first_line FROM f WHERE again <> line GROUP BY doc_id"),
    "seg_effective": Query(seg_effective, "SELECT doc_id, CAST(CASE WHEN doc_id % 3 <> 0 AND published_at IS NOT NULL THEN CAST(published_at AT TIME ZONE 'UTC' AS DATE) ELSE DATE '2026-01-01' END AS VARCHAR) AS effective_from FROM (SELECT DISTINCT doc_id, title, published_at FROM documents)"),
    "seg_second_script": Query(seg_second_script),
    "seg_back_references": Query(seg_back_references, _BACK),
    "seg_gap_classes": Query(seg_gap_classes, _GAPS),
    "src_upload_gate": Query(src_upload_gate, r"WITH r AS (SELECT DISTINCT doc_id, coalesce(circular_no, 'no number') AS name, length(text) AS size FROM documents) SELECT substr(regexp_replace(name, '[^\w.-]+', '-', 'g'), 1, 120) AS slug, CASE WHEN size IS NULL OR size = 0 THEN 'empty' WHEN size > 4000 THEN 'too large' END AS refused, count(*) AS uploads FROM r GROUP BY ALL"),
    "src_whole_dedupe": Query(src_whole_dedupe, _keyed("WITH r AS (SELECT DISTINCT doc_id, sha256(text) AS content, dockey(circular_no) AS doc FROM documents WHERE text IS NOT NULL), f AS (SELECT content, min(doc_id) AS first_doc FROM r GROUP BY 1 HAVING count(*) > 1), c AS (SELECT DISTINCT dockey(doc_id) AS doc FROM ingestion_runs WHERE lower(trim(status)) = 'completed') SELECT r.doc_id, f.first_doc, CASE WHEN c.doc IS NOT NULL THEN 'skip' ELSE 'flag' END AS verdict FROM r JOIN f USING (content) LEFT JOIN c ON c.doc = r.doc WHERE r.doc_id <> f.first_doc")),
    "src_tree_store": Query(src_tree_store, f"WITH {_CURRENT}, i AS (SELECT id, doc_id, parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS idx FROM cur) SELECT i.id, i.doc_id, i.idx, p.idx AS parent_idx FROM i LEFT JOIN i p ON p.id = i.parent_id AND p.doc_id = i.doc_id"),
    "src_delete_document": Query(src_delete_document, "WITH r AS (SELECT DISTINCT id, source_spans FROM obligations), o AS (SELECT id, list_transform(source_spans, lambda s: s.doc_id) AS docs FROM r), m AS (SELECT arg_max(doc, (n, doc)) AS gone FROM (SELECT doc, count(*) AS n FROM (SELECT id, unnest(list_distinct(docs)) AS doc FROM o) GROUP BY 1)) SELECT coalesce(CAST(len(list_distinct(docs)) AS INTEGER), -1) AS circulars, count(*) AS rules FROM o, m WHERE NOT coalesce(list_contains(docs, gone), false) GROUP BY 1"),
    "src_progress": Query(src_progress, "WITH r AS (SELECT DISTINCT id, stages FROM ingestion_runs), k AS (SELECT unnest(json_keys(stages)) AS stage, stages FROM r) SELECT stage, stages ->> ('$.' || stage) AS outcome, count(*) AS runs FROM k GROUP BY ALL"),
}
