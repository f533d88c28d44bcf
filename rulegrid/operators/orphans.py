"""Problem 4: references to records that do not exist, are gone, or arrive later.

Parent keys (clauses, circulars, completed runs) and child keys (citations) are tagged and put in one long
table (target, key). One hash aggregate per (target, key) gives the parent flag, its first arrival and whether
any child asks for it; groups that lack the parent flag are the orphans. A hot key is one row after the map-side
combine. Children find their group by a join; the groups that more than a HOT-th of all children ask for, fewer than HOT
by their definition, go to the children instead, so a key with a third of all citations moves none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.runtime import checkpointed

#: Groups asked for by more than one in so many children are sent to all tasks; there can be no more of them than this.
HOT = 1000

#: Words that only label a number.
DOC_LABELS = "CIRCULAR|CIRCULARS|CIR|CIRC|NO|NOS|NUMBER|NUM|REF|REFERENCE|DOC|DOCUMENT"
CLAUSE_LABELS = "CLAUSE|CLAUSES|CL|CLS|PARA|PARAS|PARAGRAPH|SR|SL|NO|NOS|NUMBER|NUM|SERIAL|SECTION|SEC|ITEM|POINT|SUB"
CONTAINER_LABELS = "ANNEXURE|ANNEX|ANX"


def _tokens(text: Column, labels: str) -> Column:
    """Upper case letter and digit runs with one blank between, label words in front and leading zeros gone; null for none."""
    runs = F.trim(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(runs, rf"^(?:(?:{labels})(?: |(?=\d)))+", "")
    short = F.regexp_replace(bare, r"(?<![\p{L}\p{N}])0+(?=\d)", "")
    return F.when(F.length(short) > 0, short)


def doc_key(text: Column) -> Column:
    """'Circular No. hsb-dep-2015-000039;' and 'HSB/DEP/2015/39' give one key."""
    return _tokens(text, DOC_LABELS)


def clause_key(text: Column) -> Column:
    """'Sr. No. 1.2', '(1. 2)', 'cl.01.2,' and '§ 1.2' give one key."""
    return _tokens(text, CLAUSE_LABELS)


def container_key(text: Column) -> Column:
    """'ANNEXURE  A' and 'Annexure-A' give 'A'; the main body (null or blank) gives ''."""
    return F.coalesce(_tokens(text, CONTAINER_LABELS), F.lit(""))


def dangling(citations: DataFrame, clauses: DataFrame, runs: DataFrame) -> DataFrame:
    """(citation_id, kind, state, target, created_at) of every citation whose target is late or missing.

    kind: `late` - the target's first created_at is after the citation's; `no_clause` - the circular has clauses but
    no citable one of this number in this container; `deleted` - no clauses, but a completed run; `never` - neither.
    target: `clause` if the citation has a clause number, else `circular`. Keys match as in doc_key, clause_key and
    container_key. A null or blank target_doc means the circular of from_clause_id; citations with neither circular
    nor clause number are left out, and one whose own circular is unknown counts as `never`. Repeated citations count
    once per id (of differing rows of one id, the first by created_at counts). A null created_at of the citation
    cannot be before anything: such a citation is never `late`. Empty tables give empty results or all `never`.
    """
    current = citations.groupBy("id").agg(
        F.min_by(F.struct("from_clause_id", "target_doc", "target_container", "target_clause_no", "state", "created_at"), F.struct("created_at", "state", "target_doc", "target_clause_no", "target_container", "from_clause_id")).alias("c")
    )
    cite = current.select("id", "c.*").withColumns({"doc": doc_key(F.col("target_doc")), "no": clause_key(F.col("target_clause_no"))})
    cite = cite.where("doc IS NOT NULL OR no IS NOT NULL")
    homes = clauses.where("id IS NOT NULL").groupBy("id").agg(F.max_by("doc_id", "created_at").alias("doc_id")).select(F.col("id").alias("from_clause_id"), doc_key(F.col("doc_id")).alias("home"))
    # Only citations without a circular need their own; the others stay out of this join.
    named = cite.where("doc IS NOT NULL")
    own = cite.where("doc IS NULL").join(homes, "from_clause_id", "left").withColumn("doc", F.col("home")).select(named.columns)
    cite = named.unionByName(own).select("id", "state", "created_at", F.coalesce("doc", F.lit("")).alias("doc"), container_key(F.col("target_container")).alias("box"), "no")

    at = lambda *parts: F.concat_ws("\x1f", *parts)
    rows = clauses.select(doc_key(F.col("doc_id")).alias("doc"), container_key(F.col("container")).alias("box"), clause_key(F.col("clause_no")).alias("no"), "citable", "created_at").where("doc IS NOT NULL")
    parents = (
        rows.select(F.lit("circular").alias("target"), F.col("doc").alias("key"), "created_at")
        .unionByName(rows.where("citable AND no IS NOT NULL").select(F.lit("clause").alias("target"), at("doc", "box", "no").alias("key"), "created_at"))
        .unionByName(runs.where("lower(trim(status)) = 'completed'").select(F.lit("run").alias("target"), doc_key(F.col("doc_id")).alias("key"), F.lit(None).cast("timestamp").alias("created_at")))
        .where("key IS NOT NULL")
    )
    asked = cite.select("id", F.explode(F.filter(F.array(
        F.struct(F.lit("circular").alias("target"), F.col("doc").alias("key")),
        F.struct(F.lit("run").alias("target"), F.col("doc").alias("key")),
        F.struct(F.lit("clause").alias("target"), F.when(F.col("no").isNotNull(), at("doc", "box", "no")).alias("key")),
    ), lambda x: x["key"].isNotNull())).alias("a")).select("id", "a.*")
    long = parents.withColumns({"parent": F.lit(True), "child": F.lit(False)}).unionByName(
        asked.select("target", "key", F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("parent"), F.lit(True).alias("child"))
    )
    groups = long.groupBy("target", "key").agg(F.bool_or("parent").alias("known"), F.min(F.when(F.col("parent"), F.col("created_at"))).alias("first_at"), F.count_if("child").alias("asked")).where("asked > 0")
    groups = checkpointed(groups)
    line = (groups.agg(F.sum("asked")).first()[0] or 0) // HOT
    hot = groups.where(F.col("asked") > line).drop("asked") if line else groups.drop("asked").limit(0)
    marked = asked.join(F.broadcast(hot.withColumnsRenamed({"known": "hot_known", "first_at": "hot_first_at"}).withColumn("hot", F.lit(True))), ["target", "key"], "left")
    near = marked.where("hot").select("id", "target", "key", F.col("hot_known").alias("known"), F.col("hot_first_at").alias("first_at"))
    cool = groups.where(F.col("asked") <= line).drop("asked") if line else groups.drop("asked")
    found = near.unionByName(marked.where("hot IS NULL").select("id", "target", "key").join(cool, ["target", "key"]))
    facts = found.groupBy("id").agg(
        *[F.bool_or(F.when(F.col("target") == t, F.col("known"))).alias(f"has_{t}") for t in ("circular", "clause", "run")],
        *[F.min(F.when(F.col("target") == t, F.col("first_at"))).alias(f"first_{t}") for t in ("circular", "clause")],
    )
    judged = cite.join(facts, "id").withColumns({
        "target": F.when(F.col("no").isNotNull(), F.lit("clause")).otherwise(F.lit("circular")),
        "has": F.when(F.col("no").isNotNull(), F.col("has_clause")).otherwise(F.col("has_circular")),
        "first_at": F.when(F.col("no").isNotNull(), F.col("first_clause")).otherwise(F.col("first_circular")),
    })
    kind = (
        F.when(F.col("has"), F.when(F.col("first_at") > F.col("created_at"), F.lit("late")))
        .when(F.col("has_circular"), F.lit("no_clause"))
        .when(F.col("has_run"), F.lit("deleted"))
        .otherwise(F.lit("never"))
    )
    return judged.withColumn("kind", kind).where("kind IS NOT NULL").select(F.col("id").alias("citation_id"), "kind", "state", "target", "created_at")


def dangling_report(citations: DataFrame, clauses: DataFrame, runs: DataFrame) -> DataFrame:
    """Dangling citations counted by target table, month of the citation (yyyy-mm, null if undated), kind and state."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return dangling(citations, clauses, runs).groupBy("target", month, "kind", "state").agg(F.count(F.lit(1)).alias("citations"))
