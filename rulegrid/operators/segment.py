"""Lines of a document to a tree of numbered clauses, by gaps and islands.

A line that begins with a number, or that heads a container (chapter, annexure, ...), opens a new island; the lines
after it belong to it. All windows run within one document, whose length bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What numbers and headings of parts look like, and the limits of stubs, tables of contents and windows.
NUMBERED = r"^(\d{1,2}(?:\.\d{1,3})*)[.)]?\s+(\S.*)$"
CONTAINER = r"(?i)^(chapter|part|annexure|appendix|schedule|form)\b[\s.:-]*([A-Z0-9]*)"
TOC_LINE = r"\s\d{1,3}$"
STUB, TOC_RUN, TOC_CHARS, WINDOW_CHARS, LABEL_CHARS = 15, 5, 160, 4500, 80
LEAD_IN, NAME_LIKE = r":$|(?i)\b(?:following|as under|namely)\b", r"^[A-Z][A-Za-z &/-]*[.;,]?$"
HEADING_SIZE, HEADING_CHARS = 0.8, 90
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SECOND_SCRIPT = r"[ऀ-ॿ‌‍]+"


def without_second_script(line: Column) -> Column:
    """Devanagari runs removed and what they leave tidied; null where fewer than three letters remain; other lines as they stand."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, _SECOND_SCRIPT, " "), r"\(\s*\)|[|/।]+\s*(?=[|/।]|$)", " "), r"\s+", " ")
    tidy = F.trim(F.regexp_replace(bare, r"^[\s|/।,;:-]+", ""))
    return F.when(~line.rlike(_SECOND_SCRIPT), line).when(F.length(F.regexp_replace(tidy, r"[^A-Za-z]", "")) >= 3, tidy)


def islands(lines: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, clause_no, container, container_idx, head, text, n_lines) from (doc_id, line_no, line).

    kind: container, clause or preamble. `container` is the heading in force. Lines of a clause are joined by a blank;
    a hyphen before a small letter at a line's end glues. Blank and null lines are skipped; a document without numbers
    is one preamble.
    """
    rows = lines.where("trim(line) <> ''").withColumn("line", F.trim("line"))
    kind = F.when(F.col("line").rlike(CONTAINER) & (F.length("line") <= 90), "container").when(F.col("line").rlike(NUMBERED), "clause")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    tagged = rows.withColumn("kind", kind).withColumn("idx", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(order))
    body = F.when(F.col("kind") == "clause", F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line"))
    grouped = tagged.withColumn("body", body).groupBy("doc_id", "idx").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "kind", "line", "body"))).alias("l"), F.count(F.lit(1)).alias("n_lines")
    )
    first = F.element_at("l", 1)
    text = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["body"]), "\n"), r"-\n(?=[a-z])", "")
    cut = grouped.select("doc_id", "idx", F.coalesce(first["kind"], F.lit("preamble")).alias("kind"), first["line"].alias("head"), F.regexp_replace(text, "\n", " ").alias("text"), "n_lines")
    running = Window.partitionBy("doc_id").orderBy("idx")
    held = F.last(F.when(F.col("kind") == "container", F.col("head")), ignorenulls=True).over(running)
    held_idx = F.last(F.when(F.col("kind") == "container", F.col("idx")), ignorenulls=True).over(running)
    return cut.withColumns({"container": held, "container_idx": held_idx}).withColumn("clause_no", F.when(F.col("kind") == "clause", F.regexp_extract("head", NUMBERED, 1))).select("doc_id", "idx", "kind", "clause_no", "container", "container_idx", "head", "text", "n_lines")


def parented(clauses: DataFrame) -> DataFrame:
    """Adds parent_idx: the latest clause before with the longest proper prefix of the number under the same heading of a
    part, else that heading's own row, else null. A heading that is repeated heads a part of its own. Prefixes are
    exploded and matched by equality."""
    parts = F.split("clause_no", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    box = F.coalesce("container_idx", F.lit(-1)).alias("box")
    wanted = clauses.where("kind = 'clause' AND instr(clause_no, '.') > 0").select("doc_id", box, "idx", F.explode(steps).alias("prefix"))
    there = clauses.where("kind = 'clause'").select("doc_id", box, F.col("idx").alias("parent_idx"), F.col("clause_no").alias("prefix"))
    best = wanted.join(there, ["doc_id", "box", "prefix"]).where("parent_idx < idx").groupBy("doc_id", "idx").agg(F.max(F.struct(F.length("prefix").alias("n"), "parent_idx")).alias("b")).select("doc_id", "idx", F.col("b.parent_idx").alias("by_number"))
    whole = clauses.join(best, ["doc_id", "idx"], "left")
    return whole.withColumn("parent_idx", F.coalesce("by_number", F.when(F.col("kind") != "container", F.col("container_idx")))).drop("by_number")


def carved(clauses: DataFrame) -> DataFrame:
    """Adds is_carved: a short, name-like clause under a clause that leads in a list, with another such beside it."""
    leads = clauses.select("doc_id", F.col("idx").alias("parent_idx"), F.rtrim("text").rlike(LEAD_IN).alias("__leads"))
    rows = clauses.join(leads, ["doc_id", "parent_idx"], "left")
    looks = F.coalesce((F.col("kind") == "clause") & (F.length("text") < STUB) & F.col("text").rlike(NAME_LIKE) & F.col("__leads"), F.lit(False))
    beside = F.count_if(looks).over(Window.partitionBy("doc_id", "parent_idx"))
    return rows.withColumn("is_carved", looks & (beside >= 2)).drop("__leads").select(*clauses.columns, "is_carved")


def headings(lines: DataFrame) -> DataFrame:
    """Adds is_heading to (doc_id, line, size, bold): bold, or at least HEADING_SIZE above the document's median size, and no
    longer than HEADING_CHARS."""
    median = lines.groupBy("doc_id").agg(F.percentile("size", F.lit(0.5)).alias("__median"))
    rows = lines.join(median, "doc_id", "left")
    tall = F.coalesce(F.col("bold"), F.lit(False)) | F.coalesce(F.col("size") >= F.col("__median") + HEADING_SIZE, F.lit(False))
    return rows.withColumn("is_heading", tall & (F.length("line") <= HEADING_CHARS)).drop("__median")


def unglued(line: Column) -> Column:
    """A blank between a number and the word that is stuck to it: 18.6The."""
    return F.regexp_replace(line, r"^(\d{1,2}(?:\.\d{1,3})+)([A-Z][a-z])", "$1 $2")


def effective_date(title: Column, as_of: Column) -> Column:
    """The first `Month d, yyyy` of a title; as_of where there is none."""
    found = F.regexp_extract(title, rf"({MONTHS}) (\d{{1,2}}), (\d{{4}})", 0)
    return F.coalesce(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("MMMM d, yyyy")).cast("date"), as_of)


def marked(clauses: DataFrame) -> DataFrame:
    """Adds is_toc (at least TOC_RUN clauses in a row that are short and end in a page number) and is_junk: what is of a
    table of contents, a heading of a part, or a stub that is not carved out as a list's member."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    looks = (F.col("kind") == "clause") & (F.length("text") <= TOC_CHARS) & F.col("text").rlike(TOC_LINE)
    runs = clauses.withColumn("__looks", looks).withColumn("__run", F.sum(F.when(F.col("__looks"), 0).otherwise(1)).over(order))
    size = F.count_if(F.col("__looks")).over(Window.partitionBy("doc_id", "__run"))
    toc = F.col("__looks") & (size >= TOC_RUN)
    kept = F.col("is_carved") if "is_carved" in clauses.columns else F.lit(False)
    return runs.withColumn("is_toc", toc).withColumn("is_junk", F.col("is_toc") | (F.col("kind") == "container") | (F.length("text") < STUB) & ~kept).drop("__looks", "__run")


def title(clauses: DataFrame) -> DataFrame:
    """(doc_id, title) from the preamble's subject line, 10 to 200 characters; null where there is none."""
    found = F.regexp_extract("text", r"(?i)(?:subject|sub)\s*[:.-]\s*(.{10,200}?)(?:\s*(?:dear|sir|madam|\.)|$)", 1)
    return clauses.where("kind = 'preamble'").groupBy("doc_id").agg(F.min_by(F.nullif(F.trim(found), F.lit("")), "idx").alias("title"))


def windows(clauses: DataFrame) -> DataFrame:
    """(doc_id, idx, window, content_hash): the clause's text under its container and parent label, cut at WINDOW_CHARS.

    The hash is of the whole window, so equal windows are drafted once.
    """
    parents = clauses.select("doc_id", F.col("idx").alias("parent_idx"), F.substring("text", 1, LABEL_CHARS).alias("label"))
    rows = clauses.where("kind = 'clause'").join(parents, ["doc_id", "parent_idx"], "left")
    header = F.concat_ws(" › ", F.col("container"), F.when(F.col("label") != F.col("container"), F.col("label")))
    full = F.concat_ws("\n", F.when(F.length(header) > 0, F.concat(F.lit("["), header, F.lit("]"))), "text")
    return rows.select("doc_id", "idx", F.substring(full, 1, WINDOW_CHARS).alias("window"), F.sha2(full, 256).alias("content_hash"))
