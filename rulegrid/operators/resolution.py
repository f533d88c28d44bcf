"""Data-dictionary resolution: nearest entries, name tripwires, type and unit gates, clustering, re-pointing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrid.functions.vectors import cosine_distance, jaccard
from rulegrid.runtime import checkpointed

#: Distances of the bands, of clusters and of what is only near one.
REUSE, JUDGE, CLUSTER, BORDERLINE = 0.15, 0.45, 0.15, 0.30
#: What units measure, other spellings of data types, and the data types.
DIMENSIONS = {"time": "hours days months years", "money": "rupees inr crore lakh", "ratio": "percent ratio", "count": "count"}
TYPE_ALIASES = {
    "number": "numeric integer int float decimal currency amount percentage", "date": "datetime timestamp", "boolean": "bool", "string": "text", "document": "file doc attachment",
}
TYPES = ("number", "date", "boolean", "string", "document")
#: Weights of a name's count, recency and clarity; years after which a mention is old; words that are noise.
COUNT_WEIGHT, RECENT_WEIGHT, OLD = 3.0, 1.5, 10.0
NOISE = r"^(?:\d+|january|february|march|april|may|june|july|august|september|october|november|december|q[1-4]|fy\d*|20\d\d)$"


def nearest(queries: DataFrame, register: DataFrame, k: int, within: float | None = None) -> DataFrame:
    """(query_id, id, distance, rank): each query's k nearest register entries of the same data type, by cosine.

    queries: query_id, data_type, vector; register: id, data_type, vector. The gate on the type is the join key. Null or
    empty vectors take no part. Every pair of one data type is compared: a data dictionary holds some thousand entries.
    """
    left = queries.where("size(vector) > 0").select("query_id", "data_type", F.col("vector").alias("qv"))
    right = register.where("size(vector) > 0").select("id", "data_type", F.col("vector").alias("rv"))
    pairs = left.join(right, "data_type").where("query_id <> id").select("query_id", "id", cosine_distance(F.col("qv"), F.col("rv")).alias("distance"))
    if within is not None:
        pairs = pairs.where(F.col("distance") <= within)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def bands(nearest_first: DataFrame) -> DataFrame:
    """(query_id, id, distance, decision): reuse below REUSE, judge up to JUDGE, new beyond."""
    decision = F.when(F.col("distance") < REUSE, "reuse").when(F.col("distance") <= JUDGE, "judge").otherwise("new")
    return nearest_first.where("rank = 1").select("query_id", "id", "distance", decision.alias("decision"))


def names(register: DataFrame) -> DataFrame:
    """(category, name, id): every name and alias in lower case, the smallest id where several share it."""
    every = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return register.select("id", F.lower("category").alias("category"), F.explode(every).alias("n")).groupBy("category", F.lower(F.trim("n")).alias("name")).agg(F.min("id").alias("id"))


def tripwire(mentions: DataFrame, register: DataFrame) -> DataFrame:
    """(category, name, mentions, id): mentions (category, name) that hit a name or alias exactly, id null where none does."""
    counted = mentions.groupBy("category", "name").agg(F.count(F.lit(1)).alias("mentions"))
    return counted.join(names(register), ["category", "name"], "left")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda w: F.length(w) > 2))


def judged(register: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): pairs of entries of one name in different categories whose descriptions' words overlap enough."""
    rows = register.select("id", "canonical_name", "category", word_set(F.col("description")).alias("w"))
    other = rows.select(F.col("id").alias("b"), "canonical_name", F.col("category").alias("bc"), F.col("w").alias("bw"))
    pairs = rows.join(other, "canonical_name").where("id < b AND category <> bc")
    return pairs.select(F.col("id").alias("a"), "b", F.round(jaccard(F.col("w"), F.col("bw")), 6).alias("similarity")).where(F.col("similarity") >= least)


def composite(name: Column, meaning: Column, topic: Column) -> Column:
    """The text that an attribute is embedded by; the audience is no part of it."""
    told = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{label}: "), F.trim(c))) for label, c in (("name", name), ("meaning", meaning), ("topic", topic))]
    return F.concat_ws(" ", *told)


def data_type(raw: Column) -> Column:
    """One of TYPES; string where the word is unknown."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(low.isin(*TYPES), low)
    for kind, words in TYPE_ALIASES.items():
        out = out.when(low.isin(*words.split()), kind)
    return out.otherwise("string")


def dimension(unit: Column) -> Column:
    out = None
    for kind, words in DIMENSIONS.items():
        out = F.when(unit.isin(*words.split()), kind) if out is None else out.when(unit.isin(*words.split()), kind)
    return out


def units_fit(a: Column, b: Column) -> Column:
    """Unstated units fit anything, equal ones fit, and those that measure one thing; unknown ones only themselves."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return (a == "") | (b == "") | (a == b) | F.coalesce(dimension(a) == dimension(b), F.lit(False))


def types_fit(a: Column, b: Column) -> Column:
    """Unstated types fit anything, equal ones fit, and string fits any."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return (a == "") | (b == "") | (a == b) | (a == "string") | (b == "string")


def index_apart(a: Column, b: Column) -> Column:
    """Names that differ in nothing but their numbers at the end: x_1 and x_2 never merge."""
    stem = lambda c: F.regexp_replace(c, r"_?\d+$", "")
    return (a != b) & (stem(a) == stem(b)) & a.rlike(r"\d$") & b.rlike(r"\d$")


def gated(pairs: DataFrame) -> DataFrame:
    """pairs (a_type, b_type, a_unit, b_unit, a_name, b_name, ...) with `rejected`: type, unit, index or null, the first that holds."""
    rejected = F.when(~types_fit(F.col("a_type"), F.col("b_type")), "type").when(~units_fit(F.col("a_unit"), F.col("b_unit")), "unit").when(index_apart(F.col("a_name"), F.col("b_name")), "index")
    return pairs.withColumn("rejected", rejected)


def candidates(queries: DataFrame, register: DataFrame, within: float) -> DataFrame:
    """(query_id, id, distance, rejected): register entries of the query's category within the distance, with the gates' verdict.

    queries: query_id, category, name, data_type, unit, vector; register: id, category, canonical_name, data_type, unit,
    vector. The gates are asked before anything is ranked, so a rejected entry never takes a place."""
    left = queries.where("size(vector) > 0").select("query_id", F.lower("category").alias("category"), F.col("name").alias("a_name"), F.col("data_type").alias("a_type"), F.col("unit").alias("a_unit"), F.col("vector").alias("qv"))
    right = register.where("size(vector) > 0").select("id", F.lower("category").alias("category"), F.col("canonical_name").alias("b_name"), F.col("data_type").alias("b_type"), F.col("unit").alias("b_unit"), F.col("vector").alias("rv"))
    near = left.join(right, "category").where("query_id <> id").withColumn("distance", cosine_distance(F.col("qv"), F.col("rv"))).where(F.col("distance") <= within)
    return gated(near).select("query_id", "id", "distance", "rejected")


def funnel(queries: DataFrame, register: DataFrame) -> DataFrame:
    """(query_id, decision, id): a name or alias of a fitting type goes to the judge (`tripwire`), then the nearest entry
    that passes the gates decides - `reuse` below REUSE, `judge` up to JUDGE - and what has none is `new`.

    queries as in `candidates`. All queries see the register as it was; those that are new are clustered among themselves
    by `clustered`, in place of one seeing the entries that the ones before it created."""
    named = queries.select("query_id", F.lower("category").alias("category"), F.lower(F.trim("name")).alias("name"), F.col("data_type").alias("a_type")).join(names(register), ["category", "name"]).where("id <> query_id")
    typed = register.groupBy("id").agg(F.min("data_type").alias("b_type"))
    wire = named.join(typed, "id").where(types_fit(F.col("a_type"), F.col("b_type"))).groupBy("query_id").agg(F.min("id").alias("wired"))
    near = candidates(queries, register, JUDGE).where("rejected IS NULL").groupBy("query_id").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "id")).alias("n"))
    found = queries.select("query_id").join(wire, "query_id", "left").join(near, "query_id", "left")
    decision = F.when(F.col("wired").isNotNull(), "tripwire").when(F.col("n").isNull(), "new").when(F.col("n.distance") < REUSE, "reuse").otherwise("judge")
    return found.select("query_id", decision.alias("decision"), F.coalesce("wired", "n.id").alias("id"))


def with_alias(register: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, aliases): each entry's aliases with the names it was found by (id, name) appended, once, where they are not its own."""
    heard = mentions.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("heard"))
    rows = register.groupBy("id").agg(F.min(F.struct("canonical_name", "aliases")).alias("r")).join(heard, "id", "left")
    held, none = F.coalesce("r.aliases", F.array().cast("array<string>")), F.array().cast("array<string>")
    fresh = F.filter(F.coalesce("heard", none), lambda n: (n != F.col("r.canonical_name")) & ~F.exists(held, lambda h: F.lower(h) == F.lower(n)))
    return rows.select("id", F.array_distinct(F.concat(held, fresh)).alias("aliases"))


def clarity(name: Column) -> Column:
    """Readability of a name: words count double up to four; short or vowelless words cost 3, dates and numbers 4; long average
    words help. A name without words has 0."""
    words = F.filter(F.split(F.lower(name), r"[_\s]+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    mean = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.length(w)) / n
    short = F.size(F.filter(words, lambda w: (F.length(w) <= 3) | ~w.rlike("[aeiou]")))
    noisy = F.size(F.filter(words, lambda w: w.rlike(NOISE)))
    return F.when(n > 0, F.least(n, F.lit(4)) * 2.0 + F.greatest(n - 4, F.lit(0)) * 0.25 - short * 3.0 - noisy * 4.0 + F.least(mean, F.lit(8.0)) / 4).otherwise(0.0)


def recency(date: Column, as_of: Column) -> Column:
    """1 for a date of today down to 0 after OLD years; 0.5 without a date."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.datediff(as_of, date) / 365.25 / OLD)), F.lit(0.5))


def named_best(mentions: DataFrame, as_of: Column) -> DataFrame:
    """(group, token, score, uses, runner_up): of each group's spellings the best by log2(uses + 1) * 3 + recency * 1.5 +
    clarity, the earliest mention first where they tie, then the token; runner_up is the most used of the others.

    mentions: group, token, date.
    """
    counted = mentions.groupBy("group", "token").agg(F.count(F.lit(1)).alias("n"), F.max(recency(F.col("date"), as_of)).alias("recent"), F.min("date").alias("first"))
    scored = counted.withColumn("score", F.round(F.log2(F.col("n") + 1.0) * COUNT_WEIGHT + F.col("recent") * RECENT_WEIGHT + clarity(F.col("token")), 6))
    # A group's spellings are the names of one entry, so these windows are short.
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("first"), "token"))
    ranked = scored.withColumn("place", place)
    other = ranked.where("place > 1").groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("m"), "token"))["token"].alias("runner_up"))
    return ranked.where("place = 1").join(other, "group", "left").select("group", "token", "score", F.col("n").alias("uses"), "runner_up")


def blast_radius(rules: DataFrame, dropped: DataFrame) -> DataFrame:
    """(id, rules): for each dropped attribute id the number of rules that use it."""
    uses = rules.select(F.col("id").alias("rule_id"), F.explode("attribute_ids").alias("id")).distinct()
    return dropped.select("id").join(uses, "id", "left").groupBy("id").agg(F.count("rule_id").alias("rules"))


def repointed(rules: DataFrame, moves: DataFrame) -> DataFrame:
    """(rule_id, attribute_ids): distinct sorted attribute ids of each rule after moving `old` to `new`.

    moves: old, new. Members are exploded, joined and gathered per rule; a rule has few of them.
    """
    uses = rules.select(F.col("id").alias("rule_id"), F.explode_outer("attribute_ids").alias("old")).distinct()
    moved = uses.join(moves, "old", "left").withColumn("now", F.coalesce("new", "old"))
    return moved.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("now")), ",").alias("attribute_ids"))


def _lead(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", ignore_index=True)
    vectors = np.stack([np.asarray(v, "f8") for v in pdf["vector"]])
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1)), 1e-12)[:, None]
    number = pdf["canonical_name"].str.extract(r"(\d+)$")[0].fillna("").tolist()
    stem = pdf["canonical_name"].str.replace(r"_?\d+$", "", regex=True).tolist()
    kind = pdf["dimension"].tolist()
    seeds: list[int] = []
    leader, distance, near = [], [], []
    for i, v in enumerate(vectors):
        fits = [s for s in seeds if not (stem[s] == stem[i] and number[s] != number[i] and number[s] and number[i]) and (kind[s] is None or kind[i] is None or kind[s] == kind[i])]
        gap = 1 - vectors[fits] @ v if fits else np.array([])
        hit = int(np.flatnonzero(gap <= CLUSTER)[0]) if (gap <= CLUSTER).any() else None
        others = np.delete(gap, hit) if hit is not None else gap
        near.append(bool(((others > CLUSTER) & (others <= BORDERLINE)).any()))
        leader.append(pdf["id"][fits[hit] if hit is not None else i])
        distance.append(float(gap[hit]) if hit is not None else 0.0)
        if hit is None:
            seeds.append(i)
    return pd.DataFrame({"id": pdf["id"], "leader": leader, "distance": np.round(distance, 6), "borderline": near})


def clustered(register: DataFrame) -> DataFrame:
    """(id, leader, distance, borderline): leader clustering in the order of id within each (category, data type).

    An entry joins the first leader within CLUSTER that the gates allow: units of one dimension, and not x_1 with x_2.
    borderline: another leader is within BORDERLINE. The order decides who leads, so a block is folded in sequence; a
    block is what one category of a data dictionary holds of a type.
    """
    rows = register.where("size(vector) > 0").select("id", F.lower("category").alias("category"), data_type(F.col("data_type")).alias("kind"), "canonical_name", dimension(F.lower(F.trim("unit"))).alias("dimension"), "vector")
    return rows.groupBy("category", "kind").applyInPandas(_lead, "id int, leader int, distance double, borderline boolean")


def consolidated(register: DataFrame, rules: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(register, rules) after merging entries: moves (old, new).

    The kept entries (id, aliases) take over the names and aliases of those merged into them; rules (rule_id,
    attribute_ids) point at what was kept, each once."""
    gone = moves.where("old <> new")
    names_ = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    taken = register.select("id", F.explode(names_).alias("name")).where("name IS NOT NULL").join(gone, F.col("id") == F.col("old")).select(F.col("new").alias("id"), "name")
    kept = register.join(gone.select(F.col("old").alias("id")), "id", "left_anti")
    return with_alias(kept, taken), repointed(rules, gone)


def formula_inputs(formulas: DataFrame) -> DataFrame:
    """(attribute_id, leaf_id, depth): the attributes without a formula that each formula rests on in the end.

    formulas: attribute_id, input_ids. Levels are joined until none is left; an input that rests on itself ends there, and
    a formula is followed through no more levels than there are formulas."""
    edges = formulas.select("attribute_id", F.explode("input_ids").alias("input")).distinct()
    formed = edges.select(F.col("attribute_id").alias("input")).distinct().withColumn("formed", F.lit(True))
    steps = edges.join(formed, "input", "left").select("attribute_id", "input", F.coalesce("formed", F.lit(False)).alias("formed"))
    steps = checkpointed(steps)
    front, done, depth = steps.withColumn("depth", F.lit(1)), None, 1
    while True:
        leaves = front.where("NOT formed").select("attribute_id", F.col("input").alias("leaf_id"), "depth")
        done = leaves if done is None else done.unionByName(leaves)
        open_ = front.where("formed AND attribute_id <> input")
        below = steps.select(F.col("attribute_id").alias("input"), F.col("input").alias("next"), F.col("formed").alias("next_formed"))
        depth += 1
        front = checkpointed(open_.join(below, "input").select("attribute_id", F.col("next").alias("input"), F.col("next_formed").alias("formed")).distinct().withColumn("depth", F.lit(depth)))
        if depth > 64 or not front.limit(1).count():
            break
    return done.groupBy("attribute_id", "leaf_id").agg(F.min("depth").alias("depth"))


def linked_names(rules: DataFrame, register: DataFrame, reference: str = r"\[(\w+\.\w+)\]") -> DataFrame:
    """(rule_id, ref, id, data_type): the attributes an expression refers to, id null for an unknown reference."""
    hits = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("rule_expression"), F.lit(reference), F.lit(1))))
    refs = rules.where("rule_expression IS NOT NULL").select(F.col("id").alias("rule_id"), "rule_expression").distinct().select("rule_id", hits.alias("ref"))
    split = refs.withColumns({"category": F.substring_index("ref", ".", 1), "name": F.substring_index("ref", ".", -1)})
    typed = names(register).join(register.groupBy("id").agg(F.min("data_type").alias("data_type")), "id")
    return split.join(typed, ["category", "name"], "left").select("rule_id", "ref", "id", "data_type")


def reference_drift(rules: DataFrame, register: DataFrame) -> DataFrame:
    """(kind, rules): rules whose expression names attributes that attribute_ids lacks (`unlisted`), whose attribute_ids
    hold ones the expression does not name (`unused`), or that name an unknown one (`unknown`)."""
    named = linked_names(rules, register)
    listed = rules.where("rule_expression LIKE '%[%'").select(F.col("id").alias("rule_id"), F.explode("attribute_ids").alias("id")).distinct()
    known = named.where("id IS NOT NULL").select("rule_id", "id").distinct()
    kinds = {"unlisted": known.join(listed, ["rule_id", "id"], "left_anti"), "unused": listed.join(known, ["rule_id", "id"], "left_anti"), "unknown": named.where("id IS NULL")}
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.countDistinct("rule_id").alias("rules")).select(F.lit(kind).alias("kind"), "rules")
        out = one if out is None else out.unionByName(one)
    return out


def consolidation(rules: DataFrame, register: DataFrame) -> DataFrame:
    """(leader, id, uses): the members of each cluster of the register that is to become one, with the rules that use
    them; the leader is the most used, then the smallest id."""
    members = clustered(register).select("id", F.col("leader").alias("cluster"))
    uses = rules.select(F.col("id").alias("rule_id"), F.explode("attribute_ids").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    counted = members.join(uses, "id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    best = counted.groupBy("cluster").agg(F.min(F.struct((-F.col("uses")).alias("u"), "id")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.join(best, "cluster").select(F.col("b.id").alias("leader"), "id", "uses")


def fragmented(register: DataFrame) -> DataFrame:
    """(data_type, stem, entries, first_id): entries whose names differ only by a common prefix or suffix word."""
    stem = F.regexp_replace(F.regexp_replace(F.lower("canonical_name"), r"^(?:is|has|the|total|current|last)_", ""), r"_(?:date|flag|count|amount|value|nos|inr|mn|cr|lakh|pct|bps|days|months|hrs|yrs|thousands)$", "")
    rows = register.select("id", "data_type", "canonical_name", stem.alias("stem")).where("length(stem) > 6").distinct()
    return rows.groupBy("data_type", "stem").agg(F.countDistinct("canonical_name").alias("entries"), F.min("id").alias("first_id")).where("entries > 1")
