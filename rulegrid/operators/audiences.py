"""Audiences: predicates over firms, their register, where they come from and which one holds where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.functions import predicates

#: The categories of firms and the other properties a predicate may use; those that imply a category.
CATEGORIES = (
    "stock_broker", "investment_adviser", "research_analyst", "merchant_banker", "portfolio_manager", "mutual_fund", "amc", "trustee_company", "aif", "depository",
    "depository_participant", "stock_exchange", "clearing_corporation", "custodian", "rta", "kra", "credit_rating_agency", "debenture_trustee", "venture_capital_fund",
    "collective_investment_scheme", "bank", "nbfc",
)
PROPERTIES = (
    "regulator", "category", "is_mii", "is_qsb", "is_clearing_member", "holds_client_funds", "provides_internet_trading", "uses_cloud_services", "outsources_it", "is_listed",
    "active_clients", "aum", "re_category",
)
IMPLIED = {p: "category == 'stock_broker'" for p in ("is_qsb", "is_clearing_member", "provides_internet_trading")}
#: Confidence from which a new audience needs no approval, distance of a near one, and judgement that accepts it.
SURE, NEAR, JUDGED = 0.8, 0.35, 0.7


def parsed(predicate: Column) -> Column:
    """Conditions of a predicate in its normal form, implied terms included."""
    return predicates.conditions(predicates.normalised(predicates.conditions(predicate), IMPLIED))


def relations(register: DataFrame) -> DataFrame:
    """(narrower, broader) of different audiences of the register (audience_id, conditions), all of them, transitively.

    Every condition of the broader must follow from the narrower, so the two share a property unless the broader is
    empty; pairs are formed by the broader's first property only, and an empty one holds everybody.
    """
    rows = register.select("audience_id", "conditions")
    broad = rows.where(F.size("conditions") > 0).select(F.col("audience_id").alias("broader"), F.col("conditions").alias("b"), F.element_at("conditions", 1)["prop"].alias("prop"))
    narrow = rows.select(F.col("audience_id").alias("narrower"), F.col("conditions").alias("a"), F.explode(F.array_distinct(F.transform("conditions", lambda c: c["prop"]))).alias("prop"))
    near = narrow.join(broad, "prop").where(F.col("narrower") != F.col("broader")).where(predicates.compared(F.col("a"), F.col("b")) == "narrower").select("narrower", "broader")
    empty = rows.where(F.size("conditions") == 0).select(F.lit(1).alias("k"), F.col("audience_id").alias("broader"))
    rest = rows.where(F.size("conditions") > 0).select(F.lit(1).alias("k"), F.col("audience_id").alias("narrower"))
    return near.unionByName(rest.join(empty, "k").select("narrower", "broader"))


def overlaps(register: DataFrame) -> DataFrame:
    """(audience_id, other_id), both ways: audiences of which one is narrower than, or the same as, the other."""
    pairs = relations(register)
    text = F.array_join(F.transform("conditions", predicates.text_of), " && ")
    same = register.select("audience_id", text.alias("t"))
    twins = same.join(same.withColumnRenamed("audience_id", "other_id"), "t").where("audience_id <> other_id").select("audience_id", "other_id")
    one = pairs.select(F.col("narrower").alias("audience_id"), F.col("broader").alias("other_id"))
    return one.unionByName(one.select(F.col("other_id").alias("audience_id"), F.col("audience_id").alias("other_id"))).unionByName(twins).distinct()


def guarded(predicate: Column) -> Column:
    """Why a predicate does not count: `empty`, `unreadable` (a part is no condition), `unknown property`; null if it does."""
    conds = predicates.conditions(predicate)
    parts = F.size(F.filter(F.split(predicate, r"\s*(?:&&|\bAND\b)\s*"), lambda p: F.length(F.trim(p)) > 0))
    unknown = F.exists(conds, lambda c: ~c["prop"].isin(*PROPERTIES))
    return F.when(F.length(F.trim(F.coalesce(predicate, F.lit("")))) == 0, "empty").when(F.size(conds) < parts, "unreadable").when(unknown, "unknown property")


def laddered(incoming: DataFrame, register: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(key, rung, audience_id): how each incoming audience resolves, on the first rung that holds.

    incoming: key, predicate; register: audience_id, predicate; near: key, audience_id, distance, judgement - candidates
    by vector with the verdict on them. Rungs: `refused` (guarded), `hash` (the same normal form), `identical` (each
    implies the other), `judged` (a candidate within NEAR that is judged JUDGED or better, the nearest), `created`.
    Distinct predicates are resolved at once, so one created here is not seen by the others.
    """
    rows = incoming.withColumns({"bad": guarded(F.col("predicate")), "normal": predicates.normalised(predicates.conditions(F.col("predicate")), IMPLIED)})
    held = register.withColumn("normal", predicates.normalised(predicates.conditions(F.col("predicate")), IMPLIED))
    by_hash = held.groupBy("normal").agg(F.min("audience_id").alias("by_hash"))
    found = rows.join(by_hash, "normal", "left")
    open_ = found.where("by_hash IS NULL AND bad IS NULL").select("normal").distinct().withColumn("a", predicates.conditions(F.col("normal")))
    first = lambda c: F.element_at(c, 1)["prop"]
    there = held.select("audience_id", predicates.conditions(F.col("normal")).alias("b")).where(F.size("b") > 0).withColumn("prop", first(F.col("b")))
    twins = open_.withColumn("prop", F.explode(F.array_distinct(F.transform("a", lambda c: c["prop"])))).join(there, "prop").where(predicates.compared(F.col("a"), F.col("b")) == "identical").groupBy("normal").agg(F.min("audience_id").alias("by_meaning"))
    found = found.join(twins, "normal", "left")
    if near is not None:
        best = near.where((F.col("distance") <= NEAR) & (F.col("judgement") >= JUDGED)).groupBy("key").agg(F.min(F.struct("distance", "audience_id"))["audience_id"].alias("by_judge"))
        found = found.join(best, "key", "left")
    else:
        found = found.withColumn("by_judge", F.lit(None).cast("int"))
    rung = F.when(F.col("bad").isNotNull(), "refused").when(F.col("by_hash").isNotNull(), "hash").when(F.col("by_meaning").isNotNull(), "identical").when(F.col("by_judge").isNotNull(), "judged").otherwise("created")
    return found.select("key", rung.alias("rung"), F.when(F.col("bad").isNull(), F.coalesce("by_hash", "by_meaning", "by_judge")).alias("audience_id"))


def composed(rows: DataFrame, parent: str, added: str, independent: Column | None = None) -> DataFrame:
    """The rows with `composed` and `refused`: a parent's predicate narrowed by added conditions, or the added ones alone where
    they are independent; refused, with a null predicate, where one property would have to equal two values."""
    both = F.concat_ws(" && ", F.nullif(F.col(parent), F.lit("")), F.nullif(F.col(added), F.lit("")))
    text = F.when(independent, F.col(added)).otherwise(both) if independent is not None else both
    # Each step is a column of its own: within one expression it would be computed for every use.
    whole = rows.withColumn("conds_", predicates.conditions(text)).withColumn("whole_", predicates.normalised(F.col("conds_"), IMPLIED))
    judged = whole.withColumn("conds_", predicates.conditions(F.col("whole_"))).withColumn("refused", predicates.contradictory(F.col("conds_")))
    return judged.withColumn("composed", F.when(~F.col("refused"), F.col("whole_"))).drop("conds_", "whole_")


_MANY = 8
#: How texts name the categories; a plural s may follow.
NAMES = {c: c.replace("_", " ") for c in CATEGORIES if len(c) > 4} | {"amc": "asset management company", "bank": "bank"}


def named_categories(text: Column) -> Column:
    """The categories that a text names, sorted."""
    low = F.lower(text)
    found = F.array(*[F.when(low.rlike(rf"\b{name}s?\b"), F.lit(c)) for c, name in NAMES.items()])
    return F.array_sort(F.filter(found, lambda c: c.isNotNull()))


def document_audience(title: Column, opening: Column) -> Column:
    """The predicate of a whole document: by the title, else by its opening; null where neither names anyone.

    `regulated entities`, or in the opening eight kinds of firms, mean all of the regulator's; one kind gives
    category == 'x', several category in [...].
    """
    everyone, wide = F.lit("regulator == 'sebi'"), r"(?i)\bregulated entit(?:y|ies)\b"
    text = lambda cats: F.when(F.size(cats) == 1, F.concat(F.lit("category == '"), cats[0], F.lit("'"))).when(F.size(cats) > 1, F.concat(F.lit("category in ['"), F.array_join(cats, "', '"), F.lit("']")))
    by_title, by_opening = named_categories(F.coalesce(title, F.lit(""))), named_categories(F.coalesce(opening, F.lit("")))
    return (
        F.when(title.rlike(wide), everyone).when(F.size(by_title) > 0, text(by_title)).when(opening.rlike(wide) | (F.size(by_opening) >= _MANY), everyone).otherwise(text(by_opening))
    )


#: Phrases of a heading that state a property; they outrank a category.
HEADING_PROPERTIES = {
    "qualified stock broker": "is_qsb == true", "qualified broker": "is_qsb == true", "clearing member": "is_clearing_member == true", "client fund": "holds_client_funds == true",
    "internet trading": "provides_internet_trading == true", "internet based trading": "provides_internet_trading == true", "cloud": "uses_cloud_services == true", "outsourc": "outsources_it == true",
}


def heading_audience(heading: Column) -> Column:
    """The conditions that a heading states: a property's, else those of the only category named; null for a topic."""
    low = F.lower(heading)
    out = None
    for phrase, condition in HEADING_PROPERTIES.items():
        out = F.when(low.contains(phrase), condition) if out is None else out.when(low.contains(phrase), condition)
    cats = named_categories(heading)
    return out.otherwise(F.when(F.size(cats) == 1, F.concat(F.lit("category == '"), cats[0], F.lit("'"))))


def tiered(firms: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(firm_id, tier): the tier of each firm by a matrix of thresholds, the highest rank that it reaches.

    firms: firm_id, type, size; thresholds: type, rank, least, tier - a small table, joined by type.
    """
    hits = firms.join(thresholds, "type").where(F.col("size") >= F.col("least"))
    return hits.groupBy("firm_id").agg(F.max(F.struct("rank", "tier"))["tier"].alias("tier"))


def with_labels(register: DataFrame, labels: DataFrame) -> DataFrame:
    """(audience_id, aliases): the labels (audience_id, label) under which each audience was met, each once whatever its case
    and blanks, in their order; an empty list where there were none."""
    tidy = labels.where("label IS NOT NULL").select("audience_id", F.trim(F.regexp_replace("label", r"\s+", " ")).alias("label"))
    one = tidy.groupBy("audience_id", F.lower("label").alias("low")).agg(F.min("label").alias("label"))
    held = one.groupBy("audience_id").agg(F.array_sort(F.collect_list("label")).alias("aliases"))
    return register.select("audience_id").distinct().join(held, "audience_id", "left").select("audience_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def approved(register: DataFrame, asked: DataFrame) -> DataFrame:
    """(audience_id, state, changed): the register (audience_id, state) after approving the asked audience_ids. Only a PROPOSED
    audience is approved; others stay as they are, and ids that are not there change nothing."""
    hit = register.join(asked.select("audience_id").distinct().withColumn("asked", F.lit(True)), "audience_id", "left")
    changed = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("state") == "PROPOSED")
    return hit.select("audience_id", F.when(changed, "APPROVED").otherwise(F.col("state")).alias("state"), changed.alias("changed"))
