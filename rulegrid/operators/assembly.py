"""Modifiers laid over rules: exemptions, restrictions, extensions and overrides, as a fold of conditions.

An applicability is kept as text in prefix form: and(...), or(...), not(...) over condition strings, and as a flat sorted
list where it is a plain conjunction. A rule has few modifiers, so the fold runs in an aggregate over their ordered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EFFECTS = ("restrict", "exempt", "extend", "override")


def routed(modifiers: DataFrame, rules: DataFrame) -> DataFrame:
    """modifiers with `route`: chained (the target is another modifier's clause), orphaned (no rule there), ambiguous (the
    clause number stands for several clauses with rules; refused) or indexed.

    modifiers: from_clause_no, target, effect, condition, value; rules: id, clause_no, clause_id.
    """
    sources = modifiers.select(F.col("from_clause_no").alias("target")).distinct().withColumn("is_modifier", F.lit(True))
    places = rules.groupBy(F.col("clause_no").alias("target")).agg(F.countDistinct("clause_id").alias("places"))
    route = F.when(F.col("is_modifier") & (F.col("target") != F.col("from_clause_no")), "chained").when(F.col("places").isNull(), "orphaned").when(F.col("places") > 1, "ambiguous").otherwise("indexed")
    return modifiers.join(sources, "target", "left").join(places, "target", "left").withColumn("route", route).drop("is_modifier", "places")


def applied(rules: DataFrame, modifiers: DataFrame) -> DataFrame:
    """(rule_id, applicability, conditions, overrides): each rule's base conditions with its indexed modifiers applied.

    rules: id, clause_no, clause_id, base (array of condition strings). restrict adds a condition, exempt its negation,
    extend an alternative to all so far; overrides are applied last and listed as value@condition. Modifiers of a rule
    go in the order of effect, then their text, so that the result does not depend on the order of rows. `conditions` is
    the sorted flat list where the result is a conjunction of plain conditions, else null.
    """
    indexed = routed(modifiers, rules).where("route = 'indexed'")
    hits = rules.select(F.col("id").alias("rule_id"), F.col("clause_no").alias("target")).join(indexed, "target")
    rank = F.create_map(*[x for i, e in enumerate(EFFECTS) for x in (F.lit(e), F.lit(i))])
    lists = hits.groupBy("rule_id").agg(F.sort_array(F.collect_set(F.struct(F.try_element_at(rank, "effect").alias("rank"), "condition", "effect", "value"))).alias("mods"))
    whole = rules.select(F.col("id").alias("rule_id"), F.array_sort(F.array_distinct("base")).alias("base")).join(lists, "rule_id", "left")
    mods = F.coalesce("mods", F.array().cast("array<struct<rank:int,condition:string,effect:string,value:string>>"))
    of = lambda e: F.transform(F.filter(mods, lambda m: m["effect"] == e), lambda m: m["condition"])
    ands = F.array_sort(F.array_distinct(F.concat(F.col("base"), of("restrict"))))
    nots = F.transform(of("exempt"), lambda c: F.concat(F.lit("not("), c, F.lit(")")))
    alternatives = of("extend")
    core = F.concat(F.lit("and("), F.array_join(F.concat(ands, nots), ", "), F.lit(")"))
    text = F.when(F.size(alternatives) > 0, F.concat(F.lit("or("), core, F.lit(", "), F.array_join(alternatives, ", "), F.lit(")"))).otherwise(core)
    flat = F.when((F.size(alternatives) == 0) & (F.size(nots) == 0), ands)
    overrides = F.transform(F.filter(mods, lambda m: m["effect"] == "override"), lambda m: F.concat_ws("@", m["value"], m["condition"]))
    return whole.select("rule_id", text.alias("applicability"), flat.alias("conditions"), overrides.alias("overrides"))
