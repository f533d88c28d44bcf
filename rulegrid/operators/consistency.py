"""Whether rules agree: constraints of expressions, conflicts, dead and redundant rules, integrity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrid.functions import predicates
from rulegrid.functions.quantities import STATES, required
from rulegrid.operators.units import dictionary

#: States of rules that are checked; a finding is as grave as its grade if all its rules are active.
CHECKED, ACTIVE = ("ACTIVE", "REVIEW"), "ACTIVE"
LOWER = {"high": "medium", "medium": "low", "low": "low"}


def intervals(number: Column, op: Column) -> Column:
    """struct(lo, hi, lo_open, hi_open) of `x op number`; null for != and unknown operators."""
    inf = F.lit(float("inf"))
    pick = lambda lo, hi, a, b: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(a).alias("lo_open"), F.lit(b).alias("hi_open"))
    return (
        F.when(op == ">=", pick(number, inf, False, False)).when(op == ">", pick(number, inf, True, False))
        .when(op == "<=", pick(-inf, number, False, False)).when(op == "<", pick(-inf, number, False, True)).when(op == "==", pick(number, number, False, False))
    )


def tightened(number: Column, op: Column, whole: Column) -> tuple[Column, Column]:
    """(op, number) of the closed bound that says the same of a whole number: > 5 is >= 6; others stay as they are."""
    strict = whole & op.isin(">", "<") & (number == F.floor(number))
    return F.when(strict, F.concat(op, F.lit("="))).otherwise(op), F.when(strict, number + F.when(op == ">", 1.0).otherwise(-1.0)).otherwise(number)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (i, None if pd.isna(audience) else int(audience), state, op, c.category, c.name, c.function, c.number, c.unit[0] if c.unit else None, c.unit[1] if c.unit else None)
            for i, audience, state, text in zip(pdf["id"], pdf["audience_id"], pdf["state"], pdf["rule_expression"])
            for op, c in required(text)
        ]
        yield pd.DataFrame(rows, columns=["rule_id", "audience_id", "state", "op", "category", "name", "function", "number", "unit_kind", "unit_factor"]).astype({"audience_id": "Int64"})


def constraints(rules: DataFrame, attributes: DataFrame) -> DataFrame:
    """(rule_id, audience_id, state, attribute, op, value, lo, hi, lo_open, hi_open) of every comparison of one attribute
    with a number that must hold for the rule to hold: joined by AND, not under OR and not under NOT.

    Numbers may be words, scaled, with a unit or in a BETWEEN, and stand on either side; values are in the common unit.
    `attribute` is the attribute's id (the written name if the register lacks it), `since` for a constraint on the time
    passed, and the kind of quantity. A number without a unit anywhere is compared only with such numbers of its
    attribute. `!=` bounds nothing: its interval is null. Null and unreadable expressions give no row, repeated rows count
    once. Each expression is read once.
    """
    rows = rules.where("rule_expression IS NOT NULL AND id IS NOT NULL").select("id", "audience_id", "state", "rule_expression").distinct()
    read = rows.mapInPandas(_read, "rule_id int, audience_id int, state string, op string, category string, name string, function string, number double, unit_kind string, unit_factor double")
    known = read.join(dictionary(attributes), ["category", "name"], "left")
    since = F.col("function").isNotNull()
    units = F.create_map(*[x for name, factor in STATES["time"].items() for x in (F.lit(f"{name}s"), F.lit(float(factor)))])
    home = F.when(since, F.lit("time")).otherwise(F.col("kind"))
    beside = F.when(F.col("unit_kind") == "scale", F.when(home.isNull(), F.lit("money")).otherwise(home)).otherwise(F.col("unit_kind"))
    own = F.when(since, F.try_element_at(units, F.col("function"))).otherwise(F.col("factor"))
    factor = F.coalesce("unit_factor", own)
    kind = F.when(factor.isNull(), F.lit("no unit")).otherwise(F.coalesce(beside, home))
    who = F.coalesce(F.col("attribute_id").cast("string"), F.concat_ws(".", "category", "name"))
    key = F.concat_ws(" ", who, F.when(since, F.lit("since")), kind)
    value = F.round(F.col("number") * F.coalesce(factor, F.lit(1.0)), 6)
    flat = known.select("rule_id", "audience_id", "state", key.alias("attribute"), "op", value.alias("value")).distinct()
    return flat.withColumn("i", intervals(F.col("value"), F.col("op"))).select("rule_id", "audience_id", "state", "attribute", "op", "value", "i.*")


def _ends(rows: DataFrame, audience: str) -> DataFrame:
    """One row per finite bound. On one scale an upper bound at v is at (v, -1) if open, else (v, 0); a lower one at (v, 1) or (v, 0)."""
    ends = F.array(
        F.struct(F.lit(True).alias("low"), F.col("lo").alias("v"), F.when(F.col("lo_open"), 1).otherwise(0).alias("o")),
        F.struct(F.lit(False).alias("low"), F.col("hi").alias("v"), F.when(F.col("hi_open"), -1).otherwise(0).alias("o")),
    )
    flat = rows.where(F.col(audience).isNotNull() & F.col("lo").isNotNull()).select("rule_id", "state", "op", "value", "attribute", F.col(audience).alias("audience_id"), F.explode(ends).alias("e"))
    return flat.select("*", "e.*").drop("e").where("abs(v) < double('Infinity')")


def conflicts(rows: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """(rule_id, audience_id, attribute, op, value, conflicts, example, severity): for each constraint the number of other
    constraints on the same attribute, of the same audience or one that overlaps with it, that no value can meet along with
    it, and one rule that has such a constraint; only where there are any.

    overlaps: (audience_id, other_id) of different audiences that share members. Two intervals conflict if one ends before
    the other begins, or at the same point with an open end. Bounds are folded into counts per distinct value first and
    one pass in value order counts, for each bound, the opposite bounds beyond it; no pair of rules is ever formed, so a
    much used attribute costs its distinct values. severity: high, or medium unless both rules are active.
    """
    seen = rows
    if overlaps is not None:
        both = overlaps.select(F.col("other_id").alias("audience_id"), F.col("audience_id").alias("seen_by"))
        seen = rows.join(both, "audience_id").drop("audience_id").withColumnRenamed("seen_by", "audience_id").select(rows.columns).unionByName(rows)
    group, point = ["attribute", "audience_id"], ["v", "o"]
    folded = _ends(seen, "audience_id").groupBy(*group, *point).agg(
        F.count_if(~F.col("low")).alias("ends"), F.count_if("low").alias("begins"), F.min(F.when(~F.col("low"), F.struct("rule_id", "state"))).alias("ender"), F.min(F.when(F.col("low"), F.struct("rule_id", "state"))).alias("beginner")
    )
    up = Window.partitionBy(*group).orderBy(*point).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*group).orderBy(*point).rowsBetween(1, Window.unboundedFollowing)
    scan = folded.select(
        *group, *point, F.coalesce(F.sum("ends").over(up), F.lit(0)).alias("below"), F.coalesce(F.sum("begins").over(down), F.lit(0)).alias("above"),
        F.first("ender", ignorenulls=True).over(up).alias("lowest"), F.last("beginner", ignorenulls=True).over(down).alias("highest"),
    )
    found = _ends(rows, "audience_id").join(scan, [*group, *point])
    sides = found.select("rule_id", "state", *group, "op", "value", F.when(F.col("low"), F.col("below")).otherwise(F.col("above")).alias("n"), F.when(F.col("low"), F.col("lowest")).otherwise(F.col("highest")).alias("other")).where("n > 0")
    whole = sides.groupBy("rule_id", *group, "op", "value").agg(F.sum("n").alias("conflicts"), F.min("other").alias("other"), F.min("state").alias("state"))
    grave = (F.col("state") == ACTIVE) & (F.col("other.state") == ACTIVE)
    return whole.select("rule_id", "audience_id", "attribute", "op", "value", "conflicts", F.col("other.rule_id").alias("example"), severity(grave, "high").alias("severity"))


def severity(all_active: Column, grade: str) -> Column:
    """The grade if all rules of a finding are active, else the next lower one."""
    return F.when(all_active, grade).otherwise(LOWER[grade])


def dead_rules(rules: DataFrame, rows: DataFrame, register: DataFrame) -> DataFrame:
    """(rule_id, cause, severity): checked rules that no one can meet or that bind no one: `own_conflict` (its constraints
    on one attribute exclude one another), `audience_conflict` (its audience asks one property to equal two values) and
    `no_audience`. register: (audience_id, conditions)."""
    checked = rules.where(F.col("state").isin(*CHECKED)).select(F.col("id").alias("rule_id"), "audience_id", "state").distinct()
    bound = rows.where("lo IS NOT NULL").groupBy("rule_id", "attribute").agg(F.max(F.struct("lo", "lo_open")).alias("a"), F.min(F.struct("hi", (~F.col("hi_open")).alias("shut"))).alias("b"))
    own = bound.where("a.lo > b.hi OR (a.lo = b.hi AND (a.lo_open OR NOT b.shut))").select("rule_id").distinct()
    bad = register.where(predicates.contradictory(F.col("conditions"))).select("audience_id")
    parts = [
        (checked.join(own, "rule_id", "left_semi"), "own_conflict", "high"), (checked.join(bad, "audience_id", "left_semi"), "audience_conflict", "high"), (checked.where("audience_id IS NULL"), "no_audience", "medium"),
    ]
    out = None
    for found, cause, grade in parts:
        one = found.select("rule_id", F.lit(cause).alias("cause"), severity(F.col("state") == ACTIVE, grade).alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out


def redundant(rules: DataFrame) -> DataFrame:
    """(identity_hash, rules, first_rule): identities that more than one checked rule carries."""
    rows = rules.where(F.col("identity_hash").isNotNull() & F.col("state").isin(*CHECKED)).select("id", F.lower("identity_hash").alias("identity_hash")).distinct()
    return rows.groupBy("identity_hash").agg(F.count(F.lit(1)).alias("rules"), F.min("id").alias("first_rule")).where("rules > 1")


def signatures(rows: DataFrame) -> DataFrame:
    """(rule_id, audience_id, signature): a rule's constraints in one order; they are as many as its expression holds."""
    one = F.concat_ws(" ", "attribute", "op", F.col("value").cast("decimal(30,4)").cast("string"))
    return rows.groupBy("rule_id", "audience_id").agg(F.array_join(F.array_sort(F.collect_set(one)), " && ").alias("signature"))


def subsumed(rows: DataFrame, narrower: DataFrame) -> DataFrame:
    """(signature, narrower, broader, rules, first_rule, broader_rule): rules that state the constraints of another whose
    audience is broader, by audience; narrower: (narrower, broader) pairs of audiences. No pairs of rules are formed."""
    held = signatures(rows).where("audience_id IS NOT NULL").groupBy("signature", "audience_id").agg(F.count(F.lit(1)).alias("rules"), F.min("rule_id").alias("first_rule"))
    wide = held.select("signature", F.col("audience_id").alias("broader"), F.col("first_rule").alias("broader_rule"))
    return held.withColumnRenamed("audience_id", "narrower").join(narrower, "narrower").join(wide, ["signature", "broader"]).select("signature", "narrower", "broader", "rules", "first_rule", "broader_rule")


def integrity(rules: DataFrame, clauses: DataFrame, edges: DataFrame, approved: DataFrame) -> DataFrame:
    """(kind, rules, first_rule): rules without a source span, of a clause that is not there, of an audience that is not in
    `approved`, that an active edge points at although they are superseded, or on a loop of depends_on edges.

    edges: from_id, to_id, type, state, in_cycle."""
    rows = rules.select(F.col("id").alias("rule_id"), "source_clause_id", "audience_id", "state", (F.coalesce(F.size("source_spans"), F.lit(0)) <= 0).alias("bare")).distinct()
    there = clauses.select(F.col("id").alias("source_clause_id")).distinct()
    over = rows.where("state = 'SUPERSEDED'").select("rule_id")
    kinds = {
        "no_source_span": rows.where("bare"),
        "dangling_clause": rows.where("source_clause_id IS NOT NULL").join(there, "source_clause_id", "left_anti"),
        "unapproved_audience": rows.where("audience_id IS NOT NULL").join(approved, "audience_id", "left_anti"),
        "edge_into_superseded": edges.where("state = 'ACTIVE'").select(F.col("to_id").alias("rule_id")).join(over, "rule_id", "left_semi"),
        "depends_on_loop": edges.where("in_cycle").select(F.col("from_id").alias("rule_id")),
    }
    out = None
    for kind, found in kinds.items():
        one = found.agg(F.countDistinct("rule_id").alias("rules"), F.min("rule_id").alias("first_rule")).select(F.lit(kind).alias("kind"), "rules", "first_rule")
        out = one if out is None else out.unionByName(one)
    return out


def rolled_up(findings: DataFrame) -> DataFrame:
    """(cause, severity, rules, some_rules): findings (rule_id, cause, severity) by likely cause, with the ten smallest rule ids."""
    rows = findings.distinct()
    near = rows.withColumn("place", F.row_number().over(Window.partitionBy("cause", "severity").orderBy("rule_id"))).where("place <= 10")
    some = near.groupBy("cause", "severity").agg(F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("some_rules"))
    return rows.groupBy("cause", "severity").agg(F.count(F.lit(1)).alias("rules")).join(some, ["cause", "severity"])


def tightest(rows: DataFrame) -> DataFrame:
    """(rule_id, attribute, constraints, lo, hi): several constraints of a rule on one attribute as the tightest bounds."""
    merged = rows.where("lo IS NOT NULL").groupBy("rule_id", "attribute").agg(F.count(F.lit(1)).alias("constraints"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return merged.where("constraints > 1")
