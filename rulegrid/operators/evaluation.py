"""Rules over facts: statuses, what moved, and the reports that are read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrid.functions.compiler import compile_rule

#: Statuses from worst to best, and the shares at which a rule's or a topic's own status turns.
WORST = ("RED", "AMBER", "GREY", "GREEN")
NO_DATA, GOOD, FAIR = 0.5, 0.9, 0.7


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, WORST)), status)


def status(expression: str, facts: dict[str, Column], as_of: Column, warning: int = 30) -> Column:
    """GREY where a fact is missing, RED where the rule fails, AMBER where it holds today but not `warning` days on, else GREEN."""
    now, later = compile_rule(expression, facts, as_of), compile_rule(expression, facts, F.date_add(as_of, warning))
    return F.when(now.isNull(), "GREY").when(~now, "RED").when(~F.coalesce(later, F.lit(True)), "AMBER").otherwise("GREEN")


def evaluated(firms: DataFrame, rules: dict[str, str], facts: dict[str, Column], as_of: Column, keep: list[str]) -> DataFrame:
    """(keep..., rule, status) of every firm and rule; one pass over the firms, each rule one compiled column."""
    every = F.array(*[F.struct(F.lit(n).alias("rule"), status(e, facts, as_of).alias("status")) for n, e in rules.items()])
    return firms.select(*keep, F.explode(every).alias("e")).select(*keep, "e.*")


def worst(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., status): the worst status wins."""
    return rows.groupBy(*by).agg(F.min(rank(F.col("status"))).alias("r")).select(*by, F.element_at(F.array(*map(F.lit, WORST)), F.col("r").cast("int")).alias("status"))


def shares(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., firms, no_data, met, status): GREY from half without data, else by the share that is GREEN of those with data."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("firms"), F.count_if(F.col("status") == "GREY").alias("no_data"), F.count_if(F.col("status") == "GREEN").alias("met"))
    met = F.try_divide(F.col("met"), F.col("firms") - F.col("no_data"))
    mine = F.when(F.col("no_data") >= F.col("firms") * NO_DATA, "GREY").when(met >= GOOD, "GREEN").when(met >= FAIR, "AMBER").otherwise("RED")
    return counted.withColumn("status", mine)


def transitions(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """(was, now, firms): how many firms each change of status takes from one to the other."""
    both = before.withColumnRenamed("status", "was").join(after.withColumnRenamed("status", "now"), on, "full")
    return both.groupBy("was", "now").agg(F.count(F.lit(1)).alias("firms"))


def valid_at(start: Column, end: Column, as_of: Column) -> Column:
    """Evidence is valid from its start to its end, both included; without an end it stays so."""
    return F.coalesce((start <= as_of) & (end.isNull() | (as_of <= end)), F.lit(False))
