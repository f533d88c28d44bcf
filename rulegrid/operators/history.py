"""Problem 5: the full history of changing attributes, as a type-two dimension.

1. All changes of one (identity, date) are folded into one net change by a hash aggregate with map-side
   combine; only the state at the end of a date counts, so this loses nothing. Afterwards an identity holds
   at most one row per calendar date, which bounds every later group however hot the identity is.
2. The dimension merge (`merged`): each state is compared by the hash of its tracked attributes with the current
   version; a differing one closes that version with its date as the end and opens the next. `versions` merges the
   states of a whole log into an empty dimension; later states can be merged into what it gave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
FIELDS = ("limit_value", "limit_unit", "frequency", "owner_desk", "severity")
_NUMBER = r"^[+-]?(\d+|\d[\d,]*\d)?(\.\d*)?([eE][+-]?\d+)?$"


def same_spelling(value: Column) -> Column:
    """One spelling per value: outer blanks and letter case dropped, numbers in one decimal form."""
    text = F.lower(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")))
    number = F.regexp_replace(text, ",", "").try_cast("decimal(38,9)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(_NUMBER) & text.rlike(r"\d") & number.isNotNull(), plain).otherwise(text)


def with_fields(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows with `f`, a struct of the fields, in place of `payload`: for each a struct<value> where the payload names it
    (a null value for an explicit null), else null.

    Keys may be in snake or camel case, on top or one level down (the top wins, then the order of the text). An
    unreadable payload names none. Each step is a column of its own, which the next ones use more than once: within one
    expression the parse would be repeated for every use.
    """
    as_map = "map<string,string>"
    top = rows.withColumn("top_", F.when(F.try_parse_json("payload").isNotNull(), F.from_json("payload", as_map))).drop("payload")
    inner = top.withColumn("in_", F.transform(F.filter(F.map_values("top_"), lambda v: v.startswith("{")), lambda v: F.map_entries(F.from_json(v, as_map))))
    one_name = lambda e: F.struct(F.lower(F.replace(e["key"], F.lit("_"), F.lit(""))).alias("key"), e["value"].alias("value"))
    named = inner.withColumn("e_", F.transform(F.concat(F.map_entries("top_"), F.flatten("in_")), one_name)).drop("top_", "in_")
    hits = named.withColumns({f"h_{n}": F.get(F.filter("e_", _has_key(F.lit(n.replace("_", "")))), F.lit(0)) for n in fields}).drop("e_")
    spelt = [F.when(F.col(f"h_{n}").isNotNull(), F.struct(same_spelling(F.col(f"h_{n}.value")).alias("value"))).alias(n) for n in fields]
    return hits.withColumn("f", F.struct(*spelt)).drop(*[f"h_{n}" for n in fields])


def _has_key(key: Column):
    return lambda entry: entry["key"] == key


def net_changes(log: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per identity and effective date: `base` (the last new or repeal of the date, or null) and, per
    field, what the date leaves it at (struct<value>), null where the date does not touch it."""
    void = log.where("corrects_seq IS NOT NULL").select(F.col("corrects_seq").alias("seq")).distinct()
    live = (
        log.join(void, "seq", "left_anti")
        .withColumns({"identity_hash": F.lower(F.trim("identity_hash")), "verdict": F.lower(F.trim("verdict"))})
        .where(F.col("verdict").isin("new", "amendment", "repeal") & (F.length("identity_hash") > 0) & F.col("effective_from").isNotNull())
        .select("identity_hash", "effective_from", "seq", "verdict", F.when(F.col("verdict") != "repeal", F.col("payload")).alias("payload"))
    )
    # The payload is parsed once per row, into one struct that the aggregates share.
    named = with_fields(live, fields)
    nothing = F.struct(F.lit(None).cast("string").alias("value"))
    is_new, is_set = F.col("verdict") == "new", F.col("verdict") == "amendment"
    day = named.groupBy("identity_hash", "effective_from").agg(
        F.max(F.when(F.col("verdict") != "amendment", F.struct("seq", "verdict"))).alias("base"),
        *[F.max(F.when(is_new, F.struct("seq", F.coalesce(F.col(f"f.{n}"), nothing).alias("set")))).alias(f"new_{n}") for n in fields],
        *[F.max(F.when(is_set & F.col(f"f.{n}").isNotNull(), F.struct("seq", F.col(f"f.{n}").alias("set")))).alias(f"set_{n}") for n in fields],
    )
    left = {
        n: F.when(F.col("base").isNull() | (F.col(f"set_{n}.seq") > F.col("base.seq")), F.col(f"set_{n}.set")).otherwise(None)
        for n in fields
    }
    based = {n: F.when(F.col("base.verdict") == "new", F.coalesce(left[n], F.col(f"new_{n}.set"))).otherwise(left[n]) for n in fields}
    return day.select("identity_hash", "effective_from", F.col("base.verdict").alias("base"), *[c.alias(n) for n, c in based.items()])


def states(log: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(identity_hash, effective_from, held, fields...): the whole state at the end of each date that changes an identity."""
    so_far = Window.partitionBy("identity_hash").orderBy("effective_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net_changes(log, fields).select(
        "identity_hash",
        "effective_from",
        (F.coalesce(F.last("base", ignorenulls=True).over(so_far), F.lit("none")) == "new").alias("held"),
        *[F.last(n, ignorenulls=True).over(so_far)["value"].alias(n) for n in fields],
    )


def merged(dimension: DataFrame | None, snapshots: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The dimension (identity_hash, valid_from, valid_to, fields..., is_current) with the snapshots merged into it.

    snapshots: identity_hash, effective_from, held (false: out of force from that date) and the fields, one row per
    identity and date; a null dimension is an empty one. A snapshot holds from its date until the next version or
    snapshot begins and outranks what the dimension has on that date, so late ones split a version and repeated ones
    change nothing. Snapshots equal to the version in force leave it open. Empty inputs give the other one.
    """
    points = snapshots.select("identity_hash", "effective_from", "held", *fields)
    if dimension is not None:
        starts = dimension.select("identity_hash", F.to_date("valid_from").alias("effective_from"), F.lit(True).alias("held"), *fields)
        ends = dimension.where(F.col("valid_to") != OPEN_END).select("identity_hash", F.to_date("valid_to").alias("effective_from"), F.lit(False).alias("held"), *[F.lit(None).cast("string").alias(n) for n in fields])
        ranked = starts.withColumn("rank", F.lit(1)).unionByName(ends.withColumn("rank", F.lit(0))).unionByName(points.withColumn("rank", F.lit(2)))
        best = ranked.groupBy("identity_hash", "effective_from").agg(F.max(F.struct("rank", "held", *fields)).alias("p"))
        points = best.select("identity_hash", "effective_from", "p.held", *[f"p.{n}" for n in fields])
    by_date = Window.partitionBy("identity_hash").orderBy("effective_from")
    tracked = [F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("-")) for n in fields]
    hashed = points.withColumn("version_hash", F.when(F.col("held"), F.sha2(F.concat_ws("\x1f", *tracked), 256)))
    before = F.lag("version_hash").over(by_date)
    changed = hashed.withColumn("opens", ~F.col("version_hash").eqNullSafe(before)).where("opens")
    closed = changed.withColumn("valid_to", F.lead("effective_from").over(by_date)).where("held")
    return closed.select(
        "identity_hash",
        F.date_format("effective_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(OPEN_END)).alias("valid_to"),
        *fields,
        F.col("valid_to").isNull().alias("is_current"),
    )


def versions(log: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(identity_hash, valid_from, valid_to, fields..., is_current): one row per longest period in force with equal fields.

    log: seq, identity_hash, verdict, effective_from, corrects_seq, payload (JSON text). Rows are void, ordered and
    applied as in rulegrid.operators.changes. `new` sets all fields (an absent one to null), `amendment` those it
    names (an explicit null clears; an unreadable payload sets none) and only while a version is in force, `repeal`
    ends. valid_to is the first date the version no longer holds, 9999-12-31 while it is open. Null or blank
    identity, null date: left out. Repeated deliveries change nothing; of different rows with one seq and date the
    greater value wins. Versions that begin and end on one date never show. An empty log gives an empty history.
    """
    return merged(None, states(log, fields), fields)
