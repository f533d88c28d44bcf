"""Filing assertions: verdicts by replay, the log as believed at a time, and its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrid.operators.changes import in_force


def verdicts(log: DataFrame) -> DataFrame:
    """(seq, identity_hash, replayed): replaying by (effective_from, seq) without citations, the first assertion of an
    identity is `new`; a later one is a `restatement` if it says the same as the first, else an `amendment`.

    The first is found by an aggregate and joined back; no identity is sorted. Rows without identity are left out.
    """
    rows = log.where("identity_hash IS NOT NULL").select("seq", "effective_from", F.lower("identity_hash").alias("identity_hash"), F.lower("full_hash").alias("full_hash")).distinct()
    first = rows.groupBy("identity_hash").agg(F.min(F.struct("effective_from", "seq", "full_hash")).alias("f"))
    replayed = F.when((F.col("seq") == F.col("f.seq")) & F.col("effective_from").eqNullSafe(F.col("f.effective_from")), "new").when(F.col("full_hash").eqNullSafe(F.col("f.full_hash")), "restatement").otherwise("amendment")
    return rows.join(first, "identity_hash").select("seq", "identity_hash", replayed.alias("replayed"))


def classified(log: DataFrame) -> DataFrame:
    """(seq, identity_hash, lane, verdict) of every assertion of an identity.

    A citation decides first: of one rule that it repeals or supersedes, `repeal`; that it amends, `amendment`; of several
    rules, `ambiguous`. Without one the fingerprint decides, as in `verdicts`. Of differing rows of one seq the least counts.
    """
    rows = log.where("identity_hash IS NOT NULL").groupBy("seq").agg(F.min(F.struct("effective_from", F.lower("identity_hash").alias("identity_hash"), F.lower("full_hash").alias("full_hash"), "citations")).alias("r")).select("seq", "r.*")
    ending, changing = ("repeals", "supersedes"), ("repeals", "supersedes", "amends")
    cites = F.filter(F.coalesce("citations", F.array().cast(rows.schema["citations"].dataType)), lambda c: c["kind"].isin(*changing))
    targets = F.size(F.array_distinct(F.transform(cites, lambda c: c["target_identity_hash"])))
    first = rows.groupBy("identity_hash").agg(F.min(F.struct("effective_from", "seq", "full_hash")).alias("f"))
    plain = F.when(F.col("seq") == F.col("f.seq"), "new").when(F.col("full_hash").eqNullSafe(F.col("f.full_hash")), "restatement").otherwise("amendment")
    cited = F.when(targets > 1, "ambiguous").when(F.exists(cites, lambda c: c["kind"].isin(*ending)), "repeal").otherwise("amendment")
    return rows.join(first, "identity_hash").select("seq", "identity_hash", F.when(targets > 0, "citation").otherwise("fingerprint").alias("lane"), F.when(targets > 0, cited).otherwise(plain).alias("verdict"))


def overlapping(log: DataFrame) -> DataFrame:
    """(seq, identity_hash, candidates): assertions classified as new whose audience has other identities on one of their
    attributes - they stay new, but may be another wording of one of those; candidates is the most on any attribute.

    Identities are counted per audience and attribute before anything is joined; no pair of assertions is formed."""
    fresh = classified(log).where("lane = 'fingerprint' AND verdict = 'new'").select("seq", "identity_hash")
    uses = log.where("identity_hash IS NOT NULL AND audience_id IS NOT NULL").select("seq", F.lower("identity_hash").alias("identity_hash"), "audience_id", F.explode("attribute_ids").alias("attribute_id")).distinct()
    held = uses.groupBy("audience_id", "attribute_id").agg(F.countDistinct("identity_hash").alias("n")).where("n > 1")
    hits = uses.join(fresh, ["seq", "identity_hash"]).join(held, ["audience_id", "attribute_id"])
    return hits.groupBy("seq", "identity_hash").agg((F.max("n") - 1).alias("candidates"))


def as_believed(log: DataFrame, at: str) -> DataFrame:
    """What was in force by the rows that had arrived before the time `at`."""
    return in_force(log.where(F.col("created_at") < F.lit(at).cast("timestamp")))


def log_violations(log: DataFrame) -> DataFrame:
    """(check, rows): duplicate deliveries, corrections of unknown rows, corrections of later rows, rows without identity."""
    seqs = log.select("seq").distinct()
    fixes = log.where("corrects_seq IS NOT NULL").select("seq", "corrects_seq").distinct()
    counts = [
        ("repeated_seq", log.groupBy("seq").count().where("count > 1")),
        ("corrects_unknown", fixes.join(seqs.withColumnRenamed("seq", "corrects_seq"), "corrects_seq", "left_anti")),
        ("corrects_later", fixes.where("corrects_seq >= seq")),
        ("no_identity", log.where("identity_hash IS NULL")),
    ]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def chained(rows: DataFrame, order: str, payload: str, previous: str, own: str) -> DataFrame:
    """(order value) of the links of a hash chain that do not fit: previous is not the hash before, or own is not
    sha256(previous | payload). The row before is found by an equi-join on the dense order."""
    before = rows.select((F.col(order) + 1).alias(order), F.col(own).alias("__before"))
    linked = rows.join(before, order, "left")
    fits = F.coalesce(F.col(previous), F.lit("")).eqNullSafe(F.coalesce("__before", F.lit(""))) & (F.col(own) == F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), F.col(payload)), 256))
    return linked.where(~fits).select(order)
