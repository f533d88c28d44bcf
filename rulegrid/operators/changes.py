"""Problem 3: rebuilding the current state of a table from a change feed.

Column-wise last-writer-wins, in SQL only. A change is ordered by (effective_from, seq). The last change
of kind `new` or `repeal` of a key is its base; each column then takes the value of the greatest change
at or after the base that sets it. Every piece is a max() of a struct, so the whole operator is one hash
aggregate with map-side combine: a key with a third of all rows costs one partial row per task, and neither
repeated nor reordered deliveries can change a maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CURRENT = """
WITH void AS (SELECT DISTINCT corrects_seq FROM {log} WHERE corrects_seq IS NOT NULL),
live AS (
  SELECT lower(trim(identity_hash)) AS identity_hash, lower(trim(verdict)) AS verdict,
         struct(effective_from, seq) AS at, {values}
  FROM {log} LEFT ANTI JOIN void ON seq = void.corrects_seq
  WHERE nullif(trim(identity_hash), '') IS NOT NULL
),
folded AS (
  SELECT identity_hash,
         max(struct(at, verdict)) FILTER (WHERE verdict IN ('new', 'repeal')) AS base,
         {maxima}
  FROM live WHERE verdict IN ('new', 'amendment', 'repeal') GROUP BY identity_hash
)
SELECT identity_hash, {winners}, base.at.effective_from AS in_force_from
FROM folded WHERE base.verdict = 'new'
"""


def current_state(log: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in force at the end of the feed, one per identity_hash, with `columns` as last set.

    log: seq, identity_hash, verdict, effective_from, corrects_seq and `columns`.
    A row whose seq stands in any row's corrects_seq is void, whatever that row's own fate; a correcting row
    stands by itself, and a correction of an unknown seq voids nothing. `new` sets every column (a null too),
    `amendment` sets the columns it holds a value for and does nothing where no version is in force, `repeal`
    ends the version; other verdicts change nothing. Null or blank identity: left out. Null effective_from or
    seq: sorts before all others. Hash text is compared in lower case. An empty feed gives an empty result;
    columns beyond those named are ignored. Two different rows of one (effective_from, seq): the one with the
    greater value wins, so the result does not depend on the order of delivery.
    """
    values = ", ".join(f"`{c}`" for c in columns)
    maxima = ",\n         ".join(
        f"max(struct(at, `{c}` AS value)) FILTER (WHERE verdict = 'new') AS new_{i},\n"
        f"         max(struct(at, `{c}` AS value)) FILTER (WHERE verdict = 'amendment' AND `{c}` IS NOT NULL) AS set_{i}"
        for i, c in enumerate(columns)
    )
    winners = ", ".join(
        f"CASE WHEN set_{i}.at > base.at THEN set_{i}.value ELSE new_{i}.value END AS `{c}`" for i, c in enumerate(columns)
    )
    sql = _CURRENT.replace("{values}", values).replace("{maxima}", maxima).replace("{winners}", winners)
    return log.sparkSession.sql(sql, log=log)


def in_force(log: DataFrame) -> DataFrame:
    """(identity_hash, full_hash) of every identity in force at the end, both in lower case; none without a full_hash."""
    held = log.select("seq", "identity_hash", "verdict", "effective_from", "corrects_seq", F.lower(F.trim("full_hash")).alias("full_hash"))
    return current_state(held, ["full_hash"]).select("identity_hash", "full_hash").where("full_hash IS NOT NULL")
