"""Problem 2: one common unit for quantities recorded in different units.

A hidden Markov model per attribute: the hidden state is the unit a limit is stated in, the observations are the
limits in the order they were drafted. The jump of the logarithm of the common value against the level before decides,
with a price for switching; a unit that is stated (beside the number, by a ..._since function, or by the attribute) has a
price for any other state. Viterbi decodes the best run of units. A stated unit is taken at its word: its factor, scales
multiplied (lakh crore), gives the common value, and where the model would rather have another unit the limit is marked
as suspect.

The sequences are range-partitioned and cut into pieces of PIECE rows, so that a much used attribute spans many. Each
piece is reduced to the (max, +) matrices of its best scores from entry to exit state, one per attribute in it; the few
pieces of an attribute are chained by those matrices, which fixes the states at their borders, and each piece is decoded
on its own. That equals one Viterbi pass over the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrid.functions.quantities import STATES, attribute_unit, comparisons, stem_of
from rulegrid.runtime import checkpointed

#: Price of a unit switch and the spread of the level, in powers of ten.
SWITCH, SPREAD = 2.0, 1.0
#: Price of a state other than the stated unit: more than a switch there and back and a jump of six powers of ten.
STATED = 40.0
PIECE = 65_536
_NEVER = -1e12


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (i, at, pos, c.category, c.name, c.function, c.number, c.unit[0] if c.unit else None, c.unit[1] if c.unit else None)
            for i, at, expression in zip(pdf["id"], pdf["created_at"], pdf["rule_expression"])
            for pos, c in enumerate(comparisons(expression))
        ]
        yield pd.DataFrame(rows, columns=["obligation_id", "created_at", "pos", "category", "name", "function", "number", "unit_kind", "unit_factor"])


def stated_limits(obligations: DataFrame) -> DataFrame:
    """One row per number an attribute is compared with, as written."""
    rules = obligations.where("rule_expression IS NOT NULL AND id IS NOT NULL AND lower(coalesce(obligation_type, '')) <> 'attestable'")
    once = rules.select("id", "rule_expression", "created_at").groupBy("id", "rule_expression").agg(F.min("created_at").alias("created_at"))
    return once.mapInPandas(_read, "obligation_id int, created_at timestamp, pos int, category string, name string, function string, number double, unit_kind string, unit_factor double")


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [attribute_unit(u, n, d) for u, n, d in zip(pdf["unit"], pdf["canonical_name"], pdf["description"])]
        yield pdf[["id", "category", "canonical_name", "aliases", "data_type"]].assign(stem=[stem_of(n) for n in pdf["canonical_name"]], kind=[f[0] if f else None for f in found], factor=[f[1] if f else None for f in found])


def dictionary(attributes: DataFrame) -> DataFrame:
    """(category, name, attribute_id, data_type, kind, factor): each name and alias with the attribute's unit.

    A bare scale (thousand, lakh, ...) takes its kind from what attributes of the same name measure elsewhere, and so
    does the kind of an attribute without any unit, whose factor stays null.
    """
    kept = attributes.select("id", "category", "canonical_name", "aliases", "data_type", "unit", "description")
    once = kept.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*[c for c in kept.columns if c != "id"])).alias("a")).select("id", "a.*")
    read = once.mapInPandas(_describe, "id int, category string, canonical_name string, aliases array<string>, data_type string, stem string, kind string, factor double")
    votes = read.where("kind <> 'scale'").groupBy("stem", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("stem").agg(F.max_by("kind", F.struct("n", "kind")).alias("stem_kind"))
    whole = read.join(votes, "stem", "left").withColumn(
        "kind", F.when(F.col("kind") == "scale", F.coalesce("stem_kind", F.when(F.col("factor") == 1e3, F.lit("count")).otherwise(F.lit("money")))).otherwise(F.coalesce("kind", "stem_kind"))
    )
    names = F.array_distinct(F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    long = whole.select(F.lower(F.trim("category")).alias("category"), F.explode(names).alias("name"), F.col("id").alias("attribute_id"), "data_type", "kind", "factor")
    return long.groupBy("category", F.lower(F.trim("name")).alias("name")).agg(F.min_by(F.struct("attribute_id", "data_type", "kind", "factor"), "attribute_id").alias("a")).select("category", "name", "a.*")


def observations(obligations: DataFrame, attributes: DataFrame) -> DataFrame:
    """(attribute_id, obligation_id, created_at, pos, number, kind, factor): `factor` is that of the stated unit, null
    where none is stated anywhere. Rows whose unit is of another kind than the attribute's are dropped."""
    limits = stated_limits(obligations).join(dictionary(attributes), ["category", "name"])
    since = F.col("function").isNotNull()
    units = F.create_map(*[x for name, factor in STATES["time"].items() for x in (F.lit(f"{name}s"), F.lit(float(factor)))])
    at_home = F.when(since, F.lit("time")).otherwise(F.col("kind"))
    own = F.when(since, F.try_element_at(units, F.col("function"))).otherwise(F.col("factor"))
    beside = F.when((F.col("unit_kind") == "scale"), F.when(at_home.isin("money", "count"), at_home).when(at_home.isNull(), F.lit("money")).otherwise(F.lit("scale"))).otherwise(F.col("unit_kind"))
    fits = F.col("unit_kind").isNull() | at_home.isNull() | (beside == at_home)
    return limits.where((since | (F.lower("data_type") == "number")) & fits).select(
        "attribute_id", "obligation_id", "created_at", "pos", "number", F.coalesce(beside, at_home).alias("kind"), F.coalesce("unit_factor", own).alias("factor")
    ).where("kind IS NOT NULL")


def _scores(kind: str, number: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission and logarithm of the common value by row and state, and the state of the stated unit (-1 for none).

    A stated factor that is no state's own (lakh crore) stands for the state nearest to it, at its own level.
    """
    factors = np.log10(np.array(list(STATES[kind].values())))
    given = np.log10(stated)
    free = np.isnan(given)
    home = np.where(free, -1, np.abs(np.where(free, 0, given)[:, None] - factors).argmin(1))
    emit = np.where(free[:, None] | (home[:, None] == np.arange(len(factors))), 0.0, -STATED)
    size = np.log10(np.maximum(np.abs(number), 1e-9))
    level = size[:, None] + factors
    at = np.flatnonzero(~free)
    level[at, home[at]] = size[at] + given[at]
    return emit, level, home


_ORDER = ["attribute_id", "kind", "created_at", "obligation_id", "pos"]


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[int, str, slice]]:
    """The rows of each attribute and kind in a sorted piece."""
    key = pdf["attribute_id"].to_numpy(), pdf["kind"].to_numpy()
    edges = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)]):
        yield int(key[0][low]), key[1][low], slice(low, high)


def _step(level_a: np.ndarray, level_b: np.ndarray) -> np.ndarray:
    """Score of each pair of states at two limits that follow each other."""
    jump = (level_b[None, :] - level_a[:, None]) / SPREAD
    return -0.5 * jump**2 - SWITCH * (1 - np.eye(len(level_a)))


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(_ORDER, ignore_index=True)
    number, stated, out = pdf["number"].to_numpy("f8"), pdf["factor"].to_numpy("f8"), []
    for attribute, kind, at in _runs(pdf):
        emit, level, _ = _scores(kind, number[at], stated[at])
        k = emit.shape[1]
        best = np.where(np.eye(k, dtype=bool), emit[0][:, None], _NEVER)
        for t in range(1, len(emit)):
            best = (best[:, :, None] + _step(level[t - 1], level[t])[None]).max(1) + emit[t][None, :]
        out.append((attribute, kind, pdf["piece"].iloc[0], best.ravel(), level[0], level[-1]))
    return pd.DataFrame(out, columns=["attribute_id", "kind", "piece", "best", "first", "last"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best state at entry and exit of each piece of an attribute."""
    pdf = pdf.sort_values("piece")
    k = len(pdf["first"].iloc[0])
    mats = [np.asarray(b).reshape(k, k) for b in pdf["best"]]
    score, back = np.zeros(k), []
    for i, mat in enumerate(mats):
        if i:
            hop = score[:, None] + _step(np.asarray(pdf["last"].iloc[i - 1]), np.asarray(pdf["first"].iloc[i]))
            came, score = hop.argmax(0), hop.max(0)
        else:
            came = np.zeros(k, int)
        through = score[:, None] + mat
        back.append((came, through.argmax(0)))
        score = through.max(0)
    leave, ends = int(score.argmax()), []
    for came, enter in reversed(back):
        ends.append((int(enter[leave]), leave))
        leave = int(came[enter[leave]])
    ends.reverse()
    return pd.DataFrame({"attribute_id": pdf["attribute_id"], "kind": pdf["kind"], "piece": pdf["piece"], "enter": [e for e, _ in ends], "leave": [x for _, x in ends]})


_DECODED = "attribute_id int, obligation_id int, pos int, number double, kind string, stated boolean, unit string, common_value bigint, suspect boolean"


def _viterbi(emit: np.ndarray, level: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """The best states between a first and a last one that are known."""
    n, k = emit.shape
    score, back = np.full(k, _NEVER * 10), np.zeros((n, k), "i8")
    score[enter] = 0
    for t in range(1, n):
        hop = score[:, None] + _step(level[t - 1], level[t])
        back[t], score = hop.argmax(0), hop.max(0) + emit[t]
    states = np.empty(n, "i8")
    states[-1] = leave
    for t in range(n - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def _decode(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    columns = [c.split()[0] for c in _DECODED.split(", ")]
    if pdf.empty or ends.empty:
        return pd.DataFrame(columns=columns)
    pdf = pdf.sort_values(_ORDER, ignore_index=True)
    known = {(a, k): (e, x) for a, k, e, x in zip(ends["attribute_id"], ends["kind"], ends["enter"], ends["leave"])}
    number, stated = pdf["number"].to_numpy("f8"), pdf["factor"].to_numpy("f8")
    factor, unit, suspect = stated.copy(), np.empty(len(pdf), object), np.zeros(len(pdf), bool)
    for attribute, kind, at in _runs(pdf):
        emit, level, home = _scores(kind, number[at], stated[at])
        states = _viterbi(emit, level, *known[attribute, kind])
        own = home >= 0
        suspect[at] = own & (states != home)
        final = np.where(own, home, states)
        unit[at] = np.array(list(STATES[kind]), object)[final]
        factor[at] = np.where(own, stated[at], np.array(list(STATES[kind].values()))[final])
    common = np.floor(number * factor + 0.5 + 1e-6).astype("i8")
    return pd.DataFrame(dict(zip(columns, (pdf["attribute_id"], pdf["obligation_id"], pdf["pos"], number, pdf["kind"], ~np.isnan(stated), unit, common, suspect))))


def common_units(obligations: DataFrame, attributes: DataFrame) -> DataFrame:
    """(attribute_id, obligation_id, pos, number, kind, stated, unit, common_value, suspect) of every limit of a known kind.

    obligations: id, rule_expression, obligation_type, created_at; attributes: id, category, canonical_name, data_type,
    unit, description, aliases. common_value is in hours, rupees, basis points or plain count, rounded half up.
    `stated` is false where no unit is given anywhere and the decoded one is an inference; `suspect` is true where a
    stated unit holds but the model would rather have another. Null or unreadable expressions give no row, repeated rows
    count once, unknown attribute names are left out, limits without a date sort first, a number of zero has the lowest
    level, and an empty table gives an empty result. `unit` is the nearest one where scales are multiplied.
    """
    return decoded(observations(obligations, attributes))


def decoded(seen: DataFrame) -> DataFrame:
    """common_units of limits as `observations` gives them."""
    sorted_ = seen.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    # Rows of a partition are numbered in their order, partitions one after another.
    pieces = checkpointed(sorted_.withColumn("piece", F.floor(F.monotonically_increasing_id() / PIECE).cast("long")))
    reduced = pieces.groupBy("piece").applyInPandas(_reduce, "attribute_id int, kind string, piece long, best array<double>, first array<double>, last array<double>")
    ends = reduced.groupBy("attribute_id", "kind").applyInPandas(_chain, "attribute_id int, kind string, piece long, enter int, leave int")
    return pieces.groupBy("piece").cogroup(ends.groupBy("piece")).applyInPandas(_decode, _DECODED)
