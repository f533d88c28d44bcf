"""Problem 2: reading quantities, and Viterbi over pieces against one pass."""

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest

from rulegrid.functions.quantities import STATES, attribute_unit, comparisons, read_quantity, read_unit
from rulegrid.operators import units


@pytest.mark.parametrize(
    "text, number, unit",
    [
        ("5,000 nos.", 5000, ("count", 1)), ("Rs. 25 crore", 25, ("money", 1e7)), ("₹9 mn", 9, ("money", 1e6)), ("INR 12,00,00,000", 120000000, ("money", 1)),
        ("five million rupees", 5, ("money", 1e6)), ("seventy-five per cent", 75, ("ratio", 100)), ("10%", 10, ("ratio", 100)), ("60.00d", 60, ("time", 24)),
        ("twelve weeks", 12, ("time", 168)), ("30 calendar days", 30, ("time", 24)), ("125e1", 1250, None), ("0.25 lakh", 0.25, ("scale", 1e5)), ("50 basis points", 50, ("ratio", 1)),
    ],
)
def test_quantities(text, number, unit):
    assert read_quantity(text) == (number, unit)


@pytest.mark.parametrize("text", ["type 2", "Form 4B", "within 30 days", "cloud", "", "n/a", "true"])
def test_no_quantities(text):
    assert read_quantity(text) is None


def test_attribute_units():
    assert read_unit(" Rs. in lakh ") == ("money", 1e5) and read_unit("n/a") is None and read_unit("in '000") == ("scale", 1e3)
    assert attribute_unit("-", "unpaid_dues_mn", "x") == ("scale", 1e6)
    assert attribute_unit(None, "branch_count", "Branch count for the register.") is None
    assert attribute_unit("", "haircut", "Haircut, as a fraction of one.") == ("ratio", 10_000)


def test_comparisons():
    got = comparisons("([A.x] BETWEEN 5 AND 1,000 nos. AND weeks_since([B.d])!=4) and 'cloud' == [A.m] && 50% > [A.y] AND [A.x] >= 1.5 * [A.x] AND [A.z] ≤ '7.5 crore'")
    assert [(c.category, c.name, c.function, c.number) for c in got] == [("a", "x", None, 5), ("a", "x", None, 1000), ("b", "d", "weeks", 4), ("a", "y", None, 50), ("a", "z", None, 7.5)]
    assert comparisons('attest: "the firm shall keep [A.x] >= 5 for 30 days"') == [] and comparisons(None) == [] and comparisons("(((") == []


def brute(numbers, factors, stated):
    best = None
    for states in itertools.product(range(len(factors)), repeat=len(numbers)):
        if any(s is not None and not np.isclose(factors[x], s) for x, s in zip(states, stated)):
            continue
        level = [np.log10(n) + np.log10(factors[x]) for n, x in zip(numbers, states)]
        score = sum(-0.5 * (b - a) ** 2 - units.SWITCH * (x != y) for a, b, x, y in zip(level, level[1:], states, states[1:]))
        if best is None or score > best[0] + 1e-9:
            best = (score, states)
    return best[0]


def test_pieces_decode_like_one_pass(monkeypatch):
    monkeypatch.setattr(units, "STATED", 1e9)
    rng, factors = random.Random(4), np.array(list(STATES["ratio"].values()))
    numbers, stated = [10 ** rng.uniform(-2, 3) for _ in range(9)], [rng.choice([None, None, 1, 100]) for _ in range(9)]
    pdf = pd.DataFrame({"attribute_id": 1, "kind": "ratio", "created_at": pd.Timestamp("2020-01-01"), "obligation_id": range(9), "pos": 0, "number": numbers, "factor": pd.Series(stated, dtype="f8"), "piece": [0, 0, 1, 1, 1, 1, 2, 3, 3]})
    parts = [p for _, p in pdf.groupby("piece")]
    ends = units._chain(pd.concat([units._reduce(p) for p in parts]))
    out = pd.concat([units._decode(p, e) for p, (_, e) in zip(parts, ends.groupby("piece"))])
    states = [list(STATES["ratio"]).index(u) for u in out["unit"]]
    level = np.log10(numbers) + np.log10(factors[states])
    score = sum(-0.5 * (b - a) ** 2 - units.SWITCH * (x != y) for a, b, x, y in zip(level, level[1:], states, states[1:]))
    assert abs(score - brute(numbers, factors, stated)) < 1e-6


def test_limits_come_out_in_common_units(spark):
    when = dt.datetime(2020, 1, 1)
    rules = [(1, "[A.dues] >= 5 AND [A.dues] <= Rs. 2 crore", "computable", when), (2, "[A.gap] < 36 days", "computable", when), (3, "[A.bare] == 4", "computable", None), (4, None, "computable", when), (5, "days_since([A.d]) > 2 weeks AND [A.dues] > 3 days", "computable", when)]
    attributes = [(10, "A", "dues", "number", "lakh", "", ["du"]), (11, "A", "gap", "number", "months", "", None), (12, "A", "bare", "number", None, "", None), (13, "A", "d", "date", None, "", None)]
    a = spark.createDataFrame(attributes, "id int, category string, canonical_name string, data_type string, unit string, description string, aliases array<string>").selectExpr("*", "'x' AS stem", "'x' AS kind")
    r = spark.createDataFrame(rules + rules[:1], "id int, rule_expression string, obligation_type string, created_at timestamp").selectExpr("*", "1 AS number")
    got = {(x.obligation_id, x.attribute_id, x.common_value) for x in units.common_units(r, a).where("stated").collect()}
    assert got == {(1, 10, 500000), (1, 10, 20000000), (2, 11, 864), (5, 13, 336)}
    assert units.common_units(r.limit(0), a).collect() == [] and units.common_units(r, a.limit(0)).collect() == []


_SEEN = "attribute_id int, obligation_id int, created_at timestamp, pos int, number double, kind string, factor double"


def test_multiplied_scales_and_wrong_units(spark):
    when = dt.datetime(2020, 1, 1)
    rules = [(1, "[A.pool] <= Rs. 2 lakh crore", "computable", when), (2, "[A.pool] <= 5 thousand crore", "computable", when)]
    a = spark.createDataFrame([(10, "A", "pool", "number", "rupees", "", None)], "id int, category string, canonical_name string, data_type string, unit string, description string, aliases array<string>")
    r = spark.createDataFrame(rules, "id int, rule_expression string, obligation_type string, created_at timestamp")
    got = {x.obligation_id: (x.common_value, x.unit, x.suspect) for x in units.common_units(r, a).collect()}
    assert got == {1: (2 * 10**12, "billion rupees", False), 2: (5 * 10**10, "billion rupees", False)}
    # One limit in a row of 5 crore each that says minutes' worth of money: 5 where all others are 50,000,000.
    rows = [(1, i, when, 0, 5.0, "money", 1e7 if i != 7 else 1e-3 * 1e7 / 1e7) for i in range(15)]
    out = {x.obligation_id: x for x in units.decoded(spark.createDataFrame(rows, _SEEN)).collect()}
    assert [i for i, x in out.items() if x.suspect] == [7] and out[7].common_value == 0 and out[6].common_value == 50_000_000


def test_hidden_units_are_inferred(spark, sf, monkeypatch):
    """A tenth of the stated units is masked; the model gives more than half of them back."""
    monkeypatch.setattr(units, "PIECE", 500)
    read = lambda n: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet")
    seen = units.observations(read("obligations"), read("attributes")).where("factor IS NOT NULL").toPandas().drop_duplicates()
    masked = np.random.default_rng(1).random(len(seen)) < 0.1
    shown = seen.assign(factor=np.where(masked, np.nan, seen["factor"]))
    rows = [tuple(None if x is None or x != x else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in shown[[c.split()[0] for c in _SEEN.split(", ")]].itertuples(index=False)]
    out = units.decoded(spark.createDataFrame(rows, _SEEN)).toPandas().merge(seen[masked], on=["attribute_id", "obligation_id", "pos", "number"])
    want = np.floor(out["number"] * out["factor"] + 0.5 + 1e-6)
    print("masked", len(out), "right", (out["common_value"] == want).mean())
    assert len(out) > 100 and (out["common_value"] == want).mean() > 0.5
