"""Problem 8: budgets, prefixes, caps and labels."""

import numpy as np
import pandas as pd

from rulegrid.llm import mixing


def test_pouring():
    assert mixing.pour(10, np.array([1.0, 1.0]), np.array([20.0, 20.0])).tolist() == [5, 5]
    assert np.allclose(mixing.pour(10, np.array([0.5, 0.3, 0.2]), np.array([2.0, 100.0, 100.0])), [2, 4.8, 3.2])
    assert mixing.pour(10, np.array([1.0, 1.0]), np.array([1.0, 2.0])).tolist() == [1, 2] and mixing.pour(5, np.array([0.0]), np.array([9.0])).tolist() == [0]


def test_shortages_go_to_siblings_before_ancestors():
    leaves = pd.DataFrame({"domain": ["a", "a", "b"], "source": ["x", "y", "z"], "weight": [0.4, 0.2, 0.4], "room": [10.0, 100.0, 100.0]})
    assert np.allclose(mixing.budget(leaves, 100, ["domain", "source"]), [10, 50, 40])
    leaves["room"] = [10.0, 30.0, 100.0]
    assert np.allclose(mixing.budget(leaves, 100, ["domain", "source"]), [10, 30, 60])


def test_the_share_of_an_empty_source_goes_to_its_siblings(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOMAINS", {"a1": "a", "a2": "a", "b1": "b"})
    counts = spark.createDataFrame([(i, s, "en", 100) for i, s in enumerate(["a1"] * 5 + ["b1"] * 5)], "doc_id long, source string, lang string, tokens long")
    targets = spark.createDataFrame([("a1", 0.3, 9), ("a2", 0.2, 9), ("b1", 0.5, 9)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.leaf_budgets(counts, targets).collect()}
    assert {s: r.budget for s, r in got.items()} == {"a1": 500, "a2": 0, "b1": 500}


def tables(spark):
    docs = [(i, "Big One", "en", "word " * 40) for i in range(100)] + [(200 + i, " small-src ", "en-IN", "word " * 40) for i in range(5)] + [(300, "other", "hi", "word " * 200), (301, None, None, None), (302, "big_one", "en", ""), (0, "Big One", "en", "word " * 40)]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").selectExpr("*", "1 AS tokens", "1 AS slice")
    t = spark.createDataFrame([("big_one", 0.5, 1), ("Small Src", 0.3, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    return d, t


def test_mix(spark):
    d, t = tables(spark)
    chosen, shares = mixing.mix(d, t)
    uses = {r.doc_id: r.uses for r in chosen.collect()}
    assert all(uses[200 + i] == 3 for i in range(5)) and max(u for i, u in uses.items() if i < 100) == 1 and not uses.keys() & {300, 301, 302}
    got = {r.source: r for r in shares.collect()}
    assert got["Small Src"].is_short and got["absent"].is_short and not got["big_one"].is_short and got["absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-5
    assert {r.source for r in mixing.short_sources(d, t).collect()} == {"Small Src", "absent"} == {s for s, r in got.items() if r.is_short}


def test_short_sources_are_those_whose_uses_fall_below_the_target(spark):
    rng = np.random.default_rng(5)
    for seed in range(3):
        sizes = {s: int(n) for s, n in zip("abcdef", rng.integers(1, 400, 6))}
        share = rng.dirichlet(np.ones(6))
        repeats = rng.integers(1, 5, 6)
        counts = spark.createDataFrame([(i, s, ("en", "hi")[i % 2], n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, lang string, tokens long")
        targets = spark.createDataFrame([(s, float(p), int(r)) for s, p, r in zip(sizes, share, repeats)], "source string, target_share double, max_repeats int")
        given = {r.source: r.given for r in mixing.leaf_budgets(counts, targets).collect()}
        total = sum(sizes.values())
        want = {s for s, p, r in zip(sizes, share, repeats) if sizes[s] * r < p * total - 1e-6}
        assert {s for s, p in zip(sizes, share) if given[s] < p * total - 1e-6} == want


def test_the_prefix_is_that_of_a_sort_in_one_place(spark):
    rng = np.random.default_rng(3)
    counts = spark.createDataFrame([(int(i), "s", "en", int(n)) for i, n in enumerate(rng.integers(1, 50, 400))], "doc_id long, source string, lang string, tokens long")
    total = counts.groupBy().sum("tokens").first()[0]
    leaf = spark.createDataFrame([("d", "en", "s", total, 1.0, total + total // 3)], "domain string, lang string, source string, tokens long, weight double, budget long")
    got = {r.doc_id: r.uses for r in mixing.selection(counts, leaf).collect()}
    rows = counts.selectExpr("doc_id", "tokens", f"xxhash64({mixing.SEED}, 1, doc_id) AS h").toPandas()
    rows["slot"] = [((h % 2**64) >> 40) % mixing.SLICES for h in rows["h"].tolist()]
    assert set(got.values()) == {1, 2} and min(got) == 0 and len(got) == 400
    twice = [i for i, u in got.items() if u == 2]
    used = rows.set_index("doc_id").loc[twice, "tokens"].sum()
    assert total // 3 - 50 <= used <= total // 3
    edge = rows.set_index("doc_id").loc[twice, "slot"].max()
    assert set(rows[rows["slot"] < edge]["doc_id"]) <= set(twice)


def test_empty(spark):
    d, t = tables(spark)
    chosen, shares = mixing.mix(d.limit(0), t)
    assert chosen.collect() == [] and {r.is_short for r in shares.collect()} <= {True, False}
    assert mixing.mix(d, t.limit(0))[1].collect() == []
