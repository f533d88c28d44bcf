"""Problem 1 against walking each row up, with small blocks so that every border is crossed."""

import datetime as dt
import random

import pytest

from rulegrid.operators import hierarchy

SCHEMA = "id int, parent_id int, created_at timestamp, anchor string, root string, path string, next string"


def clauses(spark, parents):
    when = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(i, p, when, "x", "x", "x", "x") for i, p in parents], SCHEMA)


def walk(parents):
    known, out = dict(parents), {}
    for i in known:
        seen, at = [], i
        while at is not None and at in known and at not in seen:
            seen.append(at)
            at = known[at]
        if at is not None and at in known:
            loop = seen[seen.index(at) :]
            path = [i] if i in loop else seen[: seen.index(at) + 1][::-1]
            out[i] = (path[0], len(path) - 1, min(loop), "/".join(map(str, path)))
        else:
            out[i] = (seen[-1], len(seen) - 1, None, "/".join(map(str, seen[::-1])))
    return out


def forest(seed, n):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 5000), n)
    parents = {i: rng.choice([None, 9999, *ids[: k or 1], ids[k - 1]]) for k, i in enumerate(ids)}
    parents |= {i: ids[3] for i in ids[n // 2 : n // 2 + n // 3]}  # a third under one parent
    parents |= {ids[1]: ids[n - 1], ids[5]: ids[5]}
    return list(parents.items())


@pytest.mark.parametrize("bits", [14, 6])
def test_equals_walking_up(spark, monkeypatch, bits):
    monkeypatch.setattr(hierarchy, "BLOCK_BITS", bits)
    monkeypatch.setattr(hierarchy, "SEGMENT_BITS", max(4, bits - 6))
    parents = forest(bits, 160)
    got = hierarchy.hierarchy(clauses(spark, parents + parents[:9])).collect()
    assert {r.id: (r.root, r.depth, r.cycle_id, r.path) for r in got} == walk(parents) and len(got) == len(parents)
    for r in got:
        inside = [x for x in got if x.root == r.root and x.entry < r.entry and x.exit > r.exit]
        assert len(inside) == r.n_descendants


def test_a_deep_chain_takes_few_rounds(spark):
    parents = [(i, i - 1 if i else None) for i in range(700)]
    got = {r.id: (r.depth, r.n_descendants) for r in hierarchy.hierarchy(clauses(spark, parents), with_paths=False).collect()}
    assert got == {i: (i, 699 - i) for i in range(700)}


def test_empty_null_and_redelivered(spark):
    assert hierarchy.hierarchy(clauses(spark, [])).collect() == []
    rows = [(None, 1, dt.datetime(2020, 1, 1)), (1, None, dt.datetime(2020, 1, 1)), (2, 1, dt.datetime(2020, 1, 1)), (2, 7, dt.datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "id int, parent_id int, created_at timestamp")
    assert {r.id: r.path for r in hierarchy.hierarchy(df).collect()} == {1: "1", 2: "2"}


def test_values_are_inherited_from_the_nearest_row_above(spark):
    from pyspark.sql import functions as F

    df = clauses(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, None)])
    value = F.when(F.col("id") == 1, 42).when(F.col("id") == 3, 7)
    got = {r.id: (r.value, r.holder, r.distance) for r in hierarchy.inherited(df, F.col("id"), value).collect()}
    assert got == {1: ("42", 1, 0), 2: ("42", 1, 1), 3: ("7", 3, 0), 4: ("7", 3, 1), 5: (None, None, None)}
