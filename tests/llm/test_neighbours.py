"""Problem 6 against brute force, with copies, unusable vectors and extreme scales."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrid.llm import neighbours

SCHEMA = "id int, created_at timestamp, embedding array<float>, rank int, key string, code string"


def frame(spark, vectors):
    when = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(i, when, v, 1, "x", "x") for i, v in vectors], SCHEMA)


def brute(vectors, k, floor):
    usable = {i: np.asarray(v, "f8") / np.abs(v).max() for i, v in vectors if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(usable)
    x = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    sims, pairs = np.round(x @ x.T, 6), set()
    for a, i in enumerate(ids):
        near = sorted((b for b in range(len(ids)) if b != a and sims[a, b] >= floor), key=lambda b: (-sims[a, b], ids[b]))[:k]
        pairs |= {tuple(sorted((i, ids[b]))) for b in near}
    return pairs


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    rows, x = [], rng.standard_normal((n, 64))
    for i in range(n):
        base = x[rng.integers(0, n)] if rng.random() < 0.4 else x[i]
        v = (base + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.4])) * 10.0 ** rng.integers(-12, 12)
        rows.append((int(i), v.astype("f4").tolist()))
    return rows


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    rows = sample(900)
    dirty = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [0.0] * 64), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63)]
    want = brute(rows, 5, 0.9)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(frame(spark, rows + dirty + rows[:20])).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 0.02 * len(want)


def test_a_third_of_copies_stays_whole_and_bounded(spark):
    v = np.random.default_rng(2).standard_normal(64).astype("f4").tolist()
    rows = [(i, [x * 2.0 ** (i % 3) for x in v]) for i in range(60)] + [(100, [x + 0.01 for x in v])]
    got = neighbours.similar(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.rank, r.neighbour_id))
    assert sorted(by) == [*range(60), 100] and all(len(x) == 5 for x in by.values())
    assert [n for _, n in sorted(by[40])] == [0, 1, 2, 3, 4] and [n for _, n in sorted(by[2])] == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0] * 64)]])
def test_nothing_to_compare(spark, rows):
    assert neighbours.similar_pairs(frame(spark, rows)).collect() == []


def test_the_latest_row_of_an_id_counts(spark):
    a, b = [1.0] * 64, [1.0, -1.0] * 32
    rows = [(1, dt.datetime(2020, 1, 1), a), (1, dt.datetime(2021, 1, 1), b), (2, dt.datetime(2020, 1, 1), a), (3, dt.datetime(2020, 1, 1), b)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp, embedding array<float>")
    assert [tuple(r) for r in neighbours.similar_pairs(df).collect()] == [(1, 3)]


@pytest.mark.parametrize("leaf, full", [(64, 100_000), (100_000, 100_000), (128, 50)])
def test_asked_rows_have_their_k_most_similar_however_far(spark, monkeypatch, leaf, full):
    monkeypatch.setattr(neighbours, "WIDE_LEAF", leaf)
    monkeypatch.setattr(neighbours, "FULL", full)
    rows = sample(500)
    rows += [(3000 + i, [x * 2.0 for x in rows[7][1]]) for i in range(8)] + [(2000, None), (2003, [0.0] * 64)]
    usable = {i: np.asarray(v, "f8") / np.abs(v).max() for i, v in rows if v is not None and np.any(v)}
    ids = sorted(usable)
    x = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    sims = np.round(x @ x.T, 9)
    want = {i: [ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sims[a, b], ids[b]))[:5]] for a, i in enumerate(ids) if i % 4 == 0}
    got = {}
    for r in neighbours.nearest(frame(spark, rows), asked=F.col("id") % 4 == 0).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.93 * 5 * len(want)
    assert got[3000] == want[3000] and got[3004] == want[3004]


def test_a_search_stops_by_the_chi_square_test_and_misses_little():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x[1::3] = x[::3] + 0.3 * rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(3000)
    q, r, s = neighbours.searched(x, ids, x[:300], ids[:300], 1, np.full(300, 4.0))
    sims = x[:300] @ x.T
    sims[np.arange(300), np.arange(300)] = -2
    assert (np.bincount(q, minlength=300) == 1).all() and (sims.argmax(1)[q] == r).mean() > 0.98 and np.allclose(s, sims[q, r])


def test_levels_of_the_tree_agree_with_one_tree():
    rng = np.random.default_rng(6)
    points = rng.standard_normal((4000, neighbours.M)).astype("f4")
    upper = neighbours.Tree.fitted(points, 3)
    leaf = upper.leaf(points)
    whole = upper.below({i: neighbours.Tree.fitted(points[leaf == i], 2) for i in range(8)}, 2)
    one = neighbours.Tree.fitted(points, 5)
    assert (whole.leaf(points) == one.leaf(points)).all() and np.bincount(one.leaf(points)).max() <= 126
    row, seen = one.visit(points[:200], np.full(200, 0.5))
    assert (seen[:200] == one.leaf(points[:200])).all() and len(set(zip(row, seen))) == len(row)
    pairs = {(i, j) for i, j in zip(row.tolist(), seen.tolist())}
    for j in range(0, 4000, 37):
        gap = one.gap(points[:200], np.repeat(points[j : j + 1], 200, 0))
        assert all(((i, int(one.leaf(points[j : j + 1])[0])) in pairs) == (gap[i] <= 0.5) for i in range(200) if abs(gap[i] - 0.5) > 1e-4)


def test_deep_trees_and_chunks_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "FULL", 40)
    monkeypatch.setattr(neighbours, "DEPTHS", (3, 4))
    base = np.random.default_rng(8).standard_normal(64)
    rows = sample(600) + [(5000 + i, (base + 1e-4 * np.random.default_rng(i).standard_normal(64)).astype("f4").tolist()) for i in range(300)]
    want = brute(rows, 5, 0.9)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(frame(spark, rows)).collect()}
    few = {p for p in want if p[1] < 5000}
    assert len(got & few) >= 0.95 * len(few) and {i for p in got for i in p} >= {5000 + i for i in range(300)} and len(got) < len(want) + 1500


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0] * 64)]])
def test_nothing_to_compare_without_a_floor(spark, rows):
    assert neighbours.nearest(frame(spark, rows)).collect() == []
