"""Problems 3 and 5 against a plain fold, on small logs with every kind of dirt."""

import datetime as dt
import json
import random

import pytest

from rulegrid.operators import changes, filing, history

SCHEMA = "seq long, identity_hash string, full_hash string, verdict string, effective_from date, corrects_seq long, payload string, at string, value string, base string"


def log_of(spark, rows):
    full = [(*r[:7], "clash", "clash", "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def random_log(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(1, 400), n):
        key = rng.choice(["aa", "AA", "bb", "cc", None, "dd"])
        verdict = rng.choice(["new", "amendment", "amendment", "repeal", "restatement", "NEW"])
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(25))
        fields = {}
        for name, values in (("limit_value", [7, "7.00", 7.5, None]), ("limitUnit", ["days", " Days ", None]), ("severity", ["low", "HIGH"])):
            if rng.random() < 0.5:
                fields[name] = rng.choice(values)
        payload = rng.choice([json.dumps(fields), json.dumps({"rule": fields, "writer": "x"}), json.dumps(fields)[:-1], None, "", "[]"])
        rows.append((seq, key, f"H{rng.randrange(6)}", verdict, day, rng.choice([None] * 6 + [rng.randrange(1, 400)]), payload))
    return rows + rng.sample(rows, 10)


def effective(rows):
    void = {r[5] for r in rows if r[5] is not None}
    live = {r for r in rows if r[0] not in void and r[1] and r[3].lower() in ("new", "amendment", "repeal")}
    by = {}
    for r in sorted(live, key=lambda r: (r[4], r[0])):
        by.setdefault(r[1].lower(), []).append(r)
    return by


def plain_state(rows):
    out = {}
    for key, mine in effective(rows).items():
        held = None
        for r in mine:
            v = r[3].lower()
            held = None if v == "repeal" else r[2].lower() if v == "new" or held is not None else held
        if held:
            out[key] = held
    return out


def fields_of(payload):
    try:
        doc = json.loads(payload)
        flat = {k.replace("_", "").lower(): v for inner in doc.values() if isinstance(inner, dict) for k, v in inner.items()}
        flat |= {k.replace("_", "").lower(): v for k, v in doc.items() if not isinstance(v, dict)}
    except (ValueError, TypeError, AttributeError):
        return {}
    return {f: same(flat[f.replace("_", "")]) for f in history.FIELDS if f.replace("_", "") in flat}


def same(v):
    if v is None:
        return None
    text = str(v).strip().lower()
    try:
        return f"{float(text):g}"
    except ValueError:
        return text


def plain_versions(rows):
    out = set()
    for key, mine in effective(rows).items():
        state, days = None, {}
        for r in mine:
            v = r[3].lower()
            if v == "repeal":
                state = None
            elif v == "new":
                state = dict.fromkeys(history.FIELDS) | fields_of(r[6])
            elif state is not None:
                state = state | fields_of(r[6])
            days[r[4]] = dict(state) if state is not None else None
        order, last = sorted(days), None
        for i, day in enumerate(order):
            if i == 0 or days[day] != last:
                start = day
                end = next((d for d in order[i + 1 :] if days[d] != days[day]), None)
                if days[day] is not None:
                    out.add((key, str(start), str(end or history.OPEN_END)))
            last = days[day]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_state_and_history_equal_a_plain_fold_in_any_order(spark, seed):
    rows = random_log(seed)
    random.Random(seed + 50).shuffle(rows)
    log = log_of(spark, rows).repartition(5)
    assert {(r.identity_hash, r.full_hash) for r in changes.in_force(log).collect()} == set(plain_state(rows).items())
    got = [(r.identity_hash, r.valid_from, r.valid_to) for r in history.versions(log).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_versions(rows)


def test_columns_are_set_one_by_one(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, "a", "x", "new", day, None, "1", 10), (2, "a", None, "amendment", day, None, None, 20), (3, "a", "y", "amendment", day, None, None, None)]
    log = spark.createDataFrame(rows, "seq long, identity_hash string, full_hash string, verdict string, effective_from date, corrects_seq long, payload string, n int")
    got = changes.current_state(log, ["full_hash", "n", "payload"]).collect()
    assert [(r.full_hash, r.n, r.payload) for r in got] == [("y", 20, "1")]


def test_empty_and_all_null_logs(spark):
    empty = log_of(spark, [])
    nulls = log_of(spark, [(None,) * 7, (5, "k", None, None, None, None, None), (6, " ", "h", "new", None, None, None)])
    for log in (empty, nulls):
        assert changes.in_force(log).collect() == [] and history.versions(log).collect() == [] and filing.as_believed(log.selectExpr("*", "now() AS created_at"), "2020-01-01").collect() == []


def test_undated_rows_sort_first_in_the_state_and_have_no_history(spark):
    log = log_of(spark, [(9, "k", "Late", "new", None, None, "{}"), (1, "k", "Dated", "amendment", dt.date(2020, 1, 1), None, "{}")])
    assert [r.full_hash for r in changes.in_force(log).collect()] == ["dated"]
    assert history.versions(log).collect() == []


def test_hot_identity_is_folded_before_it_is_grouped(spark):
    log = log_of(spark, [(i, "k", f"h{i}", "new", dt.date(2020, 1, 1 + i % 3), None, "{}") for i in range(3000)])
    assert history.net_changes(log).count() == 3
    plan = changes.in_force(log)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning(identity_hash") == 1


def test_replayed_verdicts(spark):
    d = dt.date
    rows = [(1, "A", "f1", "new", d(2024, 1, 1), None, None), (2, "a", "F1", "x", d(2024, 1, 1), None, None), (3, "a", "f2", "x", d(2026, 1, 1), None, None), (4, "a", "f3", "x", d(2023, 1, 1), None, None)]
    got = {r.seq: r.replayed for r in filing.verdicts(log_of(spark, rows)).collect()}
    assert got == {4: "new", 1: "amendment", 2: "amendment", 3: "amendment"}


def test_broken_links_of_a_chain_are_found(spark):
    import hashlib

    rows, before = [], ""
    for i in range(1, 6):
        own = hashlib.sha256(f"{before}|p{i}".encode()).hexdigest()
        rows.append((i, f"p{i}" if i != 4 else "changed", before or None, own))
        before = own
    df = spark.createDataFrame(rows, "n long, p string, prev string, own string")
    assert [r.n for r in filing.chained(df, "n", "p", "prev", "own").collect()] == [4]


def test_merging_later_states_equals_a_rebuild(spark):
    snap = "identity_hash string, effective_from date, held boolean, limit_value string, limit_unit string, frequency string, owner_desk string, severity string"
    day = lambda n: dt.date(2020, 1, n)
    rng, rows = random.Random(3), []
    for key in "abc":
        for n in sorted(rng.sample(range(1, 28), 12)):
            held = rng.random() < 0.8
            rows.append((key, day(n), held, *([rng.choice("xy"), None, None, "d", "low"] if held else [None] * 5)))
    for cut in (1, 9, 20, 28):
        early = [r for r in rows if r[1] < day(cut)]
        late = [r for r in rows if r[1] >= day(cut)]
        part = history.merged(None, spark.createDataFrame(early, snap))
        both = history.merged(part, spark.createDataFrame(late, snap))
        want = history.merged(None, spark.createDataFrame(rows, snap))
        assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        again = history.merged(both, spark.createDataFrame(late, snap))
        assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    late = history.merged(history.merged(None, spark.createDataFrame([("a", day(1), True, "x", None, None, None, None)], snap)), spark.createDataFrame([("a", day(5), True, "y", None, None, None, None)], snap))
    assert [(r.valid_from, r.valid_to, r.limit_value) for r in late.orderBy("valid_from").collect()] == [("2020-01-01", "2020-01-05", "x"), ("2020-01-05", history.OPEN_END, "y")]
