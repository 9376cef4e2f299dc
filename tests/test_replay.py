import functools
import random
from datetime import datetime, timedelta

from memlattice.operators import replay as R

SCHEMA = "sequence long, entity_type string, operation string, entity_id string, payload string, vector_clock map<string,long>, changed_at timestamp_ntz, node_id string, received_at timestamp_ntz, op int, clock string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "c", "k") for r in rows], SCHEMA)


def at(n):
    return datetime(2024, 1, 1) + timedelta(minutes=n)


def covers(a, b):
    return all(a.get(k, 0) >= v for k, v in b.items())


def brute(rows):
    """Sorts each entity's changes and walks them."""
    by = {}
    for seq, et, op, eid, _, clock, when, node in rows:
        clock = {k: v for k, v in (clock or {}).items() if v}
        k = (node, tuple(sorted(clock.items())))
        cur = by.setdefault((et, eid), {})
        if k not in cur or seq < cur[k][0]:
            cur[k] = (seq, op.strip().lower(), clock, when)
    out = {}

    def order(x, y):
        if x[2] != y[2]:
            if covers(x[2], y[2]):
                return 1
            if covers(y[2], x[2]):
                return -1
        return -1 if (x[3], x[0]) < (y[3], y[0]) else 1

    for key, cs in by.items():
        live = None
        for c in sorted(cs.values(), key=functools.cmp_to_key(order)):
            live = c[0] if c[1] == "create" or c[1] == "update" and live is not None else None
        if live is not None:
            out[key] = live
    return out


def history(seed, entities=40):
    """Changes with true clocks, delivered late and twice."""
    rng, rows, seq = random.Random(seed), [], 0
    for e in range(entities):
        clocks = {n: {} for n in "abc"}
        t = 0
        for i in range(rng.randint(1, 12)):
            n = rng.choice("abc")
            if rng.random() < 0.6:
                o = rng.choice("abc")
                clocks[n] = {k: max(clocks[n].get(k, 0), clocks[o].get(k, 0)) for k in {*clocks[n], *clocks[o]}}
            clocks[n] = {**clocks[n], n: clocks[n].get(n, 0) + 1}
            t += rng.randint(1, 5)
            op = "create" if i == 0 else rng.choice(["update", "update", "delete", "CREATE ", "Update"])
            rows.append([0, "neuron", op, f"e{e}", f"p{i}", dict(clocks[n]), at(t), n])
    rng.shuffle(rows)
    rows += [list(r) for r in rng.sample(rows, len(rows) // 4)]
    for r in rows:
        seq += 1
        r[0] = seq
    return [tuple(r) for r in rows]


def test_matches_sorted_walk(spark):
    rows = history(3)
    got = {(r.entity_type, r.entity_id): r.sequence for r in R.replay(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_nulls_ties_and_empty(spark):
    rows = [
        (1, "neuron", "create", "a", "p", {"n": 1, "m": 0}, at(1), "n"), (2, "neuron", "create", "a", "p", {"n": 1}, at(1), "n"),
        (3, "neuron", None, "b", None, None, None, None), (4, None, "create", "c", "p", {}, at(1), "n"), (5, "neuron", "update", "d", "p", {"n": 1}, at(1), "n"),
        (6, "neuron", "create", "e", None, None, None, None), (None, "neuron", "create", "f", "p", {"n": 1}, at(1), "n"),
        (7, "synapse", "create", "a", "q", {"n": 1}, at(1), "n"), (8, "neuron", "delete", "e", None, {"x": 1}, at(0), "x"),
    ]
    got = {(r.entity_type, r.entity_id): (r.sequence, r.payload) for r in R.replay(frame(spark, rows)).collect()}
    assert got == {("neuron", "a"): (1, "p"), ("neuron", "f"): (None, "p"), ("synapse", "a"): (7, "q")}
    assert R.replay(frame(spark, [])).count() == 0


def test_hot_entity_is_split(spark):
    n = 12_000
    hot = [(i + 1, "neuron", "update" if i else "create", "hot", str(i), {"n": i + 1}, at(i), "n") for i in range(n // 2)]
    rest = [(n + i, "neuron", "create", f"e{i}", None, {"m": 1}, at(i), "m") for i in range(n // 2)]
    j = frame(spark, hot + rest)
    assert R.hot_entities(R.changes(j)) == ["neuron\u0001hot"]
    got = {r.entity_id: r.sequence for r in R.replay(j).collect()}
    assert got["hot"] == n // 2 and len(got) == n // 2 + 1


def test_partial_columns(spark):
    rows = [
        (1, "n", "create", "a", '{"x": 1, "y": "old", "gone": 1}', {"p": 1}, at(1), "p"), (2, "n", "delete", "a", None, {"p": 2}, at(2), "p"),
        (3, "n", "create", "a", '{"x": 2, "y": "é"}', {"p": 3}, at(3), "p"), (9, "n", "update", "a", '{"x": null, "z": [1, 2]}', {"p": 5}, at(9), "p"),
        (5, "n", "update", "a", '{"x": 7, "w": 0.5}', {"p": 4}, at(8), "p"), (6, "n", "update", "a", None, {"p": 6}, at(10), "p"),
        (7, "n", "update", "a", "[1]", {"p": 7}, at(11), "p"), (8, "n", "update", "a", '{"cut', {"p": 8}, at(12), "p"),
        (10, "n", "create", "b", "{}", {"p": 1}, at(1), "p"), (11, "n", "update", "c", '{"x": 1}', {"p": 1}, at(1), "p"), (12, "n", "update", "a", '{"y": "q"}', {"r": 1}, at(4), "r"),
    ]
    want = {("a", "w"): ("0.5", 5), ("a", "x"): (None, 9), ("a", "y"): ("q", 12), ("a", "z"): ("[1, 2]", 9)}
    for _ in range(2):  # delivered again in another order
        got = {(r.entity_id, r.column): (r.value, r.sequence) for r in R.replay_columns(frame(spark, rows)).collect()}
        assert got == want
        rows = rows[::-1] + rows[:3]
    assert R.replay_columns(frame(spark, [])).count() == 0


def test_many_concurrent_changes():
    """One entity with 100 000 changes that don't know of each other, and one that knows of all."""
    import time

    state, began = R.EntityState(), time.time()
    n = 100_000
    for i in range(n):
        state.apply(({f"n{i}": 1}, i, i, f"n{i}", R.CREATE if i == 0 else R.UPDATE, None))
    assert len(state.all.changes) == n and state.standing()[2] == n - 1
    state.apply(({f"n{i}": 1 for i in range(n)} | {"last": 1}, 0, n, "last", R.UPDATE, None))
    assert len(state.all.changes) == 1 and state.standing()[2] == n and time.time() - began < 30
