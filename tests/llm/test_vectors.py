import json
from datetime import datetime as dt

import numpy as np
import pytest

from memlattice.llm import clusters as K
from memlattice.llm import nearduplicates as D
from memlattice.llm import neighbours as N
from memlattice.llm.vectors import matrix, unit, usable_neurons

S = "id string, merkle_root string, chunk_hashes array<string>, embedding array<float>, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, vec string"
T1, T2 = dt(2024, 1, 1), dt(2024, 2, 1)


def row(i, v, updated=T1, deleted=None, meta=None):
    return (i, None, None, None if v is None else [float(x) for x in v], meta, T1, updated, deleted, "clash")


@pytest.fixture(scope="module")
def data(spark):
    """Blobs of very different size (one holds a third of all), close versions, copies, loners and dirt."""
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in (130, 40, 20, 9, 3, 2):
        c = rng.standard_normal(384)
        c /= np.linalg.norm(c)
        for _ in range(size):
            v = c + rng.standard_normal(384) * 0.55 / np.sqrt(384)
            rows.append((f"n{n:04}", v * rng.uniform(0.3, 3)))
            n += 1
    for i in range(0, 60, 4):
        rows.append((f"n{n:04}", rows[i][1] + rng.standard_normal(384) * 0.1 / np.sqrt(384)))
        n += 1
    for i in range(5):
        rows.append((f"n{n:04}", rows[200][1]))
        n += 1
    for _ in range(60):
        rows.append((f"n{n:04}", rng.standard_normal(384)))
        n += 1
    meta = json.dumps({"tags": ["Graph ", "graph", ""], "sourceType": "File"})
    good = [row(i.upper() if k % 7 == 0 else i, v, meta=meta if k < 130 else ["{cut", None, '{"tags": "one"}'][k % 3]) for k, (i, v) in enumerate(rows)]
    bad = [row("z1", None), row("z2", []), row("z3", [0.0] * 384), row("z4", [float("nan")] * 384), row("z5", [1.0] * 383), row("z6", rows[0][1], deleted=T2), row(None, rows[0][1])]
    old = [row("n0000", rng.standard_normal(384), updated=None), row(" N0001 ", rng.standard_normal(384), updated=dt(2023, 1, 1)), good[5], good[5]]
    df = spark.createDataFrame(good + bad + old, S)
    x = unit(np.array([v for _, v in rows], "f4"))
    return df, [i for i, _ in rows], x


def test_usable(spark, data):
    df, ids, x = data
    got = usable_neurons(df).toArrow()
    assert sorted(got.column("id").to_pylist()) == sorted(ids)
    at = {i: k for k, i in enumerate(ids)}
    np.testing.assert_allclose(unit(matrix(got.column("vec"))), x[[at[i] for i in got.column("id").to_pylist()]], atol=1e-6)
    assert usable_neurons(df.limit(0)).count() == 0


def test_neighbours(spark, data):
    df, ids, x = data
    s = np.round(x @ x.T, 6)
    want = {}
    for i, a in enumerate(ids):
        hits = sorted((-s[i, j], b) for j, b in enumerate(ids) if j != i and s[i, j] >= 0.5)[:5]
        want[a] = [b for _, b in hits]
    got = {}
    for r in sorted(N.nearest(usable_neurons(df)).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    pairs = lambda m: {(a, b) for a, bs in m.items() for b in bs}
    assert len(pairs(got) & pairs(want)) >= 0.99 * len(pairs(want)) and len(pairs(got) - pairs(want)) <= 0.01 * len(pairs(want))
    assert N.nearest(usable_neurons(df).limit(0)).count() == 0


def test_blocks_change_nothing(spark, data, monkeypatch):
    df, _, _ = data
    rows = lambda: {(r.id, r.neighbour, r.rank) for r in N.nearest(usable_neurons(df), lists=4, rerank=400).collect()}
    whole = rows()
    monkeypatch.setattr(N, "BLOCK", 20)
    assert rows() == whole


def test_many_equal_vectors_tie_by_id(spark):
    """More copies than are reranked, and near copies whose cosines are equal at 6 digits."""
    rng = np.random.default_rng(8)
    c = rng.standard_normal(384).astype("f4")
    near = c + (1e-5 * rng.standard_normal((400, 384))).astype("f4")
    x = np.concatenate([np.repeat(c[None], 700, axis=0), near, (c + 0.3 * rng.standard_normal((40, 384))).astype("f4"), rng.standard_normal((60, 384)).astype("f4")])
    ids = [f"n{i:04}" for i in rng.permutation(len(x))]
    s = np.round(unit(x) @ unit(x).T, 6)
    want = {(a, b, r + 1) for i, a in enumerate(ids) for r, (_, b) in enumerate(sorted((-s[i, j], b) for j, b in enumerate(ids) if j != i and s[i, j] >= 0.5)[:5])}
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in zip(ids, x)], "id string, vec binary")
    assert {(r.id, r.neighbour, r["rank"]) for r in N.nearest(df, lists=1).collect()} == want


def components(ids, x, least):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in np.argwhere(np.triu(x @ x.T >= least, 1)):
        a, b = find(ids[i]), find(ids[j])
        label[max(a, b)] = min(a, b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {(c, m) for c, ms in groups.items() if len(ms) >= 3 for m in ms}


@pytest.mark.parametrize("block", [2048, 24])
def test_clusters(spark, data, monkeypatch, block):
    df, ids, x = data
    monkeypatch.setattr(K, "BLOCK", block)
    members, rows = K.similarity_clusters(df)
    assert {(r.cluster_id, r.neuron_id) for r in members.collect()} == components(ids, x, 0.5)
    if block > 1000:
        d = {r.cluster_id: r for r in K.describe(members, rows).collect()}
        big = max(d.values(), key=lambda r: r.size)
        assert big.common_terms == ["source:file", "tag:graph"] and len(big.typical_members) == 3
        mine = [k for k, i in enumerate(ids) if (big.cluster_id, i) in components(ids, x, 0.5)]
        c = x[mine].sum(axis=0)
        assert big.typical_members[0] == ids[mine[int((x[mine] @ c).argmax())]]


def test_blocks_of_a_cell_meet_in_full(spark, monkeypatch):
    """Two dense groups of one cell, linked only by their most central rows."""
    rng = np.random.default_rng(3)
    one, two = np.zeros(384), np.zeros(384)
    one[0], two[0], two[1] = 1, 0.55, np.sqrt(1 - 0.55**2)
    noise = rng.standard_normal((600, 384))
    noise[:, :2] = 0
    x = np.repeat([one, two], 300, axis=0) + 0.55 * unit(noise)
    x[[150, 450]] = one, two
    x = unit(x, "f4")
    ids = [f"n{i:03}" for i in range(600)]
    assert {c for c, _ in components(ids, unit(x), 0.5)} == {"n000"} and (unit(x[:300]) @ unit(x[300:]).T >= 0.5).sum() == 1
    vectors = spark.createDataFrame([(i, v.tobytes()) for i, v in zip(ids, x)], "id string, vec binary")
    blank = K.packed(np.zeros((1, 64)))[0]
    rows = spark.createDataFrame([(i, c, blank) for i, c in zip(ids, K.packed(unit(x)))], "id string, code binary, side binary")
    monkeypatch.setattr(K, "BLOCK", 128)
    links = K.links(rows, vectors, np.concatenate([unit(one[None] + two, "f4"), np.zeros((1, 64), "f4")], axis=1), 0.5, 6, 384)
    label = {i: i for i in ids}
    pairs = [(r.a, r.b) for r in links.collect()]
    for _ in ids:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert set(label.values()) == {"n000"}


def test_doubtful_pairs_are_decided_exactly(spark):
    """Cosines within the rounding error of the threshold, as many as a third of all pairs."""
    rng = np.random.default_rng(12)
    x = []
    for g in range(40):
        c = unit(rng.standard_normal((1, 384)))[0]
        o = rng.standard_normal(384)
        o = unit((o - o @ c * c)[None])[0]
        t = 0.5 + (g - 20) * 2e-6
        x += [c, t * c + np.sqrt(1 - t * t) * o]
    x = np.array(x, "f4")
    ids = [f"n{i:03}" for i in range(len(x))]
    vectors = spark.createDataFrame([(i, v.tobytes()) for i, v in zip(ids, x)], "id string, vec binary")
    blank = K.packed(np.zeros((1, 64)))[0]
    rows = spark.createDataFrame([(i, c, blank) for i, c in zip(ids, K.packed(unit(x)))], "id string, code binary, side binary")
    found = K.links(rows, vectors, np.concatenate([unit(x[:1], "f4"), np.zeros((1, 64), "f4")], axis=1), 0.5, 6, 384)
    want = {(ids[i], ids[j]) for i, j in np.argwhere(np.triu(unit(x) @ unit(x).T >= 0.5, 1))}
    assert {(r.a, r.b) for r in found.collect()} == want and 10 < len(want) < 30


def test_no_clusters(spark, data):
    members, rows = K.similarity_clusters(data[0].limit(0))
    assert members.count() == 0 and rows.count() == 0


def test_near_duplicate_vectors(spark, data):
    df, ids, x = data
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in np.argwhere(np.triu(x @ x.T >= 0.95, 1))}
    links, members = D.similar_vectors(df)
    assert {(r.key_a, r.key_b) for r in D.all_pairs(links, members).collect()} == want and len(want) >= 15
    g = {r.key: r for r in D.groups(links, members).collect()}
    assert len(g) == len(ids) and max(r.n_copies for r in g.values()) == 6


def test_neighbours_of_neighbours(spark, monkeypatch):
    """Groups of eight, of which hardly any is in the sample that centroids are fitted on."""
    for name, value in (("REFINE_FROM", 0), ("FIT_ROWS", 64), ("FIT_PER_LIST", 0), ("FIT_MORE", 0)):
        monkeypatch.setattr(N, name, value, raising=False)
    rng = np.random.default_rng(4)
    c = np.repeat(rng.standard_normal((250, 96)), 8, axis=0)
    x = (c + 0.5 * rng.standard_normal(c.shape)).astype("<f4")
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    np.fill_diagonal(s, -1)
    want = {(f"n{a:04}", f"n{b:04}"): float(s[a, b]) for a in range(len(s)) for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.5}
    df = spark.createDataFrame([(f"n{i:04}", v.tobytes()) for i, v in enumerate(x)], "id string, vec binary")
    got = {(r.id, r.neighbour): r.cosine for r in N.nearest(df, lists=40, probes=4, dim=96).collect()}
    share = len(want.keys() & got.keys()) / len(want)
    assert share > 0.95, f"SHARE {share}"
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want.keys() & got.keys())
