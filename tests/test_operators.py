import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlattice.operators import attractors, chunks, clustering, events, graph, inference, learning, merkle, similarity, states, store
from memlattice.operators import journal as J


def test_search_is_exact_and_blocks_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype("f4")
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(100, None, ""), (101, [], ""), (102, [0.0] * 8, ""), (103, [1.0], "")]
    df = spark.createDataFrame(rows, "id long, e array<float>, score string")
    one = {(r.id, r.other): round(r.score, 6) for r in similarity.search(df, df, "id", "e", 3).collect()}
    many = {(r.id, r.other): round(r.score, 6) for r in similarity.search(df, df, "id", "e", 3, blocks=3).collect()}
    assert one == many
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(60):
        assert {o for q, o in one if q == i} == set(np.argsort(-s[i])[:3].tolist())
    assert similarity.search(df.limit(0), df.limit(0), "id", "e", 3).count() == 0


def test_many_centres_are_searched_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 4)))], "id long, e array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((7, 4)))], "g int, centroid array<double>")
    rows = lambda: {(r.id, r.g, round(r.similarity, 9)) for r in similarity.nearest(df, "id", "e", c, "g").collect()}
    few = rows()
    monkeypatch.setattr(similarity, "FEW", 3)
    assert rows() == few and len(few) == 30


def test_silhouette_and_cohesion(spark):
    rng = np.random.default_rng(1)
    x, g = rng.standard_normal((24, 4)), [i % 3 for i in range(23)] + [9]
    df = spark.createDataFrame([(i, g[i], x[i].tolist()) for i in range(24)], "id long, g int, e array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    g = np.array(g)
    for r in similarity.silhouette(df, "id", "g", "e").collect():
        own = (g == r.g) & (np.arange(24) != r.id)
        a = d[r.id][own].mean() if own.any() else 0
        b = min(d[r.id][g == o].mean() for o in set(g.tolist()) - {r.g})
        assert (r.a, r.b) == (pytest.approx(a), pytest.approx(b))
    m = {r.g: r.avg_similarity for r in similarity.mean_similarity(df, "g", "e").collect()}
    i = np.flatnonzero(g == 0)
    assert m[9] == 1 and m[0] == pytest.approx((1 - d)[np.ix_(i, i)][np.triu_indices(len(i), 1)].mean())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 60), st.integers(1, 200))
def test_content_cuts(data, low, more):
    cuts = chunks.content_cuts(data, low, low + more)
    assert (cuts[-1] == len(data)) if data else cuts == []
    sizes = np.diff([0, *cuts])
    assert all(n <= low + more for n in sizes) and all(n >= low for n in sizes[:-1])


def root_of(leaves):
    h = lambda a, b: hashlib.sha3_256("".join(sorted((a, b))).encode()).hexdigest()
    leaves = list(leaves)
    while len(leaves) & (len(leaves) - 1):
        leaves.append(leaves[-1])
    while len(leaves) > 1:
        leaves = [h(a, b) for a, b in zip(leaves[::2], leaves[1::2])]
    return leaves[0]


def test_merkle(spark):
    names = {n: [hashlib.sha3_256(f"{n}{i}".encode()).hexdigest() for i in range(n)] for n in (1, 2, 3, 5, 8)}
    df = spark.createDataFrame([(n, i, h) for n, hs in names.items() for i, h in enumerate(hs)], "tree int, pos int, hash string")
    nodes = merkle.tree(df, "tree", "pos", "hash")
    assert {r.tree: r.root for r in merkle.roots(nodes).collect()} == {n: root_of(h) for n, h in names.items()}
    proofs = merkle.proofs(nodes, df.select("tree", "pos"))
    assert all(r.valid for r in merkle.verified(proofs).collect()) and proofs.count() == 19
    forged = proofs.withColumn("leaf", F.lit("0" * 64))
    assert not any(r.valid for r in merkle.verified(forged).collect())
    claimed = merkle.roots(nodes).select("tree", "root")
    assert all(r.valid for r in merkle.range_valid(df, claimed).collect())
    bad = df.withColumn("hash", F.when((F.col("tree") == 8) & (F.col("pos") == 3), F.lit("1" * 64)).otherwise(F.col("hash")))
    assert {r.tree for r in merkle.range_valid(bad, claimed).collect() if not r.valid} == {8}
    assert merkle.tree(df.limit(0), "tree", "pos", "hash").count() == 0


def test_chunks_come_back(spark):
    df = spark.createDataFrame([(1, bytearray(b"x" * 1000)), (2, None), (3, bytearray(b"")), (4, bytearray(range(256)))], "k int, d binary")
    c = chunks.fixed_chunks(df, "k", F.col("d"), 100, "sha2")
    assert {r.k: bytes(r.data) for r in chunks.merge(c, "k").collect()} == {1: b"x" * 1000, 4: bytes(range(256))}
    assert chunks.stored(c).where("ref_count = 10").count() == 1


EDGES = "id string, source_id string, target_id string, edge_type string, weight double, activation_count long, bidirectional boolean, created_at timestamp_ntz"


def edges(spark, rows):
    return spark.createDataFrame([(f"e{i}", a, b, t, w, 0, False, None) for i, (a, b, t, w) in enumerate(rows)], EDGES)


def test_graph(spark):
    e = edges(spark, [("a", "b", "CAUSAL", 0.9), ("b", "c", "SEMANTIC", 0.5), ("a", "c", "SEMANTIC", 0.2), ("c", "d", "TEMPORAL", 0.8), ("d", "a", "SEMANTIC", 0.7), ("x", "x", "SEMANTIC", 1.0), ("b", "e", "INHIBITORY", -0.6)])
    s = spark.createDataFrame([("a",)], "start string")
    assert {r.node: r.hops for r in graph.bfs(e, s, 5).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    assert [r.node for r in graph.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "c", "d"]
    assert graph.shortest_path(e, "e", "a").count() == 0
    ids = spark.createDataFrame([(x,) for x in "abcdex"] + [("lone",)], "id string")
    assert {r.node: r.component for r in graph.components(ids, e).collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "lone": "lone"}
    paths = {tuple(r.path) for r in graph.ordered_paths(e, s, 3, graph.depth_first).collect()}
    assert ("a", "c", "d") in paths or ("a", "b", "e") in paths
    walk = graph.random_walks(e, s, 4, 1).collect()
    assert walk == graph.random_walks(e, s, 4, 1).collect() and walk[0].path[0] == "a"
    f = {(r.id, r.inferred): r.confidence for r in inference.forward(e).collect()}
    assert f[("a", "b")] == 1.0 and ("a", "c") not in f and f[("b", "c")] == 0.5
    assert {(r.id, r.inferred) for r in inference.two_hop(e).collect()} >= {("d", "b")}
    assert [r.node for r in inference.causal_chain(e, "e", "c").orderBy("step").collect()] == ["e", "b", "c"]
    out = graph.inhibited(spark.createDataFrame([("s", x, i + 1) for i, x in enumerate("abce")], "session string, node string, rank int"), e)
    assert {(r.source_id, r.target_id): round(r.weight, 4) for r in out.collect()}[("b", "e")] == -0.612


def test_goal_path():
    out = {"a": [("b", 0.9), ("c", 0.1)], "b": [("d", 0.9)], "c": [("d", 0.9)]}
    near = {"a": 0.0, "b": 0.5, "c": 0.5, "d": 0.95}
    path, cost, p = attractors.search_path(out, near, "a")
    assert path == ["a", "b", "d"] and cost == pytest.approx(0.02) and p == pytest.approx(0.99**2)
    assert attractors.search_path(out, {"a": 0.95}, "a") == (["a"], 0.0, 1.0) and attractors.search_path({}, near, "a") is None
    assert attractors.meeting_path(out, near, "a")[0] == ["a", "b", "d"]


def test_states(spark):
    df = spark.createDataFrame([(1, i, p, [1.0, float(i)]) for i, p in enumerate([0.5, 0.25, 0.25])] + [(2, 0, 0.0, [1.0, 0.0]), (2, 1, 0.0, [0.0, 1.0])], "owner_id int, state_id int, probability double, embedding array<double>")
    n = {(r.owner_id, r.state_id): r.probability for r in states.normalised(df).collect()}
    assert n[(2, 0)] == 0.5 and n[(1, 0)] == 0.5
    s = {r.owner_id: r for r in states.summary(df.where("owner_id = 1")).collect()}[1]
    assert s.entropy == pytest.approx(1.5) and s.dominant == 0
    for out in (states.observed(df, 1), states.evolved(states.normalised(df), 30.0)):
        total = {r.owner_id: r.t for r in out.groupBy("owner_id").agg(F.sum("probability").alias("t")).collect()}
        assert total == {1: pytest.approx(1), 2: pytest.approx(1)}
    assert states.observed(df, 1).where("selected").count() == 2


def test_clustering(spark):
    x = [[math.cos(a), math.sin(a)] for a in (0, 0.05, 0.1, 1.5, 1.55, 1.6, 3.1)]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x)], "id long, b int, e array<double>")
    got = {r.id: (r.cluster, r.role) for r in clustering.dbscan(df, "id", "e", 0.01, 3).collect()}
    assert [got[i][0] for i in range(7)] == [0, 0, 0, 3, 3, 3, None] and got[6][1] == "noise"
    assert {r.id: r.cluster for r in clustering.single_linkage(df, "id", "e", 0.99).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    h = {r.id: r.cluster for r in clustering.hierarchical(df, "b", "id", "e", 3).collect()}
    assert len({h[0], h[1], h[2]}) == 1 and len({h[3], h[4], h[5]}) == 1 and len(set(h.values())) == 3
    at, centres, _ = clustering.kmeans(df, "id", "e", 2)
    assert at.count() == 7 and centres.count() == 2
    with pytest.raises(ValueError):
        clustering.kmeans(df, "id", "e", 9)
    assert learning.farthest_first(np.array(x), 0.9).tolist()[:3] == [0, 0, 0]


def test_journal(spark):
    schema = "sequence long, entity_type string, operation string, entity_id string, payload string, vector_clock map<string,long>, changed_at timestamp_ntz, node_id string, received_at timestamp_ntz"
    j = spark.createDataFrame([(1, "n", "create", "x", "p", {"a": 1}, None, "a", None), (2, "n", "update", "x", "p", {"b": 1}, None, "b", None), (2, "n", "update", "x", "p", {"b": 1}, None, "b", None), (3, "n", "update", "y", None, None, None, "a", None)], schema)
    t = J.tidied(j)
    assert t.count() == 3
    assert J.conflicts(t.where("node_id = 'a'"), t.where("node_id = 'b'")).count() == 1
    new = J.applied(t.where("sequence = 1"), t)
    assert new.count() == 2 and J.applied(t, t).count() == 0
    out = J.appended(t, t.drop("sequence"), ["entity_id", "node_id"]).orderBy("sequence").collect()
    assert [r.sequence for r in out] == [4, 5, 6] and [r.entity_id for r in out] == ["x", "x", "y"]


def test_events_fold(spark):
    rows = [("s", i, k) for i, k in enumerate(["good", "good", "bad", "search", "search", "bad"])]
    got = events.dopamine(spark.createDataFrame(rows, "s string, at long, kind string"), "s", "at", "kind").first()
    x = 0.5
    for _, _, k in rows:
        x = min(1, max(0.1, x * 0.9 if k == "search" else x + (0.3 if k == "good" else -0.15)))
    assert got.level == pytest.approx(x)


def test_store(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, z string")
    new = spark.createDataFrame([("a", 2, "n"), ("c", 1, "c"), ("b", 0, "old")], "id string, v int, z string")
    assert {r.id: r.z for r in store.upsert(t, new, "id", "v").collect()} == {"a": "n", "b": "y", "c": "c"}
    assert {r.id: r.z for r in store.updated(t, spark.createDataFrame([("a", None), ("b", "q")], "id string, z string"), "id").collect()} == {"a": "x", "b": "q"}
    w = spark.createDataFrame([("a", "b", "causal", None, True), ("a", "zz", "causal", 1.0, False), ("a", "b", "nonsense", 1.0, False)], "source_id string, target_id string, edge_type string, weight double, bidirectional boolean")
    assert sorted((r.source_id, r.target_id) for r in store.new_edges(w, t).collect()) == [("a", "b"), ("b", "a")]
