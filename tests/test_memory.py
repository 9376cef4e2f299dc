import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.operators import clustering, graph, index, learning, merkle, search


def vectors(n, dim=8, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(leaves):
    width = 1 << max(0, (len(leaves) - 1).bit_length())
    level = list(leaves) + [leaves[-1]] * (width - len(leaves))
    out = [level]
    while len(level) > 1:
        level = [sha("".join(sorted(p))) for p in zip(level[::2], level[1::2])]
        out.append(level)
    return out


def test_trees_beyond_one_block(spark):
    """A tree of 2 500 leaves (three blocks, padded to four) beside small ones, node by node."""
    sizes = {"a": 2500, "b": 1, "c": 3, "d": 1024}
    rows = [(t, i, sha(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    nodes = merkle.tree(spark.createDataFrame(rows, "tree string, pos int, hash string"), "tree", "pos", "hash", "sha2")
    got = {(r.tree, r.level, r.pos): r.hash for r in nodes.collect()}
    want = {(t, level, i): h for t, n in sizes.items() for level, hs in enumerate(plain_levels([sha(f"{t}{i}") for i in range(n)])) for i, h in enumerate(hs)}
    assert got == want
    empty = spark.createDataFrame([], "tree string, pos int, hash string")
    assert merkle.tree(empty, "tree", "pos", "hash").count() == 0


def test_edits_equality_and_batches(spark):
    leaves = spark.createDataFrame([(t, i, sha(f"{t}{i}")) for t in "ab" for i in range(5)], "tree string, pos long, hash string")
    new = merkle.edited(leaves, spark.createDataFrame([("a", 2, sha("x"))], "tree string, pos long, hash string"), spark.createDataFrame([("a", 7, sha("y")), ("a", 9, sha("z"))], "tree string, n int, hash string"))
    assert {r.pos: r.hash for r in new.where("tree = 'a'").collect()} == {0: sha("a0"), 1: sha("a1"), 2: sha("x"), 3: sha("a3"), 4: sha("a4"), 5: sha("y"), 6: sha("z")}
    old_nodes = merkle.tree(leaves, "tree", "pos", "hash", "sha2")
    nodes = merkle.retree(old_nodes, leaves, new, "sha2")
    assert {r.tree: r.equal for r in merkle.equal_trees(old_nodes, nodes).collect()} == {"a": False, "b": True}
    assert {r.tree: r.root for r in merkle.roots(nodes).collect()}["a"] == plain_levels([sha("a0"), sha("a1"), sha("x"), sha("a3"), sha("a4"), sha("y"), sha("z")])[-1][0]
    with pytest.raises(ValueError):
        merkle.edited(leaves, spark.createDataFrame([("a", 5, "h")], "tree string, pos long, hash string"), leaves.limit(0).select("tree", F.lit(0).alias("n"), "hash"))
    wanted = leaves.where("pos IN (1, 4)")
    siblings, top = merkle.batch_siblings(old_nodes, wanted.select("tree", "pos")), merkle.roots(old_nodes)
    valid = lambda w, s: {r.tree: r.valid for r in merkle.batch_valid(w, s, top, "sha2").collect()}
    assert valid(wanted, siblings) == {"a": True, "b": True}
    assert valid(wanted.withColumn("hash", F.when(F.col("tree") == "a", F.lit("0")).otherwise(F.col("hash"))), siblings) == {"a": False, "b": True}
    assert valid(wanted, siblings.where("level > 0 OR tree = 'b'")) == {"a": False, "b": True}
    powers = spark.range(9).select(merkle.is_power_of_two(F.col("id")).alias("p"), "id")
    assert {r.id for r in powers.collect() if r.p} == {1, 2, 4, 8}


def test_search_with_filters_and_boosts(spark):
    x = vectors(40)
    records = spark.createDataFrame([(f"r{i:02}", x[i].tolist(), ["t" if i % 2 else "u"], "a" if i < 30 else None) for i in range(40)] + [("null", None, None, "a"), ("short", [1.0], ["t"], "a")], "id string, embedding array<double>, tags array<string>, source_type string")
    q = x[0] + 0.1
    s = {f"r{i:02}": float(x[i] @ q / np.linalg.norm(q)) for i in range(40)}
    top = sorted(s, key=lambda i: (-s[i], i))[:10]
    kept = [i for i in top if s[i] >= 0.2 and int(i[1:]) % 2 and int(i[1:]) < 30][:5]
    got = search.search(records, q.tolist(), k=5, least=0.2, tags=["t"], source_type="a", refine=False).orderBy("rank").collect()
    assert [r.id for r in got] == kept and all(abs(r.score - s[r.id]) < 1e-9 for r in got)
    first, second = top[0], top[1]
    edges = spark.createDataFrame([(second, "m", "CAUSAL", 0.9), (first, "m", "INHIBITORY", -0.9), (second, first, "SEMANTIC", 0.5)], "source_id string, target_id string, edge_type string, weight double")
    memory = spark.createDataFrame([("m",)], "node string")
    contents = spark.createDataFrame([(first, "nothing here"), (second, "graph memory graph")], "id string, text string")
    got = {r.id: r for r in search.search(records, q.tolist(), "graph", k=2, edges=edges, memory=memory, contents=contents, refine=False).collect()}
    hybrid = {i: 0.85 * s[i] for i in (first, second)}
    assert got[first].score == pytest.approx(hybrid[first]) and got[first].content == "nothing here"
    assert got[second].score == pytest.approx(hybrid[second] + 0.15 * got[second].keyword + 0.1 * 0.5 + 0.15 * 0.9) and got[second].keyword > 0.5
    assert search.search(records.limit(0), q.tolist(), k=3).count() == 0


def test_ingested(spark):
    x = vectors(6)
    near = x[0] + 0.01
    records = spark.createDataFrame([("a", x[0].tolist(), ["p", "q"]), ("b", x[1].tolist(), None)], "id string, embedding array<double>, tags array<string>")
    new = spark.createDataFrame([("n1", near.tolist(), ["q", "r"]), ("n2", x[2].tolist(), ["s"]), ("n3", x[2].tolist(), ["t"]), ("n4", None, ["x"])], "id string, embedding array<double>, tags array<string>")
    outcome, after, edges = search.ingested(records, new, link=-1.0)
    assert {(r.id, r.action, r.record) for r in outcome.collect()} == {("n1", "merged", "a"), ("n2", "created", "n2"), ("n3", "merged", "n2")}
    assert {r.id: r.tags for r in after.collect()} == {"a": ["p", "q", "r"], "b": [], "n2": ["s", "t"]}
    assert {(r.source, r.target) for r in edges.collect()} == {("n2", "a"), ("a", "n2"), ("n2", "b"), ("b", "n2")}


def test_index(spark, tmp_path):
    x = vectors(300, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    i = index.VectorIndex(spark, str(tmp_path / "i")).build(df.where("id < 200"), "id", "v")
    i.insert(df.where("id >= 200"), "id", "v")
    with pytest.raises(ValueError):
        i.insert(df.where("id = 5"), "id", "v")
    i.delete(spark.createDataFrame([(7,), (9,)], "id long"))
    s = x @ x.T
    s[:, [7, 9]] = -3
    np.fill_diagonal(s, -3)
    want = {(a, int(b)) for a in range(20) for b in np.argsort(-s[a])[:5]}
    ask = lambda probes: {(r.id, r.other) for r in i.search(df.where("id < 20"), "id", "v", 5, probes).collect()}
    assert ask(10**6) == want and i.size() == 298
    i.compact()
    assert ask(10**6) == want and len(ask(8) & want) >= 0.6 * len(want)
    i.insert(df.where("id = 7"), "id", "v")
    assert i.size() == 299
    assert i.search(df.limit(0), "id", "v").count() == 0


def test_walks_follow_the_weights(spark):
    edges = spark.createDataFrame([(f"s{i}", "hub", 1.0, f"e{i}") for i in range(2000)] + [("hub", "heavy", 3.0, "x"), ("hub", "light", 1.0, "y"), ("hub", "never", -1.0, "z")], "source_id string, target_id string, weight double, id string")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(2000)] + [("lone",)], "start string")
    ends = [r.path[-1] for r in graph.random_walks(edges, starts, 5).collect()]
    assert len(ends) == 2000 and set(ends) == {"heavy", "light"} and abs(ends.count("heavy") / 2000 - 0.75) < 0.04


def test_learning_flow(spark):
    runs = [("r1", "t", ["A", "b", "c"], True, 1.0), ("r2", "t", ["a", "B", "c"], False, 3.0), ("r3", "t", ["x"], True, 2.0), ("r4", "u", ["a", "b", "c"], True, 2.0), ("r5", "t", [], True, 2.0)]
    schema = "run_id string, task_type string, steps array<string>, success boolean, duration double"
    none = spark.createDataFrame([], "process_id string, task_type string, steps array<string>")
    zero = spark.createDataFrame([], "process_id string, executions long, success_rate double, avg_duration double")
    processes, stats = learning.learned_processes(none, zero, spark.createDataFrame(runs, schema))
    assert {(r.process_id, r.executions, r.success_rate, r.avg_duration) for r in stats.collect()} == {("r1", 2, 0.5, 2.0), ("r3", 1, 1.0, 2.0), ("r4", 1, 1.0, 2.0), ("r5", 1, 1.0, 2.0)}
    _, stats = learning.learned_processes(processes, stats, spark.createDataFrame([("s1", "t", ["c", "b", "a"], True, 8.0)], schema))
    assert {r.process_id: (r.executions, round(r.success_rate, 6), r.avg_duration) for r in stats.collect()}["r1"] == (3, 0.666667, 4.0)
    rng = np.random.default_rng(2)
    c = vectors(2, 16, 9)
    rows = [(1, k, (c[k % 2] + 0.1 * rng.standard_normal(16)).tolist(), 0.5) for k in range(16)] + [(2, 100, c[0].tolist(), 0.5)]
    found = spark.createDataFrame(rows, "batch int, k int, v array<double>, importance double")
    old = spark.createDataFrame([("known", c[0].tolist(), 4, 1.0)], "id string, centroid array<double>, n long, avg_importance double")
    after = {r.id: r for r in learning.learned_patterns(found, "batch", "k", "v", old).collect()}
    # each batch is cut into four clusters; those of three or more near the old pattern join it, batch 2 is too small
    n = after["known"].n
    assert 7 <= n <= 12 and round(after["known"].avg_importance, 6) == round((4 + 0.5 * (n - 4)) / n, 6) and sum(r.n for r in after.values()) <= 20 and len(after) >= 2


def test_runs_of_one_shape_meet_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def jaccard(a, b):
        calls.add(1)
        x, y = set(a), set(b)
        return len(x & y) / len(x | y)

    monkeypatch.setattr(learning, "jaccard", F.udf(jaccard, "double"))
    steps = [["a", "b", "C"], ["B", "a", "c", "c"], ["x", "y"]]
    runs = spark.createDataFrame([(f"r{i:03}", "t", steps[i % 3]) for i in range(300)], "run_id string, task_type string, steps array<string>")
    processes = spark.createDataFrame([(f"p{i:03}", "t", steps[i % 2]) for i in range(5, 305)], "process_id string, task_type string, steps array<string>")
    got = {r.run_id: r.process_id for r in learning.same_process(runs, processes).collect()}
    assert got == {f"r{i:03}": "p005" for i in range(300) if i % 3 < 2} and 0 < calls.value < 100


def test_kmeans_plus_plus(spark):
    c = vectors(4, 16, 5)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, (c[i % 4] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(80)], "id long, v array<double>")
    at, _, _ = clustering.kmeans(df, "id", "v", 4)
    groups = {}
    for r in at.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())


def test_closest(spark, monkeypatch):
    from memlattice.operators import similarity

    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 48)) + 0.5
    base[300:] = base[rng.integers(0, 100, 100)]  # equal vectors, further copies and rows nearly alike
    base[200:300] = base[:100] + 0.12 * rng.standard_normal((100, 48))
    ask = np.concatenate([base[:60], base[60:160] + rng.uniform(0.05, 0.6, (100, 1)) * rng.standard_normal((100, 48)), 3 * base[5:9], rng.standard_normal((40, 48))])
    ask = np.concatenate([ask, ask[-60:]])
    rows = [(f"b{i:03}", v.tolist()) for i, v in enumerate(base)] + [("z", [0.0] * 48), ("n", None), ("nan", [math.nan] * 48), ("short", [1.0] * 7), (None, base[0].tolist()), ("b001", base[1].tolist())]
    asked = [(f"q{i:03}", v.tolist()) for i, v in enumerate(ask)] + [("z", [0.0] * 48), ("n", None), ("h", [1.0, None] * 24), ("short", [1.0] * 7), ("e", []), ("q000", ask[0].tolist())]
    old, new = (spark.createDataFrame(x, "id string, v array<double>") for x in (rows, asked))
    found = similarity.search(new, old, "id", "v", 1, 0.95, exclude_self=False)
    want = {(r.id, r.other) for r in found.collect()}
    monkeypatch.setattr(similarity, "SLICE", 150)
    got = similarity.closest(new, old, "id", "v", 0.95).collect()
    assert {(r.id, r.other) for r in got} == want and len(got) == len(want) > 120
    assert similarity.closest(new.limit(0), old, "id", "v", 0.95).count() == 0 == similarity.closest(new, old.limit(0), "id", "v", 0.95).count()


def test_ingestion_shuffles_no_vectors(spark):
    """The vectors of both sides are 3.7 MB; their block products sent each of them at least once."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    x = vectors(1000, 384)
    rows = spark.createDataFrame([(f"r{i:04}", v.tolist(), ["t"]) for i, v in enumerate(np.concatenate([x, x[:200]]))], "id string, embedding array<double>, tags array<string>")
    before = written()
    outcome, _, _ = search.ingested(rows.where("id < 'r0600'"), rows.where("id >= 'r0600'"), link=None)
    assert {r.action: r.n for r in outcome.groupBy("action").agg(F.count("*").alias("n")).collect()} == {"created": 400, "merged": 200}
    assert written() - before < 1_000_000
