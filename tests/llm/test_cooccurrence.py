from collections import Counter
from itertools import combinations

from memlattice.llm import cooccurrence as P

S = "id string, tags array<string>, basket string, n long"


def brute(rows):
    items = {}
    for i, tags, *_ in rows:
        if i is not None:
            items.setdefault(i.strip().lower(), set()).update(t.strip().lower() for t in tags or () if t and t.strip())
    one, two = Counter(), Counter()
    for s in items.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    n = sum(bool(s) for s in items.values())
    return {(a, b): (k, one[a], one[b], n) for (a, b), k in two.items()}


def scores(table):
    return {(r.tag_a, r.tag_b): (r.n_ab, r.n_a, r.n_b, r.n_items) for r in table.scores().collect()}


ROWS = [
    ("A", ["x", "Y ", "x", None, " "], "c", 1), ("a ", ["y", "x"], "c", 1), ("b", None, "c", 1), ("c", [], "c", 1), ("d", ["x", "é", "기억"], "c", 1),
    ("e", ["y", "x", "z"], "c", 1), (None, ["x", "y"], "c", 1), ("f", ["z"], "c", 1), ("g", [f"t{i}" for i in range(40)], "c", 1),
]


def test_counts(spark):
    df = spark.createDataFrame(ROWS, S)
    assert scores(P.count_pairs(df)) == brute(ROWS)
    assert scores(P.count_pairs(df.limit(0))) == {}


def test_increments_equal_the_whole(spark):
    new = [("a", ["y", "q"], "", 1), ("d", [], "", 1), ("h", ["q", "z"], "", 1), ("e", ["y", "x", "z"], "", 1)]
    old, after = spark.createDataFrame(ROWS, S), spark.createDataFrame(new, S)
    table = P.PairTable(spark)
    table.merge(P.changes(None, P.baskets(old)))
    touched = table.merge(P.changes(P.baskets(old), P.baskets(after)))
    gone = {r[0] for r in new}
    kept = [r for r in ROWS if r[0] is None or r[0].strip().lower() not in gone]
    assert scores(table) == brute(kept + new)
    assert {r.tag_a for r in touched.collect()} >= {"q", "x"} and "t1" not in {r.tag_a for r in touched.collect()}
    part = table.scores(touched=spark.createDataFrame([("q",)], "tag string"))
    assert {(r.tag_a, r.tag_b) for r in part.collect()} == {("q", "y"), ("q", "z")}


def test_threshold_is_exact(spark):
    s = spark.createDataFrame([("a", "b", 5, 10, 10, 80), ("a", "c", 5, 10, 10, 79), ("b", "c", 4, 4, 4, 80), ("x", "y", 5 * 10**9, 10**10, 10**10, 8 * 10**10)], "tag_a string, tag_b string, n_ab long, n_a long, n_b long, n_items long")
    assert {(r.tag_a, r.tag_b) for r in P.together(s).collect()} == {("a", "b"), ("x", "y")}


def test_queries_give_rare_pairs(spark, tmp_path):
    from memlattice.llm.queries import QUERIES

    stamped = [(i, tags, f"202{4 + k % 2}-09-01 00:00:00") for k, (i, tags, *_) in enumerate(ROWS)]
    df = spark.createDataFrame(stamped, "id string, tags array<string>, at string").selectExpr("id", "tags", "CAST(at AS timestamp_ntz) AS created_at")
    df.write.parquet(str(tmp_path / "neuron_list.parquet"))
    for name in ("p5_pairs", "p5_pairs_incremental"):
        got = {(r.tag_a, r.tag_b): (r.n_ab, r.n_a, r.n_b, r.n_items) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == brute(ROWS) and min(n for n, *_ in got.values()) == 1


def test_a_merge_rewrites_touched_buckets_only(spark):
    table = P.PairTable(spark)
    before, _ = P.grow(table, None, spark.createDataFrame(ROWS, S))
    first = dict(table.where)
    after, touched = P.grow(table, before, spark.createDataFrame([("h", ["q", "x"], "", 1), ("h", ["q"], "", 1), ("e", ["z"], "", 1)], S))
    assert 0 < sum(v == 2 for v in table.where.values()) <= touched.count() and {b for b, v in table.where.items() if v == 1} <= set(first)
    assert scores(table) == brute([*ROWS, ("h", ["q", "x"])])
    assert {(r.item, tuple(r.basket)) for r in after.collect() if r.item in "eh"} == {("e", ("x", "y", "z")), ("h", ("q", "x"))}


def test_batches(spark):
    df = spark.createDataFrame([(i, tags, f"202{4 + k % 2}-09-01 00:00:00" if k else None) for k, (i, tags, *_) in enumerate(ROWS)], "id string, tags array<string>, at string")
    df = df.selectExpr("id", "tags", "CAST(at AS timestamp_ntz) AS created_at")
    assert scores(P.in_batches(df)[0]) == brute(ROWS)
    table, touched = P.in_batches(df.limit(0))
    assert scores(table) == {} and touched.count() == 0
