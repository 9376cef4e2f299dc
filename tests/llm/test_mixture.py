from collections import Counter, defaultdict

import numpy as np

from memlattice.llm import mixture as M

T = "source string, target_share double, max_repeats int, n_tokens int"


def docs(spark, sizes):
    rows = [(i * 1000 + k, "word " * (3 + (i + k) % 5), s, 7) for i, (s, n) in enumerate(sizes) for k in range(n)]
    rows += [(-1, None, "big", 1), (-2, "", "big", 1), (-3, "text", None, 1), (-4, "text", "unlisted", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_shares_repeats_and_shards(spark):
    d = docs(spark, [("big", 900), ("Small_One ", 30), ("mid", 200)])
    t = spark.createDataFrame([("BIG", 0.5, 1, 0), ("small-one", 0.3, 4, 0), ("mid", 0.2, 3, 0), (None, 0.5, 1, 0), ("empty", 0.25, 9, 0), ("zero", 0.0, 1, 0)], T)
    draws, shares = M.mix(d, t, shards=4)
    rows, share = draws.collect(), {r.source: r for r in shares.collect()}
    assert set(share) == {"big", "small-one", "mid", "empty"} and share["empty"].n_tokens == 0
    got = {s: share[s].actual_share for s in ("big", "small-one", "mid")}
    assert all(abs(got[s] - w) < 0.01 for s, w in (("big", 0.5), ("small-one", 0.3), ("mid", 0.2)))
    taken = Counter((r.doc_id, r.copy) for r in rows)
    assert max(taken.values()) == 1
    copies = defaultdict(int)
    for r in rows:
        copies[r.source] = max(copies[r.source], r.copy + 1)
    assert copies["big"] == 1 and copies["small-one"] == 4
    for s in range(4):
        assert sorted(r.position for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    n = Counter(r.shard for r in rows)
    assert max(n.values()) < 1.4 * min(n.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(d, t, shards=4)[0].collect()))


def test_total_above_what_fits(spark):
    d = docs(spark, [("big", 300), ("small", 10)])
    t = spark.createDataFrame([("big", 0.5, 2, 0), ("small", 0.5, 3, 0)], T)
    share = {r.source: r for r in M.mix(d, t, total_tokens=10**9)[1].collect()}
    assert share["big"].n_tokens == 2 * share["big"].source_tokens and share["small"].repeats == 3


def test_empty(spark):
    d, t = docs(spark, []), spark.createDataFrame([("big", 1.0, 1, 0)], T)
    draws, shares = M.mix(d.where("doc_id > 0"), t)
    assert draws.count() == 0 and shares.first().actual_share == 0
    draws, shares = M.mix(d, t.limit(0))
    assert draws.count() == 0 and shares.count() == 0


def test_tree_is_exact():
    rng = np.random.default_rng(0)
    q = np.array([1000, 3, 0, 77])
    for shards in (1, 2, 7, 16):
        per = M.split_tree(q, shards, rng)
        assert (per.sum(axis=0) == q).all() and per.min() >= 0 and np.ptp(per.sum(axis=1)) <= shards.bit_length()
    assert 0 <= M.hypergeometric(3 * 10**9, 10**9, 10**9, rng) <= 10**9


def test_every_pass_has_its_own_order(spark):
    from pyspark.sql import functions as F

    orders = {(s, t): [M.place_of(b, s, t, 5) for b in range(M.BLOCKS)] for s in ("a", "b") for t in (0, 1)}
    assert all(sorted(o) == list(range(M.BLOCKS)) for o in orders.values()) and len({tuple(o) for o in orders.values()}) == 4
    assert abs(np.corrcoef(range(M.BLOCKS), orders["a", 0])[0, 1]) < 0.1 and abs(np.corrcoef(orders["a", 0], orders["a", 1])[0, 1]) < 0.1
    df = spark.range(M.BLOCKS).select(F.col("id").alias("block"), F.lit("b").alias("source"), F.lit(1).alias("copy"))
    assert {r.block: r._place for r in M.with_place(df, 5).collect()} == dict(enumerate(orders["b", 1]))


def test_large_draws_follow_the_distribution():
    rng = np.random.default_rng(3)
    good, bad, draws = 3 * 10**9, 5 * 10**9, 2 * 10**9
    x = np.array([M.hypergeometric(good, bad, draws, rng) for _ in range(300)], "f8")
    n = good + bad
    sd = (draws * (good / n) * (bad / n) * (n - draws) / (n - 1)) ** 0.5
    assert abs(x.mean() - draws * good / n) < 5 * sd / 300**0.5 and 0.85 < x.std() / sd < 1.15
    assert M.hypergeometric(5, 2 * 10**9, 2 * 10**9 + 4, rng) in (4, 5) and M.hypergeometric(2 * 10**9, 1, 2 * 10**9, rng) in (2 * 10**9 - 1, 2 * 10**9)


def test_quotas_against_a_plain_count(spark):
    """Each source's tokens, counted one by one, are within its longest document of its share, or at its cap."""
    from memlattice.llm.tokens import encoder

    d = docs(spark, [("big", 700), ("small", 25), ("mid", 150)])
    t = spark.createDataFrame([("big", 0.4, 2, 0), ("small", 0.2, 3, 0), ("mid", 0.4, 4, 0)], T)
    size = {r.doc_id: len(encoder().encode_batch([r.text])[0]) for r in d.where("text <> ''").collect()}
    source = {r.doc_id: r.source for r in d.collect()}
    total = 3000
    draws, _ = M.mix(d, t, total_tokens=total)
    got = Counter()
    for r in draws.collect():
        assert source[r.doc_id] == r.source and size[r.doc_id] == r.n_tokens
        got[r.source] += r.n_tokens
    for s, share, cap in (("big", 0.4, 2), ("small", 0.2, 3), ("mid", 0.4, 4)):
        mine = [n for i, n in size.items() if source[i] == s]
        assert abs(got[s] - min(share * total, cap * sum(mine))) <= max(mine)
