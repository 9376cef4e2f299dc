"""Mixing sources to target weights by exact block quotas and a hypergeometric splitting tree."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.keys import tidy
from memlattice.llm.tokens import token_counts
from memlattice.session import materialize

#: Blocks of a source at most; a block is the unit that shards draw.
BLOCKS = 1024
#: Listed sources at most: quotas and block sizes (sources x BLOCKS rows) are planned on the driver.
MAX_SOURCES = 4096


def source_key(col: Column | str) -> Column:
    """A source's key: tidied, with ``-`` for each run of ``_``, spaces and ``-``."""
    return F.regexp_replace(tidy(col), r"[_\s-]+", "-")


@dataclass
class Plan:
    """Per source: blocks drawn of its passes over the permuted blocks, and where each shard's draws begin."""

    total: int
    whole: dict[str, int]
    partial: dict[str, int]
    starts: dict[str, list[int]]


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) exact counts that add up to ``quotas``.

    Each node draws its left half's share of every source without replacement
    (multivariate hypergeometric), sized in proportion to the shards below it, so all
    shards are equally large (within one block) and mixed as a shuffle would mix them.
    """
    out = np.zeros((shards, len(quotas)), "i8")

    def down(q: np.ndarray, a: int, z: int) -> None:
        if z - a == 1:
            out[a] = q
            return
        mid = (a + z) // 2
        size = int(q.sum()) * (mid - a) // (z - a)
        left, rest, want = np.zeros_like(q), int(q.sum()), size
        for i, n in enumerate(q.tolist()):  # the multivariate draw as successive univariate ones
            rest -= n
            left[i] = hypergeometric(n, rest, want, rng)
            want -= int(left[i])
        down(left, a, mid)
        down(q - left, mid, z)

    down(quotas.astype("i8"), 0, shards)
    return out


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Marked ones among ``draws`` without replacement, for every size."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return min(good, draws)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # beyond the generator's range: inversion of the distribution, summed where a double holds it at all
    n, p = good + bad, draws / (good + bad)
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    spread = int(40 * math.sqrt(max(1.0, good * p * (1 - p) * bad / (n - 1)))) + 40
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype="i8")
    step = np.log((good - k[:-1]).astype("f8")) + np.log((draws - k[:-1]).astype("f8")) - np.log(k[1:].astype("f8")) - np.log((bad - draws + k[1:]).astype("f8"))
    log = np.concatenate([[0.0], np.cumsum(step)])
    total = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(total, rng.random() * total[-1], side="right")])


def largest_total(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every listed source that has tokens still gets its share."""
    fits = [tokens[s] * cap / share for s, (share, cap) in targets.items() if tokens.get(s) and share > 0]
    return int(min(fits, default=0))


#: Halves of a block number and rounds of the keyed permutation of blocks.
HALF_BITS, ROUNDS = 5, 6


def place_of(block: int, source: str, turn: int, seed: int) -> int:
    """Where a source's block stands in its order of pass ``turn``: a keyed (Feistel) permutation of 0..BLOCKS-1."""
    left, right = block >> HALF_BITS, block & (1 << HALF_BITS) - 1
    for r in range(ROUNDS):
        mixed = int(hashlib.md5(f"{seed}|{source}|{turn}|{r}|{right}".encode()).hexdigest()[:8], 16)
        left, right = right, left ^ mixed & (1 << HALF_BITS) - 1
    return left << HALF_BITS | right


def with_place(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (block, source, copy) with ``place_of`` as ``_place``; a column a round, so that none is computed twice."""
    mask = (1 << HALF_BITS) - 1
    out = rows.withColumn("_left", F.shiftright(F.col("block").cast("int"), HALF_BITS)).withColumn("_right", F.col("block").cast("int").bitwiseAND(F.lit(mask)))
    for r in range(ROUNDS):
        text = F.concat_ws("|", F.lit(str(seed)), "source", F.col("copy").cast("string"), F.lit(str(r)), F.col("_right").cast("string"))
        mixed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(mask).cast("long")).cast("int")
        out = out.withColumn("_mixed", mixed).withColumns({"_left": F.col("_right"), "_right": F.col("_left").bitwiseXOR(F.col("_mixed"))})
    return out.withColumn("_place", F.shiftleft("_left", HALF_BITS).bitwiseOR(F.col("_right"))).drop("_left", "_right", "_mixed")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int = 16, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    draws: (shard, position, source, doc_id, copy, n_tokens), one row for every time a
    document is taken; ``copy`` counts from 0 and stays below the source's max_repeats;
    positions shuffle a shard. shares: per listed source its target and actual share,
    tokens and the most repeats used.

    Sizes are tokens of the public vocabulary. Without ``total_tokens`` the total is the
    largest at which every source with tokens keeps its share; above it, sources run into
    max_repeats and their actual share falls short. Each source is cut into at most BLOCKS
    blocks by document hash; its quota is a number of passes over its permuted blocks, the
    last block cut at a document (every pass of every source has its own order), so a share is off by at most a document's length. Shards get
    disjoint runs of the permuted blocks, sized by the splitting tree.
    Null or unlisted sources, null and empty texts aren't drawn; listed sources without
    documents come out with share 0; of repeated targets the largest share counts.
    """
    spark = documents.sparkSession
    listed = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    listed = listed.groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m"))
    rows = listed.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    scale = sum(r["s"] for r in rows) or 1.0
    goal = {r["source"]: (r["s"] / scale, int(r["m"])) for r in rows}
    names = list(goal)

    docs = documents.select("doc_id", source_key("source").alias("source"), "text").where(F.col("source").isin(names) & (F.length("text") > 0))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int")
    docs = materialize(token_counts(docs).withColumn("block", block), "sized")
    sizes: dict[str, np.ndarray] = {s: np.zeros(BLOCKS, "i8") for s in names}
    summed = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).toArrow()  # sources x BLOCKS rows at most
    for source, number, n in zip(*(summed.column(x).to_pylist() for x in ("source", "block", "n"))):
        sizes[source][number] = n

    plan, per = plan_draws(sizes, goal, total_tokens, shards, seed)
    lookup = lambda m, kind: F.element_at(F.create_map(*[F.lit(x).cast(kind) if i % 2 else F.lit(x) for p in m.items() for i, x in enumerate(p)]), F.col("source")) if m else F.lit(None).cast(kind)
    starts = F.element_at(F.create_map(*[x for s, v in plan.starts.items() for x in (F.lit(s), F.array(*[F.lit(n).cast("long") for n in v]))]), F.col("source")) if plan.starts else F.array().cast("array<bigint>")
    d = docs.withColumn("_whole", F.coalesce(lookup(plan.whole, "long"), F.lit(0))).withColumn("_part", F.coalesce(lookup(plan.partial, "long"), F.lit(0)))
    # a document has a turn in each pass; in the last one its block's place decides, and one block is cut
    turns = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_whole") / BLOCKS))))
    # written, or a filter on the place would be pushed below and work it out again
    turns = materialize(with_place(turns, seed).withColumn("_g", F.col("copy") * BLOCKS + F.col("_place")).drop("_place"), "turns")
    whole = turns.where("_g < _whole")
    # the cut block: documents in hash order until the quota's rest is met as nearly as can be; sums of
    # hash ranges come first, so no task orders a whole block
    cut = materialize(turns.where("_g = _whole AND _part > 0").withColumn("_h", F.xxhash64("doc_id", F.lit(seed + 1))).withColumn("_r", F.shiftright("_h", 53)), "cut")
    ranges = cut.groupBy("source", "_r").agg(F.sum("n_tokens").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("source", "_r", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "_r").orderBy("_h", "doc_id"))
    cut = cut.withColumn("_in", inside).join(ranges, ["source", "_r"]).where(F.col("_ahead") + F.col("_in") - F.col("n_tokens") / 2 <= F.col("_part")).select(whole.columns)
    draws = whole.unionByName(cut)
    draws = draws.withColumn("shard", F.size(F.filter(starts, lambda s: s <= F.col("_g"))) - 1)
    draws = draws.select("shard", F.xxhash64("doc_id", "copy", F.lit(seed + 2)).alias("_o"), "source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens")
    # shuffled inside a shard: a random bucket first, so that no task sorts a whole shard
    draws = materialize(draws.withColumn("_b", F.shiftrightunsigned("_o", 54).cast("int")), "draws")
    counts = draws.groupBy("shard", "_b").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_o", "doc_id", "copy"))
    mixed = draws.withColumn("_i", inside).join(before, ["shard", "_b"]).select("shard", (F.col("_before") + F.col("_i") - 1).alias("position"), "source", "doc_id", "copy", "n_tokens")

    got = draws.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_draws"), (F.max("copy") + 1).alias("repeats"))
    goals = spark.createDataFrame([(s, float(t), m, int(sizes[s].sum())) for s, (t, m) in goal.items()], "source string, target_share double, max_repeats int, source_tokens long")
    everything = Window.partitionBy(F.lit(1))
    shares = goals.join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.sum("n_tokens").over(everything), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats", "source_tokens",
    )
    return mixed, shares


def plan_draws(sizes: dict[str, np.ndarray], goal: dict[str, tuple[float, int]], total: int | None, shards: int, seed: int) -> tuple[Plan, np.ndarray]:
    """Exact quotas in blocks from the block sizes, and their split among the shards."""
    tokens = {s: int(v.sum()) for s, v in sizes.items()}
    total = largest_total(tokens, goal) if total is None else total
    whole, partial = {}, {}
    for s, (share, cap) in goal.items():
        quota = min(int(round(share * total)), tokens[s] * cap)
        passes, rest = divmod(quota, tokens[s]) if tokens[s] else (0, 0)
        at = np.argsort([place_of(b, s, passes, seed) for b in range(BLOCKS)])
        reach = np.cumsum(sizes[s][at])
        k = int(np.searchsorted(reach, rest, side="right")) if rest else 0
        whole[s] = passes * BLOCKS + k
        partial[s] = rest - (int(reach[k - 1]) if k else 0)
    quotas = np.array([whole[s] + (partial[s] > 0) for s in goal], "i8")
    per = split_tree(quotas, shards, np.random.default_rng(seed))
    starts = {s: np.concatenate([[0], np.cumsum(per[:-1, i])]).tolist() for i, s in enumerate(goal)}
    return Plan(total, whole, partial, starts), per
