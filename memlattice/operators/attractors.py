"""Goal vectors: influence, transition probabilities, decay and goal-directed paths."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import vectors as V

#: Field radius, decay per day, most attractors.
RADIUS, DAILY_DECAY, MOST = 0.7, 0.95, 100


def capped(attractors: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` attractors of largest strength · priority · (1 + activations / 100)."""
    value = F.col("strength") * F.col("priority") * (1 + F.col("activations") / 100)
    return attractors.orderBy(value.desc(), "id").limit(most)


def influences(records: DataFrame, key: str, vector: str, attractors: DataFrame) -> DataFrame:
    """(key, attractor, similarity, influence) of every record under every attractor.

    influence = strength · exp(-(1 - cosine) / 0.7) · priority / 10. Attractors are capped
    at MOST rows, so their side of the product is bounded; they travel in one row.
    """
    a = capped(attractors).agg(F.sort_array(F.collect_list(F.struct("id", "strength", "priority", V.doubles("embedding").alias("e")))).alias("_a"))
    rows = records.select(key, V.doubles(vector).alias("_v")).join(a).select(key, "_v", F.explode("_a").alias("x"))
    s = V.cosine(F.col("_v"), F.col("x.e"))
    rows = rows.select(key, F.col("x.id").alias("attractor"), s.alias("similarity"), F.col("x.strength").alias("_s"), F.col("x.priority").alias("_p"))
    return rows.select(key, "attractor", "similarity", (F.col("_s") * F.exp(-(1 - F.col("similarity")) / RADIUS) * F.col("_p") / 10).alias("influence"))


def probability_field(records: DataFrame, key: str, vector: str, attractors: DataFrame, least: float = 0.05) -> DataFrame:
    """(attractor, key, gradient): the records that each attractor reaches, cosine · strength above ``least``."""
    near = influences(records, key, vector, attractors).join(F.broadcast(capped(attractors).select(F.col("id").alias("attractor"), "strength")), "attractor")
    return near.withColumn("gradient", F.col("similarity") * F.col("strength")).where(F.col("gradient") > least).select("attractor", key, "gradient")


def field_paths(transitions: DataFrame, least: float = 0.1) -> DataFrame:
    """(attractor, path, probability, steps) of recorded transitions (source, target, attractor, influence) above ``least``."""
    return transitions.where(F.col("influence") > least).select("attractor", F.array("source", "target").alias("path"), F.col("influence").alias("probability"), F.lit(1).alias("steps"))


def dominant(found: DataFrame, key: str) -> DataFrame:
    """(key, attractor, influence): the largest positive influence, ties by attractor."""
    best = F.max(F.struct("influence", F.col("attractor")))
    tie = found.where("influence > 0").groupBy(key).agg(best.alias("b"))
    first = found.join(tie.select(key, F.col("b.influence").alias("_top")), key).where("influence = _top")
    return first.groupBy(key).agg(F.min("attractor").alias("attractor"), F.max("influence").alias("influence"))


def transitions(current: DataFrame, candidates: DataFrame, key: str, vector: str, attractors: DataFrame) -> DataFrame:
    """(source, target, probability) for pairs (source, source_vec, target, target_vec).

    0.4 · cosine + 0.6 · (0.5 + 0.5 · tanh(change of the summed influence)), between 0 and 1,
    normalised per source. ``current`` (key, vector) has a row per source; ``candidates``
    (source, key, vector) the reachable targets.
    """
    total = lambda d: influences(d, "_k", "_v", attractors).groupBy("_k").agg(F.sum("influence").alias("_i"))
    cur = current.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    cand = candidates.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).dropDuplicates(["_k"])
    a = cur.join(total(cur), "_k", "left").select(F.col("_k").alias("source"), F.col("_v").alias("_sv"), F.coalesce("_i", F.lit(0.0)).alias("_si"))
    b = cand.join(total(cand), "_k", "left").select(F.col("_k").alias("target"), F.col("_v").alias("_tv"), F.coalesce("_i", F.lit(0.0)).alias("_ti"))
    j = candidates.select("source", F.col(key).alias("target")).join(a, "source").join(b, "target")
    raw = 0.4 * V.cosine("_sv", "_tv") + 0.6 * (0.5 + 0.5 * F.tanh(F.col("_ti") - F.col("_si")))
    j = j.select("source", "target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("_p"))
    sum_ = F.sum("_p").over(Window.partitionBy("source"))
    return j.select("source", "target", F.when(sum_ > 0, F.col("_p") / sum_).otherwise(0.0).alias("probability"))


def reprobable(attractors: DataFrame, current: list[float]) -> DataFrame:
    """Attractors with probability 0.8 · p + 0.2 · cosine to the current vector, between 0 and 1."""
    c = V.cosine("embedding", F.array(*[F.lit(float(x)) for x in current]))
    return attractors.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 * F.col("probability") + 0.2 * c)))


def decayed(attractors: DataFrame, now) -> DataFrame:
    """After 24 hours without update strength falls to 95 %; under 0.01 with fewer than 5 activations it goes."""
    stale = F.col("updated_at") < now - F.expr("INTERVAL 24 HOURS")
    s = F.when(stale, F.col("strength") * DAILY_DECAY).otherwise(F.col("strength"))
    return attractors.withColumn("strength", s).where(~(stale & (F.col("strength") < 0.01) & (F.col("activations") < 5)))


def active(attractors: DataFrame) -> DataFrame:
    """Those stronger than 0.1, by priority · strength."""
    return attractors.where("strength > 0.1").orderBy((F.col("priority") * F.col("strength")).desc(), "id")


def recorded(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, attractor, change, activated): influence deltas of a transition; positive ones activate."""
    a = before.select(key, "attractor", F.col("influence").alias("_a"))
    b = after.select(key, "attractor", F.col("influence").alias("_b"))
    d = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return a.join(b, [key, "attractor"], "full").select(key, "attractor", d.alias("change"), (d > 0).alias("activated"))


def path_costs(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, total_cost, avg_cost, n_steps) of paths (path_id, nodes): 1 - w an edge, 0.5 where there is none."""
    steps = paths.select("path_id", F.posexplode(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(1)))).alias("i", "source_id"), "nodes")
    steps = steps.where("size(nodes) > 1").select("path_id", "source_id", F.element_at("nodes", F.col("i") + 2).alias("target_id"))
    e = edges.groupBy("source_id", "target_id").agg(F.max("weight").alias("w"))
    cost = F.when(F.col("w").isNull(), 0.5).otherwise(1 - F.col("w"))
    return steps.join(e, ["source_id", "target_id"], "left").groupBy("path_id").agg(F.sum(cost).alias("total_cost"), F.avg(cost).alias("avg_cost"), F.count("*").alias("n_steps"))


def attractor_stats(attractors: DataFrame) -> DataFrame:
    return attractors.agg(F.count("*").alias("n"), F.avg("strength").alias("avg_strength"), F.avg("activations").alias("avg_activations"), F.count_if(F.col("strength") > 0.1).alias("n_active"))


def _cosines(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(g)
    return np.divide(x @ g, n, out=np.zeros(len(x)), where=n > 0)


def search_path(out: dict, near: dict, start: str, most: int = 1000, close: float = 0.9, used: set | None = None, goals: set | None = None) -> tuple[list[str], float, float] | None:
    """(nodes, cost, probability) by A*: an edge costs max(0.01, 1 - w - half the progress to the goal).

    ``near``: similarity of each node to the goal. The estimate is 1 - similarity; a goal
    is a node above ``close``; at most ``most`` expansions; ``used`` edges cost 2 more.
    """
    if used is None and goals is None and 1 - near.get(start, 0.0) < 0.1:
        return [start], 0.0, 1.0
    best, parent, heap, done = {start: 0.0}, {start: None}, [(0.0, start)], set()
    while heap and len(done) < most:
        _, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if (node in goals) if goals is not None else near.get(node, 0.0) > close:
            path, p = [], node
            while p is not None:
                path.append(p)
                p = parent[p]
            path.reverse()
            costs = [best[b] - best[a] for a, b in zip(path, path[1:])]
            return path, best[node], float(np.prod([max(0.0, 1 - c) for c in costs]))
        for target, w in out.get(node, ()):
            progress = near.get(target, 0.0) - near.get(node, 0.0)
            cost = max(0.01, 1 - w - 0.5 * max(0.0, progress)) + (2.0 if used and (node, target) in used else 0.0)
            if best[node] + cost < best.get(target, float("inf")):
                best[target], parent[target] = best[node] + cost, node
                heapq.heappush(heap, (best[target] + min(1.0, max(0.0, 1 - near.get(target, 0.0))), target))
    return None


def meeting_path(out: dict, near: dict, start: str, depth: int = 4) -> tuple[list[str], float, float] | None:
    """Anchors above 0.85 similarity walked backwards ``depth`` hops; forward A* until it meets them."""
    back: dict[str, list] = {}
    for a, targets in out.items():
        for b, w in targets:
            back.setdefault(b, []).append((a, w))
    onward = {n: None for n, s in near.items() if s > 0.85}
    front = list(onward)
    for _ in range(max(2, depth // 2)):
        fresh = []
        for n in front:
            for a, _w in back.get(n, ()):
                if a not in onward:
                    onward[a] = n
                    fresh.append(a)
        front = fresh
    found = search_path(out, near, start, goals=set(onward))
    if not found:
        return None
    path, cost, p = found
    node = onward[path[-1]]
    while node is not None:
        path.append(node)
        p *= 0.5
        node = onward[node]
    return path, cost, p


def goal_paths(edges: DataFrame, starts: DataFrame, vectors: DataFrame, goal: list[float], depth: int = 5, alternatives: int = 1, both_ways: bool = False) -> DataFrame:
    """(start, rank, path, cost, probability, bottlenecks) from each start to the goal vector.

    The edges within ``depth`` hops of a start are searched in one task per start (raises
    beyond graph.BOUND edges). Alternatives rerun with 2 more on edges already used.
    Bottlenecks are steps that cost over 1.5 times the mean. Starts without a path have no row.
    """
    from memlattice.operators.graph import BOUND, neighbourhood

    n = neighbourhood(edges, starts, depth)
    v = vectors.select(F.col("id").alias("_id"), V.cosine("vec", F.array(*[F.lit(float(x)) for x in goal])).alias("_s"))
    n = n.join(v.select(F.col("_id").alias("source_id"), F.col("_s").alias("ss")), "source_id", "left").join(v.select(F.col("_id").alias("target_id"), F.col("_s").alias("ts")), "target_id", "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > BOUND:
            raise ValueError(f"{key[0]}: more than {BOUND} edges within the depth")
        pdf = pdf.sort_values(["source_id", "target_id"])
        near = {**dict(zip(pdf.source_id, pdf.ss.fillna(0))), **dict(zip(pdf.target_id, pdf.ts.fillna(0)))}
        out: dict[str, list] = {}
        for a, b, w in zip(pdf.source_id, pdf.target_id, pdf.weight):
            out.setdefault(a, []).append((b, float(w)))
        rows, used = [], set()
        for r in range(alternatives):
            found = meeting_path(out, near, key[0], depth) if both_ways else search_path(out, near, key[0], used=used if r else None)
            if not found or any(found[0] == x[2] for x in rows):
                break
            path, cost, p = found
            steps = [max(0.01, 1 - dict(out.get(a, ())).get(b, 0.5)) for a, b in zip(path, path[1:])]
            mean = sum(steps) / len(steps) if steps else 0
            rows.append((key[0], r + 1, path, cost, p, [f"{a}>{b}" for (a, b), c in sorted(zip(zip(path, path[1:]), steps), key=lambda x: -x[1]) if c > 1.5 * mean]))
            used |= set(zip(path, path[1:]))
        return pd.DataFrame(rows, columns=["start", "rank", "path", "cost", "probability", "bottlenecks"])

    return n.groupBy("start").applyInPandas(run, "start string, rank int, path array<string>, cost double, probability double, bottlenecks array<string>")
