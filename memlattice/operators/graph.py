"""Traversals, paths, plasticity and statistics of a directed weighted edge table.

Edges: (id, source_id, target_id, edge_type, weight, activation_count, bidirectional, created_at).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.components import connected_components
from memlattice.session import materialize

#: Edges that an ordered traversal may gather in one task (about 1 GB); more raise an error instead of being cut.
BOUND = 5_000_000


def clean_edges(synapses: DataFrame) -> DataFrame:
    """Edges with tidied ends and upper-case types, repeated rows once, without null ends or weights."""
    from memlattice.functions.keys import tidy

    e = synapses.select(
        tidy("id").alias("id"), tidy("source_id").alias("source_id"), tidy("target_id").alias("target_id"),
        F.upper(F.trim("edge_type")).alias("edge_type"), "weight", F.coalesce("activation_count", F.lit(0)).alias("activation_count"),
        F.coalesce("bidirectional", F.lit(False)).alias("bidirectional"), "created_at",
    )
    return e.where("source_id IS NOT NULL AND target_id IS NOT NULL AND weight IS NOT NULL").dropDuplicates(["id", "source_id", "target_id", "edge_type"])


def bfs(edges: DataFrame, starts: DataFrame, depth: int, where=None) -> DataFrame:
    """(start, node, hops, parent, total_weight) of breadth-first trees from each ``starts`` (start).

    Level by level: one join with the edges, an anti-join with what was visited, and of
    several parents the one with the best total weight, ties by id; each level is written
    once. ``where`` filters edges.
    """
    e = edges if where is None else edges.where(where)
    e = materialize(e.select("source_id", "target_id", "weight"), "edges")
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("total_weight")).distinct()
    seen = front
    for h in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("source_id"), "total_weight").join(e, "source_id")
        best = F.max(F.struct((F.col("total_weight") + F.col("weight")).alias("w"), F.col("source_id").alias("p")))
        nxt = step.groupBy("start", F.col("target_id").alias("node")).agg(best.alias("b")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = materialize(nxt.select("start", "node", F.lit(h).alias("hops"), F.col("b.p").alias("parent"), F.col("b.w").alias("total_weight")), "front")
        seen = seen.unionByName(front)
        if front.limit(1).count() == 0:
            break
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 10) -> DataFrame:
    """(step, node) of a path of fewest hops; no rows if there is none within ``depth``."""
    spark = edges.sparkSession
    tree = materialize(bfs(edges, spark.createDataFrame([(source,)], "start string"), depth), "tree")
    path, node = [], target
    for _ in range(depth + 1):
        row = tree.where(F.col("node") == node).select("hops", "parent").first()
        if row is None:
            return spark.createDataFrame([], "step int, node string")
        path.append((row["hops"], node))
        if row["parent"] is None:
            break
        node = row["parent"]
    return spark.createDataFrame(sorted(path), "step int, node string")


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, source_id, target_id, edge_type, weight): the edges within ``depth`` hops of each start."""
    near = bfs(edges, starts, depth).where(F.col("hops") <= depth).select("start", F.col("node").alias("source_id"))
    return near.join(edges.select("source_id", "target_id", "edge_type", "weight"), "source_id").select("start", "source_id", "target_id", "edge_type", "weight")


def ordered_paths(edges: DataFrame, starts: DataFrame, depth: int, walk: Callable[[dict, str, int], list[tuple[list[str], float]]]) -> DataFrame:
    """(start, path, total_weight) of an order-dependent traversal of each start's bounded neighbourhood.

    The neighbourhood is what ``depth`` hops reach; it is walked in one task per start.
    One with more than BOUND edges raises an error.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > BOUND:
            raise ValueError(f"{key[0]}: more than {BOUND} edges within the depth")
        out: dict[str, list] = {}
        ordered = pdf.sort_values(["source_id", "weight", "target_id"], ascending=[True, False, True])
        for s, t, w in zip(ordered.source_id, ordered.target_id, ordered.weight):
            out.setdefault(s, []).append((t, float(w)))
        rows = walk(out, key[0], depth)
        return pd.DataFrame({"start": pd.Series([key[0]] * len(rows), dtype=object), "path": pd.Series([p for p, _ in rows], dtype=object), "total_weight": pd.Series([w for _, w in rows], dtype="f8")})

    near = neighbourhood(edges, starts, depth)
    return near.groupBy("start").applyInPandas(run, "start string, path array<string>, total_weight double")


def depth_first(out: dict, start: str, depth: int) -> list[tuple[list[str], float]]:
    """Pre-order with one visited set; heavier edges first; a path comes out at a dead end or below ``depth``."""
    seen, rows, stack = {start}, [], [([start], 0.0)]
    while stack:
        path, w = stack.pop()
        fresh = [(t, x) for t, x in out.get(path[-1], ()) if t not in seen] if len(path) <= depth else []
        if not fresh:
            if len(path) > 1:
                rows.append((path, w))
            continue
        for t, x in reversed(fresh):
            seen.add(t)
            stack.append(([*path, t], w + x))
    return rows


def best_first(out: dict, start: str, depth: int) -> list[tuple[list[str], float]]:
    """The node of the largest cumulative weight next, from a heap."""
    seen, rows, heap = set(), [], [(0.0, start, (start,))]
    while heap:
        w, node, path = heapq.heappop(heap)
        if node in seen:
            continue
        seen.add(node)
        fresh = [(t, x) for t, x in out.get(node, ()) if t not in seen] if len(path) <= depth else []
        if not fresh and len(path) > 1:
            rows.append((list(path), -w))
        for t, x in fresh:
            heapq.heappush(heap, (w - x, t, (*path, t)))
    return rows


#: Slices of the unit range in which a record's edges are looked up by the draw.
SLICES = 256


def drawn(*parts) -> Column:
    """A number in [0, 1) that follows from ``parts``: the same in every attempt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 2.0**32


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 11) -> DataFrame:
    """(start, path, total_weight): one walk from each start, each step drawn in proportion to positive weights.

    Every record's edges (by falling weight, then target and id) get their part of the unit
    range once; a step is a join by record and slice of that range, so a walk never gathers
    a neighbourhood and walkers at a hub meet only the edges of their slice. A walk ends
    where there is no positive edge; one without a step has no row.
    """
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "id")
    e = edges.where("weight > 0").select("id", "source_id", "target_id", "weight")
    e = e.withColumn("_high", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("weight").over(Window.partitionBy("source_id")))
    e = e.withColumn("_to", F.col("_high") / F.col("_all")).withColumn("_from", (F.col("_high") - F.col("weight")) / F.col("_all"))
    slices = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_from") - 1e-9) * SLICES)), F.least(F.lit(SLICES - 1), F.floor((F.col("_to") + 1e-9) * SLICES)))
    e = materialize(e.select("source_id", "target_id", "weight", "_from", "_to", "_high", F.explode(slices).alias("_slice")), "ranges")
    front = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0.0).alias("total_weight"))
    ended = []
    for step in range(steps):
        u = front.withColumn("_u", drawn(F.lit(str(seed)), "start", F.lit(str(step)))).withColumn("_slice", F.floor(F.col("_u") * SLICES))
        found = u.join(e.withColumnRenamed("source_id", "node"), ["node", "_slice"]).where("_u >= _from - 1e-9 AND _u <= _to + 1e-9")
        # at the border of two ranges the first one whose end lies above the draw
        best = F.min_by(F.struct("target_id", "weight"), F.struct((F.col("_u") >= F.col("_to")).cast("int"), "_high", "target_id")).alias("x")
        found = found.groupBy("start").agg(best, F.first("path").alias("path"), F.first("total_weight").alias("total_weight"))
        moved = materialize(found.select("start", F.col("x.target_id").alias("node"), F.concat("path", F.array("x.target_id")).alias("path"), (F.col("total_weight") + F.col("x.weight")).alias("total_weight")), "walk")
        ended.append(front.join(moved, "start", "left_anti"))
        front = moved
    out = front
    for x in ended:
        out = out.unionByName(x)
    return out.where(F.size("path") > 1).select("start", "path", "total_weight")


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The connection of each pair (source_id, target_id): its first edge of any type, by created_at and id."""
    w = Window.partitionBy("source_id", "target_id").orderBy(F.asc_nulls_last("created_at"), "id")
    return edges.join(pairs.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def components(records: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(node, component): weakly connected components, records without edges on their own."""
    ids = records.select(F.col(key).alias("node")).distinct()
    inner = edges.join(ids, F.col("source_id") == F.col("node"), "left_semi").join(ids, F.col("target_id") == F.col("node"), "left_semi")
    found = connected_components(inner, "source_id", "target_id")
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_weight)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("node"), F.lit(1).alias("o"), F.col("weight").alias("w")), F.struct(F.col("target_id").alias("node"), F.lit(0).alias("o"), F.lit(0.0).alias("w")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum(1 - F.col("x.o")).alias("in_degree"), F.sum("x.w").alias("out_weight"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.avg("weight").alias("avg_weight"), F.sum("activation_count").alias("activations"), F.count_if("bidirectional").alias("n_bidirectional"))


def weak(min_weight: float = 0.05, min_activations: int = 2):
    """The condition of an edge that pruning removes: weak and seldom used."""
    return (F.abs("weight") < min_weight) & (F.col("activation_count") < min_activations)


def pruned(edges: DataFrame, min_weight: float = 0.05, min_activations: int = 2) -> DataFrame:
    return edges.where(~weak(min_weight, min_activations))


def prune_counts(edges: DataFrame, min_weight: float = 0.05, min_activations: int = 2) -> DataFrame:
    return edges.agg(F.count_if(weak(min_weight, min_activations)).alias("pruned"), F.count_if(~weak(min_weight, min_activations)).alias("remaining"))


def strengthened(weight="weight", by: float = 0.1):
    return F.least(F.lit(1.0), F.col(weight) + by)


def weakened(weight="weight", by: float = 0.1):
    return F.greatest(F.lit(0.0), F.col(weight) - by)


def reinforced(edges: DataFrame, active: DataFrame, eta: float = 0.05) -> DataFrame:
    """Edges between ``active`` (node) records, except inhibitory ones: w + eta (1 - w), one activation more.

    Only the edges that change come out, as deltas to be upserted.
    """
    a = active.select(F.col("node").alias("_n")).distinct()
    hit = edges.where("edge_type <> 'INHIBITORY' AND source_id <> target_id").join(a, F.col("source_id") == F.col("_n"), "left_semi").join(a, F.col("target_id") == F.col("_n"), "left_semi")
    return hit.withColumn("weight", F.least(F.lit(1.0), F.col("weight") + eta * (1 - F.col("weight")))).withColumn("activation_count", F.col("activation_count") + 1)


def inhibited(ranked: DataFrame, edges: DataFrame, winners: int = 3, eta: float = 0.03) -> DataFrame:
    """(source_id, target_id, weight): winners of a ranking (session, node, rank) inhibit the lower ranks.

    An existing inhibitory edge gains w - eta (1 - |w|), at least -1; a new one begins at -0.05.
    """
    w = ranked.where(F.col("rank") <= winners).select("session", F.col("node").alias("source_id"), F.col("rank").alias("_a"))
    loser = ranked.select("session", F.col("node").alias("target_id"), F.col("rank").alias("_b"))
    pairs = w.join(loser, "session").where("_b > _a").select("source_id", "target_id").distinct()
    have = edges.where("edge_type = 'INHIBITORY'").groupBy("source_id", "target_id").agg(F.min("weight").alias("_w"))
    j = pairs.join(have, ["source_id", "target_id"], "left")
    return j.select("source_id", "target_id", F.when(F.col("_w").isNull(), -0.05).otherwise(F.greatest(F.lit(-1.0), F.col("_w") - eta * (1 - F.abs("_w")))).alias("weight"))


def episode_edges(episodes: DataFrame, edges: DataFrame | None = None, distance: int = 2) -> DataFrame:
    """(source_id, target_id, weight) TEMPORAL edges of ordered episodes (episode, position, node).

    A record links to those one and two places on, with 0.3 / places; an existing temporal
    edge gains 0.05 (1 - w); pairs with an edge of another type are left alone.
    """
    w = Window.partitionBy("episode").orderBy("position")
    steps = episodes.select("node", F.array(*[F.struct(F.lead("node", d).over(w).alias("t"), F.lit(d).alias("d")) for d in range(1, distance + 1)]).alias("_x"))
    pairs = steps.select(F.col("node").alias("source_id"), F.explode("_x").alias("x")).where("x.t IS NOT NULL AND x.t <> source_id")
    pairs = pairs.groupBy("source_id", F.col("x.t").alias("target_id")).agg(F.min("x.d").alias("_d"))
    new = (0.3 / F.col("_d")).alias("weight")
    if edges is None:
        return pairs.select("source_id", "target_id", new)
    have = edges.groupBy("source_id", "target_id").agg(F.max(F.when(F.col("edge_type") == "TEMPORAL", F.col("weight"))).alias("_w"))
    j = pairs.join(have.withColumn("_has", F.lit(True)), ["source_id", "target_id"], "left").where("_has IS NULL OR _w IS NOT NULL")
    return j.select("source_id", "target_id", F.when(F.col("_w").isNull(), 0.3 / F.col("_d")).otherwise(F.col("_w") + 0.05 * (1 - F.col("_w"))).alias("weight"))


def peer_weights(edges: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, excitation, inhibition): the largest positive outgoing weight to a peer, and the largest
    absolute inhibitory weight from a peer; 0 without any. ``peers``: (session, node)."""
    a = peers.select("session", F.col("node").alias("source_id"))
    b = peers.select("session", F.col("node").alias("target_id"))
    e = edges.join(a, "source_id").join(b, ["session", "target_id"])
    up = e.where("edge_type <> 'INHIBITORY' AND weight > 0").groupBy("session", F.col("source_id").alias("node")).agg(F.max("weight").alias("x"))
    down = e.where("edge_type = 'INHIBITORY'").groupBy("session", F.col("target_id").alias("node")).agg(F.max(F.abs("weight")).alias("i"))
    z = F.lit(0.0)
    return peers.join(up, ["session", "node"], "left").join(down, ["session", "node"], "left").select("session", "node", F.coalesce("x", z).alias("excitation"), F.coalesce("i", z).alias("inhibition"))


def key_edges(child: DataFrame, child_key: str, foreign: str, parent: DataFrame, parent_key: str, child_name: str, parent_name: str) -> DataFrame:
    """ASSOCIATIVE edges of weight 0.8 from each child row to the parent row its foreign key names."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    c = child.select(F.col(child_key).alias("_c"), F.col(foreign).alias("_f")).distinct()
    return c.join(p, F.col("_f") == F.col("_p")).select(F.concat_ws(":", F.lit(child_name), F.col("_c").cast("string")).alias("source_id"), F.concat_ws(":", F.lit(parent_name), F.col("_p").cast("string")).alias("target_id"), F.lit("ASSOCIATIVE").alias("edge_type"), F.lit(0.8).alias("weight"))
