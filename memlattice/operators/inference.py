"""Forward and backward inference, causal chains and hypotheses over the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.operators.graph import shortest_path

DECAY = 0.85


def _first(edges: DataFrame, end: str, other: str) -> DataFrame:
    """Per pair the first edge, by created_at and id."""
    w = Window.partitionBy(end, other).orderBy(F.asc_nulls_last("created_at"), "id")
    return edges.where(F.col(end) != F.col(other)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _hinted(confidence: Column, vector: Column | None, hint: list[float] | None) -> Column:
    if hint is None or vector is None:
        return confidence
    return confidence * (0.5 + 0.5 * V.cosine(vector, F.array(*[F.lit(float(x)) for x in hint])))


def forward(edges: DataFrame, vectors: DataFrame | None = None, hint: list[float] | None = None, least: float = 0.3) -> DataFrame:
    """(id, inferred, edge_type, confidence): each record's outgoing links, CAUSAL ones times 1.2.

    Below ``least`` they drop out; then confidence is at most 1. With ``hint``, half of
    it depends on the target's (id, vec) similarity.
    """
    e = _first(edges, "source_id", "target_id")
    c = F.col("weight") * F.when(F.col("edge_type") == "CAUSAL", 1.2).otherwise(1.0)
    if hint is not None and vectors is not None:
        e = e.join(vectors.select(F.col("id").alias("target_id"), "vec"), "target_id")
        c = _hinted(c, F.col("vec"), hint)
    return e.withColumn("_c", c).where(F.col("_c") >= least).select(F.col("source_id").alias("id"), F.col("target_id").alias("inferred"), "edge_type", F.least(F.lit(1.0), "_c").alias("confidence"))


def backward(edges: DataFrame, vectors: DataFrame | None = None, hint: list[float] | None = None, least: float = 0.3) -> DataFrame:
    """(id, inferred, edge_type, confidence): what may have led to each record, w · 0.8, CAUSAL times 1.3, TEMPORAL 1.1."""
    e = _first(edges, "target_id", "source_id")
    c = F.col("weight") * 0.8 * F.when(F.col("edge_type") == "CAUSAL", 1.3).when(F.col("edge_type") == "TEMPORAL", 1.1).otherwise(1.0)
    if hint is not None and vectors is not None:
        e = e.join(vectors.select(F.col("id").alias("source_id"), "vec"), "source_id")
        c = _hinted(c, F.col("vec"), hint)
    return e.withColumn("_c", c).where(F.col("_c") >= least).select(F.col("target_id").alias("id"), F.col("source_id").alias("inferred"), "edge_type", F.least(F.lit(1.0), "_c").alias("confidence"))


def infer(edges: DataFrame, direction: str = "bidirectional", **kw) -> DataFrame:
    """forward, backward or both, with ``direction``."""
    parts = [f(edges, **kw).withColumn("direction", F.lit(n)) for n, f in (("forward", forward), ("backward", backward)) if direction in (n, "bidirectional")]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def two_hop(edges: DataFrame, factor: float = DECAY, least: float = 0.3) -> DataFrame:
    """(id, via, inferred, confidence): a -> b -> c with w1 · w2 · factor, where a has no edge to c; the best b each.

    ``factor`` 0.85 forwards; backwards 0.765.
    """
    e = _first(edges, "source_id", "target_id").where("weight > 0").select("source_id", "target_id", "weight")
    a = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("via"), F.col("weight").alias("w1"))
    b = e.select(F.col("source_id").alias("via"), F.col("target_id").alias("inferred"), F.col("weight").alias("w2"))
    both = a.join(b, "via").where("id <> inferred").withColumn("c", F.col("w1") * F.col("w2") * factor).where(F.col("c") >= least)
    fresh = both.join(e.select(F.col("source_id").alias("id"), F.col("target_id").alias("inferred")), ["id", "inferred"], "left_anti")
    best = fresh.groupBy("id", "inferred").agg(F.max(F.struct("c", "via")).alias("b"))
    return best.select("id", "b.via", "inferred", F.col("b.c").alias("confidence"))


def causal_chain(edges: DataFrame, a: str, b: str, depth: int = 5) -> DataFrame:
    """(step, node): fewest links from ``a`` to ``b``, edges taken in either direction."""
    both = edges.select("source_id", "target_id", "weight").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    return shortest_path(both, a, b, depth)


def causal_strengths(observations: DataFrame) -> DataFrame:
    """(cause, effect, strength, n): each observation (cause, effect, at, strength) halves the way to its value.

    The fold s = (s + x) / 2 in order is a weighted sum, so no order is replayed:
    the last observation weighs 1/2, the one before 1/4, and so on; the first one doubled.
    """
    w = Window.partitionBy("cause", "effect")
    k = F.row_number().over(w.orderBy(F.desc("at"), F.desc("strength")))
    n = F.count("*").over(w)
    weight = F.pow(F.lit(0.5), F.least(F.col("_k"), F.col("_n") - 1))
    return observations.withColumn("_k", k).withColumn("_n", n).groupBy("cause", "effect").agg(F.sum(F.col("strength") * weight).alias("strength"), F.count("*").alias("n"))


def validated(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hypotheses (hypothesis_id, plausibility) weighed by evidence (hypothesis_id, supports, weight).

    support / (support + contradiction) · plausibility; unchanged without evidence.
    """
    s = evidence.groupBy("hypothesis_id").agg(F.sum(F.when(F.col("supports"), F.col("weight")).otherwise(0.0)).alias("_s"), F.sum("weight").alias("_t"))
    return hypotheses.join(s, "hypothesis_id", "left").withColumn("plausibility", F.when(F.coalesce("_t", F.lit(0.0)) == 0, F.col("plausibility")).otherwise(F.col("_s") / F.col("_t") * F.col("plausibility"))).drop("_s", "_t")


def inference_stats(strengths: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row: causal relations and their mean strength, cached hypotheses."""
    return strengths.agg(F.count("*").alias("causal_relations"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("average_strength")).join(hypotheses.agg(F.count("*").alias("cached_hypotheses")))


def recommendations(found: DataFrame, k: int = 5, steps: DataFrame | None = None) -> DataFrame:
    """(id, inferred, kind, score, rank): of each record the forward top 3 and backward top 2 above 0.5 (times 0.9),
    and of ``steps`` (id, step) the next one on its path to a goal (0.8), best first."""
    w = Window.partitionBy("id", "direction").orderBy(F.desc("confidence"), "inferred")
    top = found.where("confidence > 0.5").withColumn("_r", F.row_number().over(w)).where("(direction = 'forward' AND _r <= 3) OR (direction = 'backward' AND _r <= 2)")
    top = top.withColumn("score", F.when(F.col("direction") == "forward", F.col("confidence")).otherwise(F.col("confidence") * 0.9))
    top = top.select("id", "inferred", F.col("direction").alias("kind"), "score")
    if steps is not None:
        top = top.unionByName(steps.select("id", F.col("step").alias("inferred"), F.lit("goal").alias("kind"), F.lit(0.8).alias("score")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "inferred", "kind"))
    return top.withColumn("rank", rank).where(F.col("rank") <= k)
