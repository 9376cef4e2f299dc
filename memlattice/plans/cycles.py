"""Composed cycles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions.keys import current_rows
from memlattice.operators import graph, orchestration
from memlattice.plans.data_problems import key
from memlattice.plans.vectors import _attractors, _states
from memlattice.sources.tables import read


def evolution_cycle(spark, d):
    """O5 in part (no interference, no learning), P10, R4, F13: one cycle; label attractors of even label are stale."""
    a = _attractors(spark, d).withColumn("updated_at", F.when(F.col("id").cast("int") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2025-01-01").cast("timestamp")))
    a = a.withColumn("strength", F.when(F.col("id") == "4", 0.104).otherwise(F.col("strength")))
    e = graph.clean_edges(read(spark, d, "synapses"))
    return orchestration.evolution(a, _states(spark, d), e, F.lit("2025-01-01").cast("timestamp"), 60.0)[1]


def interaction_learning(spark, d):
    """L5, O2 in part: documents as interactions (first half of the text the input): processes with their success."""
    t = read(spark, d, "documents").where("text IS NOT NULL")
    half = F.floor(F.length("text") / 2).cast("int")
    i = t.select(F.col("doc_id").alias("id"), F.substring("text", F.lit(1), half).alias("input"), F.substring("text", half + 1, F.length("text")).alias("output"), (F.col("doc_id") % 3 > 0).alias("success"), F.col("n_chars").cast("double").alias("duration"))
    out = orchestration.interactions_learned(i)
    return out["processes"].join(out["stats"], "process_id").select("process_id", "task_type", F.array_join("steps", ">").alias("steps"), "executions", F.round("success_rate", 6).alias("success_rate"))


def index_compaction(spark, d):
    """Deleted records as tombstones of the current ones."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["deleted_at"])
    return orchestration.compaction_due(n.select("id"), n.where("deleted_at IS NOT NULL").select("id"), 10)


def live_index(spark, d):
    """Current records that aren't tombstones."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["deleted_at"])
    return orchestration.live_index(n.select("id"), n.where("deleted_at IS NOT NULL").select("id"))


def reinforced_paths(spark, d):
    """O3: edges on two-step paths that start at CAUSAL edges, strengthened."""
    e = graph.clean_edges(read(spark, d, "synapses"))
    a = e.where("edge_type = 'CAUSAL'").select(F.col("source_id").alias("x"), F.col("target_id").alias("y"))
    p = a.join(e.select(F.col("source_id").alias("y"), F.col("target_id").alias("z")), "y").select(F.array("x", "y", "z").alias("nodes"))
    return orchestration.path_reinforced(e, p).select("id", "source_id", "target_id", F.round("weight", 6).alias("weight"))


def goal_vectors(spark, d):
    """Parts as goals."""
    g = read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), (F.col("p_size") % 10 + 1).alias("priority")).dropDuplicates(["name"])
    return orchestration.goal_records(g).select("id", "name", "strength", "priority")


QUERIES = {f.__name__: f for f in (evolution_cycle, interaction_learning, index_compaction, live_index, reinforced_paths, goal_vectors)}

_N = f"WITH n AS (SELECT DISTINCT {key('id')} AS id, deleted_at FROM neurons QUALIFY updated_at = max(updated_at) OVER (PARTITION BY {key('id')}))"
_E = f"""WITH e AS (SELECT DISTINCT {key('id')} AS id, {key('source_id')} AS source_id, {key('target_id')} AS target_id, upper(trim(edge_type)) AS edge_type, weight, coalesce(activation_count, 0) AS activation_count
  FROM synapses WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND weight IS NOT NULL)"""

SQL = {
    "evolution_cycle": _E
    + """, a AS (SELECT DISTINCT label, CASE WHEN label = 4 THEN 0.104::DOUBLE ELSE 0.3 + label * 0.05::DOUBLE END AS s FROM embeddings)
      SELECT (SELECT count(*) FILTER (s > 0.1) - count(*) FILTER (CASE WHEN label % 2 = 0 THEN s * 0.95 ELSE s END > 0.1) FROM a) AS attractors_decayed,
             (SELECT count(DISTINCT vec_id // 10) FROM embeddings) AS owners_evolved, (SELECT count(*) FROM e WHERE abs(weight) < 0.05 AND activation_count < 2) AS edges_pruned""",
    "index_compaction": _N + " SELECT count(*) FILTER (deleted_at IS NULL) AS live, count(deleted_at) AS dead, count(deleted_at) >= 10 AS due FROM n",
    "live_index": _N + " SELECT id FROM n WHERE deleted_at IS NULL",
    "reinforced_paths": _E
    + """, p AS (SELECT a.source_id AS x, a.target_id AS y, b.target_id AS z FROM e a JOIN e b ON b.source_id = a.target_id WHERE a.edge_type = 'CAUSAL'),
      q AS (SELECT x AS s, y AS t FROM p UNION SELECT y, z FROM p)
      SELECT id, source_id, target_id, round(least(1, weight + 0.1::DOUBLE), 6) AS weight FROM e WHERE (source_id, target_id) IN (SELECT (s, t) FROM q)""",
}
