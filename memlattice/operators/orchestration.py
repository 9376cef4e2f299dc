"""Composed cycles: evolution, learning from interactions, index maintenance, goal records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions.embedding import simple_embedding
from memlattice.functions.hashing import content_id
from memlattice.operators import attractors as A
from memlattice.operators import graph, learning, similarity, states


def evolution(attractor_rows: DataFrame, state_rows: DataFrame, edges: DataFrame, now, seconds: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """One cycle: attractors decay, states drift, weak edges go. (tables, one-row report).

    The report counts active attractors lost, owners evolved and edges pruned.
    """
    tables = {"attractors": A.decayed(attractor_rows, now), "states": states.decayed(states.normalised(state_rows), seconds), "edges": graph.pruned(edges)}
    active = lambda d, c: d.agg(F.count_if(F.col("strength") > 0.1).alias(c))
    report = active(attractor_rows, "_a").join(active(tables["attractors"], "_b")).select((F.col("_a") - F.col("_b")).alias("attractors_decayed"))
    report = report.join(tables["states"].agg(F.countDistinct("owner_id").alias("owners_evolved"))).join(graph.prune_counts(edges).select(F.col("pruned").alias("edges_pruned")))
    return tables, report


def interactions_learned(interactions: DataFrame, least: float = 0.3) -> dict[str, DataFrame]:
    """From interactions (id, input, output, success, duration): extracts of both texts, patterns by task type,
    processes (the steps are the output's segment categories) with their success.

    Nothing is written: the tables are what a caller adds to its own.
    """
    both = interactions.select("id", F.explode(F.array(F.struct(F.lit("input").alias("side"), F.col("input").alias("t")), F.struct(F.lit("output").alias("side"), F.col("output").alias("t")))).alias("x"), T.task_type(F.coalesce("input", F.lit(""))).alias("task_type"))
    found = learning.extracts(both.select(F.struct("id", "x.side", "task_type").alias("k"), F.col("x.t").alias("t")).where("t IS NOT NULL"), "k", "t", least=least)
    found = found.select("k.*", "position", "content", "category", "importance", "keywords")
    steps = found.where("side = 'output'").groupBy("id", "task_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "category"))), lambda s: s["category"]).alias("steps"))
    process = steps.withColumn("process_id", content_id(F.col("task_type"), F.array_join("steps", ">")))
    outcomes = process.select("id", "process_id").join(interactions.select("id", "success", "duration"), "id")
    return {"extracts": found, "patterns": learning.patterns(found, "task_type"), "processes": process.select("process_id", "task_type", "steps").dropDuplicates(["process_id"]), "stats": learning.process_stats(outcomes)}


def resolved_inputs(texts: DataFrame, key: str, text: str, records: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, other, score): the record (id, vec) that each input's simple embedding is most similar to, above ``least``."""
    q = texts.select(F.col(key).cast("string").alias("id"), simple_embedding(text).alias("vec"))
    return similarity.search(q, records.select(F.col("id").cast("string").alias("id"), "vec"), "id", "vec", 1, least, exclude_self=False).select("id", "other", "score")


def goal_records(goals: DataFrame) -> DataFrame:
    """Attractor rows for goals (name, description, priority): vectors of their text, strength 0.5, ids from the name."""
    return goals.select(content_id(F.lit("goal"), "name").alias("id"), "name", simple_embedding(F.concat_ws(" ", "name", "description")).alias("embedding"), F.lit(0.5).alias("strength"), F.coalesce("priority", F.lit(5)).alias("priority"), F.lit(0.5).alias("probability"), F.lit(0).alias("activations"), F.lit(None).cast("timestamp").alias("updated_at"))


def path_reinforced(edges: DataFrame, paths: DataFrame, strength: float = 0.1) -> DataFrame:
    """Edges on successful paths (nodes), strengthened once each: deltas to be upserted."""
    steps = paths.where("size(nodes) > 1").select(F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("i", "source_id"), "nodes")
    pairs = steps.select("source_id", F.element_at("nodes", F.col("i") + 2).alias("target_id")).distinct()
    return edges.join(pairs, ["source_id", "target_id"], "left_semi").withColumn("weight", F.least(F.lit(1.0), F.col("weight") + strength))


def live_index(index: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """The index without tombstones; what a search sees before and a compaction keeps."""
    return index.join(tombstones.select(F.col(key)).distinct(), key, "left_anti")


def compaction_due(index: DataFrame, tombstones: DataFrame, threshold: int = 50, key: str = "id") -> DataFrame:
    """(live, dead, due): due from ``threshold`` tombstones on."""
    n = index.agg(F.count("*").alias("_n"))
    dead = index.join(tombstones.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("dead"))
    return n.join(dead).select((F.col("_n") - F.col("dead")).alias("live"), "dead", (F.col("dead") >= threshold).alias("due"))


def inserted(index: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The index with new rows; a key that is there already raises, as inserting twice is an error."""
    twice = rows.join(index.select(key), key, "left_semi").limit(1).count()
    if twice:
        raise ValueError("a vector with this key is in the index")
    return index.unionByName(rows)
