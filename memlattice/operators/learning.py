"""Extracts, patterns, processes and outcomes, and corpus term statistics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions.embedding import fitted_embedding
from memlattice.functions.vectors import cosine
from memlattice.operators.similarity import centroids
from memlattice.session import materialize

#: Extracts a pattern needs, least importance.
INSTANCES, LEAST = 3, 0.3


def extracts(texts: DataFrame, key: str, text: str, accesses: Column | None = None, least: float = LEAST) -> DataFrame:
    """(key, position, content, category, importance, keywords) of each text's segments of at least ``least`` importance."""
    s = texts.select(key, (accesses if accesses is not None else F.lit(0)).alias("_n"), F.posexplode(T.segments(F.col(text))).alias("position", "content"))
    s = s.withColumn("category", T.category(F.col("content")))
    s = s.withColumn("importance", T.importance(F.col("content"), F.col("category"), F.col("_n"))).where(F.col("importance") >= least)
    return s.select(key, "position", "content", "category", "importance", T.keywords(F.col("content")).alias("keywords"))


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, terms array<(term, n)>) of each text, tokenised once; written, as frequencies and weights both read it."""
    words = texts.where(F.col(text).isNotNull()).select(key, F.array_sort(T.tokens(F.col(text))).alias("_w"))
    # in a sorted list each term's first place and the next term's give its count
    starts = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    rows = words.withColumn("_s", F.when(F.size("_w") > 0, starts).otherwise(F.array().cast("array<int>")))
    count = lambda s, i: F.coalesce(F.get("_s", i + 1), F.size("_w") + 1) - s
    return materialize(rows.select(key, F.size("_w").alias("n_tokens"), F.transform("_s", lambda s, i: F.struct(F.get("_w", s - 1).alias("term"), count(s, i).alias("n"))).alias("terms")), "terms")


def document_frequency(texts: DataFrame, key: str, text: str, counts: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): documents with the term; idf = ln((N + 1) / (df + 1)) + 1, over all documents."""
    counts = term_counts(texts, key, text) if counts is None else counts
    n = counts.count()
    terms = counts.select(F.explode("terms").alias("t")).select("t.term")
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1)


def tfidf(texts: DataFrame, key: str, text: str, frequencies: DataFrame | None = None) -> DataFrame:
    """(key, term, tfidf): share of the text's tokens times idf; unseen terms have ln(100).

    Without ``frequencies`` those of the texts themselves count.
    """
    counts = term_counts(texts, key, text)
    frequencies = document_frequency(texts, key, text, counts) if frequencies is None else frequencies
    t = counts.select(key, "n_tokens", F.explode("terms").alias("t")).select(key, "t.term", (F.col("t.n") / F.col("n_tokens")).alias("_share"))
    j = t.join(frequencies.select("term", "idf"), "term", "left")
    return j.select(key, "term", (F.col("_share") * F.coalesce("idf", F.lit(math.log(100)))).alias("tfidf"))


def fitted_vectors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding): local embeddings whose word weights are fitted on all ``texts``.

    Each text takes along the idf of its own terms, so no task holds the vocabulary. Null
    texts have a null embedding, texts without terms that of their characters.
    """
    counts = term_counts(texts, key, text)
    idf = document_frequency(texts, key, text, counts).select("term", "idf")
    own = counts.select(key, F.explode("terms.term").alias("term")).join(idf, "term").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("_idf"))
    return texts.select(key, text).join(own, key, "left").select(key, fitted_embedding(text, "_idf").alias("embedding"))


def learned_patterns(found: DataFrame, batch: str, key: str, vector: str, old: DataFrame, least: float = 0.7, same: float = 0.85, importance: str = "importance") -> DataFrame:
    """Patterns (id, centroid, n, avg_importance, confidence) after extracts (batch, key, vector, importance, keywords).

    Each batch with three extracts or more is clustered; a cluster of three or more is a
    pattern: if a pattern of ``old`` is more similar than ``same`` its centroid is replaced
    and its instances add up, else the cluster is a new one.
    """
    enough = found.groupBy(batch).count().where(F.col("count") >= INSTANCES).select(batch)
    rows = found.join(enough, batch, "left_semi")
    at = rows.join(extract_clusters(rows, batch, key, vector, least), [batch, key])
    name = F.concat_ws("#", F.col(batch).cast("string"), F.col("cluster").cast("string"))
    at = at.withColumn("id", name)
    size = at.groupBy("id").agg(F.count("*").alias("n"), F.avg(importance).alias("avg_importance")).where(F.col("n") >= INSTANCES)
    centre = centroids(at.join(size.select("id"), "id", "left_semi"), "id", vector).select("id", "centroid")
    new = size.join(centre, "id")
    fate = new.join(merged_patterns(old.select("id", "centroid"), new.select("id", "centroid"), same), "id")
    into = fate.where("merged_into IS NOT NULL").groupBy(F.col("merged_into").alias("id")).agg(F.min_by("centroid", "id").alias("_c"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("avg_importance")).alias("_i"))
    kept = old.join(into, "id", "left")
    total = F.col("n") + F.coalesce("_n", F.lit(0))
    mean = (F.col("n") * F.col("avg_importance") + F.coalesce("_i", F.lit(0.0))) / total
    kept = kept.select("id", F.coalesce("_c", "centroid").alias("centroid"), total.alias("n"), mean.alias("avg_importance"))
    both = kept.unionByName(fate.where("merged_into IS NULL").select("id", "centroid", "n", "avg_importance"))
    return both.withColumn("confidence", pattern_confidence(F.col("avg_importance"), F.col("n")))


def explained(confidence: Column, kind: Column, source: Column, target: Column) -> Column:
    """A sentence for an inferred link."""
    return F.format_string("%s leads to %s (%s, confidence %.0f%%)", source, target, F.lower(kind), confidence * 100)


def pattern_confidence(importance: Column, n: Column, least: int = INSTANCES) -> Column:
    """min(1, 0.7 · mean importance + min(0.3, n / 20)); 0 below ``least`` instances."""
    return F.when(n < least, 0.0).otherwise(F.least(F.lit(1.0), 0.7 * importance + F.least(F.lit(0.3), n / 20)))


def keyword_vote(found: DataFrame, group: str, top: int = 3) -> DataFrame:
    """(group, name): the ``top`` most frequent keywords of a group's extracts, ties by word, joined by ``_``."""
    c = found.select(group, F.explode("keywords").alias("w")).groupBy(group, "w").agg(F.count("*").alias("n"))
    r = c.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "w"))).where(F.col("_r") <= top)
    return r.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda x: x["w"]), "_").alias("name"))


def patterns(found: DataFrame, group: str) -> DataFrame:
    """(group, name, n, avg_importance, confidence) of groups of extracts."""
    a = found.groupBy(group).agg(F.count("*").alias("n"), F.avg("importance").alias("avg_importance"))
    a = a.withColumn("confidence", pattern_confidence(F.col("avg_importance"), F.col("n")))
    return a.join(keyword_vote(found, group), group, "left").select(group, F.coalesce("name", F.lit("")).alias("name"), "n", "avg_importance", "confidence")


def merged_patterns(old: DataFrame, new: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, merged_into): each new pattern (id, centroid) and the first old one above ``least``; null to create it.

    Patterns are few (a row per cluster of a batch); the old ones travel in one row.
    """
    every = old.agg(F.sort_array(F.collect_list(F.struct("id", "centroid"))).alias("_all"))
    hit = F.get(F.filter("_all", lambda x: cosine(F.col("centroid"), x["centroid"]) > least), F.lit(0))
    return new.join(every).select("id", hit["id"].alias("merged_into"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists of actions, lower case."""
    low = lambda c: F.transform(c, F.lower)
    union = F.size(F.array_union(low(a), low(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(low(a), low(b))) / union)


#: Jaccard similarity above which two processes are the same, and lengths that may differ.
ALIKE, APART = 0.7, 2


def same_process(runs: DataFrame, processes: DataFrame) -> DataFrame:
    """(run_id, process_id): for each run (run_id, task_type, steps) the most similar process of its task type:
    lengths differ by 2 at most, Jaccard above 0.7; ties by process.

    Similarity rests on the task type, the set of actions and the number of steps alone, so
    only the distinct ones of these meet, each set of processes by its smallest id. Sets that
    alike share one of their first n - ceil(0.7 n) + 1 actions in any fixed order, so they
    meet only those of their task type with such an action; those without actions meet each
    other.
    """
    of = ["task_type", "_a", "_n"]
    shaped = lambda d: d.withColumn("_a", F.array_sort(F.array_distinct(F.transform("steps", F.lower)))).withColumn("_n", F.size("steps"))
    first = F.slice("_a", F.lit(1), (F.size("_a") - F.ceil(F.size("_a") * F.lit(ALIKE)) + 1).cast("int"))
    keyed = lambda d: d.withColumn("_k", F.explode(F.when(F.size("_a") > 0, first).otherwise(F.array(F.lit("")))))
    p = keyed(shaped(processes).groupBy(of).agg(F.min("process_id").alias("process_id"))).select("process_id", "task_type", F.col("_a").alias("_b"), F.col("_n").alias("_m"), "_k")
    r = shaped(runs).select("run_id", *of)
    j = keyed(r.select(of).distinct()).join(p, ["task_type", "_k"]).where(F.abs(F.col("_n") - F.col("_m")) <= APART)
    j = j.withColumn("_j", jaccard(F.col("_a"), F.col("_b"))).where(F.col("_j") > ALIKE)
    best = j.groupBy(of).agg(F.min(F.struct((-F.col("_j")).alias("_j"), "process_id")).alias("_p"))
    return r.join(best, of).groupBy("run_id").agg(F.min("_p").alias("_p")).select("run_id", "_p.process_id")


def learned_processes(processes: DataFrame, stats: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processes, stats) after ``runs`` (run_id, task_type, steps, success, duration).

    A run like a known process adds to its executions, success rate and mean duration;
    any other is a new process, named after the first run of its task type and steps.
    """
    known = same_process(runs, processes).withColumnRenamed("process_id", "_known")
    steps = F.array_join(F.transform("steps", F.lower), ">")
    names = runs.groupBy(F.col("task_type").alias("_t"), steps.alias("_w")).agg(F.min("run_id").cast("string").alias("_first"))
    named = runs.join(known, "run_id", "left").join(names, F.col("task_type").eqNullSafe(F.col("_t")) & steps.eqNullSafe(F.col("_w")), "left")
    named = materialize(named.withColumn("process_id", F.coalesce("_known", "_first")).drop("_t", "_w", "_first"), "named")
    new = named.where("_known IS NULL").groupBy("process_id").agg(F.min("task_type").alias("task_type"), F.min_by("steps", "run_id").alias("steps"))
    now = process_stats(named).select("process_id", F.col("executions").alias("_n"), F.col("success_rate").alias("_s"), F.col("avg_duration").alias("_d"))
    j = stats.join(now, "process_id", "full")
    n, m = F.coalesce("executions", F.lit(0)), F.coalesce("_n", F.lit(0))
    mean = lambda a, b: (F.coalesce(a, F.lit(0.0)) * n + F.coalesce(b, F.lit(0.0)) * m) / (n + m)
    after = j.select("process_id", (n + m).alias("executions"), mean("success_rate", "_s").alias("success_rate"), mean("avg_duration", "_d").alias("avg_duration"))
    return processes.select("process_id", "task_type", "steps").unionByName(new), after


def process_stats(outcomes: DataFrame) -> DataFrame:
    """(process_id, executions, success_rate, avg_duration): true means over all outcomes."""
    return outcomes.groupBy("process_id").agg(F.count("*").alias("executions"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("duration").alias("avg_duration"))


def process_for_task(stats: DataFrame, processes: DataFrame, least: float = 0.7) -> DataFrame:
    """(task_type, process_id): the most successful process above ``least``, ties by process."""
    j = processes.join(stats, "process_id").where(F.col("success_rate") > least)
    return j.groupBy("task_type").agg(F.min_by("process_id", F.struct(-F.col("success_rate"), "process_id")).alias("process_id"))


def outcome_edges(outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, weight) after successes (source_id, target_id): an existing edge gains 0.05, else CAUSAL 0.5."""
    hits = outcomes.where("success").groupBy("source_id", "target_id").agg(F.count("*").alias("_n"))
    have = edges.groupBy("source_id", "target_id").agg(F.min_by("edge_type", "id").alias("_t"), F.min_by("weight", "id").alias("_w"))
    j = hits.join(have, ["source_id", "target_id"], "left")
    w = F.when(F.col("_w").isNull(), F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("_n") - 1))).otherwise(F.least(F.lit(1.0), F.col("_w") + 0.05 * F.col("_n")))
    return j.select("source_id", "target_id", F.coalesce("_t", F.lit("CAUSAL")).alias("edge_type"), w.alias("weight"))


def farthest_first(x: np.ndarray, least: float) -> np.ndarray:
    """Labels: k = min(ceil(root n), ceil(n / 3)) seeds farthest first from row 0; rows below ``least``
    similarity to all stand alone; one refinement by the clusters' means."""
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = min(math.ceil(math.sqrt(n)), math.ceil(n / 3))
    seeds = [0]
    near = u @ u[0]
    while len(seeds) < k:
        i = int(near.argmin())
        seeds.append(i)
        near = np.maximum(near, u @ u[i])
    label = np.full(n, -1)
    centres = u[seeds]
    for _ in range(2):
        s = u @ centres.T
        label = np.where(s.max(axis=1) >= least, s.argmax(axis=1), -1)
        groups = [label == j for j in range(len(centres))]
        centres = np.stack([u[g].mean(axis=0) if g.any() else c for g, c in zip(groups, centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    alone = np.flatnonzero(label < 0)
    label[alone] = len(centres) + np.arange(len(alone))
    return label


def extract_clusters(found: DataFrame, batch: str, key: str, vector: str, least: float = 0.7, bound: int = 20_000) -> DataFrame:
    """(batch, key, cluster): farthest-first clusters within each learning batch; larger batches than ``bound`` raise."""
    kinds = dict(found.dtypes)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > bound:
            raise ValueError(f"a learning batch has {len(pdf)} extracts; the bound is {bound}")
        pdf = pdf.sort_values(key)
        label = farthest_first(np.array(pdf[vector].tolist(), "f8"), least)
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "cluster": label.astype("i4")})

    return found.select(batch, key, vector).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, cluster int")


def learning_stats(found: DataFrame, learned: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: counts of extracts, patterns and processes, mean confidence and success."""
    parts = [found.agg(F.count("*").alias("n_extracts")), learned.agg(F.count("*").alias("n_patterns"), F.avg("confidence").alias("avg_confidence")), stats.agg(F.count("*").alias("n_processes"), F.avg("success_rate").alias("avg_success"))]
    return reduce(lambda a, b: a.join(b), parts)
