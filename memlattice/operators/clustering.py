"""K-means, DBSCAN and agglomerative clustering under cosine similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.operators.components import connected_components
from memlattice.operators.similarity import centroids, nearest, search
from memlattice.session import materialize


def kmeans_seeds(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(cluster, centroid): k rows drawn by key hash, at most the number of rows."""
    rows = df.select(key, V.doubles(vector).alias("centroid"), F.xxhash64(key, F.lit(seed)).alias("_h")).orderBy("_h", key).limit(k)
    return rows.select((F.row_number().over(Window.orderBy("_h", key)) - 1).alias("cluster"), "centroid")


#: Rows that seeds are drawn from at most, by key hash.
SEED_ROWS = 16384


def plus_plus_seeds(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(cluster, centroid): k-means++ seeds, each drawn in proportion to its squared cosine distance to those before,
    from a bounded sample of rows (all of them up to SEED_ROWS); fewer where no row is apart from the seeds."""
    n = df.count()
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    rows = df.select(F.col(key).alias("id"), V.doubles(vector).alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(at <= int(min(1.0, SEED_ROWS / max(1, n)) * (1 << 30))) if n > SEED_ROWS else rows
    table = rows.toArrow().sort_by("id")
    x = np.array(table.column("v").to_pylist(), "f8").reshape(table.num_rows, -1)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng, chosen = np.random.default_rng(seed), []
    if len(x):
        chosen = [int(rng.integers(len(x)))]
        cost = np.maximum(1 - u @ u[chosen[0]], 0) ** 2
        while len(chosen) < k and cost.sum() > 1e-18:
            i = int(rng.choice(len(x), p=cost / cost.sum()))
            chosen.append(i)
            cost = np.minimum(cost, np.maximum(1 - u @ u[i], 0) ** 2)
    return df.sparkSession.createDataFrame([(i, x[c].tolist()) for i, c in enumerate(chosen)], "cluster int, centroid array<double>")


def kmeans_step(df: DataFrame, key: str, vector: str, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned rows, new centres): nearest centre by cosine, then plain means; an empty cluster keeps its centre."""
    at = nearest(df, key, vector, centres, "cluster")
    new = centroids(df.select(key, vector).join(at.select(key, "cluster"), key), "cluster", vector)
    kept = centres.join(new.select("cluster", F.col("centroid").alias("_c")), "cluster", "left").select("cluster", F.coalesce("_c", "centroid").alias("centroid"))
    return at, kept


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 20, tolerance: float = 1e-4, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(assignments, centres, rounds used); raises for fewer different rows than ``k``; seeds by k-means++. The k centres pass the driver each round."""
    rows = materialize(df.select(key, V.doubles(vector).alias(vector)), "kmeans")
    centres = materialize(plus_plus_seeds(rows, key, vector, k, seed), "centres")
    if centres.count() < k:
        raise ValueError("fewer different rows than clusters")
    used = 0
    for used in range(1, rounds + 1):
        _, new = kmeans_step(rows, key, vector, centres)
        new = materialize(new, "centres")
        moved = centres.join(new.select("cluster", F.col("centroid").alias("_n")), "cluster").agg(F.max(V.euclidean("centroid", "_n"))).first()[0]
        centres = new
        if (moved or 0.0) < tolerance:
            break
    return nearest(rows, key, vector, centres, "cluster"), centres, used


def eps_pairs(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """(id, other): pairs of rows with 1 - cosine <= eps, both ways, without self; block by block."""
    return search(df, df, key, vector, None, 1 - eps).select("id", "other")


def dbscan(df: DataFrame, key: str, vector: str, eps: float, least: int) -> DataFrame:
    """(key, cluster, role): core (``least`` rows within eps, itself counted), border or noise (null cluster).

    Clusters are the components of the core rows, named by their smallest key; a border
    row joins the smallest neighbouring cluster.
    """
    pairs = materialize(eps_pairs(df, key, vector, eps), "eps")
    n = pairs.groupBy("id").agg(F.count("*").alias("_n"))
    rows = df.select(F.col(key).alias("id")).join(n, "id", "left").withColumn("_core", F.coalesce("_n", F.lit(0)) + 1 >= least)
    core = materialize(rows.where("_core").select("id"), "core")
    links = pairs.join(core, "id", "left_semi").join(core.select(F.col("id").alias("other")), "other", "left_semi")
    comp = connected_components(links.unionByName(core.select("id", F.col("id").alias("other"))), "id", "other").withColumnRenamed("node", "id")
    border = pairs.join(comp.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("_b"))
    j = rows.join(comp, "id", "left").join(border, "id", "left")
    role = F.when(F.col("_core"), "core").when(F.col("_b").isNotNull(), "border").otherwise("noise")
    return j.select(F.col("id").alias(key), F.when(F.col("_core"), F.col("component")).otherwise(F.col("_b")).alias("cluster"), role.alias("role"))


def single_linkage(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(key, cluster): single-linkage clusters cut at similarity ``least`` = components of the threshold graph."""
    links = eps_pairs(df, key, vector, 1 - least)
    own = df.select(F.col(key).alias("id"), F.col(key).alias("other"))
    return connected_components(links.unionByName(own), "id", "other").select(F.col("node").alias(key), F.col("component").alias("cluster"))


def agglomerated(x: np.ndarray, target: int, linkage: str) -> np.ndarray:
    """Labels after merging the most similar clusters until ``target`` are left."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    size, label, live = np.ones(len(x)), np.arange(len(x)), len(x)
    while live > max(1, target):
        i, j = divmod(int(s.argmax()), len(x))
        i, j = min(i, j), max(i, j)
        if linkage == "single":
            row = np.maximum(s[i], s[j])
        elif linkage == "complete":
            row = np.minimum(s[i], s[j])
        else:
            row = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = row, row
        s[j], s[:, j] = -np.inf, -np.inf
        s[i, i] = -np.inf
        size[i] += size[j]
        label[label == j] = i
        live -= 1
    return np.unique(label, return_inverse=True)[1]


def hierarchical(df: DataFrame, batch: str, key: str, vector: str, target: int, linkage: str = "average", bound: int = 3000) -> DataFrame:
    """(batch, key, cluster) of each batch on its own; cubic, so a batch above ``bound`` rows raises an error."""
    kinds = dict(df.dtypes)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > bound:
            raise ValueError(f"a batch has {len(pdf)} rows; the bound is {bound}")
        pdf = pdf.sort_values(key)
        label = agglomerated(np.array(pdf[vector].tolist(), "f8"), target, linkage)
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "cluster": label.astype("i4")})

    return df.select(batch, key, vector).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, cluster int")


def cluster_stats(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    n = assigned.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_clusters"), F.avg("n").alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
