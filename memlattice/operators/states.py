"""Probability distributions over a record's competing states.

States: (owner_id, state_id, probability, embedding).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.operators.similarity import centroids

#: States a record keeps, decay per second.
MOST, RATE = 10, 0.01


def normalised(states: DataFrame, p: str = "probability") -> DataFrame:
    """p / sum per owner; an owner whose sum is 0 gets equal shares."""
    w = Window.partitionBy("owner_id")
    total, n = F.sum(p).over(w), F.count("*").over(w)
    return states.withColumn(p, F.when(total > 0, F.col(p) / total).otherwise(1 / n))


def added(states: DataFrame, new: DataFrame, most: int = MOST) -> DataFrame:
    """States with ``new`` ones, probabilities between 0 and 1, the ``most`` likeliest kept, normalised."""
    both = states.unionByName(new).withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("probability", F.lit(0.0)))))
    w = Window.partitionBy("owner_id").orderBy(F.desc("probability"), "state_id")
    return normalised(both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r"))


def summary(states: DataFrame) -> DataFrame:
    """(owner_id, n_states, entropy in bits, purity, dominant, probability) of normalised probabilities."""
    w = Window.partitionBy("owner_id")
    q = states.withColumn("_q", F.col("probability") / F.sum("probability").over(w))
    h = F.sum(F.when(F.col("_q") > 0, -F.col("_q") * F.log2("_q")).otherwise(0.0))
    return q.groupBy("owner_id").agg(F.count("*").alias("n_states"), h.alias("entropy"), F.sum(F.col("probability") * F.col("probability")).alias("purity"), F.max("_q").alias("probability"), F.min_by("state_id", F.struct(-F.col("_q"), F.col("state_id"))).alias("dominant"))


def expected(states: DataFrame) -> DataFrame:
    """(owner_id, centroid, n): the probability-weighted mean embedding."""
    return centroids(states, "owner_id", "embedding", F.col("probability"))


def amplitudes(states: DataFrame) -> DataFrame:
    return states.withColumn("amplitude", F.sqrt("probability"))


def biased(states: DataFrame, bias: Column | None) -> DataFrame:
    """p · (0.5 + 0.5 · cosine with ``bias``), normalised."""
    if bias is None:
        return normalised(states)
    return normalised(states.withColumn("probability", F.col("probability") * (0.5 + 0.5 * V.cosine(F.col("embedding"), bias))))


def likeliest(states: DataFrame, bias: Column | None = None) -> DataFrame:
    """(owner_id, state_id, probability), ties by state."""
    w = Window.partitionBy("owner_id").orderBy(F.desc("probability"), "state_id")
    return biased(states, bias).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("owner_id", "state_id", "probability")


def observed(states: DataFrame, seed: int, bias: Column | None = None) -> DataFrame:
    """States after an observation, with ``selected``: one is drawn by its share (the draw follows from seed
    and owner), gains 10 %, the others lose 5 %, normalised."""
    w = Window.partitionBy("owner_id").orderBy("state_id")
    draw = F.pmod(F.xxhash64("owner_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    b = biased(states, bias).withColumn("_c", F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("state_id"))) == 1
    b = b.withColumn("_last", last).withColumn("selected", (draw < F.col("_c")) | F.col("_last"))
    first = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("selected"), "state_id")) == 1
    b = b.withColumn("selected", first)
    return normalised(b.withColumn("probability", F.col("probability") * F.when(F.col("selected"), 1.1).otherwise(0.95)).drop("_c", "_last"))


def correlated(states: DataFrame, pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """States of partners (owner_id, partner_id in ``pairs``) after ``seen`` (owner_id, embedding) was observed:
    those of cosine above 0.5 gain cosine / 10, normalised."""
    hint = pairs.join(seen.select("owner_id", F.col("embedding").alias("_e")), "owner_id").select(F.col("partner_id").alias("owner_id"), "_e")
    c = V.cosine("embedding", "_e")
    j = states.join(hint, "owner_id").withColumn("probability", F.when(c > 0.5, F.col("probability") * (1 + 0.1 * c)).otherwise(F.col("probability")))
    return normalised(j.drop("_e"))


def decayed(states: DataFrame, seconds: float) -> DataFrame:
    """p drifts to equal shares: p (1 - f) + f / n with f = 1 - exp(-0.01 · seconds)."""
    f = F.lit(1.0) - F.exp(F.lit(-RATE * seconds))
    n = F.count("*").over(Window.partitionBy("owner_id"))
    return states.withColumn("probability", F.col("probability") * (1 - f) + f / n)


def interfered(states: DataFrame) -> DataFrame:
    """Pairs above cosine 0.8, in order: the stronger takes 0.8 of the sum; under 0.01 a state goes; normalised.

    Each pair sees the one before, so an owner's states (MOST at most) are walked in a group.
    """
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("state_id").reset_index(drop=True)
        x = np.array(pdf.embedding.tolist(), "f8")
        n = np.linalg.norm(x, axis=1)
        p = pdf.probability.to_numpy("f8").copy()
        for i in range(len(p)):
            for j in range(i + 1, len(p)):
                if n[i] and n[j] and x[i] @ x[j] / (n[i] * n[j]) > 0.8:
                    a, b = (i, j) if p[i] >= p[j] else (j, i)
                    s = p[i] + p[j]
                    p[a], p[b] = 0.8 * s, 0.2 * s
        keep = p > 0.01
        pdf = pdf.assign(probability=p / p[keep].sum() if keep.any() else p)
        return pdf[keep]

    return states.groupBy("owner_id").applyInPandas(run, states.schema)


def evolved(states: DataFrame, seconds: float) -> DataFrame:
    return interfered(decayed(states, seconds))


def gated(pairs: DataFrame, gate: str) -> DataFrame:
    """(owner_id, p0, p1) of two-state records under gate X, Y, Z, H, S or T."""
    p, q = F.col("p0"), F.col("p1")
    a, b = F.sqrt(p), F.sqrt(q)
    if gate in ("X", "Y"):
        out = q, p
    elif gate == "H":
        out = (a + b) * (a + b) / 2, (a - b) * (a - b) / 2
    else:
        out = p, q
    return pairs.select("owner_id", out[0].alias("p0"), out[1].alias("p1"))


def entanglement(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """(owner_id, partner_id, correlation, entropy): mean absolute cosine over the pairs of states, mean entropy.

    A record has MOST states at most, so a pair of records has MOST² at most.
    """
    a = states.select("owner_id", F.col("embedding").alias("_a"))
    b = states.select(F.col("owner_id").alias("partner_id"), F.col("embedding").alias("_b"))
    c = pairs.join(a, "owner_id").join(b, "partner_id").groupBy("owner_id", "partner_id").agg(F.abs(F.avg(V.cosine("_a", "_b"))).alias("correlation"))
    h = summary(states).select("owner_id", "entropy")
    j = c.join(h, "owner_id").join(h.select(F.col("owner_id").alias("partner_id"), F.col("entropy").alias("_h")), "partner_id")
    return j.select("owner_id", "partner_id", "correlation", ((F.col("entropy") + F.col("_h")) / 2).alias("entropy"))


def state_stats(states: DataFrame) -> DataFrame:
    return summary(states).agg(F.count("*").alias("n_owners"), F.sum("n_states").alias("n_states"), F.avg("entropy").alias("avg_entropy"), F.avg("n_states").alias("avg_states"))
