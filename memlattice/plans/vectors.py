"""Similarity, centroid, attractor, state and cluster queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.functions.embedding import deterministic_embedding, local_embedding, simple_embedding
from memlattice.operators import attractors as A
from memlattice.operators import clustering, similarity, states
from memlattice.sources.tables import read

CAST = "embedding::DOUBLE[]"
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _e(spark, d):
    return read(spark, d, "embeddings")


def _first(spark, d):
    return [float(x) for x in _e(spark, d).where("vec_id = 0").first()["embedding"]]


def vector_topk(spark, d):
    """K1, K2: the ten vectors most similar to that of record 0."""
    return similarity.top_k(_e(spark, d), "vec_id", "embedding", _first(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


def similar_to(spark, d):
    """Of every record whose id 20 divides, the ten most similar others."""
    e = _e(spark, d)
    found = similarity.search(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return found.select("id", "other", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def similar_all(spark, d):
    """K4, W1 for every record: its ten most similar others."""
    e = _e(spark, d)
    found = similarity.search(e, e, "vec_id", "embedding", 10)
    return found.select("id", "other", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def duplicate_probe(spark, d):
    """K5 at 0.4: the best match of each queried record, if close enough."""
    e = _e(spark, d)
    found = similarity.search(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 1)
    return similarity.duplicates(found, 0.4).select("id", "duplicate_of", F.round("score", 6).alias("score"))


def semantic_edges(spark, d):
    """Links of the queried records with their top 20 of similarity 0.4 or more, both ways."""
    e = _e(spark, d)
    found = similarity.search(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 20, 0.4)
    return similarity.semantic_edges(found).select("source", "target", F.round("weight", 6).alias("weight"), "edge_type")


def vector_suite(spark, d):
    """V1-V5: norm, unit vector's first value, distance, dot product and cosine to record 0."""
    q = F.array(*[F.lit(x) for x in _first(spark, d)])
    r = lambda c: F.round(c, 6)
    return _e(spark, d).select("vec_id", r(V.magnitude("embedding")).alias("norm"), r(F.get(V.normalized("embedding"), F.lit(0))).alias("unit_0"), r(V.euclidean("embedding", q)).alias("euclid"), r(V.dot("embedding", q)).alias("dot"), r(V.cosine("embedding", q)).alias("cosine"), r(F.get(V.added("embedding", q), F.lit(1))).alias("sum_1"))


def label_centroids(spark, d):
    """Mean vector of each label, by position."""
    c = similarity.centroids(_e(spark, d), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "value"), "n").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"), "n")


def nearest_centroid(spark, d):
    """The label whose centroid is most similar to each record."""
    e = _e(spark, d)
    return similarity.nearest(e, "vec_id", "embedding", similarity.centroids(e, "label", "embedding"), "label").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def label_cohesion(spark, d):
    """Mean similarity over all pairs of a label."""
    return similarity.mean_similarity(_e(spark, d), "label", "embedding").select("label", "n", F.round("avg_similarity", 6).alias("avg_similarity"))


def silhouette(spark, d):
    """A25 by label."""
    return similarity.silhouette(_e(spark, d), "vec_id", "label", "embedding").select("vec_id", "label", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("silhouette", 6).alias("silhouette"))


def feedback_update(spark, d):
    """SR4: every vector moved towards record 0's (away for odd ids), dopamine 0.5."""
    q = F.array(*[F.lit(x) for x in _first(spark, d)])
    v = similarity.feedback(F.col("embedding"), q, F.col("vec_id") % 2 == 0, 0.5)
    return _e(spark, d).select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("v0"), F.round(V.euclidean(v, V.normalized("embedding")), 6).alias("drift"))


def pattern_complete(spark, d):
    """N4 from record 0's vector."""
    v = similarity.pattern_complete(_e(spark, d), "vec_id", "embedding", _first(spark, d))
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(v)], "dim int, value double")


def _attractors(spark, d):
    c = similarity.centroids(_e(spark, d), "label", "embedding")
    return c.select(F.col("label").cast("string").alias("id"), F.col("centroid").alias("embedding"), (F.lit(0.3) + F.col("label") * 0.05).alias("strength"), (F.lit(1) + F.col("label") % 10).alias("priority"), F.col("n").alias("activations"), F.lit(0.5).alias("probability"))


def attractor_influence(spark, d):
    """Influence of every label attractor on every record."""
    return A.influences(_e(spark, d), "vec_id", "embedding", _attractors(spark, d)).select("vec_id", "attractor", F.round("similarity", 6).alias("similarity"), F.round("influence", 6).alias("influence"))


def dominant_attractor(spark, d):
    """P3, K13."""
    f = A.influences(_e(spark, d), "vec_id", "embedding", _attractors(spark, d))
    return A.dominant(f, "vec_id").select("vec_id", "attractor", F.round("influence", 6).alias("influence"))


def transition_probabilities(spark, d):
    """From every record to the next two by id."""
    e = _e(spark, d)
    nxt = e.select(F.col("vec_id").alias("source"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("_t"))
    cand = nxt.join(e.select(F.col("vec_id").alias("_t"), "embedding"), "_t").select("source", F.col("_t").alias("vec_id"), "embedding")
    return A.transitions(e, cand, "vec_id", "embedding", _attractors(spark, d)).select("source", "target", F.round("probability", 6).alias("probability"))


def attractor_stats(spark, d):
    """A8, P9, P13."""
    return A.attractor_stats(A.reprobable(_attractors(spark, d), _first(spark, d))).select("n", F.round("avg_strength", 6).alias("avg_strength"), F.round("avg_activations", 6).alias("avg_activations"), "n_active")


def _states(spark, d):
    """Records as states of their label's owner ``vec_id / 10``."""
    e = _e(spark, d)
    return e.select(F.floor(F.col("vec_id") / 10).alias("owner_id"), F.col("vec_id").alias("state_id"), ((F.col("vec_id") % 7 + 1) / 8.0).alias("probability"), V.doubles("embedding").alias("embedding"))


def state_summary(spark, d):
    """A15, R3, R6."""
    s = states.summary(_states(spark, d))
    return s.select("owner_id", "n_states", F.round("entropy", 6).alias("entropy"), F.round("purity", 6).alias("purity"), F.round("probability", 6).alias("probability"), "dominant")


def state_normalised(spark, d):
    """W10, R1."""
    return states.normalised(_states(spark, d)).select("owner_id", "state_id", F.round("probability", 6).alias("probability"))


def state_expected(spark, d):
    """First value of the expected embedding."""
    return states.expected(_states(spark, d)).select("owner_id", F.round(F.get("centroid", F.lit(0)), 6).alias("e0"), "n")


def state_decay(spark, d):
    """R4 without interference, after 60 seconds."""
    return states.decayed(states.normalised(_states(spark, d)), 60.0).select("owner_id", "state_id", F.round("probability", 6).alias("probability"))


def state_evolved(spark, d):
    """R4 whole."""
    return states.evolved(states.normalised(_states(spark, d)), 60.0).select("owner_id", "state_id", F.round("probability", 6).alias("probability"))


def state_observed(spark, d):
    """R2 with a seed."""
    return states.observed(_states(spark, d), 7).select("owner_id", "state_id", F.round("probability", 6).alias("probability"), "selected")


def state_gates(spark, d):
    """Gates X and H on the first two states of an owner."""
    s = states.normalised(_states(spark, d).where("state_id % 10 < 2"))
    two = s.groupBy("owner_id").agg(F.min_by("probability", "state_id").alias("p0"), F.max_by("probability", "state_id").alias("p1"), F.count("*").alias("n")).where("n = 2")
    out = [states.gated(two, g).withColumn("gate", F.lit(g)) for g in ("X", "H")]
    return out[0].unionByName(out[1]).select("owner_id", "gate", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def entanglement(spark, d):
    """Neighbouring owners."""
    s = _states(spark, d)
    pairs = s.select("owner_id").distinct().select("owner_id", (F.col("owner_id") + 1).alias("partner_id"))
    return states.entanglement(s, pairs).select("owner_id", "partner_id", F.round("correlation", 6).alias("correlation"), F.round("entropy", 6).alias("entropy"))


def kmeans_step(spark, d):
    """One step from the label centroids: sizes and first values of the new centres."""
    e = _e(spark, d)
    c = similarity.centroids(e, "label", "embedding").select(F.col("label").alias("cluster"), "centroid")
    at, new = clustering.kmeans_step(e, "vec_id", "embedding", c)
    return at.groupBy("cluster").agg(F.count("*").alias("n")).join(new, "cluster").select("cluster", "n", F.round(F.get("centroid", F.lit(0)), 6).alias("c0"))


def kmeans_sizes(spark, d):
    """Z1 whole, k = 8."""
    at, _, _ = clustering.kmeans(_e(spark, d), "vec_id", "embedding", 8, 5)
    return at.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))


def dbscan(spark, d):
    """Z2 with eps 0.55 and 4 rows."""
    return clustering.dbscan(_e(spark, d), "vec_id", "embedding", 0.55, 4)


def single_linkage(spark, d):
    """Z3, single, cut at 0.5."""
    return clustering.single_linkage(_e(spark, d), "vec_id", "embedding", 0.5)


def hierarchical(spark, d):
    """Z3, average linkage, three clusters per label."""
    return clustering.hierarchical(_e(spark, d), "label", "vec_id", "embedding", 3)


def deterministic_vectors(spark, d):
    """E1 on all texts."""
    return read(spark, d, "documents").select("doc_id", deterministic_embedding("text").alias("embedding"))


def simple_vectors(spark, d):
    """E9 on all texts."""
    return read(spark, d, "documents").select("doc_id", simple_embedding("text").alias("embedding"))


def local_vectors(spark, d):
    """E3-E7 on all part names."""
    return read(spark, d, "part").select("p_partkey", local_embedding("p_name").alias("embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, similar_to, similar_all, duplicate_probe, semantic_edges, vector_suite, label_centroids, nearest_centroid, label_cohesion, silhouette, feedback_update,
        pattern_complete, attractor_influence, dominant_attractor, transition_probabilities, attractor_stats, state_summary, state_normalised, state_expected,
        state_decay, state_evolved, state_observed, state_gates, entanglement, kmeans_step, kmeans_sizes, dbscan, single_linkage, hierarchical,
        deterministic_vectors, simple_vectors, local_vectors,
    )
}

_TOP = f"""
WITH s AS (
  SELECT a.vec_id AS id, b.vec_id AS other, {COS} AS score FROM embeddings a, embeddings b
  WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s)
"""
_CENTRE = """
WITH dims AS (
  SELECT label, dim, avg(x) AS m, count(*) AS n FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY dim) AS centroid, max(n) AS n FROM dims GROUP BY 1)
"""
_INFLUENCE = (
    _CENTRE
    + """, inf AS (
  SELECT e.vec_id, e.embedding, c.label::VARCHAR AS attractor, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS similarity,
         (0.3 + c.label * 0.05) * exp(-(1 - list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)) / 0.7) * (1 + c.label % 10) / 10 AS influence
  FROM embeddings e, c)
"""
)
_STATES = """
WITH s AS (
  SELECT vec_id // 10 AS owner_id, vec_id AS state_id, (vec_id % 7 + 1) / 8.0::DOUBLE AS probability, embedding::DOUBLE[] AS embedding FROM embeddings),
q AS (SELECT *, probability / sum(probability) OVER (PARTITION BY owner_id) AS q, count(*) OVER (PARTITION BY owner_id) AS n FROM s)
"""

def _round(i: int) -> str:
    """SQL: one round of pattern completion from the query table q{i}, k = 10, alpha 0.3."""
    return f""",
t{i} AS (
  SELECT embedding::DOUBLE[] AS v, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q{i} ORDER BY s DESC, vec_id LIMIT 10),
u{i} AS (SELECT * FROM t{i} WHERE s >= (SELECT avg(s) FROM t{i})),
m{i} AS (SELECT dim, sum(s * x) / (SELECT sum(s) FROM u{i}) AS x FROM (SELECT s, unnest(v) AS x, unnest(range(len(v))) AS dim FROM u{i}) GROUP BY 1),
b{i} AS (SELECT m.dim, 0.3::DOUBLE * q[m.dim + 1] + 0.7::DOUBLE * m.x AS x FROM m{i} m, q{i}),
q{i + 1} AS (SELECT list(x / (SELECT sqrt(sum(x * x)) FROM b{i}) ORDER BY dim) AS q FROM b{i})"""


_NEAR = f"""
WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
"""

SQL = {
    "pattern_complete": "WITH q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
    + _round(0)
    + _round(1)
    + _round(2)
    + " SELECT dim::INTEGER AS dim, round(value, 6) AS value FROM (SELECT unnest(range(len(q))) AS dim, unnest(q) AS value FROM q3)",
    "dbscan": _NEAR
    + """core AS (SELECT vec_id AS id FROM embeddings LEFT JOIN p ON a = vec_id AND c >= 1 - 0.55::DOUBLE GROUP BY 1 HAVING count(a) + 1 >= 4),
near AS (SELECT a, b FROM p WHERE c >= 1 - 0.55::DOUBLE),
comp AS (
  SELECT id, id AS label, 0 AS i FROM core
  UNION ALL
  SELECT id, min(label), i + 1 FROM (SELECT id, label, i FROM comp UNION ALL SELECT a, label, i FROM comp JOIN near ON b = id WHERE a IN (FROM core)) WHERE i < 30 GROUP BY id, i),
done AS (SELECT id, label FROM comp WHERE i = 30),
border AS (SELECT a AS id, min(label) AS label FROM near JOIN done ON done.id = b GROUP BY 1)
SELECT e.vec_id, coalesce(done.label, border.label) AS cluster, CASE WHEN done.id IS NOT NULL THEN 'core' WHEN border.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM embeddings e LEFT JOIN done ON done.id = e.vec_id LEFT JOIN border ON border.id = e.vec_id""",
    "single_linkage": _NEAR
    + """comp AS (
  SELECT vec_id AS id, vec_id AS label, 0 AS i FROM embeddings
  UNION ALL
  SELECT id, min(label), i + 1 FROM (SELECT id, label, i FROM comp UNION ALL SELECT a, label, i FROM comp JOIN p ON b = id WHERE c >= 0.5) WHERE i < 40 GROUP BY id, i)
SELECT id AS vec_id, label AS cluster FROM comp WHERE i = 40""",
    "vector_topk": f"""SELECT b.vec_id, round({COS}, 6) AS score, round(1 - {COS}, 6) AS distance FROM embeddings a, embeddings b
        WHERE a.vec_id = 0 ORDER BY {COS} DESC, b.vec_id LIMIT 10""",
    "similar_to": _TOP + "SELECT id, other, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "similar_all": _TOP.replace("a.vec_id % 20 = 0 AND ", "") + "SELECT id, other, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "duplicate_probe": _TOP + "SELECT id, other AS duplicate_of, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.4",
    "semantic_edges": _TOP
    + """, k AS (SELECT * FROM r WHERE rank <= 20 AND score >= 0.4)
      SELECT source, target, round(max(w), 6) AS weight, 'SEMANTIC' AS edge_type FROM (
        SELECT id AS source, other AS target, score AS w FROM k UNION ALL SELECT other, id, score FROM k) GROUP BY 1, 2""",
    "vector_suite": f"""SELECT b.vec_id, round(sqrt(list_dot_product(b.{CAST}, b.{CAST})), 6) AS norm,
        round(b.embedding[1]::DOUBLE / sqrt(list_dot_product(b.{CAST}, b.{CAST})), 6) AS unit_0, round(list_distance(a.{CAST}, b.{CAST}), 6) AS euclid,
        round(list_dot_product(a.{CAST}, b.{CAST}), 6) AS dot, round({COS}, 6) AS cosine, round(a.embedding[2]::DOUBLE + b.embedding[2]::DOUBLE, 6) AS sum_1
        FROM embeddings a, embeddings b WHERE a.vec_id = 0""",
    "label_centroids": _CENTRE + "SELECT label, dim, round(m, 6) AS value, n FROM dims",
    "nearest_centroid": _CENTRE
    + """SELECT vec_id, label, round(s, 6) AS similarity FROM (
        SELECT e.vec_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS s FROM embeddings e, c)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""",
    "label_cohesion": f"""SELECT a.label, any_value(n) AS n, round(avg({COS}), 6) AS avg_similarity FROM embeddings a JOIN embeddings b
        ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c ON c.label = a.label GROUP BY 1""",
    "silhouette": f"""WITH m AS (
          SELECT a.vec_id, a.label, b.label AS other, sum(1 - {COS}) AS s, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
        x AS (SELECT vec_id, label, coalesce(sum(s / n) FILTER (other = label), 0) AS a, min(s / n) FILTER (other <> label) AS b FROM m GROUP BY ALL)
        SELECT vec_id, label, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM x""",
    "feedback_update": f"""WITH u AS (
          SELECT b.vec_id, b.{CAST} AS v, list_transform(list_zip(b.{CAST}, a.{CAST}), lambda p: p[1] + 0.0125::DOUBLE * CASE WHEN b.vec_id % 2 = 0 THEN 1 ELSE -1 END * (p[2] - p[1])) AS w
          FROM embeddings a, embeddings b WHERE a.vec_id = 0),
        n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM u)
        SELECT vec_id, round(w[1], 6) AS v0, round(list_distance(v, w), 6) AS drift FROM n""",
    "attractor_influence": _INFLUENCE + "SELECT vec_id, attractor, round(similarity, 6) AS similarity, round(influence, 6) AS influence FROM inf",
    "dominant_attractor": _INFLUENCE
    + """SELECT vec_id, attractor, round(influence, 6) AS influence FROM inf WHERE influence > 0
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY influence DESC, attractor) = 1""",
    "transition_probabilities": _INFLUENCE
    + """, t AS (SELECT vec_id, any_value(embedding::DOUBLE[]) AS v, sum(influence) AS i FROM inf GROUP BY 1),
      p AS (SELECT a.vec_id AS source, b.vec_id AS target,
            greatest(0, least(1, 0.4 * list_cosine_similarity(a.v, b.v) + 0.6 * (0.5 + 0.5 * tanh(b.i - a.i)))) AS p
            FROM t a JOIN t b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2))
      SELECT source, target, round(p / sum(p) OVER (PARTITION BY source), 6) AS probability FROM p""",
    "attractor_stats": _CENTRE
    + """SELECT count(*) AS n, round(avg(0.3 + label * 0.05::DOUBLE), 6) AS avg_strength, round(avg(n), 6) AS avg_activations,
        count(*) FILTER (0.3 + label * 0.05 > 0.1) AS n_active FROM c""",
    "state_summary": _STATES
    + """SELECT owner_id, count(*) AS n_states, round(sum(-q * log2(q)), 6) AS entropy, round(sum(probability * probability), 6) AS purity,
        round(max(q), 6) AS probability, (list(state_id ORDER BY q DESC, state_id))[1] AS dominant FROM q GROUP BY 1""",
    "state_normalised": _STATES + "SELECT owner_id, state_id, round(q, 6) AS probability FROM q",
    "state_expected": _STATES + "SELECT owner_id, round(sum(probability * embedding[1]) / sum(probability), 6) AS e0, count(*) AS n FROM s GROUP BY 1",
    "state_decay": _STATES + "SELECT owner_id, state_id, round(q * exp(-0.6::DOUBLE) + (1 - exp(-0.6::DOUBLE)) / n, 6) AS probability FROM q",
    "state_gates": _STATES
    + """, t AS (SELECT owner_id, state_id, probability / sum(probability) OVER (PARTITION BY owner_id) AS q FROM s WHERE state_id % 10 < 2),
      w AS (SELECT owner_id, arg_min(q, state_id) AS p0, arg_max(q, state_id) AS p1 FROM t GROUP BY 1 HAVING count(*) = 2)
      SELECT owner_id, 'X' AS gate, round(p1, 6) AS p0, round(p0, 6) AS p1 FROM w UNION ALL
      SELECT owner_id, 'H', round((sqrt(p0) + sqrt(p1)) ** 2 / 2, 6), round((sqrt(p0) - sqrt(p1)) ** 2 / 2, 6) FROM w""",
    "entanglement": _STATES
    + """, h AS (SELECT owner_id, sum(-q * log2(q)) AS h FROM q GROUP BY 1)
      SELECT a.owner_id, b.owner_id AS partner_id, round(abs(avg(list_cosine_similarity(a.embedding, b.embedding))), 6) AS correlation,
             round((any_value(x.h) + any_value(y.h)) / 2, 6) AS entropy
      FROM s a JOIN s b ON b.owner_id = a.owner_id + 1 JOIN h x ON x.owner_id = a.owner_id JOIN h y ON y.owner_id = b.owner_id GROUP BY 1, 2""",
    "kmeans_step": _CENTRE
    + """, n AS (SELECT vec_id, embedding, label FROM (
            SELECT e.vec_id, e.embedding, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS s FROM embeddings e, c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
      SELECT label AS cluster, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS c0 FROM n GROUP BY 1""",
}
