"""Whole-flow queries: Merkle edits, search, ingestion against records, unified inference, fields, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.functions.keys import current_wide
from memlattice.operators import attractors as A
from memlattice.operators import chunks, events, graph, inference, learning, merkle, search, similarity
from memlattice.operators.index import VectorIndex
from memlattice.plans.data_problems import key
from memlattice.plans.graphs import _FIRST
from memlattice.plans.texts import _TREE
from memlattice.plans.vectors import _TOP
from memlattice.session import materialize
from memlattice.sources.tables import read


def _leaves(spark, d):
    c = chunks.fixed_chunks(read(spark, d, "documents"), "doc_id", F.encode("text", "UTF-8"), 512, "sha2")
    return c.select(F.col("doc_id").alias("tree"), F.col("idx").cast("long").alias("pos"), "hash")


def _changed(leaves):
    """Documents that 3 divides: another first leaf, and one leaf more."""
    some = leaves.where("pos = 0 AND tree % 3 = 0")
    return merkle.edited(leaves, some.select("tree", "pos", F.sha2(F.lit("first"), 256).alias("hash")), some.select("tree", F.lit(0).alias("n"), F.sha2(F.lit("last"), 256).alias("hash")))


def merkle_edited(spark, d):
    """M5: roots after leaves were replaced and added; only trees that change are built again."""
    old = _leaves(spark, d)
    new = _changed(old)
    nodes = merkle.retree(merkle.tree(old, "tree", "pos", "hash", "sha2"), old, new, "sha2")
    return merkle.roots(nodes).select(F.col("tree").alias("doc_id"), "root", "height")


def merkle_equal(spark, d):
    """U8: every tree against the one after those edits."""
    old = _leaves(spark, d)
    both = [merkle.tree(x, "tree", "pos", "hash", "sha2") for x in (old, _changed(old))]
    return merkle.equal_trees(*both).select(F.col("tree").alias("doc_id"), "equal", F.col("tree").isNotNull().alias("known"))


def merkle_batch_verified(spark, d):
    """M7: proofs of every second leaf together, with a wrong leaf where 5 divides the document."""
    leaves = _leaves(spark, d)
    nodes = merkle.tree(leaves, "tree", "pos", "hash", "sha2")
    wanted = leaves.where("pos % 2 = 0")
    siblings = merkle.batch_siblings(nodes, wanted.select("tree", "pos"))
    shown = wanted.withColumn("hash", F.when(F.col("tree") % 5 == 0, F.sha2(F.lit("wrong"), 256)).otherwise(F.col("hash")))
    return merkle.batch_valid(shown, siblings, merkle.roots(nodes), "sha2").select(F.col("tree").alias("doc_id"), "valid")


def word_windows(spark, d):
    """Windows of 160 words, 40 shared, of every text."""
    found = search.word_windows(read(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("window").cast("long").alias("window"), F.col("n_words").cast("long").alias("n_words"), F.sha2("content", 256).alias("content"))


def _records(spark, d):
    """Current neurons that aren't deleted and have 384 finite values, not all zero."""
    now = current_wide(read(spark, d, "neurons"), "id", "updated_at", ["deleted_at", "created_at", "merkle_root", "metadata", "embedding"])
    now = now.where("deleted_at IS NULL AND size(embedding) = 384 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    return now.select("id", "created_at", "merkle_root", "metadata", V.doubles("embedding").alias("vec"))


def _attractors(records):
    """The three records of the smallest ids as goals of falling strength: an example of goals, all records are measured."""
    from pyspark.sql import Window

    first = records.orderBy("id").limit(3)
    place = F.row_number().over(Window.orderBy("id"))
    return first.select("id", (0.9 - 0.1 * place).alias("strength"), (F.lit(8) - place).alias("priority"), F.col("vec").alias("embedding"), F.lit(0).alias("activations"))


def unified_inference(spark, d):
    """O1: forward and backward inference, influences, dominant goal, state entropy and recommendations of every record.

    A record's states are its outgoing edges, in proportion to their absolute weight.
    """
    r = _records(spark, d)
    e = graph.clean_edges(read(spark, d, "synapses"))
    states = e.select(F.col("source_id").alias("owner_id"), F.col("target_id").alias("state_id"), F.abs("weight").alias("probability"))
    found, _ = search.unified(e, r.select("id", "vec"), _attractors(r), states)
    return found.select(
        "id", "n_forward", "n_backward", "attractor", F.round("influence", 6).alias("influence"), F.round("total_influence", 6).alias("total_influence"),
        F.round("entropy", 6).alias("entropy"), "likeliest", "n_recommended", F.round("best", 6).alias("best"),
    )


def goal_recommendations(spark, d):
    """K12 with the next step towards a goal: every causal edge's target counts as its source's next step."""
    e = graph.clean_edges(read(spark, d, "synapses"))
    steps = e.where("edge_type = 'CAUSAL' AND source_id <> target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("step"))
    rec = inference.recommendations(inference.infer(e), 5, steps)
    return rec.select("id", "inferred", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def probability_field(spark, d):
    """The records that each goal reaches."""
    r = _records(spark, d)
    found = A.probability_field(r, "id", "vec", _attractors(r))
    return found.select("attractor", "id", F.round("gradient", 6).alias("gradient"))


def inference_stats(spark, d):
    """Causal relations observed on CAUSAL edges, hypotheses from backward inference."""
    e = graph.clean_edges(read(spark, d, "synapses"))
    seen = e.where("edge_type = 'CAUSAL' AND created_at IS NOT NULL").select(F.col("source_id").alias("cause"), F.col("target_id").alias("effect"), F.col("created_at").alias("at"), F.col("weight").alias("strength"))
    found = inference.inference_stats(inference.causal_strengths(seen), inference.backward(e))
    return found.select("causal_relations", F.round("average_strength", 6).alias("average_strength"), "cached_hypotheses")


def connections(spark, d):
    """The connection of every linked pair, whatever its type."""
    e = graph.clean_edges(read(spark, d, "synapses"))
    return graph.between(e, e.select("source_id", "target_id")).select("source_id", "target_id", "id", "edge_type", "weight")


def by_merkle_root(spark, d):
    """The record of the smallest Merkle root."""
    r = _records(spark, d)
    root = r.agg(F.min("merkle_root")).first()[0]
    return search.by_root(r, root).select("id", "merkle_root")


def index_search(spark, d):
    """A stored index of all vectors, opened again and asked for the ten nearest of every record whose id 20
    divides, all lists probed."""
    e = read(spark, d, "embeddings")
    built = VectorIndex(spark).build(e, "vec_id", "embedding")
    found = VectorIndex(spark, built.path).search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes=10**6)
    return found.select("id", "other", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def index_updates(spark, d):
    """Even records indexed, odd ones inserted, those that 7 divides deleted, the index compacted; searched as before."""
    e = read(spark, d, "embeddings")
    index = VectorIndex(spark).build(e.where("vec_id % 2 = 0"), "vec_id", "embedding")
    index.insert(e.where("vec_id % 2 = 1"), "vec_id", "embedding")
    index.delete(e.where("vec_id % 7 = 0").select("vec_id"), "vec_id")
    index.compact()
    found = index.search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, probes=10**6)
    return found.select("id", "other", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def found_with_records(spark, d):
    """The nearest records of record 0's vector joined with their items, and the access log they leave."""
    e = read(spark, d, "embeddings")
    query = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    top = similarity.top_k(e, "vec_id", "embedding", query, 10).select("vec_id", F.round("score", 6).alias("score"))
    return top.join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id").withColumn("accesses", F.lit(1).cast("long"))


def search_records(spark, d):
    """SR1: the vectors nearest to that of record 0, refined, with the texts of the same number, their labels as tags."""
    e = read(spark, d, "embeddings")
    records = e.select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("embedding"), F.array(F.col("label").cast("string")).alias("tags"), F.lit("vector").alias("source_type"))
    query = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = search.search(records, query, "memory graph index", 10, contents=texts, source_type="vector")
    return found.select("id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), F.round("keyword", 6).alias("keyword"), "rank")


def search_filtered(spark, d):
    """F1-F3 inside SR1: without refinement, the candidates with label 3 or 5 of similarity 0.1 or more."""
    e = read(spark, d, "embeddings")
    records = e.select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("embedding"), F.array(F.col("label").cast("string")).alias("tags"), F.lit("vector").alias("source_type"))
    query = [float(x) for x in e.where("vec_id = 1").first()["embedding"]]
    found = search.search(records, query, k=20, least=0.1, tags=["3", "5"], refine=False)
    return found.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def ingest_outcome(spark, d):
    """The texts of odd ids added to those of even ids: equal texts are merged into their record, others created."""
    from memlattice.functions.embedding import deterministic_embedding

    texts = read(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("id"), deterministic_embedding("text").alias("embedding"), F.array("lang").alias("tags"), "doc_id")
    old, new = texts.where("doc_id % 2 = 0"), texts.where("doc_id % 2 = 1")
    outcome, _, _ = search.ingested(old, new, link=None)
    return outcome.groupBy("action").agg(F.count("*").alias("n"))


def learned_processes(spark, d):
    """L3: a user's events of a day as a process run; the runs of the first half of the days make the known processes."""
    e = read(spark, d, "events")
    run = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    runs = e.groupBy(run.alias("run_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("day").alias("task_type")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("steps"), (F.sum("value") > 50).alias("success"), F.sum("value").alias("duration")
    )
    runs = materialize(runs, "runs")
    middle = e.agg(F.date_format(F.percentile_approx(F.col("ts").cast("timestamp"), 0.5), "yyyy-MM-dd").alias("m")).first()["m"]
    none = spark.createDataFrame([], "process_id string, task_type string, steps array<string>")
    zero = spark.createDataFrame([], "process_id string, executions long, success_rate double, avg_duration double")
    known, stats = learning.learned_processes(none, zero, runs.where(F.col("day") < middle))
    known, stats = learning.learned_processes(known, stats, runs.where(F.col("day") >= middle))
    return stats.agg(F.count("*").alias("n_processes"), F.sum("executions").alias("executions"), F.round(F.sum(F.col("executions") * F.col("success_rate")), 6).alias("successes"))


def fitted_vectors(spark, d):
    """E3 with fitted word weights: local embeddings of all texts."""
    return learning.fitted_vectors(read(spark, d, "documents"), "doc_id", "text")


def learned_patterns(spark, d):
    """L2: the records of each label as extracts of a batch, learned twice: the second time every pattern is known."""
    e = read(spark, d, "embeddings").select(F.col("label").alias("batch"), "vec_id", V.doubles("embedding").alias("vec"), ((F.col("vec_id") % 10) / 10).alias("importance"))
    none = spark.createDataFrame([], "id string, centroid array<double>, n long, avg_importance double")
    once = materialize(learning.learned_patterns(e, "batch", "vec_id", "vec", none, 0.3), "patterns")
    again = learning.learned_patterns(e, "batch", "vec_id", "vec", once.drop("confidence"), 0.3)
    return again.agg(F.count("*").alias("n_patterns"), F.sum("n").alias("n_extracts")).join(once.agg(F.count("*").alias("n_first"), F.sum("n").alias("n_first_extracts")))


def delivered_events(spark, d):
    """ST1: events delivered to three subscriptions: a type, every event since a day, and one event only."""
    subscriptions = spark.createDataFrame([("typed", "click", None, False), ("late", "*", "2024-01-20", False), ("first", None, None, True)], "subscriber string, event_type string, day string, once boolean")
    subscriptions = subscriptions.withColumn("since", F.col("day").cast("timestamp_ntz"))
    return events.deliveries(read(spark, d, "events"), subscriptions).groupBy("subscriber", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def explained_links(spark, d):
    """A sentence for every link that forward inference gives."""
    f = inference.forward(graph.clean_edges(read(spark, d, "synapses")))
    return f.select("id", "inferred", learning.explained(F.round("confidence", 2), F.col("edge_type"), F.col("id"), F.col("inferred")).alias("explanation"))


QUERIES = {
    f.__name__: f
    for f in (
        merkle_edited, merkle_equal, merkle_batch_verified, word_windows, unified_inference, goal_recommendations, probability_field, inference_stats, connections,
        by_merkle_root, index_search, index_updates, found_with_records, search_records, search_filtered, ingest_outcome, learned_processes, fitted_vectors, learned_patterns, delivered_events, explained_links,
    )
}

_EDITED = _TREE.replace(
    "h AS (SELECT doc_id, idx::INTEGER AS idx,",
    "h0 AS (SELECT doc_id, idx::INTEGER AS idx,",
).replace(
    "FROM c)",
    """FROM c),
h AS (
  SELECT doc_id, idx, CASE WHEN doc_id % 3 = 0 AND idx = 0 THEN sha256('first') ELSE hash END AS hash FROM h0
  UNION ALL SELECT doc_id, max(idx) + 1, sha256('last') FROM h0 WHERE doc_id % 3 = 0 GROUP BY 1)""",
    1,
)
_USABLE = f"""
r AS (
  SELECT id, created_at, merkle_root, embedding::DOUBLE[] AS v FROM (
    SELECT {key('id')} AS id, created_at, merkle_root, deleted_at, embedding FROM neurons WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {key('id')} ORDER BY updated_at DESC NULLS LAST, deleted_at DESC NULLS LAST, created_at DESC NULLS LAST, merkle_root DESC NULLS LAST) = 1)
  WHERE deleted_at IS NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
goals AS (SELECT id AS attractor, v AS g, 0.9::DOUBLE - 0.1::DOUBLE * i AS strength, 8 - i AS priority FROM (SELECT *, row_number() OVER (ORDER BY id) AS i FROM r) WHERE i <= 3),
near AS (SELECT r.id, attractor, list_cosine_similarity(v, g) AS s, strength, strength * exp(-(1 - list_cosine_similarity(v, g)) / 0.7::DOUBLE) * priority / 10 AS influence FROM r, goals)
"""

SQL = {
    "merkle_edited": _EDITED + "SELECT doc_id, hash AS root, level AS height FROM t WHERE width = 1",
    "merkle_equal": "SELECT doc_id, doc_id % 3 <> 0 AS equal, true AS known FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0",
    "merkle_batch_verified": "SELECT doc_id, doc_id % 5 <> 0 AS valid FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0",
    "word_windows": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, unnest(range(0, ceil(greatest(0, len(w) - 160) / 120.0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i AS window, len(list_slice(w, i * 120 + 1, i * 120 + 160)) AS n_words, sha256(encode(array_to_string(list_slice(w, i * 120 + 1, i * 120 + 160), ' '))) AS content FROM k""",
    "unified_inference": _FIRST.rstrip()
    + ","
    + _USABLE.rstrip()
    + """,
n AS (SELECT id, count(*) FILTER (direction = 'forward') AS n_forward, count(*) FILTER (direction = 'backward') AS n_backward FROM inf GROUP BY 1),
dom AS (SELECT id, attractor, influence FROM near WHERE influence > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY influence DESC, attractor) = 1),
tot AS (SELECT id, sum(influence) AS total_influence FROM near GROUP BY 1),
st AS (SELECT source_id AS id, target_id AS state, sum(abs(weight)) AS p, sum(sum(abs(weight))) OVER (PARTITION BY source_id) AS s FROM e GROUP BY 1, 2),
ent AS (SELECT id, sum(CASE WHEN p > 0 THEN -p / s * log2(p / s) ELSE 0 END) AS entropy, arg_min(state, (-p / s, state)) AS likeliest FROM st WHERE s > 0 GROUP BY 1),
tops AS (SELECT id, count(*) AS n_recommended, max(score) AS best FROM best WHERE rank <= 5 GROUP BY 1)
SELECT r.id, coalesce(n_forward, 0) AS n_forward, coalesce(n_backward, 0) AS n_backward, attractor, round(influence, 6) AS influence, round(total_influence, 6) AS total_influence,
       round(entropy, 6) AS entropy, likeliest, coalesce(n_recommended, 0) AS n_recommended, round(best, 6) AS best
FROM r LEFT JOIN n USING (id) LEFT JOIN dom USING (id) LEFT JOIN tot USING (id) LEFT JOIN ent USING (id) LEFT JOIN tops USING (id)""",
    "goal_recommendations": _FIRST.rstrip()
    + """,
goal AS (SELECT source_id AS id, min(target_id) AS inferred, 'goal' AS kind, 0.8::DOUBLE AS score FROM e WHERE edge_type = 'CAUSAL' AND source_id <> target_id GROUP BY 1),
every AS (SELECT id, inferred, kind, score FROM rec UNION ALL SELECT * FROM goal)
SELECT id, inferred, kind, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, inferred, kind) AS rank FROM every
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, inferred, kind) <= 5""",
    "probability_field": "WITH " + _USABLE + "SELECT attractor, id, round(s * strength, 6) AS gradient FROM near WHERE s * strength > 0.05",
    "inference_stats": _FIRST.rstrip()
    + """,
o AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at DESC, weight DESC) AS k, count(*) OVER (PARTITION BY source_id, target_id) AS n
      FROM e WHERE created_at IS NOT NULL AND edge_type = 'CAUSAL'),
c AS (SELECT source_id, target_id, sum(weight * 0.5::DOUBLE ** least(k, n - 1)) AS strength FROM o GROUP BY 1, 2)
SELECT count(*) AS causal_relations, round(coalesce(avg(strength), 0), 6) AS average_strength, (SELECT count(*) FROM inf WHERE direction = 'backward') AS cached_hypotheses FROM c""",
    "connections": _FIRST.rstrip()
    + "\nSELECT source_id, target_id, id, edge_type, weight FROM e QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at NULLS LAST, id) = 1",
    "by_merkle_root": "WITH " + _USABLE + "SELECT id, merkle_root FROM r WHERE merkle_root = (SELECT min(merkle_root) FROM r) ORDER BY created_at, id LIMIT 1",
    "index_search": _TOP + "SELECT id, other, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "index_updates": _TOP
    + """, k AS (SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s WHERE other % 7 <> 0)
      SELECT id, other, round(score, 6) AS score, rank FROM k WHERE rank <= 5""",
    "found_with_records": """
WITH t AS (SELECT b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY s DESC, b.vec_id LIMIT 10)
SELECT vec_id, round(s, 6) AS score, n_chars, 1::BIGINT AS accesses FROM t JOIN documents ON doc_id = vec_id""",
    "delivered_events": """
WITH d AS (
  SELECT 'typed' AS subscriber, event_id, event_type FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'late', event_id, event_type FROM events WHERE ts >= '2024-01-20'
  UNION ALL (SELECT 'first', event_id, event_type FROM events ORDER BY ts, event_id LIMIT 1))
SELECT subscriber, event_type, count(*) AS n, min(event_id) AS first_event FROM d GROUP BY 1, 2""",
    "explained_links": _FIRST
    + """SELECT id, inferred, id || ' leads to ' || inferred || ' (' || lower(edge_type) || ', confidence ' || round(round(confidence, 2) * 100)::BIGINT || '%)' AS explanation FROM inf WHERE direction = 'forward'""",
    "search_filtered": """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1),
c AS (SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY s DESC, id LIMIT 40),
f AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rank FROM c WHERE s >= 0.1 AND label IN (3, 5))
SELECT id, round(s, 6) AS score, rank FROM f WHERE rank <= 20""",
    "ingest_outcome": """
WITH old AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 AND text <> ''),
new AS (SELECT text, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND text <> '' GROUP BY 1),
o AS (SELECT n, new.text IN (FROM old) AS known FROM new)
SELECT action, n::BIGINT AS n FROM (
  SELECT 'merged' AS action, sum(CASE WHEN known THEN n ELSE n - 1 END) AS n FROM o UNION ALL SELECT 'created', count(*) FILTER (NOT known) FROM o) WHERE n > 0""",
}
