"""Graph, inference and path queries over ``synapses``, ``neuron_list`` and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlattice.functions.keys import tidy
from memlattice.operators import attractors, graph, inference, learning
from memlattice.plans.data_problems import key
from memlattice.sources.tables import read


def _edges(spark, d):
    return graph.clean_edges(read(spark, d, "synapses"))


def _items(spark, d):
    return read(spark, d, "neuron_list").select(tidy("id").alias("id"), "source_type", "created_at", "access_count", "chunk_count").dropDuplicates(["id"])


def _starts(spark, d, n=5):
    """The ``n`` records with the most outgoing edges, ties by id: a top-k report."""
    return graph.degrees(_edges(spark, d)).orderBy(F.desc("out_degree"), "node").limit(n).select(F.col("node").alias("start"))


def edge_table(spark, d):
    """Cleaned edges."""
    return _edges(spark, d).select("id", "source_id", "target_id", "edge_type", "weight", "activation_count", "bidirectional")


def node_degrees(spark, d):
    """Degrees of every record."""
    return graph.degrees(_edges(spark, d)).select("node", "out_degree", "in_degree", F.round("out_weight", 6).alias("out_weight"))


def graph_stats(spark, d):
    """A2."""
    return graph.graph_stats(_edges(spark, d)).select("edge_type", "n_edges", F.round("avg_weight", 6).alias("avg_weight"), "activations", "n_bidirectional")


def prune_counts(spark, d):
    """F13 with weight 0.3 and 3 activations."""
    return graph.prune_counts(_edges(spark, d), 0.3, 3)


def pruned_edges(spark, d):
    """F13."""
    return graph.pruned(_edges(spark, d), 0.3, 3).select("id", "source_id", "target_id", "weight")


def plasticity(spark, d):
    """Strengthened and weakened weights."""
    return _edges(spark, d).select("id", "source_id", "target_id", "edge_type", F.round(graph.strengthened(), 6).alias("stronger"), F.round(graph.weakened(), 6).alias("weaker"))


def bfs_levels(spark, d):
    """Hops from the five records of most edges, four at most."""
    return graph.bfs(_edges(spark, d), _starts(spark, d), 4).select("start", "node", "hops")


def bfs_trees(spark, d):
    """Parents and weights of the breadth-first trees."""
    return graph.bfs(_edges(spark, d), _starts(spark, d), 3).select("start", "node", "hops", "parent", F.round("total_weight", 6).alias("total_weight"))


def _ends(spark, d):
    rows = _starts(spark, d, 2).collect()  # two ids
    return [r["start"] for r in rows]


def shortest_path(spark, d):
    """G8 between the two records of most edges."""
    a, b = _ends(spark, d)
    return graph.shortest_path(_edges(spark, d), a, b)


def causal_chain(spark, d):
    """B5 between the same."""
    a, b = _ends(spark, d)
    return inference.causal_chain(_edges(spark, d), a, b)


def components(spark, d):
    """Weakly connected components of all ends of edges."""
    e = _edges(spark, d)
    ids = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.components(ids, e)


def depth_first_paths(spark, d):
    """G5."""
    return graph.ordered_paths(_edges(spark, d), _starts(spark, d), 3, graph.depth_first)


def weighted_paths(spark, d):
    """G6."""
    return graph.ordered_paths(_edges(spark, d), _starts(spark, d), 3, graph.best_first)


def random_walks(spark, d):
    """G7 from every record with edges, three steps."""
    s = _edges(spark, d).select(F.col("source_id").alias("start")).distinct()
    return graph.random_walks(_edges(spark, d), s, 3, 11).select("start", F.array_join("path", ">").alias("path"), F.round("total_weight", 6).alias("total_weight"))


def _active(spark, d):
    return _items(spark, d).where("access_count >= 10").select(F.col("id").alias("node"))


def hebbian(spark, d):
    """Edges between records accessed ten times or more."""
    return graph.reinforced(_edges(spark, d), _active(spark, d)).select("id", "source_id", "target_id", F.round("weight", 6).alias("weight"), "activation_count")


def _ranked(spark, d):
    """Items of a source type and day ranked by accesses: the sessions of the plasticity queries."""
    i = _items(spark, d).where("source_type IS NOT NULL").withColumn("session", F.concat_ws("/", "source_type", F.date_format("created_at", "yyyy-MM-dd")))
    return i.select("session", F.col("id").alias("node"), F.row_number().over(Window.partitionBy("session").orderBy(F.desc_nulls_last("access_count"), "id")).alias("rank"))


def inhibition(spark, d):
    """G12, W2."""
    return graph.inhibited(_ranked(spark, d), _edges(spark, d)).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


def episodes(spark, d):
    """Temporal links of records in order of creation, by source type and day."""
    i = _items(spark, d).where("source_type IS NOT NULL").withColumn("episode", F.concat_ws("/", "source_type", F.date_format("created_at", "yyyy-MM-dd")))
    e = i.select("episode", F.struct("created_at", "id").alias("position"), F.col("id").alias("node"))
    return graph.episode_edges(e).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


def peer_weights(spark, d):
    """Within the sessions."""
    return graph.peer_weights(_edges(spark, d), _ranked(spark, d).select("session", "node")).where("excitation > 0 OR inhibition > 0").select("session", "node", "excitation", "inhibition")


def fk_edges(spark, d):
    """Orders to customers, customers to nations, nations to regions."""
    r = lambda n: read(spark, d, n)
    a = graph.key_edges(r("orders"), "o_orderkey", "o_custkey", r("customer"), "c_custkey", "orders", "customer")
    b = graph.key_edges(r("customer"), "c_custkey", "c_nationkey", r("nation"), "n_nationkey", "customer", "nation")
    c = graph.key_edges(r("nation"), "n_nationkey", "n_regionkey", r("region"), "r_regionkey", "nation", "region")
    return a.unionByName(b).unionByName(c)


def forward_infer(spark, d):
    """B2."""
    return inference.forward(_edges(spark, d)).select("id", "inferred", "edge_type", F.round("confidence", 6).alias("confidence"))


def backward_infer(spark, d):
    """B3."""
    return inference.backward(_edges(spark, d)).select("id", "inferred", "edge_type", F.round("confidence", 6).alias("confidence"))


def infer_both(spark, d):
    """B1, U6."""
    return inference.infer(_edges(spark, d)).groupBy("direction", "edge_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def two_hop(spark, d):
    """B4, J4."""
    return inference.two_hop(_edges(spark, d)).select("id", "inferred", F.round("confidence", 6).alias("confidence"))


def recommendations(spark, d):
    """K12."""
    return inference.recommendations(inference.infer(_edges(spark, d))).select("id", "inferred", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def causal_strengths(spark, d):
    """Repeated observations of a pair."""
    e = _edges(spark, d).where("created_at IS NOT NULL")
    return inference.causal_strengths(e.select(F.col("source_id").alias("cause"), F.col("target_id").alias("effect"), F.col("created_at").alias("at"), F.col("weight").alias("strength"))).select("cause", "effect", F.round("strength", 6).alias("strength"), "n")


def hypothesis_validation(spark, d):
    """Hypotheses per record, edges as evidence (inhibitory ones contradict)."""
    e = _edges(spark, d)
    h = e.select(F.col("source_id").alias("hypothesis_id")).distinct().withColumn("plausibility", F.lit(0.8))
    v = e.select(F.col("source_id").alias("hypothesis_id"), (F.col("edge_type") != "INHIBITORY").alias("supports"), F.abs("weight").alias("weight"))
    return inference.validated(h, v).select("hypothesis_id", F.round("plausibility", 6).alias("plausibility"))


def path_costs(spark, d):
    """A27 of the weighted paths."""
    p = weighted_paths(spark, d).select(F.sha2(F.concat_ws(">", "path"), 256).alias("path_id"), F.col("path").alias("nodes")).dropDuplicates(["path_id"])
    return attractors.path_costs(p, _edges(spark, d))


def _goal(spark, d):
    from memlattice.operators.similarity import centroids

    v = read(spark, d, "embeddings")
    e = _edges(spark, d)
    n = v.count()
    ids = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    vec = ids.withColumn("vec_id", F.pmod(F.xxhash64("id"), F.lit(n))).join(v, "vec_id").select("id", F.col("embedding").alias("vec"))
    goal = centroids(v.where("label = 1"), "label", "embedding").first()["centroid"]
    return e, vec, goal


def goal_paths(spark, d):
    """A* with two alternatives towards the centroid of label 1."""
    e, vec, goal = _goal(spark, d)
    return attractors.goal_paths(e.where("weight > 0"), _starts(spark, d), vec.withColumn("vec", F.when(F.pmod(F.xxhash64("id"), F.lit(50)) == 0, F.array(*[F.lit(float(x)) for x in goal])).otherwise(F.col("vec").cast("array<double>"))), goal, 4, 3)


def meeting_paths(spark, d):
    """From both ends."""
    e, vec, goal = _goal(spark, d)
    return attractors.goal_paths(e.where("weight > 0"), _starts(spark, d), vec.withColumn("vec", F.when(F.pmod(F.xxhash64("id"), F.lit(50)) == 0, F.array(*[F.lit(float(x)) for x in goal])).otherwise(F.col("vec").cast("array<double>"))), goal, 4, 1, True)


def unified_infer(spark, d):
    """O1 in part: counts of forward and backward inferences and recommendations; unified_inference has the whole."""
    both = inference.infer(_edges(spark, d))
    rec = inference.recommendations(both)
    n = both.groupBy("id").agg(F.count_if(F.col("direction") == "forward").alias("n_forward"), F.count_if(F.col("direction") == "backward").alias("n_backward"))
    top = rec.groupBy("id").agg(F.max("score").alias("best"), F.count("*").alias("n_recommended"))
    return n.join(top, "id", "left").select("id", "n_forward", "n_backward", F.round("best", 6).alias("best"), F.coalesce("n_recommended", F.lit(0)).alias("n_recommended"))


def outcome_edges(spark, d):
    """L4: successful events between a user's records as outcomes."""
    e = _edges(spark, d)
    out = e.select("source_id", "target_id", (F.col("activation_count") > 5).alias("success"))
    return learning.outcome_edges(out, e.where("edge_type <> 'SEMANTIC'")).select("source_id", "target_id", "edge_type", F.round("weight", 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_table, node_degrees, graph_stats, prune_counts, pruned_edges, plasticity, bfs_levels, bfs_trees, shortest_path, causal_chain, components, depth_first_paths,
        weighted_paths, random_walks, hebbian, inhibition, episodes, peer_weights, fk_edges, forward_infer, backward_infer, infer_both, two_hop, recommendations,
        causal_strengths, hypothesis_validation, path_costs, goal_paths, meeting_paths, unified_infer, outcome_edges,
    )
}

_E = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT {key('id')} AS id, {key('source_id')} AS source_id, {key('target_id')} AS target_id, upper(trim(edge_type)) AS edge_type, weight,
         coalesce(activation_count, 0) AS activation_count, coalesce(bidirectional, false) AS bidirectional, created_at
  FROM synapses WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND weight IS NOT NULL),
items AS (SELECT DISTINCT ON (id) * FROM (SELECT {key('id')} AS id, source_type, created_at, access_count FROM neuron_list)),
starts AS (SELECT source_id AS start FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
"""
_FIRST = _E + """, f1 AS (SELECT * FROM e WHERE source_id <> target_id QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at NULLS LAST, id) = 1),
fwd AS (SELECT source_id AS id, target_id AS inferred, edge_type, weight * CASE WHEN edge_type = 'CAUSAL' THEN 1.2::DOUBLE ELSE 1 END AS c FROM f1),
bwd AS (SELECT target_id AS id, source_id AS inferred, edge_type, weight * 0.8::DOUBLE * CASE edge_type WHEN 'CAUSAL' THEN 1.3::DOUBLE WHEN 'TEMPORAL' THEN 1.1::DOUBLE ELSE 1 END AS c FROM f1),
inf AS (
  SELECT id, inferred, edge_type, least(1, c) AS confidence, 'forward' AS direction FROM fwd WHERE c >= 0.3 UNION ALL
  SELECT id, inferred, edge_type, least(1, c), 'backward' FROM bwd WHERE c >= 0.3),
top AS (SELECT * FROM inf WHERE confidence > 0.5 QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY confidence DESC, inferred) <= CASE direction WHEN 'forward' THEN 3 ELSE 2 END),
rec AS (SELECT id, inferred, direction AS kind, confidence * CASE direction WHEN 'forward' THEN 1 ELSE 0.9::DOUBLE END AS score FROM top),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, inferred, kind) AS rank FROM rec)
"""
_SESSIONS = """, r AS (
  SELECT source_type || '/' || strftime(created_at, '%Y-%m-%d') AS session, id AS node, created_at,
         row_number() OVER (PARTITION BY source_type, strftime(created_at, '%Y-%m-%d') ORDER BY access_count DESC NULLS LAST, id) AS rank
  FROM items WHERE source_type IS NOT NULL)
"""



def _level(h: int) -> str:
    """SQL: the nodes that hop ``h`` reaches first, each from the parent of the best total weight."""
    return f""",
l{h} AS (
  SELECT start, target_id AS node, max({{'w': b.w + e.weight, 'p': e.source_id}}) AS x FROM s{h - 1} b JOIN e ON e.source_id = b.node
  WHERE b.hops = {h - 1} AND NOT EXISTS (SELECT 1 FROM s{h - 1} y WHERE y.start = b.start AND y.node = e.target_id) GROUP BY 1, 2),
s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT start, node, {h}, x.p, x.w FROM l{h})"""


SQL = {
    "edge_table": _E + "SELECT id, source_id, target_id, edge_type, weight, activation_count, bidirectional FROM e",
    "node_degrees": _E
    + """SELECT node, sum(o)::BIGINT AS out_degree, sum(1 - o)::BIGINT AS in_degree, round(sum(w), 6) AS out_weight FROM (
        SELECT source_id AS node, 1 AS o, weight AS w FROM e UNION ALL SELECT target_id, 0, 0 FROM e) GROUP BY 1""",
    "graph_stats": _E + "SELECT edge_type, count(*) AS n_edges, round(avg(weight), 6) AS avg_weight, sum(activation_count)::BIGINT AS activations, count(*) FILTER (bidirectional) AS n_bidirectional FROM e GROUP BY 1",
    "prune_counts": _E + "SELECT count(*) FILTER (abs(weight) < 0.3 AND activation_count < 3) AS pruned, count(*) FILTER (NOT (abs(weight) < 0.3 AND activation_count < 3)) AS remaining FROM e",
    "pruned_edges": _E + "SELECT id, source_id, target_id, weight FROM e WHERE NOT (abs(weight) < 0.3 AND activation_count < 3)",
    "plasticity": _E + "SELECT id, source_id, target_id, edge_type, round(least(1, weight + 0.1::DOUBLE), 6) AS stronger, round(greatest(0, weight - 0.1::DOUBLE), 6) AS weaker FROM e",
    "bfs_levels": _E
    + """, b AS (SELECT start, start AS node, 0 AS hops FROM starts UNION
          SELECT b.start, e.target_id, b.hops + 1 FROM b JOIN e ON e.source_id = b.node WHERE b.hops < 4)
      SELECT start, node, min(hops) AS hops FROM b GROUP BY 1, 2""",
    "components": _E
    + """, l AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e UNION SELECT source_id, source_id FROM e UNION SELECT target_id, target_id FROM e),
      c AS (SELECT a AS node, min(b) AS label, 0 AS i FROM l GROUP BY 1 UNION ALL
            SELECT l.a, min(c.label), c.i + 1 FROM c JOIN l ON l.b = c.node WHERE c.i < 14 GROUP BY l.a, c.i)
      SELECT node, min(label) AS component FROM c GROUP BY 1""",
    "hebbian": _E
    + """, act AS (SELECT id FROM items WHERE access_count >= 10)
      SELECT id, source_id, target_id, round(least(1, weight + 0.05::DOUBLE * (1 - weight)), 6) AS weight, activation_count + 1 AS activation_count FROM e
      WHERE edge_type <> 'INHIBITORY' AND source_id <> target_id AND source_id IN (SELECT id FROM act) AND target_id IN (SELECT id FROM act)""",
    "inhibition": _E
    + _SESSIONS
    + """, p AS (SELECT DISTINCT a.node AS source_id, b.node AS target_id FROM r a JOIN r b ON a.session = b.session AND a.rank <= 3 AND b.rank > a.rank),
      h AS (SELECT source_id, target_id, min(weight) AS w FROM e WHERE edge_type = 'INHIBITORY' GROUP BY 1, 2)
      SELECT p.source_id, p.target_id, round(CASE WHEN w IS NULL THEN -0.05::DOUBLE ELSE greatest(-1, w - 0.03::DOUBLE * (1 - abs(w))) END, 6) AS weight
      FROM p LEFT JOIN h ON h.source_id = p.source_id AND h.target_id = p.target_id""",
    "episodes": _E
    + _SESSIONS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY created_at, node) AS i FROM r)
      SELECT a.node AS source_id, b.node AS target_id, round(0.3::DOUBLE / min(b.i - a.i), 6) AS weight
      FROM o a JOIN o b ON a.session = b.session AND b.i - a.i BETWEEN 1 AND 2 AND a.node <> b.node GROUP BY 1, 2""",
    "peer_weights": _E
    + _SESSIONS
    + """, x AS (SELECT a.session, a.node AS s, b.node AS t, e.* FROM e JOIN r a ON a.node = e.source_id JOIN r b ON b.node = e.target_id AND b.session = a.session),
      u AS (SELECT session, s AS node, max(weight) AS up, 0::DOUBLE AS down FROM x WHERE edge_type <> 'INHIBITORY' AND weight > 0 GROUP BY 1, 2 UNION ALL
            SELECT session, t, 0, max(abs(weight)) FROM x WHERE edge_type = 'INHIBITORY' GROUP BY 1, 2)
      SELECT session, node, max(up) AS excitation, max(down) AS inhibition FROM u GROUP BY 1, 2 HAVING max(up) > 0 OR max(down) > 0""",
    "fk_edges": """
      SELECT 'orders:' || o_orderkey AS source_id, 'customer:' || c_custkey AS target_id, 'ASSOCIATIVE' AS edge_type, 0.8::DOUBLE AS weight FROM orders JOIN customer ON o_custkey = c_custkey
      UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || n_nationkey, 'ASSOCIATIVE', 0.8 FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || r_regionkey, 'ASSOCIATIVE', 0.8 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "forward_infer": _FIRST + "SELECT id, inferred, edge_type, round(confidence, 6) AS confidence FROM inf WHERE direction = 'forward'",
    "backward_infer": _FIRST + "SELECT id, inferred, edge_type, round(confidence, 6) AS confidence FROM inf WHERE direction = 'backward'",
    "infer_both": _FIRST + "SELECT direction, edge_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM inf GROUP BY 1, 2",
    "two_hop": _FIRST
    + """SELECT a.source_id AS id, b.target_id AS inferred, round(max(a.weight * b.weight * 0.85::DOUBLE), 6) AS confidence
      FROM f1 a JOIN f1 b ON a.target_id = b.source_id WHERE a.weight > 0 AND b.weight > 0 AND a.source_id <> b.target_id AND a.weight * b.weight * 0.85::DOUBLE >= 0.3
        AND NOT EXISTS (SELECT 1 FROM f1 c WHERE c.weight > 0 AND c.source_id = a.source_id AND c.target_id = b.target_id) GROUP BY 1, 2""",
    "recommendations": _FIRST + "SELECT id, inferred, kind, round(score, 6) AS score, rank FROM best WHERE rank <= 5",
    "unified_infer": _FIRST
    + """, n AS (SELECT id, count(*) FILTER (direction = 'forward') AS n_forward, count(*) FILTER (direction = 'backward') AS n_backward FROM inf GROUP BY 1),
      t AS (SELECT id, max(score) AS best, count(*) AS n FROM best WHERE rank <= 5 GROUP BY 1)
      SELECT n.id, n_forward, n_backward, round(t.best, 6) AS best, coalesce(t.n, 0) AS n_recommended FROM n LEFT JOIN t ON t.id = n.id""",
    "hypothesis_validation": _E
    + """SELECT source_id AS hypothesis_id, round(CASE WHEN sum(abs(weight)) = 0 THEN 0.8::DOUBLE
        ELSE coalesce(sum(abs(weight)) FILTER (edge_type <> 'INHIBITORY'), 0) / sum(abs(weight)) * 0.8::DOUBLE END, 6) AS plausibility FROM e GROUP BY 1""",
    "causal_strengths": _E
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at DESC, weight DESC) AS k, count(*) OVER (PARTITION BY source_id, target_id) AS n
          FROM e WHERE created_at IS NOT NULL)
      SELECT source_id AS cause, target_id AS effect, round(sum(weight * 0.5::DOUBLE ** least(k, n - 1)), 6) AS strength, count(*) AS n FROM o GROUP BY 1, 2""",
    "bfs_trees": _E.rstrip()
    + ",\ns0 AS (SELECT start, start AS node, 0 AS hops, NULL::VARCHAR AS parent, 0::DOUBLE AS w FROM starts)"
    + _level(1)
    + _level(2)
    + _level(3)
    + " SELECT start, node, hops, parent, round(w, 6) AS total_weight FROM s3",
    "random_walks": _E
    + """, p AS (
        SELECT source_id, target_id, id, weight, sum(weight) OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY source_id) AS upto,
               row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, id) AS i FROM e WHERE weight > 0),
      w AS (
        SELECT DISTINCT source_id AS start, source_id AS node, source_id AS path, 0::DOUBLE AS total, 0 AS step FROM e
        UNION ALL
        SELECT start, x.target_id, path || '>' || x.target_id, total + x.weight, step + 1 FROM (
          SELECT w.*, ('0x' || substr(md5('11:' || start || ':' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w WHERE step < 3) v
        JOIN p x ON x.source_id = v.node AND x.i = (SELECT min(i) FROM p y WHERE y.source_id = v.node AND v.u < y.upto))
      SELECT start, path, round(total, 6) AS total_weight FROM w QUALIFY step > 0 AND row_number() OVER (PARTITION BY start ORDER BY step DESC) = 1""",
    "outcome_edges": _E
    + """, h AS (SELECT source_id, target_id, count(*) AS n FROM e WHERE activation_count > 5 GROUP BY 1, 2),
      x AS (SELECT source_id, target_id, arg_min(edge_type, id) AS t, arg_min(weight, id) AS w FROM e WHERE edge_type <> 'SEMANTIC' GROUP BY 1, 2)
      SELECT h.source_id, h.target_id, coalesce(t, 'CAUSAL') AS edge_type, round(CASE WHEN w IS NULL THEN least(1, 0.5 + 0.05::DOUBLE * (n - 1)) ELSE least(1, w + 0.05::DOUBLE * n) END, 6) AS weight
      FROM h LEFT JOIN x ON x.source_id = h.source_id AND x.target_id = h.target_id""",
}
