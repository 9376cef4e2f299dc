"""Record, dimension, export and set queries over ``neuron_list``, ``neurons``, ``chunks`` and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions.keys import current_rows, tidy
from memlattice.operators import dimensions as D
from memlattice.operators import graph, learning, merkle, store
from memlattice.plans.data_problems import key
from memlattice.sources import bridge
from memlattice.sources.tables import read


def _items(spark, d):
    """neuron_list with tidied ids, each once (of repeats the tags' sorted union)."""
    i = read(spark, d, "neuron_list").select(tidy("id").alias("id"), F.lower("source_type").alias("source_type"), F.filter(F.transform("tags", tidy), lambda t: t.isNotNull() & (t != "")).alias("tags"), "created_at", "access_count", "chunk_count")
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return i.groupBy("id").agg(F.max("source_type").alias("source_type"), tags.alias("tags"), F.max("created_at").alias("created_at"), F.max("access_count").alias("access_count"), F.max("chunk_count").alias("chunk_count"))


def tag_counts(spark, d):
    """A1."""
    return store.tag_counts(_items(spark, d))


def by_tags(spark, d):
    """F2."""
    return store.by_tags(_items(spark, d), ["schema", "rack"]).select("id")


def by_source(spark, d):
    """Items, accesses and chunks per source type."""
    return _items(spark, d).groupBy("source_type").agg(F.count("*").alias("n"), F.sum("access_count").alias("accesses"), F.sum("chunk_count").alias("chunks"))


def recent(spark, d):
    """K6: the ten newest items."""
    return store.most(_items(spark, d), "created_at").select("id", "created_at")


def most_accessed(spark, d):
    """K6: the ten most accessed."""
    return store.most(_items(spark, d), "access_count").select("id", "access_count")


def listing(spark, d):
    """K8, S3: a page."""
    return store.page(_items(spark, d), limit=50, offset=100).select("id")


def context(spark, d):
    """K7."""
    i = _items(spark, d).withColumn("text", F.array_join("tags", " "))
    return store.context(i, "created_at", "access_count", "text")


def tag_merge(spark, d):
    """Tags of the list joined with those of the record's metadata."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["metadata"])
    own = n.select("id", F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>").alias("_m"))
    j = _items(spark, d).join(own, "id")
    return j.select("id", F.array_join(F.array_sort(store.merged_tags(F.col("tags"), F.transform("_m", tidy))), ",").alias("tags"))


def current_records(spark, d):
    """Latest version of every record."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["updated_at", "created_at", "deleted_at", "merkle_root"])
    return n.select("id", "updated_at", "created_at", "deleted_at", "merkle_root")


def soft_deleted(spark, d):
    """Edges left when deleted records go."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["deleted_at"])
    _, e = store.deleted(n, graph.clean_edges(read(spark, d, "synapses")), n.where("deleted_at IS NOT NULL").select("id"))
    return e.select("id", "source_id", "target_id", "edge_type")


def access_log(spark, d):
    """Accesses after a log made from the edges' ends."""
    e = graph.clean_edges(read(spark, d, "synapses"))
    log = e.select(F.col("target_id").alias("id"), F.col("created_at").alias("accessed_at"))
    return store.accessed(_items(spark, d), log).select("id", "access_count", "last_accessed")


def edge_creation(spark, d):
    """Edges with existing ends, reversed where bidirectional."""
    n = read(spark, d, "neurons").select(tidy("id").alias("id"))
    return store.new_edges(graph.clean_edges(read(spark, d, "synapses")).drop("id"), n).select("source_id", "target_id", "edge_type", "weight")


def record_verify(spark, d):
    """Records checked against ``chunks``: names present, vector whole."""
    n = current_rows(read(spark, d, "neurons"), "id", "updated_at", ["chunk_hashes", "merkle_root", "embedding"])
    c = read(spark, d, "chunks").select(tidy("hash").alias("hash"), F.col("chunk_data").alias("data"))
    v = merkle.verified_records(n, "id", "chunk_hashes", "merkle_root", "embedding", c)
    return v.groupBy("chunks_ok", "root_ok", "vector_ok", "valid").agg(F.count("*").alias("n"))


def process_match(spark, d):
    """Tag lists as steps of runs, matched within their source type."""
    i = _items(spark, d).where("size(tags) >= 3 AND source_type IS NOT NULL")
    steps = i.select("id", "source_type", "tags")
    p = steps.groupBy("source_type", "tags").agg(F.min("id").alias("process_id"))
    runs = steps.select(F.col("id").alias("run_id"), F.col("source_type").alias("task_type"), F.col("tags").alias("steps"))
    found = learning.same_process(runs, p.select("process_id", F.col("source_type").alias("task_type"), F.col("tags").alias("steps")))
    return found


def process_stats(spark, d):
    """Outcomes of orders per priority."""
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("process_id"), (F.col("o_orderstatus") != "F").alias("success"), F.col("o_totalprice").alias("duration"))
    return learning.process_stats(o).select("process_id", "executions", F.round("success_rate", 6).alias("success_rate"), F.round("avg_duration", 4).alias("avg_duration"))


def dimension_registry(spark, d):
    """Y1, T10."""
    return D.registry_stats(D.base_registry(spark)).select("category", "n_dimensions")


def dimension_named(spark, d):
    """Vectors as named dimensions: projection, dense form again and sparse cosine to the first."""
    e = read(spark, d, "embeddings")
    m = D.named(F.col("embedding"), 64)
    first = e.where("vec_id = 0").select(m.alias("_f"))
    r = e.select("vec_id", m.alias("m")).join(first)
    return r.select("vec_id", F.round(D.projected(F.col("m"), ["sem_3"])["sem_3"], 6).alias("sem_3"), F.round(F.get(D.dense(F.col("m"), D.base_names(64)), F.lit(5)), 6).alias("d5"), F.round(D.sparse_cosine("m", "_f"), 6).alias("cosine"))


def dimension_expansion(spark, d):
    """Keyword dimensions of all texts."""
    return D.expansion(read(spark, d, "documents"), "doc_id", "text", D.base_registry(spark)).groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def row_text(spark, d):
    """Customer rows as text."""
    return read(spark, d, "customer").select("c_custkey", bridge.row_text("customer", ["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


def imported_keys(spark, d):
    """Lineitem rows named by their primary key, with their parent's name."""
    return bridge.imported(read(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], {"l_orderkey": ("orders", "o_orderkey")}).select("row_key", "parent_key")


def exported(spark, d):
    """Current records and edges as export rows."""
    return bridge.export_rows(_items(spark, d), ["schema"]).select("id", "tags", "source_type")


def sanitized(spark, d):
    """binary chunks wrapped and unwrapped again."""
    c = read(spark, d, "chunks").select(tidy("owner_id").alias("owner_id"), "idx", "chunk_data").dropDuplicates(["owner_id", "idx"])
    w = c.select("owner_id", "idx", "chunk_data", bridge.wrapped_binary(F.col("chunk_data")).alias("w"))
    return w.select("owner_id", "idx", (bridge.unwrapped_binary(F.col("w")) == F.col("chunk_data")).alias("same"), F.length("w").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_counts, by_tags, by_source, recent, most_accessed, listing, context, tag_merge, current_records, soft_deleted, access_log, edge_creation, record_verify,
        process_match, process_stats, dimension_registry, dimension_named, dimension_expansion, row_text, imported_keys, exported, sanitized,
    )
}

_I = f"""
WITH raw AS (SELECT {key('id')} AS id, lower(source_type) AS source_type, tags, created_at, access_count, chunk_count FROM neuron_list),
tg AS (SELECT DISTINCT id, {key('t')} AS tag FROM (SELECT id, unnest(tags) AS t FROM raw) WHERE t IS NOT NULL AND {key('t')} <> ''),
tl AS (SELECT id, list(tag ORDER BY tag) AS tags FROM tg GROUP BY 1),
items AS (
  SELECT r.id, max(source_type) AS source_type, coalesce(any_value(tl.tags), []) AS tags, max(created_at) AS created_at, max(access_count) AS access_count, max(chunk_count) AS chunk_count
  FROM raw r LEFT JOIN tl ON tl.id = r.id GROUP BY 1)
"""
_E = f"""
e AS (
  SELECT DISTINCT {key('id')} AS id, {key('source_id')} AS source_id, {key('target_id')} AS target_id, upper(trim(edge_type)) AS edge_type, weight, coalesce(bidirectional, false) AS bidirectional, created_at
  FROM synapses WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND weight IS NOT NULL),
n AS (SELECT DISTINCT {key('id')} AS id, updated_at, created_at, deleted_at, merkle_root FROM neurons QUALIFY updated_at = max(updated_at) OVER (PARTITION BY {key('id')}))
"""

SQL = {
    "context": _I
    + """, i AS (SELECT id, created_at, access_count, array_to_string(tags, ' ') AS text FROM items),
a AS (SELECT * FROM i ORDER BY access_count DESC NULLS LAST, id LIMIT 5), b AS (SELECT * FROM i ORDER BY created_at DESC NULLS LAST, id LIMIT 20),
u AS (SELECT * FROM a UNION SELECT * FROM b),
o AS (SELECT *, row_number() OVER (ORDER BY id NOT IN (SELECT id FROM a), created_at DESC NULLS LAST, id) AS position FROM u)
SELECT position::INTEGER AS position, id, CASE WHEN length(text) > 220 THEN substr(text, 1, 220) || '…' ELSE text END AS preview FROM o WHERE position <= 20""",
    "process_match": _I
    + """, s AS (SELECT id, source_type, tags FROM items WHERE len(tags) >= 3 AND source_type IS NOT NULL),
p AS (SELECT source_type, tags, min(id) AS process_id FROM s GROUP BY 1, 2),
j AS (
  SELECT s.id AS run_id, process_id, len(list_intersect(s.tags, p.tags))::DOUBLE / len(list_distinct(list_concat(s.tags, p.tags))) AS j
  FROM s JOIN p ON p.source_type = s.source_type AND abs(len(s.tags) - len(p.tags)) <= 2)
SELECT run_id, arg_min(process_id, (-j, process_id)) AS process_id FROM j WHERE j > 0.7 GROUP BY 1""",
    "tag_merge": _I
    + f""", cur AS (SELECT {key('id')} AS id, metadata FROM neurons WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {key('id')} ORDER BY updated_at DESC NULLS LAST, metadata DESC NULLS LAST) = 1),
own AS (
  SELECT id, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.tags') = 'ARRAY' THEN list_transform(list_filter(from_json(json_extract(metadata, '$.tags'), '["VARCHAR"]'), lambda t: true), lambda t: {key('t')}) END AS m FROM cur)
SELECT items.id, array_to_string(list_sort(list_distinct(list_concat(items.tags, coalesce(m, [])))), ',') AS tags FROM items JOIN own ON own.id = items.id""",
    "tag_counts": _I + "SELECT tag, count(*) AS n FROM tg GROUP BY 1",
    "by_tags": _I + "SELECT DISTINCT id FROM tg WHERE tag IN ('schema', 'rack')",
    "by_source": _I + "SELECT source_type, count(*) AS n, sum(access_count)::BIGINT AS accesses, sum(chunk_count)::BIGINT AS chunks FROM items GROUP BY 1",
    "recent": _I + "SELECT id, created_at FROM items ORDER BY created_at DESC NULLS LAST, id LIMIT 10",
    "most_accessed": _I + "SELECT id, access_count FROM items ORDER BY access_count DESC NULLS LAST, id LIMIT 10",
    "listing": _I + "SELECT id FROM items ORDER BY id LIMIT 50 OFFSET 100",
    "current_records": f"WITH {_E} SELECT id, updated_at, created_at, deleted_at, merkle_root FROM n",
    "soft_deleted": f"WITH {_E} SELECT id, source_id, target_id, edge_type FROM e WHERE source_id NOT IN (SELECT id FROM n WHERE deleted_at IS NOT NULL) AND target_id NOT IN (SELECT id FROM n WHERE deleted_at IS NOT NULL)",
    "access_log": _I
    + f""", {_E}, h AS (SELECT target_id AS id, count(*) AS n, max(created_at) AS t FROM e GROUP BY 1)
      SELECT items.id, coalesce(access_count, 0) + coalesce(h.n, 0) AS access_count, h.t AS last_accessed FROM items LEFT JOIN h ON h.id = items.id""",
    "edge_creation": f"""WITH {_E}, g AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))
      SELECT source_id, target_id, edge_type, weight FROM g UNION ALL SELECT target_id, source_id, edge_type, weight FROM g WHERE bidirectional""",
    "process_stats": "SELECT o_orderpriority AS process_id, count(*) AS executions, round(avg((o_orderstatus <> 'F')::INTEGER), 6) AS success_rate, round(avg(o_totalprice), 4) AS avg_duration FROM orders GROUP BY 1",
    "dimension_registry": "SELECT * FROM (VALUES ('semantic', 128::BIGINT), ('syntactic', 64), ('contextual', 96), ('relational', 64), ('abstract', 32)) t(category, n_dimensions)",
    "dimension_named": """SELECT b.vec_id, round(b.embedding[4]::DOUBLE, 6) AS sem_3, round(b.embedding[6]::DOUBLE, 6) AS d5,
        round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 0""",
    "row_text": "SELECT c_custkey, '[customer]' || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment || chr(10) || 'c_nationkey: ' || c_nationkey AS text FROM customer",
    "imported_keys": "SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber AS row_key, 'orders:' || l_orderkey AS parent_key FROM lineitem",
    "exported": _I + "SELECT id, array_to_string(tags, ',') AS tags, source_type FROM items WHERE list_contains(tags, 'schema')",
    "sanitized": f"""SELECT DISTINCT ON (owner_id, idx) {key('owner_id')} AS owner_id, idx, true AS same, (length(to_base64(chunk_data)) + length('{{"__binary":""}}'))::BIGINT AS n FROM chunks""",
}
