"""Text, chunk and Merkle queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions.hashing import java_hash, sha3_256
from memlattice.operators import chunks, learning, merkle
from memlattice.operators import hybrid
from memlattice.sources.tables import read

QUERY = "memory graph index"


def _d(spark, d):
    return read(spark, d, "documents")


def _fixed(spark, d, size=512, algorithm="sha2"):
    return chunks.fixed_chunks(_d(spark, d), "doc_id", F.encode("text", "UTF-8"), size, algorithm)


def fixed_chunks(spark, d):
    """C1, H1 (SHA-2)."""
    return _fixed(spark, d).select("doc_id", "idx", "byte_offset", "size", "hash")


def fixed_chunks_sha3(spark, d):
    """C1 with SHA3-256."""
    return _fixed(spark, d, 512, "sha3").select("doc_id", "idx", "hash")


def content_chunks(spark, d):
    """Content-defined chunks."""
    return chunks.content_chunks(_d(spark, d), "doc_id", F.encode("text", "UTF-8"), 256, 4096).select("doc_id", "idx", "byte_offset", "size", "hash")


def chunk_stats(spark, d):
    """A4, C5, S17."""
    return chunks.chunk_stats(_fixed(spark, d))


def chunk_dedup(spark, d):
    """A5, C5."""
    return chunks.dedup_report(_fixed(spark, d))


def chunk_store(spark, d):
    """Contents with their reference counts."""
    return chunks.stored(_fixed(spark, d))


def chunk_release(spark, d):
    """The store after the documents of odd ids are gone."""
    c = _fixed(spark, d)
    gone = c.where("doc_id % 2 = 1").select("hash", F.lit(1).alias("n"))
    return chunks.released(chunks.stored(c), gone).select("hash", "size", "ref_count")


def chunk_merge(spark, d):
    """Chunks joined again; the hash of the whole."""
    return chunks.merge(_fixed(spark, d), "doc_id").select("doc_id", F.sha2("data", 256).alias("content_hash"))


def chunk_integrity(spark, d):
    """Chunks of even documents against the names of all, with one byte more in documents that 7 divides."""
    c = _fixed(spark, d)
    held = c.where("doc_id % 2 = 0").withColumn("data", F.when(F.col("doc_id") % 7 == 0, F.concat("data", F.lit("x").cast("binary"))).otherwise(F.col("data")))
    return chunks.integrity(held, c, "sha2")


def merkle_roots(spark, d):
    """M1, M2 (SHA-2)."""
    return merkle.roots(merkle.tree(_fixed(spark, d), "doc_id", "idx", "hash", "sha2")).select(F.col("tree").alias("doc_id"), "root", "height")


def merkle_roots_sha3(spark, d):
    """M1 with SHA3-256."""
    return merkle.roots(merkle.tree(_fixed(spark, d, 512, "sha3"), "doc_id", "idx", "hash")).select(F.col("tree").alias("doc_id"), "root", "height", "n_leaves")


def _leaves(c):
    return c.select(F.col("doc_id").alias("tree"), F.col("idx").cast("long").alias("pos"), "hash")


def merkle_proofs(spark, d):
    """M3, M4: proofs of every leaf of every tree, verified."""
    c = _fixed(spark, d)
    n = merkle.tree(c, "doc_id", "idx", "hash", "sha2")
    return merkle.verified(merkle.proofs(n, _leaves(c)), "sha2").select(F.col("tree").alias("doc_id"), "pos", "leaf", F.size("siblings").alias("n_siblings"), "valid")


def merkle_batch(spark, d):
    """M7: siblings that prove each three leaves in a row together, to the end of the tree."""
    c = _fixed(spark, d)
    n = merkle.tree(c, "doc_id", "idx", "hash", "sha2")
    wanted = _leaves(c).withColumn("batch", F.floor(F.col("pos") / 3).cast("long"))
    return merkle.batch_siblings(n, wanted).select(F.col("tree").alias("doc_id"), "batch", "level", "pos", "hash")


def merkle_diff(spark, d):
    """All leaves against those of the whole text with another letter for each ``a``, and one more at the end."""
    up = chunks.fixed_chunks(_d(spark, d), "doc_id", F.encode(F.concat(F.replace("text", F.lit("a"), F.lit("A")), F.lit("!")), "UTF-8"), 512, "sha2")
    return merkle.diff(_leaves(_fixed(spark, d)), _leaves(up)).groupBy("change").agg(F.count("*").alias("n"))


def merkle_versions(spark, d):
    """M9: versions of the trees after odd documents lost their first chunk."""
    c = _fixed(spark, d)
    r = lambda x: merkle.roots(merkle.tree(x, "doc_id", "idx", "hash", "sha2")).select("tree", "root")
    old = merkle.versions(None, r(c))
    new = merkle.versions(old, r(c.where("doc_id % 2 = 0 OR idx > 0").withColumn("idx", F.when(F.col("doc_id") % 2 == 0, F.col("idx")).otherwise(F.col("idx") - 1))))
    return new.groupBy("version").agg(F.count("*").alias("n"))


def content_hashes(spark, d):
    """H1, H3, H4: SHA3-256 and the 31-hash of all texts."""
    return _d(spark, d).select("doc_id", sha3_256("text").alias("sha3"), java_hash("text").alias("hash32"))


def doc_frequency(spark, d):
    """A20."""
    return learning.document_frequency(_d(spark, d), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf(spark, d):
    """A21, T1."""
    t = _d(spark, d)
    return learning.tfidf(t, "doc_id", "text").select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


def keyword_scores(spark, d):
    """Keyword score of every text for a query."""
    terms = T.search_terms(F.lit(QUERY))
    return _d(spark, d).where("text IS NOT NULL").select("doc_id", F.round(T.keyword_score(terms, F.col("text")), 6).alias("score"), T.keyword_weight(F.lit(QUERY)).alias("weight"))


def extracts(spark, d):
    """Segments with category, importance and keywords."""
    return learning.extracts(_d(spark, d), "doc_id", "text").withColumn("importance", F.round("importance", 6))


def patterns(spark, d):
    """Patterns of extracts by source and category."""
    e = learning.extracts(_d(spark, d).withColumn("grp", F.coalesce(F.lower("source"), F.lit("none"))), "grp", "text")
    return learning.patterns(e, "grp").select("grp", "name", "n", F.round("confidence", 6).alias("confidence"))


def task_types(spark, d):
    """T9."""
    return _d(spark, d).where("text IS NOT NULL").select(T.task_type(F.col("text")).alias("task")).groupBy("task").agg(F.count("*").alias("n"))


def hybrid_search(spark, d):
    """SR1, 3.B: hybrid ranking of all texts for a query, with deterministic embeddings."""
    return hybrid.hybrid_search(_d(spark, d), "doc_id", "text", QUERY, 10).select("doc_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), F.round("keyword", 6).alias("keyword"))


def ingest(spark, d):
    """I1, I2, 3.A: all texts ingested in one batch."""
    return hybrid.ingest(_d(spark, d), "doc_id", "text").select("id", "n_chunks", "merkle_root", "n_copies")


QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunks, fixed_chunks_sha3, content_chunks, chunk_stats, chunk_dedup, chunk_store, chunk_release, chunk_merge, chunk_integrity, merkle_roots, merkle_roots_sha3,
        merkle_proofs, merkle_batch, merkle_diff, merkle_versions, content_hashes, doc_frequency, tfidf, keyword_scores, extracts, patterns, task_types, hybrid_search, ingest,
    )
}

_C = """
WITH d AS (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0),
c AS (
  SELECT doc_id, i AS idx, i * 512 AS byte_offset, array_slice(b, i * 512 + 1, i * 512 + 512) AS data
  FROM (SELECT doc_id, b, unnest(range(0, (octet_length(b) + 511) // 512)) AS i FROM d)),
h AS (SELECT doc_id, idx::INTEGER AS idx, byte_offset, octet_length(data) AS size, data, sha256(data) AS hash FROM c)
"""
_TREE = (
    _C.replace("WITH d", "WITH RECURSIVE d")
    + """,
w AS (SELECT doc_id, count(*) AS n, arg_max(hash, idx) AS last, (2 ** ceil(log2(count(*))))::BIGINT AS w FROM h GROUP BY 1),
leaf AS (
  SELECT doc_id, idx::BIGINT AS pos, hash FROM h UNION ALL
  SELECT doc_id, unnest(range(n, w)) AS pos, last FROM w WHERE w > n),
t AS (
  SELECT doc_id, 0 AS level, pos, hash, (SELECT w FROM w WHERE w.doc_id = leaf.doc_id) AS width FROM leaf
  UNION ALL
  SELECT doc_id, level + 1, pos // 2, sha256(least(min(hash), max(hash)) || greatest(min(hash), max(hash))), width // 2
  FROM t WHERE width > 1 GROUP BY doc_id, level, pos // 2, width)
"""
)
_STOP = ", ".join(f"'{w}'" for w in T.SEARCH_STOPWORDS)
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s가-힣ㄱ-ㅎㅏ-ㅣ]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')"
_IDF = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 1 AS idf FROM f)
"""

SQL = {
    "fixed_chunks": _C + "SELECT doc_id, idx, byte_offset, size, hash FROM h",
    "chunk_stats": _C + "SELECT count(*) AS n_chunks, sum(size) AS total_size, round(avg(size))::BIGINT AS avg_size, min(size) AS min_size, max(size) AS max_size FROM h",
    "chunk_dedup": _C + "SELECT hash, count(*) AS copies, sum(size) - max(size) AS saved_bytes FROM h GROUP BY 1 HAVING count(*) > 1",
    "chunk_store": _C + "SELECT hash, max(size) AS size, count(*) AS ref_count, min(byte_offset) AS first_offset FROM h GROUP BY 1",
    "chunk_release": _C + "SELECT hash, max(size) AS size, count(*) FILTER (doc_id % 2 = 0) AS ref_count FROM h GROUP BY 1 HAVING count(*) FILTER (doc_id % 2 = 0) > 0",
    "chunk_merge": "SELECT doc_id, sha256(encode(text)) AS content_hash FROM documents WHERE text IS NOT NULL AND text <> ''",
    "chunk_integrity": _C
    + """, g AS (SELECT hash, max(doc_id % 7 <> 0) AS ok FROM h WHERE doc_id % 2 = 0 GROUP BY 1)
      SELECT DISTINCT h.hash, CASE WHEN g.hash IS NULL THEN 'missing' WHEN g.ok THEN 'valid' ELSE 'corrupted' END AS status FROM h LEFT JOIN g ON g.hash = h.hash""",
    "merkle_roots": _TREE + "SELECT doc_id, hash AS root, level AS height FROM t WHERE width = 1",
    "keyword_scores": """
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest([(length(t) - length(replace(t, w, ''))) // length(w) FOR w IN ['memory', 'graph', 'index']]) AS n FROM t)
SELECT doc_id, round(avg(CASE WHEN n > 0 THEN 0.5 + 0.5 * n / (n + 1.5::DOUBLE) ELSE 0 END), 6) AS score, 0.15::DOUBLE AS weight FROM n GROUP BY 1""",
    "merkle_versions": "SELECT (CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END)::INTEGER AS version, count(*) AS n FROM documents WHERE octet_length(encode(text)) > 512 OR (doc_id % 2 = 0 AND text <> '') GROUP BY 1",
    "merkle_proofs": _TREE
    + """SELECT h.doc_id, h.idx::BIGINT AS pos, h.hash AS leaf, t.level AS n_siblings, true AS valid FROM h JOIN t ON t.doc_id = h.doc_id AND t.width = 1""",
    "merkle_batch": _TREE.rstrip()
    + """,
known AS (
  SELECT DISTINCT doc_id, batch, level, idx >> level AS pos FROM (
    SELECT h.doc_id, h.idx::BIGINT AS idx, h.idx::BIGINT // 3 AS batch, unnest(range(0, top.level)) AS level FROM h JOIN (SELECT doc_id, level FROM t WHERE width = 1) top ON top.doc_id = h.doc_id)),
need AS (SELECT doc_id, batch, level, xor(pos, 1) AS pos FROM known EXCEPT SELECT * FROM known)
SELECT need.*, t.hash FROM need JOIN t ON t.doc_id = need.doc_id AND t.level = need.level AND t.pos = need.pos""",
    "merkle_diff": _C
    + """, u AS (SELECT doc_id, i::INTEGER AS idx, sha256(array_slice(b, i * 512 + 1, i * 512 + 512)) AS hash FROM (
            SELECT doc_id, b, unnest(range(0, (octet_length(b) + 511) // 512)) AS i FROM (
              SELECT doc_id, encode(replace(text, 'a', 'A') || '!') AS b FROM documents WHERE text IS NOT NULL)))
      SELECT CASE WHEN h.hash IS NULL THEN 'added' WHEN u.hash IS NULL THEN 'removed' ELSE 'modified' END AS change, count(*) AS n
      FROM h FULL JOIN u ON u.doc_id = h.doc_id AND u.idx = h.idx WHERE h.hash IS DISTINCT FROM u.hash GROUP BY 1""",
    "doc_frequency": _IDF + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf": _IDF
    + """SELECT doc_id, t.term, round(n / len * idf, 6) AS tfidf FROM (
        SELECT doc_id, term, count(*) AS n, any_value(len) AS len FROM (SELECT doc_id, unnest(w) AS term, len(w) AS len FROM d) GROUP BY 1, 2) t JOIN idf ON idf.term = t.term""",
    "task_types": """SELECT CASE WHEN regexp_matches(lower(text), 'search|find|look|검색|찾') THEN 'search' WHEN regexp_matches(lower(text), 'create|make|build|생성|만들') THEN 'create'
        WHEN regexp_matches(lower(text), 'fix|debug|repair|수정|고치') THEN 'fix' WHEN regexp_matches(lower(text), 'explain|describe|설명') THEN 'explain'
        WHEN regexp_matches(lower(text), 'analyze|분석') THEN 'analyze' ELSE 'general' END AS task, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
}
