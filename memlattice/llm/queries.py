"""Queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.llm import clusters, cooccurrence, garbled, mixture, nearduplicates, neighbours, splitting, tokens, vectors
from memlattice.sources.tables import read


def _pieces(spark, d):
    return splitting.split(read(spark, d, "chunks"), read(spark, d, "chunk_options"))


def p1_found(spark, d):
    return _pieces(spark, d).where("n_pieces > 1").groupBy("owner_id", "idx").agg(F.max("n_pieces").alias("n")).select("owner_id", "idx")


def p1_pieces(spark, d):
    return _pieces(spark, d)


def p1_report(spark, d):
    return splitting.boundary_report(_pieces(spark, d))


def p1_rejoined(spark, d):
    """Every oversized chunk put together again from its pieces."""
    return splitting.rejoined(_pieces(spark, d))


def p4_found(spark, d):
    return clusters.similarity_clusters(read(spark, d, "neurons"))[0].select("cluster_id", "neuron_id")


def p4_clusters(spark, d):
    return clusters.describe(*clusters.similarity_clusters(read(spark, d, "neurons")))


def _pairs(spark, d):
    return cooccurrence.in_batches(read(spark, d, "neuron_list"))


def p5_found(spark, d):
    return cooccurrence.together(_pairs(spark, d)[0].scores(least=5)).select("tag_a", "tag_b")


def p5_scores(spark, d):
    return cooccurrence.count_pairs(read(spark, d, "neuron_list")).scores(least=5).withColumn("lift", F.round("lift", 6)).withColumn("pmi", F.round("pmi", 6))


def p5_pairs(spark, d):
    """Every pair of tags that occurs on an item, with no minimum."""
    return _pairs(spark, d)[0].scores().withColumn("lift", F.round("lift", 6)).withColumn("pmi", F.round("pmi", 6))


def p5_incremental(spark, d):
    """The older items first, then the rest and every changed basket as signed deltas."""
    return _pairs(spark, d)[0].scores(least=5).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n_items")


def p5_pairs_incremental(spark, d):
    """p5_pairs, built as p5_incremental is."""
    return _pairs(spark, d)[0].scores().select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n_items")


def p5_rescored(spark, d):
    """The pairs that the second batch makes score anew: those with a tag of which it changes a count."""
    table, touched = _pairs(spark, d)
    return table.scores(touched=touched).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n_items")


def _alike(spark, d):
    return {
        "chunk": nearduplicates.similar_texts(read(spark, d, "chunks")),
        "embedding": nearduplicates.similar_vectors(read(spark, d, "neurons")),
    }


def p6_found(spark, d):
    parts = [nearduplicates.tagged(kind, nearduplicates.all_pairs(*found)) for kind, found in _alike(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p6_groups(spark, d):
    parts = [nearduplicates.tagged(kind, nearduplicates.groups(*found)) for kind, found in _alike(spark, d).items()]
    return parts[0].unionByName(parts[1])


def _p7(spark, d):
    return neighbours.nearest(vectors.usable_neurons(read(spark, d, "neurons")))


def p7_found(spark, d):
    return neighbours.neighbour_pairs(_p7(spark, d))


def p7_neighbours(spark, d):
    return _p7(spark, d)


def p8_ids(spark, d):
    return tokens.encode(read(spark, d, "documents"), "doc_id")


def p8_report(spark, d):
    return tokens.token_report(tokens.encode_states(read(spark, d, "documents"), "doc_id"))


def p9_mixture(spark, d):
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def _p10(spark, d):
    return garbled.garbled(read(spark, d, "documents"))


def p10_found(spark, d):
    return _p10(spark, d).select("doc_id")


def p10_restored(spark, d):
    return _p10(spark, d)


def p10_report(spark, d):
    return garbled.garble_report(_p10(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_report, p1_rejoined, p4_found, p4_clusters, p5_found, p5_scores, p5_incremental, p5_pairs, p5_pairs_incremental, p5_rescored, p6_found, p6_groups, p7_found, p7_neighbours, p8_ids, p8_report, p9_mixture, p9_shares, p10_found, p10_restored, p10_report)
}


def key(x: str) -> str:
    return f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"


_P5 = f"""
WITH rows AS (
  SELECT {key('id')} AS item, unnest(tags) AS t FROM neuron_list WHERE id IS NOT NULL),
clean AS (
  SELECT DISTINCT item, {key('t')} AS tag FROM rows WHERE t IS NOT NULL AND {key('t')} <> ''),
total AS (SELECT count(DISTINCT item) AS n_items FROM clean),
single AS (SELECT tag, count(*) AS n FROM clean GROUP BY 1),
pair AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM clean a JOIN clean b ON a.item = b.item AND a.tag < b.tag GROUP BY 1, 2),
scored AS (
  SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, n_items
  FROM pair JOIN single x ON x.tag = tag_a JOIN single y ON y.tag = tag_b, total WHERE n_ab >= 5)
"""

_USABLE = f"""
r AS (
  SELECT id, embedding::DOUBLE[] AS v FROM (
    SELECT {key('id')} AS id, deleted_at, embedding FROM neurons WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {key('id')} ORDER BY updated_at DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1)
  WHERE deleted_at IS NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
cos AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM r a JOIN r b ON a.id < b.id)
"""
#: Every pair of usable neurons and of chunks, by brute force.
_P4 = "WITH RECURSIVE " + _USABLE.strip() + """,
link AS (SELECT a, b FROM cos WHERE c >= 0.5 UNION ALL SELECT b, a FROM cos WHERE c >= 0.5),
lab AS (
  SELECT id, id AS label, 0 AS i FROM r
  UNION ALL
  SELECT id, min(label), i + 1 FROM (SELECT lab.id, lab.label, lab.i FROM lab UNION ALL SELECT link.a, lab.label, lab.i FROM lab JOIN link ON link.b = lab.id) WHERE i < 12 GROUP BY id, i),
member AS (SELECT id, label FROM lab WHERE i = 12)
"""

SQL: dict[str, str] = {
    "p4_found": _P4 + "SELECT label AS cluster_id, id AS neuron_id FROM member WHERE label IN (SELECT label FROM member GROUP BY 1 HAVING count(*) >= 3)",
    "p6_found": "WITH " + _USABLE.strip() + f""",
t AS (
  SELECT DISTINCT ON (hash) {key('hash')} AS hash, trim(regexp_replace(lower(TRY(decode(chunk_data))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS t
  FROM chunks WHERE hash IS NOT NULL AND TRY(decode(chunk_data)) IS NOT NULL),
piece AS (SELECT DISTINCT hash, substr(t, i::INTEGER, 8) AS p FROM (SELECT hash, t, unnest(range(1, length(t) - 6)) AS i FROM t WHERE length(t) >= 8)),
n AS (SELECT hash, count(*) AS n FROM piece GROUP BY 1),
shared AS (SELECT a.hash AS a, b.hash AS b, count(*) AS k FROM piece a JOIN piece b ON a.p = b.p AND a.hash < b.hash GROUP BY 1, 2)
SELECT 'embedding' AS kind, a AS key_a, b AS key_b FROM cos WHERE c >= 0.95
UNION ALL SELECT 'chunk', a, b FROM shared JOIN n x ON x.hash = a JOIN n y ON y.hash = b WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9""",
    "p7_found": "WITH " + _USABLE.strip() + """,
rank AS (
  SELECT a, b FROM (SELECT a, b, c FROM cos UNION ALL SELECT b, a, c FROM cos) WHERE round(c, 6) >= 0.5
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS neuron_a, greatest(a, b) AS neuron_b FROM rank""",

    "p1_found": f"""
WITH o AS (SELECT {key('profile')} AS p, max(chunk_size) AS s FROM chunk_options GROUP BY 1)
SELECT DISTINCT {key('owner_id')} AS owner_id, idx FROM chunks c LEFT JOIN o ON o.p = {key('c.profile')}
WHERE octet_length(chunk_data) > coalesce(o.s, (SELECT s FROM o WHERE p = 'default'))""",
    "p1_rejoined": f"""
WITH o AS (SELECT {key('profile')} AS p, max(chunk_size) AS s FROM chunk_options GROUP BY 1)
SELECT DISTINCT {key('owner_id')} AS owner_id, idx, byte_offset, octet_length(chunk_data)::BIGINT AS size, sha256(chunk_data) AS content FROM chunks c LEFT JOIN o ON o.p = {key('c.profile')}
WHERE octet_length(chunk_data) > coalesce(o.s, (SELECT s FROM o WHERE p = 'default'))""",
    "p5_found": _P5 + "SELECT tag_a, tag_b FROM scored WHERE n_items * n_ab >= 4 * n_a * n_b",
    "p5_scores": _P5
    + """SELECT tag_a, tag_b, n_ab, n_a, n_b, n_items, round(n_items * n_ab / (n_a::DOUBLE * n_b), 6) AS lift,
         round(log2(n_items * n_ab / (n_a::DOUBLE * n_b)), 6) AS pmi FROM scored""",
    "p5_pairs": _P5.replace(" WHERE n_ab >= 5", "")
    + """SELECT tag_a, tag_b, n_ab, n_a, n_b, n_items, round(n_items * n_ab / (n_a::DOUBLE * n_b), 6) AS lift,
         round(log2(n_items * n_ab / (n_a::DOUBLE * n_b)), 6) AS pmi FROM scored""",
    "p5_pairs_incremental": _P5.replace(" WHERE n_ab >= 5", "") + "SELECT tag_a, tag_b, n_ab, n_a, n_b, n_items FROM scored",
    "p5_rescored": _P5.replace(" WHERE n_ab >= 5", "").rstrip()
    + f""",
day AS (SELECT date_trunc('day', make_timestamp(avg(epoch_us(created_at))::BIGINT)) AS day FROM neuron_list),
old AS (
  SELECT DISTINCT {key('id')} AS item, {key('t')} AS tag FROM (SELECT id, unnest(tags) AS t FROM neuron_list, day WHERE id IS NOT NULL AND created_at < day)
  WHERE t IS NOT NULL AND {key('t')} <> ''),
old_single AS (SELECT tag, count(*) AS n FROM old GROUP BY 1),
old_pair AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM old a JOIN old b ON a.item = b.item AND a.tag < b.tag GROUP BY 1, 2),
changed AS (
  SELECT s.tag FROM single s LEFT JOIN old_single o ON o.tag = s.tag WHERE s.n <> coalesce(o.n, 0)
  UNION SELECT unnest([p.tag_a, p.tag_b]) FROM pair p LEFT JOIN old_pair o ON o.tag_a = p.tag_a AND o.tag_b = p.tag_b WHERE p.n_ab <> coalesce(o.n, 0))
SELECT tag_a, tag_b, n_ab, n_a, n_b, n_items FROM scored WHERE tag_a IN (FROM changed) OR tag_b IN (FROM changed)""",
    "p5_incremental": _P5 + "SELECT tag_a, tag_b, n_ab, n_a, n_b, n_items FROM scored",
}
