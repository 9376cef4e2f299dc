"""Ingestion of texts into records and hybrid search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions import vectors as V
from memlattice.functions.embedding import deterministic, deterministic_embedding
from memlattice.functions.hashing import content_id
from memlattice.operators import chunks, merkle
from memlattice.operators.graph import peer_weights

#: Texts of more bytes are cut by content.
LARGE = 32 * 1024


def ingest(texts: DataFrame, key: str, text: str, size: int = 4096, algorithm: str = "sha3") -> DataFrame:
    """(id, n_chunks, chunk_hashes, merkle_root, embedding, n_copies): a record per distinct non-empty text.

    Equal texts of the batch become one record (the smallest key stands for it): with
    the deterministic provider only they have a similarity of 1. Texts above 32 KiB get
    content-defined chunks. Null and empty texts have no chunks and no record.
    """
    kind = dict(texts.dtypes)[key]
    rows = texts.where(F.octet_length(text) > 0).groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(key).alias(key), F.count("*").alias("n_copies"), F.max(text).alias(text))
    data = F.encode(text, "UTF-8")
    small = chunks.fixed_chunks(rows.where(F.octet_length(text) < LARGE), key, data, size, algorithm)
    large = chunks.content_chunks(rows.where(F.octet_length(text) >= LARGE), key, data, algorithm=algorithm)
    cut = small.select(key, "idx", "hash").unionByName(large.select(key, "idx", "hash"))
    tree = merkle.roots(merkle.tree(cut, key, "idx", "hash", algorithm)).select(F.col("tree").alias(key), F.col("root").alias("merkle_root"))
    listed = cut.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("chunk_hashes"))
    del kind
    j = rows.join(listed, key).join(tree, key)
    return j.select(F.col(key).alias("id"), F.size("chunk_hashes").cast("long").alias("n_chunks"), "chunk_hashes", "merkle_root", deterministic_embedding(text).alias("embedding"), "n_copies", content_id(F.lit("record"), F.col(key).cast("string")).alias("record_id"))


def hybrid_search(texts: DataFrame, key: str, text: str, query: str, k: int = 10, least: float = 0.0, edges: DataFrame | None = None, vector: str | None = None, mode: str = "pre") -> DataFrame:
    """(key, score, similarity, keyword): (1 - w) · cosine + w · keyword score, best k, ties by key.

    Filters come before the candidate cut (mode ``pre``), so that k rows return where there
    are k; ``post`` cuts 2 k by cosine first. With ``edges`` the k rows gain 0.1 of their
    largest edge to one another, lose 0.08 of the largest inhibitory one, and are ranked again.
    """
    q = F.array(*[F.lit(float(x)) for x in deterministic(query)])
    rows = texts.where(F.length(text) > 0)
    v = F.col(vector) if vector else deterministic_embedding(text)
    rows = rows.select(F.col(key), F.col(text).alias("_t"), V.cosine(v, q).alias("similarity")).where(F.col("similarity") >= least)
    if mode == "post":
        rows = rows.orderBy(F.desc("similarity"), key).limit(2 * k)
    w = T.keyword_weight(F.lit(query))
    rows = rows.withColumn("keyword", T.keyword_score(T.search_terms(F.lit(query)), F.col("_t")))
    rows = rows.withColumn("score", (1 - w) * F.col("similarity") + w * F.col("keyword"))
    top = rows.orderBy(F.desc("score"), key).limit(k).select(key, "score", "similarity", "keyword")
    if edges is None:
        return top
    peers = top.select(F.lit(0).alias("session"), F.col(key).alias("node"))
    boost = peer_weights(edges, peers).select(F.col("node").alias(key), (0.1 * F.col("excitation") - 0.08 * F.col("inhibition")).alias("_b"))
    return top.join(boost, key, "left").withColumn("score", F.col("score") + F.coalesce("_b", F.lit(0.0))).drop("_b").orderBy(F.desc("score"), key)
