"""Search as a whole: refinement, candidates, filters, hybrid scores, peer and working-memory boosts, content and proof;
ingestion against existing records; unified inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions import vectors as V
from memlattice.operators import attractors as A
from memlattice.operators import inference, similarity, store
from memlattice.operators.graph import peer_weights
from memlattice.session import materialize

#: Records from which on a query is refined, boosts of the score.
REFINED_FROM = 20
PEERS, INHIBITED, MEMORY = 0.10, 0.08, 0.15


def working_memory_boost(edges: DataFrame, candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """(node, boost): of each candidate (node) the largest weight of its edges, in either direction, with a record
    in working ``memory`` (node); inhibitory edges don't count; 0 without any."""
    m = F.broadcast(memory.select(F.col("node").alias("_m")).distinct())  # a working set holds seven
    e = edges.where("edge_type <> 'INHIBITORY'")
    both = e.select(F.col("target_id").alias("node"), F.col("source_id").alias("_m"), "weight").unionByName(e.select(F.col("source_id").alias("node"), F.col("target_id").alias("_m"), "weight"))
    best = both.join(m, "_m").groupBy("node").agg(F.greatest(F.lit(0.0), F.max("weight")).alias("_b"))
    return candidates.select("node").join(best, "node", "left").select("node", F.coalesce("_b", F.lit(0.0)).alias("boost"))


def search(
    records: DataFrame, query: list[float], text: str | None = None, k: int = 10, least: float = 0.0, tags: list[str] | None = None,
    source_type: str | None = None, contents: DataFrame | None = None, edges: DataFrame | None = None, memory: DataFrame | None = None, proofs: DataFrame | None = None, refine: bool = True,
) -> DataFrame:
    """(id, score, similarity, keyword, rank[, content][, leaf, siblings, root]): the ``k`` best records (id, embedding, tags, source_type).

    From twenty records on the query is refined by pattern completion. The 2 k records most
    similar to the refined query are filtered (score, any of ``tags``, ``source_type``) and,
    with ``text``, weighed with the keyword score of their ``contents`` (id, text; a record
    without has keyword score 0). The best k gain 0.1 of their largest edge to one another
    and 0.15 of that to working ``memory``, lose 0.08 of the largest inhibition, and are
    ranked again, ties by id. ``proofs`` (tree, pos, leaf, siblings, root) adds that of the
    first leaf. Null embeddings and those of another length take no part.
    """
    usable = records.where(F.size("embedding") == len(query))
    if refine and usable.limit(REFINED_FROM).count() == REFINED_FROM:
        query = similarity.pattern_complete(usable, "id", "embedding", query, 2 * k, 3, 0.3)
    top = similarity.top_k(usable, "id", "embedding", query, 2 * k).withColumnRenamed("score", "similarity").where(F.col("similarity") >= least)
    if tags is not None:
        top = top.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    if source_type is not None:
        top = top.where(F.col("source_type") == source_type)
    rows = top.select("id", "similarity")
    if text is not None and contents is not None:
        w = T.keyword_weight(F.lit(text))
        rows = rows.join(contents.select("id", F.col("text").alias("_t")), "id", "left")
        rows = rows.withColumn("keyword", F.coalesce(T.keyword_score(T.search_terms(F.lit(text)), F.col("_t")), F.lit(0.0))).drop("_t")
        rows = rows.withColumn("score", (1 - w) * F.col("similarity") + w * F.col("keyword"))
    else:
        rows = rows.withColumn("keyword", F.lit(0.0)).withColumn("score", F.col("similarity"))
    best = rows.orderBy(F.desc("score"), "id").limit(k)
    if edges is not None:
        peers = peer_weights(edges, best.select(F.lit(0).alias("session"), F.col("id").alias("node"))).select(F.col("node").alias("id"), "excitation", "inhibition")
        best = best.join(peers, "id", "left").withColumn("score", F.col("score") + PEERS * F.coalesce("excitation", F.lit(0.0)) - INHIBITED * F.coalesce("inhibition", F.lit(0.0))).drop("excitation", "inhibition")
        if memory is not None:
            boost = working_memory_boost(edges, best.select(F.col("id").alias("node")), memory).select(F.col("node").alias("id"), "boost")
            best = best.join(boost, "id").withColumn("score", F.col("score") + MEMORY * F.col("boost")).drop("boost")
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows
    if contents is not None:
        out = out.join(contents.select("id", F.col("text").alias("content")), "id", "left")
    if proofs is not None:
        out = out.join(proofs.where("pos = 0").select(F.col("tree").alias("id"), "leaf", "siblings", "root"), "id", "left")
    return out


def ingested(records: DataFrame, new: DataFrame, duplicate: float = 0.95, link: float | None = 0.7, links: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcome, records, edges) of adding ``new`` (id, embedding, tags) to ``records`` (id, embedding, tags).

    A new row whose most similar record reaches ``duplicate`` isn't created: its tags are
    merged into that record (order kept, no repeats). Others are created, equal vectors of
    the batch once (smallest id), and linked both ways to their ``links`` most similar
    records of at least ``link`` (None: none). outcome: (id, action, record), action
    ``created`` or ``merged``. Rows without vector are neither.
    """
    # narrow and written: vectors that a function makes aren't made again for each use
    n = materialize(new.select("id", "tags", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("_h")), "hashed").where("_h IS NOT NULL")
    first = n.groupBy("_h").agg(F.min("id").alias("_first"))
    n = n.join(first, "_h")
    hit = similarity.closest(new.select("id", "embedding"), records.select("id", "embedding"), "id", "embedding", duplicate).select("id", F.col("other").alias("_record"))
    outcome = n.join(hit, "id", "left").select("id", "tags", F.coalesce("_record", "_first").alias("record"), F.when(F.col("_record").isNotNull() | (F.col("id") != F.col("_first")), "merged").otherwise("created").alias("action"))
    created = new.select("id", "embedding", "tags").join(outcome.where("action = 'created'").select("id"), "id", "left_semi")
    extra = outcome.where("action = 'merged'").groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("_more"))
    both = records.select("id", "embedding", "tags").unionByName(created)
    after = both.join(extra, both["id"] == extra["record"], "left").select("id", "embedding", store.merged_tags(F.col("tags"), F.col("_more")).alias("tags"))
    if link is None:
        edges = records.sparkSession.createDataFrame([], "source string, target string, weight double, edge_type string")
    else:
        near = similarity.search(created.select("id", "embedding"), records.select("id", "embedding"), "id", "embedding", links, link, exclude_self=False)
        edges = similarity.semantic_edges(near)
    return outcome.select("id", "action", "record"), after, edges


def unified(edges: DataFrame, records: DataFrame, attractors: DataFrame, states: DataFrame, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, recommendations) of every record (id, vec).

    summary: (id, n_forward, n_backward, attractor, influence, total_influence, entropy,
    likeliest, n_recommended, best). Forward and backward inference over ``edges``; the
    influence of the ``attractors`` and the dominant one; of the record's ``states``
    (owner_id, state_id, probability) the entropy in bits and the likeliest; and the five
    best recommendations, of which one may be the next of ``steps`` (id, step) towards a
    goal. What a record lacks is null or 0.
    """
    both = inference.infer(edges)
    rec = inference.recommendations(both, 5, steps)
    n = both.groupBy("id").agg(F.count_if(F.col("direction") == "forward").alias("n_forward"), F.count_if(F.col("direction") == "backward").alias("n_backward"))
    near = A.influences(records, "id", "vec", attractors)
    total = near.groupBy("id").agg(F.sum("influence").alias("total_influence"))
    p = states.groupBy("owner_id", "state_id").agg(F.sum("probability").alias("p"))
    sums = p.groupBy("owner_id").agg(F.sum("p").alias("_s"))
    p = p.join(sums, "owner_id").where("_s > 0").withColumn("p", F.col("p") / F.col("_s"))
    state = p.groupBy("owner_id").agg(
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("entropy"), F.min_by("state_id", F.struct(-F.col("p"), "state_id")).alias("likeliest")
    ).withColumnRenamed("owner_id", "id")
    top = rec.groupBy("id").agg(F.count("*").alias("n_recommended"), F.max("score").alias("best"))
    out = records.select("id")
    for part in (n, A.dominant(near, "id"), total, state, top):
        out = out.join(part, "id", "left")
    return out.fillna(0, ["n_forward", "n_backward", "n_recommended"]), rec


def by_root(records: DataFrame, root: str, column: str = "merkle_root") -> DataFrame:
    """The record of a Merkle root: the oldest one, ties by id."""
    return records.where(F.col(column) == root).orderBy("created_at", "id").limit(1)


def unexpired(records: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """Records that have no end or a later one than ``now``."""
    return records.where(F.col(expires).isNull() | (F.col(expires) > now))


def word_windows(texts: DataFrame, key: str, text: str, size: int = 160, overlap: int = 40) -> DataFrame:
    """(key, window, n_words, content): overlapping windows of ``size`` words of the longer texts, the shorter whole; no words, no row."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = texts.where(F.col(text).isNotNull()).select(key, words.alias("_w")).where(F.size("_w") > 0)
    last = F.ceil(F.greatest(F.lit(0), F.size("_w") - size) / (size - overlap)).cast("int")
    rows = rows.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    part = F.slice("_w", F.col("window") * (size - overlap) + 1, F.lit(size))
    return rows.select(key, "window", F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def segment_embedding(local, base, share: float = 0.8):
    """A segment's vector: ``share`` of its own, the rest of the text it stands in, of length one."""
    return V.normalized(F.zip_with(V.doubles(local), V.doubles(base), lambda a, b: share * a + (1 - share) * b))


