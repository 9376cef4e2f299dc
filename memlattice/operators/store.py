"""Record and edge tables: upserts, deletes, access logs, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.hashing import content_id
from memlattice.functions.text import preview

#: The edge types.
EDGE_TYPES = ("SEMANTIC", "TEMPORAL", "CAUSAL", "ASSOCIATIVE", "HIERARCHICAL", "DUPLICATE", "INHIBITORY")


def upsert(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """``table`` with ``rows`` put in: per key the row of the latest ``version``, the new one on a tie."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("_new"), *[c for c in sorted(table.columns) if c not in (key, version)])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def latest(table: DataFrame, key: str, version: str) -> DataFrame:
    return upsert(table, table.limit(0), key, version)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Shallow merge: non-null columns of ``changes`` replace those of the row with the same key."""
    cols = [c for c in changes.columns if c != key and c in table.columns]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in cols])
    return table.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in cols else F.col(x) for x in table.columns])


def deleted(records: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Records without the ``gone`` keys, and edges without their incident ones."""
    g = gone.select(F.col(key).alias("_k")).distinct()
    kept = records.join(g, F.col(key) == F.col("_k"), "left_anti")
    e = edges.join(g, F.col("source_id") == F.col("_k"), "left_anti").join(g, F.col("target_id") == F.col("_k"), "left_anti")
    return kept, e


def accessed(records: DataFrame, log: DataFrame, key: str = "id", at: str = "accessed_at") -> DataFrame:
    """Access counts and last access after a log (key, at) of reads."""
    hits = log.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(at).alias("_t"))
    j = records.join(hits, F.col(key) == F.col("_k"), "left")
    return j.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "_t") if "last_accessed" in records.columns else F.col("_t")).drop("_k", "_n", "_t")


def new_edges(wanted: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Edges (id, source_id, target_id, edge_type, weight, bidirectional) whose ends both exist, types in
    upper case and valid, bidirectional ones with their reversed row; ids follow from the content."""
    ids = records.select(F.col(key).alias("_k")).distinct()
    e = wanted.withColumn("edge_type", F.upper(F.trim("edge_type"))).where(F.col("edge_type").isin(*EDGE_TYPES))
    e = e.join(ids, F.col("source_id") == F.col("_k"), "left_semi").join(ids, F.col("target_id") == F.col("_k"), "left_semi")
    e = e.select("source_id", "target_id", "edge_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("bidirectional", F.lit(False)).alias("bidirectional"))
    back = e.where("bidirectional").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", "weight", "bidirectional")
    return e.unionByName(back).withColumn("id", content_id(F.col("source_id"), F.col("target_id"), F.col("edge_type")))


def by_tags(items: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Items with any of ``tags``."""
    return items.where(F.arrays_overlap(column, F.array(*map(F.lit, tags))))


def tag_counts(items: DataFrame, column: str = "tags") -> DataFrame:
    """(tag, n): items per tag; a tag counts once per item."""
    return items.select(F.explode(F.array_distinct(column)).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))


def merged_tags(a: Column, b: Column) -> Column:
    """Union in order of first appearance."""
    e = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, e), F.coalesce(b, e))


def most(items: DataFrame, order: str, key: str = "id", limit: int = 10) -> DataFrame:
    """The ``limit`` rows of largest ``order``, ties by key, nulls last."""
    return items.orderBy(F.desc_nulls_last(order), key).limit(limit)


def page(items: DataFrame, key: str = "id", limit: int = 50, offset: int = 0) -> DataFrame:
    return items.orderBy(key).offset(offset).limit(min(limit, 500))


def context(items: DataFrame, recent: str, accesses: str, text: str, key: str = "id", recent_n: int = 15, top_n: int = 5) -> DataFrame:
    """(position, key, preview): the most accessed and the most recent items without repeats, recent_n + top_n at most."""
    cols = [key, text, recent, accesses]
    a = most(items.select(*cols), accesses, key, top_n).withColumn("_s", F.lit(1))
    b = most(items.select(*cols), recent, key, recent_n + top_n).withColumn("_s", F.lit(0))
    both = b.unionByName(a)
    one = both.groupBy(key).agg(F.min("_s").alias("_s"), F.max(recent).alias("_t"), F.max(text).alias("_x"), F.max(accesses).alias("_a"))
    taken = Window.orderBy(F.desc("_top"), F.desc_nulls_last("_t"), key)
    top = a.select(F.col(key).alias("_k")).withColumn("_top", F.lit(1))
    j = one.join(top, one[key] == top["_k"], "left").withColumn("_top", F.coalesce("_top", F.lit(0)))
    return j.withColumn("position", F.row_number().over(taken)).where(F.col("position") <= recent_n + top_n).select("position", key, preview(F.col("_x")).alias("preview"))
