"""Named dimensions: sparse vectors as maps, and a registry of what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import text as T
from memlattice.functions.vectors import sparse_cosine

#: Families of base dimensions with their prefixes and counts.
FAMILIES = (("semantic", "sem", 128), ("syntactic", "syn", 64), ("contextual", "ctx", 96), ("relational", "rel", 64), ("abstract", "abs", 32))
MOST = 10_000


def base_registry(spark: SparkSession) -> DataFrame:
    """(position, name, category, usage_count) of the base dimensions."""
    names = [(f"{p}_{i}", c) for c, p, n in FAMILIES for i in range(n)]
    return spark.createDataFrame([(i, n, c, 0) for i, (n, c) in enumerate(names)], "position int, name string, category string, usage_count long")


def base_names(n: int) -> list[str]:
    return [f"{p}_{i}" for _, p, k in FAMILIES for i in range(k)][:n]


def named(vector: Column, n: int) -> Column:
    """A dense vector as a map from the first ``n`` base dimensions."""
    names = F.array(*map(F.lit, base_names(n)))
    size = F.least(F.size(vector), F.lit(n))
    return F.map_from_arrays(F.slice(names, 1, size), F.slice(vector.cast("array<double>"), 1, size))


def dense(sparse: Column, order: list[str]) -> Column:
    """Values in registry order, 0 where a dimension is absent."""
    return F.transform(F.array(*map(F.lit, order)), lambda d: F.coalesce(F.element_at(sparse, d), F.lit(0.0)))


def projected(sparse: Column, names: list[str]) -> Column:
    keep = F.array(*map(F.lit, names))
    return F.map_filter(sparse, lambda k, v: F.array_contains(keep, k))


def registered(registry: DataFrame, names: DataFrame) -> DataFrame:
    """The registry with new ``names`` (name): categories by prefix, positions after the last, usage counted; MOST at most."""
    used = names.groupBy("name").agg(F.count("*").alias("_n"))
    old = registry.join(used, "name", "left").select("position", "name", "category", (F.col("usage_count") + F.coalesce("_n", F.lit(0))).alias("usage_count"))
    fresh = used.join(registry.select("name"), "name", "left_anti").orderBy("name").limit(MOST)
    last = registry.agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0]
    from pyspark.sql import Window

    new = fresh.select((F.row_number().over(Window.orderBy("name")) + last).cast("int").alias("position"), "name", T.dimension_category(F.col("name")).alias("category"), F.col("_n").alias("usage_count"))
    return old.unionByName(new.where(F.col("position") < MOST))


def expansion(texts: DataFrame, key: str, text: str, registry: DataFrame) -> DataFrame:
    """(key, name, value): keyword dimensions ``ext_<word>`` of each text that the registry hasn't, by keyword importance."""
    words = texts.select(key, F.col(text).alias("_t"), F.explode(F.array_distinct(T.keywords(F.col(text), T.DIMENSION_STOPWORDS))).alias("_w"))
    rows = words.select(key, F.concat(F.lit("ext_"), "_w").alias("name"), T.keyword_importance(F.col("_w"), F.col("_t")).alias("value"))
    return rows.join(registry.select("name"), "name", "left_anti").select(key, "name", "value")


def expanded(sparse: Column, extra: Column) -> Column:
    """Adds the dimensions of ``extra`` that ``sparse`` hasn't."""
    return F.map_zip_with(sparse, extra, lambda k, a, b: F.coalesce(a, b))


def needs_expansion(sparse: Column, target: Column, least: float = 0.3) -> Column:
    return sparse_cosine(sparse, target) < least


def registry_stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("category").agg(F.count("*").alias("n_dimensions"), F.sum("usage_count").alias("usage"))
