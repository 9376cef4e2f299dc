"""Items that appear together: an incremental table of pair counts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import tidy
from memlattice.session import materialize, shared_dir

#: Counts of a bucket, about, and the buckets at least and at most.
BUCKET_ROWS, BUCKETS, MOST_BUCKETS = 1_000_000, 16, 32768


def basket(tags: Column) -> Column:
    """The distinct tags of an item, sorted by code points; null and blank entries are none."""
    clean = F.filter(F.transform(tags, tidy), lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(F.coalesce(clean, F.array().cast("array<string>"))))


def baskets(df: DataFrame, key: str = "id", tags: str = "tags") -> DataFrame:
    """(item, basket): one row per distinct tidied key, with the tags of all its rows; rows without a key drop out."""
    rows = df.select(tidy(key).alias("item"), basket(F.col(tags)).alias("b")).where("item IS NOT NULL")
    return rows.groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("b")))).alias("basket"))


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(basket, sign) of the items whose basket changed: the old one leaves (-1), the new one enters (+1).

    ``after`` holds the new baskets of changed and new items; an item that it has with an
    empty basket leaves. Without ``before`` every item is new.
    """
    if before is None:
        return after.select("basket", F.lit(1).alias("sign"))
    old = before.select("item", F.col("basket").alias("old"))
    both = after.join(old, "item", "left").where(~F.col("basket").eqNullSafe(F.col("old")))
    signed = F.array(F.struct(F.col("old").alias("basket"), F.lit(-1).alias("sign")), F.struct(F.col("basket"), F.lit(1).alias("sign")))
    return both.select(F.explode(signed).alias("x")).select("x.*").where("basket IS NOT NULL")


def deltas(changed: DataFrame) -> DataFrame:
    """Signed counts (tag_a, tag_b, n): pairs with tag_a < tag_b, marginals with a null tag_b, and
    the number of baskets with both null.

    A basket of m tags is unrolled tag by tag, so a row never holds more than m of its
    pairs, and counts combine before the shuffle.
    """
    full = changed.where(F.size("basket") > 0)
    tagged = full.select("sign", "basket", F.posexplode("basket").alias("i", "tag_a"))
    partners = F.concat(F.array(F.lit(None).cast("string")), F.expr("slice(basket, i + 2, greatest(size(basket), 1))"))
    rows = tagged.select("sign", "tag_a", F.explode(partners).alias("tag_b"))
    rows = rows.unionByName(full.select("sign", F.lit(None).cast("string").alias("tag_a"), F.lit(None).cast("string").alias("tag_b")))
    return rows.groupBy("tag_a", "tag_b").agg(F.sum("sign").alias("n"))


class PairTable:
    """Persistent counts in hash buckets of both tags, so a common tag's pairs lie in all of them.

    A merge reads and rewrites only the buckets that its deltas touch; ``where`` holds the
    version of each bucket. The number of buckets follows from the first merge.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or os.path.join(shared_dir(spark), f"pairs-{uuid.uuid4().hex[:10]}")
        self.version = 0
        self.buckets = 0
        self.where: dict[int, int] = {}

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        schema = "tag_a string, tag_b string, n long"
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(self.where.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, changed: DataFrame) -> DataFrame:
        """Adds the deltas of ``changed`` (basket, sign); returns the keys whose counts changed."""
        new = materialize(deltas(changed).where("n <> 0"), "deltas")
        if not self.buckets:
            self.buckets = min(MOST_BUCKETS, max(BUCKETS, -(-new.count() // BUCKET_ROWS)))
        bucket = F.pmod(F.hash("tag_a", "tag_b"), F.lit(self.buckets)).cast("int")
        touched = sorted(r["b"] for r in new.select(bucket.alias("b")).distinct().collect())  # MOST_BUCKETS at most
        old = [b for b in touched if b in self.where]
        both = self.counts(set(old)).unionByName(new) if old else new
        # a bucket whose counts all vanish keeps a row of zero, so that its file replaces the old one
        merged = both.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n")).withColumn("bucket", bucket)
        self.version += 1
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{self.version}")
        self.where |= dict.fromkeys(touched, self.version)
        return new.select("tag_a", "tag_b")

    def scores(self, least: int = 1, touched: DataFrame | None = None) -> DataFrame:
        """Pairs with at least ``least`` items: counts, lift (how many times as often as by chance) and PMI.

        ``touched`` (tag): only pairs with one of these tags are scored again.
        """
        counts = self.counts().where("n <> 0")
        total = counts.where("tag_a IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))
        single = counts.where("tag_a IS NOT NULL AND tag_b IS NULL")
        pairs = counts.where(F.col("tag_b").isNotNull() & (F.col("n") >= least)).select("tag_a", "tag_b", F.col("n").alias("n_ab"))
        if touched is not None:
            hit = pairs.join(touched.select(F.col("tag").alias("tag_a")), "tag_a", "left_semi").unionByName(pairs.join(touched.select(F.col("tag").alias("tag_b")), "tag_b", "left_semi"))
            pairs = hit.distinct()
        a = single.select("tag_a", F.col("n").alias("n_a"))
        b = single.select(F.col("tag_a").alias("tag_b"), F.col("n").alias("n_b"))
        n = total.first()["n_items"]
        joined = pairs.join(a, "tag_a").join(b, "tag_b").withColumn("n_items", F.lit(n).cast("long"))
        lift = F.col("n_items") * F.col("n_ab") / (F.col("n_a").cast("double") * F.col("n_b"))
        return joined.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "n_items", lift.alias("lift"), F.log2(lift).alias("pmi"))


def together(scores: DataFrame, least: int = 5, times: int = 4) -> DataFrame:
    """Pairs with ``least`` items and ``times`` times as often as by chance, in exact integers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return scores.where((F.col("n_ab") >= least) & (big("n_items") * big("n_ab") >= big("n_a") * big("n_b") * F.lit(times)))


def count_pairs(df: DataFrame, key: str = "id", tags: str = "tags") -> PairTable:
    """A pair table of all of ``df``, as one batch of new baskets."""
    table = PairTable(df.sparkSession)
    table.merge(changes(None, baskets(df, key, tags)))
    return table


def grow(table: PairTable, before: DataFrame | None, batch: DataFrame, key: str = "id", tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """(baskets after, keys whose counts changed): the rows of ``batch`` added to the counts of ``before``.

    An item's new basket is what it had and what the batch gives it; only items of the
    batch are looked at, and of these only those whose basket changes emit deltas.
    """
    new = baskets(batch, key, tags)
    if before is None:
        after = materialize(new, "baskets")
        return after, table.merge(changes(None, after))
    had = before.select("item", F.col("basket").alias("had"))
    grown = F.array_sort(F.array_distinct(F.concat(F.coalesce("had", F.array().cast("array<string>")), "basket")))
    new = materialize(new.join(had, "item", "left").select("item", grown.alias("basket")), "baskets")
    touched = table.merge(changes(before, new))
    return before.join(new, "item", "left_anti").unionByName(new), touched


def in_batches(df: DataFrame, key: str = "id", tags: str = "tags", at: str = "created_at") -> tuple[PairTable, DataFrame]:
    """(pair table, tags whose counts the second batch changed) of ``df`` in two batches: the rows before
    the day of the mean ``at``, then the others (null ``at`` included)."""
    mean = F.timestamp_micros(F.avg(F.unix_micros(F.col(at).cast("timestamp"))).cast("long"))
    day = df.agg(F.date_trunc("day", mean).cast("timestamp_ntz").alias("day")).first()["day"]
    early = F.coalesce(F.col(at) < F.lit(day), F.lit(False))
    table = PairTable(df.sparkSession)
    before, _ = grow(table, None, df.where(early), key, tags)
    _, touched = grow(table, before, df.where(~early), key, tags)
    return table, touched.select(F.explode(F.array("tag_a", "tag_b")).alias("tag")).where("tag IS NOT NULL").distinct()
