"""Keys and current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.session import materialize

#: Keys that are sent to every task at once, at most (under 100 MB).
BROADCAST_KEYS = 1_000_000


def tidy(col: Column | str) -> Column:
    """Lower case without white space (Unicode) at either end; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def current_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per tidied ``key``: the one with the largest ``order``.

    Null ``order`` counts as oldest; of rows with equal ``order`` the one whose
    ``columns`` are largest (compared from left to right) is kept, so the result
    doesn't depend on the order of rows. Rows with null key are dropped. The aggregate
    combines before the shuffle, so a key with many versions isn't gathered.
    """
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])
    return (
        df.select(tidy(key).alias("_k"), row.alias("_r"))
        .where(F.col("_k").isNotNull())
        .groupBy("_k")
        .agg(F.max("_r").alias("_r"))
        .select(F.col("_k").alias(key), *[F.col("_r")[c].alias(c) for c in columns if c != key])
    )


def bounded(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` (``n`` rows of one narrow column), marked for broadcast where that many are within the bound."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def current_wide(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``current_rows`` for wide columns: only the rows of keys that occur more than once are shuffled.

    The keys are counted by themselves first; rows whose key occurs once pass straight
    from the scan. Where more keys repeat than can be broadcast, the rows are joined by key.
    """
    rows = df.select(tidy(key).alias("_k"), F.col(order).alias("_o"), *[F.col(c).alias(f"_c_{c}") for c in columns]).where(F.col("_k").isNotNull())
    many = materialize(rows.groupBy("_k").count().where("count > 1").select("_k"), "repeated")
    n = many.count()
    shown = [F.col("_k").alias(key), *[F.col(f"_c_{c}").alias(c) for c in columns if c != key]]
    if n == 0:
        return rows.select(shown)
    few = bounded(many, n)
    values = [f"_c_{c}" for c in columns]
    again = rows.join(few, "_k", "left_semi").groupBy("_k").agg(F.max(F.struct("_o", *values)).alias("_r")).select("_k", *[F.col("_r")[c].alias(c) for c in values])
    again = materialize(again, "versions")
    return rows.join(few, "_k", "left_anti").select(shown).unionByName(again.select(shown))
