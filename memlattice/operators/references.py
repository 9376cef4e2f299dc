"""References to keys that are missing, deleted or created only later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import current_rows, tidy

#: A key that has more than one in HOT_SHARE of all references is spread over SALTS tasks.
HOT_SHARE = 1024
SALTS = 128


def references(df: DataFrame, table: str, record: Column, field: str, key: Column, at: Column) -> DataFrame:
    """Rows (ref_table, record_id, field_name, missing_key, ref_at); null keys are no references."""
    return df.select(
        F.lit(table).alias("ref_table"),
        record.alias("record_id"),
        F.lit(field).alias("field_name"),
        key.alias("missing_key"),
        at.alias("ref_at"),
    ).where(F.col("missing_key").isNotNull())


def hot_keys(refs: DataFrame, key: str = "missing_key") -> list[str]:
    """At most HOT_SHARE keys that may each hold over 1/HOT_SHARE of the rows (one pass, bounded sketch)."""
    row = refs.agg(F.count("*").alias("n"), F.expr(f"approx_top_k({key}, {HOT_SHARE}, {HOT_SHARE * 16})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] * HOT_SHARE > row["n"] > 10_000]


def dangling(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent isn't valid at ``ref_at``, with ``reason``.

    ``parents`` has one row per ``parent_key`` with its validity: the interval from
    ``valid_from`` (null: unknown) to ``valid_to`` (null: open, or its end isn't known), and
    ``gone``: whether it has ended by now. Both sides are hash partitioned and sorted by key and
    merged in one linear pass (a sort-merge join); hot keys are salted, their single
    parent row copied per salt. reason is ``missing``, ``deleted`` or ``late`` (the
    parent begins after the reference; where both times are known). Each distinct
    reference comes out once, under the first reason that holds in that order, with
    its earliest ``ref_at`` and with ``made``: whether it was made before, during or after
    its parent's interval (never: no parent; unknown: a time is; of repeats the first by name). Empty inputs: without parents all references are missing.
    """
    hot = hot_keys(refs)
    is_hot = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    left = refs.withColumn("_salt", F.when(is_hot("missing_key"), F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    right = parents.withColumn("_salt", F.explode(F.when(is_hot("parent_key"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    joined = left.join(
        right.hint("merge"),
        (left["missing_key"] == right["parent_key"]) & (left["_salt"] == right["_salt"]),
        "left",
    )
    reason = (
        F.when(F.col("parent_key").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("valid_from") > F.col("ref_at"), "late")
    )
    valid_to = F.col("valid_to") if "valid_to" in parents.columns else F.lit(None)
    made = (
        F.when(F.col("parent_key").isNull(), "never")
        .when(F.col("ref_at") < F.col("valid_from"), "before")
        .when(F.col("ref_at") > valid_to, "after")
        .when(F.col("ref_at") >= F.col("valid_from"), "during")
        .otherwise("unknown")
    )
    rank = F.when(F.col("reason") == "missing", 0).when(F.col("reason") == "deleted", 1).otherwise(2)
    return (
        joined.withColumn("reason", reason).withColumn("made", made)
        .where(F.col("reason").isNotNull())
        .groupBy("ref_table", "record_id", "field_name", "missing_key")
        .agg(F.min_by("reason", rank).alias("reason"), F.min("ref_at").alias("ref_at"), F.min("made").alias("made"))
    )


def neuron_parents(neurons: DataFrame) -> DataFrame:
    """One row per neuron id: the current row's validity."""
    return current_rows(neurons, "id", "updated_at", ["deleted_at", "created_at"]).select(
        F.col("id").alias("parent_key"),
        F.col("created_at").alias("valid_from"),
        F.col("deleted_at").alias("valid_to"),
        F.col("deleted_at").isNotNull().alias("gone"),
    )


def chunk_parents(chunk_metadata: DataFrame) -> DataFrame:
    """One row per chunk hash; of repeated rows the largest ref_count and the earliest known time count."""
    return (
        chunk_metadata.select(tidy("hash").alias("parent_key"), "created_at", "ref_count")
        .where(F.col("parent_key").isNotNull())
        .groupBy("parent_key")
        .agg(F.min("created_at").alias("valid_from"), F.max("ref_count").alias("_n"))
        .select("parent_key", "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.coalesce(F.col("_n") <= 0, F.lit(False)).alias("gone"))
    )


def memory_dangling(neurons: DataFrame, synapses: DataFrame, chunk_metadata: DataFrame) -> DataFrame:
    """Dangling endpoints of synapses and dangling chunk hashes of current neurons (deleted ones included)."""
    ends = synapses.select(
        tidy("id").alias("_id"),
        "created_at",
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), tidy(f).alias("k")) for f in ("source_id", "target_id")])).alias("_e"),
    )
    edge_refs = ends.select(
        F.lit("synapses").alias("ref_table"),
        F.col("_id").alias("record_id"),
        F.col("_e.f").alias("field_name"),
        F.col("_e.k").alias("missing_key"),
        F.col("created_at").alias("ref_at"),
    ).where(F.col("missing_key").isNotNull())
    owners = current_rows(neurons, "id", "updated_at", ["chunk_hashes", "created_at"])
    hashes = owners.select("id", "created_at", F.explode("chunk_hashes").alias("_h"))
    chunk_refs = references(hashes, "neurons", F.col("id"), "chunk_hashes", tidy("_h"), F.col("created_at"))
    return reduce(DataFrame.unionByName, [dangling(edge_refs, neuron_parents(neurons)), dangling(chunk_refs, chunk_parents(chunk_metadata))])


def dangling_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, reason and month of the record's created_at (null: unknown)."""
    return (
        found.groupBy("ref_table", "field_name", "reason", F.date_format("ref_at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n_refs"), F.countDistinct("record_id").alias("n_records"))
    )


def interval_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, reason and place of the reference beside its parent's validity interval."""
    return found.groupBy("ref_table", "field_name", "reason", "made").agg(F.count("*").alias("n_refs"))
