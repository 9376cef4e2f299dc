"""Chunking, content-addressed storage and integrity of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.hashing import MASK, POLYNOMIAL, digest


def fixed_chunks(df: DataFrame, key: str, data: Column, size: int = 4096, algorithm: str = "sha3") -> DataFrame:
    """(key, idx, byte_offset, size, data, hash): slices of ``size`` bytes without overlap; empty and null data have none."""
    rows = df.select(key, data.alias("_d")).where("octet_length(_d) > 0")
    rows = rows.select(key, "_d", F.posexplode(F.sequence(F.lit(0), F.expr("octet_length(_d) - 1"), F.lit(size))).alias("idx", "_o"))
    piece = F.substring("_d", F.col("_o") + 1, F.lit(size))
    rows = rows.select(key, "idx", F.col("_o").cast("long").alias("byte_offset"), piece.alias("data"))
    return rows.select(key, "idx", "byte_offset", F.octet_length("data").cast("long").alias("size"), "data", digest(F.col("data"), algorithm).alias("hash"))


def content_cuts(data: bytes, smallest: int, largest: int) -> list[int]:
    """Ends of content-defined chunks: where the rolling fingerprint's low bits vanish, within the sizes."""
    cuts, fp, begun = [], 0, 0
    for i, byte in enumerate(data, 1):
        fp = (fp << 1 ^ byte) % POLYNOMIAL
        n = i - begun
        if n >= largest or n >= smallest and not fp & MASK:
            cuts.append(i)
            fp, begun = 0, i
    if begun < len(data):
        cuts.append(len(data))
    return cuts


def content_chunks(df: DataFrame, key: str, data: Column, smallest: int = 2048, largest: int = 65536, algorithm: str = "sha3") -> DataFrame:
    """As fixed_chunks, with content-defined boundaries that survive insertions."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                for i, z in enumerate(content_cuts(d, smallest, largest)):
                    out.append((k, i, at, z - at, d[at:z]))
                    at = z
            columns = list(zip(*out)) or [()] * 5
            kinds = (b.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[key, "idx", "byte_offset", "size", "data"])

    rows = df.select(key, data.cast("binary").alias("_d")).where("octet_length(_d) > 0")
    return rows.mapInArrow(run, f"`{key}` {kind}, idx int, byte_offset long, size long, data binary").withColumn("hash", digest(F.col("data"), algorithm))


def merge(chunks: DataFrame, key: str, data: str = "data", idx: str = "idx") -> DataFrame:
    """(key, data): a record's chunks in order of ``idx``, joined; a record fits a row by definition."""
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(idx, F.hex(data).alias("_h")))).alias("_p"))
    return parts.select(key, F.unhex(F.array_join(F.transform("_p", lambda x: x["_h"]), "")).alias("data"))


def stored(chunks: DataFrame) -> DataFrame:
    """(hash, size, ref_count, first_offset): one row per content; each further copy only counts."""
    return chunks.groupBy("hash").agg(F.max("size").alias("size"), F.count("*").alias("ref_count"), F.min("byte_offset").alias("first_offset"))


def released(store: DataFrame, releases: DataFrame) -> DataFrame:
    """The store after ``releases`` (hash, n): counts fall, contents without references go."""
    gone = releases.groupBy("hash").agg(F.sum("n").alias("_n"))
    return store.join(gone, "hash", "left").withColumn("ref_count", F.col("ref_count") - F.coalesce("_n", F.lit(0))).where("ref_count > 0").drop("_n")


def collected(store: DataFrame, referenced: DataFrame) -> DataFrame:
    """Contents with references that a live record names."""
    return store.where("ref_count > 0").join(referenced.select("hash").distinct(), "hash", "left_semi")


def chunk_stats(chunks: DataFrame, size: str = "size") -> DataFrame:
    """Count, total, rounded mean, smallest and largest; zeros without chunks."""
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return chunks.agg(F.count("*").alias("n_chunks"), z(F.sum(size)).alias("total_size"), z(F.round(F.avg(size)).cast("long")).alias("avg_size"), z(F.min(size)).alias("min_size"), z(F.max(size)).alias("max_size"))


def dedup_report(chunks: DataFrame) -> DataFrame:
    """(hash, copies, first_key saved_bytes) of contents that occur more than once."""
    by = chunks.groupBy("hash").agg(F.count("*").alias("copies"), F.sum("size").alias("_all"), F.max("size").alias("_one"))
    return by.where("copies > 1").select("hash", "copies", (F.col("_all") - F.col("_one")).alias("saved_bytes"))


def integrity(chunks: DataFrame, named: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """(hash, status) of the ``named`` hashes: valid, corrupted (bytes don't hash to it) or missing."""
    have = chunks.select(F.col("hash").alias("_h"), digest(F.col("data"), algorithm).alias("_real")).groupBy("_h").agg(F.max(F.col("_real") == F.col("_h")).alias("_ok"))
    j = named.select("hash").distinct().join(have, F.col("hash") == F.col("_h"), "left")
    return j.select("hash", F.when(F.col("_h").isNull(), "missing").when(F.col("_ok"), "valid").otherwise("corrupted").alias("status"))


def record_content(records: DataFrame, key: str, hashes: str, store: DataFrame) -> DataFrame:
    """(key, content): the chunks a record names, in the record's order; missing ones are left out."""
    named = records.select(key, F.posexplode(hashes).alias("_i", "hash"))
    one = store.groupBy("hash").agg(F.max("data").alias("data"))
    return merge(named.join(one, "hash"), key, "data", "_i").withColumnRenamed("data", "content")
