"""A stored vector index: inverted lists in a table, for repeated searches, inserts, deletes and compaction."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import vectors as V
from memlattice.operators.similarity import _blocks
from memlattice.session import materialize, shared_dir

#: Rows the centroids are fitted on, lists at most, rows of a list that one task holds.
SAMPLE, LISTS, BLOCK = 16384, 4096, 8192


def _fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of unit rows: seeds far apart by squared distance, a few rounds of means."""
    rng = np.random.default_rng(17)
    first = int(rng.integers(len(x)))
    chosen, cost = [first], np.maximum(1 - x @ x[first], 0)
    while len(chosen) < min(lists, len(x)) and cost.sum() > 1e-9:
        i = int(rng.choice(len(x), p=cost / cost.sum()))
        chosen.append(i)
        cost = np.minimum(cost, np.maximum(1 - x @ x[i], 0))
    c = x[chosen]
    for _ in range(5):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _placed(centres: np.ndarray, probes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = np.asarray(v.flatten(), "f8").reshape(len(v), -1) if len(v) else np.zeros((0, centres.shape[1]))
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ centres.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column("id"), v, pa.array(list(top.astype("i4")), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    return run, f"id {kind}, v array<double>, lists array<int>"


class VectorIndex:
    """Vectors of one length in lists of near ones, in a folder: ``lists`` (parquet by list), ``gone`` (deleted
    ids) and ``index.json`` (centroids). A folder that is there already is opened as it is."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or os.path.join(shared_dir(spark), f"index-{uuid.uuid4().hex[:10]}")

    # centroids and the current version are one row of text
    def _meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/meta").orderBy(F.desc("value")).first()["value"].split(" ", 1)[1])

    def _put(self, meta: dict) -> None:
        meta["version"] = meta.get("version", 0) + 1
        self.spark.createDataFrame([(f"{meta['version']:012d} {json.dumps(meta)}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/meta")

    def rows(self) -> DataFrame:
        """(id, v, list) of what is in the index, deleted rows left out."""
        meta = self._meta()
        kind = meta["kind"]
        schema = f"id {kind}, v array<double>, list int"
        all_ = self.spark.read.schema(schema).parquet(*[f"{self.path}/lists/{p}" for p in meta["parts"]]) if meta["parts"] else self.spark.createDataFrame([], schema)
        if not meta["gone"]:
            return all_
        gone = self.spark.read.schema(f"id {kind}").parquet(*[f"{self.path}/gone/{p}" for p in meta["gone"]])
        return all_.join(gone.distinct(), "id", "left_anti")

    def _clean(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), V.doubles(vector).alias("v")).where("id IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")

    def _write(self, rows: DataFrame, meta: dict) -> str:
        run, shape = _placed(np.array(meta["centres"]), 1, meta["kind"])
        part = uuid.uuid4().hex[:10]
        placed = rows.select("id", "v").mapInArrow(run, shape).select("id", "v", F.col("lists")[0].alias("list"))
        placed.repartitionByRange("list").sortWithinPartitions("list").write.parquet(f"{self.path}/lists/{part}")
        return part

    def build(self, df: DataFrame, key: str, vector: str, lists: int | None = None) -> VectorIndex:
        """Indexes every row of ``df`` (ids once); centroids are fitted on at most SAMPLE of them, by id hash."""
        rows = self._clean(df, key, vector)
        n = rows.count()
        share = min(1.0, SAMPLE / max(n, 1))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("id").select("v").toArrow().column("v").to_pylist()
        x = np.array(sample or [[1.0]], "f8")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        meta = {"kind": dict(rows.dtypes)["id"], "dim": x.shape[1], "centres": _fitted(x, lists or max(1, min(LISTS, int(n**0.5)))).tolist(), "parts": [], "gone": [], "version": 0}
        meta["parts"].append(self._write(rows.where(F.size("v") == meta["dim"]), meta))
        self._put(meta)
        return self

    def insert(self, df: DataFrame, key: str, vector: str) -> None:
        """Adds rows to their lists; an id that is there already, or twice among them, raises an error."""
        meta, rows = self._meta(), materialize(self._clean(df, key, vector), "inserted")
        if rows.where(F.size("v") != meta["dim"]).limit(1).count():
            raise ValueError("a vector has another length than the index")
        if rows.join(self.rows().select("id"), "id", "left_semi").limit(1).count() or rows.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("a vector with this id is in the index")
        if meta["gone"]:  # an id that was deleted may come again
            self.compact()
            meta = self._meta()
        meta["parts"].append(self._write(rows, meta))
        self._put(meta)

    def delete(self, ids: DataFrame, key: str = "id") -> None:
        """Marks ids as deleted; searches no longer give them, ``compact`` removes them."""
        meta, part = self._meta(), uuid.uuid4().hex[:10]
        ids.select(F.col(key).cast(meta["kind"]).alias("id")).where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/gone/{part}")
        meta["gone"].append(part)
        self._put(meta)

    def compact(self) -> None:
        """Rewrites the lists without deleted rows, in one part."""
        meta = self._meta()
        meta["parts"], meta["gone"] = [self._write(self.rows(), meta)], []
        self._put(meta)

    def size(self) -> int:
        return self.rows().count()

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int = 8, least: float = -2.0, exclude_self: bool = True) -> DataFrame:
        """(id, other, score, rank): for each query its ``k`` best rows among those of the ``probes`` nearest lists.

        With as many probes as lists the result is exact. Lists are read once, those that no
        query probes not at all; longer ones than BLOCK are split, each block answering for
        itself. Ties go by id; queries of another length have no row.
        """
        meta = self._meta()
        probes = min(probes, len(meta["centres"]))
        run, shape = _placed(np.array(meta["centres"]), probes, meta["kind"])
        q = self._clean(queries, key, vector).where(F.size("v") == meta["dim"]).mapInArrow(run, shape)
        q = materialize(q.select("id", "v", F.explode("lists").alias("list")), "probes")
        touched = sorted(r["list"] for r in q.select("list").distinct().collect())  # LISTS at most
        rows = self.rows()
        if len(touched) < len(meta["centres"]):
            rows = rows.where(F.col("list").isin(touched))
        sizes = {r["list"]: -(-r["count"] // BLOCK) for r in rows.groupBy("list").count().collect()}  # LISTS at most
        many = {c: m for c, m in sizes.items() if m > 1}
        m = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in many.items() for x in p]), F.col("list")), F.lit(1)) if many else F.lit(1)
        base = rows.select("list", F.pmod(F.xxhash64("id"), m).cast("int").alias("b"), F.lit(0).alias("side"), "id", "v")
        asks = q.select("list", F.explode(F.sequence(F.lit(0), m - 1)).alias("b"), F.lit(1).alias("side"), "id", "v")
        cells = base.unionByName(asks).withColumn("cell", F.xxhash64("list", "b"))
        found = cells.repartition("cell").sortWithinPartitions("cell", "side").select("cell", "side", "id", "v").mapInArrow(_blocks(k, least, exclude_self), f"id {meta['kind']}, other {meta['kind']}, score double")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
        return ranked.where(F.col("rank") <= k)
