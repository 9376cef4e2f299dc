"""Usable neuron vectors and arithmetic on blocks of them.

A vector travels as the little-endian float32 bytes it was stored with; cosines that
decide anything are computed from these in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import current_wide

DIM = 384


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """A binary column of float32 vectors as a (rows, dim) array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, dim)


def unit(m: np.ndarray, dtype: str = "f8") -> np.ndarray:
    m = m.astype("f8")
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(dtype)


def _usable(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            starts = np.asarray(col.offsets)
            values = col.values
            flat = np.asarray(values.fill_null(np.nan) if values.null_count else values, dtype="<f4")
            sizes = np.diff(starts)
            keep = np.flatnonzero((sizes == dim) & np.asarray(col.is_valid()))
            if len(keep):
                m = flat[starts[keep][:, None] + np.arange(dim)]
                good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                keep, m = keep[good], m[good]
            if len(keep):
                rest = [b.column(i).take(pa.array(keep)) for i, f in enumerate(b.schema) if f.name != "embedding"]
                names = [f.name for f in b.schema if f.name != "embedding"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([v.tobytes() for v in m], pa.binary())], names=[*names, "vec"])

    return run


def usable_neurons(neurons: DataFrame, dim: int = DIM, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, vec): the current row of each id that isn't deleted and whose
    embedding has ``dim`` finite values, not all zero. Null, empty, short, NaN and zero
    embeddings drop out; repeated rows count once; extra columns of the table are ignored.
    """
    now = current_wide(neurons, "id", "updated_at", ["deleted_at", *extra, "embedding"]).where("deleted_at IS NULL")
    now = now.select("id", *extra, F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") == dim)
    types = dict(now.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in ("id", *extra)), "vec binary"])
    return now.mapInArrow(_usable(dim), schema)


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Spherical k-means of unit rows; a centre without rows stays."""
    w = np.ones(len(x), "f4") if weights is None else weights.astype("f4")
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x * w[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def seeds(x: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ seeds among unit rows (by weighted squared distance)."""
    w = np.ones(len(x)) if weights is None else weights.astype("f8")
    first = int(rng.choice(len(x), p=w / w.sum()))
    chosen, cost = [first], np.maximum(2 - 2 * (x @ x[first]), 0).astype("f8")
    for _ in range(min(k, len(x)) - 1):
        p = cost * w
        if p.sum() <= 1e-9:
            break
        i = int(rng.choice(len(x), p=p / p.sum()))
        chosen.append(i)
        cost = np.minimum(cost, np.maximum(2 - 2 * (x @ x[i]), 0))
    return x[chosen]
