"""Similarity clusters: hashed weighted features, k-means with parallel oversampled seeding,
and the exact threshold graph inside the cells."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.keys import bounded, tidy
from memlattice.llm.vectors import DIM, lloyd, matrix, seeds, unit, usable_neurons
from memlattice.operators.components import connected_components
from memlattice.session import materialize

#: Cells at most; up to 4.3 billion rows their number grows with the root of the rows.
MAX_CELLS = 65536
#: Rows of a cell that meet in one task; fuller cells are split into half blocks that meet pairwise.
BLOCK = 2048
#: A row also goes to the cells whose centre has this share of the nearest one's similarity, less a margin.
SHARE, MARGIN = 0.7, 0.08


def metadata_terms(metadata: Column) -> Column:
    """Terms of a neuron's metadata JSON: ``tag:x`` and ``source:x``; cut off or null JSON gives none.

    ``tags`` may be a list or one string; blank entries drop out, repeats count once.
    """
    tags = F.get_json_object(metadata, "$.tags")
    listed = F.coalesce(F.from_json(tags, "array<string>"), F.array(tags))
    tagged = F.transform(F.filter(F.transform(listed, tidy), lambda t: t.isNotNull() & (t != "")), lambda t: F.concat(F.lit("tag:"), t))
    source = F.concat(F.lit("source:"), tidy(F.get_json_object(metadata, "$.sourceType")))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(tagged, F.array().cast("array<string>")), F.array(source))))


def features(x: np.ndarray, terms: list[list[str] | None], weight: float, hashed: int) -> np.ndarray:
    """Unit rows: the unit embedding beside ``weight`` times the unit hashed terms (signed hashing; CRC-32)."""
    h = np.zeros((len(x), hashed), "f4")
    for i, row in enumerate(terms):
        for t in row or ():
            c = zlib.crc32(t.encode())
            h[i, c % hashed] += 1.0 if c >> 31 else -1.0
    n = np.linalg.norm(h, axis=1, keepdims=True)
    f = np.concatenate([unit(x, "f4"), weight * h / np.maximum(n, 1e-9)], axis=1)
    return f / np.linalg.norm(f, axis=1, keepdims=True)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as scale, norm of the rounding error (float32 each) and a signed byte a value."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30) / 127
    codes = np.rint(x / scale).astype("i1")
    left = np.linalg.norm(codes * scale - x, axis=1, keepdims=True)
    head = np.concatenate([scale, left * (1 + 1e-5) + 1e-7], axis=1).astype("<f4")
    return [h.tobytes() + c.tobytes() for h, c in zip(head, codes)]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, norms of their errors) of ``packed`` rows."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 0), "f4"), np.zeros(0, "f4")
    raw = np.frombuffer(b"".join(rows), "u1").reshape(len(rows), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return raw[:, 8:].view("i1") * head[:, :1], head[:, 1]


def _featured(weight: float, hashed: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                x = matrix(b.column("vec"), dim)
                f = features(x, b.column("terms").to_pylist(), weight, hashed)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed(unit(x)), pa.binary()), pa.array(packed(f[:, dim:]), pa.binary())], names=["id", "code", "side"])

    return run


def feature_rows(b: pa.RecordBatch) -> np.ndarray:
    """The unit feature rows of a batch with ``code`` and ``side``."""
    x, side = unpacked(b.column("code"))[0], unpacked(b.column("side"))[0]
    f = np.concatenate([x * np.sqrt(np.maximum(1 - (side**2).sum(axis=1, keepdims=True), 0)), side], axis=1)
    return (f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-12)).astype("f4")


def _costs(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of unit rows to the nearest centre."""
    return np.maximum(2 - 2 * (rows @ centres.T).max(axis=1), 1e-12).astype("f8")


def _cost_sum(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float(_costs(feature_rows(b), centres).sum()) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["cost"])

    return run


def _oversample(centres: np.ndarray, factor: float, seed: int):
    """Each row with a chance of ``factor`` times its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(b)
            # the same row draws the same number in every attempt
            u = np.array([(zlib.crc32(f"{seed}:{i}".encode()) + 0.5) / 2**32 for i in b.column("id").to_pylist()])
            at = np.flatnonzero(u < factor * _costs(x, centres)) if len(x) else []
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["id", "feat"])

    return run


def _sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centres.shape, "f8"), np.zeros(len(centres), "i8")
        for b in batches:
            x = feature_rows(b)
            near = (x @ centres.T).argmax(axis=1)
            order = np.argsort(near, kind="stable")
            at = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1]]) if len(near) else np.empty(0, int)
            sums[near[order][at]] += np.add.reduceat(x[order].astype("f8"), at, axis=0) if len(at) else 0
            n += np.bincount(near, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(n[at]), pa.array([r.tobytes() for r in sums[at]], pa.binary())], names=["cell", "n", "total"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of the cells in a partition."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, k, t in zip(*(x.to_pylist() for x in b.columns)):
            v = np.frombuffer(t, "f8")
            n[c], total[c] = n.get(c, 0) + k, total[c] + v if c in total else v.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["cell", "n", "total"])


def _totals(feats: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum per centre over all rows; MAX_CELLS rows at most reach the driver."""
    shape = "cell int, n long, total binary"
    rows = feats.select("code", "side").mapInArrow(_sums(centres), shape).repartition("cell").mapInArrow(_merged, shape).toArrow()
    n, total = np.zeros(len(centres), "i8"), np.zeros(centres.shape, "f8")
    for c, k, t in zip(*(x.to_pylist() for x in rows.columns)):
        n[c], total[c] = k, np.frombuffer(t, "f8")
    return n, total


def kmeans(feats: DataFrame, k: int, rounds: int = 3, iterations: int = 3, seed: int = 11) -> np.ndarray:
    """Unit centres (at most ``k``) of the feature rows of (id, code, side), every pass over all rows.

    Seeding: ``rounds`` times, each row is drawn with a chance in proportion to its
    squared distance to the candidates so far, k draws a round as the expected number
    (so its spread is below the root of k). The candidates, weighted by the rows nearest to
    them, are clustered to k on the driver (rounds · k rows). Centres move until less than a
    thousandth of the rows' similarity changes, ``iterations`` times at most.
    """
    lowest = feats.agg(F.min("id")).first()[0]
    if lowest is None:
        return np.zeros((0, 1), "f4")
    first = feats.select("id", "code", "side").where(F.col("id") == lowest).limit(1).toArrow()
    candidates = feature_rows(first.combine_chunks().to_batches()[0])
    for r in range(rounds):
        total = feats.select("code", "side").mapInArrow(_cost_sum(candidates), "cost double").agg(F.sum("cost")).first()[0]
        drawn = feats.select("id", "code", "side").mapInArrow(_oversample(candidates, k / total, seed + r), "id string, feat binary").toArrow().sort_by("id")
        if drawn.num_rows:
            candidates = np.concatenate([candidates, matrix(drawn.column("feat"), candidates.shape[1])])
    weights, _ = _totals(feats, candidates)
    rng = np.random.default_rng(seed)
    centres = lloyd(candidates, seeds(candidates, k, rng, weights + 1e-3), 5, weights)
    fit = 0.0
    for _ in range(iterations):
        n, total = _totals(feats, centres)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centres).astype("f4")
        before, fit = fit, float(norm.sum())
        if fit - before < 1e-3 * fit:
            break
    return centres


def _cells(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = feature_rows(b) @ centres.T
            m = min(probes, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            value = np.take_along_axis(s, top, axis=1)
            row, col = np.nonzero(value >= SHARE * value.max(axis=1, keepdims=True) - MARGIN)
            yield pa.RecordBatch.from_arrays([pa.array(top[row, col].astype("i4")), b.column("id").take(pa.array(row)), b.column("code").take(pa.array(row))], names=["cell", "id", "code"])

    return run


def _counts(centres: np.ndarray, probes: int):
    """Rows that ``_cells`` sends to each cell, per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centres), "i8")
        for b in _cells(centres, probes)(x for x in batches if x.num_rows):
            n += np.bincount(b.column("cell").to_numpy(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(n[at])], names=["cell", "n"])

    return run


def _label(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest linked row) after joining the pairs ``near``."""
    near = near[label[near[:, 0]] != label[near[:, 1]]]
    while len(near):
        low = np.minimum(label[near[:, 0]], label[near[:, 1]])
        new = np.arange(len(label))
        for side in (0, 1):
            np.minimum.at(new, label[near[:, side]], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        near = near[label[near[:, 0]] != label[near[:, 1]]]
    return label


def _join_block(x: np.ndarray, left: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(component, in doubt) of rows whose true unit vectors are within ``left`` of ``x``.

    The component (its smallest row) follows from the pairs that surely have a cosine of
    ``least``; in doubt are rows of pairs that may have it and that would join components.
    """
    n = len(x)
    label, x4, doubtful = np.arange(n), x.astype("f4"), []
    for i in range(0, n, 1024):
        s = x4[i : i + 1024] @ x4.T
        slack = left[i : i + 1024, None] * 1.0001 + left + (left[i : i + 1024, None] * left + 1e-5)
        a, b = np.nonzero(s >= least - slack)
        keep = a + i < b
        a, b = a[keep], b[keep]
        sure = s[a, b] >= least + slack[a, b]
        label = _label(np.stack([a[sure] + i, b[sure]], axis=1), label)
        doubtful.append(np.stack([a[~sure] + i, b[~sure]], axis=1))
    pairs = np.concatenate(doubtful) if doubtful else np.empty((0, 2), int)
    if not left.any():  # exact rows: double precision decides
        for i in range(0, len(pairs), 65536):
            p = pairs[i : i + 65536]
            label = _label(p[np.einsum("ij,ij->i", x[p[:, 0]], x[p[:, 1]]) >= least], label)
        return label, np.zeros(n, bool)
    doubt = np.zeros(n, bool)
    doubt[pairs[label[pairs[:, 0]] != label[pairs[:, 1]]].ravel()] = True
    return label, doubt


def _linker(least: float, dim: int, exact: bool):
    """Groups (cell, block): rows (cell, block, a, b): b is linked with a; without b, a is in doubt there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = table.column("id").combine_chunks()
            if exact:
                x = unit(matrix(table.column("code"), dim))
                left = np.zeros(len(x), "f4")
            else:
                x, left = unpacked(table.column("code"))
            label, doubt = _join_block(x, left, least)
            b, d = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(doubt)
            n = len(b) + len(d)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key[0], "i4")), pa.array(np.full(n, key[1], "i8")), ids.take(pa.array(np.concatenate([label[b], d]))), pa.concat_arrays([ids.take(pa.array(b)), pa.nulls(len(d), pa.string())])],
                names=["cell", "block", "a", "b"],
            )

        for batch in batches:
            cells, blocks = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1])) + 1), len(cells)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                now = int(cells[a]), int(blocks[a])
                if now != key and held:
                    yield close()
                key = now
                held.append(batch.slice(a, z - a))
        if held:
            yield close()

    return run


def links(rows: DataFrame, exact: DataFrame, centres: np.ndarray, least: float, probes: int, dim: int) -> DataFrame:
    """Links (a, b) that join rows of a cell as their cosines of ``least`` or more do.

    ``rows`` (id, code, side) travel with a byte a value; where the rounding leaves a pair
    that would join components in doubt, its two rows meet again in that cell with their
    whole vectors of ``exact`` (id, vec), so the result is that of exact cosines. A cell
    above BLOCK rows is split into half blocks, and every two of them meet in a task, so
    all its pairs are compared.
    """
    shape = "cell int, block long, a string, b string"
    rows = rows.select("id", "code", "side")
    counts = rows.mapInArrow(_counts(centres, probes), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sizes = {r["cell"]: -(-r["n"] // BLOCK) for r in counts.where(F.col("n") > BLOCK).collect()}  # at most MAX_CELLS counts
    v = rows.mapInArrow(_cells(centres, probes), "cell int, id string, code binary")
    many = {c: 2 * m for c, m in sizes.items()}
    split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in many.items() for x in p]), F.col("cell")), F.lit(1)) if many else F.lit(1)
    v = v.withColumn("_m", split).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    # a half block meets itself beside each of the others
    v = v.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).where("_m = 1 OR _o <> _b")
    tile = F.least("_b", "_o").cast("long") * F.col("_m") + F.greatest("_b", "_o")
    tiles = v.select("cell", tile.alias("block"), "id", "code")
    done = materialize(tiles.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_linker(least, dim, False), shape), "links")
    found = done.where("b IS NOT NULL").select("a", "b")
    doubt = done.where("b IS NULL").select("cell", "block", F.col("a").alias("id"))
    n = doubt.count()
    if n:
        again = exact.join(bounded(doubt, n), "id").select("cell", "block", "id", F.col("vec").alias("code"))
        found = found.unionByName(again.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_linker(least, dim, True), shape).select("a", "b"))
    return found


def vectorise(neurons: DataFrame, weight: float = 0.2, hashed: int = 64, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """((id, code, side) of the usable neurons, written once; (id, vec, terms) from the table)."""
    vectors = usable_neurons(neurons, dim, ("metadata",)).select("id", "vec", metadata_terms(F.col("metadata")).alias("terms"))
    return materialize(vectors.mapInArrow(_featured(weight, hashed, dim), "id string, code binary, side binary"), "features"), vectors


def default_cells(n: int) -> int:
    return max(1, min(MAX_CELLS, int(n**0.5)))


def similarity_clusters(neurons: DataFrame, least: float = 0.5, smallest: int = 3, cells: int | None = None, probes: int = 6, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(members (cluster_id, neuron_id), rows (id, vec, terms) of all usable neurons).

    The k-means cells bound which rows meet: each usable neuron goes to up to ``probes``
    of its nearest cells, cosines decide inside a cell, and the links' connected components
    with at least ``smallest`` members are the clusters, named by their smallest id.
    Without usable neurons there are no rows.
    """
    rows, vectors = vectorise(neurons, dim=dim)
    n = rows.count()
    if n == 0:
        return neurons.sparkSession.createDataFrame([], "cluster_id string, neuron_id string"), vectors
    centres = kmeans(rows, cells or default_cells(n))
    found = connected_components(links(rows, vectors.select("id", "vec"), centres, least, probes, dim), "a", "b").select(F.col("component").alias("cluster_id"), F.col("node").alias("neuron_id"))
    big = found.groupBy("cluster_id").count().where(F.col("count") >= smallest).select("cluster_id")
    return found.join(big, "cluster_id", "left_semi"), vectors


def _centred(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums of unit vectors per cluster of the partition."""
        total: dict[str, list] = {}
        for b in batches:
            x = unit(matrix(b.column("vec"), dim))
            for c, v in zip(b.column("cluster_id").to_pylist(), x):
                t = total.setdefault(c, [0, np.zeros(dim)])
                t[0] += 1
                t[1] += v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tobytes() for t in total.values()], pa.binary())], names=["cluster_id", "n", "total"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list] = {}
    for b in batches:
        for c, n, t in zip(*(x.to_pylist() for x in b.columns)):
            v = np.frombuffer(t, "f8")
            o = total.setdefault(c, [0, np.zeros(len(v))])
            o[0] += n
            o[1] = o[1] + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([(t[1] / max(np.linalg.norm(t[1]), 1e-12)).astype("f4").tobytes() for t in total.values()], pa.binary())], names=["cluster_id", "n", "centre"])


def _closeness(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.einsum("ij,ij->i", unit(matrix(b.column("vec"), dim)), matrix(b.column("centre"), dim).astype("f8"))
            yield pa.RecordBatch.from_arrays([b.column("cluster_id"), b.column("neuron_id"), pa.array(np.round(c, 6))], names=["cluster_id", "neuron_id", "closeness"])

    return run


def describe(members: DataFrame, rows: DataFrame, typical: int = 3, shared: float = 0.5, dim: int = DIM) -> DataFrame:
    """Per cluster: size, the ``typical`` members nearest the centroid (ties by id), and the
    metadata terms that at least the share ``shared`` of its members have, most frequent first.
    """
    full = members.join(rows.select(F.col("id").alias("neuron_id"), "vec", "terms"), "neuron_id")
    full = materialize(full, "members")
    centres = full.select("cluster_id", "vec").mapInArrow(_centred(dim), "cluster_id string, n long, total binary").repartition("cluster_id").mapInArrow(_added, "cluster_id string, n long, centre binary")
    centres = materialize(centres, "centres")
    close = full.join(centres, "cluster_id").select("cluster_id", "neuron_id", "vec", "centre").mapInArrow(_closeness(dim), "cluster_id string, neuron_id string, closeness double")
    # the best few per task first, so that a large cluster isn't gathered
    part = F.pmod(F.xxhash64("neuron_id"), F.lit(64))
    by = [F.desc("closeness"), "neuron_id"]
    near = close.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "_p").orderBy(*by))).where(F.col("_r") <= typical)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*by))).where(F.col("rank") <= typical)
    best = near.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neuron_id"))), lambda x: x["neuron_id"]).alias("typical_members"), F.max("closeness").alias("closeness"))
    terms = full.select("cluster_id", F.explode("terms").alias("term")).groupBy("cluster_id", "term").count()
    common = terms.join(centres.select("cluster_id", "n"), "cluster_id").where(F.col("count") >= shared * F.col("n"))
    common = common.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "term"))), lambda x: x["term"]).alias("common_terms"))
    return centres.select("cluster_id", F.col("n").alias("size")).join(best, "cluster_id").join(common, "cluster_id", "left").withColumn("common_terms", F.coalesce("common_terms", F.array().cast("array<string>")))
