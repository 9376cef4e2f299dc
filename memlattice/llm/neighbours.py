"""The most similar vectors of every vector: inverted file, product quantisation, exact reranking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.keys import bounded
from memlattice.llm.vectors import DIM, lloyd, matrix, seeds, unit
from memlattice.session import discard, materialize

#: Rows that centroids and codebooks are fitted on, and rows for each list where that is more; every row is indexed.
FIT_ROWS, FIT_PER_LIST = 16384, 4
#: Four times as many a list as long as they are no more than this.
FIT_MORE = 65536
#: From so many vectors on small groups have no list of their own: what the lists give is refined by the
#: neighbours of neighbours, in ROUNDS rounds at most, until one brings less than ENOUGH of the pairs there are.
REFINE_FROM, ROUNDS, ENOUGH = 65536, 3, 0.005
#: Rows around a centre that are compared at once.
AROUND = 256
#: Lists at most; up to 4.3 billion vectors their number grows with the root of the rows.
MAX_LISTS = 131072
#: Rows of a list that one group holds in memory; longer lists are split into blocks.
BLOCK = 16384
#: A query also goes to the lists whose centroid has this share of the nearest one's similarity, less a margin.
SHARE, MARGIN = 0.75, 0.02
#: Times as many lists where their centroids are themselves as similar as a neighbour must be: a dense
#: group is cut into many lists.
DENSE = 4
#: The tables' error that reranking allows for, in parts of a row's quantisation error.
BAND = 0.25


@dataclass
class Index:
    """Coarse centroids (lists, dim), codebooks of the residuals (parts, codes, dim / parts), blocks of each list."""

    centres: np.ndarray
    books: np.ndarray
    blocks: np.ndarray


def tree(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of unit rows; many are fitted in two levels, each top cell having its share."""
    few = lambda y, k: lloyd(y, seeds(y[: 24 * k], k, rng), 6)
    if lists <= 1024:
        return few(x, lists)
    top = few(x[: 64 * int(lists**0.5)], int(lists**0.5))
    near = np.concatenate([(x[i : i + 4096] @ top.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    return np.concatenate([few(x[near == c], max(1, round(lists * (near == c).mean()))) for c in range(len(top)) if (near == c).any()])


def fit(rows: DataFrame, lists: int, n: int, parts: int = 48, codes: int = 256, dim: int = DIM, seed: int = 7) -> Index:
    """Fit on the rows (id, vec) of a bounded sample, on the driver; ``n`` is the number of all rows."""
    table = rows.select("id", "vec").toArrow().sort_by("id")
    rng = np.random.default_rng(seed)
    if table.num_rows == 0:
        return Index(np.zeros((1, dim), "f4"), np.zeros((parts, 1, dim // parts), "f4"), np.ones(1, "i8"))
    x = unit(matrix(table.column("vec"), dim), "f4")[rng.permutation(table.num_rows)]
    centres = tree(x, lists, rng)
    near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    # blocks of a list from its share of the sample: it only decides how the work is cut
    blocks = np.ceil(1.5 * np.bincount(near, minlength=len(centres)) / len(x) * n / BLOCK).astype("i8")
    few = x[:FIT_ROWS]
    residual = (few - centres[near[:FIT_ROWS]]).reshape(len(few), parts, dim // parts)
    books = np.zeros((parts, min(codes, len(few)), dim // parts), "f4")
    for p in range(parts):
        r = np.ascontiguousarray(residual[:, p])
        c = r[rng.choice(len(r), books.shape[1], replace=False)]
        for _ in range(4):
            code = nearest_code(r, c)
            n_of = np.bincount(code, minlength=len(c))
            s = np.stack([np.bincount(code, weights=r[:, j], minlength=len(c)) for j in range(r.shape[1])], axis=1)
            c = np.where(n_of[:, None] > 0, s / np.maximum(n_of, 1)[:, None], c).astype("f4")
        books[p] = c
    return Index(centres, books, np.maximum(blocks, 1))


def nearest_code(r: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (r @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)


def encode(index: Index, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norm of what they leave) of the residuals of unit rows in the lists ``near``."""
    parts = len(index.books)
    r = (x - index.centres[near]).reshape(len(x), parts, -1)
    codes, left = np.empty((len(x), parts), "u1"), np.zeros(len(x), "f4")
    for p in range(parts):
        codes[:, p] = nearest_code(r[:, p], index.books[p])
        left += ((r[:, p] - index.books[p][codes[:, p]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


_SENT = "list int, block int, kind int, id string, vec binary, codes binary"


def _assign(index: Index, probes: int, margin: float, least: float, dim: int):
    """Each row goes to its own list (kind 0, with codes), and as a query (kind 1) to the other lists within the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                x = unit(matrix(b.column("vec"), dim), "f4")
                s = x @ index.centres.T
                m = min(DENSE * probes, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                value = np.take_along_axis(s, top, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
                near = top[:, 0]
                codes, left = encode(index, x, near)
                packed = [c.tobytes() + e.tobytes() for c, e in zip(codes, left)]
                # a list's blocks share its rows by the hash of the vector; every query meets all of them
                own = np.array([zlib.crc32(v) for v in b.column("vec").to_pylist()], "i8") % index.blocks[near]
                row, col = np.nonzero((value >= SHARE * value[:, :1] - margin) & ((np.arange(m) < probes) | (value >= least)))
                to = top[row, col]
                again = np.repeat(np.arange(len(row)), index.blocks[to])
                block = np.arange(len(again)) - np.repeat(np.cumsum(index.blocks[to]) - index.blocks[to], index.blocks[to])
                row, to = row[again], to[again]
                other = (to != near[row]) | (block != own[row])  # its own block holds it already
                row, to, block = row[other], to[other], block[other]
                at = pa.array(np.concatenate([np.arange(len(x)), row]))
                kinds = np.repeat(np.array([0, 1], "i4"), [len(x), len(row)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([near, to]).astype("i4")), pa.array(np.concatenate([own, block]).astype("i4")), pa.array(kinds), b.column("id").take(at), b.column("vec").take(at), pa.array(packed + [None] * len(row), pa.binary())],
                    names=["list", "block", "kind", "id", "vec", "codes"],
                )

    return run


class Base:
    """The rows of one block: vectors in single precision, codes and their errors, and the ids' order."""

    def __init__(self, index: Index, list_: int, parts: list[pa.RecordBatch], dim: int):
        self.index, self.list = index, list_
        table = pa.Table.from_batches(parts).combine_chunks()
        self.ids = table.column("id").combine_chunks()
        packed = np.frombuffer(b"".join(table.column("codes").to_pylist()), "u1").reshape(len(self.ids), -1)
        self.codes = np.ascontiguousarray(packed[:, :-4].T)
        self.left = np.ascontiguousarray(packed[:, -4:]).view("<f4")[:, 0]
        self.raw = matrix(table.column("vec"), dim)
        self.x = unit(self.raw, "f4")
        self.place = np.empty(len(self.ids), "i8")
        self.place[np.asarray(pc.sort_indices(self.ids))] = np.arange(len(self.ids))

    def scan(self, q: np.ndarray, own: np.ndarray | None, k: int, least: float, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of the ``k`` best rows of each query (raw float32); ``own``: the queries' rows here.

        Asymmetric tables (query part against codebook) add up over a row's codes. The
        ``rerank`` best rows by the tables are scored from their vectors and set the bar;
        other rows are scored only if the tables' sum, with the error that their
        quantisation leaves, may reach it, so no tie is cut by position.
        """
        q4 = unit(q, "f4")
        n, books = len(self.ids), self.index.books
        tables = np.matmul(books, q4.reshape(len(q4), len(books), -1).transpose(1, 2, 0))  # (parts, codes, queries)
        near = np.empty((len(q4), n), "f4")
        first = q4 @ self.index.centres[self.list]
        for i in range(0, n, 256):
            codes = self.codes[:, i : i + 256]
            sums = np.repeat(first[None], codes.shape[1], axis=0)
            one = np.empty_like(sums)
            for p in range(len(books)):
                np.take(tables[p], codes[p], axis=0, out=one, mode="clip")
                sums += one
            near[:, i : i + 256] = sums.T
        m = min(max(rerank, k + 1), n)
        top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(np.arange(n), near.shape)
        rough = np.einsum("qd,qmd->qm", q4, self.x[top])
        if own is not None:
            rough[top == own[:, None]] = -1
        kth = min(k, m)
        bar = np.maximum(np.partition(rough, -kth, axis=1)[:, -kth], least) - 4e-6
        may = near + BAND * self.left >= bar[:, None]
        np.put_along_axis(may, top, rough >= bar[:, None], axis=1)
        if own is not None:
            may[np.arange(len(q4)), own] = False
        row, col = np.nonzero(may)
        single = np.concatenate([np.einsum("ij,ij->i", q4[row[i : i + 8192]], self.x[col[i : i + 8192]]) for i in range(0, len(row), 8192)] or [np.empty(0, "f4")])
        keep = single >= bar[row]
        row, col, single = row[keep], col[keep], single[keep]
        # the k-th best of all that was scored is a sharper bar
        order = np.lexsort((-single, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        sharper = np.full(len(q4), -2.0)
        at = order[rank == k - 1]
        sharper[row[at]] = single[at] - 4e-6
        keep = single >= sharper[row]
        row, col = row[keep], col[keep]
        exact = np.concatenate([np.einsum("ij,ij->i", unit(q[row[i : i + 8192]]), unit(self.raw[col[i : i + 8192]])) for i in range(0, len(row), 8192)] or [np.empty(0)]).round(6)
        order = np.lexsort((self.place[col], -exact, row))
        rank = np.empty(len(row), "i8")
        rank[order] = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        keep = (rank < k) & (exact >= least)
        return row[keep], col[keep], exact[keep]


def _search(index: Index, k: int, least: float, rerank: int, dim: int):
    """Groups (list, block), their rows before queries: the rows are held, queries stream by."""

    def answers(base: Base, ids: pa.Array, q: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(q), 256):
            row, col, cosine = base.scan(q[i : i + 256], np.arange(i, min(i + 256, len(q))) if own else None, k, least, rerank)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i)), base.ids.take(pa.array(col)), pa.array(cosine)], names=["id", "neighbour", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, base = None, [], None
        for b in batches:
            lists, blocks, kinds = (b.column(c).to_numpy() for c in ("list", "block", "kind"))
            group = np.stack([lists, blocks, kinds])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1), len(lists)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                part, now = b.slice(a, z - a), (int(lists[a]), int(blocks[a]))
                if rows and (now != key or kinds[a] == 1):
                    base, rows = Base(index, key[0], rows, dim), []
                    yield from answers(base, base.ids, base.raw, True)
                if now != key:
                    key, base = now, base if now == key else None
                if kinds[a] == 0:
                    rows.append(part)
                elif base is not None:
                    yield from answers(base, part.column("id"), matrix(part.column("vec"), dim), False)
        if rows:
            base = Base(index, key[0], rows, dim)
            yield from answers(base, base.ids, base.raw, True)

    return run


def nearest(vectors: DataFrame, k: int = 5, least: float = 0.5, lists: int | None = None, probes: int = 6, rerank: int = 32, dim: int = DIM, margin: float = MARGIN) -> DataFrame:
    """(id, neighbour, cosine, rank): for every vector of (id, vec) its ``k`` most similar
    others by cosine rounded to 6 digits, then by smaller id; only cosines of ``least`` or more.

    Equal vectors are sought once, by their smallest id, and then stand in for each other
    (``_copies``), so no number of copies cuts a tie. Every such row lies in the list of
    its nearest centroid with the codes of its residual, and is sought there and in up to
    ``probes`` lists whose centroids are nearly as similar (SHARE, ``margin``): the tables
    rank a list's rows, the best ``rerank`` set the bar, and exact double cosines decide
    among the rows whose table sum may reach it. Lists longer than BLOCK are split, each
    block answering for itself, so no group outgrows memory whatever the skew. Centroids
    are fitted on a bounded sample of rows by id hash; ``lists`` defaults to twice the
    root of the row count. No vectors give no rows; equal vectors tie by id. The more
    vectors, the fewer of them the centroids are fitted on, and the members of a group too
    small for a centroid go to different lists: from REFINE_FROM vectors on the neighbours
    of neighbours are compared too (``refined``).
    """
    # 128 bits stand for a vector; the vectors themselves aren't shuffled for this
    same = materialize(vectors.select("id", F.xxhash64("vec").alias("s1"), F.xxhash64(F.lit(7), "vec").alias("s2")), "same")
    n = same.count()
    groups = same.groupBy("s1", "s2").agg(F.min("id").alias("one"), F.count("*").alias("_n")).where("_n > 1").select("s1", "s2", "one")
    members = materialize(same.join(groups, ["s1", "s2"]).select("one", F.col("id").alias("copy")), "members")
    further = members.where("copy <> one").select(F.col("copy").alias("id"))
    n_further = further.count()
    v = vectors.select("id", "vec")
    if n_further:
        v = v.join(bounded(further, n_further), "id", "left_anti")
    n -= n_further  # only these are indexed, and only they can be in the sample
    refine = n >= REFINE_FROM
    if refine:
        v = materialize(v, "vectors")
    lists = lists or max(1, min(MAX_LISTS, int(2 * n**0.5)))
    share = min(1.0, max(FIT_ROWS, min(FIT_MORE, 4 * FIT_PER_LIST * lists), FIT_PER_LIST * lists) / max(n, 1))
    sample = v.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    index = fit(sample, lists, n, dim=dim)
    found = (
        v.mapInArrow(_assign(index, probes, margin, least, dim), _SENT)
        .repartition("list", "block")
        .sortWithinPartitions("list", "block", "kind")
        .mapInArrow(_search(index, k, least, rerank, dim), "id string, neighbour string, cosine double")
    )
    if refine:
        found = refined(_best(found, k), v, k, least, dim)
    if not n_further:
        return _best(found, k)
    return _best(_copies(_best(found, k), members, k), k)


def _small(dim: int):
    """A byte a value of the unit vector, and the step that it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column("vec"), dim), "f4")
            step = np.abs(x).max(axis=1, keepdims=True, initial=1e-9) / np.float32(127)
            codes = np.rint(x / step).astype("i1")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step[:, 0])], names=["id", "code", "step"])

    return run


def _around(dim: int):
    """Of the rows around each centre, the pairs (a, b) that may be better than what a or b has."""

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        h = b.column("h").to_numpy()
        has, n = b.column("has").flatten().to_numpy(), np.asarray(pc.list_value_length(b.column("has")))
        known = np.repeat(h[:, None], n.max(initial=1), axis=1)
        known[np.repeat(np.arange(len(h)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = has
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), "i1").reshape(-1, dim)
        return [b.column("id").to_numpy(zero_copy_only=False), code, b.column("step").to_numpy(), b.column("bar").to_numpy(), h, known]

    def better(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        width = max(p[5].shape[1] for p in parts)
        parts = [[*p[:5], np.pad(p[5], ((0, 0), (0, width - p[5].shape[1])), "edge")] for p in parts] if len(parts) > 1 else parts
        ids, code, step, bar, h, known = (np.concatenate(c) for c in zip(*parts)) if len(parts) > 1 else parts[0]
        x = code * step[:, None]
        # four standard deviations of what rounding to bytes leaves of the two
        wanted = x @ x.T + np.float32(1.2) * (step[:, None] + step) >= bar[:, None]
        wanted &= ~(h[None, :, None] == known[:, None, :]).any(axis=2)
        a, b = np.nonzero(np.triu(wanted | wanted.T, 1))
        return ids[a], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, parts, size, out = None, [], 0, []

        def table() -> pa.RecordBatch:
            a, b = ([np.concatenate(x) for x in zip(*out)] if out else ([], []))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

        for batch in batches:
            c = batch.column("centre").to_numpy(zero_copy_only=False)
            all_ = columns(batch)
            cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]).tolist() if len(c) else [0]
            for a, z in zip(cuts, cuts[1:]):
                for i in range(a, z, AROUND):
                    if parts and (c[a] != centre or size >= AROUND):
                        if size > 1:
                            out.append(better(parts))
                        parts, size = [], 0
                    centre = c[a]
                    parts.append([x[i : min(i + AROUND, z)] for x in all_])
                    size += len(parts[-1][0])
            yield table()
        if size > 1:
            out.append(better(parts))
        yield table()

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                p = whole.slice(i, 2048)
                c = np.einsum("ij,ij->i", unit(matrix(p.column("vec_a"), dim)), unit(matrix(p.column("vec_b"), dim))).round(6)
                yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(c)], names=["id", "neighbour", "cosine"])

    return run


def refined(found: DataFrame, v: DataFrame, k: int, least: float, dim: int = DIM) -> DataFrame:
    """``found`` (id, neighbour, cosine) with what the neighbours of neighbours add.

    What a row is found by counts for it too. The rows around a centre, those it has or
    that have it, are compared by vectors of a byte a value; pairs that may be better than
    what one of them has are checked exactly. ``v`` (id, vec) has been written.
    """
    codes = materialize(v.mapInArrow(_small(dim), "id string, code binary, step float"), "codes")
    mirrored = lambda d: d.unionByName(d.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "cosine")).distinct()
    pairs = lambda d: _best(mirrored(d.select("id", "neighbour", "cosine")), k).select("id", "neighbour", "cosine")
    found = materialize(pairs(found), "found")
    for _ in range(ROUNDS):
        bars = found.groupBy("id").agg(F.collect_list(F.xxhash64("neighbour")).alias("has"), F.when(F.count("*") < k, least).otherwise(F.min("cosine")).cast("float").alias("bar"))
        cards = codes.join(bars, "id").withColumn("h", F.xxhash64("id"))
        sides = found.select(F.col("id").alias("centre"), F.col("neighbour").alias("id")).unionByName(found.select(F.col("neighbour").alias("centre"), "id")).distinct()
        rows = sides.join(cards, "id").repartition("centre").sortWithinPartitions("centre")
        maybe = rows.mapInArrow(_around(dim), "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        maybe = materialize(maybe, "maybe")
        both = maybe.join(v.select(F.col("id").alias("a"), F.col("vec").alias("vec_a")), "a").join(v.select(F.col("id").alias("b"), F.col("vec").alias("vec_b")), "b")
        more = both.mapInArrow(_cosines(dim), "id string, neighbour string, cosine double").where(F.col("cosine") >= least)
        old, found = found, materialize(pairs(found.unionByName(more)), "found")
        n, new = found.count(), found.join(old, ["id", "neighbour"], "left_anti").count()
        discard(old)
        discard(maybe)
        if new < ENOUGH * n:
            break
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _copies(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, cosine) of all ids from those found for the smallest id of each set of ``members`` (one, copy).

    A set of copies that gives any of an id's ``k`` best gives its smallest id first, so it is
    among the ``k`` best sets; of each, and of the id's own, the k + 1 smallest ids suffice.
    """
    first = Window.partitionBy("one").orderBy("copy")
    few = members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).select(F.col("one").alias("neighbour"), F.col("copy").alias("_b"))
    own = members.select(F.col("one").alias("id"), F.col("one").alias("neighbour")).distinct().withColumn("cosine", F.lit(1.0))
    sets = found.select("id", "neighbour", "cosine").unionByName(own)
    wide = sets.join(few, "neighbour", "left").select("id", F.coalesce("_b", "neighbour").alias("neighbour"), "cosine")
    # the k + 1 best of a set, as one may be the id itself
    wide = _best(wide, k + 1).select("id", "neighbour", "cosine")
    all_ids = members.select(F.col("one").alias("id"), F.col("copy").alias("_a"))
    return wide.join(all_ids, "id", "left").select(F.coalesce("_a", "id").alias("id"), "neighbour", "cosine").where("id <> neighbour")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs (neuron_a < neuron_b), each once."""
    return found.select(F.least("id", "neighbour").alias("neuron_a"), F.greatest("id", "neighbour").alias("neuron_b")).distinct()
