"""Merkle trees in long form: one row per node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from memlattice.functions.hashing import digest, pair_digest
from memlattice.session import materialize


#: Levels that one task builds of the leaves it gets: blocks of 1024.
DEEP = 10


def _subtrees(algorithm: str, kind: pa.DataType):
    """Rows (tree, level, pos, hash, width) sorted by tree and position, whole blocks together: the levels above each block."""
    digest_of = hashlib.sha3_256 if algorithm == "sha3" else hashlib.sha256

    def grown(tree, level: int, first: int, width: int, hashes: list[str], out: list[tuple]) -> None:
        while len(hashes) > 1:
            hashes = [digest_of((a + b if a <= b else b + a).encode()).hexdigest() for a, b in zip(hashes[::2], hashes[1::2])]
            level, first, width = level + 1, first >> 1, width >> 1
            out.extend((tree, level, first + i, h, width) for i, h in enumerate(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashes, out = None, [], []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["tree", "level", "pos", "hash", "width"])

        for b in batches:
            for tree, level, pos, hash, width in zip(*(c.to_pylist() for c in b.columns)):
                now = tree, pos >> DEEP
                if key is None or now != key[:2]:
                    if key:
                        grown(key[0], *key[2:], hashes, out)
                    key, hashes = (*now, level, pos, width), []
                hashes.append(hash)
            yield table()
        if key:
            grown(key[0], *key[2:], hashes, out)
        yield table()

    return run


def tree(leaves: DataFrame, tree: str, pos: str, hash: str, algorithm: str = "sha3") -> DataFrame:
    """(tree, level, pos, hash): level 0 holds the leaves, padded to a power of two by repeating the last one.

    Blocks of 1024 nodes go to a task that builds ten levels above them, and the blocks'
    tops again, so a tree of any size spreads over all tasks and most take one pass. The
    parent hashes both texts, the smaller one first. Trees without leaves have no rows; a
    single leaf is its root.
    """
    base = leaves.select(F.col(tree).alias("tree"), F.lit(0).alias("level"), F.col(pos).cast("long").alias("pos"), F.col(hash).alias("hash"))
    size = base.groupBy("tree").agg(F.count("*").alias("n"), F.max_by("hash", "pos").alias("last"))
    size = size.withColumn("width", F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long"))
    pad = size.where("width > n").select("tree", F.lit(0).alias("level"), F.explode(F.sequence(F.col("n"), F.col("width") - 1)).alias("pos"), F.col("last").alias("hash"), "width")
    seen = Observation()
    level = materialize(base.join(size.select("tree", "width"), "tree").unionByName(pad).observe(seen, F.max("width").alias("widest")), "merkle")
    widest = seen.get.get("widest") or 0
    kind = level.select("tree").limit(0).toArrow().schema.field("tree").type
    shape = f"tree {dict(level.dtypes)['tree']}, level int, pos long, hash string, width long"
    parts, front, at = [level], level, 0
    while widest > 1:
        block = F.shiftright("pos", DEEP)
        rows = front.where("width > 1").select("tree", "level", "pos", "hash", "width").repartition(F.col("tree"), block).sortWithinPartitions("tree", "pos")
        parts.append(materialize(rows.mapInArrow(_subtrees(algorithm, kind), shape), "merkle"))
        at, widest = at + DEEP, widest >> DEEP
        front = parts[-1].where(F.col("level") == at)
    nodes = parts[0]
    for x in parts[1:]:
        nodes = nodes.unionByName(x)
    return nodes.select("tree", "level", "pos", "hash")


def edited(leaves: DataFrame, updates: DataFrame, added: DataFrame) -> DataFrame:
    """Leaves (tree, pos, hash) after ``updates`` (tree, pos, hash) of positions that exist and ``added`` (tree, n, hash)
    ones, put behind the last in the order of ``n``; an update of a position that isn't there raises an error."""
    lost = updates.join(leaves, ["tree", "pos"], "left_anti").limit(1).count()
    if lost:
        raise ValueError("an update names a leaf that isn't there")
    new = updates.select("tree", F.col("pos").cast("long").alias("pos"), F.col("hash").alias("_new"))
    kept = leaves.select("tree", F.col("pos").cast("long").alias("pos"), "hash").join(new, ["tree", "pos"], "left").select("tree", "pos", F.coalesce("_new", "hash").alias("hash"))
    last = leaves.groupBy("tree").agg((F.max("pos") + 1).alias("_n"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("n")) - 1
    more = added.withColumn("_i", place).join(last, "tree", "left").select("tree", (F.coalesce("_n", F.lit(0)) + F.col("_i")).cast("long").alias("pos"), "hash")
    return kept.unionByName(more)


def retree(nodes: DataFrame, old: DataFrame, new: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """``nodes`` of the leaves ``old`` for the leaves ``new`` (tree, pos, hash): only trees with another leaf are built again."""
    touched = materialize(diff(old, new).select("tree").distinct(), "touched")
    again = tree(new.join(touched, "tree", "left_semi"), "tree", "pos", "hash", algorithm)
    return nodes.join(touched, "tree", "left_anti").unionByName(again)


def equal_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree, equal): whether both node tables have the same root; a tree that one of them lacks isn't equal."""
    x, y = (roots(n).select("tree", F.col("root").alias(c)) for n, c in ((a, "_a"), (b, "_b")))
    return x.join(y, "tree", "full").select("tree", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def batch_valid(leaves: DataFrame, siblings: DataFrame, claimed: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """(tree, valid): whether the ``leaves`` (tree, pos, hash) with their shared ``siblings`` (tree, level, pos, hash)
    give the ``claimed`` (tree, root, height).

    A tree's proof is folded level by level in one task; it holds its leaves and their
    siblings, not the tree. A sibling that contradicts what the leaves give makes the proof
    invalid, as does a node without its neighbour; without leaves nothing is proved.
    """
    digest_of = hashlib.sha3_256 if algorithm == "sha3" else hashlib.sha256
    kind = dict(claimed.dtypes)["tree"]

    def fold(key: tuple, proof: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        if not len(top):
            return pd.DataFrame({"tree": [], "valid": []})
        height, root = int(top.height.iloc[0]), top.root.iloc[0]
        given: dict[int, dict[int, str]] = {}
        for level, pos, hash in zip(proof.level, proof.pos, proof.hash):
            if level >= 0:
                given.setdefault(int(level), {})[int(pos)] = hash
        known, ok = {int(p): h for level, p, h in zip(proof.level, proof.pos, proof.hash) if level < 0}, True
        ok = bool(known)
        for level in range(height):
            both = {**given.get(level, {}), **known}
            ok = ok and all(known.get(p, h) == h for p, h in given.get(level, {}).items()) and all(p ^ 1 in both for p in known)
            if not ok:
                break
            up = {}
            for p in known:
                a, b = sorted((both[p], both[p ^ 1]))
                up[p >> 1] = digest_of((a + b).encode()).hexdigest()
            known = up
        return pd.DataFrame({"tree": [key[0]], "valid": [ok and known == {0: root}]})

    proof = leaves.select("tree", F.lit(-1).alias("level"), F.col("pos").cast("long").alias("pos"), "hash").unionByName(siblings.select("tree", F.col("level").cast("int").alias("level"), "pos", "hash"))
    return proof.groupBy("tree").cogroup(claimed.select("tree", "root", "height").groupBy("tree")).applyInPandas(fold, f"tree {kind}, valid boolean")


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, root, height, n_leaves) with padded leaves."""
    return nodes.groupBy("tree").agg(F.max_by("hash", "level").alias("root"), F.max("level").alias("height"), F.count_if(F.col("level") == 0).alias("n_leaves"))


def proofs(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, pos, leaf, siblings, directions, root) for the ``wanted`` (tree, pos) leaves."""
    top = roots(nodes).select("tree", "root", "height")
    w = wanted.select("tree", F.col("pos").cast("long").alias("pos")).join(top, "tree")
    steps = w.where("height > 0").select("tree", "pos", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    at = F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    steps = steps.withColumn("_at", at).withColumn("_sib", F.col("_at").bitwiseXOR(F.lit(1).cast("long")))
    n = nodes.select("tree", "level", F.col("pos").alias("_sib"), "hash")
    path = steps.join(n, ["tree", "level", "_sib"]).groupBy("tree", "pos").agg(F.array_sort(F.collect_list(F.struct("level", "hash", F.when(F.col("_at") % 2 == 0, "right").otherwise("left").alias("dir")))).alias("_p"))
    leaf = nodes.where("level = 0").select("tree", "pos", F.col("hash").alias("leaf"))
    full = w.join(leaf, ["tree", "pos"]).join(path, ["tree", "pos"], "left")
    empty = F.array().cast("array<string>")
    return full.select("tree", "pos", "leaf", F.coalesce(F.transform("_p", lambda x: x["hash"]), empty).alias("siblings"), F.coalesce(F.transform("_p", lambda x: x["dir"]), empty).alias("directions"), "root")


def verified(found: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """Proof rows with ``valid``: the leaf folded with its siblings gives the root.

    SHA-2 folds in one expression; SHA3 folds level by level, as deep as the deepest proof.
    """
    if algorithm != "sha3":
        fold = F.aggregate("siblings", F.col("leaf"), lambda acc, s: pair_digest(acc, s, algorithm))
        return found.withColumn("valid", fold == F.col("root"))
    deepest = found.agg(F.max(F.size("siblings"))).first()[0] or 0
    rows = found.withColumn("_h", F.col("leaf"))
    for i in range(deepest):
        sibling = F.get("siblings", F.lit(i))
        rows = rows.withColumn("_h", F.when(sibling.isNull(), F.col("_h")).otherwise(pair_digest(F.col("_h"), F.coalesce(sibling, F.lit("")), algorithm)))
    return rows.withColumn("valid", F.col("_h") == F.col("root")).drop("_h")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tree, pos, change, old_hash, new_hash) by position: added, removed or modified leaves."""
    a = old.select("tree", "pos", F.col("hash").alias("old_hash"))
    b = new.select("tree", "pos", F.col("hash").alias("new_hash"))
    j = a.join(b, ["tree", "pos"], "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("modified")
    return j.select("tree", "pos", kind.alias("change"), "old_hash", "new_hash")


def batch_siblings(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, level, pos, hash): the siblings that prove all ``wanted`` leaves of a tree at once, none twice
    and none that the wanted leaves themselves give. With a column ``batch`` in ``wanted``, each batch of a
    tree is proved on its own and the rows have it too."""
    keys = ["tree", "batch"] if "batch" in wanted.columns else ["tree"]
    top = roots(nodes).select("tree", "height")
    w = wanted.select(*keys, "pos").join(top, "tree").where("height > 0")
    steps = w.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"), "pos")
    known = steps.select(*keys, "level", F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("pos")).distinct()
    need = known.select(*keys, "level", F.col("pos").bitwiseXOR(F.lit(1).cast("long")).alias("pos")).join(known, [*keys, "level", "pos"], "left_anti")
    return nodes.join(need, ["tree", "level", "pos"]).select(*keys, "level", "pos", "hash")


def range_valid(leaves: DataFrame, claimed: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """(tree, valid): whether all ``leaves`` (tree, pos, hash) of a range proof, put in place, give the claimed root.

    The root is computed again from every leaf, so interior leaves are checked too.
    """
    again = roots(tree(leaves, "tree", "pos", "hash", algorithm)).select("tree", F.col("root").alias("_r"))
    return claimed.join(again, "tree", "left").select("tree", F.coalesce(F.col("root") == F.col("_r"), F.lit(False)).alias("valid"))


def versions(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(tree, version, root, parent_root): version 0 for a new tree, the old one plus 1 where the root changed."""
    if old is None:
        return new.select("tree", F.lit(0).alias("version"), "root", F.lit(None).cast("string").alias("parent_root"))
    j = new.join(old.select("tree", F.col("version").alias("_v"), F.col("root").alias("_r"), F.col("parent_root").alias("_p")), "tree", "left")
    same = F.col("_r") == F.col("root")
    return j.select("tree", F.when(F.col("_v").isNull(), 0).when(same, F.col("_v")).otherwise(F.col("_v") + 1).alias("version"), "root", F.when(same, F.col("_p")).otherwise(F.col("_r")).alias("parent_root"))


def verified_records(records: DataFrame, key: str, hashes: str, root: str, vector: str, store: DataFrame, dim: int = 384, algorithm: str = "sha3") -> DataFrame:
    """(key, chunks_ok, root_ok, vector_ok, valid): every named chunk exists and hashes to its name, the tree of
    the named hashes has the record's root, and the vector has ``dim`` values."""
    named = records.select(key, F.posexplode(hashes).alias("pos", "hash"))
    good = store.groupBy("hash").agg(F.max(digest(F.col("data"), algorithm) == F.col("hash")).alias("_ok"))
    chunks = named.join(good, "hash", "left").groupBy(key).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("chunks_ok"))
    top = roots(tree(named, key, "pos", "hash", algorithm)).select(F.col("tree").alias(key), F.col("root").alias("_root"))
    j = records.select(key, F.col(root).alias("_want"), (F.size(vector) == dim).alias("_v")).join(chunks, key, "left").join(top, key, "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    j = j.select(key, ok(F.col("chunks_ok")).alias("chunks_ok"), ok(F.col("_root") == F.col("_want")).alias("root_ok"), ok(F.col("_v")).alias("vector_ok"))
    return j.withColumn("valid", F.col("chunks_ok") & F.col("root_ok") & F.col("vector_ok"))
