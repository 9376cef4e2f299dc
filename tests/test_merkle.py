import hashlib

from memlattice.plans.texts import QUERIES


def test_every_leaf_of_long_texts(spark, tmp_path):
    long = "".join(f"word {i} of a long note, " for i in range(150))
    spark.createDataFrame([(1, long), (2, "SHORT"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    leaves = [sha(long.encode()[i : i + 512]) for i in range(0, len(long), 512)]
    proofs = run("merkle_proofs")
    assert sorted((r.doc_id, r.pos, r.leaf) for r in proofs) == [(1, i, h) for i, h in enumerate(leaves)] + [(2, 0, sha(b"SHORT"))]
    assert all(r.valid for r in proofs) and len(leaves) == 8
    assert {(r.change, r.n) for r in run("merkle_diff")} == {("modified", 9)}
    got = {(r.batch, r.level, r.pos) for r in run("merkle_batch")}
    assert got == {(0, 0, 3), (0, 2, 1), (1, 0, 2), (1, 1, 0), (1, 1, 3), (2, 1, 2), (2, 2, 0)}
