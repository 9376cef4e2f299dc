from datetime import datetime as dt

import pytest

from memlattice.operators import references as R

N = "id string, merkle_root string, chunk_hashes array<string>, embedding array<float>, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, missing_key string"
S = "id string, source_id string, target_id string, edge_type string, weight double, created_at timestamp_ntz, _salt int, reason string"
C = "hash string, ref_count long, created_at timestamp_ntz, parent_key string"
T1, T2, T3 = dt(2024, 1, 1), dt(2024, 2, 1), dt(2024, 3, 1)


def tables(spark, n=(), s=(), c=()):
    return spark.createDataFrame(list(n), N), spark.createDataFrame(list(s), S), spark.createDataFrame(list(c), C)


def neuron(i, hashes=None, created=T1, updated=T1, deleted=None):
    return (i, None, hashes, None, None, created, updated, deleted, "clash")


def rows(df):
    return sorted((r.ref_table, r.record_id, r.field_name, r.missing_key, r.reason) for r in df.collect())


def test_reasons(spark):
    n = [neuron("A ", ["h1", "H2", None, "h3", "h4"], T2), neuron("b", None, deleted=T2), neuron("c", []), neuron("late", ["h1"], T3), neuron("a", ["old"], updated=None)]
    s = [
        ("s1", "a", "b", "X", 1.0, T3, 1, "x"), ("s1", "a", "b", "X", 1.0, T3, 1, "x"), ("s2", None, "zz", "X", 1.0, T1, 1, "x"),
        ("s3", " LATE", "c", "X", None, T2, 1, "x"), ("s4", "late", "c", "X", 1.0, None, 1, "x"), ("s5", "c", "c", "X", 1.0, T1, 1, "x"),
    ]
    c = [("h1", 1, T1, "k"), ("h1", 1, T1, "k"), ("h2", 0, T1, "k"), ("h3", 2, T3, "k"), (None, 1, T1, "k")]
    found = R.memory_dangling(*tables(spark, n, s, c))
    assert rows(found) == [
        ("neurons", "a", "chunk_hashes", "h2", "deleted"), ("neurons", "a", "chunk_hashes", "h3", "late"), ("neurons", "a", "chunk_hashes", "h4", "missing"),
        ("synapses", "s1", "target_id", "b", "deleted"), ("synapses", "s2", "target_id", "zz", "missing"), ("synapses", "s3", "source_id", "late", "late"),
    ]
    report = {(r.ref_table, r.field_name, r.reason, r.month): r.n_refs for r in R.dangling_report(found).collect()}
    assert report[("synapses", "target_id", "deleted", "2024-03")] == 1


def test_s1_source_is_not_late_of_a(spark):
    found = R.memory_dangling(*tables(spark, [neuron("a", None, T2), neuron("b")], [("s", "a", "b", "X", 1.0, T1, 0, "")]))
    assert rows(found) == [("synapses", "s", "source_id", "a", "late")]


def test_empty(spark):
    assert R.memory_dangling(*tables(spark)).count() == 0


@pytest.mark.parametrize("share", [0.4])
def test_hot_key_is_salted(spark, share):
    n = 30_000
    refs = spark.range(n).selectExpr("'t' ref_table", "cast(id as string) record_id", "'f' field_name", f"if(id < {int(n * share)}, 'hot', concat('k', id)) missing_key", "timestamp_ntz'2024-01-01' ref_at")
    assert R.hot_keys(refs) == ["hot"]
    parents = spark.range(n).selectExpr("if(id = 0, 'hot', concat('k', id)) parent_key", "cast(null as timestamp_ntz) valid_from", "id = 0 gone")
    found = R.dangling(refs, parents)
    assert found.count() == int(n * share) and {r.reason for r in found.select("reason").distinct().collect()} == {"deleted"}
