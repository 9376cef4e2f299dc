import importlib
import os

import pytest

from memlattice.plans import collect

SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


PLANNED, PLANNED_SQL = collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(PLANNED))
def test_runs_and_agrees_on_small_tables(agrees, name):
    agrees(PLANNED[name], PLANNED_SQL.get(name))


def test_snapshots_and_stream(spark, tmp_path):
    from memlattice.sources.connectors import SnapshotStore
    from memlattice.streaming.feeds import JournalApplier

    s = SnapshotStore(spark, str(tmp_path / "snap"))
    assert not s.exists("a") and s.load("a") is None
    s.save("a", spark.range(3))
    s.save("a", spark.range(5))
    assert s.load("a").count() == 5
    s.backup("a", str(tmp_path / "copy"))
    s.delete("a")
    assert not s.exists("a")
    s.restore("a", str(tmp_path / "copy"))
    assert s.load("a").count() == 5
    schema = "sequence long, entity_type string, operation string, entity_id string, payload string, vector_clock map<string,long>, changed_at timestamp_ntz, node_id string, received_at timestamp_ntz"
    batch = spark.createDataFrame([(1, "n", "create", "x", "p", {"a": 1}, None, "a", None)], schema)
    a = JournalApplier(spark, str(tmp_path / "j"))
    a.apply(batch, 0)
    a.apply(batch, 0)
    a.apply(batch, 1)
    assert a.journal().count() == 1 and a.state().count() == 1
