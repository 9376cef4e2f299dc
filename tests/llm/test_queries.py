import os

import pytest

from memlattice.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_agrees_on_small_tables(agrees, name):
    agrees(QUERIES[name], SQL.get(name))
