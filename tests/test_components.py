import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memlattice.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_shapes(spark):
    check(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(60)])
    check(spark, [("hub", f"{i:03}") for i in range(50)] + [("x", "x"), ("y", "z"), ("z", "y")])
    rng = random.Random(1)
    check(spark, [(f"{rng.randrange(80):02}", f"{rng.randrange(80):02}") for _ in range(70)])
    assert connected_components(spark.createDataFrame([(None, "a")], "a string, b string"), "a", "b").count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_random(spark, pairs):
    check(spark, [(str(a), str(b)) for a, b in pairs])
