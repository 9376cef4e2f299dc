import hashlib
import math

import pytest
from pyspark.sql import functions as F

from memlattice.functions import clocks as C
from memlattice.functions import text as T
from memlattice.functions import vectors as V
from memlattice.functions.embedding import deterministic, local, simple
from memlattice.functions.hashing import sha3_256, string_hash
from memlattice.sources.connectors import create_connector, create_table, identifier
from memlattice.sources.validation import Field, validated


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    r = one(spark, V.cosine(arr(1, 0), arr(1, 1)), V.cosine(arr(0, 0), arr(1, 1)), V.normalized(arr(3, 4)), V.normalized(arr(0, 0)), V.euclidean(arr(0, 0), arr(3, 4)), V.resized(arr(1, 2, 3, 4), 2), V.resized(arr(0, 2), 3))
    assert r.c0 == pytest.approx(math.sqrt(0.5)) and r.c1 == 0 and r.c2 == [0.6, 0.8] and r.c3 == [0, 0] and r.c4 == 5
    assert r.c5 == pytest.approx([1.5 / math.hypot(1.5, 3.5), 3.5 / math.hypot(1.5, 3.5)]) and r.c6 == pytest.approx([0, 1 / math.sqrt(5), 2 / math.sqrt(5)])
    with pytest.raises(Exception, match="different length"):
        one(spark, V.dot(arr(1), arr(1, 2)))


def test_clock_order(spark):
    m = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if d else F.create_map().cast("map<string,bigint>")
    cases = [({"a": 1}, {"a": 1}, "equal"), ({"a": 1}, {"a": 2}, "before"), ({"a": 1, "b": 1}, {"a": 1}, "after"), ({"a": 1}, {"b": 1}, "concurrent"), ({}, {"b": 1}, "before"), ({"a": 0}, {}, "equal")]
    r = one(spark, *[C.compared(m(a), m(b)) for a, b, _ in cases], C.shown(C.merged(m({"a": 1, "b": 3}), m({"a": 2}))), C.shown(C.tick(m({}), "z")))
    assert list(r[: len(cases)]) == [c for _, _, c in cases] and r[-2] == "a:2,b:3" and r[-1] == "z:1"


def test_hashes(spark):
    r = one(spark, sha3_256(F.lit("abc")), sha3_256(F.lit(None).cast("string")))
    assert r.c0 == hashlib.sha3_256(b"abc").hexdigest() and r.c1 is None
    assert string_hash("hello") == 99162322 and string_hash("") == 0 and string_hash("polygenelubricants") == -(1 << 31)


def test_embeddings():
    for f in (deterministic, simple, local):
        v = f("Because the graph découvre 🚀 기억")
        assert len(v) == 384 and float((v.astype("f8") ** 2).sum()) == pytest.approx(1, abs=1e-5)
    assert (deterministic("a") == deterministic("a")).all() and local("").shape == (384,)


def test_text(spark):
    r = one(
        spark, T.keyword_score(T.search_terms(F.lit("aa graph")), F.lit("aaa the graph")), T.keyword_weight(F.lit("a b c d")), T.segments(F.lit("First sentence. Tiny. Second one here!\n\nThird paragraph here")),
        T.category(F.lit("so it goes")), T.category(F.lit("만약 그렇다")), T.keywords(F.lit("The Graph, the memory of it")), T.tokens(F.lit("été a_b 기억!")), T.task_type(F.lit("Please FIX it")), T.dimension_category(F.lit("ctx_5")),
    )
    two = 0.5 + 0.5 * 2 / 3.5
    assert r.c0 == pytest.approx((two + 0.7) / 2) and r.c1 == 0.25 and r.c2 == ["First sentence.", "Second one here!", "Third paragraph here"]
    assert (r.c3, r.c4, r.c7, r.c8) == ("causal", "conditional", "fix", "contextual") and r.c5 == ["graph", "memory"] and r.c6 == ["t", "a_b", "기억"]


def test_arguments(spark):
    f = [Field("depth", "integer", low=1, high=10, default=3), Field("mode", choices=("a", "b")), Field("id", required=True), Field("x", "number")]
    assert validated({"id": "q", "mode": "a", "x": "1.5"}, f) == ({"depth": 3, "mode": "a", "id": "q", "x": 1.5}, [])
    assert len(validated({"depth": 11, "mode": "c", "x": "y"}, f)[1]) == 4
    ddl = create_table("t", spark.range(1).selectExpr("id", "'x' name").schema, ["id"], {"name": "it's"})
    assert "`id` BIGINT NOT NULL" in ddl and "DEFAULT 'it''s'" in ddl
    with pytest.raises(ValueError):
        identifier("a; drop")
    with pytest.raises(ValueError):
        create_connector("oracle?")
