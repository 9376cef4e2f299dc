import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no vocabularies")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(os.path.join(T.TOKENIZERS, T.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_lossless(reference):
    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=200))
    def run(text):
        e = T.encoder()
        ids = e.encode_batch([text])[0]
        assert ids == reference.encode_ordinary(text) and e.decode(ids) == text

    run()


def test_hard_texts(reference):
    texts = ["", None, "<|endoftext|>", "a" * 20_000, " \n\t \n", "\x00\x01\x7f", "שלום עולם", "é 👩‍👩‍👧 기억", "don't I'LL we've"]
    got = T.encoder().encode_batch(texts)
    assert got == [reference.encode_ordinary(t or "") for t in texts] and got[:2] == [[], []]


def test_table(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, "x"), (3, "", "x"), (1, "hi there", "x")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, list(r.ids)) for r in T.encode(df, "doc_id").collect())
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2][1] == rows[3][1] == []
    states = {r.doc_id: (r.text_state, r.n_tokens, r.lossless) for r in T.encode_states(df, "doc_id").collect()}
    assert states == {1: ("text", 2, True), 2: ("null", 0, True), 3: ("empty", 0, True)}
    assert T.encode(df.limit(0), "doc_id").count() == 0
