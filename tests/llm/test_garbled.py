import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm import garbled as G

FR = "Le café privé préfère la forêt et l'élève répète déjà une règle très étroite après la fenêtre cachée".split()
RU = "Каждый новый отрывок повторяет длинный поиск и хранит пустой сигнал через общий журнал памяти".split()
KO = "뉴런 에서 오래된 기억 다시 찾는다 조각 보다 복제본 천천히 확인한다 경계 까지 그 기록 읽는다".split()
EN = "the quiet index stores a sparse graph near our shallow archive – see below “now” don’t retry".split()


def corpus():
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(w) for _ in range(60))) for i, w in enumerate([FR, RU, KO, EN] * 60)]
    text = lambda w: " ".join(rng.choice(w) for _ in range(40))
    bad = {
        1000: (text(FR).encode().decode("latin-1"), text), 1001: (text(EN) + " “now” – don’t".encode().decode("cp1252", "replace").replace("�", "?"), None),
        1002: (text(RU).encode("koi8_r").decode("cp1251"), None), 1003: (text(KO).encode("cp949").decode("latin-1"), None),
        1004: (text(FR) + " caf� priv�", None), 1005: ("plain words and one caf" + "é".encode().decode("mac_roman") + " here", None),
    }
    clean = {2000: "", 2001: None, 2002: "only ascii here", 2003: "CAFÉ PRIVÉ, ÉLÈVE", 2004: "élève privé café", 2005: "® ± × ÷ √", 2006: "🚀 " + text(KO)}
    return docs, {k: v[0] for k, v in bad.items()}, clean


def test_found_and_restored(spark):
    docs, bad, clean = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in [*docs, *bad.items(), *clean.items()]], "doc_id long, text string, key string, restored string")
    got = {r.doc_id: r for r in G.garbled(df).collect()}
    assert set(got) == set(bad)
    assert "café" in got[1000].restored and "Ã" not in got[1000].restored
    assert sum(w in RU for w in got[1002].restored.split()) > 20 and "café" in got[1005].restored
    assert len([w for w in got[1003].restored.split() if w in KO]) > 20 and got[1004].restored is None
    assert G.garbled(df.limit(0)).count() == 0


def test_all_runs_of_a_segment(spark):
    docs, _, _ = corpus()
    wrong = lambda t: t.encode().decode("latin-1")
    text = "le " + "🚀".join(wrong(w) for w in ("café", "privé", "préfère", "élève")) + " ici"
    df = spark.createDataFrame([*docs, (1000, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in G.garbled(df).collect()}
    assert set(got) == {1000} and got[1000].restored == "le café🚀privé🚀préfère🚀élève ici"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=40))
def test_segments(xs):
    score = np.array(xs)
    found = G.segments(score)
    assert all(z > a and score[a:z].sum() > 0 for a, z in found)
    assert all(z <= b for (_, z), (b, _) in zip(found, found[1:]))
    if len(xs) and score.max() > 0:
        best = max(score[a:z].sum() for a in range(len(xs)) for z in range(a + 1, len(xs) + 1))
        assert max(score[a:z].sum() for a, z in found) == pytest.approx(best)


def test_round_trip_of_inverses():
    for text, wrong in (("déjà vu", "latin-1"), ("– “naïf”", "cp1252"), ("Привет", "cp437"), ("기억", "mac_roman")):
        garbage = text.encode().decode(wrong, "ignore")
        if garbage.encode(wrong, "ignore") == text.encode():
            assert text in {t for t, _, _ in G.inverses(garbage)}


def test_rare_pairs_come_from_the_table(spark, monkeypatch):
    """A model that holds few pairs gives what one with all gives, the others being fetched."""
    docs, bad, clean = corpus()
    df = spark.createDataFrame([*docs, *bad.items(), *clean.items()], "doc_id long, text string")
    rows = lambda: {(r.doc_id, str(r.stretches), r.restored) for r in G.garbled(df).collect()}
    whole = rows()
    monkeypatch.setattr(G, "KEPT", 40)
    model, rest = G.pair_model(df)
    assert len(model.pairs) <= 40 < rest.count() and rows() == whole
    monkeypatch.setattr(G, "DENSE", 0)
    assert rows() == whole


def test_long_runs_are_restored_whole(spark):
    docs, _, _ = corpus()
    word = "нашпоиск" * 40  # no blank: one run of 320 characters
    bad = word.encode("koi8_r").decode("cp1251")
    df = spark.createDataFrame([*docs, *((i, word) for i in range(300, 320)), (1000, "журнал " + bad + " память")], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in G.garbled(df).collect()}
    assert set(got) == {1000} and got[1000].endswith(" " + word + " память")


def test_the_corpus_decides_about_single_letters(spark, monkeypatch):
    """A mapping that strong stretches of other texts have is believed of one odd letter, another isn't."""
    docs, _, _ = corpus()
    wrong = lambda t: t.encode("cp1252").decode("mac_roman")
    monkeypatch.setattr(G, "HALF", 2e-4)  # in so small a corpus one occurrence would be evidence
    strong = [(1000, " ".join(wrong(w) for w in FR[:9])), (1001, " ".join(wrong(w) for w in FR[9:]))]
    single = (2000, " ".join([*EN, wrong("don’t"), *EN]))
    found = lambda rows: {r.doc_id for r in G.garbled(spark.createDataFrame([*docs, *rows], "doc_id long, text string")).collect()}
    assert found([*strong, single]) == {1000, 1001, 2000} and found([single]) == set()


def test_a_hot_garbled_source_is_no_evidence(spark):
    """A third of all texts are UTF-8 read otherwise, the same words again and again."""
    docs, _, _ = corpus()
    ko = " ".join(KO)
    hot = [(1000 + i, " ".join(RU).encode().decode("koi8_r")) for i in range(60)] + [(1100 + i, ko.encode().decode("gbk", "ignore")) for i in range(60)]
    found = {r.doc_id for r in G.garbled(spark.createDataFrame([*docs, *hot], "doc_id long, text string")).collect()}
    assert {i for i, _ in hot[:60]} <= found and not found & {i for i, _ in docs}
