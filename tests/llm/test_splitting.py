import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm import splitting as S

C = "owner_id string, idx int, byte_offset long, size long, chunk_data binary, hash string, profile string, chunk_size int, piece int"
O = "profile string, chunk_size int, overlap int, use_cdc boolean, owner_id string"  # noqa: E741


def check(data, size, overlap):
    ps = S.pieces(data, size, overlap)
    assert ps[0][0] == 0 and ps[-1][1] == len(data)
    for a, z, _ in ps:
        assert z - a <= size and (z > a or not data)
    for (a, z, _), (b, y, _) in zip(ps, ps[1:]):
        assert a < b <= z < y
    return ps


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r,é기🚀́‍", max_size=400), st.integers(8, 90), st.integers(0, 60))
def test_text(text, size, overlap):
    data = text.encode()
    for a, z, _ in check(data, size, overlap):
        data[a:z].decode()


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=500), st.integers(1, 60), st.integers(0, 60))
def test_bytes(data, size, overlap):
    try:
        data.decode()
    except UnicodeDecodeError:
        check(data, size, overlap)


def test_natural_boundaries_and_balance():
    data = b"\n\n".join(b"word " * 18 + b"end." for _ in range(10))
    ps = check(data, 300, 30)
    assert {S.KINDS[s] for _, _, s in ps if s >= 0} == {"paragraph"}
    sizes = [z - a for a, z, _ in check(b"x" * 10_000, 3000, 100)]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 60


def test_table(spark):
    big = b"line of text\n" * 40
    c = spark.createDataFrame(
        [
            ("A ", 0, 100, None, big, "h", " NOTE", 1, 1), ("a", 0, 100, 5, big, "h", "note", 1, 1), ("a", 1, None, 5, big, "h", "note", 1, 1), ("a", 2, 0, 5, b"x" * 50, "h", "nope", 1, 1),
            ("b", 0, 0, 5, None, "h", "note", 1, 1), ("b", 1, 0, 5, b"", "h", None, 1, 1), (None, 0, 0, 5, big, "h", "note", 1, 1), ("c", 0, 0, 5, b"\xff" * 90, "h", None, 1, 1),
        ],
        C,
    )
    o = spark.createDataFrame([("note", 100, 10, False, "clash"), ("default", 60, 5, False, "clash"), (None, 1, 1, False, ""), ("zero", 0, 1, False, "")], O)
    rows = S.split(c, o).collect()
    assert {(r.owner_id, r.idx) for r in rows} == {("a", 0), ("a", 1), ("c", 0)}
    first = sorted((r for r in rows if (r.owner_id, r.idx) == ("a", 0)), key=lambda r: r.piece)
    assert first[0].byte_offset == 100 and all(r.size <= 100 and bytes(r.piece_data) == big[r.byte_offset - 100 : r.byte_offset - 100 + r.size] for r in first)
    assert all(r.byte_offset is None for r in rows if r.idx == 1)
    assert S.split(c.limit(0), o.limit(0)).count() == 0


def test_long():
    data = ("가나다. " * 200_000).encode()
    assert len(check(data, 4096, 256)) == pytest.approx(len(data) / 3840, rel=0.1)


def test_wide_overlap_is_reported():
    data = b"some words in a row " * 60
    for overlap, used in ((100, 100), (180, 150), (500, 150), (0, 0)):
        ps, told = S.cut(data, 200, overlap)
        assert told == used and abs(sum(z - b for (_, z, _), (b, _, _) in zip(ps, ps[1:])) / (len(ps) - 1) - used) <= 0.25 * used + 1
    wide = "🚀".encode() * 30
    ps, told = S.cut(wide, 8, 6)
    assert told < 6 and all(z - a <= 8 for a, z, _ in ps)


def test_pieces_are_as_few_as_can_be():
    for n in (9_000, 40_000):
        data = b"x" * n
        ps, overlap = S.cut(data, 300, 20)
        assert len(ps) == -(-(n - overlap) // (300 - overlap))
