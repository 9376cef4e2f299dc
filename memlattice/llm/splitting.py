"""Splitting oversized chunks at natural boundaries with balanced targets."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import tidy

#: What holds where chunk_options has no usable row ``default``.
DEFAULT_SIZE, DEFAULT_OVERLAP = 4096, 256
#: A cut may move this share of a piece away from its target.
SLACK = 0.25
#: Share of a piece that it can have in common with the one before, at most.
MOST_OVERLAP = 0.75
#: A piece may begin this share of the overlap away from its exact place to meet a word's edge.
GIVE = 0.25

#: Boundaries by falling strength; a cut comes after the match.
KINDS = ("paragraph", "line", "sentence", "clause", "word", "character", "byte")
_PATTERNS = (
    re.compile(rb"\r?\n[ \t]*(?:\r?\n[ \t]*)+"),
    re.compile(rb"\r?\n|\r(?!\n)"),
    re.compile(rb"(?:[.!?]+[\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe2\x80\xa6)(?:[ \t]|\xe3\x80\x80)*"),
    re.compile(rb"(?:[,;:](?=\s)|\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9b|\xef\xbc\x9a)[ \t]*"),
    re.compile(rb"[ \t]+|\xc2\xa0|\xe3\x80\x80"),
)
#: First code points of ranges that continue the character before them (combining
#: marks, joiners, variation selectors, emoji modifiers), with their last ones.
_CONTINUING = ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x93A, 0x93C), (0x93E, 0x94F), (0xE31, 0xE31), (0xE34, 0xE3A), (0x200D, 0x200D), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE00, 0xFE0F), (0x1F3FB, 0x1F3FF), (0xE0100, 0xE01EF))


class Boundaries:
    """The places where ``data`` may be cut, by strength."""

    def __init__(self, data: bytes):
        self.data = data
        self.places = [[m.end() for m in p.finditer(data)] for p in _PATTERNS]
        try:
            data.decode("utf-8")
            self.text = True
        except UnicodeDecodeError:
            self.text = False

    def whole(self, at: int) -> bool:
        """No character of text, with its marks, lies across ``at``."""
        d = self.data
        if not 0 < at < len(d):
            return True
        if not self.text:
            return True
        if d[at] & 0xC0 == 0x80 or d[at - 1 : at + 1] == b"\r\n":
            return False
        if d[at] < 0xC0:
            return True
        point = ord(d[at : at + 4].decode("utf-8", "ignore")[0])
        if any(a <= point <= z for a, z in _CONTINUING):
            return False
        return d[max(0, at - 3) : at] != b"\xe2\x80\x8d"

    def strongest(self, target: int, low: int, high: int, weakest: int = len(_PATTERNS)) -> tuple[int, int] | None:
        """(place, strength index) in low..high: the strongest, then the nearest to ``target``."""
        for s, places in enumerate(self.places[:weakest]):
            i, z = bisect.bisect_left(places, low), bisect.bisect_right(places, high)
            if i < z:
                j = bisect.bisect_left(places, target, i, z)
                near = [places[x] for x in (j - 1, j) if i <= x < z]
                return min(near, key=lambda p: (abs(p - target), p)), s
        return None

    def nearest_word(self, target: int, low: int, high: int) -> int | None:
        """The boundary of any strength nearest to ``target``."""
        found = []
        for places in self.places:
            i, z = bisect.bisect_left(places, low), bisect.bisect_right(places, high)
            j = bisect.bisect_left(places, target, i, z)
            found += [places[x] for x in (j - 1, j) if i <= x < z]
        return min(found, key=lambda p: (abs(p - target), p), default=None)

    def character(self, target: int, low: int, high: int) -> tuple[int, int]:
        """The nearest place at or before ``target`` (else after it) that cuts no character; else no code point."""
        for kind, ok in ((5, self.whole), (5, lambda p: self.data[p] & 0xC0 != 0x80 or not self.text)):
            for p in [*range(target, low - 1, -1), *range(target + 1, high + 1)]:
                if ok(p):
                    return p, kind if self.text else 6
        return target, 6


def pieces(data: bytes, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength index of the end) of each piece; they cover ``data`` in order.

    No piece has more than ``size`` bytes. Consecutive pieces share ``overlap`` bytes as
    nearly as the cuts allow; ``cut`` tells the overlap that was aimed at.
    """
    return cut(data, size, overlap)[0]


def cut(data: bytes, size: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """(pieces, overlap aimed at): the overlap that was asked for, but MOST_OVERLAP of the size at most,
    and less where characters are too wide for it; the pieces are as few as these limits allow."""
    n = len(data)
    if n <= size:
        return [(0, n, -1)], max(0, min(overlap, int(MOST_OVERLAP * size)))
    overlap = max(0, min(overlap, int(MOST_OVERLAP * size)))
    places = Boundaries(data)
    while True:
        count = below = -(-(n - overlap) // (size - overlap))
        while count <= n:
            found = _attempt(places, n, size, overlap, count)
            if found:
                # the counts that were passed over
                fewer = (_attempt(places, n, size, overlap, c) for c in range(below + 1, count))
                return next((f for f in fewer if f), found), overlap
            below, count = count, count + max(1, count // 16)
        if not overlap:  # characters as wide as the limit
            return _greedy(places, n, size), 0
        overlap = overlap * 7 // 8


def _greedy(places: Boundaries, n: int, size: int) -> list[tuple[int, int, int]]:
    """Full pieces without overlap, for limits of a few bytes; a limit below a character's width cuts it."""
    out, at = [], 0
    while n - at > size:
        end, kind = places.character(at + size, at + 1, at + size)
        out.append((at, end, kind))
        at = end
    return [*out, (at, n, -1)]


def _attempt(places: Boundaries, n: int, size: int, overlap: int, count: int) -> list[tuple[int, int, int]] | None:
    """Pieces around ``count`` balanced targets, or None if a limit fails."""
    step = (n - overlap) / count
    slack = max(4, int(SLACK * step))
    out, start, last = [], 0, 0
    for k in range(count - 1):
        target = int(overlap + (k + 1) * step)
        high = min(start + size, target + slack, n - 1)
        low = max(start + overlap + 1, last + 1, target - slack)
        if low > high:
            if start + size < low and step > 8:
                return None
            low, high = last + 1, min(start + size, n - 1)
            if low > high:
                return None
        target = min(max(target, low), high)
        end, strength = places.strongest(target, low, high) or places.character(target, low, high)
        if places.text and strength == 6:  # no character ends near the target
            end, strength = places.character(target, last + 1, min(start + size, n - 1))
            if strength == 6:
                return None
        out.append((start, end, strength))
        last = end
        start = _begin(places, end, overlap, start)
        if end - start >= size:
            return None
    if n - start > size:
        return None
    out.append((start, n, -1))
    return out


def _begin(places: Boundaries, end: int, overlap: int, start: int) -> int:
    """Where the next piece begins: a word's edge near the exact overlap, else a character's."""
    if not overlap:
        return end
    exact = max(end - overlap, start + 1)
    give = max(1, int(GIVE * overlap))
    low, high = max(start + 1, exact - give), min(end, exact + give)
    word = places.nearest_word(exact, low, high)
    return word if word is not None else places.character(exact, low, end)[0]


def sized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Chunks with the ``chunk_size`` and ``overlap`` of their profile; unknown and null profiles have ``default``'s."""
    opts = options.select(tidy("profile").alias("_profile"), "chunk_size", "overlap").where("_profile IS NOT NULL AND chunk_size > 0")
    opts = opts.groupBy("_profile").agg(F.max(F.struct("chunk_size", "overlap")).alias("_o"))
    base = opts.where("_profile = 'default'").select("_o").first()
    size, overlap = (base["_o"]["chunk_size"], base["_o"]["overlap"] or 0) if base else (DEFAULT_SIZE, DEFAULT_OVERLAP)
    rows = chunks.select(tidy("owner_id").alias("owner_id"), "idx", "byte_offset", "chunk_data", tidy("profile").alias("_profile"))
    return rows.join(opts, "_profile", "left").select(
        "owner_id", "idx", "byte_offset", "chunk_data",
        F.coalesce("_o.chunk_size", F.lit(size)).alias("chunk_size"),
        F.when(F.col("_o").isNotNull(), F.coalesce("_o.overlap", F.lit(0))).otherwise(F.lit(overlap)).alias("overlap"),
    )


def oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """The chunks with more bytes than their limit, each (owner_id, idx) once."""
    big = sized(chunks, options).where("octet_length(chunk_data) > chunk_size AND owner_id IS NOT NULL AND idx IS NOT NULL")
    row = F.struct("byte_offset", "chunk_size", "overlap", "chunk_data")
    return big.groupBy("owner_id", "idx").agg(F.max(row).alias("r")).select("owner_id", "idx", "r.*")


_PIECES = "owner_id string, idx int, piece int, n_pieces int, byte_offset long, size int, shared int, overlap int, boundary string, piece_data binary"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["owner_id", "idx", "piece", "n_pieces", "byte_offset", "size", "shared", "overlap", "boundary", "piece_data"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            out = []
            for owner, idx, offset, size, overlap, data in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                found, used = cut(data, size, overlap)
                before = 0
                for k, (a, z, s) in enumerate(found):
                    out.append((owner, idx, k, len(found), None if offset is None else offset + a, z - a, max(0, before - a), used, KINDS[s] if s >= 0 else "end", data[a:z]))
                    before = z
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


def split(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk.

    (owner_id, idx, piece, n_pieces, byte_offset, size, shared, overlap, boundary, piece_data):
    ``byte_offset`` counts in the owner's data (null where the chunk's is), ``shared`` is
    the overlap with the piece before, ``overlap`` the one aimed at (the profile's unless
    ``cut`` had to lower it), ``boundary`` what the piece ends at. The least
    number of pieces gets equally spaced targets, each moves to the strongest boundary
    nearby, and pieces are added while a limit fails. The bytes count, not ``size``;
    null data has no pieces; data that isn't UTF-8 may be cut between any two bytes
    where it has no line or word; repeated rows count once; a third of all chunks under
    one owner is no skew, as chunks are grouped by owner and index.
    """
    return oversized(chunks, options).select("owner_id", "idx", "byte_offset", "chunk_size", "overlap", "chunk_data").mapInArrow(_split, _PIECES)


def boundary_report(found: DataFrame) -> DataFrame:
    """Pieces, bytes and mean overlap per boundary kind."""
    return found.groupBy("boundary").agg(
        F.count("*").alias("n_pieces"), F.sum("size").alias("n_bytes"), F.max("size").alias("max_size"), F.round(F.avg("shared"), 3).alias("avg_shared")
    )


def rejoined(found: DataFrame) -> DataFrame:
    """(owner_id, idx, byte_offset, size, content): each chunk from its pieces without what they share, as its SHA-256."""
    part = F.struct("piece", "byte_offset", F.expr("substring(piece_data, shared + 1)").alias("data"))
    whole = found.groupBy("owner_id", "idx").agg(F.array_sort(F.collect_list(part)).alias("p"))
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return whole.select("owner_id", "idx", F.col("p")[0]["byte_offset"].alias("byte_offset"), data.alias("d")).select(
        "owner_id", "idx", "byte_offset", F.octet_length("d").cast("long").alias("size"), F.sha2("d", 256).alias("content")
    )
