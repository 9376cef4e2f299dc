"""Text decoded with another character encoding than it was written in.

Adjacent character pairs are scored by their mutual information over the whole corpus,
the maximum-scoring segments of improbable pairs are isolated, and only these are put
through inverse mappings (back to bytes by the wrong encoding, on by the right one).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.session import materialize, spread

#: Pairs that every task holds at most (16 bytes each), those seen most often; documents whose suspicious
#: segments need the counts of others get these from the table of all pairs.
KEPT = 1 << 22
#: Alphabets below this size have their pair counts in a square table.
DENSE = 4096
#: Discount of a pair's mutual information: a pair seen in this share of all pairs has half of it.
HALF = 2e-6
#: What an unseen pair scores, and how far one pair can push a segment.
UNSEEN, LIMIT = 2.0, 3.0
#: What a segment scores at least; less is what any two words that rarely meet have.
LEAST = 0.25
#: Nats by which a restored segment's mean pair must be likelier than the garbled one's.
GAIN = 2.0
#: What a pair of ASCII characters scores at least and at most.
PLAIN = -1.0, -0.5
#: Characters that must speak for a mapping between two legacy encodings.
EVIDENCE = 3
LETTERS = 6
#: Nats by which a text's weakly supported stretches must gain in all, and how many times as many documents
#: must have their mapping on strong evidence as have it on such alone.
WEAK, POOL = 8.0, 1
EXPLAINED = 0.5
#: Longer stretches aren't remembered; so many shorter ones and pairs are, per worker.
MEMO = 64
REMEMBERED = 200_000

#: Encodings that texts are wrongly decoded with, and were written in.
WRONG = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1253", "cp1254", "gbk", "cp932", "cp949", "big5")
RIGHT = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "mac_roman", "cp437", "cp850", "gbk", "cp932", "cp949", "big5", "euc_jp")
_MULTI = {"gbk", "cp932", "cp949", "big5", "euc_jp"}


def _reverse(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


REVERSE = {w: _reverse(w) for w in WRONG if w not in _MULTI}
#: Single-byte encodings under which a valid UTF-8 sequence isn't likely in any clean text.
_TELLING = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")
#: Others under which one such sequence may be, but not two in a row.
_TELLING_TWICE = ("koi8_r", "cp1250", "iso8859_2", "cp1253", "cp1254")


def _byte_table(codec: str) -> np.ndarray:
    t = np.full(0x10000, -1, "i2")
    for c, b in REVERSE[codec].items():
        t[ord(c)] = b
    return t


_TABLES = {w: _byte_table(w) for w in (*_TELLING, *_TELLING_TWICE)}


def damaged(points: np.ndarray) -> np.ndarray:
    """Characters that only a wrong decoding leaves: U+FFFD, C1 controls, private use."""
    return (points == 0xFFFD) | ((points >= 0x80) & (points <= 0x9F)) | ((points >= 0xE000) & (points <= 0xF8FF))


def invertible(points: np.ndarray) -> np.ndarray:
    """Marks characters inside sequences that are UTF-8 under one of the telling encodings."""
    hit = np.zeros(len(points), bool)
    where = np.flatnonzero(points > 127)
    if len(where) < 2:
        return hit
    here = points[where]
    low = np.where(here < 0x10000, here, 0)
    # characters that are followed by one, two, three others without a gap
    gap = np.r_[np.diff(where) != 1, True]
    run = [~gap]
    for _ in range(2):
        run.append(run[-1] & np.r_[~gap[len(run) :], np.zeros(min(len(run), len(gap)), bool)])
    for name, t in _TABLES.items():
        b = t[low]
        b[here >= 0x10000] = -1
        follows = (b >= 0x80) & (b <= 0xBF)
        starts, ends = [], []
        for first, last, more in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)):
            at = np.flatnonzero((b >= first) & (b <= last) & run[more - 1])
            for j in range(1, more + 1):
                at = at[follows[at + j]]
            starts.append(at)
            ends.append(at + more + 1)
        start, end = np.concatenate(starts), np.concatenate(ends)
        if name in _TELLING_TWICE and len(start):
            first, after = np.zeros(len(here) + 1, bool), np.zeros(len(here) + 1, bool)
            first[start], after[end] = True, True
            twice = after[start] & ~gap[start - 1] | first[end] & ~gap[end - 1]
            start, end = start[twice], end[twice]
        for j in range(4):
            hit[where[(start + j)[start + j < end]]] = True
    return hit


_WIDE_RUN = re.compile("[\u2e80-\ufffd]{3,}")


def wide(text: str) -> Iterator[tuple[int, int]]:
    """Runs of East Asian characters that are UTF-8 under one of the multi-byte encodings."""
    for m in _WIDE_RUN.finditer(text):
        for wrong in sorted(_MULTI & set(WRONG)):
            other = utf8_of(m[0], wrong)
            if other is not None and not other.isascii():
                yield m.span()
                break


def _points(texts: list[str]) -> np.ndarray:
    """All texts' code points, a zero before each text and at the end."""
    return np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain = np.zeros(128 * 128, "i8")
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            texts = [t for t in batch.slice(i, 512).column(0).to_pylist() if t]
            p = _points(texts)
            bad = damaged(p) | invertible(p)
            start = 1
            for t in texts:
                if not t.isascii():
                    for a, z in wide(t):
                        bad[start + a : start + z] = True
                start += len(t) + 1
            a, b = p[:-1], p[1:]
            ascii_pair = (a < 128) & (b < 128)
            plain += np.bincount(a[ascii_pair] << 7 | b[ascii_pair], minlength=len(plain))
            keep = ~(bad[1:] | bad[:-1] | ascii_pair)
            code, n = np.unique(a[keep] << 21 | b[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype("i8"))], names=["pair", "n"])
    at = np.flatnonzero(plain)
    yield pa.RecordBatch.from_arrays([pa.array((at >> 7) << 21 | at & 127), pa.array(plain[at])], names=["pair", "n"])


@dataclass
class PairModel:
    """Pair counts of the corpus (sorted by pair) and of the single characters."""

    pairs: np.ndarray
    counts: np.ndarray
    points: np.ndarray
    singles: np.ndarray
    total: float
    half: float
    dense: int
    #: Pairs looked up that the model doesn't hold, where it doesn't hold all.
    missed: set | None = None
    #: Further pairs with their counts.
    extra: dict[int, int] | None = None

    @cached_property
    def single(self) -> np.ndarray:
        """Counts by code point."""
        out = np.zeros(0x110000)
        out[self.points] = self.singles
        return out

    @cached_property
    def square(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(place by code point, counts by two places) for alphabets that allow it."""
        if len(self.points) >= self.dense:
            return None
        place = np.full(0x110000, len(self.points), "i4")
        place[self.points] = np.arange(len(self.points))
        n = len(self.points) + 1
        table = np.zeros(n * n)
        table[place[self.pairs >> 21] * n + place[self.pairs & 0x1FFFFF]] = self.counts
        table[n - 1 :: n] = table[(n - 1) * n :] = 0  # of a character that isn't there
        return place, table

    def pair_counts(self, p: np.ndarray) -> np.ndarray:
        code = p[:-1] << 21 | p[1:]
        if self.square:
            place, table = self.square
            at = place[p]
            found = table[at[:-1] * (len(self.points) + 1) + at[1:]]
        elif len(self.pairs):
            i = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            found = np.where(self.pairs[i] == code, self.counts[i], 0.0)
        else:
            found = np.zeros(len(code))
        if self.missed is not None:
            self.missed.update(code[found == 0].tolist())
        if self.extra:
            lacking = np.flatnonzero(found == 0)
            found[lacking] = [self.extra.get(c, 0) for c in code[lacking].tolist()]
        return found

    def of(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each adjacent pair of ``p``: its count and the counts of both characters."""
        ab, one = self.pair_counts(p), self.single[p]
        return ab, one[:-1], one[1:]

    def improbability(self, p: np.ndarray) -> np.ndarray:
        """Per pair: minus its discounted mutual information, between -LIMIT and LIMIT."""
        if self.square and self.missed is None and not self.extra:
            return self.scores[self.places(p)]
        return self._improbability(*self.of(p))

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """Per pair: log of its share of all pairs, smoothed by those of its characters."""
        if self.square and self.missed is None and not self.extra:
            return self.logs[self.places(p)]
        return self._likelihood(*self.of(p))

    def _improbability(self, ab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mi = np.log(np.maximum(ab, 0.5) * self.total / (np.maximum(a, 0.5) * np.maximum(b, 0.5)))
        trust = ab / (ab + max(1.0, self.half * self.total))
        score = np.clip((1 - trust) * UNSEEN - trust * mi, -LIMIT, LIMIT)
        score[(a == 0) | (b == 0)] = LIMIT  # a character that no sound text of the corpus has
        return score

    def _likelihood(self, ab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.total
        return np.log(0.9 * ab / n + 0.1 * np.maximum(a, 0.1) / n * np.maximum(b, 0.1) / n + 1e-12)

    def places(self, p: np.ndarray) -> np.ndarray:
        at = self.square[0][p]
        return at[:-1] * (len(self.points) + 1) + at[1:]

    @cached_property
    def scores(self) -> np.ndarray:
        return self._improbability(*self._all()).astype("f4")

    @cached_property
    def logs(self) -> np.ndarray:
        return self._likelihood(*self._all())

    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, n = np.append(self.singles, 0.0), len(self.points) + 1
        return self.square[1], np.repeat(one, n), np.tile(one, n)

    def pair_likelihood(self, a: int, b: int) -> float:
        """``likelihood`` of one pair."""
        n = self.total
        ab = float(self.pair_counts(np.array([a, b]))[0])
        na, nb = self.single[a], self.single[b]
        return math.log(0.9 * ab / n + 0.1 * max(na, 0.1) / n * max(nb, 0.1) / n + 1e-12)

    def beside(self, missed: set | None = None, extra: dict[int, int] | None = None) -> PairModel:
        """The model of one document: it notes what it misses, or has further pairs; the tables are shared."""
        out = replace(self, missed=missed, extra=extra)
        out.__dict__.update(single=self.single, square=self.square)
        return out


def pair_model(documents: DataFrame, text: str = "text") -> tuple[PairModel, DataFrame | None]:
    """Counts over all documents; pairs within sequences that are plainly garbled aren't counted as evidence.

    The model holds the KEPT pairs seen most often at most; the others, if any, come as a table (pair, n).
    """
    counted = spread(documents.select(text)).mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pairs")
    row = counted.agg(F.sum("n").alias("total"), *[F.sum((F.col("n") >= 1 << j).cast("long")).alias(f"b{j}") for j in range(60)]).first()
    total = row["total"] or 0
    least = next((1 << j for j in range(60) if (row[f"b{j}"] or 0) <= KEPT), 1 << 60)
    rows = counted.where(F.col("n") >= least).toArrow()
    ones = counted.groupBy(F.shiftright("pair", 21).alias("point")).agg(F.sum("n").alias("n")).toArrow()  # an alphabet: 1.1 million at most
    order = np.argsort(rows.column("pair").to_numpy())
    first = np.argsort(ones.column("point").to_numpy())
    model = PairModel(rows.column("pair").to_numpy()[order], rows.column("n").to_numpy()[order].astype("f8"), ones.column("point").to_numpy()[first], ones.column("n").to_numpy()[first].astype("f8"), max(1.0, float(total)), HALF, DENSE)
    return model, counted.where(F.col("n") < least) if least > 1 else None


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """The maximal scoring subsequences (start, end) of ``score``: disjoint, each of positive sum."""
    if not len(score) or score.max() <= 0:
        return []
    sign = score > 0
    cuts = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    sums = np.add.reduceat(score, cuts)
    ends = np.r_[cuts[1:], len(score)]
    kept: list[list] = []  # start, end, sum before, sum after
    run = 0.0
    for a, z, s in zip(cuts.tolist(), ends.tolist(), sums.tolist()):
        before, run = run, run + s
        if s <= 0:
            continue
        new = [a, z, before, run]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], z, kept[j][2], run]
            del kept[j:]
    return [(k[0], k[1]) for k in kept]


_EAST = re.compile("[\u2e80-\ufffd]").search


def to_bytes(s: str, wrong: str) -> bytes | None:
    if wrong in _MULTI:
        try:
            return s.encode(wrong)
        except UnicodeEncodeError:
            return None
    table = REVERSE[wrong]
    try:
        return bytes([table[c] for c in s])
    except KeyError:
        return None


def inverses(s: str) -> Iterator[tuple[str, str, str]]:
    """(restored, wrong, right) for every inverse mapping that ``s`` allows and that changes it."""
    seen, told, east = set(), {s}, _EAST(s)
    for wrong in WRONG:
        if wrong in _MULTI and not east:  # nearly all that these give is East Asian
            continue
        raw = to_bytes(s, wrong)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for right in RIGHT:
            if right == wrong:
                continue
            try:
                t = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if t not in told:
                told.add(t)
                yield t, wrong, right


def utf8_of(s: str, wrong: str) -> str | None:
    """What the bytes of ``s`` are in UTF-8."""
    raw = to_bytes(s, wrong)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


@dataclass
class Finding:
    start: int
    end: int
    restored: str | None
    wrong: str | None
    right: str | None
    weak: bool = False


class Options:
    """Texts (text, wrong, right) that a stretch may have been, with the log-likelihood of their pairs."""

    def __init__(self, texts: list[tuple[str, str, str]], sums: np.ndarray):
        self.texts, self.sum = texts, sums
        self.bound = sums / np.maximum(1, [len(t) - 1 for t, _, _ in texts]) if texts else sums


def alien(letter: str, c: str) -> bool:
    """Whether ``c`` beside ``letter`` is a symbol, a number or a letter of another alphabet."""
    kinds = ("LATIN", "GREEK", "CYRILLIC")
    one, two = (unicodedata.name(x, "").split(" ")[0] for x in (letter, c))
    return unicodedata.category(c)[0] in "SN" or one in kinds and two in kinds and one != two


def _code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")


class Finder:
    """Finds and restores the garbled stretches of texts under a pair model."""

    def __init__(self, model: PairModel):
        self.model = model
        self.known: dict[tuple[str, str], float] = {}
        most = model.counts.max(initial=0.0)
        single = max(0.1, model.singles.max(initial=0.0)) / model.total
        self.top = math.log(0.9 * most / model.total + 0.1 * single * single + 1e-12)  # no pair is likelier
        self.tried: dict[tuple[str, str, str], tuple[str, str, str] | None] = {}
        self.options: dict[str, Options] = {}

    def options_of(self, s: str) -> Options:
        """What ``s`` may have been, and second layers of that where it is UTF-8 again; remembered for short ones."""
        found = self.options.get(s)
        if found is None:
            texts: list[tuple[str, str, str]] = []
            for t, wrong, right in inverses(s):
                # a layer of a double decoding may still hold controls
                if right == "utf-8" and not t.isascii():
                    texts += [(u, wrong, right) for u in {utf8_of(t, w) for w in WRONG} if u is not None and u != t and not _CONTROL(u)]
                if not _CONTROL(t):
                    texts.append((t, wrong, right))
            found = Options(texts, self.sums([t for t, _, _ in texts]))
            if len(s) <= MEMO:
                if len(self.options) > REMEMBERED // 4:
                    self.options.clear()
                self.options[s] = found
        return found

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of the pairs inside each text."""
        if not texts:
            return np.empty(0)
        value = np.concatenate([[0.0], np.cumsum(self.model.likelihood(_code_points("\0".join(texts) + "\0")))])
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        return value[at[1:] - 2] - value[at[:-1]]

    def pair(self, a: str, b: str) -> float:
        k = a, b
        x = self.known.get(k)
        if x is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            x = self.known[k] = self.model.pair_likelihood(ord(a), ord(b))
        return x

    def mean(self, before: str, s: str, after: str) -> float:
        """Mean log-likelihood of the pairs of ``s`` and its neighbours."""
        s = before + s + after
        if len(s) < 2:
            return 0.0
        if len(s) > MEMO:
            return float(self.model.likelihood(_code_points(s)).mean())
        return sum(map(self.pair, s, s[1:])) / (len(s) - 1)

    def best(self, text: str, a: int, z: int) -> tuple[str, str, str] | None:
        """The inverse mapping of text[a:z] that gains most, if it gains enough; the same words are tried once."""
        k = text[a - 1 : a], text[a:z], text[z : z + 1]
        if z - a > MEMO:
            return self.search(*k)
        if k not in self.tried:
            if len(self.tried) > REMEMBERED:
                self.tried.clear()
            self.tried[k] = self.search(*k)
        return self.tried[k]

    def search(self, before: str, s: str, after: str) -> tuple[str, str, str] | None:
        options = self.options_of(s)
        if not options.texts:
            return None
        here = self.mean(before, s, after)
        least, ends, found = here + GAIN, bool(before) + bool(after), None
        pairs = max(1, len(s) - 1 + ends)
        for i in np.argsort(-options.bound, kind="stable").tolist():
            t, wrong, right = options.texts[i]
            n = len(t) - 1 + ends
            # no pair is likelier than the top one, so neither neighbour lifts the mean beyond this
            if right != "utf-8" and options.sum[i] + ends * self.top <= least * n:
                continue
            total = options.sum[i] + (self.pair(before, t[0]) if before else 0.0) + (self.pair(t[-1], after) if after else 0.0)
            gain = total / n if n else 0.0
            if right == "utf-8":  # fewer characters than bytes: what the whole text gains, for each pair that it had
                gain = max(gain, here + (total - here * pairs) / pairs)
            if gain > least:
                found, least = (t, wrong, right), gain
        if found and not found[0].isascii():
            layers = {u for u in (utf8_of(found[0], w) for w in WRONG) if u is not None and u != found[0]}
            again = max(((self.mean(before, u, after), u) for u in layers), default=None)
            if again and again[0] > least + GAIN / 2:
                found = (again[1], *found[1:])
        return found

    def findings(self, text: str, p: np.ndarray, score: np.ndarray) -> list[Finding]:
        """``p``: code points with a zero at either end; ``score``: improbability of its pairs."""
        hurt: list[tuple[int, int]] = []
        bad = damaged(p)
        # pairs a..z-1 touch characters a..z of p, that is a-1..z-1 of the text; the longest come first
        todo = sorted({(max(0, a - 1), min(len(text), z)) for a, z in segments(score) if score[a:z].sum() >= LEAST}, key=lambda s: (s[0] - s[1], s))
        every, dropped = list(todo), []
        held: list[Finding] = []
        tried = set()
        for a, z in todo:
            if bad[a + 1 : z + 1].any():
                hurt.append((a, z))
        while True:
            for s in todo:
                for x, y in self.windows(text, *s):
                    if x >= y or (x, y) in tried or any(f.start < y and x < f.end for f in held) or text[x:y].isascii():
                        continue
                    tried.add((x, y))
                    hit = self.best(text, x, y)
                    if hit:
                        held.append(Finding(x, y, *hit))
            kept = self.supported(text, held)
            names = {id(f) for f in kept}
            # where a hit is dropped, the windows it kept from being tried come next
            if len(kept) == len(held):
                break
            free = [f for f in held if id(f) not in names]
            todo = [s for s in every if any(f.start < s[1] and s[0] < f.end for f in free)]
            held, dropped = kept, dropped + free
        found = kept + [Finding(a, z, None, None, None) for a, z in sorted(hurt) if not any(f.start < z and a < f.end for f in kept)]
        if not dropped:
            return found
        sums = [(max(0, a - 1), min(len(text), z), float(score[a:z].sum())) for a, z in segments(score)]
        return found + self.weak(text, dropped, found, [s for s in sums if not text[s[0] : s[1]].isascii()])

    def gain(self, text: str, f: Finding) -> float:
        """Nats by which a restored stretch is likelier than the garbled one."""
        before, s, after = text[f.start - 1 : f.start] if f.start else "", text[f.start : f.end], text[f.end : f.end + 1]
        return (self.mean(before, f.restored, after) - self.mean(before, s, after)) * (len(s) - 1 + bool(before) + bool(after))

    def weak(self, text: str, dropped: list[Finding], found: list[Finding], parts: list[tuple[int, int, float]]) -> list[Finding]:
        """Dropped stretches that the corpus decides about: of mappings that gain at least WEAK nats over the
        text and explain at least EXPLAINED of what its improbable segments (start, end, score) score besides ``found``."""
        touches = lambda f, a, z: f.start < z and a < f.end
        rest = [s for s in parts if not any(touches(f, s[0], s[1]) for f in found)]
        all_of = sum(s[2] for s in rest)
        by: dict[tuple, list[Finding]] = {}
        for f in dropped:
            if not any(touches(f, x.start, x.end) for x in (*found, *by.get((f.wrong, f.right), ()))):
                by.setdefault((f.wrong, f.right), []).append(f)
        out: list[Finding] = []
        gains = {m: sum(self.gain(text, f) for f in fs) for m, fs in by.items()}
        for m in sorted(by, key=lambda m: (-gains[m], m)):
            explained = sum(s[2] for s in rest if any(touches(f, s[0], s[1]) for f in by[m]))
            if gains[m] >= WEAK and explained >= EXPLAINED * all_of:
                out += [replace(f, weak=True) for f in by[m] if not any(touches(f, x.start, x.end) for x in out)]
        return out

    @staticmethod
    def supported(text: str, found: list[Finding]) -> list[Finding]:
        """Drops mappings between legacy encodings that too few characters of the text speak for.

        A mapping to UTF-8 proves itself by its byte structure. Any other needs EVIDENCE
        characters in the text that aren't white space, two of them different (if all are
        letters: LETTERS, three of them different); or, between two letters, a symbol or a
        letter of another script; or a box-drawing character before a letter.
        """
        seen: dict[tuple, list[str]] = {}
        inside: set[tuple] = set()
        for f in found:
            for i in range(f.start, f.end):
                c = text[i]
                if not c.isascii() and not c.isspace():
                    seen.setdefault((f.wrong, f.right), []).append(c)
                    if 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha() and alien(text[i - 1], c):
                        inside.add((f.wrong, f.right))
                    if "\u2500" <= c <= "\u259f" and text[i + 1 : i + 2].isalpha():
                        inside.add((f.wrong, f.right))
        strong = {m for m, cs in seen.items() if m[1] in ("utf-8", None) or m in inside or len(cs) >= LETTERS and len(set(cs)) > 2 or len(cs) >= EVIDENCE and len(set(cs)) > 1 and not all(map(str.isalpha, cs))}
        return [f for f in found if f.wrong is None or (f.wrong, f.right) in strong]

    @staticmethod
    def windows(text: str, a: int, z: int) -> Iterator[tuple[int, int]]:
        """The segment, widened to its words; without ASCII ends; the runs of other characters in it."""
        x, y = a, z
        while x > 0 and not text[x - 1].isspace() and ord(text[x - 1]) > 127:
            x -= 1
        while y < len(text) and ord(text[y]) > 127:
            y += 1
        # characters below @ are no part of any encoding's characters of several bytes
        while x < y and text[x] < "@":
            x += 1
        while y > x and text[y - 1] < "@":
            y -= 1
        yield x, y
        u, v = x, y
        while u < v and text[u].isascii():
            u += 1
        while v > u and text[v - 1].isascii():
            v -= 1
        yield u, v
        for pattern in (_OTHER_RUN, _WESTERN_RUN):
            for m in pattern.finditer(text, x, y):
                yield m.span()


_CONTROL = re.compile("[\x80-\x9f\ufffd]").search
_OTHER_RUN = re.compile(r"[^\x00-\x7f]+(?:[\x21-\x7e]{1,2}[^\x00-\x7f]+)*|[^\x00-\x7f]+")


_WESTERN = "\u0080-\u036f\u2000-\u2bff"
#: Latin letters, marks and symbols on their own, where another script stands beside them.
_WESTERN_RUN = re.compile(f"[{_WESTERN}]+(?:[\x21-\x7e]{{1,2}}[{_WESTERN}]+)*")


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("wrong", pa.string()), ("right", pa.string()), ("weak", pa.bool_()), ("restored", pa.string())]))


def _scored(model: PairModel, p: np.ndarray) -> np.ndarray:
    """Improbability of each pair; a wrong decoding leaves ASCII as it is, so pairs of it speak little and never for it."""
    score = model.improbability(p)
    plain = (p[:-1] < 128) & (p[1:] < 128)
    score[plain] = np.clip(score[plain], *PLAIN)
    return score


def _find(shared, partial: bool = False):
    """Findings of (key, text), and the pairs looked up in vain where the model is ``partial``; a third
    column holds further pairs of a document, which is then read by its own model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        finder = Finder(common)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                own = part.column(2).to_pylist() if part.num_columns > 2 else None
                rows = [k for k, t in enumerate(texts) if t and not t.isascii()]
                keep, stretches, missed = [], [], []
                if rows and own is None and not partial:
                    p = _points([texts[k] for k in rows])
                    score = _scored(common, p)
                    starts = np.cumsum([0] + [len(texts[k]) + 1 for k in rows])
                for j, k in enumerate(rows):
                    if own is not None:
                        finder = Finder(common.beside(extra={x["pair"]: x["n"] for x in own[k] or ()}))
                    elif partial:
                        finder = Finder(common.beside(missed=set()))
                    if own is None and not partial:
                        a, z = int(starts[j]), int(starts[j + 1])
                        mine, its = p[a : z + 1], score[a:z]
                    else:
                        mine = _points([texts[k]])
                        its = _scored(finder.model, mine)
                    found = finder.findings(texts[k], mine, its)
                    lacking = sorted(finder.model.missed) if partial else []
                    if found or lacking:
                        keep.append(k)
                        stretches.append([{"start": f.start, "end": f.end, "wrong": f.wrong, "right": f.right, "weak": f.weak, "restored": f.restored} for f in found])
                        missed.append(lacking)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(stretches, _FOUND), pa.array(missed, pa.list_(pa.int64()))], names=["key", "text", "found", "missed"])

    return run


def _repair(accepted: set[tuple[str, str]]):
    """(key, stretches, restored) from (key, text, found): weak stretches stay where their mapping is accepted."""
    shown = pa.list_(pa.struct([f for f in _FOUND.value_type if f.name not in ("weak", "restored")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stretches, restored = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                kept = [Finding(f["start"], f["end"], f["restored"], f["wrong"], f["right"]) for f in found if not f["weak"] or (f["wrong"], f["right"]) in accepted]
                stretches.append([{"start": f.start, "end": f.end, "wrong": f.wrong, "right": f.right} for f in kept])
                restored.append(repaired(text, kept) if kept else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(stretches, shown), pa.array(restored, pa.string())], names=["key", "stretches", "restored"])

    return run


def repaired(text: str, found: list[Finding]) -> str | None:
    """``text`` with its restorable stretches restored; null if none is."""
    if all(f.restored is None for f in found):
        return None
    out, at = [], 0
    for f in sorted(found, key=lambda f: f.start):
        if f.start >= at and f.restored is not None:
            out += [text[at : f.start], f.restored]
            at = f.end
    return "".join([*out, text[at:]])


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stretches, restored) of the documents with at least one garbled stretch.

    stretches: (start, end, wrong, right) in characters; wrong and right are null where
    no inverse mapping holds (characters that only a wrong decoding leaves). ``restored``
    is null where nothing can be restored. Null and empty texts and pure ASCII have none;
    whole texts are read; an empty table gives no rows.
    """
    types = dict(documents.dtypes)
    model, rest = pair_model(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    shape = f"key {types[key]}, text string, found array<struct<start:int,end:int,wrong:string,right:string,weak:boolean,restored:string>>, missed array<long>"
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = materialize(spread(docs).mapInArrow(_find(shared, rest is not None), shape), "found")
    if rest is not None:
        # pairs beyond the model: documents that looked for some of them are read again with their counts
        wanted = found.select("key", F.explode("missed").alias("pair")).join(rest, "pair")
        wanted = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("pair", "n")).alias("pairs")), "wanted")
        again = docs.join(wanted, "key").select("key", "text", "pairs").mapInArrow(_find(shared), shape)
        found = materialize(found.join(wanted, "key", "left_anti").unionByName(again), "found")
    # a weak stretch counts if the corpus has its mapping mostly on strong evidence
    each = found.select("key", F.exists("found", lambda f: ~f["weak"]).alias("any"), F.explode("found").alias("f")).where("f.wrong IS NOT NULL").select("key", "any", "f.wrong", "f.right", "f.weak")
    each = each.groupBy("key", "wrong", "right").agg(F.bool_and("weak").alias("weak"), F.first("any").alias("any"))
    votes = each.groupBy("wrong", "right").agg(F.sum((~F.col("weak")).cast("long")).alias("strong"), F.sum((F.col("weak") & ~F.col("any")).cast("long")).alias("unsure")).collect()
    accepted = {(r["wrong"], r["right"]) for r in votes if r["strong"] >= POOL * r["unsure"]}  # a mapping a row
    out = found.select("key", "text", "found").mapInArrow(_repair(accepted), f"key {types[key]}, stretches array<struct<start:int,end:int,wrong:string,right:string>>, restored string")
    return out.where(F.size("stretches") > 0).withColumnRenamed("key", key)


def garble_report(found: DataFrame) -> DataFrame:
    """Documents and stretches per pair of encodings."""
    x = found.select(found.columns[0], F.explode("stretches").alias("s"))
    return x.groupBy("s.wrong", "s.right").agg(F.countDistinct(found.columns[0]).alias("n_docs"), F.count("*").alias("n_stretches"))
