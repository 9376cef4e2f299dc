"""Model-free embeddings in Arrow batches."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from memlattice.functions.hashing import string_hash

DIM = 384
#: Word, direction and spread of the seed lexicon.
LEXICON = """
code 0 0.2 | function 0.1 0.15 | variable 0.05 0.15 | class 0.08 0.18 | method 0.12 0.15 | type 0.15 0.2 | error 0.5 0.25
bug 0.52 0.2 | fix 0.55 0.18 | test 0.3 0.2 | learn 0.7 0.25 | understand 0.72 0.2 | know 0.68 0.22 | think 0.65 0.25
idea 0.75 0.3 | create 0.25 0.2 | build 0.27 0.18 | make 0.28 0.22 | use 0.35 0.25 | get 0.4 0.3 | set 0.42 0.25
is 0.9 0.4 | has 0.88 0.35 | with 0.85 0.38 | from 0.82 0.35 | to 0.95 0.45
"""
#: Families of marker words with their weights; family i covers dimensions 48 i to 48 i + 47.
FAMILIES = (
    ("because|therefore|thus|hence|so", 0.3),
    ("if|when|unless|while|although", 0.3),
    ("is|are|was|were|be|being", 0.2),
    ("can|could|may|might|should|would", 0.25),
    ("first|then|next|finally|after", 0.25),
    ("but|however|although|despite|yet", 0.3),
    ("all|every|any|some|none", 0.2),
    ("more|less|most|least|very", 0.2),
)
_SPLIT = re.compile(r"[^a-z0-9_\s가-힣ㄱ-ㅎㅏ-ㅣ]")
_FAMILY_RE = [re.compile(rf"\b(?:{p})\b", re.ASCII) for p, _ in FAMILIES]


def _unit(v: np.ndarray) -> np.ndarray:
    n = math.sqrt(float((v.astype("f8") ** 2).sum()))
    return (v / n).astype("f4") if n > 0 else v.astype("f4")


#: 31 to the powers 1 to DIM and what the steps add, both modulo 2^32.
_POWERS, _STEPS = np.empty(DIM, "u8"), np.empty(DIM, "u8")
_power, _step = 1, 0
for _i in range(DIM):
    _power, _step = _power * 31 & 0xFFFFFFFF, (_step * 31 + _i) & 0xFFFFFFFF
    _POWERS[_i], _STEPS[_i] = _power, _step


def deterministic(text: str) -> np.ndarray:
    """A pseudo-random unit vector from the text's 31-hash, stepped once per dimension."""
    h = np.uint64(string_hash(text) & 0xFFFFFFFF)
    signed = (h * _POWERS + _STEPS).astype("u4").view("i4")
    return _unit((np.fmod(signed, 1000) / 1000 - 0.5).astype("f4"))


def simple(text: str) -> np.ndarray:
    """Character codes weighted by word place, bucketed by code · word · letter."""
    out = np.zeros(DIM, "f4")
    for i, word in enumerate(re.split(r"\s+", text.lower()), 1):
        codes = np.frombuffer(word.encode("utf-16-le", "surrogatepass"), "<u2").astype("i8")
        np.add.at(out, codes * i * np.arange(1, len(codes) + 1) % DIM, np.float32(1 / (1 + math.log(i))))
    return _unit(out)


def _seeded(direction: float, spread: float) -> np.ndarray:
    angle = np.arange(DIM) / DIM * 2 * math.pi
    base = direction * 2 * math.pi
    return _unit(np.exp(-np.abs(np.sin(angle - base)) / spread) * (np.cos(angle + base) * 0.5 + 0.5))


_WORDS = {w: _seeded(float(d), float(s)) for w, d, s in (x.split() for x in LEXICON.strip().replace("\n", "|").split("|"))}


#: 31-hashes of the dimension numbers, and what a hash before them is multiplied with.
_NUMBER = np.array([string_hash(str(i)) for i in range(DIM)], "i8")
_SHIFT = np.array([31 ** len(str(i)) for i in range(DIM)], "i8")


@lru_cache(maxsize=50_000)
def word_vector(word: str) -> np.ndarray:
    """The lexicon's direction, else a unit vector from the hashes of ``word_<dimension>``."""
    v = _WORDS.get(word)
    if v is None:
        v = _unit((string_hash(word + "_") * _SHIFT + _NUMBER & 0xFFFF) / 32768 - 1)
    return v


@lru_cache(maxsize=512)
def _wave(pos: int) -> np.ndarray:
    i = np.arange(DIM)
    angle = pos / 10000 ** (2 * (i >> 1) / DIM)
    return np.where(i % 2, np.cos(angle), np.sin(angle))


def gram_hashes(chars: str) -> list[np.ndarray]:
    """``string_hash`` of all runs of 3, 4 and 5 characters."""
    units = np.frombuffer(chars.encode("utf-16-le", "surrogatepass"), "<u2").astype("u8")
    if len(units) != len(chars):  # characters of two units: run by run
        return [np.array([string_hash(chars[i : i + n]) for i in range(len(chars) - n + 1)], "i8") for n in (3, 4, 5)]
    out = []
    for n in (3, 4, 5):
        h = np.zeros(max(0, len(units) - n + 1), "u8")
        for j in range(n):
            h = h * np.uint64(31) + units[j : j + len(h)]
        out.append(h.astype("u4").view("i4").astype("i8"))
    return out


def local(text: str, idf: dict[str, float] | None = None, context: np.ndarray | None = None) -> np.ndarray:
    """Half TF-IDF word vectors, a quarter character n-grams, 0.15 positions, 0.1 context or marker families."""
    lowered = text.lower()
    tokens = _SPLIT.sub(" ", lowered).split()
    out = np.zeros(DIM)
    if tokens:
        names, counts = np.unique(tokens, return_counts=True)
        unseen = math.log(100)
        weight = counts / len(tokens) * [(idf or {}).get(t, unseen) for t in names]
        per = dict(zip(names, weight))
        w = np.array([per[t] for t in tokens])
        out += 0.5 * (np.stack([word_vector(t) for t in tokens]) * w[:, None]).sum(axis=0) / w.sum()
    grams = np.zeros(DIM)
    chars = re.sub(r"\s+", "_", lowered)
    for h in gram_hashes(chars):
        np.add.at(grams, np.abs(h) % DIM, (h >> 16 & 0xFFFF) / 65535 - 0.5)
    reach = np.minimum(np.arange(DIM) + 4, DIM), np.maximum(np.arange(DIM) - 3, 0)
    sums = np.r_[0, np.cumsum(grams)]
    out += 0.25 * (sums[reach[0]] - sums[reach[1]]) / (reach[0] - reach[1])
    bit = np.arange(DIM) % 32
    for pos, token in enumerate(tokens[:512]):
        out += 0.15 * (_wave(pos) + (string_hash(token) >> bit & 1) * 0.01) / (pos + 1)
    if context is not None:
        return _unit(out + 0.1 * context)
    for k, (pattern, (_, weight)) in enumerate(zip(_FAMILY_RE, FAMILIES)):
        n = len(pattern.findall(lowered))
        if n:
            out[48 * k : 48 * k + 48] += 0.1 * np.sin(np.arange(48) / 48 * 2 * math.pi + n) * weight * math.log(n + 1)
    korean = len(re.findall("[가-힯]", lowered)) / max(1, len(text))
    out[:16] += 0.1 * ((korean if text else 0) - 0.5) * 0.1
    return _unit(out)


def _embedder(f):
    @pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return embed


@pandas_udf(ArrayType(FloatType()))
def fitted_embedding(texts: pd.Series, idf: pd.Series) -> pd.Series:
    """``local`` with the fitted idf of the text's own terms (a map column)."""
    return pd.Series([None if t is None else local(t, dict(m) if m is not None else None) for t, m in zip(texts, idf)])


#: Column functions: null text gives null.
deterministic_embedding = _embedder(deterministic)
simple_embedding = _embedder(simple)
local_embedding = _embedder(local)
