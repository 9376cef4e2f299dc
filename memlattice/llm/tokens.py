"""Encoding texts with a public byte-level BPE vocabulary through a sentencepiece model.

The model is serialised here from the vocabulary file alone: each token's bytes are
mapped to one printable character a byte, its score is its negative rank, and the
normaliser is the identity. Merging by the best score is then merging by the lowest
rank, so sentencepiece yields the vocabulary's own ids.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.session import spread

TOKENIZERS = os.environ.get("MEMLATTICE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers between batches.
MEMORY = 200_000


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it prints, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_CHARACTERS = byte_characters()
_TABLE = {b: c for b, c in enumerate(_CHARACTERS)}
_BYTES = {c: b for b, c in enumerate(_CHARACTERS)}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_TABLE)


def unmapped(piece: str) -> bytes:
    return bytes(_BYTES[c] for c in piece)


def vocabulary(path: str) -> list[bytes]:
    """The tokens in rank order."""
    with open(path, "rb") as f:
        ranks = [line.split() for line in f if line.strip()]
    return [base64.b64decode(t) for t, r in sorted(ranks, key=lambda x: int(x[1]))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: piece i is token i; the required unknown piece comes last."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = _field(1, mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    # trainer: type BPE, size, ids of unknown, begin, end and padding (absent: -1)
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(i, absent) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Encoder:
    """Splits a text into pre-tokens, encodes each distinct one once, and decodes by the inverse mapping."""

    def __init__(self, directory: str = TOKENIZERS, name: str = VOCABULARY):
        import regex
        import sentencepiece

        self.tokens = vocabulary(os.path.join(directory, name))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the empty and the null text have none."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        if new:
            known.update(zip(new, self.model.encode([mapped(w.encode("utf-8", "replace")) for w in new], num_threads=1)))
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(unmapped(self.model.id_to_piece(i)) for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZERS, name: str = VOCABULARY) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(directory, name)


def _slices(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, max(batch.num_rows, 1), size):
        yield batch.slice(i, size)


def encode(df: DataFrame, key: str, text: str = "text", directory: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of ``text``, one row per row of ``df``; no special tokens.

    Empty and null texts come out with an empty list (``text_state`` of ``encode_states``
    tells them apart). Whole texts are encoded whatever their length; strings that look
    like special tokens are ordinary text; repeated rows are kept; other columns are
    dropped; an empty table gives no rows.
    """
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                ids = encoder(directory, name).encode_batch(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {types[key]}, ids array<int>")


def encode_states(df: DataFrame, key: str, text: str = "text", **kw) -> DataFrame:
    """(key, text_state, n_tokens, n_bytes, lossless): text_state is ``null``, ``empty`` or ``text``."""
    types = dict(df.dtypes)
    directory, name = kw.get("directory", TOKENIZERS), kw.get("name", VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                e, texts = encoder(directory, name), b.column(1).to_pylist()
                ids = e.encode_batch(texts)
                state = ["null" if t is None else "text" if t else "empty" for t in texts]
                back = [e.decode(i) == (t or "") for i, t in zip(ids, texts)]
                size = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(state, pa.string()), pa.array([len(i) for i in ids], pa.int64()), pa.array(size, pa.int64()), pa.array(back, pa.bool_())],
                    names=[key, "text_state", "n_tokens", "n_bytes", "lossless"],
                )

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {types[key]}, text_state string, n_tokens long, n_bytes long, lossless boolean")


def token_counts(df: DataFrame, text: str = "text", directory: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with ``n_tokens``."""
    kept = [c for c in df.columns if c != text]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                n = [len(i) for i in encoder(directory, name).encode_batch(b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return spread(df.select(text, *kept)).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "n_tokens long"]))


def token_report(states: DataFrame) -> DataFrame:
    """Documents, tokens and bytes per token of each text_state."""
    return states.groupBy("text_state").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), F.bool_and("lossless").alias("lossless")
    )
