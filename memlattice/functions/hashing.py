"""Content hashes: SHA3-256 (Arrow UDF), SHA-256 (built in), 31-hashes and rolling fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

#: Polynomial and boundary mask of the rolling fingerprint.
POLYNOMIAL = 0x3DA3358B4DC173
MASK = 0x1FFF


@pandas_udf(StringType())
def sha3_256(data: pd.Series) -> pd.Series:
    """Hex SHA3-256 of binary or string values; null stays null."""
    raw = lambda x: x.encode() if isinstance(x, str) else bytes(x)
    return data.map(lambda x: None if x is None else hashlib.sha3_256(raw(x)).hexdigest())


def digest(col: Column, algorithm: str = "sha3") -> Column:
    return sha3_256(col) if algorithm == "sha3" else F.sha2(col, 256)


def pair_digest(a: Column, b: Column, algorithm: str = "sha3") -> Column:
    """Hash of the two hex strings' text, the smaller one first."""
    return digest(F.concat(F.least(a, b), F.greatest(a, b)), algorithm)


def is_hash(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9a-f]{64}$"), F.lit(False))


def string_hash(text: str) -> int:
    """31-hash over UTF-16 units, wrapped to 32 bits."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype("u8")
    n = len(units)
    if not n:
        return 0
    powers = np.ones(n, "u8")
    if n > 1:
        powers[1:] = np.cumprod(np.full(n - 1, 31, "u8"))
    return int((units * powers[::-1]).sum(dtype="u8").astype("u4").view("i4"))


@pandas_udf(IntegerType())
def java_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else string_hash(t)).astype("Int32")


def object_hash(fields: dict[str, Column], algorithm: str = "sha3") -> Column:
    """Hash of a JSON object of ``fields`` in key order."""
    return digest(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])), algorithm)


def content_id(*cols: Column) -> Column:
    """A deterministic UUID-shaped id from the values, for rows that are made again on retry."""
    h = F.md5(F.concat_ws("\u0001", *cols))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
