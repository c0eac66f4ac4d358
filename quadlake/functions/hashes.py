"""Content hashes and their Base58 text form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Base58 alphabet, and SHA-256 of nothing, which stands for "no revision".
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
NIL = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def encode58(data: bytes, width: int = 44) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = ALPHABET[k] + out
    return out.rjust(width, ALPHABET[0])


def decode58(text: str, size: int = 32) -> bytes:
    n = 0
    for c in text:
        n = n * 58 + ALPHABET.index(c)
    return n.to_bytes(size, "big")


def base58(hex_hash: Column) -> Column:
    """44 characters for a SHA-256 in hex. An Arrow UDF: use it where hashes leave the system, and hex inside."""

    @F.pandas_udf("string")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else encode58(bytes.fromhex(h)))

    return encode(hex_hash)


def from_base58(text: Column) -> Column:
    """Hex of a Base58 hash; null where it is not one."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None or len(t) != 44 else decode58(t).hex()
        except (ValueError, OverflowError):
            return None

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(one)

    return decode(text)


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def is_nil(h: Column) -> Column:
    return h == NIL
