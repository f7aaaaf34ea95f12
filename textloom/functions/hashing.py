"""Content addresses, fingerprints and seeded orders."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Fixed value: the exact split address covers this many leading code points plus the length.
ADDRESS_CHARS = 16_384


def sha256_key(value: Column, digits: int | None = None) -> Column:
    """Hex SHA-256 of a string or binary column, cut to ``digits`` when given."""
    full = F.sha2(value, 256)
    return full if digits is None else F.substring(full, 1, digits)


def file_key(path: Column) -> Column:
    """Ten hex digits that name a source path."""
    return sha256_key(path, 10)


def seeded_hash(seed: int | str | Column, *keys: Column) -> Column:
    """md5 of ``seed:key[:key…]`` — a reproducible random order for rows with a unique key."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first.cast("string"), *[k.cast("string") for k in keys]))


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    """Leading hex digits as an integer; keeps the order of the digests."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


@arrow_udf(T.DoubleType())
def _blake_fraction(prefixes: pa.Array, lengths: pa.Array) -> pa.Array:
    digests = b"".join(
        hashlib.blake2b(f"{text}{length}".encode(errors="replace"), digest_size=8).digest()
        for text, length in zip(prefixes.to_pylist(), lengths.to_pylist())
    )
    fractions = np.frombuffer(digests, dtype="<u8").astype(np.float64) / 2.0**64
    return pa.array(fractions, mask=prefixes.is_null().to_numpy(zero_copy_only=False))


def unit_interval(text: Column, method: str = "md5") -> Column:
    """A number in [0, 1) that depends on the content of ``text`` only.

    ``md5`` stays in the JVM and hashes the whole text; ``blake2b`` is bit-exact with the published
    address (leading code points plus decimal length, 64-bit little-endian digest).
    """
    if method == "md5":
        digest = F.md5(F.concat(text, F.length(text).cast("string")))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    if method == "blake2b":
        return _blake_fraction(F.substring(text, 1, ADDRESS_CHARS), F.length(text))
    raise ValueError(f"unknown hash method {method!r}")


def is_validation(text: Column, fraction: float, method: str = "md5") -> Column:
    """True for the content-addressed share ``fraction`` of all texts."""
    if not 0.0 < fraction < 0.1:
        raise ValueError("validation fraction must be between 0 and 0.1")
    return unit_interval(text, method) < F.lit(fraction)
