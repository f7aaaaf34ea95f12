"""Packed token sequences: little-endian uint16 in a binary column, two bytes a token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

TOKEN_BYTES = 2
MAX_VOCAB = 65_535


@arrow_udf(T.ArrayType(T.IntegerType()))
def unpack_ids(packed: pa.Array) -> pa.Array:
    """Packed binary to an array of ids."""
    rows = packed.to_pylist()
    flat = np.frombuffer(b"".join(r for r in rows if r is not None), dtype="<u2").astype(np.int32)
    ends = np.cumsum([0] + [0 if r is None else len(r) // TOKEN_BYTES for r in rows])
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(flat), mask=mask
    )


@arrow_udf(T.BinaryType())
def pack_ids(ids: pa.Array) -> pa.Array:
    """Array of ids to packed binary; an id that does not fit raises."""
    out = []
    for row in ids.to_pylist():
        if row is None:
            out.append(None)
            continue
        values = np.asarray(row, dtype=np.int64)
        if values.size and (values.min() < 0 or values.max() >= MAX_VOCAB):
            raise ValueError("token id does not fit the uint16 format")
        out.append(values.astype("<u2").tobytes())
    return pa.array(out, pa.binary())


@arrow_udf(T.ArrayType(T.IntegerType()))
def distinct_ids(packed: pa.Array) -> pa.Array:
    """The different ids of a packed sequence."""
    return pa.array(
        [
            None if row is None else np.unique(np.frombuffer(row, dtype="<u2")).astype(np.int32)
            for row in packed.to_pylist()
        ],
        pa.list_(pa.int32()),
    )


def count_id(packed: Column, token_id: int) -> Column:
    """How often an id occurs in a packed sequence."""

    @arrow_udf(T.LongType())
    def count(rows: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if row is None else int((np.frombuffer(row, dtype="<u2") == token_id).sum())
                for row in rows.to_pylist()
            ],
            pa.int64(),
        )

    return count(packed)


def token_count(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / TOKEN_BYTES)


def packed_slice(packed: Column, start: Column, count: Column) -> Column:
    """Tokens ``start`` (from 0) to ``start + count`` of a packed sequence."""
    return packed.substr(
        (start * TOKEN_BYTES + 1).cast("int"), (count * TOKEN_BYTES).cast("int")
    )
