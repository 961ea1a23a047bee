"""Scalar functions as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def hex_bytes(c: Column) -> Column:
    return F.lower(F.hex(c))


def _fnv1a(values: pd.Series) -> pd.Series:
    """All values of a batch at once, a byte of each at a time; the longest are still at work when the others are done."""
    there = np.flatnonzero(values.notna().to_numpy())
    data = [bytes(values.iloc[i]) for i in there]
    size = np.array([len(v) for v in data], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    order = np.argsort(-size, kind="stable")
    h = np.full(len(data), 0xCBF29CE484222325, dtype=np.uint64)
    longest_first, prime = size[order], np.uint64(0x100000001B3)
    for k in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-longest_first, -k, side="left")]
        h[on] = (h[on] ^ flat[start[on] + k]) * prime
    out = pd.Series([None] * len(values), dtype="Int64")
    out.iloc[there] = h.view(np.int64)
    return out


def fnv1a_64(c: Column) -> Column:
    """The 64-bit FNV-1a hash, as a signed long. For joins xxhash64 does as well without leaving the JVM."""
    return F.pandas_udf(_fnv1a, T.LongType())(c.cast("binary"))


def type_name(value: Column) -> Column:
    """The type of a VAL; Null where it is missing."""
    names = {"b": "Bool", "i": "Int", "f": "Float", "s": "String", "x": "Bytes"}
    out = F.lit("Null")
    for tag, name in names.items():
        out = F.when(value["t"] == tag, name).otherwise(out)
    return out
