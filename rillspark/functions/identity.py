"""Stable identifiers and seeds that Spark has no function for."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(*parts: Column) -> Column:
    """BLAKE2b of 16 bytes, in hex, over the compact JSON array of the parts (whole numbers and strings)."""

    @F.pandas_udf(T.StringType())
    def digest(rows: pd.DataFrame) -> pd.Series:
        values = rows.astype(object).where(rows.notna(), None).itertuples(index=False)
        return pd.Series([hashlib.blake2b(json.dumps([v if v is None or isinstance(v, str) else int(v) for v in r], separators=(",", ":")).encode(), digest_size=16).hexdigest() for r in values])

    return digest(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))))


def region_file(row: Column, column: Column) -> Column:
    """Name of a region's file, signs included."""
    return F.format_string("r%+06d_c%+06d", row, column)


def probe_key(x: Column) -> Column:
    """Order in which equally large groups are drawn: a multiplicative hash modulo 2 ** 32."""
    return ((x + 1) * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF))
