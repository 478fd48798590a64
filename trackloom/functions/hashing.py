"""Stable 64-bit unit hashes. Applied to distinct tracks only, never per frame."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F, types as T


def _unit(value: str, order: str, scale: float) -> float:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8"), digest_size=8).digest(), order) / scale


@F.pandas_udf(T.DoubleType())
def split_hash(keys: pd.Series) -> pd.Series:
    """Little-endian digest over 2**64: decides train, val or test."""
    return keys.map(lambda k: _unit(k, "little", float(2**64)))


@F.pandas_udf(T.DoubleType())
def fraction_hash(keys: pd.Series) -> pd.Series:
    """Big-endian digest over 2**64 - 1: decides membership in a fraction sample."""
    return keys.map(lambda k: _unit(k, "big", float(2**64 - 1)))


def md5_code(keys):
    """60-bit integer from md5, by built-ins only, so plain SQL can repeat it."""
    return F.conv(F.substring(F.md5(keys), 1, 15), 16, 10).cast("long")


def md5_hash(keys):
    """Unit hash from the first 32 bits of md5."""
    return F.conv(F.substring(F.md5(keys), 1, 8), 16, 10).cast("double") / float(2**32)
