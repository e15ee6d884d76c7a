"""Deterministic hashes that do not depend on the engine, the cluster or the row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = float(1 << 60)


def hash_key(seed: int | str | Column, *keys: Column | str) -> Column:
    """60-bit non-negative integer from the md5 of ``seed:key[:key...]``."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [head.cast("string")] + [_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed: int | str | Column, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(seed, *keys) / F.lit(HASH_RANGE)


def sql_hash(seed: object, *keys: str) -> str:
    """The same hash as SQL text; ``seed`` may be a number or a column name."""
    head = f"'{seed}'" if isinstance(seed, int) else f"cast({seed} as varchar)"
    rest = "".join(f", cast({k} as varchar)" for k in keys)
    return f"cast('0x' || substr(md5(concat_ws(':', {head}{rest})), 1, 15) as bigint)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
