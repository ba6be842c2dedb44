"""Deterministic hash helpers that Spark and DuckDB compute identically (md5 based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296  # 2**32


def md5_u32(*parts: Column | str) -> Column:
    """First 32 bits of ``md5(concat(parts))`` as a non-negative BIGINT in [0, 2**32)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = cols[0].cast("string") if len(cols) == 1 else F.concat(*[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def term_bucket(term: Column | str, dim: int) -> Column:
    """Bucket of a term in a hashed vector of ``dim`` dimensions."""
    return F.pmod(md5_u32(term), F.lit(dim)).cast("int")


def term_sign(term: Column | str) -> Column:
    """+1/-1 sign of a term from the 9th hex digit of its md5 (independent of the bucket bits)."""
    t = F.col(term) if isinstance(term, str) else term
    digit = F.conv(F.substring(F.md5(t), 9, 1), 16, 10).cast("int")
    return F.when(digit % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
