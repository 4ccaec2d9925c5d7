"""Scalar column expressions (all built-in, JVM side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes of the monthly credit table and the label they map to.
GOOD_STATUS = ["X", "C", "0"]
BAD_STATUS = ["1", "2", "3", "4", "5"]

# The multiplicative-congruential mix used for deterministic splits.
# Chosen so that DuckDB can evaluate the same arithmetic for the oracle.
SPLIT_MODULUS = 1000003
SPLIT_MULTIPLIER = 48271


def response(status: Column | str = "STATUS") -> Column:
    """1.0 for X/C/0, 0.0 for 1..5, null otherwise (no ``otherwise`` branch)."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isin(*GOOD_STATUS), F.lit(1.0)).when(s.isin(*BAD_STATUS), F.lit(0.0))


def clamp_int(c: Column | str, floor: int = 0) -> Column:
    """``max(floor, int(x))``; int truncates toward zero; null stays null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(
        F.greatest(x.cast("int"), F.lit(floor))
    )


def clamp_double(c: Column | str, floor: float = 0.0) -> Column:
    """``max(floor, float(x))``; null stays null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(x.cast("double"), F.lit(float(floor)))
    )


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when den is 0 or null (ANSI division would raise)."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n.cast("double"), d.cast("double"))


def split_bucket(id_col: Column | str, seed: int, buckets: int = 100) -> Column:
    """Deterministic pseudo-random bucket in [0, buckets) of an integer id.

    Stable under repartitioning (a pure function of the id), unlike ``randomSplit``.
    """
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    mixed = F.pmod(
        F.pmod(i.cast("long"), F.lit(SPLIT_MODULUS)) * F.lit(SPLIT_MULTIPLIER) + F.lit(int(seed)),
        F.lit(SPLIT_MODULUS),
    )
    return F.pmod(mixed, F.lit(buckets)).cast("int")


def split_bucket_sql(id_sql: str, seed: int, buckets: int = 100) -> str:
    """The same bucket as SQL text (for DuckDB oracles; ids are non-negative)."""
    return (
        f"CAST(((({id_sql}) % {SPLIT_MODULUS}) * {SPLIT_MULTIPLIER} + {int(seed)}) "
        f"% {SPLIT_MODULUS} % {buckets} AS INTEGER)"
    )


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from xxhash64 of the columns and a seed."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    h = F.xxhash64(F.lit(int(seed)), *parts)
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def round_even(c: Column | str, scale: int) -> Column:
    """numpy's ``round``: ``rint(x * 10**scale) / 10**scale`` on the binary value.

    ``F.round`` is half-up, and ``F.bround`` rounds the shortest decimal text of
    the double (1211.975 -> 1211.98) where numpy gives 1211.97.
    """
    x = F.col(c) if isinstance(c, str) else c
    f = float(10 ** scale)
    return F.rint(x.cast("double") * F.lit(f)) / F.lit(f)
