"""Scalar helpers (B9-B11, B14) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_sig(v, sig: int = 3) -> Column:
    """B10 for integers: ``sig`` significant figures, ties to even; NULL and
    0 pass through.  Pure BIGINT arithmetic (quotient / remainder by a power
    of ten), so there is no floating-point rounding at all."""
    x = _c(v).cast("long")
    a = F.abs(x)
    digits = F.length(a.cast("string"))
    k = F.greatest(digits - F.lit(sig), F.lit(0))
    p = F.pow(F.lit(10), k).cast("long")
    r = a % p
    # round the remainder away when 2r > p, or on a tie when the kept part is odd
    odd = (a - r) % (p * 2) != 0
    up = (r * 2 > p) | ((r * 2 == p) & odd)
    rounded = a - r + F.when(up & (k > 0), p).otherwise(F.lit(0).cast("long"))
    return F.when(x.isNull() | (x == 0), x).otherwise(F.signum(x).cast("long") * rounded)


def round_sig_float(v, sig: int = 4) -> Column:
    """B10 for float statistics: ``sig`` significant figures, ties to even;
    NULL and 0 pass through."""
    x = _c(v).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (sig - 1))
    return F.when(x.isNull() | (x == 0), x).otherwise(F.rint(x / unit) * unit)


def parse_abbrev(text) -> Column:
    """``128k``, ``1.09k``, ``4.66M``, ``1,234`` -> integer; no match -> 0.

    Decimal arithmetic, rounded half-even to an integer."""
    t = F.regexp_replace(F.trim(_c(text)), ",", "")
    num = F.regexp_extract(t, r"^([\d.]+)\s*([kKmM]?)", 1)
    suf = F.lower(F.regexp_extract(t, r"^([\d.]+)\s*([kKmM]?)", 2))
    mult = F.when(suf == "k", F.lit(1000)).when(suf == "m", F.lit(1000000)).otherwise(F.lit(1))
    val = F.bround(num.try_cast("decimal(30,8)") * mult, 0).try_cast("long")
    return F.when(num == "", F.lit(0).cast("long")).otherwise(F.coalesce(val, F.lit(0).cast("long")))


def log10_pos(v) -> Column:
    """log10 of a positive value, NULL otherwise (callers drop NULLs)."""
    c = _c(v)
    return F.when(c > 0, F.log10(c))


def created_date(c) -> Column:
    """Creation time of either era (string or timestamp) -> DATE."""
    col = _c(c)
    return F.to_date(col.cast("string").substr(1, 10))
