"""Partition-independent randomness.

``rand(seed)`` depends on how rows fall into partitions, so a recomputed task
(after an executor loss, or with another partition count) would draw other
numbers.  Every random choice in this library is a function of the row's own
key instead: ``md5(concat_ws('|', parts...))``.  The first 8 hex digits read as
an unsigned 32-bit integer and divided by 2^32 give a uniform in [0, 1).  The
same text is produced by DuckDB, so samplers and splits have exact SQL oracles:

    DuckDB: ('0x' || substr(md5(concat_ws('|', parts...)), 1, 8))::BIGINT / 4294967296.0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def hash_key(*parts) -> Column:
    """md5 hex digest of the '|'-joined parts (strings, ints or columns)."""
    return F.md5(F.concat_ws("|", *[_part(p) for p in parts]))


def uniform(*parts) -> Column:
    """Deterministic uniform in [0, 1) from the parts."""
    digest = hash_key(*parts)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def gaussian(*parts) -> Column:
    """Deterministic standard normal draw (Box-Muller on two hash uniforms)."""
    u1 = F.lit(1.0) - uniform(*parts, "bm1")  # in (0, 1], so log is finite
    u2 = uniform(*parts, "bm2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


def sql_hash_key(*parts: str) -> str:
    """DuckDB text of :func:`hash_key`; parts are SQL expressions."""
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_uniform(*parts: str) -> str:
    """DuckDB text of :func:`uniform`."""
    return f"(('0x' || substr({sql_hash_key(*parts)}, 1, 8))::BIGINT / 4294967296.0)"
