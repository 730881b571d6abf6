"""Stable range partition of the 64-bit hash space.

The ring has ``2**64 - 1`` as its space and ``space // n`` as the width of one
range; the last range takes the remainder. Arithmetic is on ``decimal(20,0)``
because the hash uses all 64 bits and ``bigint`` is signed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2**64 - 1

_DIGESTS = {
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "sha1": F.sha1,
    "md5": F.md5,
}


def digest(c: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in _DIGESTS:
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    return _DIGESTS[algorithm](c)


def hash64(c: Column, algorithm: str = "sha256") -> Column:
    """First 64 bits of the digest as an unsigned number."""
    return F.conv(F.substring(digest(c, algorithm), 1, 16), 16, 10).cast("decimal(20,0)")


def range_width(n: Column | int) -> Column:
    """Width of one of ``n`` ranges."""
    if isinstance(n, int):
        return F.lit(Decimal(HASH_SPACE // n)).cast("decimal(20,0)")
    space = F.lit(Decimal(HASH_SPACE)).cast("decimal(20,0)")
    return F.floor(space / n.cast("decimal(10,0)")).cast("decimal(20,0)")


def _int_div(a: Column, b: Column) -> Column:
    # Integral division; "/" on decimals rounds up near the end of a range.
    return F.call_function("div", a, b)


def chunk_index(key: Column, n: Column | int, algorithm: str = "sha256") -> Column:
    """Index of the range that holds the key's hash, 0 to ``n - 1``; null without a key."""
    last = ((F.lit(n) if isinstance(n, int) else n) - 1).cast("bigint")
    index = _int_div(hash64(key, algorithm), range_width(n))
    return F.when(key.isNotNull(), F.least(index, last)).cast("int")


def hex16(c: Column) -> Column:
    """Unsigned number as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.conv(c.cast("string"), 10, 16)), 16, "0")


def range_start(index: Column, n: Column | int) -> Column:
    return hex16((index.cast("decimal(10,0)") * range_width(n)).cast("decimal(20,0)"))


def range_end(index: Column, n: Column | int) -> Column:
    count = F.lit(n) if isinstance(n, int) else n
    following = ((index + 1).cast("decimal(10,0)") * range_width(n)).cast("decimal(21,0)")
    end = F.when(index == count - 1, F.lit(Decimal(HASH_SPACE)).cast("decimal(20,0)")).otherwise(
        (following - 1).cast("decimal(20,0)")
    )
    return hex16(end)


def ring_ranges(n: int) -> list[tuple[int, str, str]]:
    """All ranges of a ring of fixed size, for small dimension tables and checks."""
    width = HASH_SPACE // n
    return [
        (i, f"{i * width:016x}", f"{HASH_SPACE if i == n - 1 else (i + 1) * width - 1:016x}")
        for i in range(n)
    ]
