"""Seeded hash randomness.

Every random choice in the engine is a function of ``(seed, salt, id)``
through md5, so results do not depend on partitioning or on the order in
which tasks run, and DuckDB can reproduce them exactly:

    key(seed, salt, id) = md5(seed || ':' || salt || ':' || id)
    u(seed, salt, id)   = int(first 8 hex digits of key, 16) / 2^32

Sampling m rows means taking the m smallest ``(key, id)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int, salt: str, id_col) -> Column:
    """md5 hex string of ``seed:salt:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)),
                             _as_col(id_col).cast("string")))


def uniform(seed: int, salt: str, id_col) -> Column:
    """Uniform double in [0, 1) derived from :func:`hash_key`."""
    return (F.conv(F.substring(hash_key(seed, salt, id_col), 1, 8), 16, 10)
            .cast("double") / F.lit(4294967296.0))


def hash_order(seed: int, salt: str, id_col) -> list[Column]:
    """Sort key for seeded sampling: hash first, id as tie-break."""
    return [hash_key(seed, salt, id_col), _as_col(id_col)]
