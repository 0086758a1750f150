"""Deterministic per-row randomness.

``hash_key(seed, key)`` is the first 32 bits of ``md5("seed:key")`` as a
BIGINT in [0, 2^32).  It depends only on the row's key, never on the
partitioning, so samples/splits/folds are identical on 8 or 8,000 cores and
reproducible in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2 ** 32)


def hash_key(seed, *keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    h = F.md5(F.concat(*parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def unit_hash(seed, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(seed, *keys) / F.lit(TWO_32)
