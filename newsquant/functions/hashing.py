"""Reproducible pseudo-random keys that any SQL engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_RANGE = 1 << 32


def random_key(id_col, seed=0) -> Column:
    """Uniform integer in [0, 2^32) from the MD5 of `id:seed`."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws(":", c.cast("string"), seed_col.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def key_bucket(key: Column, buckets: Column) -> Column:
    """Equal-width bucket of a uniform 32-bit key; order-preserving."""
    return F.floor(key * buckets / F.lit(KEY_RANGE)).cast("int")
