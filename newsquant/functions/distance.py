"""Row-to-row distances as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mini-event columns: absolute difference for numbers, mismatch for categories.
MINI_NUMERIC = ["day_no", "goldstein", "is_root", "num_mentions", "num_sources", "num_articles", "avg_tone"]
MINI_CATEGORY = ["event_code", "quad_class", "actor1_name", "actor2_name", "actor1_geo", "actor2_geo", "domain"]


def mixed_distance(a: str, b: str, numeric: Sequence[str] = tuple(MINI_NUMERIC),
                   category: Sequence[str] = tuple(MINI_CATEGORY)) -> Column:
    """Sum of |difference| and of mismatches; a missing category always counts 1.

    `a` and `b` are the aliases of the two sides.
    """
    total = F.lit(0.0)
    for c in numeric:
        total = total + F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    for c in category:
        same = F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(False))
        total = total + F.when(same, 0.0).otherwise(1.0)
    return total
