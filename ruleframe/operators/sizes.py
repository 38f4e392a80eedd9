"""Broadcasting only what has been counted, and splitting joins at heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of at most so many narrow rows are broadcast; larger ones are joined by exchange.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows. ``df`` should be cheap to count: checkpointed or tiny."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def heavy_keys(counted: DataFrame, keys: list[str], n: str, share: float = 0.001, least: int = 10_000) -> DataFrame:
    """The keys with at least ``share`` of all rows (and ``least`` of them); there are at most 1 / share such keys.

    ``counted`` holds partial counts ``n`` by ``keys`` and perhaps more columns. Null keys are left out: they match nothing.
    """
    per_key = counted.groupBy(*keys).agg(F.sum(n).alias("__n"))
    total = counted.agg(F.sum(n)).first()[0] or 0
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return per_key.where((F.col("__n") >= F.lit(max(least, int(total * share)))) & known).select(*keys)
