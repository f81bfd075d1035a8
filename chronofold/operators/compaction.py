"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.kinds import named


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order``, a unique number, of every key; rows without the last key go.

    The greatest number per key is found on two narrow columns with map-side combining, so a hot
    key stays small; whole rows move only to meet it.
    """
    last = rows.filter(named(keys[-1]).isNotNull()).groupBy(*map(named, keys)).agg(F.max(named(order)).alias("_last"))
    return rows.join(last.select("_last"), named(order) == F.col("_last"), "left_semi")
