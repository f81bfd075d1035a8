"""Mergeable sketches for rollups: made once per fine group, stored, and merged for coarser ones.

Distinct counts use HyperLogLog of 2^precision registers (4 to 21), quantiles KLL; both are bytes
of bounded size, merged by map-side combining aggregates.  Where a distinct count has to be exact at
any size, ``distinct_values`` keeps a row for each value of a group instead; HyperLogLog is an estimate
even where it still lists its hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.kinds import Kind, named, numeric

PRECISION = 14


def distinct_sketch(column: str, precision: int = PRECISION) -> Column:
    if not 4 <= precision <= 21:
        raise ValueError(f"precision out of range: {precision}")
    return F.hll_sketch_agg(named(column), precision)


def merged_distinct(sketches: str) -> Column:
    """Merges sketches of one precision; different ones are an error."""
    return F.hll_union_agg(named(sketches), F.lit(False))


def distinct_estimate(sketches: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(named(sketches)), F.lit(0))


def distinct_values(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The values of each group, null included, with the number ``n`` of their rows; spread over tasks by value."""
    return rows.groupBy(*map(named, [*keys, column])).agg(F.count(F.lit(1)).alias("n"))


def merged_values(values: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Values of finer groups folded into those of the groups of ``keys``; they may be merged further."""
    return values.groupBy(*map(named, [*keys, column])).agg(F.sum("n").alias("n"))


def quantile_sketch(column: str, kind: Kind = Kind.FLOAT) -> Column:
    return F.kll_sketch_agg_double(numeric(named(column), kind).cast("double"))


def merged_quantiles(sketches: str) -> Column:
    return F.kll_merge_agg_double(named(sketches))


def quantile_estimate(sketches: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(named(sketches), F.lit(q))


def count_in_range(rows: DataFrame, column: str, value: str, start: int, end: int) -> int:
    """Rows of [start, end) whose text column has a value."""
    when = named("timestamp")
    return rows.filter((when >= start) & (when < end) & (named(column) == value)).count()
