"""Partial results that can be stored and merged: the states of metrics per group, all of bounded size.

``partial`` makes one row of states per group, ``merged`` folds rows of states (of other days, other
partitions, other stores) into one per coarser group, and ``finished`` reads the metrics from them.
Counts, sums, averages, least and greatest values are exact; distinct counts are HyperLogLog
sketches and percentiles KLL sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.kinds import Kind, named, numeric, schema_kinds
from chronofold.operators import sketches
from chronofold.operators.metrics import QUANTILES, Metric

#: The states of a metric: how each is made of rows and merged.
_MERGE = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _states(metrics: Sequence[Metric]) -> list[tuple[str, str | None]]:
    """(state, column) pairs that the metrics need, each once."""
    found: dict[tuple[str, str | None], None] = {}
    for m in metrics:
        m.validate()
        if m.op == "count":
            found["n", None] = None
        elif m.op == "avg":
            found["sum", m.column] = found["n", m.column] = None
        elif m.op == "count_distinct":
            found["distinct", m.column] = None
        elif m.op in QUANTILES:
            found["quantiles", m.column] = None
        else:
            found[m.op, m.column] = None
    return list(found)


def _name(state: str, column: str | None) -> str:
    return f"{state}({column or ''})"


def _made(state: str, column: str | None, kind: Kind | None) -> Column:
    if column is None:
        return F.count(F.lit(1))
    if kind is None:
        raise ValueError(f"no column {column}")
    if state == "distinct":
        return sketches.distinct_sketch(column)
    if state == "quantiles":
        return sketches.quantile_sketch(column, kind)
    number = numeric(named(column), kind)
    return F.count(number) if state == "n" else _MERGE[state](number)


def partial(rows: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """One row of states per group of rows."""
    kinds = schema_kinds(rows.schema)
    made = [_made(state, c, kinds.get(c)).alias(_name(state, c)) for state, c in _states(metrics)]
    return rows.groupBy(*map(named, keys)).agg(*made)


def merged(states: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """States folded into one row per group of ``keys``; they may be merged further."""
    folded = []
    for state, c in _states(metrics):
        name = _name(state, c)
        if state == "distinct":
            found = sketches.merged_distinct(name)
        elif state == "quantiles":
            found = sketches.merged_quantiles(name)
        else:
            found = _MERGE[state](named(name))
        folded.append(found.alias(name))
    return states.groupBy(*map(named, keys)).agg(*folded)


def finished(states: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """The metrics of rows of states; groups without values give 0."""
    zero, out = F.lit(0.0), []
    for m in metrics:
        state = lambda s: named(_name(s, m.column))  # noqa: B023, E731
        if m.op == "count":
            found = state("n")
        elif m.op == "avg":
            found = F.coalesce(F.try_divide(state("sum").cast("double"), state("n")), zero)
        elif m.op == "count_distinct":
            found = sketches.distinct_estimate(_name("distinct", m.column))
        elif m.op in QUANTILES:
            found = F.coalesce(sketches.quantile_estimate(_name("quantiles", m.column), m.fraction), zero)
        else:
            found = F.coalesce(state(m.op), F.lit(0))
        out.append(found.alias(m.name))
    return states.select(*map(named, keys), *out)
