"""Metrics: each names its result column and builds an aggregate; groups without values give 0."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.kinds import Kind

#: The quantiles of the named percentiles.
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@dataclass(frozen=True)
class Metric:
    """An operation on a column.  ``distinct`` is the tagged source of a distinct count, else ``source`` is a number."""

    op: str
    column: str | None = None
    quantile: float | None = None

    @property
    def name(self) -> str:
        if self.op == "count":
            return "count"
        return f"count({self.column})" if self.op == "count_distinct" else f"{self.op}({self.column})"

    def validate(self) -> None:
        if self.op == "count":
            return
        if not self.column:
            raise ValueError(f"{self.op} needs a column")
        if self.op in ("sum", "avg", "max", "min", "count_distinct"):
            return
        if self.op not in QUANTILES:
            raise ValueError(f"unknown metric {self.op}")
        if not 0 < self.fraction <= 1:
            raise ValueError(f"quantile out of range: {self.fraction}")

    @property
    def fraction(self) -> float:
        return QUANTILES[self.op] if self.quantile is None else self.quantile


def Count() -> Metric:
    return Metric("count")


def Sum(column: str) -> Metric:
    return Metric("sum", column)


def Avg(column: str) -> Metric:
    return Metric("avg", column)


def Max(column: str) -> Metric:
    return Metric("max", column)


def Min(column: str) -> Metric:
    return Metric("min", column)


def CountDistinct(column: str) -> Metric:
    return Metric("count_distinct", column)


def P50(column: str) -> Metric:
    return Metric("p50", column)


def P75(column: str) -> Metric:
    return Metric("p75", column)


def P90(column: str) -> Metric:
    return Metric("p90", column)


def P95(column: str) -> Metric:
    return Metric("p95", column)


def P99(column: str) -> Metric:
    return Metric("p99", column)


def P999(column: str) -> Metric:
    return Metric("p999", column)


def Percentile(column: str, op: str, quantile: float) -> Metric:
    """A percentile under one of the six names with a quantile of its own."""
    return Metric(op, column, quantile)


def aggregates(metrics: Sequence[Metric], sources: dict[str, Column], values: dict[str, Column], kinds: dict[str, Kind], approximate: bool) -> tuple[dict[str, Column], list[Column]]:
    """The aggregate columns to compute by name (``__m`` and the metric's number, if not shared), and the result columns that read them.

    ``sources`` holds each column as a number, ``values`` as what distinct counts compare.
    Percentiles of one column share one aggregate, as one array of quantiles.
    """
    made: dict[str, Column] = {}
    results: list[Column] = []
    quantiles: dict[str, list[float]] = {}
    for m in metrics:
        if m.op in QUANTILES:
            fractions = quantiles.setdefault(m.column, [])
            if m.fraction not in fractions:
                fractions.append(m.fraction)
    slots = {c: f"__q{i}" for i, c in enumerate(quantiles)}

    def exact_count(column: str) -> Column:
        if not quantiles:
            return F.count_distinct(values[column])
        # Beside a distinct count Spark would build every percentile anew for each distinct value; a set needs
        # no second pass, and takes memory like the percentile's.
        value = values[column]
        if kinds.get(column) is not Kind.FLOAT:
            return F.size(F.collect_set(value)).cast("bigint")
        # A set takes -0.0 and 0.0 for two, and any NaN for another.
        plain = F.when(value == 0, F.lit(0.0)).when(~F.isnan(value), value)
        return F.size(F.collect_set(plain)).cast("bigint") + F.coalesce(F.max(F.isnan(value).cast("bigint")), F.lit(0))

    for c, fractions in quantiles.items():
        source, asked = sources[c].cast("double"), F.array(*map(F.lit, fractions))
        found = F.percentile_approx(source, fractions, 10_000) if approximate else F.percentile(source, asked)
        made[slots[c]] = found.alias(slots[c])
    for i, m in enumerate(metrics):
        slot = f"__m{i}"
        zero = F.lit(0).cast("bigint") if kinds.get(m.column) is Kind.INT else F.lit(0.0)
        if m.op in QUANTILES:
            results.append(F.coalesce(F.get(slots[m.column], F.lit(quantiles[m.column].index(m.fraction))), F.lit(0.0)).alias(m.name))
            continue
        if m.op == "count":
            found = F.count(F.lit(1))
        elif m.op == "count_distinct":
            found = F.approx_count_distinct(values[m.column], 0.0081) if approximate else exact_count(m.column)
        elif m.op == "avg":
            found = F.coalesce(F.avg(sources[m.column].cast("double")), F.lit(0.0))
        else:
            found = F.coalesce({"sum": F.sum, "max": F.max, "min": F.min}[m.op](sources[m.column]), zero)
        made[slot] = found.alias(slot)
        results.append(F.col(slot).alias(m.name))
    return made, results
