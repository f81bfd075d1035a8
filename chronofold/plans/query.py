"""Queries and their plans: range, filter, group, aggregate, order, all as one lazy DataFrame."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronofold.functions import timedims
from chronofold.functions.kinds import SPARK_TYPES, Kind, named, numeric, schema_kinds, stored
from chronofold.operators.filters import Filter
from chronofold.operators.metrics import QUANTILES, Metric, aggregates

TIMESTAMP = "timestamp"

#: What the optimizer may expect to read for a query whose distinct counts and percentiles are exact by default.
EXACT_BYTES = 1 << 36

Instant = datetime | int | float


@dataclass(frozen=True)
class OrderBy:
    field: str
    desc: bool = False


@dataclass(frozen=True)
class Query:
    """What to compute.  ``start`` and ``end`` bound a half-open range and are floored to seconds.

    Exact distinct counts and percentiles hold the distinct values of a group in memory, sketches are
    of bounded size.  ``approximate`` says which; left open, sketches are taken where the columns read
    come to more than ``EXACT_BYTES``.
    """

    start: Instant
    end: Instant
    dataset: str = ""
    dimensions: Sequence[str] = ()
    metrics: Sequence[Metric] = ()
    metric: Metric | None = None
    filter: Filter | None = None
    order_by: Sequence[OrderBy] = ()
    granularity: str = "day"
    timezone: str = "UTC"
    approximate: bool | None = None

    def all_metrics(self) -> list[Metric]:
        return list(dict.fromkeys([*self.metrics, *([self.metric] if self.metric else [])]))

    def all_dimensions(self) -> list[str]:
        return list(dict.fromkeys(self.dimensions))

    def stored_dimensions(self) -> list[str]:
        return [d for d in self.all_dimensions() if d not in (timedims.DATE, timedims.DAY_OF_WEEK)]

    def bounds(self) -> tuple[int, int]:
        return math.floor(seconds(self.start)), math.floor(seconds(self.end))

    def columns(self) -> set[str]:
        """The stored columns the query reads, besides the timestamp."""
        read = {*self.stored_dimensions(), *(m.column for m in self.all_metrics() if m.column)}
        return (read | (self.filter.columns() if self.filter else set())) - {TIMESTAMP}

    def validate(self) -> None:
        if bool(self.metrics) == (self.metric is not None):
            raise ValueError("give either metric or metrics")
        for m in self.all_metrics():
            if m is None:
                raise ValueError("empty metric")
            m.validate()
        if seconds(self.end) <= seconds(self.start):
            raise ValueError("invalid time range")
        if self.filter is not None:
            self.filter.validate()
        names = [m.name for m in self.all_metrics()]
        if len(set(names)) < len(names):
            raise ValueError("two metrics share a name")
        if clash := set(names) & set(self.dimensions):
            raise ValueError(f"dimension and metric share a name: {sorted(clash)[0]}")
        if not all(self.dimensions):
            raise ValueError("empty dimension")
        for o in self.order_by:
            if not o.field:
                raise ValueError("empty order field")
            if o.field not in (*self.dimensions, *names, "count"):
                raise ValueError(f"unsupported order field {o.field}")


def seconds(instant: Instant) -> float:
    """Unix seconds; a datetime without a zone is in UTC."""
    if isinstance(instant, datetime):
        return (instant if instant.tzinfo else instant.replace(tzinfo=UTC)).timestamp()
    return instant


def merged_kind(kinds: Sequence[Kind | None]) -> Kind | None:
    """The kind of a column over several inputs: the common one, or None where they differ or none has it."""
    found = {k for k in kinds if k is not None}
    return found.pop() if len(found) == 1 else None


@dataclass
class Part:
    """Rows that share one kind for each column."""

    rows: DataFrame
    kinds: Mapping[str, Kind]
    read: dict[str, Kind] = field(default_factory=dict)

    def kind(self, column: str) -> Kind | None:
        return Kind.INT if column == TIMESTAMP else self.kinds.get(column)


def _tagged(column: Column, kind: Kind) -> Column:
    """A value that differs from equal-looking values of other kinds."""
    return F.when(column.isNotNull(), F.struct(F.lit(kind.value).alias("kind"), column.cast("string").alias("text")))


@dataclass
class Watch:
    """Row counts gathered while a query runs; read them after an action on its result."""

    seen: list[Observation] = field(default_factory=list)

    def on(self, rows: DataFrame) -> DataFrame:
        self.seen.append(Observation())
        return rows.observe(self.seen[-1], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> list[int]:
        return [o.get["rows"] for o in self.seen]


def _projected(part: Part, query: Query, mixed: set[str], numbers: dict[str, Kind], watch: tuple[Watch, Watch] | None) -> DataFrame:
    """Range, filter and projection of one part to dimensions d0.., numbers n0.. and distinct sources v0.. ."""
    start, end = query.bounds()
    kinds = {**part.kinds, TIMESTAMP: Kind.INT}
    when = named(TIMESTAMP)
    kept = part.rows.filter((when >= start) & (when < end))
    kept = watch[0].on(kept) if watch else kept
    if query.filter is not None:
        kept = kept.filter(query.filter.to_column(kinds))
    kept = watch[1].on(kept) if watch else kept
    out: list[Column] = []
    for i, d in enumerate(query.all_dimensions()):
        if d == timedims.DATE:
            c = timedims.bucket(when, query.granularity, query.timezone)
        elif d == timedims.DAY_OF_WEEK:
            c = timedims.day_of_week(when, query.timezone)
        elif (kind := part.kind(d)) is None:
            c = F.lit(None).cast("struct<kind:string,text:string>" if d in mixed else SPARK_TYPES[numbers.get(d, Kind.STRING)])
        else:
            c = _tagged(named(d), kind) if d in mixed else named(d)
        out.append(c.alias(f"d{i}"))
    sources = sorted({m.column for m in query.all_metrics() if m.column})
    for i, s in enumerate(sources):
        kind = part.kind(s)
        number = F.lit(None) if kind is None else numeric(named(s), kind)
        out.append(number.cast("bigint" if numbers.get(s) is Kind.INT else "double").alias(f"n{i}"))
        if any(m.op == "count_distinct" and m.column == s for m in query.all_metrics()):
            if s in mixed:
                c = F.lit(None).cast("struct<kind:string,text:string>") if kind is None else _tagged(named(s), kind)
            else:
                c = F.lit(None).cast(SPARK_TYPES[numbers.get(s, Kind.STRING)]) if kind is None else named(s)
            out.append(c.alias(f"v{i}"))
    return kept.select(*out)


#: What the optimizer says of inputs whose size it cannot tell.
UNKNOWN = 1 << 62


def expected_bytes(rows: DataFrame) -> int:
    """The size of a DataFrame's rows as the optimizer expects it, from the sizes of the files and of the columns read."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def plan(parts: Sequence[Part], query: Query, watch: tuple[Watch, Watch] | None = None) -> DataFrame:
    """The result of a valid query over parts, of which there is at least one.

    ``watch`` counts the rows in range and the rows that pass the filter; counting them keeps the
    filter from being pushed to the scan.
    """
    metrics, dims = query.all_metrics(), query.all_dimensions()
    sources = sorted({m.column for m in metrics if m.column})
    numbers: dict[str, Kind] = {}
    mixed: set[str] = set()
    for c in {*query.stored_dimensions(), *sources}:
        found = [p.kind(c) for p in parts]
        if (one := merged_kind(found)) is not None:
            numbers[c] = one
        elif any(k is not None for k in found):
            mixed.add(c)
    rows = reduce(DataFrame.unionByName, [_projected(p, query, mixed, numbers, watch) for p in parts])
    place = {s: i for i, s in enumerate(sources)}
    approximate = query.approximate
    if approximate is None:
        approximate = any(m.op == "count_distinct" or m.op in QUANTILES for m in metrics) and EXACT_BYTES < expected_bytes(rows) < UNKNOWN
    made, results = aggregates(
        metrics, {s: F.col(f"n{i}") for s, i in place.items()}, {s: F.col(f"v{i}") for s, i in place.items()}, {s: numbers.get(s) for s in sources}, approximate
    )
    if dims:
        keys = [f"d{i}" for i in range(len(dims))]
        grouped = rows.groupBy(*keys).agg(*made.values())
    else:  # no row in, no row out
        grouped = rows.agg(*made.values(), F.count(F.lit(1)).alias("__rows")).filter("__rows > 0")
    shown = [(F.col(f"d{i}.text") if d in mixed else F.col(f"d{i}")).alias(d) for i, d in enumerate(dims)]
    result = grouped.select(*shown, *results)
    order = []
    known = {*dims, *(m.name for m in metrics)}
    for o in query.order_by:
        if o.field in known:
            order.append(named(o.field).desc_nulls_last() if o.desc else named(o.field).asc_nulls_first())
    order += [named(d).asc_nulls_first() for d in dims]
    return result.orderBy(*order) if order else result


def run_query(rows: DataFrame, query: Query) -> DataFrame:
    """A query over any DataFrame with a BIGINT ``timestamp`` in Unix seconds; columns outside the four kinds count as text."""
    query.validate()
    if TIMESTAMP not in rows.columns:
        raise ValueError("the rows have no timestamp column")
    wanted = [f for f in rows.schema if f.name in query.columns() | {TIMESTAMP}]
    kinds = schema_kinds(rows.schema)
    return plan([Part(rows.select(*[stored(named(f.name), f.dataType).alias(f.name) for f in wanted]), {f.name: kinds[f.name] for f in wanted})], query)
