"""The filter tree.  Each node turns into a column that is never null, given the kinds of the columns it reads."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.kinds import Kind, fit_literal, is_nan, named, typed

Kinds = Mapping[str, Kind]


class Filter:
    """A node: what it reads, whether it is well formed, whether it can match under given kinds, and its column."""

    def columns(self) -> set[str]:
        raise NotImplementedError

    def validate(self) -> None:
        raise NotImplementedError

    def can_match(self, kinds: Kinds) -> bool:
        raise NotImplementedError

    def to_column(self, kinds: Kinds) -> Column:
        raise NotImplementedError

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)


def _named(column: str) -> None:
    if not column:
        raise ValueError("a filter needs a column name")


@dataclass(frozen=True)
class Eq(Filter):
    column: str
    value: Any

    def columns(self) -> set[str]:
        return {self.column}

    def validate(self) -> None:
        _named(self.column)
        if self.value is None:
            raise ValueError(f"no value to compare {self.column} with")

    def can_match(self, kinds: Kinds) -> bool:
        return self.column in kinds and fit_literal(self.value, kinds[self.column]) is not None

    def to_column(self, kinds: Kinds) -> Column:
        if not self.can_match(kinds):
            return F.lit(False)
        value = fit_literal(self.value, kinds[self.column])
        if is_nan(value):
            return F.lit(False)
        return F.coalesce(named(self.column) == typed(value, kinds[self.column]), F.lit(False))

    def __str__(self) -> str:
        return f"(Eq {self.column} {self.value})"


@dataclass(frozen=True)
class Exists(Filter):
    column: str

    def columns(self) -> set[str]:
        return {self.column}

    def validate(self) -> None:
        _named(self.column)

    def can_match(self, kinds: Kinds) -> bool:
        return self.column in kinds

    def to_column(self, kinds: Kinds) -> Column:
        return named(self.column).isNotNull() if self.column in kinds else F.lit(False)

    def __str__(self) -> str:
        return f"(Exists {self.column})"


@dataclass(frozen=True)
class NotExists(Exists):
    def can_match(self, kinds: Kinds) -> bool:
        return True

    def to_column(self, kinds: Kinds) -> Column:
        return named(self.column).isNull() if self.column in kinds else F.lit(True)

    def __str__(self) -> str:
        return f"(NotExists {self.column})"


class _Members(Filter):
    column: str
    values: tuple[Any, ...]

    def __init__(self, column: str, *values: Any) -> None:
        self.column, self.values = column, values

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and (self.column, self.values) == (other.column, other.values)

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.column, self.values))

    def columns(self) -> set[str]:
        return {self.column}

    def validate(self) -> None:
        _named(self.column)
        if any(v is None for v in self.values):
            raise ValueError(f"no value may be missing in the list for {self.column}")

    def fitting(self, kinds: Kinds) -> list[Column]:
        """The values that fit the column's kind; the rest can match nothing."""
        if self.column not in kinds:
            return []
        kind = kinds[self.column]
        found = [x for v in self.values if (x := fit_literal(v, kind)) is not None and not is_nan(x)]
        return [typed(x, kind) for x in dict.fromkeys(found)]

    def __str__(self) -> str:
        return f"({type(self).__name__} {self.column} {' '.join(map(str, self.values))})"


class In(_Members):
    def can_match(self, kinds: Kinds) -> bool:
        return bool(self.fitting(kinds))

    def to_column(self, kinds: Kinds) -> Column:
        found = self.fitting(kinds)
        return F.coalesce(named(self.column).isin(*found), F.lit(False)) if found else F.lit(False)


class NotIn(_Members):
    """A missing value is in no list, so it passes."""

    def can_match(self, kinds: Kinds) -> bool:
        return True

    def to_column(self, kinds: Kinds) -> Column:
        found = self.fitting(kinds)
        return ~F.coalesce(named(self.column).isin(*found), F.lit(False)) if found else F.lit(True)


@dataclass(frozen=True)
class _Compare(Filter):
    column: str
    value: int | float | str

    def columns(self) -> set[str]:
        return {self.column}

    def validate(self) -> None:
        _named(self.column)
        if isinstance(self.value, bool) or not isinstance(self.value, int | float | str):
            raise ValueError(f"{self.column} can be compared with a number or a text only")

    def can_match(self, kinds: Kinds) -> bool:
        return self.column in kinds and kinds[self.column] is not Kind.BOOL and fit_literal(self.value, kinds[self.column]) is not None

    def to_column(self, kinds: Kinds) -> Column:
        if not self.can_match(kinds):
            return F.lit(False)
        kind = kinds[self.column]
        value, column = fit_literal(self.value, kind), named(self.column)
        if is_nan(value):
            return F.lit(False)
        holds = _SIGNS[type(self)](column, typed(value, kind))
        # NaN is above every number to Spark; here it compares with nothing.
        holds = holds & ~F.isnan(column) if kind is Kind.FLOAT and isinstance(self, Gt | Gte) else holds
        return F.coalesce(holds, F.lit(False))

    def __str__(self) -> str:
        return f"({type(self).__name__} {self.column} {self.value})"


class Lt(_Compare):
    pass


class Lte(_Compare):
    pass


class Gt(_Compare):
    pass


class Gte(_Compare):
    pass


_SIGNS = {Lt: operator.lt, Lte: operator.le, Gt: operator.gt, Gte: operator.ge}


class _Group(Filter):
    def __init__(self, *parts: Filter) -> None:
        self.parts = parts

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.parts == other.parts

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.parts))

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def validate(self) -> None:
        if not self.parts:
            raise ValueError(f"{type(self).__name__} needs at least one part")
        for p in self.parts:
            if p is None:
                raise ValueError(f"{type(self).__name__} has an empty part")
            p.validate()

    def __str__(self) -> str:
        return f"({type(self).__name__} {' '.join(map(str, self.parts))})"


class And(_Group):
    def can_match(self, kinds: Kinds) -> bool:
        return all(p.can_match(kinds) for p in self.parts)

    def to_column(self, kinds: Kinds) -> Column:
        return reduce(operator.and_, (p.to_column(kinds) for p in self.parts)) if self.can_match(kinds) else F.lit(False)


class Or(_Group):
    def can_match(self, kinds: Kinds) -> bool:
        return any(p.can_match(kinds) for p in self.parts)

    def to_column(self, kinds: Kinds) -> Column:
        return reduce(operator.or_, (p.to_column(kinds) for p in self.parts if p.can_match(kinds)), F.lit(False))


def matches(node: Filter, row: Mapping[str, Any]) -> bool:
    """Whether one row of Python values passes; kinds are those of the values, without any conversion."""
    if isinstance(node, And):
        return all(matches(p, row) for p in node.parts)
    if isinstance(node, Or):
        return any(matches(p, row) for p in node.parts)
    value = row.get(node.column)
    if isinstance(node, NotExists):
        return value is None
    if isinstance(node, Exists):
        return value is not None
    if isinstance(node, _Members):
        inside = value is not None and any(type(v) is type(value) and v == value for v in node.values)
        return inside is isinstance(node, In)
    if value is None or type(value) is not type(node.value):
        return False
    return value == node.value if isinstance(node, Eq) else _SIGNS[type(node)](value, node.value)
