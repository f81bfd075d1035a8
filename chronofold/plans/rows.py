"""Reading result rows as Python values."""

from __future__ import annotations

from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Row

#: What a value that is no time reads as.
ZERO_TIME = datetime(1, 1, 1, tzinfo=UTC)


def as_time(row: Row, name: str) -> datetime:
    """A field as a time in UTC: times, Unix seconds, RFC 3339 texts and dates; anything else is the zero time."""
    value = row.asDict().get(name)
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day, tzinfo=UTC)
    if isinstance(value, int | float) and not isinstance(value, bool):
        try:
            return datetime.fromtimestamp(value, UTC)
        except (ValueError, OverflowError, OSError):
            return ZERO_TIME
    try:
        found = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return ZERO_TIME
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def as_int(row: Row, name: str) -> int:
    value = row.asDict().get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) else 0


def as_float(row: Row, name: str) -> float:
    """A float field; integers count too."""
    value = row.asDict().get(name)
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else 0.0


def as_text(row: Row, name: str) -> str:
    value = row.asDict().get(name)
    return value if isinstance(value, str) else ""


def as_bool(row: Row, name: str) -> bool:
    return row.asDict().get(name) is True


def is_null(row: Row, name: str) -> bool:
    return name in row.asDict() and row[name] is None


def to_json(row: Row) -> dict[str, Any]:
    """A row as JSON values; times in RFC 3339."""
    return {k: (v if v.tzinfo else v.replace(tzinfo=UTC)).isoformat() if isinstance(v, datetime) else v for k, v in row.asDict().items()}


def cell(value: Any) -> str:
    """A table cell: whole floats without a point, others with two digits."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.0f}" if value.is_integer() else f"{value:.2f}"
    return value.isoformat() if isinstance(value, datetime) else str(value)
