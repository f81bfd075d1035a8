"""Time partitions: their names, and which can hold rows of a range."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Partitioner(Protocol):
    """Names the partition of a time, on the driver and as a column, and tells what to scan."""

    def of(self, seconds: int) -> str: ...

    def column(self, seconds: Column) -> Column: ...

    def overlaps(self, name: str, start: int, end: int) -> bool: ...


#: Aliases and the strftime formats they stand for.
ALIASES = {"": "%Y-%m", "month": "%Y-%m", "monthly": "%Y-%m", "year": "%Y", "yearly": "%Y", "annual": "%Y", "day": "%Y-%m-%d", "daily": "%Y-%m-%d"}
#: strftime parts and Spark's letters for them, coarse to fine.
_SPARK = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm"}
_STEPS = {"%d": timedelta(days=1), "%H": timedelta(hours=1), "%M": timedelta(minutes=1)}


@dataclass(frozen=True)
class FormatPartitioner:
    """Partitions in UTC by the finest part that the format names, from year to minute; any other
    characters but those that file names cannot hold stand for themselves."""

    format: str = "%Y-%m"

    def __post_init__(self) -> None:
        parts = re.findall("%.", self.format)
        if not parts or sorted(parts, key=[*_SPARK].index if {*parts} <= {*_SPARK} else str) != [*_SPARK][: len(parts)] or re.search(r"[/\\:*?\"<>|'=%\0-\x1f]", re.sub("%.", "", self.format)):
            raise ValueError(f"not a partition format: {self.format}")

    @property
    def finest(self) -> str:
        return max(re.findall("%.", self.format), key=[*_SPARK].index)

    def of(self, seconds: int) -> str:
        return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime(self.format)

    def column(self, seconds: Column) -> Column:
        pieces = re.split("(%.)", self.format)
        pattern = "".join(_SPARK.get(p) or (f"'{p}'" if re.search("[A-Za-z]", p) else p) for p in pieces)
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
        if self.finest not in ("%H", "%M"):
            return F.date_format(day, pattern)
        rest = F.pmod(seconds, F.lit(86400))
        none = F.lit(0)
        return F.date_format(day.cast("timestamp_ntz") + F.make_dt_interval(none, F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int")), pattern)

    def bounds(self, name: str) -> tuple[int, int] | None:
        """Unix seconds [from, to) of a partition; None for names in another format."""
        try:
            first = datetime.strptime(name, self.format).replace(tzinfo=UTC)
        except ValueError:
            return None
        if self.finest in _STEPS:
            after = first + _STEPS[self.finest]
        elif self.finest == "%m":
            after = (first + timedelta(days=32)).replace(day=1)
        else:
            after = first.replace(year=first.year + 1)
        return int(first.timestamp()), int(after.timestamp())

    def overlaps(self, name: str, start: int, end: int) -> bool:
        found = self.bounds(name)
        return found is None or (found[0] < end and start < found[1])


def partitioner(name: str = "") -> FormatPartitioner:
    """From an alias (day, month, year ...) or a strftime format of %Y, %m, %d, %H and %M, none left out before a finer one."""
    return FormatPartitioner(ALIASES.get(name, name))
