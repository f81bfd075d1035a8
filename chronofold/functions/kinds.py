"""The four value kinds, how literals fit them, and how values turn into numbers."""

from __future__ import annotations

import json
import math
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
MAX_STRING_BYTES = 1 << 20


class Kind(str, Enum):
    INT = "int64"
    FLOAT = "float64"
    BOOL = "bool"
    STRING = "string"


SPARK_TYPES: dict[Kind, T.DataType] = {Kind.INT: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.BOOL: T.BooleanType(), Kind.STRING: T.StringType()}


def kind_of_type(kind: T.DataType) -> Kind | None:
    """The kind a Spark column is stored as; None for types that are stored as JSON text."""
    if isinstance(kind, T.IntegralType):
        return Kind.INT
    if isinstance(kind, T.FractionalType):
        return Kind.FLOAT
    if isinstance(kind, T.BooleanType):
        return Kind.BOOL
    return Kind.STRING if isinstance(kind, T.StringType) else None


def schema_kinds(schema: T.StructType) -> dict[str, Kind]:
    return {f.name: kind_of_type(f.dataType) or Kind.STRING for f in schema}


def stored(column: Column, kind: T.DataType) -> Column:
    """A column as it is stored: widened to its kind, anything outside the four kinds as JSON text."""
    found = kind_of_type(kind)
    if found is not None:
        return column.cast(SPARK_TYPES[found])
    return F.to_json(column) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else column.cast("string")


def cut_text(column: Column) -> Column:
    """A text column with long texts cut to ``MAX_STRING_BYTES`` of UTF-8, between characters."""
    raw, most = column.cast("binary"), MAX_STRING_BYTES
    within = lambda k: F.substring(F.hex(F.substring(raw, k + 1, 1)), 1, 1).isin("8", "9", "A", "B")
    end = F.when(~within(most), most).when(~within(most - 1), most - 1).when(~within(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(column) > most, F.substring(raw, F.lit(1), end).cast("string")).otherwise(column)


def stored_value(value: Any) -> tuple[Kind, Any]:
    """A Python value as it is stored, with its kind."""
    if isinstance(value, bool):
        return Kind.BOOL, value
    if isinstance(value, int):
        if not INT64_MIN <= value <= INT64_MAX:
            raise ValueError(f"integer out of range: {value}")
        return Kind.INT, value
    if isinstance(value, float):
        return Kind.FLOAT, value
    text = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    raw = text.encode("utf-8", "replace")
    return Kind.STRING, text if len(raw) <= MAX_STRING_BYTES else raw[:MAX_STRING_BYTES].decode("utf-8", "ignore")


def fit_literal(value: Any, kind: Kind) -> Any | None:
    """The literal as a value of ``kind``, or None where it can match nothing there.  No text is ever read as a number."""
    if isinstance(value, bool):
        return value if kind is Kind.BOOL else None
    if isinstance(value, int):
        if kind is Kind.INT:
            return value if INT64_MIN <= value <= INT64_MAX else None
        return float(value) if kind is Kind.FLOAT else None
    if isinstance(value, float):
        if kind is Kind.INT:
            return int(value) if value.is_integer() and INT64_MIN <= value <= INT64_MAX else None
        return value if kind is Kind.FLOAT else None
    return value if isinstance(value, str) and kind is Kind.STRING else None


def is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)


def typed(value: Any, kind: Kind) -> Column:
    return F.lit(value).cast(SPARK_TYPES[kind])


#: Decimal text, without the spaces, suffixes and names that a cast would also take.
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def numeric(column: Column, kind: Kind) -> Column:
    """A column as a number: integers stay, booleans are 1 or 0, empty text is 0, other text is parsed or skipped."""
    if kind in (Kind.INT, Kind.FLOAT):
        return column
    if kind is Kind.BOOL:
        return column.cast("int").cast("double")
    parsed = F.when(column.rlike(_DECIMAL), column.try_cast("double"))
    return F.when(column == "", F.lit(0.0)).when(F.abs(parsed) < math.inf, parsed)


def named(column: str) -> Column:
    """A flat column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")
