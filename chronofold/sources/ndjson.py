"""Newline-delimited JSON: one object a line, nested objects and arrays flattened to dotted names."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.kinds import INT64_MAX, INT64_MIN, SPARK_TYPES, Kind, named, stored_value
from chronofold.sources.store import RowInput, Store

TIMESTAMP = "timestamp"
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def parse_time(value: Any) -> int:
    """Unix seconds of an RFC 3339 time, a date, or a number of seconds, cut off at the point."""
    if isinstance(value, bool) or value is None:
        raise ValueError("timestamp must be a text or a number")
    if isinstance(value, int | float):
        return int(value)
    if isinstance(value, str):
        text = value.strip()
        if _DAY.fullmatch(text):
            return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())
        found = datetime.fromisoformat(text)
        if found.tzinfo is None:
            raise ValueError(f"time without zone: {value}")
        return int(found.timestamp() // 1)
    raise ValueError("timestamp must be a text or a number")


def _number(text: str) -> int | float:
    """An integer if it is written as one and fits 64 bits, else a float."""
    n = int(text)
    return n if INT64_MIN <= n <= INT64_MAX else float(n)


def flatten(value: Any, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted name, scalar) pairs; nulls and empty objects and arrays give none."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{prefix}.{i}" if prefix else str(i))
    elif value is not None:
        yield prefix, value


def parse_line(line: str) -> RowInput:
    found = json.loads(line, parse_int=_number)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    if TIMESTAMP not in found:
        raise ValueError("no timestamp")
    at = parse_time(found.pop(TIMESTAMP))
    return RowInput(at, dict(flatten(found)))


def ingest_lines(store: Store, dataset: str, lines: Iterable[str], batch_size: int = 1000) -> int:
    """Appends lines in batches; blank lines are skipped and not counted.  Batches before a bad line stay."""
    if batch_size < 1:
        raise ValueError("batch size must be positive")
    batch: list[RowInput] = []
    done = 0
    for line in lines:
        if not line.strip():
            continue
        done += 1
        try:
            batch.append(parse_line(line))
        except (ValueError, TypeError) as e:
            raise ValueError(f"line {done}: {e}") from e
        if len(batch) == batch_size:
            store.ingest_batch(dataset, batch)
            batch = []
    store.ingest_batch(dataset, batch)
    return done


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, names, kinds, texts = [], [], [], []
        for value in batch.column("value"):
            line = value.as_py()
            if not line.strip():
                continue
            row = parse_line(line)
            found = {c: stored_value(v) for c, v in row.values.items()}
            at.append(row.timestamp)
            names.append(list(found))
            kinds.append([k.value for k, _ in found.values()])
            texts.append([str(v).lower() if k is Kind.BOOL else repr(v) if k is Kind.FLOAT else str(v) for k, v in found.values()])
        strings = pa.list_(pa.string())
        yield pa.record_batch({TIMESTAMP: pa.array(at, pa.int64()), "names": pa.array(names, strings), "kinds": pa.array(kinds, strings), "texts": pa.array(texts, strings)})


def ingest_files(spark: SparkSession, store: Store, dataset: str, path: str) -> None:
    """Appends files of any size, parsed on the executors.

    Lines are parsed once, into a folder beside the store's datasets that goes at the end.  A first pass over that finds the kinds of every column in every partition, on the driver no more than
    partitions x columns x kinds; two kinds in one partition are an error before anything is written.
    """
    lines = spark.read.text(path).mapInArrow(_parsed, f"{TIMESTAMP} bigint, names array<string>, kinds array<string>, texts array<string>")
    lines = lines.withColumn("_partition", store.partitioner.column(F.col(TIMESTAMP)))
    parsed = f"{store.base}/.parsed-{uuid.uuid4().hex}"
    try:
        lines.write.parquet(parsed)
        _ingest_parsed(spark.read.schema(lines.schema).parquet(parsed), store, dataset)
    finally:
        store.files.delete(parsed)


def _ingest_parsed(lines: DataFrame, store: Store, dataset: str) -> None:
    pairs = lines.select("_partition", F.explode(F.arrays_zip("names", "kinds")).alias("x")).select("_partition", "x.names", "x.kinds").distinct().collect()
    by_partition: dict[str, dict[str, Kind]] = {}
    for partition, column, kind in sorted(pairs):
        if by_partition.setdefault(partition, {}).setdefault(column, Kind(kind)) is not Kind(kind):
            raise TypeError(f"column {column} has two kinds in {partition}")
    # Partitions that agree on every column they share go in together.
    groups: list[tuple[dict[str, Kind], list[str]]] = []
    for partition, kinds in sorted(by_partition.items()):
        for known, members in groups:
            if all(known.get(c, k) is k for c, k in kinds.items()):
                known.update(kinds)
                members.append(partition)
                break
        else:
            groups.append((dict(kinds), [partition]))
    if not groups and not lines.isEmpty():
        groups = [({}, [r[0] for r in lines.select("_partition").distinct().collect()])]
    for kinds, members in groups:
        values = F.map_from_arrays("names", "texts")
        typed = [F.try_element_at(values, F.lit(c)).cast(SPARK_TYPES[k]).alias(c) for c, k in sorted(kinds.items())]
        store.ingest_df(dataset, lines.filter(F.col("_partition").isin(members)).select(named(TIMESTAMP), *typed))
