"""The store: datasets of time-partitioned Parquet with a manifest of column kinds.

Layout: ``<base>/<dataset>/<folder>/_partition=<name>/*.parquet`` and ``<base>/<dataset>/manifest.json``,
which holds for each partition its column kinds, its next row id and the folders that its rows
are in.  Every ingest and every compaction writes a new folder and then the manifest, which makes
it part of the dataset; what a crash leaves behind without that is no part of it, is overwritten
by the next folder of the same number, and a batch of a stream is in exactly if its number is.
Every row has ``timestamp`` (Unix seconds), its partition's ``_row_id``, which rises in the order
of arrival, and the sparse columns.  A column has one kind in a partition; partitions may differ.

A batch whose kinds do not fit is refused as a whole.  One driver writes to a
store at a time; a lock for each dataset's folder keeps its threads apart, whichever Store they use.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.kinds import SPARK_TYPES, Kind, cut_text, named, schema_kinds, stored, stored_value
from chronofold.operators.compaction import latest
from chronofold.plans.query import TIMESTAMP, Part, Query, Watch, plan, seconds
from chronofold.sources.files import Files
from chronofold.sources.partitioning import Partitioner, partitioner

PARTITION, ROW_ID = "_partition", "_row_id"
_LOCKS: dict[str, threading.RLock] = {}
DEFAULT_DATASET = "entities"
_DATASET = re.compile(r"[A-Za-z0-9_-]+")


@dataclass
class RowInput:
    timestamp: datetime | int | float
    values: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Placed:
    """Where a row went."""

    row_id: int
    partition: str


@dataclass
class Span:
    """A step that a store took: its name, dataset, seconds, and what it counted."""

    name: str
    dataset: str
    seconds: float = 0.0
    counts: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    """A query's rows with what it took to get them."""

    rows: list[Row]
    partitions: int
    pruned: int
    unmatched: int
    rows_in_range: int
    rows_matched: int
    seconds: float


@dataclass
class Explained:
    """Which partitions a query scans, and its plan."""

    total: int
    scanned: list[str]
    pruned: list[str]
    unmatched: list[str]
    result: DataFrame


class Store:
    def __init__(self, spark: SparkSession, base: str, partitions: Partitioner | str = "", watch: Callable[[Span], None] | None = None) -> None:
        """``watch`` is told of every ingest, profiled query and compaction once it is done."""
        if partitions is None:
            raise ValueError("a store needs a partitioner")
        self.spark, self.base = spark, base.rstrip("/")
        self.partitioner = partitioner(partitions) if isinstance(partitions, str) else partitions
        self.files = Files(spark, base)
        self._watch = watch

    def _lock(self, dataset: str) -> threading.RLock:
        return _LOCKS.setdefault(self.folder(dataset), threading.RLock())

    @contextmanager
    def _span(self, name: str, dataset: str) -> Iterator[Span]:
        span, began = Span(name, dataset or DEFAULT_DATASET), time.perf_counter()
        try:
            yield span
        except Exception as e:
            span.counts["error"] = type(e).__name__
            raise
        finally:
            span.seconds = time.perf_counter() - began
            if self._watch is not None:
                self._watch(span)

    # -- layout ---------------------------------------------------------------------------

    def folder(self, dataset: str) -> str:
        name = dataset or DEFAULT_DATASET
        if not _DATASET.fullmatch(name):
            raise ValueError(f"invalid dataset name {dataset!r}")
        return f"{self.base}/{name}"

    def _paths(self, dataset: str, partition: str, entry: Mapping[str, Any]) -> list[str]:
        return [f"{self.folder(dataset)}/{f}/{PARTITION}={partition}" for f in entry["folders"]]

    def manifest(self, dataset: str) -> dict[str, Any]:
        name = f"{self.folder(dataset)}/manifest.json"
        return json.loads(self.files.read(name)) if self.files.written(name) else {"partitions": {}, "batches": {}, "folders": 0}

    def partitions(self, dataset: str) -> list[str]:
        return sorted(n for n, entry in self.manifest(dataset)["partitions"].items() if entry["folders"])

    def _record(self, dataset: str, manifest: dict[str, Any]) -> None:
        self.files.write(f"{self.folder(dataset)}/manifest.json", json.dumps(manifest, sort_keys=True))

    def _new_folder(self, dataset: str, manifest: dict[str, Any]) -> str:
        """The next folder's name.  One of that number that a crash left goes."""
        name = f"{manifest['folders']:08d}"
        manifest["folders"] += 1
        self.files.delete(f"{self.folder(dataset)}/{name}")
        return name

    def kinds(self, dataset: str, partition: str) -> dict[str, Kind]:
        entry = self.manifest(dataset)["partitions"].get(partition, {})
        return {c: Kind(k) for c, k in entry.get("kinds", {}).items()}

    def rows(self, dataset: str, partition: str) -> DataFrame:
        """One partition's rows with the columns of its manifest."""
        entry = self.manifest(dataset)["partitions"].get(partition, {"kinds": {}, "folders": []})
        return self._scan(dataset, {partition: entry}).drop(PARTITION)

    def _scan(self, dataset: str, entries: Mapping[str, dict[str, Any]]) -> DataFrame:
        """All rows of partitions; those that agree on the kinds of all columns share one scan."""
        fields = [T.StructField(TIMESTAMP, T.LongType()), T.StructField(ROW_ID, T.LongType())]
        last = [T.StructField(PARTITION, T.StringType())]
        groups: dict[tuple, list[str]] = {}
        for name, entry in sorted(entries.items()):
            groups.setdefault(tuple(sorted(entry["kinds"].items())), []).extend(self._paths(dataset, name, entry))
        scans = []
        for kinds, paths in groups.items():
            schema = T.StructType(fields + [T.StructField(c, SPARK_TYPES[Kind(k)]) for c, k in kinds] + last)
            # Each folder is a table of its own with partitions in it.
            for folder in sorted({p.rpartition("/")[0] for p in paths}):
                own = [p for p in paths if p.rpartition("/")[0] == folder]
                scans.append(self.spark.read.schema(schema).option("basePath", folder).parquet(*own))
        if not scans:
            return self.spark.createDataFrame([], T.StructType(fields + last))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)

    # -- ingest ---------------------------------------------------------------------------

    @staticmethod
    def _fit(entry: dict[str, Any], kinds: Mapping[str, Kind], partition: str) -> None:
        known = entry.setdefault("kinds", {})
        for column, kind in kinds.items():
            if not column or "/" in column or "\0" in column or column in (ROW_ID, PARTITION):
                raise ValueError(f"invalid column name {column!r}")
            if known.setdefault(column, kind.value) != kind.value:
                raise TypeError(f"column {column} holds {known[column]} in {partition}, not {kind.value}")

    def ingest_row(self, dataset: str, row: RowInput) -> Placed:
        return self.ingest_batch(dataset, [row])[0]

    def ingest_batch(self, dataset: str, rows: Sequence[RowInput]) -> list[Placed]:
        """Appends rows in order; ids are dense from 0 in each partition.  A bad row leaves nothing written."""
        self.folder(dataset)
        with self._span("ingest", dataset) as span:
            placed = self._ingest_batch(dataset, rows)
            span.counts |= {"rows": len(placed), "partitions": len({p.partition for p in placed})}
            return placed

    def _ingest_batch(self, dataset: str, rows: Sequence[RowInput]) -> list[Placed]:
        if any(r is None for r in rows):
            raise ValueError("missing row")
        if not rows:
            return []
        with self._lock(dataset):
            manifest = self.manifest(dataset)
            placed: list[Placed] = []
            ready: dict[str, list[dict[str, Any]]] = {}
            for r in rows:
                at = int(seconds(r.timestamp) // 1)
                name = self.partitioner.of(at)
                entry = manifest["partitions"].setdefault(name, {"next": 0, "kinds": {}, "folders": []})
                values = {c: stored_value(v) for c, v in r.values.items() if v is not None and c != TIMESTAMP}
                self._fit(entry, {c: k for c, (k, _) in values.items()}, name)
                placed.append(Placed(entry["next"], name))
                ready.setdefault(name, []).append({TIMESTAMP: at, ROW_ID: entry["next"]} | {c: v for c, (_, v) in values.items()})
                entry["next"] += 1
            folder = self._new_folder(dataset, manifest)
            for name in sorted(ready):
                entry = manifest["partitions"][name]
                self._append(f"{self.folder(dataset)}/{folder}/{PARTITION}={name}", ready[name], entry["kinds"])
                entry["folders"].append(folder)
            self._record(dataset, manifest)
            return placed

    def _append(self, path: str, rows: list[dict[str, Any]], known: Mapping[str, str]) -> None:
        columns = sorted({c for r in rows for c in r} - {TIMESTAMP, ROW_ID})
        fields = [T.StructField(TIMESTAMP, T.LongType()), T.StructField(ROW_ID, T.LongType())]
        schema = T.StructType(fields + [T.StructField(c, SPARK_TYPES[Kind(known[c])]) for c in columns])
        made = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        made.coalesce(1).write.parquet(path)

    def ingest_df(self, dataset: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Appends a DataFrame with a ``timestamp`` (Unix seconds or a timestamp) without a shuffle.

        Ids rise with the order of the DataFrame's partitions and rows and may leave gaps.  ``batch``
        names a stream and its batch number; a batch already taken in is skipped.
        """
        if TIMESTAMP not in rows.columns:
            raise ValueError("the rows have no timestamp column")
        with self._lock(dataset), self._span("ingest", dataset) as span:
            manifest = self.manifest(dataset)
            if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return
            kinds = {c: k for c, k in schema_kinds(rows.schema).items() if c not in (TIMESTAMP, ROW_ID, PARTITION)}
            kind = rows.schema[TIMESTAMP].dataType
            when = named(TIMESTAMP)
            if isinstance(kind, T.TimestampNTZType):  # wall clocks are in UTC
                when = F.convert_timezone(F.lit("UTC"), F.current_timezone(), when).cast("timestamp")
            if isinstance(kind, T.TimestampNTZType | T.TimestampType):
                when = F.unix_seconds(when)
            at = F.floor(when).cast("bigint")
            fit = lambda c: stored(named(c), rows.schema[c].dataType)
            narrow = rows.select(at.alias(TIMESTAMP), *[(cut_text(fit(c)) if k is Kind.STRING else fit(c)).alias(c) for c, k in kinds.items()])
            narrow = narrow.withColumn(PARTITION, self.partitioner.column(F.col(TIMESTAMP)))
            base = max((entry["next"] for entry in manifest["partitions"].values()), default=0)
            made = narrow.withColumn(ROW_ID, F.lit(base) + F.monotonically_increasing_id())
            seen = Observation()
            made = made.observe(seen, F.max(ROW_ID).alias("last"), F.count(F.lit(1)).alias("rows"))
            folder = self._new_folder(dataset, manifest)
            path = f"{self.folder(dataset)}/{folder}"
            # Rows are read once; that they fit is checked on what was written, before the manifest names it.
            made.write.partitionBy(PARTITION).parquet(path)
            try:
                touched = [n.removeprefix(f"{PARTITION}=") for n in self.files.folders(path) if n.startswith(f"{PARTITION}=")]
                if "__HIVE_DEFAULT_PARTITION__" in touched:
                    raise ValueError("a row has no timestamp")
                for name in touched:
                    entry = manifest["partitions"].setdefault(name, {"next": 0, "kinds": {}, "folders": []})
                    self._fit(entry, kinds, name)
                    entry["folders"].append(folder)
                    entry["next"] = seen.get["last"] + 1
            except Exception:
                self.files.delete(path)
                raise
            if batch is not None:
                manifest["batches"][batch[0]] = batch[1]
            if touched or batch is not None:
                self._record(dataset, manifest)
            span.counts |= {"rows": seen.get["rows"], "partitions": len(touched)}

    # -- query ----------------------------------------------------------------------------

    def _parts(self, query: Query) -> tuple[list[str], list[str], list[str], list[Part]]:
        start, end = query.bounds()
        manifest = {n: entry for n, entry in self.manifest(query.dataset)["partitions"].items() if entry["folders"]}
        names = sorted(manifest)
        pruned = [n for n in names if not self.partitioner.overlaps(n, start, end)]
        wanted = query.columns()
        groups: dict[tuple, list[str]] = {}
        unmatched = []
        for n in names:
            if n in pruned:
                continue
            kinds = {c: Kind(k) for c, k in manifest[n]["kinds"].items() if c in wanted}
            if query.filter is not None and not query.filter.can_match({**kinds, TIMESTAMP: Kind.INT}):
                unmatched.append(n)
                continue
            groups.setdefault(tuple(sorted(kinds.items())), []).append(n)
        # One scan for all partitions that agree on the columns read.
        parts = []
        for kinds, members in groups.items():
            schema = T.StructType([T.StructField(TIMESTAMP, T.LongType()), *[T.StructField(c, SPARK_TYPES[k]) for c, k in kinds]])
            parts.append(Part(self.spark.read.schema(schema).parquet(*[p for n in members for p in self._paths(query.dataset, n, manifest[n])]), dict(kinds)))
        return names, pruned, unmatched, parts

    def _empty(self) -> Part:
        return Part(self.spark.createDataFrame([], T.StructType([T.StructField(TIMESTAMP, T.LongType())])), {})

    def query(self, query: Query) -> DataFrame:
        """The result as a lazy DataFrame: dimensions, then metrics, in the order asked for."""
        query.validate()
        return plan(self._parts(query)[3] or [self._empty()], query)

    def explain(self, query: Query) -> Explained:
        query.validate()
        names, pruned, unmatched, parts = self._parts(query)
        scanned = [n for n in names if n not in pruned and n not in unmatched]
        return Explained(len(names), scanned, pruned, unmatched, plan(parts or [self._empty()], query))

    def profile(self, query: Query) -> Profile:
        """Runs a query and counts partitions and rows on the way."""
        began = time.perf_counter()
        query.validate()
        names, pruned, unmatched, parts = self._parts(query)
        reach, matched = Watch(), Watch()
        with self._span("query", query.dataset) as span:
            rows = plan(parts or [self._empty()], query, (reach, matched)).collect()
            span.counts |= {"rows": len(rows), "partitions": len(names) - len(pruned) - len(unmatched), "pruned": len(pruned), "unmatched": len(unmatched)}
        return Profile(rows, len(names), len(pruned), len(unmatched), sum(reach.counts()), sum(matched.counts()), time.perf_counter() - began)

    # -- compaction -----------------------------------------------------------------------

    def compact_partition(self, dataset: str, partition: str, key: str) -> None:
        """Keeps the last row of every key by arrival; rows without the key go.  The new rows replace the old at once."""
        if not key:
            raise ValueError("compaction needs a key column")
        with self._lock(dataset), self._span("compact", dataset) as span:
            manifest = self.manifest(dataset)
            entry = manifest["partitions"].get(partition)
            if entry is None or not entry["folders"]:
                return
            if key != TIMESTAMP and key not in entry["kinds"]:
                raise KeyError(f"key column {key} not found in {partition}")
            rows = self.rows(dataset, partition)
            if rows.filter(named(key).isNotNull()).isEmpty():
                return
            folder = self._new_folder(dataset, manifest)
            path = f"{self.folder(dataset)}/{folder}/{PARTITION}={partition}"
            seen = Observation()
            latest(rows, [key], ROW_ID).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            old, entry["folders"] = self._paths(dataset, partition, entry), [folder]
            self._record(dataset, manifest)
            for gone in old:
                self.files.delete(gone)
            span.counts |= {"partition": partition, "rows": seen.get["rows"]}

    def compact_dataset(self, dataset: str, key: str, include_active: bool = False) -> None:
        """Compacts partitions in order of name; the last one, which still grows, only on request."""
        if not key:
            raise ValueError("compaction needs a key column")
        names = self.partitions(dataset)
        for name in names if include_active else names[:-1]:
            self.compact_partition(dataset, name, key)

    def read(self, dataset: str) -> DataFrame:
        """All rows of a dataset whose partitions agree on kinds, with ``_partition`` and ``_row_id``; none if it is missing."""
        return self._scan(dataset, {n: entry for n, entry in self.manifest(dataset)["partitions"].items() if entry["folders"]})
