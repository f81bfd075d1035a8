"""WARC (operator 5): archives with revisit records and a salvage reader.

Writing.  Payloads are told apart by SHA-256 and length on a narrow table; the page with the
smallest page_id of a large equal group is its response, the others become revisit records
that name it and carry no payload.  Each record becomes a gzip member of its own, and Spark's
text writer lays members end to end, so each part file is a WARC/1.1 archive on whatever store
the folder is in.  The writer ends every row with one byte; that byte is the last of the member,
the highest of its length, which is zero below 16 MiB (a longer record is followed by an empty
member, whose last byte it is).  Plain archives have CRLF there.  ``pack`` makes the same records
from plain values.

Reading.  ``salvage`` walks one archive.  A record is taken if its version line, headers,
length and end all check and its digest agrees; after a failed check the reader searches for
the next version line or gzip member header behind the failure that checks, recovers from
there, and reports the bytes between as a quarantined gap with the reason.  So damage within an
archive written here costs the records it lies in and no other.

Special cases: null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always
responses; of repeated rows (same page_id and payload) one is the response and the rest
revisit it; null page ids rank after all others and their records carry none; very long pages get
archives of few records; an empty table writes no record; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import cut, own_folder

MIN_REVISIT = 100
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives end after this many records, so that one is read whole within bounded memory.
RECORDS_PER_ARCHIVE = 1_000
#: Payload bytes of an archive of more than one record.
ARCHIVE_BYTES = 1 << 27

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile("[0-9]{1,18}")
_ID = re.compile("-?[0-9]{1,18}")
_MEMBER = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    offset: int
    end: int


class Gap(NamedTuple):
    """Quarantined bytes [offset, end) and what failed there."""

    offset: int
    end: int
    reason: str


def pack(headers: dict[str, str], payload: bytes, compressed: bool = False) -> bytes:
    """One record; its length is set here."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(payload)}", "", ""]
    record = CRLF.join(lines).encode() + payload + b"\r\n\r\n"
    return _member(record) if compressed else record


def _member(data: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as members that lack their last byte, which is zero."""
    for batch in batches:
        for a in range(0, batch.num_rows, 100):
            members = [_member(x.as_py()) for x in batch.column("record").slice(a, 100)]
            members = [m if m.endswith(b"\0") else m + _member(b"") for m in members]
            yield pa.record_batch({"value": pa.array([m[:-1] for m in members], pa.binary())})


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at ``at``: headers, payload, end.  ValueError says which check failed."""
    if not (line := _VERSION_LINE.match(data, at)):
        raise ValueError("no version line")
    headers, at = {}, line.end()
    while (stop := data.find(b"\r\n", at)) != at:
        if stop < 0:
            raise ValueError("headers without end")
        name, colon, value = data[at:stop].partition(b":")
        if not colon or not name:
            raise ValueError("malformed header")
        headers[name.decode("latin-1").lower()] = value.decode("utf-8", "replace").strip()
        at = stop + 2
    length = headers.get("content-length", "")
    if not _LENGTH.fullmatch(length):
        raise ValueError("no content length")
    if not _LENGTH.fullmatch(headers.get("warc-payload-length", "0")):
        raise ValueError("malformed payload length")
    start, end = stop + 2, stop + 2 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    payload = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("block digest differs")
    return headers, payload, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, as far as it can be read, where it ends, and what failed."""
    d, out, view = zlib.decompressobj(31), [], memoryview(data)
    step = 1 << 16
    while at < len(data):
        before = d.copy() if step > 1 else None
        try:
            out.append(d.decompress(view[at : at + step]))
        except zlib.error as e:
            if before is None:
                return b"".join(out), len(data), f"gzip: {e}"
            d, step = before, 1  # once more, byte by byte, for what comes before the failure
            continue
        at = min(at + step, len(data))
        if d.eof:
            return b"".join(out), at - len(d.unused_data), ""
    return b"".join(out), len(data), "gzip member without end"


@dataclass
class _Walk:
    """How far the records of some bytes have been read."""

    data: bytes
    at: int = 0
    out: list[Record | Gap] = field(default_factory=list)
    bad: int | None = None
    reason: str = ""
    member: tuple[bool, int, str] = (True, 0, "")

    def settle(self, found: list[Record | Gap], end: int, why: str) -> None:
        """Takes what was found at ``at``; a failure goes on at the next line or header that may begin a record."""
        if self.bad is not None and found:
            self.out.append(Gap(self.bad, self.at, self.reason))
            self.bad = None
        self.out += found
        if why:
            if self.bad is None:
                self.bad, self.reason = self.at, why
            end = self.next()
        self.at = end

    def next(self) -> int:
        """Where a record may begin behind ``at``."""
        later = _MEMBER.search(self.data, self.at + 1)
        return later.start() if later else len(self.data)

    def unwrapped(self, found: list[Record | Gap]) -> None:
        """Takes what the member at ``at`` holds."""
        empty, end, why = self.member
        end = self.next() if why else end
        found = [x._replace(offset=self.at, end=end) for x in found]
        if not any(isinstance(x, Record) for x in found):
            if not empty or why:  # an archive without records has none to lose
                found, why = [], why or "gzip member without a record"
        elif why:
            found = [x for x in found if isinstance(x, Record)]
        self.settle(found, end, why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of one archive in order; together they cover all its bytes.

    A member may hold one record, many, or members in turn, to any depth; its records carry the
    member's range.  A member that breaks off gives the records before the break, and a gap.
    """
    walks = [_Walk(data)]
    while True:
        w = walks[-1]
        if w.at < len(w.data) and w.data[w.at : w.at + 2] == b"\x1f\x8b":
            inner, end, why = _inflate(w.data, w.at)
            w.member = (not inner, end, why)
            walks.append(_Walk(inner))
        elif w.at < len(w.data):
            try:
                headers, payload, end = _plain(w.data, w.at)
                w.settle([Record(headers, payload, w.at, end)], end, "")
            except ValueError as e:
                w.settle([], w.at, str(e))
        else:
            if w.bad is not None:
                w.out.append(Gap(w.bad, len(w.data), w.reason))
            walks.pop()
            if walks:
                walks[-1].unwrapped(w.out)
        if len(walks) <= 1:
            yield from w.out if not walks else walks[0].out
            if not walks:
                return
            walks[0].out = []


def records(pages: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, the payload's length and the record's text, without its last line end, for every row."""
    html = F.coalesce("html", F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), key.alias("_id"), "url", html.alias("html"), F.sha2(html, 256).alias("_sha"), F.octet_length(html).cast("bigint").alias("_len"))
    large = cut(rows.filter(F.col("_len") >= MIN_REVISIT).select("page_id", "_id", "_sha", "_len"))
    first = large.groupBy("_sha", "_len").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Decisions are made on narrow rows; the payloads move once, keyed by page.
    decided = large.groupBy("page_id", "_id", "_sha", "_len").agg(F.count(F.lit(1)).alias("_same")).join(first, ["_sha", "_len"]).select("_id", "_sha", "_first")
    joined = rows.join(decided, ["_id", "_sha"], "left")
    # The length, which the digest settles, is named too, so that a filter on it gets below the window.
    copy = F.row_number().over(Window.partitionBy("_id", "_sha", "_len").orderBy(F.lit(0)))
    revisit = F.col("_first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("_first")) | (F.col("_copy") > 1))
    joined = joined.withColumn("_copy", copy).withColumn("_revisit", revisit)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    when = lambda value: F.when(F.col("_revisit"), value).otherwise(F.lit(""))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    block = F.when(F.col("_revisit"), F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Date", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("_id"), F.lit(":"), F.col("_copy"), F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_sha"))),
        line("WARC-Payload-Length", F.col("_len").cast("string")),
        when(line("WARC-Profile", F.lit(PROFILE))),
        when(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(":1>")))),
        F.when(F.col("_revisit"), F.lit("")).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("_sha")))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),
    )
    return joined.select("page_id", F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(F.col("_revisit"), F.col("_first")).alias("refers_to"), F.col("_len").alias("payload_bytes"), record.alias("record"))


def write(pages: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Archives of all rows below ``folder``, a gzip member for each record or none; every part file is one archive.

    Large pages go by their size into archives of fewer records, so that no archive of several
    records has more than ``ARCHIVE_BYTES`` of payload.
    """
    made = records(pages)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low, high, mode = -1, ARCHIVE_BYTES // RECORDS_PER_ARCHIVE, "overwrite"
    while low < largest:
        fit = made if mode == "overwrite" and high >= largest else made.filter(F.col("payload_bytes").between(low + 1, high))
        most = min(RECORDS_PER_ARCHIVE, max(1, ARCHIVE_BYTES // high))
        if compression == "gzip":
            members = fit.select(F.concat("record", F.lit(CRLF)).cast("binary").alias("record")).mapInArrow(_packed, "value binary")
            lines, last = members.select(F.col("value").cast("string").alias("value")), "\0"
        else:
            lines, last = fit.select("record"), CRLF
        lines.write.option("lineSep", last).option("maxRecordsPerFile", most).mode(mode).text(folder)
        low, high, mode = high, high * 4, "append"


def _page(uri: str) -> int | None:
    """The page id in <urn:page:ID:COPY>."""
    name = uri.strip("<>").split(":")[2:3]
    return int(name[0]) if name and _ID.fullmatch(name[0]) else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of the archives below ``folder``.

    A record has page_id, payload_bytes, payload_digest, record_type and refers_to; a gap has
    record_type null and its reason; both have archive, offset and end.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, `offset` bigint, `end` bigint, reason string"
    shape = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]
    )

    def row(x: Record | Gap, archive: str) -> dict:
        if isinstance(x, Gap):
            return {"archive": archive, "offset": x.offset, "end": x.end, "reason": x.reason}
        h = x.headers
        revisit = h.get("warc-type") == "revisit"
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(x.payload).hexdigest()
        length = int(h.get("warc-payload-length") or 0) if revisit else len(x.payload)
        return {
            "page_id": _page(h.get("warc-record-id", "")), "payload_bytes": length, "payload_digest": digest, "record_type": h.get("warc-type"),
            "refers_to": _page(h.get("warc-refers-to", "")) if revisit else None, "archive": archive, "offset": x.offset, "end": x.end,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                archive = path.as_py().rpartition("/")[2]
                rows = [row(x, archive) for x in salvage(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder and reads them back: one row per page, then any gaps."""
    folder = own_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
