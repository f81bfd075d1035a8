"""Secret scans (operator 9): a recursive decoding worklist.

A text is the first layer.  Each layer is scanned with the rules; then every encoded run
in it (percent escapes, backslash-u escapes, base64, and zlib or gzip under base64) is
unwrapped into a further layer, which goes on the worklist.  Base64 is decoded from each of four
neighbouring places, since what stands right before a payload shifts it, and over line ends.  A
layer already seen, told by its content, is not entered again, so a cycle ends; the worklist ends
when nothing new comes out.  Every layer carries, for each of its characters, the range of the original text it
came from, so a finding in any layer becomes a span of the original text.

Findings of the first layer are the base spans and always stay.  Findings below add spans
of the same kinds; one that lies on a base span of its kind adds nothing.

What a compressed run unwraps to, all its gzip members, is scanned in windows as it is inflated,
however much it is; memory holds a window, which grows only while one run of printable characters
fills it.  Bytes that are not UTF-8 are replaced.

Special cases: null text counts as empty and has no spans; each input row gives one row, repeated
and null ids too, and an empty table none; columns other than doc_id and text are ignored whatever
their names; a very long text is one layer, for which nothing but the text is kept, while layers
below keep a range for each of their characters, eight bytes.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.llm.common import text_of

#: Characters of a window of unwrapped text at least, and bytes inflated at once.
WINDOW = 1 << 20
PART = 1 << 16

# Kinds in their order and their proposal patterns.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OCTETS = r"(?:%[0-9A-Fa-f]{2})+"
ESCAPE = r"\\u([0-9A-Fa-f]{4})"
BASE64 = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Lines of such a run, the last of any length.
WRAPPED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)?+={0,2}"
#: How a gzip member or a zlib stream begins.
PACKED = b"|".join([rb"\x1f\x8b\x08", *(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0)])
#: The least a finding takes: token=abcdef.
SHORTEST = 12

Span = tuple[int, int, int]


class Places(NamedTuple):
    """For each character of a layer the range it comes from; starts and ends never fall from one to the next."""

    starts: np.ndarray
    ends: np.ndarray

    def under(self, inner: Places) -> Places:
        """The ranges of a layer whose own are given in this one's characters."""
        return Places(self.starts[inner.starts], self.ends[inner.ends - 1])


class Inflated:
    """What a gzip or zlib stream holds, in parts, with the members behind it; bytes before damage count."""

    def __init__(self, raw: memoryview) -> None:
        self.raw, self.parts = raw, self._inflate()
        self.taken, self.first = 2, b""

    def sound(self) -> bool:
        """Whether the first stream is whole and its checksum agrees."""
        d = zlib.decompressobj(47)
        try:
            for at in range(0, len(self.raw), PART):
                data = self.raw[at : at + PART]
                while data and not d.eof:
                    d.decompress(data, PART)
                    data = d.unconsumed_tail
                if d.eof:
                    return True
        except zlib.error:
            pass
        return False

    def ready(self) -> bool:
        """Whether anything comes out; reads the first part."""
        self.first = next(self.parts, b"")
        return bool(self.first)

    def __iter__(self) -> Iterator[bytes]:
        yield self.first
        yield from self.parts

    def _inflate(self) -> Iterator[bytes]:
        at = 0
        while at < len(self.raw):
            d = zlib.decompressobj(47)
            while not d.eof and at < len(self.raw):
                data = self.raw[at : at + PART]
                at += len(data)
                while True:
                    try:
                        out = d.decompress(data, PART)
                    except zlib.error:
                        return
                    self.taken = at
                    if out:
                        yield out
                    data = d.unconsumed_tail
                    if d.eof or not (data or len(out) == PART):
                        break
            at -= len(d.unused_data)
            self.taken = at
            if not d.eof:
                return


class Rules:
    """Compiled patterns; made once a task."""

    def __init__(self) -> None:
        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
        self.octets, self.escape, self.base64 = re.compile(OCTETS), re.compile(ESCAPE), re.compile(BASE64)
        self.wrapped, self.packed = re.compile(WRAPPED), re.compile(PACKED, re.DOTALL)
        self.printable = re.compile(rb"[\t\n\r\x20-\x7e]{%d,}" % SHORTEST)
        # On reversed text: three words and their blanks, as in token = x, behind the cut-off one; what nothing passes over.
        self.words = re.compile(r"[\x21-\x7e]*+(?:[^\x21-\x7e]++[\x21-\x7e]++){3}(?=[^\x21-\x7e])")
        self.hard = re.compile(r"[^\x20-\x7e\t\r\n]|\n\r?\n")
        self.blank = re.compile(r"[\x20\n]|$(?!\n)")

    def scan(self, text: str) -> list[Span]:
        """(start, kind number, end) of the findings in one layer."""
        found = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return found

    def unwrap(self, text: str) -> Iterator[tuple[str | Iterator[str], Places]]:
        """Decoded runs of a layer, with the range in the layer of each decoded character; of a compressed run windows and one range."""
        if "%" in text:
            yield from self._regions(text, self.octets, self._percent)
        if "\\u" in text:
            yield from self._regions(text, self.escape, self._unicode)
        for m in self.base64.finditer(text):
            yield from self._base64(m[0].replace("-", "+").replace("_", "/"), range(m.start(), m.end()))
        for m in self.wrapped.finditer(text) if "\n" in text else ():
            if "\n" in m[0]:
                at = m.start() + np.flatnonzero(~np.isin(np.frombuffer(m[0].encode("ascii"), dtype=np.uint8), list(b"\r\n\t ")))
                yield from self._base64("".join(m[0].split()).replace("-", "+").replace("_", "/"), at)

    def _regions(self, text: str, escape: re.Pattern, decode) -> Iterator[tuple[str, Places]]:
        """Every stretch between blanks that holds an escape, decoded; a secret may be escaped in part only."""
        done = 0
        while m := escape.search(text, done):
            a = max(text.rfind(" ", done, m.start()), text.rfind("\n", done, m.start()), done - 1) + 1
            done = self.blank.search(text, m.end()).start()
            out, starts, ends, at = [], array("i"), array("i"), a
            for e in escape.finditer(text, a, done):
                out.append(text[at : e.start()])
                starts.extend(range(at, e.start()))
                ends.extend(range(at + 1, e.start() + 1))
                decode(e, out, starts, ends)
                at = e.end()
            out.append(text[at:done])
            starts.extend(range(at, done))
            ends.extend(range(at + 1, done + 1))
            yield "".join(out), Places(np.frombuffer(starts, dtype=np.int32), np.frombuffer(ends, dtype=np.int32))

    @staticmethod
    def _percent(e: re.Match, out: list[str], starts: array, ends: array) -> None:
        raw, k = bytes.fromhex(e[0].replace("%", "")), e.start()
        for c in raw.decode("utf-8", "surrogateescape"):
            n = 3 * (1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode()))
            out.append(c)
            starts.append(k)
            k += n
            ends.append(k)

    @staticmethod
    def _unicode(e: re.Match, out: list[str], starts: array, ends: array) -> None:
        c = int(e[1], 16)
        out.append(chr(c) if not 0xD800 <= c < 0xE000 else "\ufffd")
        starts.append(e.start())
        ends.append(e.end())

    def _base64(self, chars: str, at: range | np.ndarray) -> Iterator[tuple[str | Iterator[str], Places]]:
        """What a run holds, decoded from each of its first four characters: a payload may begin anywhere in it.

        ``at`` has the place in the layer of each character.  Bytes that are not readable throughout
        give their printable ASCII stretches; no finding or encoded run has other characters in it,
        and none is shorter than ``SHORTEST``.
        """
        for phase in range(4):
            run = chars[phase:].rstrip("=")
            raw = binascii.a2b_base64(run[: len(run) - (len(run) % 4 == 1)] + "=" * (-len(run) % 4))
            places = at[phase:]
            done = 0
            for m in self.packed.finditer(raw):
                k = m.start()
                if k >= done:
                    inflated = Inflated(memoryview(raw)[k:])
                    # Two bytes are soon met by chance: inside a run a zlib stream has to end well.
                    begins = k % 3 == 0 and (phase + k == 0 or chars[phase + k // 3 * 4 - 1] in "+/")
                    if (begins or m[0][:1] == b"\x1f" or Inflated(inflated.raw).sound()) and inflated.ready():
                        yield self._windows(inflated), Places(*np.array([[places[k // 3 * 4]], [places[-1] + 1]], dtype=np.int32))
                        done = k + inflated.taken
            if self._readable(raw):
                first = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)
                yield raw.decode("utf-8"), self._places(places, first, np.append(first[1:], len(raw)))
            else:
                for m in self.printable.finditer(raw):
                    each = np.arange(*m.span())
                    yield m[0].decode("ascii"), self._places(places, each, each + 1)

    def _windows(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of the parts in windows that overlap so far that each finding and encoded run is whole in one."""
        decoder, text, most = codecs.getincrementaldecoder("utf-8")("replace"), "", WINDOW
        for part in parts:
            text += decoder.decode(part)
            if len(text) >= most:
                if keep := self._overlap(text):
                    yield text
                    text, most = text[keep:], max(WINDOW, 2 * (len(text) - keep))
                else:
                    most = 2 * len(text)
        text += decoder.decode(b"", True)
        if text:
            yield text

    def _overlap(self, text: str) -> int:
        """Where the next window has to begin: nothing that a rule takes whole passes from before it over the end."""
        end = text[::-1]
        words, hard = self.words.match(end), self.hard.search(end)
        at = len(text) - words.end() if words else 0
        for m in self.wrapped.finditer(text):
            if m.start() < at and m.end() + 8 >= len(text):
                at = m.start()
        # A run that is cut off goes on in the next window, from its beginning.
        return max(at, len(text) - hard.start() if hard else 0)

    @staticmethod
    def _places(places: range | np.ndarray, i: np.ndarray, j: np.ndarray) -> Places:
        """The ranges in the layer that bytes i to j of the decoded run come from."""
        first, last = i // 3 * 4, np.minimum((j - 1) // 3 * 4 + 3, len(places) - 1)
        if isinstance(places, range):
            first, last = first + places.start, last + places.start
        else:
            first, last = places[first], places[last]
        return Places(first.astype(np.int32), (last + 1).astype(np.int32))

    @staticmethod
    def _readable(raw: bytes) -> bool:
        if any(b < 32 and b not in (9, 10, 13) for b in raw[:64]):
            return False
        try:
            return raw.decode("utf-8").isprintable() or all(c.isprintable() or c in "\t\n\r" for c in raw.decode("utf-8"))
        except UnicodeDecodeError:
            return False

    def find(self, text: str) -> tuple[list[Span], list[Span], int]:
        """Base spans, all spans, and the number of layers, for one text."""
        base = sorted(self.scan(text))
        spans, seen = set(base), {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0)}
        work: list[tuple[str | Iterator[str], Places | None]] = [(text, None)]
        layers = 0

        def enter(inner: str, at: Places) -> bool:
            # One content may stand in several places; in one place it is entered once.
            mark = hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest(), int(at.starts[0])
            return mark not in seen and not seen.add(mark)

        while work:
            layer, places = work.pop()
            if not isinstance(layer, str):
                windows, layer = layer, next(layer, None)
                if layer is None:
                    continue
                work.append((windows, places))
                if not enter(layer, places):
                    continue
                places = Places(*(np.broadcast_to(x, len(layer)) for x in places))
            layers += 1
            if places is not None:
                for s, k, e in self.scan(layer):
                    a, b = int(places.starts[s]), int(places.ends[e - 1])
                    if not any(k == kind and x <= a and b <= y for x, kind, y in base):
                        spans.add((a, k, b))
            for inner, at in self.unwrap(layer):
                if not inner:
                    continue
                if places is not None:
                    at = places.under(at)
                if not isinstance(inner, str) or enter(inner, at):
                    work.append((inner, at))
        return base, sorted(spans), layers


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base spans joined and their digest, all spans, layers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers")}
            for value in batch.column("text"):
                base, spans, layers = rules.find(value.as_py())
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(1 for x in base if x[1] == k))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["n_layers"].append(layers)
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {c: pa.array(v, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c, v in out.items()})

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint")
