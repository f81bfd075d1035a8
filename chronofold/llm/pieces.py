"""SentencePiece encoding and decoding (operator 8): a weighted finite-state transducer.

A BPE model is compiled into three transducers that are composed with each input:

  normaliser   blank -> U+2581, one put before a text that is not empty
  pieces       each piece is a path that reads its characters and writes its id; a character
               without a piece is a path that writes its UTF-8 bytes (byte fallback)
  neighbours   weighs each pair of adjacent pieces in the tropical semiring: 0 if merging
               the pair's characters in the model's order gives these two pieces back,
               infinity if not

Merging stays inside pieces exactly when no adjacent pair would merge across its border, so
the input's shortest path is the only one of finite weight, and it is the model's own
encoding (piece scores alone, added up, would not give it).  As weights are 0 or infinity,
depth-first search, longest arc first, finds it; states found to lead nowhere are marked, so
the work is linear in the input.

A text falls apart, without changing its shortest path, wherever two characters meet that meet in
no piece: no arc crosses there, and any pair weighs 0.  The parts' paths are kept in a bounded table.

Decoding is the inverse: ids -> bytes, U+2581 -> blank, less the blank put before.

Special cases: null and empty texts have no ids; every text, however long or strange, round
trips unless it holds U+2581 itself, which reads back as a blank.  Each input row gives one row,
repeated and null ids too, and an empty table none; extra columns are ignored.  A model of another
type or with another normaliser is told by ``PROBES``, which it encodes in another way, and is an error.
"""

from __future__ import annotations

import hashlib
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.common import text_of
from chronofold.llm.workers import returning

BLANK = "▁"
INFINITY = float("inf")
#: States past the ids: characters without a piece.
LONE = 1 << 24
STATES = 1 << 26
#: Bounds of a worker's tables, some 40 and 30 MB; of paths where nothing else needs the memory, some 80 MB.
MAX_PARTS = 200_000
MAX_PAIRS = 250_000
MANY_PARTS = 400_000
#: Parts longer than this are not kept.
MAX_KEPT_CHARS = 64
ROWS = 500


#: Texts that other normalisers change, and words that a model of another type cuts elsewhere.
PROBES = ("two  blanks ", "ﬁ Ａ é e\u0301 ①", "\t\nline\r\n", "internationalisation of unbelievable misunderstandings", "Donaudampfschifffahrt, néanmoins, desarrollándose 1234567", "漢字 😀 \x00")


def load(path: str) -> dict:
    """The model at ``path`` as plain values: pieces by id, ranks, byte ids.  At most its vocabulary's size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    octets = {i: int(names[i][3:5], 16) for i in range(n) if model.is_byte(i)}
    if len(octets) != 256:
        raise ValueError("the model has no byte fallback")
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    found = {"names": names, "ids": {names[i]: i for i in plain}, "order": {names[i]: -model.get_score(i) for i in plain}, "octets": octets, "key": hashlib.sha256(repr(names).encode()).hexdigest()}
    t = Transducer(found)
    if any(np.frombuffer(t.encode(x), dtype="<i4").tolist() != model.encode(x) for x in PROBES):
        raise ValueError("not a BPE model that leaves texts as they are")
    return found


class Paths(dict):
    """Part -> its path; works out what it lacks.  When half of ``most`` are new, those from before them
    that were not asked for since are forgotten, so that frequent parts stay."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work, self.before, self.most = work, {}, MAX_PARTS

    def __missing__(self, part: str) -> bytes:
        path = self.before.get(part)
        if path is None:
            path = self.work(part)
        if len(part) <= MAX_KEPT_CHARS:
            if len(self) >= self.most // 2:
                self.before = self.copy()
                self.clear()
            self[part] = path
        return path


class Transducer:
    """The compiled model with its bounded tables of paths and pair weights."""

    def __init__(self, model: dict) -> None:
        self.ids, self.order = model["ids"], model["order"]
        self.byte_id = {b: i for i, b in model["octets"].items()}
        self.fallback = np.isin(np.arange(len(model["names"])), list(model["octets"]))
        self.bytes = [bytes([model["octets"][i]]) if i in model["octets"] else name.replace(BLANK, " ").encode() if name in self.ids else b"" for i, name in enumerate(model["names"])]
        #: Every beginning of a piece -> the piece's id, -1 where it is no piece itself.
        self.prefixes: dict[str, int] = {}
        for piece in self.ids:
            for k in range(1, len(piece)):
                self.prefixes.setdefault(piece[:k], -1)
        self.prefixes |= self.ids
        self.names = model["names"]
        # Character -> class, classes that meet in some piece.
        inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        found = sorted({c for pair in inside for c in pair})
        self.classes = np.zeros(0x110000, dtype=np.uint16)
        self.classes[[ord(c) for c in found]] = np.arange(1, len(found) + 1)
        self.meet = np.zeros((len(found) + 1, len(found) + 1), dtype=bool)
        for x, y in inside:
            self.meet[self.classes[ord(x)], self.classes[ord(y)]] = True
        #: At most one entry a piece.
        self.traces: dict[str, tuple[list, list] | None] = {}
        self.paths = Paths(self.path)
        self.pairs: dict[int, bool] = {}

    def trace(self, piece: str) -> tuple[list, list] | None:
        """How merging builds a piece: (order, last part after) and (order, first part after) for each
        merge, lowest order first, the leftmost among equals; None if merging does not end in the piece."""
        if piece in self.traces:
            return self.traces[piece]
        parts, order = list(piece), self.order
        tail, head = [], []
        while len(parts) > 1:
            best, at = INFINITY, -1
            for i in range(len(parts) - 1):
                if (o := order.get(parts[i] + parts[i + 1], INFINITY)) < best:
                    best, at = o, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            tail.append((best, parts[-1]))
            head.append((best, parts[0]))
        end = [(INFINITY, "")]
        got = (tail + end, head + end) if len(parts) == 1 else None
        if piece in self.ids:
            self.traces[piece] = got
        return got

    def name(self, state: int) -> str:
        return self.names[state] if state < LONE else chr(state - LONE)

    def free(self, left: int, right: int) -> bool:
        """Whether a pair of neighbours weighs 0; with nothing (-1) on the left, whether a piece can stand alone."""
        key = left * STATES + right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._free(self.name(left) if left >= 0 else "", self.name(right))
        return got

    def _free(self, left: str, right: str) -> bool:
        """Replays both pieces' merges side by side; the border must never be the next to merge."""
        if (mine := self.trace(right)) is None:
            return False
        if not left:
            return True
        tail, head = self.trace(left)[0], mine[1]
        a, b, i, j, order = left[-1], right[0], 0, 0, self.order
        while True:
            on_left, on_right = tail[i][0], head[j][0]
            border = order.get(a + b, INFINITY)
            if border < on_left and border <= on_right and border < INFINITY:
                return False
            if on_left <= on_right:
                if on_left == INFINITY:
                    return True
                a, i = tail[i][1], i + 1
            else:
                b, j = head[j][1], j + 1

    def arcs(self, part: str, at: int, most: int) -> list[tuple[int, int]]:
        """(end, state) of the pieces from ``at`` that end before ``most``, the shortest first; a lone character is always one."""
        prefixes, n = self.prefixes, len(part)
        end = at + 1
        state = prefixes.get(part[at], -1)
        out = [(end, state if state >= 0 else LONE + ord(part[at]))]
        while end < n and end + 1 < most:
            end += 1
            state = prefixes.get(part[at:end])
            if state is None:
                break
            if state >= 0:
                out.append((end, state))
        return out

    def shortest(self, part: str) -> list[int]:
        """The states on the only path of finite weight through one part: piece ids, and LONE + code point for characters without a piece."""
        free, arcs, n = self.free, self.arcs, len(part)
        out: list[tuple[int, int]] = []
        dead: set[tuple[int, int]] = set()
        at, last, most = 0, -1, n + 1
        while at < n:
            for arc in reversed(arcs(part, at, most)) if most > at + 1 else ():
                if (not dead or arc not in dead) and free(last, arc[1]):
                    break
            else:  # nothing leads on: step back and take a shorter arc
                arc = out.pop()
                dead.add(arc)
                most = arc[0]
                at, last = out[-1] if out else (0, -1)
                continue
            out.append(arc)
            at, last = arc
            most = n + 1
        return [state for _, state in out]

    def path(self, part: str) -> bytes:
        out = array("i")
        for state in self.shortest(part):
            if state < LONE:
                out.append(state)
            else:
                out.extend(self.byte_id[b] for b in chr(state - LONE).encode())
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 4-byte integers."""
        if not text:
            return b""
        line = BLANK + text.replace(" ", BLANK)
        c = self.classes[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        ends = (np.flatnonzero(~self.meet[c[:-1], c[1:]]) + 1).tolist()
        ends.append(len(line))
        parts = map(line.__getitem__, map(slice, chain((0,), ends), ends))
        return b"".join(map(self.paths.__getitem__, parts))

    def rest(self) -> None:
        """Between tasks of a job with other stages a worker keeps no paths: those need the memory."""
        self.paths.clear()
        self.paths.before = {}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def transducer(model: Broadcast, parts: int = MAX_PARTS) -> Transducer:
    """One per Python worker and model: the compiled model and its tables serve all tasks the worker runs; it keeps at most ``parts`` paths."""
    kept = sys.modules.setdefault("_chronofold_kept", types.ModuleType("_chronofold_kept"))
    found = getattr(kept, "transducers", None)
    if found is None or model.value["key"] not in found:
        kept.transducers = found = {model.value["key"]: Transducer(model.value)}
    t = found[model.value["key"]]
    t.paths.most = parts
    return t


def _model(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load(path))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows, so that few rows' ids are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens for every row."""
    model = _model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in _few(batches):
            got = [t.encode(x.as_py()) for x in batch.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": ids, "n_tokens": pa.array(np.diff(ends).astype(np.int64))})
        t.rest()

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(returning(run), "doc_id bigint, ids array<int>, n_tokens bigint")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text its ``ids`` spell."""
    model = _model(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            texts = [t.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(returning(run), "doc_id bigint, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, sha256 of the ids as little-endian 4-byte integers, and whether decoding gives the text back."""
    model = _model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model, MANY_PARTS)
        for batch in _few(batches):
            n, octets, sha, same = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                raw = t.encode(text)
                ids = np.frombuffer(raw, dtype="<i4")
                n.append(len(ids))
                octets.append(np.count_nonzero(t.fallback[ids]))
                sha.append(hashlib.sha256(raw).hexdigest())
                same.append(t.decode(ids.tolist()) == text)
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "n_byte_tokens": pa.array(octets, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(same, pa.bool_())}
            )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(returning(run), "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean")
