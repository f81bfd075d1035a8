"""MinHash near-dedup (operator 2): fast similarity sketching, banding, exact verification.

Sketch.  Rounds of hashed bin placement (Dahlgaard, Knudsen, Thorup 2017): in each of the first
``COORDINATES`` rounds every shingle falls into one bin with a value, and a bin keeps the least
value of the first round that reached it; the next ``COORDINATES`` rounds put every shingle into
one given bin each.  So every coordinate fills, after about n + t log t steps, with MinHash's
collision probability and concentration.

Candidates.  ``BANDS`` bands of ``ROWS`` coordinates.  A pair at similarity 0.85 shares no band
with probability (1 - 0.85^5)^32, about 7e-9.

Verification and grouping, without making the pairs of a bucket:
1. Documents with equal shingle sets (128-bit digest) form a class; its smallest id stands for it.
2. Stars: every member of a bucket is compared with the bucket's hub, its smallest id.  Bit maps of
   the sets rule most unlike pairs out before full sets move.
3. Buckets whose other members still span several components stay open.  Their members, gathered
   by hub, are resolved by halving (``_resolved``): a group of few members is compared within one
   task.  For a larger one the centre is the set of shingles that most members have, and each
   member is told by its difference D from it.  A pair differs in |D| + |D'| shingles less twice
   those that D and D' share.  If it is near without sharing any, then both are near the member
   with the most to spare, the new hub, by the same sum.  Otherwise D and D' share so many that
   their prefixes, rarest shingles first, have one in common (prefix filtering; exact).  So members
   are compared with the hub, and meet again in one group for each prefix shingle.  A shingle of a
   difference belongs to a minority, so groups at least halve with every level and the work ends.
Every link is confirmed on full sets (or full differences, which tell as much) of 64-bit shingle
fingerprints; pairs are ruled out only by bounds that hold for certain.  Components come from
alternating large-star and small-star steps on the verified links, after each task has contracted
the links that it holds.

Rows of a key, hub or component that holds a large share of all rows are dealt out over several
tasks (``spread``); texts move only where a bit map of the ids says they may be needed.  The tables
and shuffle files of finished steps are deleted.

Results in special cases: null text, or a text without words, has an empty set and links with
nothing; a null doc_id links with nothing, has a null component and is kept; rows that share a
doc_id are one node and all get its component; very long texts are sketched whole, a slice of
texts at a time; an empty table gives an empty result; extra columns are ignored by ``groups``
and returned untouched by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Cuts, Flags, hot_keys, spread, text_of, unpacked, whole
from chronofold.llm.workers import returning

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SLICE_BYTES = 1 << 20
#: A group of at most so many members, with so many shingles in all, is compared within one task.
MEMBERS, SHINGLES = 256, 1 << 18
#: Links that a task contracts at a time; so many or fewer in all are one task's work.
LINKS = 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sketcher:
    """Tables for shingling and sketching; made once a task."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            self.letters = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
            self.places = _mix(np.arange(1001, 1001 + WORDS, dtype=_U)) | _U(1)
            self.rounds = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.base = 0x100000001B3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.unpowers = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * SLICE_BYTES)
            self.powers = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(self.base))]), dtype=_U)
            self.unpowers = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(self.inverse))]), dtype=_U)

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle fingerprints of each text (UTF-8)."""
        with np.errstate(over="ignore"):
            out: list[np.ndarray] = []
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size >= SLICE_BYTES or i == len(texts) - 1:
                    out += self._shingles(texts[start : i + 1])
                    start, size = i + 1, 0
            return out

    def _shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
        n = len(data)
        self._grow(n + 1)
        starts_of_docs = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts_of_docs[1:])
        blank = self.blank[data]
        before = np.concatenate([[True], blank[:-1]])
        begin = np.flatnonzero(before & ~blank)
        end = np.flatnonzero(blank & ~before)
        sums = np.concatenate([[_U(0)], np.cumsum(self.letters[data] * self.powers[:n], dtype=_U)])
        words = _mix((sums[end] - sums[begin]) * self.unpowers[begin] + (end - begin).astype(_U))
        bounds = np.searchsorted(begin, starts_of_docs)
        m = max(0, len(words) - WORDS + 1)
        runs = np.zeros(m, dtype=_U)
        for j in range(WORDS):
            runs += words[j : j + m] * self.places[j]
        runs = _mix(runs)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(runs[a : b - WORDS + 1]))
            elif b > a:
                short = (words[a:b] * self.places[: b - a]).sum(dtype=_U) + _U(b - a)
                out.append(_mix(np.array([short], dtype=_U) ^ _U(0x5851F42D4C957F2D)))
            else:
                out.append(np.zeros(0, dtype=_U))
        return out

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of COORDINATES values for each set, none of them empty."""
        t = COORDINATES
        with np.errstate(over="ignore"):
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            x = np.concatenate(sets)
            values = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=_U)
            filled = np.zeros(len(sets) * t, dtype=bool)
            for r in range(2 * t):
                h = _mix(x ^ self.rounds[r])
                bins = (((h >> _U(32)) * _U(t)) >> _U(32)).astype(np.int64) if r < t else np.full(len(x), r - t)
                slot = owner * t + bins
                free = ~filled[slot]
                np.minimum.at(values, slot[free], (h[free] & _U(0xFFFFFFFF)) | _U(r << 32))
                filled[slot] = True
                whole = filled.reshape(-1, t).all(axis=1)
                if whole.all():
                    break
                if r % 4 == 0:
                    stay = ~whole[owner]
                    owner, x = owner[stay], x[stay]
            return values.reshape(-1, t)

    def bands(self, sketches: np.ndarray) -> np.ndarray:
        """Band keys; the band's number is part of its key."""
        with np.errstate(over="ignore"):
            s = sketches.reshape(len(sketches), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), s.shape[:2])
            for r in range(ROWS):
                key = _mix(key * _U(0x9E3779B97F4A7C15) ^ s[:, :, r])
            return key.astype(np.int64)


def _slices(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= 1 << 18 or i - start >= 2000 or i == len(sets) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = Sketcher()
    for batch in batches:
        sets = k.shingles(batch.column("text").to_pylist())
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        rows: list[np.ndarray | None] = [None] * len(sets)
        some = [i for i, s in enumerate(sets) if len(s)]
        for a, b in _slices([sets[i] for i in some]):
            keys = k.bands(k.sketches([sets[i] for i in some[a:b]]))
            for i, row in zip(some[a:b], keys, strict=True):
                rows[i] = row
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()), "bands": pa.array(rows, pa.list_(pa.int64()))}
        )


def _bits(s: np.ndarray) -> bytes:
    """A bit map of a set, four bits or more a shingle, placed by its low bits."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    flags = np.zeros(size, dtype=np.uint8)
    flags[(s & _U(size - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def _most(x: bytes, n: int, y: bytes, m: int) -> int:
    """An upper bound of what two sets have in common: a bit of one that the other lacks is a shingle it lacks."""
    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = Sketcher()
    for batch in batches:
        sets = k.shingles(batch.column("text").to_pylist())
        names = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) for s in sets]
        yield pa.record_batch(
            {"node": batch.column("node"), "name": pa.array(names, pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()), "bits": pa.array([_bits(s) for s in sets], pa.binary())}
        )


def _pairs(batch: pa.RecordBatch, ok: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that their bit maps do not rule out."""
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("x", "n", "y", "m")], strict=True)
        yield _pairs(batch, [(100 + PERCENT) * _most(x, n, y, m) >= PERCENT * (n + m) for x, n, y, m in rows])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield _pairs(batch, ok)


def _verify(pairs: DataFrame, sets: DataFrame, cuts: Cuts) -> DataFrame:
    """Links among distinct candidate pairs (a, b), a being a hub of many."""

    def joined(pairs: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
        def other(side: str, names: str) -> DataFrame:
            return sets.select(F.col("node").alias(side), *[c.alias(name) for name, c in zip(names, columns, strict=False)])

        hot = hot_keys(pairs.groupBy("a").count(), ["a"], pairs.count())
        return spread(pairs.join(other("b", "ym"), "b"), other("a", "xn"), ["a"], hot, "b")

    size = (F.octet_length("shingles") / 8).cast("bigint")
    near = cuts(joined(pairs, F.col("bits"), size).mapInArrow(returning(_possible), "a bigint, b bigint"))
    links = cuts(joined(near, F.col("shingles")).mapInArrow(returning(_confirmed), "a bigint, b bigint"))
    cuts.free(near)
    return links


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for us, vs in pairs:
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            u, v = top(u), top(v)
            up[max(u, v)] = min(u, v)
    rows = [(x, top(x)) for x in up]
    rows = [(x, y) for x, y in rows if x != y]
    return pa.record_batch({"u": pa.array([x for x, _ in rows], pa.int64()), "v": pa.array([y for _, y in rows], pa.int64())})


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task, some at a time, as one from each node to the smallest that it reaches by them."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += batch.num_rows
        if n >= LINKS:
            yield _forest(held)
            held, n = [], 0
    yield _forest(held)


def components(links: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """node, component (its smallest node) of every linked node but the smallest ones themselves, by large-star and small-star steps."""
    cuts = cuts or Cuts(links.sparkSession)
    edges, written = links.select(F.col("a").alias("u"), F.col("b").alias("v")), []

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    if links.count() <= LINKS:
        return cuts(edges.coalesce(1).mapInArrow(returning(_contracted), "u bigint, v bigint")).toDF("node", "component")
    while True:
        local = cuts(edges.mapInArrow(returning(_contracted), "u bigint, v bigint"))
        before = mark(local)
        both = local.union(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("count"))
        large = spread(both, least.select("u", "m"), ["u"], hot_keys(least, ["u"], 2 * before[0]), "v")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cuts(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        cuts.free(local, *written)
        written = [edges]
        if mark(edges) == before:  # stars already
            return edges.toDF("node", "component")


def _slack(n: np.ndarray | int, different: np.ndarray | int) -> np.ndarray | int:
    """Two sets are near if and only if (100 - P) (n + m) >= (100 + P) x shingles that only one has; a member's part of that."""
    return (100 - PERCENT) * n - (100 + PERCENT) * different


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=_U) for x in column]


def _within(group: pa.Table) -> pa.Table:
    """The links between components that span a small group."""
    sets, n = _arrays(group.column("diff").combine_chunks()), group.column("n").to_numpy()
    parts = group.column("component").to_pylist()
    _, at, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    again = uses[at] > 1  # the others are in one set only
    _, at = np.unique(at[again], return_inverse=True)
    owner, order = owner[again], np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common, some = np.zeros((len(sets), len(sets)), dtype=np.int64), 1 << 14
    for k in range(0, int(at.max(initial=-1)) + 1, some):
        a, b = np.searchsorted(at, [k, k + some])
        holds = np.zeros((len(sets), some), dtype=np.float32)
        holds[owner[a:b], at[a:b] - k] = 1
        common += (holds @ holds.T).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    near = _slack(n[:, None] + n[None, :], sizes[:, None] + sizes[None, :] - 2 * common) >= 0
    up = {c: c for c in parts}

    def top(c: int) -> int:
        while up[c] != c:
            c = up[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = top(parts[i]), top(parts[j])
        if x != y:
            up[max(x, y)] = min(x, y)
            links.append((x, y))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _members(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The shingles of members, some members at a time, and for each shingle its member's columns."""
    for batch in batches:
        sets = _arrays(batch.column("diff"))
        own = [batch.column(c).to_numpy() for c in columns]
        for a, b in _slices(sets):
            at = a + np.repeat(np.arange(b - a), [len(s) for s in sets[a:b]])
            yield np.concatenate(sets[a:b]), *[x[at] for x in own]


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of a group's members, once for some of them, with its uses."""
    for x, g, s in _members(batches, "g", "members"):
        order = np.lexsort((x, g))
        x, g, s = x[order], g[order], s[order]
        first = np.flatnonzero(np.concatenate([[True] * bool(len(x)), (x[1:] != x[:-1]) | (g[1:] != g[:-1])]))
        uses = np.diff(np.concatenate([first, [len(x)]]))
        yield pa.record_batch({"g": pa.array(g[first], pa.int64()), "members": pa.array(s[first], pa.int64()), "shingle": pa.array(x[first].astype(np.int64)), "uses": pa.array(uses, pa.int64())})


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with their differences from the centre, and what they have to spare."""
    for batch in batches:
        diffs, spare = [], []
        for x, centre, n in zip(_arrays(batch.column("diff")), batch.column("centre"), batch.column("n").to_pylist(), strict=True):
            c = np.sort(np.array(centre.values if centre.is_valid else [], dtype=np.int64).astype(_U))
            diffs.append(np.setxor1d(x, c, assume_unique=True))
            spare.append(_slack(n, len(diffs[-1])))
        kept = {c: batch.column(c) for c in ("g", "node", "n", "component")}
        yield pa.record_batch(kept | {"diff": pa.array([d.tobytes() for d in diffs], pa.binary()), "slack": pa.array(spare, pa.int64())})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with the hub's component where they are near the hub, and the length of their prefix."""
    for batch in batches:
        near, prefix = [], []
        columns = [batch.column(c).to_pylist() for c in ("n", "component", "slack", "hub_n", "hub_component", "most", "next")]
        for x, y, n, mine, slack, m, theirs, most, other in zip(_arrays(batch.column("diff")), _arrays(batch.column("hub_diff")), *columns, strict=True):
            apart = mine != theirs and _slack(n + m, len(np.setxor1d(x, y, assume_unique=True))) >= 0
            near.append(theirs if apart else None)
            # What a near member of another component can have to spare: its size is bounded by this one's,
            # and its difference by how far the two can be apart.
            most = min(most if mine != theirs else other, slack + _slack(2 * (100 * n // PERCENT), 0))
            # A pair whose slack is below zero together shares -(slack + slack') / (2 (100 + P)) shingles of its differences at least.
            share = max(1, -((slack + most) // (2 * (100 + PERCENT))))
            prefix.append(len(x) - share + 1)
        kept = {"from": batch.column("g")} | {c: batch.column(c) for c in ("node", "n", "component", "diff", "hub")}
        yield pa.record_batch(kept | {"near": pa.array(near, pa.int64()), "prefix": pa.array(prefix, pa.int64())})


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, g, node, component in _members(batches, "from", "node", "component"):
        yield pa.record_batch({"g": pa.array(g), "node": pa.array(node), "component": pa.array(component), "shingle": pa.array(x.astype(np.int64))})


def _compared_with_hubs(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Of large groups' rows (g, members, node, n, component, diff): what ``_compared`` gives, the group as ``from``."""
    sizes = rows.groupBy("g").count()
    hot = hot_keys(sizes, ["g"], rows.count())
    counts = rows.select("g", "members", "diff").mapInArrow(returning(_uses), "g bigint, members bigint, shingle bigint, uses bigint")
    common = counts.groupBy("g", "members", "shingle").agg(F.sum("uses").alias("uses")).filter("2 * uses > members")
    # No longer than twice a group's mean set.
    centres = common.groupBy("g").agg(F.collect_list("shingle").alias("centre"))
    shape = "node bigint, n bigint, component bigint, diff binary"
    centred = cuts(spread(rows, centres, ["g"], hot, "node", "left").mapInArrow(returning(_centred), f"g bigint, {shape}, slack bigint"))
    # The most that a component's members have to spare, and of those in other components.
    parts = centred.groupBy("g", "component").agg(F.max("slack").alias("slack"))
    best = parts.groupBy("g").agg(F.max("slack").alias("most"), F.max_by("component", "slack").alias("top"))
    other = spread(parts, best.select("g", "top"), ["g"], hot, "component").filter("component <> top").groupBy("g").agg(F.max("slack").alias("next"))
    best = best.join(other, "g")
    hubs = spread(centred.select("g", "node", "component", "slack"), best, ["g"], hot, "node").filter("slack = most and component = top")
    hubs = hubs.groupBy("g", "most", "next").agg(F.min("node").alias("node"))
    hub = centred.select("g", "node", F.col("n").alias("hub_n"), F.col("component").alias("hub_component"), F.col("diff").alias("hub_diff"))
    hubs = hubs.join(hub, ["g", "node"]).withColumnRenamed("node", "hub")
    compared = cuts(spread(centred, hubs, ["g"], hot, "node").mapInArrow(returning(_compared), f"`from` bigint, {shape}, hub bigint, near bigint, prefix bigint"))
    cuts.free(centred)
    return compared


def _halved(compared: DataFrame, found: DataFrame | None, cuts: Cuts) -> DataFrame:
    """The next groups' members: those of groups that still span several components, once for each
    shingle of their prefixes that members of another component have too."""
    size = (F.octet_length("diff") / 8).cast("bigint").alias("size")
    narrow = compared.filter("node <> hub and prefix > 0").select("from", "node", "n", "component", "prefix", size)
    named = cuts(narrow if found is None else _renamed(narrow, found))
    spans = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(*keys, "count")
    still = cuts(spans(named, "from"))
    left = cuts(spread(named, still.select("from"), ["from"], hot_keys(still, ["from"], named.count()), "node"))
    told = compared.select("from", "node", "diff").join(left.select("from", "node", "component"), ["from", "node"])
    elements = cuts(told.mapInArrow(returning(_elements), "g bigint, node bigint, component bigint, shingle bigint"))
    shared = cuts(spans(elements, "g", "shingle"))
    among = spread(elements.drop("component"), shared, ["g", "shingle"], hot_keys(shared, ["g", "shingle"], elements.count()), "node")
    member = Window.partitionBy("g", "node")
    # In the order of the prefixes, shingles that only one component has come first; no pair across shares one.
    among = among.withColumn("rank", F.row_number().over(member.orderBy("count", "shingle"))).withColumn("met", F.count(F.lit(1)).over(member))
    prefixes = among.join(left.withColumnRenamed("from", "g"), ["g", "node"]).filter("size - met + rank <= prefix")
    members = cuts(prefixes.select(F.xxhash64("g", "shingle").alias("g"), F.col("g").alias("from"), "node", "n", "component", "size"))
    cuts.free(named, still, left, elements, shared)
    return members


def _renamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their components as the found ones say."""
    found = found.select(F.col("node").alias("component"), F.col("component").alias("_now"))
    hot = hot_keys(rows.groupBy("component").count(), ["component"], rows.count())
    renamed = spread(rows, found, ["component"], hot, "node", "left")
    return renamed.withColumn("component", F.coalesce("_now", "component")).drop("_now")


def _resolved(members: DataFrame, differ: DataFrame, cuts: Cuts) -> DataFrame | None:
    """Links between the components of groups' members; together they tell all there are within the groups.

    ``members`` has g, from, node, n, component and size; ``differ`` the set or difference of each (from, node).
    """
    links: DataFrame | None = None
    while True:
        sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        still = cuts(sizes.filter("lo <> hi").select("g", "members", "shingles"))
        if still.isEmpty():
            cuts.free(members, differ, still)
            return links
        few = F.expr(f"members <= {MEMBERS} and shingles <= {SHINGLES}")
        large = not still.filter(~few).isEmpty()
        hot = hot_keys(still, ["g"], members.count(), "members")
        rows = spread(members, still, ["g"], hot, "node").join(differ.select("from", "node", "diff"), ["from", "node"])
        rows = cuts(rows.select("g", "members", "shingles", "node", "n", "component", "diff"))
        cuts.free(members, differ, still)
        within = cuts(rows.filter(few).select("g", "n", "component", "diff").groupBy("g").applyInArrow(_within, "a bigint, b bigint"))
        if not large:
            cuts.free(rows)
            return within if links is None else links.union(within)
        differ = _compared_with_hubs(rows.filter(~few), cuts)
        spanning = differ.filter("near is not null").select(F.col("component").alias("a"), F.col("near").alias("b"))
        new = cuts(within.union(spanning).distinct())
        cuts.free(within, rows)
        found = None
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            found = components(new, cuts)
        members = _halved(differ, found, cuts)


def _link(docs: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """Sketched rows (doc_id, n_shingles, digest) and the component of each digest."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    sketched = cuts(rows.mapInArrow(returning(_sketched), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"))
    known = sketched.filter("doc_id is not null and digest is not null")
    narrow = cuts(sketched.select("doc_id", "n_shingles", "digest"))
    nodes = cuts(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    cuts.free(sketched)
    exploded = nodes.select("node", F.explode("bands").alias("key"))
    hubs = cuts(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("hub")).filter("count > 1"))
    total = nodes.count()
    hot = hot_keys(hubs, ["key"], BANDS * total)
    buckets = cuts(spread(exploded, hubs, ["key"], hot, "node").filter("node <> hub").select("key", "hub", "node"))
    classes = cuts(nodes.select("digest", "node"))
    cuts.free(nodes, hubs)
    pairs = cuts(buckets.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    needed = cuts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    texts = Flags(needed, "node").mark(rows.withColumnRenamed("doc_id", "node"), "node").filter("_flag")
    sets = cuts(texts.join(needed, "node", "left_semi").select("node", "text").mapInArrow(returning(_sets), "node bigint, name bigint, shingles binary, bits binary"))
    links = _verify(pairs, sets, cuts)
    cuts.free(pairs, needed)
    # Rows of one id with different texts are one node.
    ids = narrow.filter("doc_id is not null and digest is not null")
    again = ids.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).filter("lo <> hi").select("doc_id")
    if not again.isEmpty():
        tied = ids.join(again, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        links = links.union(tied)
    stars = components(links, cuts)
    named = cuts(buckets.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node")))
    cuts.free(buckets)
    still = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("count")).filter("lo <> hi")
    still = cuts(still.select("key", "count"))
    wide = spread(named, still, ["key"], hot_keys(still, ["key"], named.count()), "node").select("hub", "node", "component").distinct()
    # Buckets with hubs of one component make one group, so that a member is not taken once for each hub of a family.
    hubs = stars.select(F.col("node").alias("hub"), F.col("component").alias("_top"))
    wide = cuts(wide.join(hubs, "hub", "left").select(F.coalesce("_top", "hub").alias("g"), "node", "component").distinct())
    # From here on a member is named by its set: an id may have several.
    own = sets.select("node", "name", (F.octet_length("shingles") / 8).cast("bigint").alias("n"))
    first = F.lit(0).cast("bigint").alias("from")
    members = cuts(wide.join(own, "node").select("g", first, F.col("name").alias("node"), "n", "component", F.col("n").alias("size")))
    cuts.free(named, still, wide)
    among = sets.join(members.select(F.col("node").alias("name")).distinct(), "name", "left_semi").dropDuplicates(["name"])
    differ = cuts(among.select(first, F.col("name").alias("node"), F.col("shingles").alias("diff")))
    cuts.free(sets)
    more = _resolved(members, differ, cuts)
    found = classes.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if more is not None:
        found = _renamed(found, components(more, cuts))
    labels = cuts(found.select("digest", "component"))
    cuts.free(classes)
    return narrow, labels


def groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    narrow, labels = _link(docs, Cuts(docs.sparkSession))
    hot = hot_keys(narrow.groupBy("digest").count(), ["digest"], narrow.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    rows = spread(narrow, labels, ["digest"], hot, "doc_id", "left").withColumn("component_id", component)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows whose document stands for its component, with all their columns; only rows that may go move."""
    cuts = Cuts(docs.sparkSession)
    gone = cuts(groups(docs).filter("not kept").select(F.col("doc_id").alias("id")).distinct())
    rows = Flags(gone, "id").mark(docs.select(whole(docs).alias("row"), docs["doc_id"].cast("bigint").alias("id")), "id")
    stay = rows.filter("not _flag").select("row").union(rows.filter("_flag").join(gone, "id", "left_anti").select("row"))
    return unpacked(stay, docs.columns)
