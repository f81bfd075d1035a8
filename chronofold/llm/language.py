"""Language identification (operator 3): multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every non-letter becomes a blank, and the character 1- to 3-grams
of the code points are hashed into ``BUCKETS`` buckets.  Counting runs over all labelled
training rows; partial counts meet by (language, bucket), so what reaches the driver is at
most languages x buckets numbers whatever the size of the input.  The matrix of log
probabilities, ``BUCKETS`` x languages of 4 bytes, is broadcast with the languages' priors, their
shares of the training documents; batches are scored by gathering its rows and summing them per
document.  More than ``MAX_LANGUAGES`` different values of lang, which no matrix of bounded size
could hold, are an error.

Special cases: null text, or a text with no letter, gives ``und`` with score 0; without
training rows every text does.  Equal posteriors go to the alphabetically first language.
Each input row gives one row, and an empty table none; extra columns and repeated or null ids are
of no consequence; a very long text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import remainder

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SLICE_CHARS = 1 << 20
MAX_LANGUAGES = 512


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point for letters, blank for all else, 0 for 0."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    table[0] = 0
    return table


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 3
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by (order, position), each document's first position, and whether it has a letter.

    Documents are set apart by three zeros; a gram that holds one goes to the idle bucket ``BUCKETS``.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0\0\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = table[codes]
    starts = np.zeros(len(low), dtype=np.int64)
    np.cumsum([len(t) + 3 for t in low[:-1]], out=starts[1:])
    n = len(c)
    out = np.empty((len(ORDERS), n), dtype=np.int32)
    h = np.zeros(n, dtype=np.uint32)
    idle = np.zeros(n, dtype=bool)
    for k, order in enumerate(ORDERS):
        step = order - 1
        shifted = np.zeros(n, dtype=np.uint32)
        shifted[: n - step] = c[step:]
        h = h * np.uint32(0x01000193) + shifted + np.uint32(order)
        idle |= shifted == 0
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[k] = mixed >> np.uint32(32 - 15)
        out[k][idle] = BUCKETS
    has = np.add.reduceat((c > 32).astype(np.int32), starts) > 0
    return out, starts, has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _letters()
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in _slices(texts):
            names = sorted(set(langs[a:b]))
            for name in names:
                some = [t for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == name]
                seen, _, _ = _grams(some, table)
                total = counts.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                total[:BUCKETS] += np.bincount(seen.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                total[BUCKETS] += len(some)
    for name, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array([name] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the (BUCKETS + 1) x languages matrix, whose last row, for idle grams, is zero, and log priors.

    Trains on every row with a text and a language whose crc32 remainder is not 2.
    """
    train = docs.filter(docs["text"].isNotNull() & docs["lang"].isNotNull() & (remainder(docs["doc_id"], 4) != 2))
    parts = train.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n bigint")
    if train.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((BUCKETS + 1, len(names)))
    at = np.array([place[x] for x in rows.column("lang").to_pylist()], dtype=np.int64)
    if len(at):
        counts[rows.column("bucket").to_numpy(), at] = rows.column("n").to_numpy()
    grams = counts[:BUCKETS] + SMOOTHING
    matrix = np.zeros((BUCKETS + 1, len(names)), dtype=np.float32)
    matrix[:BUCKETS] = np.log(grams / grams.sum(axis=0)) if names else 0
    documents = counts[BUCKETS] + SMOOTHING
    return names, matrix, np.log(documents / documents.sum()) if names else documents


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, priors: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = docs.sparkSession.sparkContext.broadcast((names, matrix, priors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, priors = model.value
        table = _letters()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, sure = [], []
            for a, b in _slices(texts):
                grams, starts, has = _grams(texts[a:b], table)
                if not names:
                    best += ["und"] * (b - a)
                    sure += [0.0] * (b - a)
                    continue
                total = np.tile(priors, (b - a, 1))
                for k in range(len(ORDERS)):
                    total += np.add.reduceat(matrix[grams[k]], starts, axis=0, dtype=np.float64)
                total -= total.max(axis=1, keepdims=True)
                p = np.exp(total)
                p /= p.sum(axis=1, keepdims=True)
                top = p.argmax(axis=1)
                best += [names[i] if ok else "und" for i, ok in zip(top, has, strict=True)]
                sure += [float(x) if ok else 0.0 for x, ok in zip(p.max(axis=1), has, strict=True)]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(best, pa.string()), "score": pa.array(sure, pa.float64())}
            )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text", (remainder(docs["doc_id"], 4) == 2).alias("held_out"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs))
