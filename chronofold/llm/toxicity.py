"""Toxicity (operator 6): a weighted finite-state pattern grammar over clauses.

Words map to classes (insult, threat, target, negation, report).  Five small transducers read
the class sequence of a clause; every arc has a factor for insults and one for threats:

  insult     lets an insult word's weight out, and no other word's
  threat     remembers a threat verb for ``NEAR`` words; a target then lets a threat out
  target     remembers a person word for ``NEAR`` words and multiplies insults by ``TARGETED``
  negation   remembers a negation for ``NEAR`` words and multiplies by ``NEGATED``
  report     remembers reported speech to the clause's end and multiplies by ``REPORTED``

``compose`` joins two transducers into one over the pairs of states that can be reached, the
factors multiplied; folded over the five it gives the grammar.  A clause's weight is the sum
over its words of word weight x insult factor and ``THREAT_WEIGHT`` x threat factor; a document
is scored on its clauses' weights, never on single words.

What is learned, from labelled training rows only (crc32 remainder not 1), on at most
``MAX_TRAIN_DOCS`` of them, those with the smallest hash of their id: words and word stems
(prefixes, for inflected forms) that are far more frequent in toxic documents and so join the
insult class, their weights (half the lower bound of their log-odds), and the logistic scale of
the document score.  Weights come from three quarters of the sample, the scale from the rest.
Candidates appear in at least ``MIN_SHARE`` of the toxic sample, so there are at most
1 / MIN_SHARE x its mean distinct words.

Special cases: null and empty texts score as texts without a matched clause; without any
training labels built-in weights and scale are used; each input row gives one row, and an empty
table none; a repeated id counts once in training; null ids and extra columns do no harm; a very long text is read whole,
clause by clause, in time linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import cut, remainder, text_of

MAX_TRAIN_DOCS = 20_000
MIN_SHARE = 0.01
MIN_DOCS = 4
MIN_LOG_ODDS = 2.0
STEMS = (4, 5)
MAX_CACHED = 200_000
NEAR = 3
NEGATED, TARGETED, REPORTED = 0.3, 1.5, 0.5
SEED_WEIGHT, THREAT_WEIGHT = 1.5, 3.0
CUTOFF = 0.7

# The seed lexicon.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb",
    "fool", "vermin", "filth", "filthy", "garbage", "jerk", "coward", "freak", "ugly", "useless", "disgrace", "parasite",
    "dummkopf", "abschaum", "versager", "trottel", "crétin", "ordure", "abruti", "imbécile", "idiota", "basura", "estúpido", "inútil",
)
THREATS = ("kill", "hurt", "destroy", "murder", "stab", "shoot", "burn", "beat", "crush", "töten", "tuer", "matar")
TARGETS = ("you", "your", "youre", "yourself", "they", "them", "he", "him", "she", "her", "people", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "tú", "usted")
NEGATIONS = ("not", "no", "never", "isnt", "arent", "dont", "without", "neither", "nicht", "kein", "pas", "jamais", "nunca", "sin")
REPORTS = ("said", "says", "called", "quoted", "wrote", "reported", "alleged", "claimed", "sagte", "nannte", "disait", "dijo")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSES = re.compile(r"[.!?;:,\n]+")


#: For each state and class: the next state, the factor for insults, the factor for threats.
Machine = list[list[tuple[int, float, float]]]


def _remembering(cls: int, factors: Callable[[bool, int], tuple[float, float]], span: int | None = NEAR) -> Machine:
    """A transducer that knows for ``span`` words, or to the clause's end, that a class came; state 0 does not."""
    top = span or 1
    after = lambda state, c: top if c == cls else state if span is None else max(0, state - 1)
    return [[(after(state, c), *factors(state > 0, c)) for c in range(6)] for state in range(top + 1)]


def compose(first: Machine, second: Machine) -> Machine:
    """One transducer for two that read the same words; states that are not reached are left out."""
    place, todo, out = {(0, 0): 0}, [(0, 0)], []
    while len(out) < len(todo):
        x, y = todo[len(out)]
        row = []
        for (nx, ix, tx), (ny, iy, ty) in zip(first[x], second[y], strict=True):
            if (nx, ny) not in place:
                place[nx, ny] = len(todo)
                todo.append((nx, ny))
            row.append((place[nx, ny], ix * iy, tx * ty))
        out.append(row)
    return out


def grammar() -> Machine:
    insult: Machine = [[(0, float(c == INSULT), 1.0) for c in range(6)]]
    threat = _remembering(THREAT, lambda on, c: (1.0, float(on and c == TARGET)))
    target = _remembering(TARGET, lambda on, c: (TARGETED if on else 1.0, 1.0))
    negation = _remembering(NEGATION, lambda on, c: (NEGATED, NEGATED) if on else (1.0, 1.0))
    report = _remembering(REPORT, lambda on, c: (REPORTED, REPORTED) if on else (1.0, 1.0), span=None)
    return reduce(compose, (insult, threat, target, negation, report))


def forms(word: str) -> list[str]:
    """The word and its stems; a stem ends in a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


class Grammar:
    """Lexicon plus composed table; scores clauses."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.fixed = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.insults = insults
        self.known: dict[str, tuple[int, float]] = {}
        machine = grammar()
        self.step, self.factor, self.threat = ([[arc[k] for arc in row] for row in machine] for k in range(3))

    def classify(self, words: list[str]) -> list[tuple[int, float]]:
        if len(self.known) > MAX_CACHED:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            if (got := known.get(w)) is None:
                c = self.fixed.get(w.replace("'", "").replace("’", ""), OTHER)
                weight = max((self.insults.get(f, 0.0) for f in forms(w)), default=0.0) if c == OTHER else 0.0
                got = known[w] = (INSULT, weight) if weight else (c, 0.0)
            out.append(got)
        return out

    def clause(self, classes: list[tuple[int, float]]) -> float:
        state, total = 0, 0.0
        for c, weight in classes:
            if c == INSULT:
                total += weight * self.factor[state][c]
            elif self.threat[state][c]:
                total += THREAT_WEIGHT * self.threat[state][c]
            state = self.step[state][c]
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """log of 1 + all clause weight, the heaviest clause, clause weight per hundred words."""
        low = text.lower()
        words = WORDS.findall(low)
        if not any(c in (INSULT, THREAT) for c, _ in self.classify(words)):
            return 0.0, 0.0, 0.0
        got = [self.clause(self.classify(WORDS.findall(part))) for part in CLAUSES.split(low)]
        return math.log1p(sum(got)), max(got), 100 * sum(got) / len(words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([*[0.5] * x.shape[1], 1e-3])
    for _ in range(25):
        p = _sigmoid(a @ w)
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
    return w


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled training documents with their text, read from the documents once.

    Ids are chosen on the narrow table, at most MAX_TRAIN_DOCS, so they fit a broadcast; of the rows
    of a repeated id the greatest text counts, so there are no more rows than ids.
    """
    known = labels.filter(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & (remainder(labels["doc_id"], 3) != 1))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_DOCS)
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))


def _tally(candidates: frozenset[str] | None):
    """Documents each word occurs in, by label; all words of toxic rows, or only candidates of all rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {f for w in set(WORDS.findall(text.lower())) for f in forms(w)}
                counts[int(toxic > 0)].update(words if candidates is None else words & candidates)
                counts[int(toxic > 0)][""] += 1
        for toxic, c in enumerate(counts):
            yield pa.record_batch({"word": pa.array(list(c), pa.string()), "toxic": pa.array([toxic] * len(c), pa.int32()), "n": pa.array(list(c.values()), pa.int64())})

    return tally


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Insult weights and the logistic weights of the document score."""
    sample = _sample(docs, labels)
    first, second = sample.filter(F.xxhash64("doc_id") % 4 != 0), sample.filter(F.xxhash64("doc_id") % 4 == 0)
    shape = "word string, toxic int, n bigint"
    toxic = first.filter("toxic > 0").select("text", "toxic")
    counts = toxic.mapInArrow(_tally(None), shape).groupBy("word").agg(F.sum("n").alias("n"))
    total = toxic.count()
    common = counts.filter(F.col("n") >= max(MIN_DOCS, total * MIN_SHARE)).select("word", "n").collect()
    mine = frozenset(r["word"] for r in common) | frozenset(INSULTS)
    insults = dict.fromkeys(INSULTS, SEED_WEIGHT)
    rows = first.select("text", "toxic").mapInArrow(_tally(mine), shape).groupBy("word", "toxic").agg(F.sum("n").alias("n")).collect()
    seen = {(r["word"], r["toxic"]): r["n"] for r in rows}
    n_toxic, n_clean = seen.get(("", 1), 0), seen.get(("", 0), 0)
    for w in mine - {""} if n_toxic and n_clean else ():
        a, b = seen.get((w, 1), 0) + 0.5, seen.get((w, 0), 0) + 0.5
        low = math.log(a / (n_toxic + 1)) - math.log(b / (n_clean + 1)) - math.sqrt(1 / a + 1 / b)
        if a > MIN_DOCS and low >= MIN_LOG_ODDS:
            insults[w] = low / 2
        elif a + b > 2 * MIN_DOCS and w in insults:
            insults[w] = max(0.05, low / 2)
    grammar = Grammar(insults)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.record_batch({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": pa.array([int(v > 0) for v in batch.column("toxic").to_pylist()], pa.int32())})

    got = second.select("text", "toxic").mapInArrow(measure, "a double, b double, c double, y int").toArrow()
    y = got.column("y").to_numpy()
    if not 0 < y.sum() < len(y):
        return insults, np.array([1.0, 0.5, 0.1, -2.5])
    x = np.column_stack([got.column(c).to_numpy() for c in "abc"])
    order = np.lexsort((y, *x.T))  # so that the fit does not depend on the order of rows
    return insults, _logistic(x[order], y[order])


def predict(docs: DataFrame, insults: dict[str, float], scale: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted, and the matched clauses' summed weight."""
    model = docs.sparkSession.sparkContext.broadcast((insults, scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        insults, scale = model.value
        grammar = Grammar(insults)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            p = _sigmoid(x @ scale[:3] + scale[3])
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": p, "predicted": pa.array((p >= CUTOFF).astype(np.int32)), "clause_weight": np.expm1(x[:, 0])}
            )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), (remainder(docs["doc_id"], 3) == 1).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int, clause_weight double")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs, labels))
