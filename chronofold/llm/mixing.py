"""Mixing sources to target weights (operator 1): iterative proportional fitting, then sampling.

Documents fall into cells (source, language, topic).  A cell's tokens are counted exactly; the
raking multiplies a factor per source, per language and per topic,

    p(cell) = min(1, f(source) g(language) h(topic)),

so that the kept tokens, tokens x p summed over cells, meet the target of every margin value.
One step solves one margin's factors exactly, caps included; steps go round the margins until
all targets are met or nothing moves.  A value whose target asks for more than it has keeps
everything it has.  Then each document is kept with its cell's probability, by a hash of its id
and a seed, so that a lost task or a rerun gives the same sample.

Targets are the observed shares raised to ``TEMPERATURE`` and scaled to ``KEEP`` of all tokens:
large sources give way to small ones, and what a value has not got goes to the others.  ``rake``
takes any other targets.

Cells are held on the driver while there are at most ``MAX_CELLS``, their distinct values being
counted first; beyond that the same steps run on a distributed table of cells.

The documents have no topic column; ``topic`` tells their form from counts of characters, and any
other column expression can take its place in ``measured``.

Special cases: null source, language or topic is a value of its own; very long texts are counted whole; texts without words count
no tokens but are sampled as their cell is; a null doc_id is hashed as the empty text; repeated
rows share their id's fate; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import WORD, checkpoint_dir, cut, fenced, hot_keys, spread, text_of, unpacked, whole
from chronofold.sources.files import Files

MARGINS = ("source", "lang", "topic")
TEMPERATURE = 0.7
KEEP = 0.6
SEED = 17
MAX_CELLS = 200_000
MAX_STEPS = 200
TOLERANCE = 1e-9


def topic(text: Column) -> Column:
    """A coarse topic by form: listing, markup, note or prose."""
    bars = F.regexp_count(text, F.lit(r"\|"))
    marks = F.regexp_count(text, F.lit(r"[#*$%&<>{}]"))
    n = F.length(text)
    return F.when(bars * 50 > n, "listing").when(marks * 25 > n, "markup").when(n < 400, "note").otherwise("prose")


def measured(docs: DataFrame, topic: Callable[[Column], Column] = topic) -> DataFrame:
    """doc_id, source, lang, topic, tokens (words) of every row; margins as text, null as U+0000."""
    text = text_of(docs)
    values = {"source": docs["source"], "lang": docs["lang"], "topic": topic(text)}
    named = [F.coalesce(v.cast("string"), F.lit("\0")).alias(k) for k, v in values.items()]
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), *named, F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("tokens"))


def _solve(tokens: np.ndarray, rest: np.ndarray, target: float) -> float:
    """The factor f with sum of tokens x min(1, f x rest) = target; infinite if even 1 everywhere is not more."""
    some = (tokens > 0) & (rest > 0)
    t, r = tokens[some], rest[some]
    if target >= t.sum() * (1 - 1e-12):
        return np.inf
    order = np.argsort(-r)  # cells reach their cap in this order
    t, r = t[order], r[order]
    capped = np.concatenate([[0.0], np.cumsum(t)])
    free = np.concatenate([np.cumsum((t * r)[::-1])[::-1], [0.0]])
    for k in range(len(t)):
        f = (target - capped[k]) / free[k]
        if f * r[k] <= 1:
            return max(f, 0.0)
    return np.inf


def targets(sums: dict[str, float], temperature: float = TEMPERATURE, keep: float = KEEP) -> dict[str, float]:
    """Shares to the power of ``temperature``, scaled to ``keep`` of all tokens; what a value has not
    got for its share is spread over the others."""
    total = sum(sums.values())
    names = sorted(k for k, v in sums.items() if v > 0)
    have = np.array([sums[k] for k in names], dtype=float)
    share = (have / total) ** temperature if total else have
    f = _solve(have, share / have, keep * total) if len(names) else 0.0
    met = have if np.isinf(f) else np.minimum(have, f * share)
    return {k: 0.0 for k in sums} | dict(zip(names, met.tolist(), strict=True))


def rake(cells: list[tuple[tuple[str, ...], float]], wanted: list[dict[str, float]]) -> list[float]:
    """The probability of each cell (values, tokens) under one target per margin value."""
    if not cells:
        return []
    tokens = np.array([t for _, t in cells], dtype=float)
    places, goals = [], []
    for m, want in enumerate(wanted):
        names = sorted({values[m] for values, _ in cells})
        place = {x: i for i, x in enumerate(names)}
        places.append(np.array([place[values[m]] for values, _ in cells]))
        goals.append([want.get(x, 0.0) for x in names])
    members = [np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at))[:-1]) for at in places]
    factors = [np.ones(len(goal)) for goal in goals]
    scale = float(np.sum(tokens)) or 1.0
    before = None
    for _ in range(MAX_STEPS):
        for m, goal in enumerate(goals):
            rest = np.ones(len(cells))
            for k, at in enumerate(places):
                if k != m:
                    rest = rest * factors[k][at]
            for i, want in enumerate(goal):
                own = members[m][i]
                f = _solve(tokens[own], rest[own], want)
                factors[m][i] = f if np.isfinite(f) else 1 / max(rest[own].min(initial=1.0), 1e-12)
        p = np.minimum(1.0, np.prod([f[at] for f, at in zip(factors, places, strict=True)], axis=0))
        if before is not None and np.abs((p - before) * tokens).sum() <= TOLERANCE * scale:
            break
        before = p
    return p.tolist()


def _far_goals(sums: DataFrame, total: float) -> DataFrame:
    """``targets`` on a distributed table: the sums of a margin (``have``) with their ``goal``."""
    have = F.col("have")
    share = F.when(have > 0, F.pow(have / F.lit(total or 1.0), F.lit(TEMPERATURE))).otherwise(0.0)
    if KEEP * total >= total * (1 - 1e-12):
        return sums.withColumn("goal", have)
    f = 0.0
    while True:
        full = F.lit(f) * share >= have
        x = sums.filter(have > 0).agg(F.sum(F.when(full, have)).alias("capped"), F.sum(F.when(~full, share)).alias("free")).first()
        after = (KEEP * total - (x["capped"] or 0.0)) / x["free"] if x["free"] else f
        if after <= f * (1 + 1e-12):
            return sums.withColumn("goal", F.least(have, F.lit(f) * share))
        f = after


def _far_factors(cells: DataFrame, tables: dict[str, DataFrame], m: str, start: bool) -> DataFrame:
    """One Newton step for all factors of margin m, and whether each is now exact.

    Kept tokens are concave in a factor and bend where a cell reaches its cap, so a step from anywhere ends
    at or below the factor sought, further ones rise to it, and it is met once no cell changes sides.
    """
    for k in MARGINS:
        cells = cells.join(tables[k].select(k, *([f"f_{k}", f"goal_{k}"] if k == m else [f"f_{k}"])), k)
    rest = F.lit(1.0)
    for k in MARGINS:
        rest = rest * F.col(f"f_{k}") if k != m else rest
    t, r, f = F.col("tokens").cast("double"), F.col("_r"), F.col(f"f_{m}")
    some, full = (t > 0) & (r > 0), f * r >= 1
    sums = cells.withColumn("_r", rest).groupBy(m).agg(
        F.sum(F.when(some, t)).alias("_has"), F.sum(F.when(some, t * r)).alias("_all"), F.min(r).alias("_least"),
        F.sum(F.when(some & full, t)).alias("_capped"), F.sum(F.when(some & ~full, t * r)).alias("_free"),
        F.min(F.when(some & full, r)).alias("_low"), F.max(F.when(some & ~full, r)).alias("_high"),
    )
    goal, zero = F.col(f"goal_{m}"), F.lit(0.0)
    everything = goal >= F.coalesce("_has", zero) * (1 - 1e-12)
    newton = F.greatest((goal - F.coalesce("_capped", zero)) / F.col("_free"), goal / F.col("_all"))
    after = F.when(everything, 1 / F.greatest(F.least("_least", F.lit(1.0)), F.lit(1e-12))).otherwise(newton)
    sure = (F.coalesce(F.col("_after") * F.col("_low"), F.lit(1.0)) >= 1 - 1e-12) & (F.coalesce(F.col("_after") * F.col("_high"), F.lit(1.0)) <= 1 + 1e-12)
    before = F.col(f"f_{m}" if start else f"old_{m}")
    found = tables[m].join(sums, m).withColumn("_after", after).withColumn("sure", everything | sure)
    return found.select(m, f"goal_{m}", F.col("_after").alias(f"f_{m}"), before.alias(f"old_{m}"), "sure")


def _rake_far(cells: DataFrame, steps: int | None = None) -> DataFrame:
    """``rake`` to ``targets`` on a distributed table: the same targets, steps and stop.

    The factors of a margin are a table of their own, in files that go when the next ones are written.
    """
    spark = cells.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/rake-{uuid.uuid4().hex}"
    files, number, paths = Files(spark, folder), count(), {}

    def put(m: str, table: DataFrame) -> DataFrame:
        path, before = f"{folder}/{next(number)}", paths.get(m)
        table.write.parquet(path)
        if before:
            files.delete(before)
        paths[m] = path
        return spark.read.schema(table.schema).parquet(path)

    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    tables = {}
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
        one = F.lit(1.0)
        tables[m] = put(m, _far_goals(sums, total).select(m, F.col("goal").alias(f"goal_{m}"), one.alias(f"f_{m}"), one.alias(f"old_{m}"), F.lit(True).alias("sure")))

    def p(kind: str) -> Column:
        out = F.lit(1.0)
        for m in MARGINS:
            out = out * F.col(f"{kind}_{m}")
        return F.least(F.lit(1.0), out)

    def joined() -> DataFrame:
        out = cells
        for m in MARGINS:
            out = out.join(tables[m].select(m, f"f_{m}", f"old_{m}"), m)
        return out

    for step in range(MAX_STEPS if steps is None else steps):
        for m in MARGINS:
            start = True
            while start or not tables[m].filter("not sure").isEmpty():
                tables[m] = put(m, _far_factors(cells, tables, m, start))
                start = False
        if step and (joined().agg(F.sum(F.abs(p("f") - p("old")) * F.col("tokens"))).first()[0] or 0.0) <= TOLERANCE * (total or 1.0):
            break
    out = cut(joined().select(*MARGINS, p("f").alias("p")))
    files.delete(folder)
    return out


def _probabilities(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """source, lang, topic, p for every cell of the measured rows; with it the cells whose rows are too many for one task of a join."""
    spark = rows.sparkSession
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    if cells.count() > MAX_CELLS:
        return _rake_far(cells), hot_keys(cells, list(MARGINS), cells.agg(F.sum("docs")).first()[0], "docs")
    found = sorted((tuple(r[m] for m in MARGINS), float(r["tokens"])) for r in cells.collect())
    total = sum(t for _, t in found)
    wanted = []
    for m in range(len(MARGINS)):
        sums: dict[str, float] = {}
        for values, t in found:
            sums[values[m]] = sums.get(values[m], 0.0) + t
        wanted.append(targets(sums))
    p = rake(found, wanted)
    names = {k: pa.array([values[m] for values, _ in found], pa.string()) for m, k in enumerate(MARGINS)}
    return F.broadcast(spark.createDataFrame(pa.table(names | {"p": pa.array(p, pa.float64())}))), None


def probabilities(rows: DataFrame) -> DataFrame:
    """source, lang, topic, p for every cell of the measured rows."""
    return _probabilities(rows)[0]


def _draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    h = F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def sample(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, its cell, tokens, the cell's probability, and whether it is kept."""
    rows = cut(measured(docs))
    cells, hot = _probabilities(rows)
    drawn = spread(rows, cells, list(MARGINS), hot, "doc_id").withColumn("kept", _draw(F.col("doc_id"), seed) < F.col("p"))
    return drawn.select("doc_id", *[F.nullif(m, F.lit("\0")).alias(m) for m in MARGINS], "tokens", F.col("p").alias("probability"), "kept")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents kept, with all their columns."""
    cells, hot = _probabilities(cut(measured(docs)))
    margins = {"source": docs["source"], "lang": docs["lang"], "topic": fenced(topic(text_of(docs)))}
    named = [F.coalesce(v.cast("string"), F.lit("\0")).alias(k) for k, v in margins.items()]
    rows = docs.select(whole(docs).alias("row"), _draw(docs["doc_id"], seed).alias("drawn"), *named)
    return unpacked(spread(rows, cells, list(MARGINS), hot, "drawn").filter("drawn < p"), docs.columns)
