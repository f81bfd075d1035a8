"""Exact dedup (operator 7): content-defined chunk recipes, DataFrame functions only.

A text is cut where its content says so (after a sentence or line end once a chunk
holds ``MIN_CHUNK`` characters, or at ``MAX_CHUNK``), so equal texts have equal cuts.
Its recipe is the ordered list of (length, hash) of its chunks.

1. Recipes are made where the text lies; only recipes move.
2. Texts whose recipe occurs once are unique: different recipes mean different texts.
3. For the rest, chunks are deduplicated on their bytes.  Texts are chunked again where they lie,
   those that a bit map of the ids tells apart from the rest only; each map task sends a distinct
   chunk once, however many copies hold it.  Chunks alike in length and hash but not in bytes get
   ordinals, so that (length, hash, ordinal) names a chunk's bytes exactly.
4. The ordered lists of these identifiers are compared; equal ones are equal texts.

Results in special cases: null text counts as empty; all empty texts are equal; a null
doc_id ranks below every other; repeated rows (same doc_id and text) each get a row, one
of them kept; a very long text is a long list of chunks, none longer than ``MAX_CHUNK``; an empty
table gives an empty result; extra columns are ignored by ``groups`` and returned untouched by
``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Cuts, Flags, hot_keys, spread, text_of, unpacked, whole

MIN_CHUNK = 512
MAX_CHUNK = 4096


def chunks(text: Column) -> Column:
    """Content-defined chunks; concatenated they are the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _id(name: str) -> Column:
    """A join key that tells null from every id."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _recipes(docs: DataFrame) -> DataFrame:
    df = docs.select("doc_id", text_of(docs).alias("_t"))
    keys = F.transform(chunks(F.col("_t")), lambda c: F.struct(F.length(c).alias("len"), F.xxhash64(c).alias("h")))
    return df.select("doc_id", F.sha2("_t", 256).alias("text_sha256"), keys.alias("recipe"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    cuts = Cuts(docs.sparkSession)
    # Repeated rows fold into one with a count; the id in the key keeps hot texts spread.
    once = _recipes(docs).groupBy("doc_id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("reps"))
    once = cuts(once.withColumn("rkey", F.xxhash64("recipe")))
    shared = cuts(once.groupBy("rkey").agg(F.count(F.lit(1)).alias("count")).filter("count > 1"))
    total = once.count()
    marked = cuts(spread(once, shared, ["rkey"], hot_keys(shared, ["rkey"], total), "doc_id", "left"))
    cuts.free(once, shared)
    unique = marked.filter("count is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("reps").alias("group_size"), "text_sha256", "reps")
    lists = cuts(_identified(docs, marked.filter("count is not null"), cuts))
    keep = cuts(lists.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.sum("reps").alias("group_size"), F.count(F.lit(1)).alias("count")))
    hot = hot_keys(keep, ["ids"], total)
    grouped = spread(lists, keep.drop("count"), ["ids"], hot, "doc_id").select("doc_id", "keep_id", "group_size", "text_sha256", "reps")
    rows = unique.unionByName(grouped).withColumn("_rep", F.explode(F.sequence(F.lit(1).cast("bigint"), "reps")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_rep") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _identified(docs: DataFrame, candidates: DataFrame, cuts: Cuts) -> DataFrame:
    """Candidates with ``ids``: the list of their chunks' identifiers."""
    ids = cuts(candidates.select(_id("doc_id").alias("_id")).distinct())
    text = Flags(ids, "_id").mark(docs.select(_id("doc_id").alias("_id"), text_of(docs).alias("_t")), "_id").filter("_flag").select("_t")
    # A text that only the bit map lets through adds chunks, which cost a little and change nothing.
    distinct = text.select(F.explode(chunks(F.col("_t"))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("uses"))
    named = distinct.select(F.length("chunk").alias("len"), F.xxhash64("chunk").alias("h"), "chunk")
    # Chunks that share length and hash without sharing bytes; none unless a hash collides.
    pairs = cuts(named.groupBy("len", "h").agg(F.count(F.lit(1)).alias("count")).filter("count > 1").select("len", "h"))
    recipe = candidates.select("doc_id", "text_sha256", "reps", "recipe")
    plain = F.transform("recipe", lambda c: F.struct(c["len"].alias("len"), c["h"].alias("h"), F.lit(1).alias("ordinal")))
    if pairs.isEmpty():
        return recipe.select("doc_id", "text_sha256", "reps", plain.alias("ids"))
    # Few chunks, as many as hashes collide; the texts that hold one are read once more, to see which.
    ordinal = F.row_number().over(Window.partitionBy("len", "h").orderBy("chunk"))
    clashes = cuts(named.join(pairs, ["len", "h"]).withColumn("ordinal", ordinal))
    held = docs.select(_id("doc_id").alias("_id"), text_of(docs).alias("_t")).join(ids, "_id", "left_semi")
    pieces = held.select("_id", F.sha2("_t", 256).alias("text_sha256"), F.posexplode(chunks(F.col("_t"))).alias("at", "chunk")).distinct()
    found = pieces.join(clashes, "chunk").groupBy("_id", "text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("at", "ordinal"))).alias("ordinals"))
    numbered = F.transform("recipe", lambda c, i: F.struct(c["len"].alias("len"), c["h"].alias("h"), F.coalesce(F.try_element_at("ordinals", i), F.lit(1)).alias("ordinal")))
    joined = recipe.withColumn("_id", _id("doc_id")).join(found, ["_id", "text_sha256"], "left")
    return joined.select("doc_id", "text_sha256", "reps", numbered.alias("ids"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; only texts of which there may be copies move, to meet the verdict."""
    cuts = Cuts(docs.sparkSession)
    found = cuts(groups(docs).filter("group_size > 1").groupBy(_id("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("stays")))
    rows = docs.select(whole(docs).alias("row"), _id("doc_id").alias("id"), F.sha2(text_of(docs), 256).alias("sha"))
    rows = Flags(found, "id").mark(rows, "id")
    copies = rows.filter("_flag").join(found, ["id", "sha"], "left").filter(F.coalesce("stays", F.lit(True)))
    first = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(0)))
    stay = rows.filter("not _flag").select("row").union(copies.withColumn("first", first).filter("first = 1").select("row"))
    return unpacked(stay, docs.columns)
