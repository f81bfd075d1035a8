"""Quality rules (operator 10): line-first cleaning, DataFrame functions only.

Every line is judged by itself; failing lines are removed; a document goes when
the base repetition/length rule fails or when removal takes too much of its text.

Line rules, on lines that hold a word (blank lines are kept and cost nothing):
  navigation   at least ``NAV_BARS`` bar separators and one for every four words
  symbols      more than one symbol of ``[#*$%&|<>]`` for every two words
  boilerplate  one of the fixed phrases below, in a line of at most ``BOILER_WORDS`` words
  punctuation  fewer than ``SHORT_WORDS`` words and no closing punctuation mark

Results in special cases: a null or empty text has no words, so it fails the base
rule; repeated rows and equal or null ids give one output row per input row; a
very long text is judged whole, with a few numbers kept per word; an empty table
gives an empty result; other columns of the input are ignored by
``measure`` and returned untouched by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import WORD, fenced, let, text_of, unpacked, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
NAV_BARS = 3
BOILER_WORDS = 40
SHORT_WORDS = 3
SYMBOLS = r"[#*$%&|<>]"

# Phrases that mark page furniture.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "javascript is disabled", "subscribe to our newsletter", "lorem ipsum",
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lines(text: Column) -> Column:
    """Each line with its words and its number of symbols, taken once: a lambda works out anew what it names twice."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), _words(x).alias("words"), F.regexp_count(x, F.lit(SYMBOLS)).alias("symbols")))


def _line_fails(x: Column) -> Column:
    line, words, symbols = x["line"], F.size(x["words"]), x["symbols"]
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    closed = F.rtrim(line).rlike(r"[.!?:;,…»\"'”’)\]。！？]\s*$")
    boiler = line.rlike("(?i)" + "|".join(BOILERPLATE))
    return (words > 0) & (
        ((bars >= NAV_BARS) & (bars * 4 >= words))
        | (symbols * 2 > words)
        | ((words <= BOILER_WORDS) & boiler)
        | ((words < SHORT_WORDS) & ~closed)
    )


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))


def _repeat_words(words: Column) -> Column:
    """Word positions covered by 3-word windows that occur twice or more.

    Windows are 64-bit hashes of the three words, sorted with their positions so that equal
    windows stand side by side: n log n work inside one row, no shuffle.
    """

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, made)

    def ordered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)

    def positions(o: Column) -> Column:
        def again(e: Column, k: Column) -> Column:
            before, after = F.get(o, k - 1)["h"] == e["h"], F.get(o, k + 1)["h"] == e["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(o, again), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    count = let(words, lambda w: let(windows(w), lambda h: let(ordered(h), lambda o: let(positions(o), covered))))
    return F.coalesce(count, F.lit(0)).cast("bigint")


def _judged(text: Column) -> Column:
    """One struct with every measure of a text, its good lines and the verdict."""

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _chars(w).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column, good: Column) -> Column:
        lines, wordy = x["line"], F.filter(x, lambda e: F.size(e["words"]) > 0)["line"]
        repeats = let(wordy, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(
            repeats.cast("bigint").alias("n_dup_lines"),
            (F.size(lines) - F.size(good)).cast("bigint").alias("n_bad_lines"),
            _chars(lines).alias("all_chars"),
            (_chars(lines) - _chars(good)).alias("lost_chars"),
            good.alias("good"),
        )

    def of_text(x: Column) -> Column:
        lines = let(F.filter(x, lambda e: ~_line_fails(e))["line"], lambda good: of_lines(x, good))
        symbols = F.aggregate(x["symbols"], F.lit(0).cast("bigint"), lambda a, n: a + n)
        return F.struct(let(F.flatten(x["words"]), of_words).alias("w"), lines.alias("l"), symbols.alias("n_symbols"))

    return let(_lines(text), of_text)  # a line end is no part of a word, so the lines' words are the text's


def _base_failed(q: Column) -> Column:
    w = q["w"]
    return (w["n_words"] < MIN_WORDS) | (w["n_repeat_words"] * 100 > w["n_words"] * MAX_REPEAT_PERCENT)


def _kept(q: Column) -> Column:
    return ~_base_failed(q) & (q["l"]["lost_chars"] * 100 <= q["l"]["all_chars"] * MAX_LOST_PERCENT)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with the base measures, what the line rules remove, and the verdict."""
    df = docs.select("doc_id", fenced(_judged(text_of(docs))).alias("q"))
    q = F.col("q")
    return df.select(
        "doc_id",
        *[q["w"][n].alias(n) for n in ("n_words", "word_chars")],
        q["n_symbols"].alias("n_symbols"),
        q["l"]["n_dup_lines"].alias("n_dup_lines"),
        q["w"]["n_repeat_words"].alias("n_repeat_words"),
        _base_failed(q).alias("base_failed"),
        _kept(q).alias("kept"),
        q["l"]["n_bad_lines"].alias("n_bad_lines"),
        q["l"]["lost_chars"].alias("lost_chars"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, failing lines removed from their text, all columns as they came.

    ``n_chars`` follows the text where the input has it.
    """
    df = docs.select(whole(docs).alias("row"), fenced(_judged(text_of(docs))).alias("q"))
    q = F.col("q")
    text = F.array_join(q["l"]["good"], "\n")
    replaced = {"text": text}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpacked(df.filter(_kept(q)), docs.columns, **replaced)
