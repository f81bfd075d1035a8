"""Personal data (operator 4): DataFrame functions only.

Regular expressions propose spans, validators confirm them, context words nearby
move the score; spans scoring at least ``THRESHOLD`` are reported.

kind   proposal                                   validator            base score
email  local@label(.label)+                       -                    0.9
ip     four dotted numbers                        each at most 255     0.7
card   12+ digits, single blanks or hyphens       12-19 digits, Luhn   0.8
phone  + digit ... digit                          9-15 digits          0.7
iban   country, check digits, 11-30 characters    length, mod 97 = 1   0.8
ssn    ddd-dd-dddd                                area/group/serial    0.3, so it needs a context word

The first four are the base kinds; they always stay, whatever the context says (their
score is never below the threshold).  A context word within ``REACH`` characters before
the span adds ``BONUS``.

Time is linear in the length of a text, in its longest run and, but for blocks of ``BLOCK``, in its
matches: places are running sums over what lies between matches, and the context of a match is put
together from the ends of the pieces before it.

The patterns are written with possessive quantifiers and a look-behind or ``\\G`` that only
lets a match begin where the leftmost match can begin.  That changes no match; it keeps
the time linear on very long runs and needs no stack.  The proposal for an IBAN takes in what
follows it (blanks join words); the IBAN is the beginning of it that has the country's length,
or for a country not listed any length from 15 to 34, ends where a word does and passes.

Special cases: null text counts as empty and has no spans (the digest is that of the empty
string); each input row gives one output row, repeated ids too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import fenced, let, text_of

THRESHOLD = 0.5
BONUS = 0.3
REACH = 40
#: Matches that a running array is grown by one after another; blocks of them are then joined.
BLOCK = 128
#: A context reaches over so many earlier matches at most, as none is shorter than four characters.
EARLIER = REACH // 4

_LOCAL = r"A-Za-z0-9._%+-"
# Proposal patterns and the characters a text must hold for each to match.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write to"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, "ip|host|server|address"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,}+", None, 0.8, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile"),
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", None, 0.8, "iban|account|bank|konto"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security|tax id"),
}
BASE = ("email", "ip", "card", "phone")

#: Characters of an IBAN by country; codes not listed may have any length of ``IBAN_LENGTHS``.
IBAN_COUNTRIES = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18
FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24
SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30
""".split()
IBAN_LENGTHS = (15, 34)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(total: Column, i: Column) -> Column:
        v = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(v < 65, (total * 10 + v - 48) % 97).otherwise((total * 100 + v - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def _iban(run: Column) -> Column:
    """The longest beginning of the run that ends where a word does and is an IBAN, or null."""
    known = F.create_map(*[F.lit(x) for c in IBAN_COUNTRIES for x in (c[:2], int(c[2:]))])
    least, most = (F.lit(n) for n in IBAN_LENGTHS)
    length = F.try_element_at(known, F.substring(run, 1, 2))
    head = lambda n: F.regexp_substr(run, F.concat(F.lit(r"^(?:\x20?[A-Z0-9]){"), n.cast("string"), F.lit(r"}(?![A-Za-z0-9])")))
    heads = F.transform(F.when(length.isNotNull(), F.array(length)).otherwise(F.sequence(least, most)), head)
    return F.try_element_at(F.filter(heads, lambda h: h.isNotNull() & _mod97(h)), F.lit(-1))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _spans(t: Column, kind: str) -> Column:
    """Array of (s, e, score), ends exclusive, in code points."""
    pattern, needs, base, words = KINDS[kind]
    may = (F.instr(t, needs) > 0) if needs else t.rlike("[0-9][\\x20-]?[0-9]")

    def gaps(m: Column) -> Column:
        """What lies before each match."""
        return F.slice(F.split(t, pattern, -1), F.lit(1), F.size(m))

    def contexts(m: Column, g: Column) -> Column:
        """The end of the text before each match, ``REACH`` characters at most."""
        end = lambda x: F.right(x, F.lit(REACH))
        used = lambda x: F.left(x, F.lit(4)) if kind == "iban" else x
        before = F.transform(g, lambda x, i: F.concat(F.when(i > 0, end(used(F.get(m, i - 1)))).otherwise(F.lit("")), end(x)))
        first = lambda i: F.greatest(i - EARLIER, F.lit(0)) + 1
        return let(before, lambda p: F.transform(p, lambda _, i: end(F.array_join(F.slice(p, first(i), i + 2 - first(i)), ""))))

    def ends(m: Column, g: Column) -> Column:
        """End k sums gaps and matches up to k."""
        lengths = F.zip_with(g, m, lambda x, y: F.length(x) + taken(y))
        grow = lambda r, n: F.struct((r["at"] + n).alias("at"), F.concat(r["out"], F.array(r["at"] + n)).alias("out"))
        return _scanned(lengths, "int", grow)

    def taken(x: Column) -> Column:
        """What a match uses up; that of an IBAN is its first four characters, so that runs may overlap."""
        return F.lit(4) if kind == "iban" else F.length(x)

    def scored(x: Column, end: Column, before: Column) -> Column:
        if kind == "iban":
            return let(_iban(x), lambda y: placed(F.coalesce(y, F.lit("")), end - taken(x), y.isNotNull(), before))
        return placed(x, end - taken(x), _valid(kind, x), before)

    def placed(x: Column, start: Column, valid: Column, before: Column) -> Column:
        near = before.rlike(rf"(?i)\b(?:{words})")
        score = F.least(F.lit(1.0), F.lit(base) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0)))
        return F.struct(start.alias("s"), (start + F.length(x)).alias("e"), F.when(valid, score).otherwise(F.lit(0.0)).alias("score"))

    def all_scored(m: Column) -> Column:
        return let(gaps(m), lambda g: let(ends(m, g), lambda e: let(contexts(m, g), lambda c: F.transform(m, lambda x, i: scored(x, F.get(e, i), F.get(c, i))))))

    matches = F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(1 if kind == "iban" else 0)))
    found = F.filter(let(matches, lambda m: F.when(F.size(m) > 0, all_scored(m))), lambda x: x["score"] >= THRESHOLD)
    shape = "struct<s:int,e:int,score:double>"
    if kind == "iban":  # of overlapping ones the first stays
        grow = lambda r, x: F.when(r["at"] <= x["s"], F.struct(x["e"].alias("at"), F.concat(r["out"], F.array(x)).alias("out"))).otherwise(r)
        found = let(found, lambda x: _scanned(x, shape, grow))
    return F.coalesce(found, F.array().cast(f"array<{shape}>"))


def _scanned(items: Column, shape: str, grow: Callable[[Column, Column], Column]) -> Column:
    """The array ``out`` of a state (at int, out) that ``grow`` carries over the items, from 0 and nothing."""
    none = F.array().cast(f"array<{shape}>")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))

    def block(x: Column, r: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(x, b, F.lit(BLOCK)), state(r["at"], none), grow)
        return let(own, lambda o: state(o["at"], F.concat(r["out"], o["out"])))

    blocks = lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), state(F.lit(0), none), lambda r, b: block(x, r, b))
    return let(items, lambda x: F.when(F.size(x) > 0, blocks(x)["out"]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and one array of (s, e, score) per kind."""
    t = text_of(docs)
    return docs.select("doc_id", *[fenced(_spans(t, kind)).alias(kind) for kind in KINDS])


def _joined(kinds: tuple[str, ...]) -> Column:
    def tagged(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("n"), x["e"].alias("e"), F.lit(kind).alias("k")))

    ranked = [tagged(n, kind) for n, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*ranked)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans joined, and the highest score."""
    found = find(docs)
    top = F.array_max(F.concat(*[F.transform(k, lambda x: x["score"]) for k in KINDS]))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(tuple(KINDS)).alias("spans"),
        F.coalesce(top, F.lit(0.0)).alias("top_score"),
    )
