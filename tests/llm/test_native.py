"""Quality rules, exact dedup and personal data against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from chronofold.llm import exact_dedup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog near the river bank today, and nobody minds it.\n"
CLEAN = "".join(f"Line{i} tells of place{i * 7} and river{i * 3}, where man{i} once met friend{i * 5} under tree{i * 11}.\n" for i in range(12))
ODD = [
    None, "", " \n\t", "x", "é😀 a@b.co 4111111111111111", "a b c a b c", "w w w w w", "a b c\n\na b c\n  \n", "a" * 120_000, "1" * 60_000, "a@b" + ".c" * 30_000, "+1" + " " * 30_000,
    "x@y.z.w a@b.c%d@e.f a@b", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3", "4111-1111-1111-1111 5 4111 1111 1111 1112", "+1 (743) 555-3824) +12", "GB82 WEST 1234 5698 7654 32 my ssn 123-45-6789 and then a good way further on in this text, id 123-45-6780",
    CLEAN,
    CLEAN + "Home | News | Sport | About\nCookie policy applies here\nok\n",
    "Home | News | Sport | About | Mail | Help | Jobs | Press | Blog\n" * 3 + " | ".join(f"w{i}" for i in range(60)),
    "".join(f"w{i}%%% x{i}### y{i}&&& " for i in range(40)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, "x", "again"), (None, "x", ""), (None, None, ""), (40, "é", ""), (41, "é", ""), (41, "é", ""), (42, "é ", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)


def texts(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.doc_id].append(r.text or "")
    return found


def measures(t):
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(odd):
    known = texts(odd)
    out = quality.measure(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in [measures(t) for t in known[r.doc_id]]
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {17, 18}


def test_quality_cleaning(odd):
    out = {r.doc_id: r for r in quality.clean(odd).collect()}
    assert set(out) == {17, 18} and out[17].text == ODD[17] and out[17].n_words == "clash"
    assert "Home |" not in out[18].text and "Cookie" not in out[18].text and out[18].text.startswith(ODD[17])
    named = quality.clean(odd.selectExpr("*", "n_words q", "n_words row", "7 n_chars", "n_words `a.b`")).collect()
    assert len(named) == 2 and all(r["q"] == r["row"] == r["a.b"] == "clash" and r["n_chars"] == len(r["text"]) for r in named)
    assert quality.clean(odd.filter("false")).count() == 0 == quality.measure(odd.filter("false")).count()


def test_quality_takes_the_words_once(odd):
    plan = quality.measure(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # words and symbols of each line; counts of matches are extractions too


def test_exact_groups(odd, monkeypatch):
    known = texts(odd)
    members = defaultdict(list)
    for i, many in known.items():
        for t in many:
            members[t].append(i)
    out = exact_dedup.groups(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, many in known.items() for _ in many)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in members}
    kept = Counter()
    for r in out:
        group = members[sha[r.text_sha256]]
        ids = [i for i in group if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids) if ids else None, len(group))
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(members)
    named = odd.selectExpr("*", "n_words _id", "n_words sha", "n_words row", "n_words first", "n_words `a.b`")
    rows = exact_dedup.dedup(named).collect()
    assert len(rows) == len(members) and list(rows[0].asDict()) == named.columns
    assert all(r["n_words"] == r["_id"] == r["sha"] == r["row"] == r["first"] == r["a.b"] for r in rows)
    assert exact_dedup.groups(odd.filter("false")).count() == 0


def test_chunks_cover_the_text(spark):
    for t in ("", "a" * 10_000, PROSE * 100, "é😀\r\n" * 3000):
        df = spark.createDataFrame([(t,)], "text string")
        assert "".join(df.select(exact_dedup.chunks(df["text"]).alias("c")).first().c) == t


def test_clashing_hashes_do_not_merge_texts(spark, monkeypatch):
    """With a hash that never tells chunks apart, texts of one length still differ."""
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(exact_dedup.F.lit(1)))
    rows = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.groups(rows).collect()} == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] if "@" in t else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))] if "." in t else []
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_personal_data(odd):
    known = texts(odd)
    out = pii.digest(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        options = []
        for t in known[r.doc_id]:
            found = base_spans(t)
            text = ",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in found)
            options.append((*[sum(1 for x in found if x[1] == k) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in options
        assert {x for x in r.spans.split(",") if x.partition(":")[0] in pii.BASE} in [{f"{pii.BASE[k]}:{s}:{e}" for s, k, e in base_spans(t)} for t in known[r.doc_id]]
    extra = next(r for r in out if r.doc_id == 16)
    assert extra.spans == "iban:0:27,ssn:35:46" and extra.top_score == pytest.approx(0.8)
    assert pii.digest(odd.filter("false")).count() == 0


def test_iban_ends_where_its_country_says(spark):
    """What follows an IBAN, or comes before it, does not hide it."""
    one, wide = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    rows = [
        f"IBAN {one} Please pay", f"{wide} BIC COBADEFF", f"{one} 12 34", f"BE12 {wide} X", f"{one} {one}", f"{one}X {one}x", "DE88370400440532013000 Pay",
        "NO9386011117947 Ok", "MT84MALT011000012345MTLCAST001S AND MORE", f"{one}. {wide}\nGB82WEST12345698765432 5", "ZZ22370400440532013000 A", "AB12 " * 3000,
    ]
    want = [[(5, 27)], [(0, 27)], [(0, 22)], [(5, 32)], [(0, 22), (23, 45)], [], [], [(0, 15)], [(0, 31)], [(0, 22), (24, 51), (52, 74)], [(0, 22)], []]
    out = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()}
    for i, spans in enumerate(want):
        got = [x for x in out[i].split(",") if x.startswith("iban")]
        assert got == [f"iban:{s}:{e}" for s, e in spans], rows[i][:60]


def test_many_matches_in_one_text(spark):
    """Time and places hold for very many matches; contexts reach over short matches and gaps."""
    many = "".join(f"write to u{i}@h{i}.org, " for i in range(16_000))
    rows = [(1, many), (2, "ssn: 123-45-6789, 123-45-6780 " + "x" * 60 + " 123-45-6781"), (3, "GB82 WEST 1234 5698 7654 32, " * 700)]
    out = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = ",".join(f"email:{s}:{e}" for s, _, e in base_spans(many))
    assert out[1].spans == want and out[1].n_email == 16_000
    assert out[2].spans == "ssn:5:16,ssn:18:29"
    assert out[3].spans == ",".join(f"iban:{29 * i}:{29 * i + 27}" for i in range(700))


def test_context_is_the_text_before(spark):
    """A context word counts within the reach, over other matches, and nowhere else."""
    rows, want = [], []
    for gap in range(0, 60, 3):
        t = f"ssn {'.' * gap} 123-45-6789"
        rows.append((len(rows), t))
        want.append("ssn" in t[max(0, t.index("1") - pii.REACH) : t.index("1")])
        t = f"ssn 1.2.3.4 {'-' * (gap // 6)} 900-12-3456 {'.' * (gap // 2)} 123-45-6789"
        rows.append((len(rows), t))
        want.append("ssn" in t[max(0, t.index("123-") - pii.REACH) : t.index("123-")])
    out = {r.doc_id: "ssn:" in r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(rows))] == want
