"""Language, toxicity, secrets and pieces: held-out accuracy, brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import os
import random
import re
import tracemalloc
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from chronofold.llm import language, pieces, secrets, toxicity
from chronofold.llm.queries import TOKENIZER
from chronofold.llm.workers import returning

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = "doc_id long, text string, lang string, source string, score string"
ROWS = [(1, None, "en", "s", "x"), (2, "", None, "s", "x"), (2, "123 !?", "en", "s", "x"), (None, "the of and", "en", None, None), (4, "le la les " * 60_000, "fr", "s", ""), (5, "\0", "de", "s", "")]


@tables
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    right = {r.doc_id: r.lang for r in docs.collect()}
    out = language.identify(docs).collect()
    assert len(out) == len(right) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == right[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    out = [(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()]
    assert len(out) == 6 and (1, "und") in out and out.count((2, "und")) == 2 and (5, "und") in out
    assert language.identify(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null")).collect()} <= {"und", ""}


def test_language_grams():
    """Counts of hashed grams against a loop."""
    table = language._letters()
    grams, starts, has = language._grams(["Ab1", "", "é"], table)
    assert has.tolist() == [True, False, True] and starts.tolist() == [0, 6, 9]
    assert [(g[:6] < language.BUCKETS).sum() for g in grams] == [3, 2, 1]
    again, _, _ = language._grams(["x", "ab "], table)
    assert [g[0] for g in grams] == [g[4] for g in again]


def plain_grams(text):
    """Buckets of the 1- to 3-grams of a text, by loops."""
    low = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    low = [0 if o == "\0" else c for o, c in zip(text.lower(), low, strict=True)]
    out = []
    for i in range(len(low)):
        h = 0
        for order in (1, 2, 3):
            if i + order > len(low) or 0 in low[i : i + order]:
                break
            h = (h * 0x01000193 + low[i + order - 1] + order) & 0xFFFFFFFF
            out.append((((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 17)
    return out


def test_language_scores_against_loops(spark):
    """Naive Bayes with priors, worked out document by document."""
    rng = random.Random(4)
    words = {"en": "the of and house river", "de": "der die und haus fluss", "fr": "le la et maison fleuve"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "!", " é1\0x"]), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], [6, 3, 1], k=150))]
    rows += [(200 + i, rng.choice(["a", "un der", "i e", "xyz", "r\0f"]), None) for i in range(20)]
    counts, docs = {}, {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            docs[lang] = docs.get(lang, 0) + 1
            for g in plain_grams(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    n = language.BUCKETS
    for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.5 * n
            logs[lang] = np.log((docs[lang] + 0.5) / (sum(docs.values()) + 0.5 * len(docs))) + sum(np.log((c.get(g, 0) + 0.5) / total) for g in plain_grams(text))
        top = max(logs.values())
        p = {lang: np.exp(x - top) for lang, x in logs.items()}
        best = max(sorted(p), key=p.get)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == best and r.score == pytest.approx(p[best] / sum(p.values()), rel=1e-3)


def test_language_values_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([(i, "abc", f"l{i % 5}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.identify(rows)


@tables
def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    right = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in toxicity.detect(docs, labels).collect() if r.held_out and r.doc_id in right]
    caught = sum(r.predicted for r in out if right[r.doc_id])
    assert caught >= 0.7 * sum(right[r.doc_id] for r in out) and not any(r.predicted for r in out if not right[r.doc_id])


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 2.0, "moro*": 1.0})
    weigh = lambda t: round(float(np.expm1(g.features(t)[0])), 3)
    assert weigh("you idiot") == 3.0 and weigh("the idiot") == 2.0 and weigh("morons") == 1.0 and weigh("moron") == 1.0
    assert weigh("not an idiot") == 0.6 and weigh("she said he is an idiot") == 1.5 and weigh("she said no. an idiot") == 2.0
    assert weigh("kill you") == 3.0 and weigh("kill time") == 0 and weigh("") == 0
    brute = g.clause(g.classify(["you", "x", "y", "z", "idiot"]))
    assert brute == 2.0


def plain_clause(classes):
    """The rules, one word at a time, by looking back."""
    total = 0.0
    for i, (c, weight) in enumerate(classes):
        near = {x for x, _ in classes[max(0, i - toxicity.NEAR) : i]}
        scale = (toxicity.NEGATED if toxicity.NEGATION in near else 1) * (toxicity.REPORTED if any(x == toxicity.REPORT for x, _ in classes[:i]) else 1)
        if c == toxicity.INSULT:
            total += weight * scale * (toxicity.TARGETED if toxicity.TARGET in near else 1)
        elif c == toxicity.TARGET and toxicity.THREAT in near:
            total += toxicity.THREAT_WEIGHT * scale
    return total


def test_toxicity_grammar_against_looking_back():
    g, rng = toxicity.Grammar({}), random.Random(12)
    assert len(toxicity.grammar()) <= (toxicity.NEAR + 1) ** 3 * 2
    for _ in range(3000):
        drawn = [rng.randrange(6) for _ in range(rng.randrange(14))]
        classes = [(c, 1.0 + k % 3 if c == toxicity.INSULT else 0.0) for k, c in enumerate(drawn)]
        assert g.clause(classes) == pytest.approx(plain_clause(classes))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.detect(docs, none).collect()
    assert len(out) == 6 and not any(r.predicted for r in out)
    some = spark.createDataFrame([(1, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert toxicity.detect(docs, some).count() == 6 and toxicity.detect(docs.filter("false"), some).count() == 0


def test_toxicity_sample_holds_an_id_once(spark):
    many, lone, empty = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(many, f"text {i}", i) for i in range(300)] + [(lone, "other", 1), (empty, None, 1), (500, "unlabelled", 1), (None, "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(many, 0), (many, 1), (lone, 0), (empty, 1), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = toxicity._sample(docs, labels).collect()
    assert sorted((r.doc_id, r.text, r.toxic) for r in got) == sorted([(many, "text 99", 1), (lone, "other", 0), (empty, "", 1)])


SECRET = 'token = "abcdef123456"'


def test_secrets_under_layers():
    rules = secrets.Rules()
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    quote, escape = urllib.parse.quote, "".join(f"\\u{ord(c):04x}" for c in SECRET)
    for wrapped in (quote(SECRET), quote(quote(SECRET)), b64(SECRET), b64(b64(SECRET)), b64(zlib.compress(SECRET.encode())), b64(gzip.compress(SECRET.encode())), escape, b64(quote(SECRET)), quote(b64(SECRET)), b64(escape), base64.urlsafe_b64encode(SECRET.encode()).decode()):
        text = f"héé {wrapped} and {wrapped} end"
        base, spans, layers = rules.find(text)
        assert not base and layers > 2
        assert [k for _, k, _ in spans] == [0, 0] and all(text[s:e] in wrapped and e - s >= 20 for s, _, e in spans), wrapped
    assert rules.find(f"x {SECRET}")[0] == rules.find(f"x {SECRET}")[1] == [(2, 0, 23)]


def test_secrets_in_text_that_begins_like_zlib():
    rules = secrets.Rules()
    for inner in ("x-auth-token: abcdef123456", "xoxb config password=abcdef123456", "x^ token=abcdef123456", "xml " + base64.b64encode(SECRET.encode()).decode()):
        text = f"see {base64.b64encode(inner.encode()).decode()} end"
        base, spans, _ = rules.find(text)
        assert not base and [k for _, k, _ in spans] == [0], inner


def test_secrets_under_shifted_and_wrapped_base64():
    rules = secrets.Rules()
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    noise = random.Random(8)
    long = "".join(noise.choice("bcdfgh \n") for _ in range(400)) + SECRET + "".join(noise.choice("bcdfgh \n") for _ in range(400))
    for inner in (SECRET, b64(SECRET), zlib.compress(SECRET.encode()), gzip.compress(SECRET.encode()), f"a\u00a0b {SECRET}", f"\u200b{SECRET}\0", b"\xff" + SECRET.encode()):
        for before in ("ex.com/cb/", "blob_", "id-", "x", "xy", "abc", "/////"):
            text = f"héé {before}{b64(inner)} end"
            base, spans, _ = rules.find(text)
            assert not base and [k for _, k, _ in spans] == [0], (inner, before)
            assert all(4 <= s and e <= len(text) - 4 for s, _, e in spans)
    for inner in (long, gzip.compress(long.encode())):
        for width, end in ((64, "\n"), (76, "\r\n"), (64, "\n    ")):
            one = b64(inner)
            text = "héé " + end.join(one[i : i + width] for i in range(0, len(one), width)) + " end"
            base, spans, _ = rules.find(text)
            assert not base and [k for _, k, _ in spans] == [0], (width, end)
    assert rules.find("A" * 50_000 + "\n" + "x" * 50_000 + "\n" * 50_000)[1] == []


def test_secrets_in_large_and_many_members(monkeypatch):
    rules = secrets.Rules()
    b64 = lambda x: base64.b64encode(x).decode()
    secret, noise = SECRET.encode(), random.Random(9)
    log = b"line of a log, nothing here\n" * 700_000
    members = gzip.compress(b"first\n") + gzip.compress(secret) + gzip.compress(b"last\n")
    for raw in (gzip.compress(log + secret), zlib.compress(log + secret + log), members, gzip.compress(b"\xff\0 " + secret), gzip.compress(bytes(3_000_000) + secret), gzip.compress(secret + b"\n" + log)[:-9]):
        base, spans, _ = rules.find(f"see {b64(raw)} end")
        assert not base and [k for _, k, _ in spans] == [0]
    monkeypatch.setattr(secrets, "WINDOW", 100, raising=False)
    monkeypatch.setattr(secrets, "PART", 16, raising=False)
    inner = b64(gzip.compress(noise.randbytes(300) + b" " + secret))
    wrapped = "\n".join(inner[i : i + 64] for i in range(0, len(inner), 64)).encode()
    for held in (secret, b"token   =    abcdef123456", inner.encode(), wrapped, b"x" * 500 + b" " + secret):
        for before in range(0, 240, 7):
            text = f"see {b64(gzip.compress(b'some log ' * 9 + b'ab cd e '[: before % 8] + b'w ' * before + held + b' more words' * 60))} end"
            assert [k for _, k, _ in rules.find(text)[1]] == [0], (held, before)


def test_secrets_hold_few_bytes_for_a_character():
    text = base64.b64encode(b"plain words " * 80_000 + SECRET.encode()).decode()
    tracemalloc.start()
    try:
        spans = secrets.Rules().find(text)[1]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [k for _, k, _ in spans] == [0] and most < 60 * len(text)


def test_secrets_end_and_stay_quiet():
    rules = secrets.Rules()
    loop = "%2525" * 2000 + " " + "%41" * 20_000
    for text in ("", "plain words", "100%zz %4", loop, "g" * 200_000, "\\u12 \\ud800", "%ff%fe"):
        base, spans, _ = rules.find(text)
        assert base == [] and len(spans) <= 1


def test_secrets_base_against_loops(spark):
    random.seed(2)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc", "DEF123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef00", "\n", "ſecret", "-._/+"]
    pattern = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({pattern})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 30)))) for i in range(400)] + [(None, None)]
    out = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want = sorted(want + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        assert set(secrets.joined(want).split(",")) - {""} <= set(out[i].spans.split(","))
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(1 for x in want if x[1] == k) for k in range(3))


def test_secrets_odd_rows(spark):
    rows = [(1, SECRET, 7, "a"), (1, SECRET, 7, "a"), (1, None, 7, "b"), (None, SECRET, 7, None), (2, "", 7, ""), (3, "x " * 300_000 + SECRET, 7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, n_hex string").selectExpr("*", "spans base", "spans `a.b`")
    out = secrets.find(docs)
    got = sorted((r.doc_id or 0, r.n_assign, r.spans) for r in out.collect())
    assert got == [(0, 1, "assign:0:21"), (1, 0, ""), (1, 1, "assign:0:21"), (1, 1, "assign:0:21"), (2, 0, ""), (3, 1, "assign:600000:600021")]
    assert secrets.find(docs.filter("false")).count() == 0 and secrets.find(docs.filter("false")).columns == out.columns


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer model")
def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor

    class Folding:
        """A model that normalises what it encodes, as many do."""

        def __init__(self, model_file):
            self.model = real(model_file=model_file)

        def __getattr__(self, name):
            return getattr(self.model, name)

        def encode(self, text):
            return self.model.encode(" ".join(text.split()))

    assert pieces.load(TOKENIZER)["octets"]
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="leaves texts as they are"):
        pieces.load(TOKENIZER)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer model")
def test_pieces_are_the_models_own(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    random.seed(3)
    alphabet = "abcdeth in  ▁.,éß漢😀\n\t<>0x1"
    rows = ["", " ", "  a  b\n\nc ", "a\0b", "▁x", "<s>hi</s><0x41>", "é́ ﬁ Ａ", " " * 40, "\n" * 5, "x" * 5000, "the " * 5000]
    rows += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 40))) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(rows), (None, None), (0, "again")], "doc_id long, text string")
    tokens = pieces.encode(df, TOKENIZER)
    out = {r.doc_id: r.ids for r in tokens.filter("n_tokens <> 2 or doc_id is null or doc_id > 0").collect()}
    for i, t in enumerate(rows[1:], 1):
        assert out.get(i, model.encode(t)) == model.encode(t), repr(t)
    back = {r.doc_id: r.text for r in pieces.decode(tokens.filter("doc_id > 0"), TOKENIZER).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(rows) if i)
    sums = {r.doc_id: r for r in pieces.digest(df.filter("doc_id > 0"), TOKENIZER).collect()}
    assert all(sums[i].round_trip == ("▁" not in t) and sums[i].n_tokens == len(model.encode(t)) for i, t in enumerate(rows) if i)
    assert pieces.encode(df.filter("false"), TOKENIZER).count() == 0
    clash = df.selectExpr("*", "text ids", "text n_tokens", "text `a.b`").filter("doc_id = 1")
    assert [r.ids for r in pieces.encode(clash, TOKENIZER).collect()] == [model.encode(rows[1])]


def test_returning_changes_no_batch():
    batches = [pa.record_batch({"x": pa.array([1, None], pa.int64())}), pa.record_batch({"x": pa.array([], pa.int64())})]
    double = returning(lambda found: (pa.record_batch({"x": pc.multiply(b.column("x"), 2)}) for b in found))
    assert [b.to_pydict() for b in double(iter(batches))] == [{"x": [2, None]}, {"x": []}]
    assert list(double(iter([]))) == []
