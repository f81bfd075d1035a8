"""Near-dedup, mixing, WARC and the pipeline against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronofold.llm import mixing, near_dedup, warc

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """doc_id -> smallest reachable doc_id."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many if i is not None and s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows():
    """Two overlapping families of edited copies in every degree, chains, copies, short and empty texts."""
    rng = random.Random(5)
    base, other = [f"w{rng.randrange(4000)}" for _ in range(150)], [f"v{rng.randrange(4000)}" for _ in range(150)]
    rows = [(1000 + i, edited(rng, base, rng.randrange(8))) for i in range(120)] + [(2000 + i, edited(rng, base[:75] + other[75:], rng.randrange(5))) for i in range(60)]
    chain = base[:]
    for i in range(40):
        chain[(i * 5) % 150] = f"c{i}"
        rows.append((3000 + i, " ".join(chain)))
    rows += [(10, "A b C d e f"), (11, "a B c D e F"), (12, "a b c"), (13, "A B\nC"), (14, "a b"), (15, None), (16, ""), (17, " \n"), (18, "one"), (19, "ONE"), (20, "É a b c d"), (21, "é a b c d")]
    rows += [(5, " ".join(base)), (6, " ".join(base).upper())] + [(7, "x y z"), (7, "x y z"), (None, "a b c"), (None, None)]
    long = [f"l{rng.randrange(10**6)}" for _ in range(30_000)]
    return rows + [(30, " ".join(long)), (31, edited(rng, long, 300)), (32, edited(rng, long, 1500))]


def test_near_copies_against_brute_force(spark):
    rows = family_rows()
    want = brute_components(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(5)
    df = df.selectExpr("*", "component row", "component id", "component `a.b`")
    out = near_dedup.groups(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i is None or want[i] == i)
    assert near_dedup.groups(df.filter("false")).count() == 0


def just_apart(n, words=300, seed=9):
    """n edited copies of one text, most pairs of them just below the threshold, and some near copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for j in rng.sample(range(0, words, 6), 3):  # each edit changes five shingles
            own[j] = f"e{i}.{j}"
        rows.append((i, " ".join(own)))
    return rows + [(n + i, rows[i][1] + " more words here") for i in range(0, n, 9)]


def test_halving_loses_no_link(spark, monkeypatch):
    """Groups go down to pairs of members: what the centres, hubs and prefixes leave out has no links."""
    rng = random.Random(21)
    rows = just_apart(70) + [(5000 + i, t) for i, t in family_rows() if i is not None and t]
    part = [f"p{k}" for k in range(200)]
    for k in range(60):  # families within families: halves share edits
        own = list(part)
        for level in range(5):
            own[level * 20 + (k >> level) % 2] = f"s{level}.{(k >> level) % 2}"
        own[100 + rng.randrange(100)] = f"u{k}"
        own[100 + rng.randrange(100)] = f"v{k}"
        rows.append((9000 + k, " ".join(own)))
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for members in (2, 8):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        assert {r.doc_id: r.component_id for r in near_dedup.groups(df).collect()} == want


def test_members_just_apart_meet_in_proportion(spark, monkeypatch):
    """Rows of groups beyond the first grow with a family of unlike edited copies, not with its square."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 64)
    met = {}
    halved = near_dedup._halved

    def counted(compared, found, cuts):
        members = halved(compared, found, cuts)
        met[n] = met.get(n, 0) + compared.count() + members.count()
        return members

    monkeypatch.setattr(near_dedup, "_halved", counted)
    for n in (100, 200, 400):
        rows = just_apart(n)
        got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert met[200] <= 2.6 * met[100] and met[400] <= 2.6 * met[200]


def test_sketches_estimate_similarity():
    """The share of equal coordinates follows the Jaccard similarity, and every coordinate fills for sets of any size."""
    k, rng = near_dedup.Sketcher(), np.random.default_rng(1)
    for n in (1, 2, 7, 40, 400):
        pool = rng.integers(0, 1 << 63, size=3 * n, dtype=np.uint64)
        a, b = np.unique(pool[: 2 * n]), np.unique(pool[n:])
        s = k.sketches([a, b])
        assert (s != np.iinfo(np.uint64).max).all()
        assert (s == k.sketches([b, a])[::-1]).all()
    same = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, size=115, dtype=np.uint64)
        s = k.sketches([np.unique(pool[:100]), np.unique(pool[15:])])
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - 85 / 115) < 0.03


def test_bounds_hold():
    k, rng = near_dedup.Sketcher(), random.Random(3)
    for _ in range(200):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 80))]
        a, b = k.shingles([" ".join(base).encode(), edited(rng, base, rng.randrange(9)).encode()])
        assert near_dedup._most(near_dedup._bits(a), len(a), near_dedup._bits(b), len(b)) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("links_a_task", [1 << 18, 16])
def test_components(spark, monkeypatch, links_a_task):
    monkeypatch.setattr(near_dedup, "LINKS", links_a_task)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    up = {x: x for e in links for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {i: top(i) for i in up if i != top(i)}


def test_raking_meets_its_margins():
    rng = random.Random(4)
    cells = [((s, l, t), float(rng.randrange(1, 1000))) for s in "abcde" for l in "xyz" for t in "pq" if rng.random() < 0.9]
    wanted = [mixing.targets(_sums(cells, m)) for m in range(3)]
    p = mixing.rake(cells, wanted)
    assert all(0 <= x <= 1 for x in p)
    for m in range(3):
        for name, want in wanted[m].items():
            assert sum(t * x for (v, t), x in zip(cells, p, strict=True) if v[m] == name) == pytest.approx(want, rel=1e-4)
    plain = np.full(len(cells), 0.5)  # plain proportional fitting, where no cap binds
    for _ in range(3000):
        for m in range(3):
            for name, want in wanted[m].items():
                at = [i for i, (v, _) in enumerate(cells) if v[m] == name]
                plain[at] *= want / sum(cells[i][1] * plain[i] for i in at)
    if plain.max() <= 1:
        assert np.allclose(plain, p, atol=1e-3)


def _sums(cells, m):
    out = Counter()
    for v, t in cells:
        out[v[m]] += t
    return dict(out)


def test_targets_give_what_is_missing_to_others():
    got = mixing.targets({"a": 1.0, "b": 99.0, "c": 0.0}, temperature=0.1, keep=0.5)
    assert got["a"] == 1.0 and got["b"] == pytest.approx(49.0) and got["c"] == 0.0
    assert mixing.targets({}) == {} and mixing.rake([], [{}, {}, {}]) == []


def test_mixing_rows(spark):
    rows = [(i, f"word{i} " * (i % 40), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else "s0", 1) for i in range(3000)] + [(None, None, None, None, 1), (7, "x", "en", "s3", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p int").selectExpr("*", "p row", "p topic", "p drawn")
    out = mixing.sample(df).collect()
    assert len(out) == len(rows) and sum(r.tokens for r in out) == sum(len((t or "").split()) for _, t, *_ in rows)
    by = defaultdict(lambda: [0.0, 0, 0])
    for r in out:
        b = by[r.source]
        b[0], b[1], b[2] = b[0] + r.tokens * r.probability, b[1] + r.tokens * r.kept, b[2] + r.tokens
    goals = mixing.targets({k or "\0": v[2] for k, v in by.items()})
    for k, (expected, kept, _) in by.items():
        assert expected == pytest.approx(goals[k or "\0"], rel=1e-3, abs=1) and kept == pytest.approx(expected, rel=0.15, abs=100)
    assert Counter(r.doc_id for r in mixing.mix(df).collect()) == Counter(r.doc_id for r in out if r.kept)
    assert mixing.mix(df).columns == df.columns and mixing.sample(df.filter("false")).count() == 0
    far = {tuple(r[:3]): r.p for r in mixing._rake_far(mixing.measured(df).groupBy(*mixing.MARGINS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens"), steps=8).collect()}
    assert all(0 <= p <= 1 for p in far.values()) and len(far) == len({(r.source, r.lang, r.topic) for r in out})


def test_both_ways_of_raking_agree(spark, monkeypatch):
    """Caps that bind and sources too small for their share; the distributed table gives the driver's probabilities."""
    rng = random.Random(6)
    rows = [(f"s{i}", l, t, int(20_000 / (i + 1) ** 1.1 * rng.choice([1, 1, 2]))) for i in range(60) for l in ("x", "y") for t in ("p", "q") if rng.random() < 0.8]
    rows += [("zero", "x", "p", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(2)
    near = {tuple(r[:3]): r.p for r in mixing.probabilities(cells).collect()}
    monkeypatch.setattr(mixing, "MAX_CELLS", 10)
    far = {tuple(r[:3]): r.p for r in mixing.probabilities(cells).collect()}
    assert far.keys() == near.keys() and sum(p == 1 for p in near.values()) > 5
    assert all(far[k] == pytest.approx(near[k], rel=1e-6) for k in near)


def test_both_ways_of_raking_sample_alike(spark, monkeypatch):
    """Also where one cell has a third of all rows, which the join with a distributed table deals out."""
    rows = [(i, "some words " * (i % 7), "en", "hot" if i % 3 else f"s{i % 30}", 1) for i in range(1500)] + [(None, None, None, None, 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _salt int").repartition(3)
    monkeypatch.setattr(mixing, "MAX_STEPS", 2)
    near, kept = Counter(mixing.sample(df).collect()), Counter(mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    assert mixing._probabilities(mixing.measured(df))[1].count() >= 1
    rounded = lambda rows: Counter({(*r[:5], round(r.probability, 9), r.kept): n for r, n in rows.items()})
    assert rounded(Counter(mixing.sample(df).collect())) == rounded(near) and sum(near.values()) == len(rows)
    assert Counter(mixing.mix(df).collect()) == kept and mixing.mix(df).columns == df.columns


PAGES = [(5, "http://a/ü x\r\nX: y", "é" * 60), (3, "u", "é" * 60), (9, None, "é" * 60), (9, "again", "é" * 60), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", "é" * 60), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 100), (7, "u", "a\r\n\r\n" * 50_000)]


def brute_pages():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out, seen = Counter(), set()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first.get(h) is not None and (i != first[h] or (i, h) in seen)
        seen.add((i, h))
        out[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    return out


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record string").repartition(2)
    warc.write(pages, str(tmp_path / "w"), compression)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert not any(r.reason for r in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute_pages()
    warc.write(pages.filter("false"), str(tmp_path / "none"), compression)
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_long_urls_and_large_pages_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000, raising=False)
    rows = [(i, "data:" + "u" * 100_000 if i == 3 else "u", f"{i} " * n) for i, n in enumerate([10] * 30 + [900] * 12 + [3_000] * 4 + [9_000])] + [(100, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    warc.write(pages, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert not any(r.reason for r in found) and sorted((r.page_id, r.payload_bytes) for r in found) == [(i, len(h or "")) for i, _, h in rows]
    sizes = defaultdict(list)
    for r in found:
        sizes[r.archive].append(r.payload_bytes)
    assert all(len(x) == 1 or sum(x) <= 10_000 for x in sizes.values()) and len(sizes) < 30


def test_query_fails_on_a_gap(spark, monkeypatch):
    from chronofold.llm import queries

    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    good = warc.round_trip(pages)
    gap = good.selectExpr(*[f"cast(null as {t}) {c}" if c in ("record_type", "page_id") else f"'broken' {c}" if c == "reason" else c for c, t in good.dtypes])
    monkeypatch.setattr(warc, "round_trip", lambda _: good.unionByName(gap))
    with pytest.raises(Exception, match="broken"):
        queries.op5_warc(spark, SF).collect()


@pytest.mark.parametrize("compressed", [False, True])
def test_salvage_recovers_what_is_whole(compressed):
    rng = random.Random(7)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) + b"WARC/1.1\r\nfake\x1f\x8b\x08" for _ in range(30)]
    parts = [warc.pack({"WARC-Type": "response", "WARC-Block-Digest": f"sha256:{hashlib.sha256(p).hexdigest()}", "WARC-Record-ID": f"<urn:page:{i}:1>"}, p, compressed) for i, p in enumerate(payloads)]
    ends = np.cumsum([len(p) for p in parts])
    whole = b"".join(parts)
    assert [r.payload for r in warc.salvage(whole)] == payloads
    for _ in range(60):
        data, hurt = bytearray(whole), set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hurt.add(int(np.searchsorted(ends, at, side="right")))
        found = list(warc.salvage(bytes(data)))
        got = [x.payload for x in found if isinstance(x, warc.Record)]
        assert [p for i, p in enumerate(payloads) if i not in hurt] == [p for p in got if p in payloads and payloads.index(p) not in hurt]
        if not compressed:
            spans = sorted((x.offset, x.end) for x in found)
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    cut = list(warc.salvage(whole[: int(ends[10]) + 5]))
    assert isinstance(cut[-1], warc.Gap) and sum(isinstance(x, warc.Record) for x in cut) >= 11
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"junk")), warc.Gap)


def test_one_member_with_many_records_breaks_off_late():
    import gzip

    parts = [warc.pack({"WARC-Type": "response"}, bytes(random.Random(i).randrange(256) for _ in range(3000))) for i in range(200)]
    data = gzip.compress(b"".join(parts))
    assert len(list(warc.salvage(data))) == 200
    found = list(warc.salvage(data[: len(data) // 2]))
    assert isinstance(found[-1], warc.Gap) and 80 <= sum(isinstance(x, warc.Record) for x in found) <= 110


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from chronofold.llm import quality
    from chronofold.llm.queries import TOKENIZER

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], SF)
        assert k == 4 or out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert set(rows[1]) == {r.doc_id for r in quality.measure(docs).collect() if r.kept}
    last = {}
    for i, r in rows[1].items():
        last[r.text] = max(i, last.get(r.text, i))
    assert set(rows[2]) == set(last.values())
    want = brute_components([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, c in want.items() if i == c}
    assert set(rows[4]) == {r.doc_id for r in mixing.sample(frames[3]).collect() if r.kept}
    assert all(rows[4][i] == rows[3][i] for i in rows[4])
    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    assert {i: r.ids for i, r in rows[5].items()} == {i: model.encode(r.text) for i, r in rows[4].items()}
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(list(rows[5]))


def test_a_flipped_byte_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (20 + i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    parts = [p for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size]
    whole = parts[0].read_bytes()
    held = len(list(warc.salvage(whole)))
    assert held > 5 and all(isinstance(x, warc.Record) and "warc-date" in x.headers for x in warc.salvage(whole))
    rng = random.Random(2)
    for _ in range(40):
        data = bytearray(whole)
        data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        found = list(warc.salvage(bytes(data)))
        assert sum(isinstance(x, warc.Record) for x in found) >= held - 1
        covered = sorted({(x.offset, x.end) for x in found})
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_long_records_end_with_an_empty_member(spark, tmp_path):
    long = "".join(f"{i:x}" for i in range(3_600_000))  # above 16 MiB
    pages = spark.createDataFrame([(1, "u", long), (2, "u", "short"), (3, "u", long)], "page_id long, url string, html string").coalesce(1)
    assert len(long) > 1 << 24
    warc.write(pages, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert set(rows) == {1, 2, 3} and all(r.reason is None for r in rows.values())
    assert rows[1].payload_bytes == rows[3].payload_bytes == len(long) and rows[3].refers_to == 1


def test_malformed_headers_and_deep_nesting_are_quarantined():
    good = warc.pack({"WARC-Type": "response"}, b"x" * 200)
    bad = warc.pack({"WARC-Type": "revisit", "WARC-Payload-Length": "many", "WARC-Record-ID": "<urn:page:--5:1>"}, b"")
    found = list(warc.salvage(good + bad + good))
    assert [type(x).__name__ for x in found] == ["Record", "Gap", "Record"] and found[1].reason == "malformed payload length"
    assert warc._page("<urn:page:--5:1>") is None and warc._page("<urn:page:-5:1>") == -5
    nested = good
    for _ in range(1500):
        nested = warc._member(nested)
    found = list(warc.salvage(nested + good))
    assert [x.payload for x in found] == [b"x" * 200] * 2 and found[0].end == len(nested) == found[1].offset
