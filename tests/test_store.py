from __future__ import annotations

import json

import pytest

from chronofold.cli import main
from chronofold.operators.filters import Eq, matches
from chronofold.operators.metrics import Count, Max, Sum
from chronofold.plans.query import Query
from chronofold.plans.rows import ZERO_TIME, as_float, as_int, as_time, cell
from chronofold.plans.sexpr import parse, parse_filter, parse_metrics, parse_order
from chronofold.sources.ndjson import ingest_files, ingest_lines, parse_line, parse_time
from chronofold.sources.partitioning import partitioner
from chronofold.sources.store import Placed, RowInput, Store
from chronofold.streaming.ingest import ingest_stream

JAN1, FEB1 = 1704067200, 1706745600
YEAR = {"start": 1700000000, "end": 1720000000}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ask(store, **query):
    return [tuple(r) for r in store.query(Query(**{**YEAR, **query})).collect()]


def test_ids_by_partition_and_after_reopening(spark, store):
    rows = [RowInput(JAN1, {"a": 1}), RowInput(JAN1, {"a": 2}), RowInput(FEB1, {"a": 3})]
    assert store.ingest_batch("", rows) == [Placed(0, "2024-01"), Placed(1, "2024-01"), Placed(0, "2024-02")]
    assert Store(spark, store.base).ingest_row("", RowInput(JAN1)) == Placed(2, "2024-01")


def test_bad_batches_write_nothing(store):
    with pytest.raises(ValueError):
        store.ingest_batch("bad/../name", [RowInput(JAN1)])
    with pytest.raises(ValueError):
        store.ingest_batch("", [RowInput(JAN1), None])
    with pytest.raises(TypeError):
        store.ingest_batch("", [RowInput(JAN1, {"a": 1}), RowInput(JAN1, {"a": "x"})])
    assert store.ingest_batch("", []) == [] and store.partitions("") == []
    store.ingest_row("", RowInput(JAN1, {"a": 1}))
    with pytest.raises(TypeError):
        store.ingest_row("", RowInput(JAN1, {"a": 1.5}))
    store.ingest_row("", RowInput(FEB1, {"a": 1.5}))


def test_values_are_stored_by_kind(store):
    store.ingest_row("", RowInput(JAN1, {"l": ["A/1", "B/2"], "none": None, "timestamp": 5, "s": "é" * 600_000}))
    assert store.kinds("", "2024-01") == {"l": "string", "s": "string"}
    row = store.rows("", "2024-01").first()
    assert row["l"] == '["A/1","B/2"]' and row["timestamp"] == JAN1 and row["s"] == "é" * 524_288


def test_compaction(store):
    for ref, v in (("r/1", 10), ("r/2", 100), ("r/1", 11), ("r/2", 101)):
        store.ingest_row("", RowInput(JAN1, {"ref": ref, "v": v}))
    store.ingest_row("", RowInput(JAN1, {"v": 5}))
    store.ingest_row("", RowInput(FEB1, {"ref": "r/1", "v": 1}))
    store.ingest_row("", RowInput(FEB1, {"ref": "r/1", "v": 2}))
    store.compact_dataset("", "ref")
    assert ask(store, dimensions=["ref"], metrics=[Count(), Sum("v")]) == [("r/1", 3, 14), ("r/2", 1, 101)]
    store.compact_dataset("", "ref", include_active=True)
    store.compact_dataset("", "ref", include_active=True)
    assert ask(store, dimensions=["ref"], metrics=[Count(), Sum("v")]) == [("r/1", 2, 13), ("r/2", 1, 101)]
    assert store.ingest_row("", RowInput(JAN1, {"v": 1})).row_id == 5
    with pytest.raises(KeyError, match="not found"):
        store.compact_partition("", "2024-01", "none")
    with pytest.raises(ValueError):
        store.compact_partition("", "2024-01", "")
    store.compact_partition("", "1999-01", "none")
    store.compact_dataset("absent", "ref")


def test_partitioners():
    assert partitioner("month").of(1707570000) == "2024-02" and partitioner("annual").of(1707570000) == "2024" and partitioner("daily").of(1707570000) == "2024-02-10"
    year = partitioner("year")
    assert [n for n in ("2023", "2024", "2025", "odd") if year.overlaps(n, 1717200000, 1719792000)] == ["2024", "odd"]
    hour = partitioner("%Y/%m".replace("/", ".") + ".%dT%H")
    assert hour.of(1707570000) == "2024.02.10T13" and hour.bounds("2024.02.10T13") == (1707570000, 1707573600)
    assert partitioner("%Y-%m-%d %H%M").bounds("2024-02-10 1301") == (1707570060, 1707570120)
    for bad in ("weekly", "%Y-%d", "%H", "%Y/%m", "%Y-%m-%d-%S", "%Y%m%m"):
        with pytest.raises(ValueError):
            partitioner(bad)


def test_dataframes_and_streams(spark, store, tmp_path):
    rows = spark.createDataFrame([(JAN1, 1), (FEB1, 2)], "timestamp long, v long")
    store.ingest_df("", rows, ("s", 0))
    store.ingest_df("", rows, ("s", 0))
    assert ask(store, metrics=[Count(), Sum("v")]) == [(2, 3)]
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, "streamed", "one", str(tmp_path / "ck"), once=True)
        query.awaitTermination()
    assert ask(store, dataset="streamed", metrics=[Count(), Sum("v")]) == [(2, 3)]


def test_lines(spark, store, tmp_path):
    lines = ['{"timestamp":"2024-01-01","a":{"b":[1,{"c":"x"}],"e":{}},"n":null}', "", '{"timestamp":1704067201.9,"a":{"b":[2]},"f":1.0}']
    assert ingest_lines(store, "", lines, 1) == 2
    assert ask(store, dimensions=["a.b.0", "a.b.1.c"], metric=Count()) == [(1, "x", 1), (2, None, 1)]
    with pytest.raises(ValueError, match="line 2: no timestamp"):
        ingest_lines(store, "", [lines[0], "", "{}"])
    with pytest.raises(TypeError):
        ingest_lines(store, "", ['{"timestamp":1704067200,"f":1}'])
    assert parse_line('{"timestamp":"2024-01-15T10:00:00+02:00","v":9223372036854775808}') == RowInput(1705305600, {"v": 9223372036854775808.0})
    (tmp_path / "x.json").write_text("\n".join(lines))
    ingest_files(spark, store, "far", str(tmp_path / "x.json"))
    assert ask(store, dataset="far", dimensions=["a.b.0"], metric=Max("f")) == [(1, 0.0), (2, 1.0)]
    for bad in (None, True, "soon", "2024-01-15T10:00:00"):
        with pytest.raises((ValueError, TypeError)):
            parse_time(bad)


def test_expressions():
    built = parse_filter('(and (eq a "12") (or (exists b) (not-in c (1 2.5 true x))) (LT d 3))')
    assert str(built) == "(And (Eq a 12) (Or (Exists b) (NotIn c 1 2.5 True x)) (Lt d 3))"
    assert built.parts[0].value == "12" and parse_filter("  ") is None
    assert parse('"a\\tb\\"c"').text == 'a\tb"c'
    for bad, at in (("(and)", "1:1"), ("(eq a", "1:1"), ("(eq a 1))", "1:9"), ("(foo a)", "1:2"), ('\n (eq a "x)', "2:8"), ("a b", "1:3")):
        with pytest.raises(ValueError, match=at):
            parse_filter(bad)
    assert [m.name for m in parse_metrics("count, SUM(x), count(y), distinct_count(y), p999(z)")] == ["count", "sum(x)", "count(y)", "count(y)", "p999(z)"]
    assert [(o.field, o.desc) for o in parse_order("sum(x):desc, day, count(y):asc")] == [("sum(x)", True), ("day", False), ("count(y)", False)]
    with pytest.raises(ValueError):
        parse_metrics("median(x)")
    assert matches(Eq("v", 42), {"v": 42}) and not matches(Eq("v", 42), {"v": 42.0}) and not matches(Eq("v", 42), {})


def test_command_line(spark, store, tmp_path, capsys):
    (tmp_path / "in.json").write_text("".join(json.dumps({"timestamp": JAN1, "k": k, "v": v}) + "\n" for k, v in (("a", 1), ("a", 2), ("b", 3))))
    base = ["--store", store.base, "--dataset", "d"]
    main(["ingest", *base, "--file", str(tmp_path / "in.json")], spark)
    asked = ["query", *base, "--dimensions", "k", "--metrics", "count,avg(v)", "--order-by", "avg(v):desc", "--start", "2024-01-01", "--end", "2024-01-02"]
    capsys.readouterr()
    main([*asked, "--output", "json", "--where", "(gte v 2)"], spark)
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"k": "b", "count": 1, "avg(v)": 3.0}, {"k": "a", "count": 1, "avg(v)": 2.0}]
    main(asked, spark)
    assert capsys.readouterr().out.splitlines() == ["k  count  avg(v)", "b  1      3", "a  2      1.50"]
    main(["ingest", *base[:2], "--dataset", "far", "--parallel", "--file", str(tmp_path / "in.json")], spark)
    assert ask(store, dataset="far", metrics=[Count(), Sum("v")]) == [(3, 6)]
    main(["compact", *base, "--key", "k", "--include-active"], spark)
    main([*asked, "--output", "none", "-v", "--where", "(gte v 3)"], spark)
    err = capsys.readouterr().err
    assert "1 of 1 partitions, 2 rows in range, 1 matched" in err and "1 rows in" in err


def test_profile_over_partitions(store):
    store.ingest_batch("", [RowInput(JAN1, {"a": 1}), RowInput(JAN1, {"a": 2}), RowInput(FEB1, {"a": "x"}), RowInput(FEB1 + 5_000_000, {"b": 1})])
    got = store.profile(Query(**{**YEAR, "end": FEB1 + 10}, metric=Count(), filter=Eq("a", 2)))
    assert (got.partitions, got.pruned, got.unmatched, got.rows_in_range, got.rows_matched, [tuple(r) for r in got.rows]) == (3, 1, 1, 2, 1, [(1,)])


def test_result_rows(spark):
    from pyspark.sql import Row

    r = Row(a="2024-01-15T00:00:00Z", b="2024-01-15", c=1705276800, d=1705276800.0, e="junk", f=2)
    assert {as_time(r, x).isoformat() for x in "abcd"} == {"2024-01-15T00:00:00+00:00"} and as_time(r, "e") == ZERO_TIME
    assert {as_time(Row(x=x), "x") for x in (float("nan"), 1e30, -1e30, 10**30)} == {ZERO_TIME}
    assert as_float(r, "f") == 2.0 and as_int(r, "e") == 0 and cell(2.0) == "2" and cell(2.345) == "2.35"


class Crash(Exception):
    pass


def crash_in(store, monkeypatch, step):
    def stop(*_):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(store, "_record", stop)
        with pytest.raises(Crash):
            step()
    return Store(store.spark, store.base)


def test_crashes_lose_and_double_nothing(spark, store, monkeypatch):
    rows = spark.createDataFrame([(JAN1, 1, "a"), (JAN1, 2, "a"), (FEB1, 3, "b")], "timestamp long, v long, k string")
    want = [(3, 6)]
    store = crash_in(store, monkeypatch, lambda: store.ingest_df("", rows, ("s", 0)))
    assert store.read("").count() == 0 and store.partitions("") == []
    for _ in range(2):
        store.ingest_df("", rows, ("s", 0))
    assert ask(store, metrics=[Count(), Sum("v")]) == want
    store = crash_in(store, monkeypatch, lambda: store.ingest_batch("", [RowInput(JAN1, {"v": 9})]))
    store = crash_in(store, monkeypatch, lambda: store.ingest_df("", rows, ("s", 1)))
    store = crash_in(store, monkeypatch, lambda: store.compact_dataset("", "k", include_active=True))
    assert ask(store, metrics=[Count(), Sum("v")]) == want
    with monkeypatch.context() as m:  # between taking the old manifest away and renaming the new one
        m.setattr(store.files, "move", lambda *_: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            store.ingest_df("", rows, ("s", 1))
    store = Store(spark, store.base)
    store.ingest_df("", rows, ("s", 1))
    assert ask(store, metrics=[Count(), Sum("v")]) == [(6, 12)]
    store.compact_dataset("", "k", include_active=True)
    assert sorted((r.k, r.v, r._partition) for r in store.read("").collect()) == [("a", 2, "2024-01"), ("b", 3, "2024-02")]


def test_frames_that_do_not_fit_are_refused(spark, store):
    store.ingest_df("", spark.createDataFrame([(JAN1, 1)], "timestamp long, v long"))
    for bad in (spark.createDataFrame([(JAN1, "x"), (FEB1, "x")], "timestamp long, v string"), spark.createDataFrame([(None, 1)], "timestamp long, v long")):
        with pytest.raises((TypeError, ValueError)):
            store.ingest_df("", bad)
    assert ask(store, metrics=[Count(), Sum("v")]) == [(1, 1)] and store.partitions("") == ["2024-01"]
    assert store.read("absent").count() == 0


def test_long_texts_of_frames_are_cut_like_those_of_rows(spark, store):
    texts = ["x" * ((1 << 20) - k) + "é😀" * 5 for k in range(8)] + ["x" * (1 << 20), "é" * 600_000]
    store.ingest_df("", spark.createDataFrame([*enumerate(texts)], "i int, s string").selectExpr(f"{JAN1}L timestamp", "i", "s"))
    store.ingest_batch("rows", [RowInput(JAN1, {"i": i, "s": t}) for i, t in enumerate(texts)])
    assert {r.i: r.s for r in store.read("").collect()} == {r.i: r.s for r in store.read("rows").collect()}


def test_threads_of_several_stores_take_turns(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        placed = list(pool.map(lambda i: Store(spark, store.base).ingest_row("", RowInput(JAN1, {"i": i})), range(8)))
    assert sorted(p.row_id for p in placed) == list(range(8)) and ask(store, metrics=[Count(), Sum("i")]) == [(8, 28)]


def test_steps_are_told(spark, tmp_path):
    told = []
    store = Store(spark, str(tmp_path / "s"), watch=told.append)
    store.ingest_batch("", [RowInput(JAN1, {"k": 1}), RowInput(JAN1, {"k": 1})])
    store.ingest_df("", spark.createDataFrame([(FEB1, 1)], "timestamp long, k long"))
    store.compact_dataset("", "k", include_active=True)
    store.profile(Query(**YEAR, metric=Count()))
    with pytest.raises(TypeError):
        store.ingest_row("", RowInput(JAN1, {"k": "x"}))
    assert [(s.name, s.counts.get("rows"), s.counts.get("error")) for s in told] == [
        ("ingest", 2, None), ("ingest", 1, None), ("compact", 1, None), ("compact", 1, None), ("query", 1, None), ("ingest", None, "TypeError"),
    ]
    assert all(s.seconds > 0 and s.dataset == "entities" for s in told)


def test_partial_states_merge(spark):
    from chronofold.operators import partials
    from chronofold.operators.metrics import P95, Avg, CountDistinct, Min

    rows = spark.createDataFrame([(d, i % 3, i, f"u{i % 50}") for d in range(4) for i in range(d * 100, d * 100 + 100)], "day int, g int, v long, u string")
    metrics = [Count(), Sum("v"), Avg("v"), Min("v"), Max("v"), CountDistinct("u"), P95("v"), Sum("u")]
    daily = partials.partial(rows, ["day", "g"], metrics)
    for keys in (["g"], []):
        got = {tuple(r[k] for k in keys): r for r in partials.finished(partials.merged(partials.merged(daily, ["day", *keys], metrics), keys, metrics), keys, metrics).collect()}
        for key, r in got.items():
            own = [x for x in rows.collect() if not keys or x.g == key[0]]
            vs = [x.v for x in own]
            assert (r["count"], r["sum(v)"], r["min(v)"], r["max(v)"], r["count(u)"]) == (len(vs), sum(vs), min(vs), max(vs), 50)
            assert r["avg(v)"] == pytest.approx(sum(vs) / len(vs)) and abs(r["p95(v)"] - sorted(vs)[int(len(vs) * 0.95)]) <= 12 and r["sum(u)"] == 0
    with pytest.raises(ValueError):
        partials.partial(rows, [], [Sum("none")])
