"""End to end: rows into a store, queries out; literals as in FIXTURES.md."""

from __future__ import annotations

import math
from datetime import UTC, datetime

import pytest

from chronofold.operators.filters import And, Eq, Exists, Gt, Gte, In, Lt, NotExists, NotIn, Or
from chronofold.operators.metrics import P50, P75, P90, P95, P99, P999, Avg, Count, CountDistinct, Max, Metric, Min, Percentile, Sum
from chronofold.plans.query import OrderBy, Query, run_query
from chronofold.sources.store import RowInput, Store

JAN1, JAN2, FEB1, MAR1 = 1704067200, 1704153600, 1706745600, 1709251200
YEAR = {"start": 1700000000, "end": 1720000000}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def fill(store, *rows):
    store.ingest_batch("", [RowInput(at, values) for at, values in rows])


def ask(store, **query):
    return [tuple(r) for r in store.query(Query(**{**YEAR, **query})).collect()]


def count(store, node):
    got = ask(store, metric=Count(), filter=node)
    return got[0][0] if got else 0


def test_two_months(store):
    fill(store, (JAN1, {"t": "Sales", "v": 10}), (JAN1 + 3600, {"t": "Sales", "v": 20}), (JAN2, {"t": "Invoice", "v": 30}), (FEB1, {"t": "Sales", "v": 40}))
    assert ask(store, dimensions=["date", "t"], metric=Count(), filter=Eq("t", "Sales")) == [(datetime(2024, 1, 1), "Sales", 2), (datetime(2024, 2, 1), "Sales", 1)]
    assert ask(store, metric=Avg("v"), filter=Eq("t", "Sales")) == [(pytest.approx(70 / 3),)]


def test_missing_dimension_is_null(store):
    fill(store, (JAN1, {"t": "a"}))
    assert ask(store, dimensions=["date", "none"], metric=Count()) == [(datetime(2024, 1, 1), None, 1)]


def test_multi_metrics(store):
    rows = [("Tea", 10, "A"), ("Tea", 20, "A"), ("Tea", 5, "B"), ("Coffee", 7, "C")]
    fill(store, *[(JAN1, {"p": p, "v": v, "c": c}) for p, v, c in rows])
    got = ask(store, dimensions=["p"], metrics=[Count(), Sum("v"), Avg("v"), Min("v"), Max("v"), CountDistinct("c")])
    assert got == [("Coffee", 1, 7, 7.0, 7, 7, 1), ("Tea", 3, 35, pytest.approx(11.667, abs=1e-3), 5, 20, 2)]


def test_default_and_explicit_order(store):
    fill(store, *[(JAN1, {"n": n}) for n in (4, 2, 3, 2)], (JAN1, {}))
    assert [r[0] for r in ask(store, dimensions=["n"], metric=Count())] == [None, 2, 3, 4]
    assert ask(store, dimensions=["n"], metric=Count(), order_by=[OrderBy("count", True)]) == [(2, 2), (None, 1), (3, 1), (4, 1)]
    assert [r[0] for r in ask(store, dimensions=["n"], metric=Count(), order_by=[OrderBy("n", True)])] == [4, 3, 2, None]
    with pytest.raises(ValueError, match="unsupported order field"):
        ask(store, dimensions=["n"], metric=Count(), order_by=[OrderBy("x")])


def test_time_zone_and_weekday(store):
    fill(store, (1704069000, {"t": "a"}))
    assert ask(store, dimensions=["date", "day_of_week"], metric=Count(), timezone="America/New_York") == [(datetime(2023, 12, 31), "Sun", 1)]
    assert ask(store, dimensions=["date", "day_of_week"], metric=Count(), timezone="No/Where", granularity="century") == [(datetime(2024, 1, 1), "Mon", 1)]


def test_repeated_hour_is_one_bucket_and_weeks_start_on_monday(store):
    at = int(datetime(2024, 11, 3, 5, 30, tzinfo=UTC).timestamp())
    fill(store, (at, {"x": 1}), (at + 3600, {"x": 1}))
    far = {"start": at - 10, "end": at + 10_000}
    assert ask(store, dimensions=["date"], metric=Count(), granularity="hour", timezone="America/New_York", **far) == [(datetime(2024, 11, 3, 1), 2)]
    assert ask(store, dimensions=["date"], metric=Count(), granularity="week", **far) == [(datetime(2024, 10, 28), 2)]
    assert ask(store, dimensions=["date"], metric=Count(), granularity="minute", **far) == [(datetime(2024, 11, 3, 5, 30), 1), (datetime(2024, 11, 3, 6, 30), 1)]
    assert ask(store, dimensions=["date"], metric=Count(), granularity="month", **far) == [(datetime(2024, 11, 1), 2)]


def test_percentiles_over_partitions(store):
    fill(store, *[(start + 60 * i, {"v": base + i + 1}) for start, base in ((JAN1, 0), (FEB1, 100), (MAR1, 200)) for i in range(100)])
    got = ask(store, metrics=[m("v") for m in (P50, P75, P90, P95, P99, P999)])[0]
    assert got == tuple(pytest.approx(x) for x in (150.5, 225.25, 270.1, 285.05, 297.01, 299.701))
    near = ask(store, metrics=[P50("v"), P99("v"), CountDistinct("v")], approximate=True)[0]
    assert near[0] == pytest.approx(150, abs=2) and near[2] == pytest.approx(300, rel=0.05)
    assert ask(store, metric=Percentile("v", "p50", 1.0)) == [(300.0,)]


def test_missing_columns_in_filters(store):
    fill(store, (JAN1, {"present": 1}), (JAN1, {"present": 2}))
    for node, n in (
        (Eq("missing", "x"), 0), (NotExists("missing"), 2), (And(Eq("present", 1), Eq("missing", "x")), 0), (Or(Eq("missing", "x"), Eq("present", 1)), 1),
        (Exists("present"), 2), (NotIn("missing", "x"), 2), (In("present"), 0), (NotIn("present"), 2),
    ):
        assert count(store, node) == n, str(node)


def test_literals_are_not_coerced(store):
    fill(store, (JAN1, {"n": 42, "f": 1.25, "s": "alpha", "b": True}), (JAN1, {"n": 7, "f": 2.5, "s": "beta"}))
    for node, n in (
        (Eq("n", 42), 1), (Eq("f", 1.25), 1), (Eq("n", "42"), 0), (In("n", 42.0, 42.5), 1), (In("f", 1.25, "x"), 1), (NotIn("n", 42.0, "x"), 1),
        (Lt("n", 10), 1), (Lt("n", 10.5), 0), (Gte("n", 42), 1), (Gt("s", "alpha"), 1), (Eq("b", True), 1), (Gt("b", 0), 0), (Eq("n", True), 0), (NotIn("b", True), 1),
    ):
        assert count(store, node) == n, str(node)


def test_nan_compares_with_nothing(store):
    fill(store, (JAN1, {"f": math.nan}), (JAN1, {"f": math.inf}), (JAN1, {"f": 1.0}))
    assert [count(store, x) for x in (Gt("f", 0.0), Gte("f", 1.0), Lt("f", math.nan), Eq("f", math.nan), NotIn("f", math.nan))] == [2, 2, 0, 0, 3]


def test_text_and_bool_sources(store):
    fill(store, *[(JAN1, {"s": s, "b": b}) for s, b in (("", True), ("12.5", False), ("abc", True), (" 1", True), ("1e400", True))])
    assert ask(store, metrics=[Sum("s"), Min("s"), Max("s"), Avg("b"), Sum("b")]) == [(12.5, 0.0, 12.5, 0.8, 4.0)]


def test_groups_without_values_give_zero(store):
    fill(store, (JAN1, {"g": "A", "v": 1.5}), (JAN1, {"g": "B"}))
    assert ask(store, dimensions=["g"], metrics=[Sum("v"), Avg("v"), Min("v"), Max("v"), P50("v"), CountDistinct("v")])[1] == ("B", 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert ask(store, metric=Sum("v"), filter=Eq("g", "C")) == []


def test_dotted_names(store):
    fill(store, (JAN1, {"a.b.c": "x", "a.b.n": 3}), (JAN1, {"a.b.c": "y", "a.b.n": 4}))
    assert ask(store, dimensions=["a.b.c"], metric=Sum("a.b.n"), filter=Eq("a.b.n", 3)) == [("x", 3)]


def test_kind_drift(store):
    fill(store, (JAN1, {"x": 1}), (FEB1, {"x": "1"}), (FEB1, {"x": "z"}), (MAR1, {}))
    assert sorted(map(str, ask(store, dimensions=["x"], metrics=[Count(), Sum("x"), CountDistinct("x")]))) == sorted(
        map(str, [(None, 1, 0.0, 0), ("1", 1, 1.0, 1), ("1", 1, 1.0, 1), ("z", 1, 0.0, 1)])
    )
    assert [count(store, x) for x in (Eq("x", 1), Eq("x", "1"), NotIn("x", 1), Exists("x"), NotExists("x"))] == [1, 1, 3, 3, 1]


def test_range_is_floored_and_half_open(store):
    fill(store, (JAN1, {"v": 1}), (JAN1 + 1, {"v": 1}))
    assert ask(store, metric=Count(), start=JAN1 + 0.9, end=JAN1 + 1.9) == [(1,)]
    with pytest.raises(ValueError, match="time range"):
        ask(store, metric=Count(), start=JAN1, end=JAN1)


def test_bad_queries(store):
    for query in ({}, {"metric": Count(), "metrics": [Count()]}, {"metric": Sum("")}, {"metric": Metric("median", "v")}, {"metric": Count(), "dimensions": ["count"]}, {"metric": Count(), "filter": And()}, {"metric": Count(), "filter": Eq("a", None)}, {"metric": Count(), "filter": In("a", None)}, {"metric": Percentile("v", "p50", 1.5)}):
        with pytest.raises(ValueError):
            ask(store, **query)


def test_absent_dataset_and_range(store):
    assert ask(store, dimensions=["a"], metric=Count(), dataset="none") == []
    fill(store, (JAN1, {"v": 1}))
    assert ask(store, metric=Sum("v"), start=1, end=2) == []


def test_scan_is_pruned(spark, store):
    fill(store, *[(at, {"a": 1, "b": 2}) for at in (JAN1, FEB1, MAR1)])
    got = store.explain(Query(start=FEB1, end=MAR1, metric=Sum("a")))
    assert (got.total, got.scanned, got.pruned) == (3, ["2024-02"], ["2024-01", "2024-03"])
    plan = got.result._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<timestamp:bigint,a:bigint>" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_any_dataframe(spark):
    rows = spark.createDataFrame([(JAN1, 1, ["x"]), (JAN1, 2, ["x"])], "timestamp long, v int, tags array<string>")
    assert [tuple(r) for r in run_query(rows, Query(**YEAR, dimensions=["tags"], metric=Sum("v"))).collect()] == [('["x"]', 3)]


def test_sketches_merge(spark):
    from chronofold.operators import sketches as k

    rows = spark.range(6000).selectExpr("id % 3 AS part", "id AS v", "'x' AS s", "id AS timestamp")
    parts = rows.groupBy("part").agg(k.distinct_sketch("v").alias("d"), k.quantile_sketch("v").alias("q"))
    one = parts.agg(k.merged_distinct("d").alias("d"), k.merged_quantiles("q").alias("q")).select(k.distinct_estimate("d").alias("n"), k.quantile_estimate("q", 0.9).alias("p")).first()
    assert one.n == pytest.approx(6000, rel=0.05) and one.p == pytest.approx(5400, rel=0.03)
    small = rows.filter("v < 256").agg(k.distinct_sketch("v", 14).alias("d")).select(k.distinct_estimate("d").alias("n")).first().n
    assert small == pytest.approx(256, rel=0.02)
    with pytest.raises(ValueError):
        k.distinct_sketch("v", 3)
    assert k.count_in_range(rows, "s", "x", 10, 20) == 10 and k.count_in_range(rows, "s", "y", 10, 20) == 0


def test_rollup_of_many_users_is_exact(spark, tmp_path):
    from chronofold.queries import sketch_rollup

    times = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 3 AS int)) AS ts"
    users = "CASE WHEN id < 180000 THEN id % 90000 END AS user_id"  # each on one or two days, and rows without a user
    spark.range(180_007).selectExpr("id AS event_id", times, users, "CASE WHEN id % 2 = 0 THEN 'a' END AS event_type", "1D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    found = {tuple(r) for r in sketch_rollup(spark, str(tmp_path)).collect()}
    assert found == {("a", 90_004, 45_000), (None, 90_003, 45_000)}


def test_one_scan_for_distinct_counts_beside_percentiles(spark, tmp_path):
    rows = spark.createDataFrame([(JAN1, g, v) for g in "ab" for v in (0.0, -0.0, 1.0, 2.0, float("nan"), float("nan"), None)], "timestamp long, g string, v double")
    rows.write.parquet(str(tmp_path / "t"))
    query = Query(**YEAR, dimensions=["g"], metrics=[CountDistinct("v"), P50("timestamp"), Count()])
    result = run_query(spark.read.parquet(str(tmp_path / "t")), query)
    assert [tuple(r) for r in result.collect()] == [("a", 4, JAN1, 7), ("b", 4, JAN1, 7)]
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_large_inputs_get_sketches_unless_asked_otherwise(spark, tmp_path, monkeypatch):
    from chronofold.plans import query as module

    spark.range(20_000).selectExpr(f"{JAN1}L timestamp", "id v").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    asked = {**YEAR, "metrics": [CountDistinct("v"), P95("v")]}
    assert [tuple(r) for r in run_query(rows, Query(**asked)).collect()] == [(20_000, pytest.approx(18_999.05))]
    monkeypatch.setattr(module, "EXACT_BYTES", 1000)
    for approximate, sketched in ((None, True), (False, False), (True, True)):
        result = run_query(rows, Query(**asked, approximate=approximate))
        assert ("approx_count_distinct" in result._jdf.queryExecution().optimizedPlan().toString()) is sketched
        n, p = result.first()
        assert abs(n - 20_000) <= 1000 and abs(p - 18_999) <= 40
