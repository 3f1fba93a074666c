"""Relational, time-series and stateful operators: edges that the tables don't have."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators import stateful as S
from tallyloom.operators import timeseries as TS


def test_floor_join_below_the_first(spark):
    tiers = spark.createDataFrame([(0, "a"), (160, "b"), (250, "c")], "floor int, tier string")
    rows = spark.createDataFrame([(-3,), (0,), (159,), (160,), (999,)], "v int")
    assert [r["tier"] for r in R.floor_join(rows, tiers, "v", "floor").orderBy("v").collect()] == ["a", "a", "a", "b", "c"]


def test_prefix_join_takes_every_prefix(spark):
    prefixes = spark.range(12_000).select(F.format_string("p%05d", "id").alias("prefix")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    rows = spark.createDataFrame([("p00000x",), ("p11999",), ("p11999",), ("p11998 y",), ("p12000",), ("p1",), ("",), (None,)], "t string")
    assert sorted(r["t"] for r in R.prefix_join(rows, prefixes, "t").collect()) == ["p00000x", "p11998 y", "p11999", "p11999"]
    assert sorted(r["t"] for r in R.prefix_join(rows, prefixes.limit(9), "t", max_broadcast=2).collect()) == ["p00000x"]


def test_keyset_page_ends(spark):
    rows = spark.range(5)
    page = R.keyset_page(rows, "id", 2, 5).orderBy("id").collect()
    assert [r["id"] for r in page] == [3, 4] and not page[0]["has_next"] and page[0]["next_cursor"] is None
    first = R.keyset_page(rows, "id", None, 2).collect()
    assert first[0]["has_next"] and first[0]["next_cursor"] == 1
    assert R.keyset_page(rows, "id", 9, 2).collect() == []


def test_row_numbers(spark):
    rows = spark.range(0, 1000, 3).repartition(7)
    got = R.row_numbers(rows, "id").orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(len(got)))


def test_chunks_of_nothing(spark):
    assert R.chunks(spark.range(0), "id", 10).collect() == []


def test_merge_latest_prefers_changes(spark):
    stored = spark.createDataFrame([(1, 5, "s"), (2, 9, "s")], "k int, t int, v string")
    changes = spark.createDataFrame([(1, 5, "c"), (2, 8, "c"), (3, 1, "c")], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in R.merge_latest(stored, changes, ["k"], "t").collect()} == {1: "c", 2: "s", 3: "c"}


def test_fallback_skips_known_missing(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    two = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "k string, v int")
    got = R.fallback_lookup(wanted, spark.createDataFrame([("c",)], "k string"), [one, two], "k", "v").collect()
    assert {r["k"]: r["v"] for r in got} == {"a": 1, "b": 2}


def test_reset_stalled(spark):
    rows = spark.sql("select * from values (1, 'PROCESSING', 'w', timestamp'2024-01-01 00:00:00'), (2, 'PROCESSING', 'w', timestamp'2024-01-01 00:58:00'), (3, 'PENDING', null, null) t(id, status, locked_by, locked_at)")
    got = {r["id"]: (r["status"], r["locked_by"]) for r in R.reset_stalled(rows, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert got == {1: ("PENDING", None), 2: ("PROCESSING", "w"), 3: ("PENDING", None)}


def test_histogram_quantile_edges(spark):
    inf = math.inf
    rows = [("n", 1.0, 5.0), ("n", 2.0, 10.0), ("n", inf, 10.0), ("top", 1.0, 0.0), ("top", inf, 4.0), ("empty", 1.0, 0.0), ("empty", inf, 0.0), ("open", 1.0, 2.0), ("open", 2.0, 2.0)]
    got = {r["k"]: r["quantile"] for r in TS.histogram_quantile(spark.createDataFrame(rows, "k string, le double, count double"), ["k"], 0.75).collect()}
    assert got["n"] == 1.5 and got["top"] == 1.0 and math.isnan(got["empty"]) and math.isnan(got["open"])


def test_zscore_ignores_flat_short_and_nan(spark):
    rows = [("flat", i, 1.0) for i in range(12)] + [("short", i, float(i * 100)) for i in range(5)]
    rows += [("spike", i, 1.0 + 0.01 * (i % 2)) for i in range(30)] + [("spike", 30, 50.0), ("spike", 31, math.nan)]
    got = TS.zscore_anomalies(spark.createDataFrame(rows, "s string, ts int, value double"), ["s"]).collect()
    assert [(r["s"], r["ts"], r["severity"]) for r in got] == [("spike", 30, "CRIT")]


def test_counter_reset(spark):
    rows = spark.sql("select 'a' s, timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,n,0) ts, v value from values (0, 5.0D), (1, 9.0D), (2, 3.0D), (3, 4.0D) t(n, v)")
    got = TS.increase(rows, ["s"], 600).orderBy("ts").collect()
    assert [r["increase"] for r in got] == [0, 4, 7, 8]


# cool-down at 60 s: moments from the fixture list
def test_cooldown(spark):
    rows = spark.createDataFrame([("k", s) for s in (0, 59, 60, 61, 119, 120, 121)], "k string, s long")
    assert [r["s"] for r in S.cooldown(rows, "k", "s", 60).where("emitted").orderBy("s").collect()] == [0, 60, 120]
    assert [r["s"] for r in S.duplicates_in_window(rows, "k", "s", 300).where("is_new").collect()] == [0]


def test_quota(spark):
    rows = spark.range(101).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    assert S.daily_quota(rows, "ts", "id", 100).where("not allowed").collect()[0]["id"] == 100


def test_budget_window_opens_at_first_event(spark):
    rows = spark.createDataFrame([("k", s) for s in (10, 20, 30, 69, 70, 71)], "k string, s long")
    assert [r["allowed"] for r in S.budget_from_first(rows, "k", "s", 2, 60).orderBy("s").collect()] == [True, True, False, False, True, True]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", s) for s in (0, 0, 0, 6, 6, 100)], "k string, s long")
    assert [r["allowed"] for r in S.token_bucket(rows, "k", "s", 2, 1, 6).orderBy("s").collect()] == [True, True, False, True, False, True]


def test_outbox(spark):
    rows = [("a", 1, False, True), ("a", 2, False, True), ("a", 3, False, True), ("a", 4, True, True), ("b", 1, True, False), ("c", 1, False, True), ("c", 2, True, True)]
    got = S.outbox_states(spark.createDataFrame(rows, "r string, n int, succeeded boolean, intact boolean"), "r", "n").collect()
    assert {r["r"]: (r["status"], r["retry_count"]) for r in got} == {"a": ("DEAD_LETTER", 3), "b": ("DEAD_LETTER", 0), "c": ("COMPLETED", 1)}


def test_health(spark):
    rows = spark.createDataFrame([("d", i, e) for i, e in enumerate(["CLOSED", "OPEN", "RECOVERED", "CLOSED", "OPEN", "CLOSED", "RECOVERED"])], "k string, n int, event string")
    assert [r["state"] for r in S.health_states(rows, "k", ["n"]).orderBy("n").collect()] == ["HEALTHY", "DEGRADED", "DEGRADED", "RECOVERING", "DEGRADED", "RECOVERING", "HEALTHY"]


def test_folds_of_nothing(spark):
    assert S.cooldown(spark.createDataFrame([], "k string, s long"), "k", "s").collect() == []


def test_approximate_percentiles(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    exact = TS.golden_signals(rows, ["k"], "v", F.col("v") > 899, accuracy=None).first()
    near = TS.golden_signals(rows, ["k"], "v", F.col("v") > 899, accuracy=1000).first()
    assert exact["p95"] == 949.05 and abs(near["p95"] - 949) <= 2 and exact["error_rate"] == 0.1
