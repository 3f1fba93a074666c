"""Rules that queries alone don't pin down: nulls, ties, bounds that are passed, streams beside their batch."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom import sources as SO
from tallyloom import streaming as SG
from tallyloom.config import Settings
from tallyloom.operators import distributions as D
from tallyloom.operators import relational as R
from tallyloom.operators import stateful as S
from tallyloom.operators import timeseries as TS
from tallyloom.streaming.pipelines import Store


def write(folder, name, rows):
    """A JSON file that is a second younger than those before it."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
    age = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / name, (age, age))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


# --- mutations and joins ---------------------------------------------------------


def test_a_refused_debit_spends_nothing(spark):
    accounts = spark.createDataFrame([("a", 100), ("b", 10)], "who string, balance long")
    debits = spark.createDataFrame([("a", 1, 80), ("a", 2, 50), ("a", 3, 20), ("a", 4, 1), ("b", 1, 10), ("b", 2, None), ("c", 1, 5)], "who string, n long, amount long")
    got = R.debit_if_covered(accounts, debits, "who", "balance", "amount", "n")
    assert got.columns == ["who", "n", "amount", "accepted"]
    assert sorted((r["who"], r["n"]) for r in got.where("accepted").collect()) == [("a", 1), ("a", 3), ("b", 1)]


@pytest.mark.parametrize("most", [0, 100])
def test_floors_with_and_without_a_broadcast(spark, most):
    rows = spark.createDataFrame([(v,) for v in [-5, 0, 3, 10, 11, 25, 99, None, 3]], "v int")
    tiers = spark.createDataFrame([(f, f"t{f}") for f in (0, 10, 20, 30)], "floor int, name string")
    got = R.floor_join(rows, tiers, "v", "floor", max_broadcast=most)
    assert sorted(((r["v"], r["name"]) for r in got.where("v is not null").collect())) == [(-5, "t0"), (0, "t0"), (3, "t0"), (3, "t0"), (10, "t10"), (11, "t10"), (25, "t20"), (99, "t30")]


@pytest.mark.parametrize("most", [0, 100])
def test_every_prefix_counts(spark, most):
    rows = spark.createDataFrame([("abc",), ("abd",), ("x",), ("",), (None,)], "name string")
    prefixes = spark.createDataFrame([("ab",), ("abc",), ("zz",), (None,)], "prefix string")
    assert sorted(r["name"] for r in R.prefix_join(rows, prefixes, "name", max_broadcast=most).collect()) == ["abc", "abd"]


def test_defaults_of_missing_series(spark):
    series = spark.createDataFrame([("a", 2.0)], "k string, value double")
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted((r["k"], r["value"]) for r in R.or_default(series, wanted, ["k"]).collect()) == [("a", 2.0), ("b", 0.0)]


def test_an_upsert_s_ties_are_broken_by_the_row(spark):
    rows = [("k", 1, x) for x in ("a", "b", "c")]
    pick = lambda r: R.merge_latest(*(spark.createDataFrame(x, "k string, t int, x string") for x in ([], r)), ["k"], "t").first()["x"]
    assert pick(rows) == pick(rows[::-1])


# --- series and rules with memory ---------------------------------------------------


def test_an_increase_starts_at_the_window_s_first_point(spark):
    points = [("s", 0, 0.0), ("s", 100, 50.0), ("s", 110, 60.0), ("s", 115, 5.0), ("t", 5, 7.0)]
    df = spark.createDataFrame(points, "s string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["s"], r["t"]): r["increase"] for r in TS.increase(df, ["s"], 20).collect()}
    assert got == {("s", 0): 0, ("s", 100): 0, ("s", 110): 10, ("s", 115): 15, ("t", 5): 0}


@pytest.mark.parametrize("most", [0, 100])
def test_zscores_of_aggregated_baselines(spark, most):
    rows = [("a", i, 1.0 + i % 2) for i in range(40)] + [("a", 40, 50.0)] + [(None, i, float(i % 2)) for i in range(20)] + [(None, 20, 90.0)]
    got = TS.zscore_anomalies(spark.createDataFrame(rows, "k string, ts long, value double"), ["k"], max_broadcast=most)
    assert sorted(((r["k"], r["value"]) for r in got.collect()), key=str) == [("a", 50.0), (None, 90.0)] and "__k" not in got.columns


def test_events_without_time_or_key(spark):
    rows = [("a", None, 1), ("a", 0, 2), ("a", 1, 3), (None, 5, 4), (None, 6, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "k string, s long, id long")
    on = lambda df: sorted(r["id"] for r in df.where("allowed").collect())
    assert on(S.budget_from_first(df, "k", "s", 1, 60, "id")) == [2, 4]
    assert on(S.token_bucket(df, "k", "s", 1, 1, 60, "id")) == [2, 4]
    timed = df.withColumn("ts", F.timestamp_seconds("s"))
    assert on(S.tumbling_budget(timed, ["k"], "ts", "id", 1)) == [2, 4]
    assert on(S.daily_quota(timed, "ts", "id", 1, ["k"])) == [2, 4]


def test_a_null_in_a_tuple_keeps_its_result(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5)], "a int, b int")
    got = D.once_per_tuple(df, ["a", "b"], lambda t: t.withColumn("c", F.coalesce("b", F.lit(-1))))
    assert sorted(r["c"] for r in got.collect()) == [-1, -1, 5]


def test_buffers_and_claims(spark):
    rows = [("b", 1, "OFFER", 6), ("b", 2, "OFFER", 5), ("b", 3, "DRAIN", 4), ("b", 4, "OFFER", 5), ("b", 5, "LOOK", 1), ("b", 6, "DRAIN", 99), ("b", 7, "OFFER", None)]
    got = S.bounded_buffer(spark.createDataFrame(rows, "k string, id long, action string, n long"), "k", ["id"], 10)
    assert [r["accepted"] for r in got.orderBy("id").collect()] == [6, 0, 4, 5, None, 7, None]
    rows = [("c", 0, "BEGIN"), ("c", 5, "BEGIN"), ("c", 6, "DONE"), ("c", 7, "BEGIN"), ("c", 306, "BEGIN"), ("c", 307, "FAIL"), ("c", 308, "BEGIN"), ("c", 700, "DONE"), ("c", None, "BEGIN")]
    got = S.idempotent_claims(spark.createDataFrame(rows, "k string, s long, action string"), "k", "s")
    want = ["IGNORED", "CLAIMED", "PROCESSING", "COMPLETED", "COMPLETED", "CLAIMED", "RELEASED", "CLAIMED", "IGNORED"]
    assert [r["outcome"] for r in got.orderBy(F.asc_nulls_first("s")).collect()] == want


def test_rules_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    schema = "k string, id long, action string"
    rows = [{"k": f"m{i % 3}", "id": i, "action": a} for i, a in enumerate(["PUBLISH"] * 3 + ["CONSUME"] * 3 + ["NACK", "ACK", "NACK", "DUE", "DUE", "DUE", "CONSUME", "ACK", "CONSUME"])]
    for i in range(0, len(rows), 4):
        write(tmp_path / "in", f"{i:02}.json", rows[i : i + 4])
    folded = SG.fold_stream(stream(spark, tmp_path / "in", schema), "k", ["id"], S.queue_step(), "state", "string", ["action"])
    folded.writeStream.format("memory").queryName("queue").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    batch = S.queue_states(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "k", ["id"])
    pairs = lambda df: sorted((r["id"], r["state"]) for r in df.collect())
    assert pairs(spark.table("queue")) == pairs(batch) and len(rows) == spark.table("queue").count()


# --- stores, replays, alerts ---------------------------------------------------------


def test_a_new_checkpoint_on_an_old_store_loses_nothing(spark, tmp_path):
    read = lambda: {r["user_ign"]: r["count"] for r in Store(spark, str(tmp_path / "s")).read().collect()}
    for n, delta in enumerate((5, 7)):
        write(tmp_path / f"in{n}", "1.json", [{"user_ign": "u", "delta": delta}])
        for _ in range(2):  # run again: nothing new
            SG.delta_sync(stream(spark, tmp_path / f"in{n}", "user_ign string, delta long"), str(tmp_path / "s"), str(tmp_path / f"cp{n}")).awaitTermination()
    assert read() == {"u": 12}
    # a batch of the first stream that comes again is known, though the second has written since
    store = Store(spark, str(tmp_path / "s"))
    first = min(store.ledger(), key=lambda k: k)
    store.merge(0, lambda old: old.limit(0), first)
    assert read() == {"u": 12} and len(store.ledger()) == 2


def test_a_crash_between_the_rows_and_the_ledger_is_written_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    add = lambda old: spark.range(1) if old is None else old.union(spark.range(1))
    store.merge(0, add, "a")
    spark.range(50).write.parquet(str(tmp_path / "s" / "v1"))  # rows without a ledger
    assert store.version() == 0 and store.read().count() == 1
    store.merge(1, add, "a")
    assert store.version() == 1 and store.read().count() == 2


def test_replays_wait_and_then_give_up(spark, tmp_path):
    write(tmp_path / "in", "1.json", [{"id": 1, "ts": 1, "attempts": 0}, {"id": 2, "ts": 1, "attempts": 3}])
    schema = "id long, ts long, attempts long"
    waited: list[float] = []
    (tmp_path / "file").write_text("no folder")
    SG.replay(stream(spark, tmp_path / "in", schema), str(tmp_path / "file"), str(tmp_path / "dead"), str(tmp_path / "cp"), sleep=waited.append).awaitTermination()
    assert waited == [1, 2, 4]
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "dead")).collect()) == [1, 2]
    SG.replay(stream(spark, tmp_path / "in", schema), str(tmp_path / "s"), str(tmp_path / "dead2"), str(tmp_path / "cp2")).awaitTermination()
    assert [r["id"] for r in Store(spark, str(tmp_path / "s")).read().collect()] == [1]
    assert [r["id"] for r in spark.read.json(str(tmp_path / "dead2")).collect()] == [2]


def test_relations_that_fail_are_tallied(spark, tmp_path):
    write(tmp_path / "in", "1.json", [{"target_ocid": "t", "liker_account_id": "a"}, {"target_ocid": None, "liker_account_id": "a"}])
    tally: list[dict] = []
    SG.relation_sync(stream(spark, tmp_path / "in", "target_ocid string, liker_account_id string"), str(tmp_path / "s"), str(tmp_path / "cp"), tally).awaitTermination()
    assert [(t["added"], t["skipped"], t["failed"]) for t in tally] == [(1, 0, 1)]


def test_alerts_fall_back_from_channel_to_channel(spark, tmp_path):
    write(tmp_path / "in", "1.json", [{"m": "x"}])
    memory = SG.MemoryChannel()

    def refuse(alerts):
        raise OSError("no")

    run = lambda n, channels: SG.write_alerts(stream(spark, tmp_path / "in", "m string"), str(tmp_path / f"a{n}"), str(tmp_path / f"cp{n}"), channels).awaitTermination()
    run(0, [SG.webhook("http://127.0.0.1:9/none", 0.2), memory])
    assert list(memory.held) == ['{"m":"x"}'] and not (tmp_path / "a0").exists()
    run(1, [refuse])
    assert [r["m"] for r in spark.read.json(str(tmp_path / "a1")).collect()] == ["x"]


def test_ingest_on_a_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(json.dumps({"eventId": "e", "timestamp": 0, "payload": {"ocid": "a", "date": "2024-01-01T00:00:00Z"}}) + "\n")
    from tallyloom.streaming.pipelines import lines

    query = SG.ingest(lines(spark, str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "cp"), every="1 second")
    try:
        query.processAllAvailable()
        assert [r["ocid"] for r in Store(spark, str(tmp_path / "s")).read().collect()] == ["a"] and query.isActive
    finally:
        query.stop()


# --- sources and settings ---------------------------------------------------------


def test_dashboards_of_any_depth(spark):
    panel = {"id": 1, "type": "graph", "title": "p", "targets": [{"expr": "x"}]}
    for _ in range(9):
        panel = {"type": "row", "panels": [panel]}
    docs = spark.createDataFrame([(json.dumps({"uid": "u", "panels": [panel, {"type": "row"}]}),), ("not json",), (None,)], "value string")
    assert [r["query"] for r in SO.signals_of(docs).collect()] == ["x"]


def test_a_database_table_by_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(driver["driver"])
    except Exception:
        pytest.skip("no database driver here")
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"))
    SO.write_jdbc(rows, url, "ITEMS", mode="overwrite", **driver)
    got = SO.jdbc_table(spark, url, "ITEMS", key="ID", bounds=(0, 100), parts=4, **driver)
    assert got.rdd.getNumPartitions() == 4 and got.where("ID >= 90").count() == 10
    assert SO.jdbc_table(spark, url, "ITEMS", **driver).count() == 100
    with pytest.raises(ValueError):
        SO.jdbc_table(spark, url, "ITEMS", key="ID", **driver)


def test_yaml_settings():
    text = "# limits\nlike:\n  sync-size: 20\nbuffer:\n  limit: '30'\nlenient_mass: true # yes\n"
    found = Settings.from_yaml(text)
    assert (found.like_sync_size, found.buffer_limit, found.lenient_mass) == (20, 30, True)
    with pytest.raises(ValueError):
        Settings.from_yaml("unknown: 1")


def test_group_reads_idle_entries_first(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    entries = spark.range(1, 9).withColumnRenamed("id", "e")
    held = spark.createDataFrame([(1, "a", at(0), 1), (2, "a", at(15), 1), (3, "a", at(10), 2), (4, "a", None, 1), (99, "a", at(0), 1)], "e long, consumer string, since string, times int")
    held = held.withColumn("since", F.col("since").cast("timestamp"))
    now = F.lit(at(20)).cast("timestamp")
    read = lambda rows, last, count: [tuple(r) for r in S.read_group(entries, rows, "e", last, now, count).orderBy("e").collect()]
    assert read(held, 4, 5) == [(1, True), (3, True)]  # 10 minutes are long enough; 99 has left the log
    assert read(held, 4, 1) == [(1, True)]
    assert read(held.where("e in (2, 4)"), 4, 3) == [(5, False), (6, False), (7, False)]
    assert read(held.limit(0), None, 2) == [(1, False), (2, False)]
    assert read(held.limit(0), 8, 2) == []
    taken = S.read_group(entries, held, "e", 4, now, 1)
    after = {r["e"]: (r["consumer"], r["times"]) for r in S.held_after(held, taken, "e", "b", now).collect()}
    assert after == {1: ("b", 2), 2: ("a", 1), 3: ("a", 2), 4: ("a", 1), 99: ("a", 1)}
    fresh = S.held_after(held.limit(0), entries.limit(1), "e", "b", now).collect()
    assert [(r["e"], r["consumer"], r["times"]) for r in fresh] == [(1, "b", 1)]
