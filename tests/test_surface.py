"""Settings, sinks, SQL functions and the remaining operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyloom import sinks
from tallyloom.config import Settings
from tallyloom.functions import keys as K
from tallyloom.functions.register import register
from tallyloom.operators import stateful as S
from tallyloom.operators import valuation as V


def test_settings():
    s = Settings.from_properties("# sizes\nlike-sync-size = 7\nlenient.mass: true\n")
    assert (s.like_sync_size, s.lenient_mass, s.daily_quota) == (7, True, 100)
    for text in ("nope=1", "like_sync_size=x", "lenient_mass=maybe"):
        with pytest.raises(ValueError):
            Settings.from_properties(text)


def test_json_archive_and_recovery(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "new"), (2, 1, None), (3, 1, "ok")], "id int, t int, v string")
    sinks.write_json(rows, str(tmp_path / "b1"))
    moved = sinks.archive(spark, str(tmp_path / "b1"), str(tmp_path / "done"))
    backup = spark.read.schema("id int, t int, v string").json(moved)
    stored = spark.createDataFrame([(1, 4, "old")], "id int, t int, v string")
    merged, failed = sinks.recover(stored, backup, ["id"], "t", F.col("v").isNotNull())
    assert {r["id"]: r["v"] for r in merged.collect()} == {1: "new", 3: "ok"}
    assert [r["id"] for r in failed.collect()] == [2]


def test_publish(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"a": 1}) + "\n")
    sinks.publish(spark.readStream.schema("a int").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1}']


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select parse_num('9레벨 당 STR +1') a, expected_trials(0D) b, nearest_10(15D) c, backoff_seconds(2) d, content_hash('a', 't', 'p') e").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (91, float("inf"), 20.0, 120) and len(r["e"]) == 64
    pmf = "array(named_struct('value', 0, 'prob', 0.7D), named_struct('value', 6, 'prob', 0.2D), named_struct('value', 9, 'prob', 0.1D))"
    assert spark.sql(f"select convolved_tail(array({pmf}, {pmf}, {pmf}), 15)").first()[0] == pytest.approx(0.132)
    assert spark.sql(f"select draw_chance(array({pmf}), 6, false)").first()[0] == pytest.approx(0.3 / 4)
    assert spark.sql("select count(*) from unique_permutations(array('a', 'a', 'b'))").first()[0] == 3


def test_queue_life(spark):
    steps = ["PUBLISH", "CONSUME", "NACK", "DUE", "CONSUME", "NACK", "ACK", "REPROCESS", "CONSUME", "REDRIVE", "CONSUME", "ACK"]
    rows = spark.createDataFrame([("m", i, a) for i, a in enumerate(steps)], "m string, n int, action string")
    got = [r["state"] for r in S.queue_states(rows, "m", ["n"], max_retries=1).orderBy("n").collect()]
    assert got == ["PENDING", "INFLIGHT", "RETRY", "PENDING", "INFLIGHT", "DLQ", "DLQ", "PENDING", "INFLIGHT", "PENDING", "INFLIGHT", "DONE"]


def test_recover_stalled(spark):
    rows = spark.sql("select * from values (1, 'PROCESSING', timestamp'2024-01-01 00:00:00', true), (2, 'PROCESSING', timestamp'2024-01-01 00:00:00', false), (3, 'PROCESSING', timestamp'2024-01-01 00:59:00', false) t(id, status, locked_at, ok)")
    got = S.recover_stalled(rows, F.lit("2024-01-01 01:00:00").cast("timestamp"), F.col("ok"))
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "PENDING", 2: "DEAD_LETTER", 3: "PROCESSING"}


def test_summary_path_and_nested(spark):
    df = spark.range(1)
    s = df.select(V.starforce_summary(F.lit(200), F.lit(0), F.lit(22)).alias("s")).first()["s"]
    assert (int(s["plain_cost"]), float(s["safe_destroys"])) == (16169451100, 2.43)
    path = df.select(V.path_text(F.lit("base"), [("black", F.lit(5)), ("red", F.lit(0)), ("star", F.lit(1))])).first()[0]
    assert path == "base > black > star"
    nested = F.array(*(F.struct(F.lit(i).alias("preset_no")) for i in (1, 2, 3)))
    assert [x["preset_no"] for x in df.select(V.of_preset(nested, F.lit(2))).first()[0]] == [2]
    items = spark.createDataFrame([("o", 1, "b", 2.0), ("o", 1, "a", 3.0)], "o string, p int, name string, black_cube_cost double")
    r = V.preset_costs(items, "o", "p", ("black_cube_cost",), listed=["name"]).first()
    assert float(r["total_cost"]) == 5.0 and [x["name"] for x in r["items"]] == ["a", "b"]


def test_reasons(spark):
    r = spark.range(1).select(K.zscore_reason(F.lit("p"), F.lit(9.0), F.lit(3.5), F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()[0]
    assert r == "[Z-SCORE] p: Value 9.00 deviates 3.50σ from baseline 1.00 (σ=2.00, threshold=3.0)"
