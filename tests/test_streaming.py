"""Streams over file sources give what the batch gives."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom import streaming as ST
from tallyloom.streaming.pipelines import Store, lines


def message(event: str, ocid: str, level: int, date: str, ts: int = 0) -> str:
    return json.dumps({"eventId": event, "eventType": "C", "timestamp": ts, "payload": {"ocid": ocid, "character_level": level, "date": date}})


def write(folder, name, rows):
    """A file that is a second younger than those before it: streams take files by age."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(rows) + "\n")
    age = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / name, (age, age))


def test_ingest_latest_wins_and_quarantine(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.txt", [message("e1", "a", 10, "2024-01-01T00:00:00Z"), message("e2", "a", 12, "2024-01-03T00:00:00Z"), "not json"])
    write(src, "2.txt", [message("e3", "a", 11, "2024-01-02T00:00:00Z"), message("e4", "b", 5, "2024-01-01T00:00:00Z")])
    ST.ingest(lines(spark, str(src), 1), str(tmp_path / "store"), str(tmp_path / "cp"), str(tmp_path / "dead")).awaitTermination()
    got = {r["ocid"]: r["character_level"] for r in Store(spark, str(tmp_path / "store")).read().collect()}
    assert got == {"a": 12, "b": 5}
    assert [r["value"] for r in spark.read.json(str(tmp_path / "dead")).collect()] == ["not json"]
    # a second run without new files changes nothing
    ST.ingest(lines(spark, str(src), 1), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert Store(spark, str(tmp_path / "store")).version() == 1


def test_deduplicated(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.txt", [message("e1", "a", 1, "2024-01-01T00:00:00Z", 1000), message("e1", "a", 1, "2024-01-01T00:00:00Z", 2000), message("e2", "b", 1, "2024-01-01T00:00:00Z", 3000)])
    stream = ST.deduplicated(ST.envelopes(lines(spark, str(src))), ["eventId"])
    query = stream.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(r["eventId"] for r in spark.table("dedup").collect()) == ["e1", "e2"]


def json_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_delta_sync(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [json.dumps({"user_ign": "user1", "delta": 10}), json.dumps({"user_ign": "user2", "delta": 20})])
    write(src, "2.json", [json.dumps({"user_ign": "user1", "delta": -3}), json.dumps({"user_ign": "user2", "delta": -99})])
    ST.delta_sync(json_stream(spark, src, "user_ign string, delta long"), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert {r["user_ign"]: r["count"] for r in Store(spark, str(tmp_path / "s")).read().collect()} == {"user1": 7, "user2": 0}


def test_delta_sync_keeps_what_cannot_be_merged(spark, tmp_path, monkeypatch):
    src, args = tmp_path / "in", (str(tmp_path / "s"), str(tmp_path / "cp"), "k", str(tmp_path / "kept"))
    merge, down = Store.merge, {"on": True}

    def failing(self, batch, change, stream=""):
        if down["on"]:
            raise OSError("the store is away")
        return merge(self, batch, change, stream)

    def run(name, rows):
        write(src, name, [json.dumps(r) for r in rows])
        ST.delta_sync(json_stream(spark, src, "k string, delta long"), *args).awaitTermination()

    counts = lambda: {r["k"]: r["count"] for r in Store(spark, args[0]).read().collect()}
    monkeypatch.setattr(Store, "merge", failing)
    run("1.json", [{"k": "a", "delta": 5}])
    run("2.json", [{"k": "a", "delta": 1}, {"k": "b", "delta": 2}])
    assert Store(spark, args[0]).read() is None
    down["on"] = False
    run("3.json", [{"k": "a", "delta": 10}])
    assert counts() == {"a": 16, "b": 2}
    run("4.json", [{"k": "b", "delta": 1}])
    assert counts() == {"a": 16, "b": 3}
    assert not list((tmp_path / "kept").glob("stream=*/batch=*"))


def test_relation_sync(spark, tmp_path):
    src = tmp_path / "in"
    edge = lambda t, a: json.dumps({"target_ocid": t, "liker_account_id": a})
    write(src, "1.json", [edge("t", "a"), edge("t", "a"), edge("t", "b")])
    write(src, "2.json", [edge("t", "a"), edge("u", "a")])
    tally: list[dict] = []
    ST.relation_sync(json_stream(spark, src, "target_ocid string, liker_account_id string"), str(tmp_path / "s"), str(tmp_path / "cp"), tally).awaitTermination()
    assert [(t["added"], t["skipped"]) for t in tally] == [(2, 0), (1, 1)]
    assert Store(spark, str(tmp_path / "s")).read().count() == 3


def test_replay(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [json.dumps({"id": 1, "ts": 1, "attempts": 0, "v": "x"}), json.dumps({"id": 1, "ts": 2, "attempts": 1, "v": "y"}), json.dumps({"id": 2, "ts": 1, "attempts": 3, "v": "z"})])
    ST.replay(json_stream(spark, src, "id long, ts long, attempts int, v string"), str(tmp_path / "s"), str(tmp_path / "d"), str(tmp_path / "cp")).awaitTermination()
    assert [r["v"] for r in Store(spark, str(tmp_path / "s")).read().collect()] == ["y"]
    assert [r["id"] for r in spark.read.json(str(tmp_path / "d")).collect()] == [2]


def test_cooldown_stream(spark, tmp_path):
    src = tmp_path / "in"
    for i, moments in enumerate([(0, 59, 60), (61, 119, 120, 121)]):
        write(src, f"{i}.json", [json.dumps({"k": "a", "ts": f"2024-01-01T00:{m // 60:02d}:{m % 60:02d}Z"}) for m in moments])
    stream = ST.cooldown_stream(json_stream(spark, src, "k string, ts timestamp"), "k")
    query = stream.writeStream.format("memory").queryName("cool").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(r["s"] for r in spark.table("cool").select((F.unix_timestamp("ts") % 3600).alias("s")).collect()) == [0, 60, 120]


def test_monitors_and_alerts(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [json.dumps({"buffer": "b", "ts": "2024-01-01T00:00:01Z", "level": 6000}), json.dumps({"buffer": "b", "ts": "2024-01-01T00:00:07Z", "level": 10}), json.dumps({"buffer": "b", "ts": "2024-01-01T00:05:00Z", "level": 1})])
    alerts = ST.saturation_monitor(json_stream(spark, src, "buffer string, ts timestamp, level long"))
    ST.write_alerts(alerts.select("buffer", "level"), str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    assert [r["level"] for r in spark.read.json(str(tmp_path / "alerts")).collect()] == [6000]


def test_popularity(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [json.dumps({"k": "a", "ts": "2024-01-01T01:00:00Z"}), json.dumps({"k": "a", "ts": "2024-01-01T23:00:00Z"}), json.dumps({"k": "b", "ts": "2024-01-02T01:00:00Z"})])
    stream = ST.popularity(json_stream(spark, src, "k string, ts timestamp"), "k")
    stream.writeStream.format("memory").queryName("pop").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted((r["k"], r["count"]) for r in spark.table("pop").collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("most", [2])
def test_capped_log(spark, tmp_path, most):
    src = tmp_path / "in"
    write(src, "1.json", [json.dumps({"ts": i}) for i in (1, 2, 3)])
    write(src, "2.json", [json.dumps({"ts": 4})])
    ST.capped_log(json_stream(spark, src, "ts long"), str(tmp_path / "s"), str(tmp_path / "cp"), "ts", most).awaitTermination()
    assert sorted(r["ts"] for r in Store(spark, str(tmp_path / "s")).read().collect()) == [3, 4]


def test_store_keeps_few_versions_and_skips_repeats(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), keep=2)
    assert store.read() is None
    for n in range(4):
        store.merge(n, lambda old: spark.range(1) if old is None else old.union(spark.range(1)))
    store.merge(2, lambda old: spark.range(99))  # a batch that comes again
    assert store.versions() == [2, 3] and store.read().count() == 4
