"""Sources on small files."""

from __future__ import annotations

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallyloom import sources as SO
from tallyloom.sources.http import CharacterSource


def test_rate_table(spark, tmp_path):
    path = tmp_path / "rates.csv"
    header = "cube_type,option,rate,slot,potential_option_grade,base_equipment_level,item_equipment_slot\n"
    path.write_text(header + "BLACK,STR +12%,0.5,1,레전드리,200,모자\n")
    assert SO.rate_table(spark, str(path)).first()["rate"] == 0.5
    path.write_text(header)
    with pytest.raises(Exception, match="empty"):
        SO.rate_table(spark, str(path)).collect()


ITEM = {"item_equipment_slot": "모자", "item_equipment_part": "모자", "item_name": "x", "base_equipment_level": 200, "potential_option_grade": "null", "potential_option_1": "STR +12%", "starforce": "17", "starforce_scroll_flag": "사용", "item_add_option": {"str": "12"}, "unknown": {"a": [1]}}


def test_equipment_documents(spark):
    doc = {"item_equipment_preset_1": [ITEM, {"item_name": "no slot"}], "item_equipment_preset_3": [ITEM], "date": "x"}
    text = json.dumps(doc, ensure_ascii=False)
    rows = spark.createDataFrame([("plain", text.encode()), ("packed", gzip.compress(text.encode())), ("broken", b"\x1f\x8bzz"), ("none", None)], "ocid string, data binary")
    items = SO.all_presets(rows.select("ocid", SO.inflate("data").alias("json")), "json").collect()
    assert sorted((r["ocid"], r["preset"]) for r in items) == [("packed", 1), ("packed", 3), ("plain", 1), ("plain", 3)]
    r = items[0]
    assert (r["level"], r["grade"], r["star"], r["other_chain"], r["bonus"]["str"], r["options"][0]) == (200, None, 17, True, 12, "STR +12%")


def test_dashboards(spark, tmp_path):
    panel = {"id": 3, "type": "graph", "title": "p99 latency", "targets": [{"expr": "rate(x[1m])", "refId": "A"}, {"expr": " "}], "fieldConfig": {"defaults": {"unit": "s", "thresholds": {"steps": [{"value": None}, {"value": 1}, {"value": 2}]}}}}
    logs = {"id": 4, "type": "logs", "title": "l", "datasource": {"type": "loki"}, "targets": [{"expr": "{a}"}]}
    board = {"uid": "u", "title": "t", "panels": [{"type": "row", "panels": [{"type": "row", "panels": [panel]}, logs]}, {"type": "text"}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps(board, indent=1))
    (tmp_path / "copy.json").write_text(json.dumps(board))
    (tmp_path / "x.txt").write_text("no")
    signals = SO.dashboard_signals(spark, str(tmp_path))
    assert signals.count() == 2
    r = SO.signal_catalog(signals).collect()
    assert len(r) == 1 and (r[0]["warn"], r[0]["crit"], r[0]["priority"], r[0]["slo_tag"]) == (1.0, 2.0, 100, "latency.p99")


def test_range_series(spark):
    body = json.dumps({"data": {"result": [{"metric": {"a": "b"}, "values": [[1700000000.5, "1.5"], [1700000001, "bad"]]}]}})
    rows = SO.range_series(spark.createDataFrame([(body,)], "body string"), "body").orderBy("ts").collect()
    assert [r["value"] for r in rows] == [1.5, 0.0] and rows[0]["labels"] == {"a": "b"}


def test_slow_query_log(spark, tmp_path):
    text = "# Time: 2024-01-01T00:00:00Z\n# User@Host: app[app] @ h\n# Query_time: 2.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 900\nSELECT 1;\n# Time: 2024-01-01T00:00:05Z\n# User@Host: bob[b] @ h\n# Query_time: 1.5  Lock_time: 0.2 Rows_sent: 2  Rows_examined: 9\nSELECT\n2;\n"
    (tmp_path / "slow.log").write_text(text)
    rows = SO.slow_query_log(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["user"], r["query_time"], r["rows_examined"], r["statement"]) for r in rows] == [("app", 2.5, 900, "SELECT 1;"), ("bob", 1.5, 9, "SELECT\n2;")]


def test_backups_newest_first(spark, tmp_path):
    import os

    for i, name in enumerate(("a.json", "b.json")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [r["path"].rsplit("/", 1)[1] for r in SO.backup_files(spark, str(tmp_path)).collect()] == ["b.json", "a.json"]


def test_key_globs(spark):
    rows = spark.createDataFrame([("a_1",), ("ab1",), ("a_12",)], "k string")
    assert [r["k"] for r in SO.keys_like(rows, "k", "a_?").collect()] == ["a_1"]


def test_deflate_round_trip(spark):
    df = spark.createDataFrame([("텍스트",), (None,)], "t string")
    assert [r[0] for r in df.select(SO.inflate(SO.deflate("t"))).collect()] == ["텍스트", None]


def test_http_source(spark):
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            ok = self.path == "/a" or (self.path == "/flaky" and seen[self.path] > 1)
            self.send_response(200 if ok else 404 if self.path == "/none" else 503)
            self.end_headers()
            if ok:
                self.wfile.write(b'{"ocid":"x"}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(CharacterSource)
        reader = spark.read.format("character_api").option("base_url", f"http://127.0.0.1:{server.server_port}").option("backoff", "0.01")
        rows = {r["ocid"]: r["status"] for r in reader.option("ids", "a,flaky,none,down").load().collect()}
    finally:
        server.shutdown()
    assert rows == {"a": 200, "flaky": 200, "none": 404, "down": 503}
    assert F.lit(1) is not None and seen["/down"] == 3
