"""File sources: probability tables, equipment documents, dashboards, series, logs, backups."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import cut

RATES = "cube_type string, option string, rate double, slot int, potential_option_grade string, base_equipment_level int, item_equipment_slot string"
_TEXT = (
    "item_equipment_slot", "item_equipment_part", "item_name", "item_icon", "base_equipment_level", "potential_option_grade",
    "potential_option_1", "potential_option_2", "potential_option_3", "additional_potential_option_grade",
    "additional_potential_option_1", "additional_potential_option_2", "additional_potential_option_3", "starforce",
    "starforce_scroll_flag", "special_ring_level",
)
_BONUS = ("str", "dex", "int", "luk", "max_hp", "all_stat", "attack_power", "magic_power", "boss_damage", "damage")
_BASE = ("attack_power", "magic_power", "base_equipment_level")
ITEM = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in _TEXT),
        T.StructField("item_add_option", T.StructType([T.StructField(n, T.StringType()) for n in _BONUS])),
        T.StructField("item_base_option", T.StructType([T.StructField(n, T.StringType()) for n in _BASE])),
    ]
)
PRESETS = ("item_equipment_preset_1", "item_equipment_preset_2", "item_equipment_preset_3")


def rate_table(spark: SparkSession, path: str) -> DataFrame:
    """The probability table, a CSV with a header; an empty file is an error when it is used."""
    rows = spark.read.schema(RATES).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    filled = rows.agg(F.count("*").alias("__n")).select(
        F.when(F.col("__n") > 0, True).otherwise(F.raise_error(F.lit("the probability table is empty")).cast("boolean")).alias("__ok")
    )
    return rows.crossJoin(F.broadcast(filled)).where("__ok").drop("__ok")  # one row


@F.pandas_udf(T.StringType())
def inflate(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of bytes that may be gzip (magic 1F 8B); bytes that can't be read are null."""

    def one(value: bytes | None) -> str | None:
        if value is None:
            return None
        value = bytes(value)
        try:
            return (gzip.decompress(value) if value[:2] == b"\x1f\x8b" else value).decode("utf-8")
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    for batch in data:
        yield batch.map(one)


@F.pandas_udf(T.BinaryType())
def deflate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """gzip bytes of a text, without a time stamp."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0))


def _number(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, "[^0-9-]", "").try_cast("int"), F.lit(0))


def _given(text: Column) -> Column:
    """Null for a missing value, also one written as ``null``."""
    return F.when((F.trim(text) != "") & (text != "null"), text)


def preset_items(docs: DataFrame, json: str, preset: int) -> DataFrame:
    """One row per item of a preset's array, with the fields that valuation needs.

    Only the named array is parsed; unknown fields are skipped. Items without a slot are
    dropped; the position in the array is kept.
    """
    field = PRESETS[preset - 1]
    root = T.StructType([T.StructField(field, T.ArrayType(ITEM))])
    parsed = docs.withColumn("__doc", F.from_json(json, root)).drop(json)
    items = parsed.select(*(c for c in parsed.columns if c != "__doc"), F.posexplode(f"__doc.{field}").alias("position", "__item"))
    i = F.col("__item")
    grade = _given(i["potential_option_grade"])
    return items.where(F.length(F.trim(i["item_equipment_slot"])) > 0).select(
        *(c for c in items.columns if c != "__item"),
        F.lit(preset).alias("preset"),
        i["item_equipment_slot"].alias("slot"),
        i["item_equipment_part"].alias("part"),
        i["item_name"].alias("item_name"),
        _number(F.coalesce(i["base_equipment_level"], i["item_base_option"]["base_equipment_level"])).alias("level"),
        grade.alias("grade"),
        F.array(*(i[f"potential_option_{k}"] for k in (1, 2, 3))).alias("options"),
        _given(i["additional_potential_option_grade"]).alias("additional_grade"),
        F.array(*(i[f"additional_potential_option_{k}"] for k in (1, 2, 3))).alias("additional_options"),
        _number(i["starforce"]).alias("star"),
        F.coalesce(i["starforce_scroll_flag"] == "사용", F.lit(False)).alias("other_chain"),
        F.struct(*(_number(i["item_add_option"][b]).alias(b) for b in _BONUS)).alias("bonus"),
        _number(i["item_base_option"]["attack_power"]).alias("base_att"),
        _number(i["item_base_option"]["magic_power"]).alias("base_mag"),
    )


def all_presets(docs: DataFrame, json: str) -> DataFrame:
    found = preset_items(docs, json, 1)
    for preset in (2, 3):
        found = found.unionByName(preset_items(docs, json, preset))
    return found


_TARGET = T.StructType([T.StructField(n, T.StringType()) for n in ("expr", "refId", "legendFormat")] + [T.StructField("datasource", T.StructType([T.StructField("type", T.StringType())]))])
_STEPS = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType())]))
_FIELD = T.StructType([T.StructField("defaults", T.StructType([T.StructField("unit", T.StringType()), T.StructField("thresholds", T.StructType([T.StructField("steps", _STEPS)]))]))])


_PANEL = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("datasource", T.StructType([T.StructField("type", T.StringType())])),
        T.StructField("fieldConfig", _FIELD),
        T.StructField("targets", T.ArrayType(_TARGET)),
        T.StructField("panels", T.StringType()),  # JSON, parsed when a row of panels is opened
    ]
)


def dashboard_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of all ``*.json`` dashboards below a folder."""
    return signals_of(spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json"))


def signals_of(docs: DataFrame, json: str = "value") -> DataFrame:
    """Signals of dashboards given as JSON text; rows of panels are opened until none are left."""
    from tallyloom.functions.keys import signal_priority, slo_tag, stable_id, thresholds

    root = T.StructType([T.StructField("uid", T.StringType()), T.StructField("title", T.StringType()), T.StructField("panels", T.ArrayType(_PANEL))])
    level = docs.select(F.from_json(json, root).alias("d")).select(F.coalesce("d.uid", F.lit("")).alias("uid"), F.coalesce("d.title", F.lit("")).alias("title"), F.explode("d.panels").alias("panel"))
    panels, is_row = None, F.coalesce(F.col("panel.type"), F.lit("")) == "row"
    while True:
        level = cut(level)
        own = level.where(~is_row).select("uid", "title", *(F.col(f"panel.{f.name}").alias(f"p_{f.name}") for f in _PANEL))
        panels = own if panels is None else panels.unionByName(own)
        inner = level.where(is_row & F.col("panel.panels").isNotNull())
        if inner.isEmpty():
            break
        level = inner.select("uid", "title", F.explode(F.from_json("panel.panels", T.ArrayType(_PANEL))).alias("panel"))
    signals = panels.withColumn("t", F.explode("p_targets")).where(F.length(F.trim("t.expr")) > 0)
    kind = F.coalesce(_given(F.col("t.datasource.type")), _given(F.col("p_datasource.type")), F.lit("prometheus"))
    panel_title = F.coalesce("p_title", F.lit("Untitled Panel"))
    limits = thresholds(F.col("p_fieldConfig.defaults.thresholds.steps"))
    return signals.where(F.lower(kind) == "prometheus").select(
        stable_id(F.col("uid"), F.coalesce("p_id", F.lit(-1)), F.coalesce("t.refId", F.lit("A")), F.col("t.expr")).alias("id"),
        "uid",
        F.col("title").alias("dashboard"),
        panel_title.alias("panel"),
        F.col("t.expr").alias("query"),
        F.coalesce("t.legendFormat", F.lit("")).alias("legend"),
        F.coalesce("p_fieldConfig.defaults.unit", F.lit("")).alias("unit"),
        limits["warn"].alias("warn"),
        limits["crit"].alias("crit"),
        signal_priority(panel_title, F.col("t.expr")).alias("priority"),
        slo_tag(panel_title, F.col("t.expr")).alias("slo_tag"),
    )


def signal_catalog(signals: DataFrame) -> DataFrame:
    """One row per signal id."""
    from tallyloom.operators.stateful import first_of_each

    return first_of_each(signals, ["id"], ["uid", "panel", "query"])


def range_series(responses: DataFrame, json: str) -> DataFrame:
    """labels, ts, value: points of range-query responses; a value that is no number is 0."""
    schema = "data struct<result array<struct<metric map<string,string>, values array<array<string>>>>>"
    found = responses.select(F.explode(F.from_json(json, schema)["data"]["result"]).alias("r"))
    points = found.select(F.col("r.metric").alias("labels"), F.explode("r.values").alias("pair"))
    return points.select(
        "labels",
        F.timestamp_millis((F.get("pair", 0).try_cast("double") * 1000).cast("long")).alias("ts"),
        F.coalesce(F.get("pair", 1).try_cast("double"), F.lit(0.0)).alias("value"),
    )


def slow_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log whose records begin with ``# Time:``, with their labels."""
    return slow_query_entries(spark.read.text(path, lineSep="# Time: "))


def slow_query_entries(records: DataFrame) -> DataFrame:
    """Labels of records (column ``value``) cut at ``# Time: ``."""
    raw = records.where(F.length(F.trim("value")) > 0)
    text = F.col("value")

    def label(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    return raw.select(
        F.try_to_timestamp(label(r"^(\S+)")).alias("ts"),
        label(r"User@Host:\s+(\w+)").alias("user"),
        label(r"Query_time:\s+([\d.]+)").cast("double").alias("query_time"),
        label(r"Lock_time:\s+([\d.]+)").cast("double").alias("lock_time"),
        label(r"Rows_sent:\s+(\d+)").cast("long").alias("rows_sent"),
        label(r"Rows_examined:\s+(\d+)").cast("long").alias("rows_examined"),
        F.regexp_extract(text, r"(?s)\n([^#\n].*?)\s*$", 1).alias("statement"),
    )


def backup_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, modified and size of backups, newest first."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def keys_like(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Keys that match a glob of ``*`` and ``?``."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return rows.where(F.col(key).like(like))
