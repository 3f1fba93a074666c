"""Documents, series, dashboards and logs made from the star schema, read back by the sources; small functions.

Their texts are built here as the outside world writes them, and SQL says what should be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import sources as SO
from tallyloom.functions import keys as K
from tallyloom.functions import masking as M
from tallyloom.functions import money as MO
from tallyloom.functions import options as O
from tallyloom.operators import distributions as D
from tallyloom.operators import flame as FL
from tallyloom.operators import refdata as REF
from tallyloom.operators import relational as R
from tallyloom.operators import starforce as S
from tallyloom.operators import stateful as ST
from tallyloom.plans.numeric_queries import _chain_sql
from tallyloom.plans.registry import query
from tallyloom.sources import read_table

# --- sources ------------------------------------------------------------------


@query("equipment_items", """
    WITH i AS (SELECT p_partkey, p_name, preset, p_size + preset AS n FROM part, (VALUES (1), (2), (3)) t(preset) WHERE preset <> 2 OR p_partkey % 2 = 0)
    SELECT p_partkey, preset, 0 AS position, '모자' AS slot, n * 5 AS level, CASE n % 3 WHEN 0 THEN '레전드리' WHEN 1 THEN '유니크' END AS grade,
           n % 26 AS star, n % 4 = 0 AS other_chain, 'STR +' || (n % 13) || '%' AS first_option, CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS bonus_str FROM i
    UNION ALL SELECT p_partkey, preset, 2, p_name, 200, NULL, 0, false, NULL, 0 FROM i""")
def equipment_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of documents of up to three presets, gzip or plain; the second item of each has no slot and is dropped."""
    n = lambda preset: F.col("p_size") + preset

    def items(preset: int) -> F.Column:
        grade = F.when(n(preset) % 3 == 0, "레전드리").when(n(preset) % 3 == 1, "유니크").otherwise("null")
        first = F.struct(
            F.lit("모자").alias("item_equipment_slot"),
            F.concat(F.lit("Lv. "), (n(preset) * 5).cast("string")).alias("base_equipment_level"),
            grade.alias("potential_option_grade"),
            F.concat(F.lit("STR +"), (n(preset) % 13).cast("string"), F.lit("%")).alias("potential_option_1"),
            (n(preset) % 26).cast("string").alias("starforce"),
            F.when(n(preset) % 4 == 0, "사용").otherwise("미사용").alias("starforce_scroll_flag"),
            F.struct(F.when(n(preset) % 2 == 0, n(preset).cast("string")).alias("str")).alias("item_add_option"),
            F.lit("more").alias("unknown_field"),
        )
        last = F.struct(F.col("p_name").alias("item_equipment_slot"), F.struct(F.lit(200).alias("base_equipment_level")).alias("item_base_option"))
        return F.concat(F.lit("["), F.to_json(first), F.lit(", {\"item_equipment_slot\": \" \"}, "), F.to_json(last), F.lit("]"))

    second = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(', "item_equipment_preset_2": '), items(2))).otherwise("")
    text = F.concat(F.lit('{"item_equipment_preset_1": '), items(1), second, F.lit(', "other": [1], "item_equipment_preset_3": '), items(3), F.lit("}"))
    docs = read_table(spark, folder, "part").select("p_partkey", text.alias("text"))
    data = F.when(F.col("p_partkey") % 3 == 0, SO.deflate("text")).otherwise(F.encode("text", "UTF-8"))
    found = SO.all_presets(docs.select("p_partkey", SO.inflate(data).alias("json")), "json")
    return found.select(
        "p_partkey", "preset", "position", "slot", "level", "grade", "star", "other_chain", F.get("options", 0).alias("first_option"), F.col("bonus.str").alias("bonus_str")
    )


@query("range_points", """
    SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE round(value, 2) END AS value FROM events""")
def range_points(spark: SparkSession, folder: str) -> DataFrame:
    """Range-query responses, one a user, read back as points; every tenth value is no number."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    value = F.when(F.col("event_id") % 10 == 0, "NaN?").otherwise(F.round("value", 2).cast("string"))
    pair = F.concat(F.lit("["), seconds, F.lit(', "'), value, F.lit('"]'))
    metric = F.concat(F.lit('{"metric": {"user": "'), F.col("user_id").cast("string"), F.lit('", "event": "'), F.col("event_id").cast("string"), F.lit('"}, "values": ['), pair, F.lit("]}"))
    series = read_table(spark, folder, "events").select("user_id", metric.alias("m"))
    bodies = series.groupBy("user_id").agg(F.concat(F.lit('{"status": "success", "data": {"result": ['), F.array_join(F.collect_list("m"), ", "), F.lit("]}}")).alias("body"))
    points = SO.range_series(bodies, "body")
    return points.select(F.col("labels.user").cast("long").alias("user_id"), F.col("labels.event").cast("long").alias("event_id"), F.unix_seconds("ts").alias("s"), "value")


@query("dashboard_panels", """
    SELECT 'u' || n_nationkey AS uid, n_name AS dashboard, 'p99 of ' || n_name AS panel, 'rate(x{n="' || n_nationkey || '"}[1m])' AS query, n_nationkey + 1.0::DOUBLE AS warn, n_nationkey + 2.0::DOUBLE AS crit,
           100 AS priority, 'latency.p99' AS slo_tag, left(sha256('u' || n_nationkey || '|7|A|rate(x{n="' || n_nationkey || '"}[1m])'), 16) AS id FROM nation""")
def dashboard_panels(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of dashboards whose panel lies n % 7 rows deep."""
    key = F.col("n_nationkey").cast("string")
    expr = F.concat(F.lit('rate(x{n=\\"'), key, F.lit('\\"}[1m])'))
    steps = F.concat(F.lit('[{"value": null}, {"value": '), (F.col("n_nationkey") + 1).cast("string"), F.lit('}, {"value": '), (F.col("n_nationkey") + 2).cast("string"), F.lit("}]"))
    panel = F.concat(
        F.lit('{"id": 7, "type": "graph", "title": "p99 of '), "n_name", F.lit('", "targets": [{"refId": "A", "expr": "'), expr,
        F.lit('"}, {"refId": "B", "expr": " "}], "fieldConfig": {"defaults": {"thresholds": {"steps": '), steps, F.lit("}}}}"),
    )
    depth = (F.col("n_nationkey") % 7).cast("int")
    nested = F.concat(F.repeat(F.lit('{"type": "row", "panels": ['), depth), panel, F.repeat(F.lit("]}"), depth))
    logs = '{"id": 8, "type": "logs", "datasource": {"type": "loki"}, "targets": [{"expr": "{a}"}]}'
    text = F.concat(F.lit('{"uid": "u'), key, F.lit('", "title": "'), "n_name", F.lit(f'", "panels": [{logs}, '), nested, F.lit("]}"))
    found = SO.signal_catalog(SO.signals_of(read_table(spark, folder, "nation").select(text.alias("value"))))
    return found.select("uid", "dashboard", "panel", "query", "warn", "crit", "priority", "slo_tag", "id")


@query("slow_queries", """
    SELECT o_orderkey AS s, 'user' || (o_custkey % 50) AS "user", (o_orderkey % 100) / 10.0::DOUBLE AS query_time, o_orderkey % 7 AS rows_sent, o_orderkey % 1000 AS rows_examined,
           'SELECT *' || chr(10) || 'FROM t WHERE k = ' || o_orderkey || ';' AS statement FROM orders""")
def slow_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a slow-query log, cut at their time line."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.date_format(F.timestamp_seconds(key), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\n# User@Host: user"), (F.col("o_custkey") % 50).cast("string"), F.lit("[u] @ h []\n# Query_time: "),
        F.format_number((key % 100) / 10, 3), F.lit("  Lock_time: 0.01 Rows_sent: "), (key % 7).cast("string"), F.lit("  Rows_examined: "), (key % 1000).cast("string"),
        F.lit("\nSELECT *\nFROM t WHERE k = "), key.cast("string"), F.lit(";\n"),
    )
    found = SO.slow_query_entries(read_table(spark, folder, "orders").select(text.alias("value")))
    return found.select(F.unix_seconds("ts").alias("s"), "user", "query_time", "rows_sent", "rows_examined", "statement")


# --- predicates and functions -----------------------------------------------------


@query("item_predicates", """
    SELECT p_partkey, p_size % 3 = 0 AS basic, p_size % 4 IN (2, 3) AND p_size % 5 > 0 AS dp, p_size % 7 = 0 AS other FROM part""")
def item_predicates(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.col("p_name")).when(size % 3 == 1, F.lit("  "))
    stat = F.when(size % 4 == 1, "UNKNOWN").when(size % 4 > 1, "STR_PERCENT")
    flag = F.when(size % 7 == 0, "사용").when(size % 7 < 4, "미사용")
    return read_table(spark, folder, "part").select(
        "p_partkey", R.has_text(name).alias("basic"), R.is_dp_mode(stat, size % 5).alias("dp"), R.is_other_chain(flag).alias("other")
    )


@query("half_up_amounts", """
    SELECT o_orderkey, CAST(floor(CAST(o_orderkey AS DECIMAL(18,4)) / 8 * 100 + 0.5) / 100 AS DOUBLE) AS two, CAST(floor(o_orderkey / 8.0::DOUBLE + 0.5) AS DOUBLE) AS none FROM orders""")
def half_up_amounts(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("o_orderkey").cast("decimal(18,4)") / 8
    return read_table(spark, folder, "orders").select("o_orderkey", MO.half_up(value, 2).cast("double").alias("two"), MO.half_up(value, 0).cast("double").alias("none"))


@query("grade_names", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'RARE' WHEN 1 THEN 'EPIC' WHEN 2 THEN 'UNIQUE' ELSE 'LEGENDARY' END AS grade FROM part""")
def grade_names(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.array(*map(F.lit, (" 레어", "에픽 ", "유니크", "레전드리")))
    return read_table(spark, folder, "part").select("p_partkey", O.grade_of(F.get(texts, F.col("p_size") % 4)).alias("grade"))


@query("stat_defaults", """
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'STR_PERCENT' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'STR_PERCENT,DEX_PERCENT' ELSE 'UNKNOWN' END AS kinds FROM part""")
def stat_defaults(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.array(*map(F.lit, ("STR +12%", "잘못된 옵션 문자열", "", "STR/DEX +6%", "피격 시 10% 확률로 데미지 무시")))
    return read_table(spark, folder, "part").select("p_partkey", F.array_join(O.all_stats_or_unknown(F.get(texts, F.col("p_size") % 5)), ",").alias("kinds"))


@query("stack_traces", """
    SELECT c_custkey, 'at /home/[USER]/app/Main.java and /Users/[USER]/x from [IP_MASKED]' AS trace,
           CASE c_custkey % 3 WHEN 0 THEN 'Unknown error' WHEN 1 THEN 'IOException' ELSE 'mail [EMAIL_MASKED]' END AS error FROM customer""")
def stack_traces(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    owner = F.concat(F.lit("user"), key.cast("string"))
    trace = F.concat(F.lit("at /home/"), owner, F.lit("/app/Main.java and /Users/"), owner, F.lit("/x from 10.0."), (key % 256).cast("string"), F.lit(".1"))
    kind = F.when(key % 3 > 0, "IOException")
    message = F.when(key % 3 == 2, F.concat(F.lit("mail "), owner, F.lit("@example.com")))
    return read_table(spark, folder, "customer").select("c_custkey", M.mask_stack_trace(trace).alias("trace"), M.mask_exception(kind, message).alias("error"))


@query("threshold_steps", """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size + 0.5::DOUBLE ELSE p_size + 0.0::DOUBLE END AS warn,
           CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_size + 9.0::DOUBLE END AS crit FROM part""")
def threshold_steps(spark: SparkSession, folder: str) -> DataFrame:
    """One step gives none; a base step without a value is skipped."""
    size = F.col("p_size").cast("double")
    step = lambda value: F.struct(value.cast("double").alias("value"))
    none = F.lit(None)
    steps = F.when(F.col("p_size") % 3 == 0, F.array(step(size))).when(F.col("p_size") % 3 == 1, F.array(step(none), step(size + 0.5))).otherwise(F.array(step(none), step(size), step(size + 9)))
    found = K.thresholds(steps)
    return read_table(spark, folder, "part").select("p_partkey", found["warn"].alias("warn"), found["crit"].alias("crit"))


@query("safe_numbers", """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey ELSE 0 END AS n, o_orderkey % 86400 AS s,
           CASE o_orderkey % 3 WHEN 0 THEN o_orderkey / 4.0::DOUBLE ELSE 0.0 END AS value FROM orders""")
def safe_numbers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(F.lit("-"), key.cast("string"))).when(key % 4 == 2, F.lit("12x"))
    value = F.when(key % 3 == 0, (key / 4).cast("string")).when(key % 3 == 1, F.lit("bad")).otherwise("")
    pair = K.value_pair(F.concat(F.lit("["), (key % 86400).cast("string"), F.lit(', "'), value, F.lit('"]')))
    return read_table(spark, folder, "orders").select("o_orderkey", K.safe_long(text).alias("n"), pair["ts"].alias("s"), pair["value"].alias("value"))


# --- chains and draws --------------------------------------------------------------

_LEVELS = "[100, 110, 120, 130, 140, 150, 160, 200, 250]"
_LEVEL = f"{_LEVELS}[p_size % 9 + 1]"


@query("star_cost_table", _chain_sql(_LEVEL, f"CASE WHEN {_LEVEL} <= 94 THEN 5 WHEN {_LEVEL} <= 107 THEN 8 WHEN {_LEVEL} <= 117 THEN 10 WHEN {_LEVEL} <= 127 THEN 15 WHEN {_LEVEL} <= 137 THEN 20 ELSE 30 END", "p_size % 2 = 1", "0.7", "x.c") + """
    SELECT DISTINCT CAST(lv AS INTEGER) AS level, pv AS prevention, CAST(tg AS INTEGER) AS target, CAST(floor(e / 1000 + 0.5) AS BIGINT) AS thousands FROM r""")
def star_cost_table(spark: SparkSession, folder: str) -> DataFrame:
    """The precomputed table: nine levels, with and without prevention, up to each level's cap."""
    found = S.cost_table(spark, [100, 110, 120, 130, 140, 150, 160, 200, 250])
    return found.select("level", "prevention", "target", F.round(F.col("cost") / 1000).cast("long").alias("thousands"))


@query("current_scores", """
    SELECT p_partkey, s AS score, CASE WHEN s > 0 THEN s END AS target FROM (
      SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 10 * (p_size % 20) + 1 * coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 0) ELSE 0 END + 100 * (p_size % 4) AS s FROM part)""")
def current_scores(spark: SparkSession, folder: str) -> DataFrame:
    jobs = F.array(F.lit("없는 직업"), F.lit("비숍"))  # STR with DEX; INT with LUK
    size = F.col("p_size")
    items = FL.job_weights(read_table(spark, folder, "part").withColumn("job", F.get(jobs, size % 2)), REF.job_weight_table(spark))
    score = FL.current_score({"STR": size % 20, "DEX": F.when(size % 3 == 0, size), "ALLSTAT_PCT": size % 4})
    return items.select("p_partkey", score.alias("score"), FL.reachable_target(score).alias("target"))


_DRAWS = """o(position, option) AS (VALUES (0, 'STR'), (1, 'DEX'), (2, 'INT'), (3, 'LUK'), (4, 'STR_DEX'), (5, 'STR_INT'), (6, 'STR_LUK'), (7, 'DEX_INT'), (8, 'DEX_LUK'), (9, 'INT_LUK'),
      (10, 'MAX_HP'), (11, 'MAX_MP'), (12, 'LEVEL_REDUCE'), (13, 'DEF'), (14, 'ATT'), (15, 'MAG'), (16, 'BOSS_DMG_PCT'), (17, 'DMG_PCT'), (18, 'ALLSTAT_PCT')),
    st(stage, prob) AS (VALUES (5, 0.63::DOUBLE), (6, 0.34), (7, 0.03)),
    sc AS (SELECT position, prob, CAST(CASE option WHEN 'STR' THEN 11 * stage * 10 WHEN 'DEX' THEN 11 * stage WHEN 'STR_DEX' THEN 6 * stage * 11 WHEN 'STR_INT' THEN 6 * stage * 10 WHEN 'STR_LUK' THEN 6 * stage * 10
        WHEN 'DEX_INT' THEN 6 * stage WHEN 'DEX_LUK' THEN 6 * stage WHEN 'ATT' THEN floor(6 * stage * (1.0::DOUBLE + 0.1::DOUBLE * (stage - 3)) * 150) * 40
        WHEN 'MAG' THEN floor(6 * stage * (1.0::DOUBLE + 0.1::DOUBLE * (stage - 3)) * 100) * 40 WHEN 'BOSS_DMG_PCT' THEN 2 * stage * 140 WHEN 'DMG_PCT' THEN stage * 140 WHEN 'ALLSTAT_PCT' THEN stage * 100 ELSE 0 END AS BIGINT) AS score FROM o, st),
    pm AS (SELECT position, score, sum(prob) AS prob FROM sc GROUP BY 1, 2)"""


def _weapon(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """A boss weapon of level 200 under the strongest flame, for a class of STR with DEX; a row a target."""
    item = targets.select(
        F.col("target").alias("key"), "target", F.lit(200).alias("level"), F.lit(True).alias("weapon"), F.lit(True).alias("boss"), F.lit("ABYSS").alias("flame_type"),
        F.lit(150).alias("base_att"), F.lit(100).alias("base_mag"), F.lit("없는 직업").alias("job"),
    )
    return FL.job_weights(item, REF.job_weight_table(spark))


@query("flame_pmfs", f"WITH {_DRAWS} SELECT position, score, round(prob, 9) AS prob FROM pm")
def flame_pmfs(spark: SparkSession, folder: str) -> DataFrame:
    found = FL.option_pmfs(_weapon(spark, spark.createDataFrame([(1,)], "target int")), "key")
    return found.select("position", F.col("score").cast("long").alias("score"), F.round("prob", 9).alias("prob"))


@query("flame_draws", f"""WITH {_DRAWS},
    sums AS (SELECT a.score + b.score + c.score + d.score AS total, sum(a.prob * b.prob * c.prob * d.prob) AS p
      FROM pm a JOIN pm b ON a.position < b.position JOIN pm c ON b.position < c.position JOIN pm d ON c.position < d.position GROUP BY 1),
    t AS (SELECT DISTINCT p_size * 4000 AS target FROM part)
    SELECT target, round(p, 9) AS p, round(1 / p, 4) AS trials FROM (SELECT target, sum(p) / 3876 AS p FROM t LEFT JOIN sums ON total >= target GROUP BY 1) WHERE p > 1e-6""")
def flame_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of four of nineteen options at once, by enumeration in SQL."""
    items = _weapon(spark, read_table(spark, folder, "part").select((F.col("p_size") * 4000).alias("target")).distinct())
    found = FL.flame_trials(items, FL.option_pmfs(items, "key"), "key").where("p > 1e-6")
    return found.select(F.col("key").alias("target"), F.round("p", 9).alias("p"), F.round("trials", 4).alias("trials"))


@query("first_rates", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25 END * 0.125 * 0.5 AS p FROM part""")
def first_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Three equal lines; of two rates of the first slot the first row's counts."""
    sizes = [(d, s, "x", r, n) for d, first in ((0, 0.5), (1, 0.25)) for s, r, n in ((1, first, 0), (1, 0.9, 1), (1, 0.1, 2), (2, 0.125, 3), (3, 0.5, 4))]
    rates = spark.createDataFrame(sizes, "dist_id int, slot int, option string, rate double, line int")
    items = read_table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") % 2).alias("dist_id"), F.array_repeat(F.lit("x"), 3).alias("options"))
    return D.permutation_trials(items, rates, order="line").select(F.col("item_id").alias("p_partkey"), "p")


# --- buffers and claims -------------------------------------------------------------


@query("bounded_buffer", """
    WITH RECURSIVE o AS (SELECT event_id, user_id AS k, event_type = 'purchase' AS drains, CAST(round(value) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, CASE WHEN drains THEN 0 WHEN n <= 100 THEN n ELSE 0 END AS level, CASE WHEN drains THEN 0 WHEN n <= 100 THEN n ELSE 0 END AS accepted FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.event_id, o.rn, CASE WHEN drains THEN level - least(level, n) WHEN level + n <= 100 THEN level + n ELSE level END,
            CASE WHEN drains THEN least(level, n) WHEN level + n <= 100 THEN n ELSE 0 END FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT event_id, accepted FROM f""")
def bounded_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """A buffer of 100 entries for each user: purchases drain it, other events offer their value."""
    action = F.when(F.col("event_type") == "purchase", "DRAIN").otherwise("OFFER")
    rows = read_table(spark, folder, "events").select("event_id", "user_id", action.alias("action"), F.round("value").cast("long").alias("n"))
    return ST.bounded_buffer(rows, "user_id", ["event_id"], 100).select("event_id", "accepted")


@query("idempotent_claims", """
    WITH RECURSIVE o AS (SELECT event_id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAIL' ELSE 'BEGIN' END AS a,
             row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, CASE WHEN a = 'BEGIN' THEN 'PROCESSING' END AS state, s AS since, CASE WHEN a = 'BEGIN' THEN 'CLAIMED' ELSE 'IGNORED' END AS outcome FROM o WHERE rn = 1
          UNION ALL SELECT k, event_id, rn, CASE WHEN a = 'BEGIN' THEN coalesce(live, 'PROCESSING') WHEN live = 'PROCESSING' AND a = 'DONE' THEN 'COMPLETED' WHEN live = 'PROCESSING' THEN NULL ELSE live END,
            CASE WHEN a = 'BEGIN' AND live IS NULL OR live = 'PROCESSING' AND a = 'DONE' THEN s ELSE since END,
            CASE WHEN a = 'BEGIN' THEN coalesce(live, 'CLAIMED') WHEN live = 'PROCESSING' AND a = 'DONE' THEN 'COMPLETED' WHEN live = 'PROCESSING' THEN 'RELEASED' ELSE 'IGNORED' END
          FROM (SELECT o.*, f.since, CASE WHEN o.s - f.since < 43200 THEN f.state END AS live FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1))
    SELECT event_id, outcome FROM f""")
def idempotent_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that live twelve hours: purchases complete, errors release, other events begin."""
    action = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAIL").otherwise("BEGIN")
    rows = read_table(spark, folder, "events").select("event_id", "user_id", action.alias("action"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return ST.idempotent_claims(rows, "user_id", "s", ttl=43200, tie="event_id").select("event_id", "outcome")


@query("group_read", """
    WITH h AS (SELECT event_id, ts AS since FROM events WHERE event_type = 'error'),
    late AS (SELECT event_id FROM h WHERE since <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE ORDER BY event_id LIMIT 500),
    fresh AS (SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM h) ORDER BY event_id LIMIT 500)
    SELECT event_id, true AS reclaimed FROM late UNION ALL SELECT event_id, false FROM fresh WHERE NOT EXISTS (SELECT 1 FROM late)""")
def group_read(spark: SparkSession, folder: str) -> DataFrame:
    """The next 500 events of a group that holds all errors since they came, read at the end of the log."""
    events = read_table(spark, folder, "events")
    held = events.where("event_type = 'error'").select("event_id", F.lit("a").alias("consumer"), F.col("ts").alias("since"), F.lit(1).alias("times"))
    ends = events.agg(F.max("ts").alias("now"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last")).first()
    return ST.read_group(events, held, "event_id", F.lit(ends["last"]), F.lit(ends["now"]), 500).select("event_id", "reclaimed")


@query("group_held_after", """
    WITH h AS (SELECT event_id, ts AS since FROM events WHERE event_type = 'error'),
    late AS (SELECT event_id FROM h WHERE since <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE ORDER BY event_id LIMIT 500)
    SELECT h.event_id, CASE WHEN l.event_id IS NULL THEN 'a' ELSE 'b' END AS consumer,
           CAST(CASE WHEN l.event_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS times
    FROM h LEFT JOIN late l ON l.event_id = h.event_id""")
def group_held_after(spark: SparkSession, folder: str) -> DataFrame:
    """Who holds the errors after consumer b has read from that group."""
    events = read_table(spark, folder, "events")
    held = events.where("event_type = 'error'").select("event_id", F.lit("a").alias("consumer"), F.col("ts").alias("since"), F.lit(1).alias("times"))
    ends = events.agg(F.max("ts").alias("now"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last")).first()
    taken = ST.read_group(events, held, "event_id", F.lit(ends["last"]), F.lit(ends["now"]), 500)
    return ST.held_after(held, taken, "event_id", "b", F.lit(ends["now"])).select("event_id", "consumer", "times")
