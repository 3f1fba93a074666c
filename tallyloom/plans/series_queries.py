"""Time-series and stateful queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators import stateful as S
from tallyloom.operators import timeseries as TS
from tallyloom.plans.registry import query
from tallyloom.sources import read_table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def _seconds(column: str = "ts") -> F.Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


@query("golden_signals", """
    SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS mean, max(value) AS most,
           round(CAST(count(*) FILTER (WHERE value > 100) AS DOUBLE) / count(*), 6) AS error_rate FROM events GROUP BY 1""")
def golden_signals(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.golden_signals(_events(spark, folder), ["event_type"], "value", F.col("value") > 100, accuracy=None)
    return found.select("event_type", "n", "most", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean", "error_rate")))


@query("service_statistics", """
    SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS most FROM events GROUP BY 1""")
def service_statistics(spark: SparkSession, folder: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return _events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"), total.alias("total"), F.max("value").alias("most"))


@query("mean_and_deviation", """
    SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation, count(value) AS n FROM events GROUP BY 1""")
def mean_and_deviation(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.mean_and_deviation(_events(spark, folder), ["event_type"])
    return found.select("event_type", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "n")


_BOUNDS = [5.0, 10.0, 20.0, 30.0, 40.0, float("inf")]


@query("histogram_quantile", """
    WITH b(le) AS (VALUES (5.0::DOUBLE), (10.0), (20.0), (30.0), (40.0), ('Infinity'::DOUBLE)),
    c AS (SELECT l_returnflag, le, count(*) FILTER (WHERE l_quantity <= le) AS c FROM lineitem, b GROUP BY 1, 2),
    r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS ple, coalesce(lag(c) OVER w, 0) AS pc, 0.95 * max(c) OVER (PARTITION BY l_returnflag) AS rk
          FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY le))
    SELECT l_returnflag, round(CASE WHEN isinf(le) THEN ple ELSE ple + (le - ple) * (rk - pc) / (c - pc) END, 6) AS quantile
    FROM r WHERE c >= rk AND pc < rk""")
def histogram_quantile(spark: SparkSession, folder: str) -> DataFrame:
    bounds = F.array(*map(F.lit, _BOUNDS))
    # one row per item and bound that holds it, summed before the shuffle
    rows = read_table(spark, folder, "lineitem").select("l_returnflag", F.explode(F.filter(bounds, lambda b: F.col("l_quantity") <= b)).alias("le"))
    buckets = rows.groupBy("l_returnflag", "le").agg(F.count("*").cast("double").alias("count"))
    return TS.histogram_quantile(buckets, ["l_returnflag"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query("error_ratio", """
    WITH d AS (SELECT CAST(unnest(generate_series(min(date_trunc('day', ts)) - INTERVAL 3 DAY, max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS DATE) AS day FROM events)
    SELECT CAST(d.day AS VARCHAR) AS day, coalesce(round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(event_id), 0), 6), 0.0) AS ratio
    FROM d LEFT JOIN events ON CAST(ts AS DATE) = d.day GROUP BY d.day""")
def error_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Error rate of every day from three before the first on; a day without events has 0."""
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    events = _events(spark, folder).withColumn("day", F.to_date("ts"))
    series = events.groupBy("day").agg((F.try_divide(errors, F.count("*")) * 100).alias("value"))
    wanted = events.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.expr("sequence(date_sub(lo, 3), hi)")).alias("day"))
    found = R.or_default(series, wanted, ["day"])
    return found.select(F.col("day").cast("string").alias("day"), F.round("value", 6).alias("ratio"))


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    """A counter per user that falls now and then: cents of the value, summed, starting anew every 37 events."""
    order = W.partitionBy("user_id").orderBy("event_id")
    rows = _events(spark, folder).withColumn("__n", F.floor((F.row_number().over(order) - 1) / 37))
    total = F.sum(F.round(F.col("value") * 100).cast("long")).over(W.partitionBy("user_id", "__n").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("event_id", "user_id", "ts", total.cast("double").alias("value"))


_COUNTERS = """WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 37 AS g FROM events),
    c AS (SELECT event_id, user_id, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, g ORDER BY event_id) AS DOUBLE) AS v FROM e),
    w AS (SELECT event_id, user_id, list_transform(list_sort(list({'t': ts, 'v': v}) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)), lambda p: p.v) AS vs FROM c),
    i AS (SELECT event_id, user_id, coalesce(list_sum(list_transform(range(2, len(vs) + 1), lambda k: CASE WHEN vs[k] < vs[k - 1] THEN vs[k] ELSE vs[k] - vs[k - 1] END)), 0) AS increase FROM w)"""


@query("counter_increase", _COUNTERS + " SELECT event_id, user_id, increase FROM i")
def counter_increase(spark: SparkSession, folder: str) -> DataFrame:
    return TS.increase(_counters(spark, folder), ["user_id"], 12 * 3600).select("event_id", "user_id", "increase")


@query("counter_rate", _COUNTERS + " SELECT event_id, user_id, round(increase / 43200, 6) AS rate FROM i")
def counter_rate(spark: SparkSession, folder: str) -> DataFrame:
    return TS.rate(_counters(spark, folder), ["user_id"], 12 * 3600).select("event_id", "user_id", F.round("rate", 6).alias("rate"))


@query("sum_of_rates", _COUNTERS + """, l AS (SELECT user_id, increase, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM i)
    SELECT user_id % 10 AS label, round(sum(increase / 43200), 6) AS value FROM l WHERE rn = 1 GROUP BY 1""")
def sum_of_rates(spark: SparkSession, folder: str) -> DataFrame:
    points = _counters(spark, folder).withColumn("label", F.col("user_id") % 10)
    return TS.sum_of_rates(points, ["user_id"], ["label"], 12 * 3600).withColumn("value", F.round("value", 6))


@query("count_over_time", """
    SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_recent FROM events""")
def count_over_time(spark: SparkSession, folder: str) -> DataFrame:
    return TS.count_over_time(_events(spark, folder), ["event_type"], 3600).select("event_id", "event_type", "n_recent")


@query("counts_by_window", """
    SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def counts_by_window(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.counts_by_window(_events(spark, folder), ["event_type"], "1 hour")
    return found.select("event_type", F.unix_seconds("start").alias("start"), "n")


@query("alert_for_duration", """
    WITH m AS (SELECT user_id, event_id, ts, value > 10 AS hot, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM m WHERE hot GROUP BY user_id, g
    HAVING CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) >= 86400""")
def alert_for_duration(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.alert_islands(_events(spark, folder), ["user_id"], F.col("value") > 10, 86400)
    return found.select("user_id", _seconds("started").alias("started"), "n")


@query("latest_point", """
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn = 1""")
def latest_point(spark: SparkSession, folder: str) -> DataFrame:
    return TS.latest_point(_events(spark, folder), ["user_id"]).select("user_id", "event_id", "value")


@query("threshold_anomaly", """
    SELECT user_id, value, CASE WHEN value > 60 THEN 'CRIT' WHEN value > 20 THEN 'WARN' END AS severity FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn = 1 AND value > 20""")
def threshold_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    latest = TS.latest_point(_events(spark, folder), ["user_id"])
    return latest.select("user_id", "value", TS.threshold_severity(F.col("value"), F.lit(20.0), F.lit(60.0)).alias("severity")).where("severity is not null")


@query("zscore_anomaly", """
    WITH z AS (SELECT event_id, event_type, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type))
    SELECT event_id, event_type, round(abs(value - m) / s, 6) AS z, 'CRIT' AS severity FROM z WHERE n >= 10 AND s > 0 AND abs(value - m) / s >= 3""")
def zscore_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.zscore_anomalies(_events(spark, folder), ["event_type"])
    return found.select("event_id", "event_type", F.round("z", 6).alias("z"), "severity")


@query("zscore_rolling", """
    WITH z AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, round(abs(value - m) / s, 5) AS z FROM z WHERE n >= 10 AND s > 0 AND abs(value - m) / s >= 3""")
def zscore_rolling(spark: SparkSession, folder: str) -> DataFrame:
    found = TS.zscore_anomalies(_events(spark, folder), ["user_id"], rolling=30)
    return found.select("event_id", "user_id", F.round("z", 5).alias("z"))


@query("deviation_percent", """
    SELECT event_id, round(CASE WHEN b = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE (value - b) / abs(b) * 100 END, 6) AS percent
    FROM (SELECT event_id, value, CAST(user_id % 7 AS DOUBLE) AS b FROM events)""")
def deviation_percent(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.round(TS.deviation_percent(F.col("value"), (F.col("user_id") % 7).cast("double")), 6).alias("percent"))


@query("gauge_snapshot", """
    SELECT user_id AS instance, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1""")
def gauge_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    points = _events(spark, folder).select(F.col("user_id").alias("instance"), F.col("event_type").alias("metric"), "ts", "value")
    return TS.latest_pivot(points, ["click", "view"])


@query("state_code", """
    SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 0 END) AS state FROM events GROUP BY 1""")
def state_code(spark: SparkSession, folder: str) -> DataFrame:
    flag = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    rows = _events(spark, folder).withColumn("s", TS.state_code(flag("error"), flag("signup")))
    return rows.groupBy("user_id").agg(F.max("s").alias("state"))


@query("age_over", "SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS BIGINT) > 86400 AS old FROM events")
def age_over(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", TS.age_over(F.col("ts"), F.lit("2024-01-31").cast("timestamp_ntz"), 86400).alias("old"))


@query("topk_daily", """
    SELECT day, user_id, n, rank FROM (
      SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n,
             CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, user_id) AS INTEGER) AS rank FROM events GROUP BY CAST(ts AS DATE), user_id) WHERE rank <= 3""")
def topk_daily(spark: SparkSession, folder: str) -> DataFrame:
    counts = _events(spark, folder).groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count("*").alias("n"))
    return R.top_k_per_group(counts, ["day"], "n", 3, "user_id")


@query("top_k_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_k_users(spark: SparkSession, folder: str) -> DataFrame:
    return R.top_k(_events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n")), "n", 10, "user_id")


@query("daily_unique", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def daily_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("n"))


@query("snapshot_report", """
    SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2""")
def snapshot_report(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")
    return _events(spark, folder).groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("quota_daily", """
    SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100 AS allowed FROM events""")
def quota_daily(spark: SparkSession, folder: str) -> DataFrame:
    return S.daily_quota(_events(spark, folder), "ts", "event_id", 100).select("event_id", "allowed")


@query("tumbling_budget", """
    SELECT event_id, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) <= 10 AS allowed FROM events""")
def tumbling_budget(spark: SparkSession, folder: str) -> DataFrame:
    return S.tumbling_budget(_events(spark, folder), ["event_type"], "ts", "event_id", 10, "6 hours").select("event_id", "allowed")


def _stamped(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", "user_id", "event_type", "value", _seconds().alias("s"))


_CHAIN = """WITH RECURSIVE e AS (SELECT event_id, {key} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
    o AS (SELECT event_id, k, s, row_number() OVER (PARTITION BY k ORDER BY s, event_id) AS rn FROM e),
    f AS (SELECT k, event_id, s, rn, s AS last, true AS hit FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.event_id, o.s, o.rn, CASE WHEN o.s - f.last >= {wait} THEN o.s ELSE f.last END, o.s - f.last >= {wait}
          FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT event_id, hit AS {name} FROM f"""


@query("cooldown_throttle", _CHAIN.format(key="user_id", wait=21600, name="emitted"))
def cooldown_throttle(spark: SparkSession, folder: str) -> DataFrame:
    return S.cooldown(_stamped(spark, folder), "user_id", "s", 21600, "event_id").select("event_id", "emitted")


@query("dedup_window", _CHAIN.format(key="user_id * 10 + length(event_type)", wait=86400, name="is_new"))
def dedup_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stamped(spark, folder).withColumn("k", F.col("user_id") * 10 + F.length("event_type"))
    return S.duplicates_in_window(rows, "k", "s", 86400, "event_id").select("event_id", "is_new")


@query("budget_from_first", """
    WITH RECURSIVE o AS (SELECT event_id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s,
             row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, s AS start, 1 AS used, true AS ok FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.event_id, o.rn, CASE WHEN o.s - f.start >= 86400 THEN o.s ELSE f.start END,
            CASE WHEN o.s - f.start >= 86400 THEN 1 WHEN f.used < 2 THEN f.used + 1 ELSE f.used END, o.s - f.start >= 86400 OR f.used < 2
          FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT event_id, ok AS allowed FROM f""")
def budget_from_first(spark: SparkSession, folder: str) -> DataFrame:
    return S.budget_from_first(_stamped(spark, folder), "user_id", "s", 2, 86400, "event_id").select("event_id", "allowed")


@query("token_bucket", """
    WITH RECURSIVE o AS (SELECT event_id, user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s,
             row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, s AS start, 0 AS ticks, 1 AS tokens, true AS ok FROM o WHERE rn = 1
          UNION ALL SELECT k, event_id, rn, start, CASE WHEN due > ticks THEN due ELSE ticks END, avail - CASE WHEN avail > 0 THEN 1 ELSE 0 END, avail > 0 FROM (
            SELECT o.k, o.event_id, o.rn, f.start, f.ticks, (o.s - f.start) // 36000 AS due,
                   CASE WHEN (o.s - f.start) // 36000 > f.ticks THEN least(2, f.tokens + (o.s - f.start) // 36000 - f.ticks) ELSE f.tokens END AS avail
            FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1))
    SELECT event_id, ok AS allowed FROM f""")
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return S.token_bucket(_stamped(spark, folder), "user_id", "s", 2, 1, 36000, "event_id").select("event_id", "allowed")


@query("outbox_states", """
    WITH RECURSIVE o AS (SELECT user_id AS k, event_type = 'purchase' AS done, event_type = 'error' AND value > 30 AS broken,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT k, rn, n, CASE WHEN broken THEN 'DEAD_LETTER' WHEN done THEN 'COMPLETED' ELSE 'FAILED' END AS status, CAST(CASE WHEN broken OR done THEN 0 ELSE 1 END AS BIGINT) AS r FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.rn, o.n,
            CASE WHEN f.status IN ('COMPLETED', 'DEAD_LETTER') THEN f.status WHEN o.broken THEN 'DEAD_LETTER' WHEN o.done THEN 'COMPLETED' WHEN f.r + 1 >= 3 THEN 'DEAD_LETTER' ELSE 'FAILED' END,
            CASE WHEN f.status IN ('COMPLETED', 'DEAD_LETTER') OR o.broken OR o.done THEN f.r ELSE f.r + 1 END
          FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT k AS user_id, status, r AS retry_count, n AS n_attempts FROM f WHERE rn = n""")
def outbox_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select(
        "user_id", "event_id", (F.col("event_type") == "purchase").alias("succeeded"), (~((F.col("event_type") == "error") & (F.col("value") > 30))).alias("intact")
    )
    return S.outbox_states(rows, "user_id", "event_id")


@query("health_states", """
    WITH RECURSIVE o AS (SELECT user_id AS k, event_id, CASE event_type WHEN 'error' THEN 'OPEN' WHEN 'view' THEN 'CLOSED' WHEN 'signup' THEN 'RECOVERED' ELSE 'NONE' END AS e,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, CASE WHEN e = 'OPEN' THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.event_id, o.rn, CASE WHEN o.e = 'OPEN' THEN 'DEGRADED' WHEN f.state = 'DEGRADED' AND o.e = 'CLOSED' THEN 'RECOVERING'
            WHEN f.state = 'RECOVERING' AND o.e = 'RECOVERED' THEN 'HEALTHY' ELSE f.state END
          FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT event_id, state FROM f""")
def health_states(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"error": "OPEN", "view": "CLOSED", "signup": "RECOVERED"}
    event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("NONE"))
    rows = _events(spark, folder).select("user_id", "event_id", event.alias("event"))
    return S.health_states(rows, "user_id", ["event_id"]).select("event_id", "state")


@query("idempotent_first", """
    SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def idempotent_first(spark: SparkSession, folder: str) -> DataFrame:
    return S.first_of_each(_events(spark, folder), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("saturation", "SELECT user_id, round(count(*) / 200.0 * 100, 6) AS percent, count(*) > 60 AS full_ FROM events GROUP BY 1")
def saturation(spark: SparkSession, folder: str) -> DataFrame:
    counts = _events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.round(TS.saturation(F.col("n"), F.lit(200.0)), 6).alias("percent"), (F.col("n") > 60).alias("full_"))


@query("queue_states", """
    WITH RECURSIVE o AS (SELECT user_id AS k, event_id, CASE event_type WHEN 'signup' THEN 'PUBLISH' WHEN 'view' THEN 'CONSUME' WHEN 'purchase' THEN 'ACK' WHEN 'error' THEN 'NACK' ELSE 'DUE' END AS a,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT k, event_id, rn, CASE WHEN a = 'PUBLISH' THEN 'PENDING' END AS state, 0 AS r FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.event_id, o.rn, CASE WHEN state IS NULL AND a = 'PUBLISH' THEN 'PENDING' WHEN state = 'PENDING' AND a = 'CONSUME' THEN 'INFLIGHT'
              WHEN state = 'INFLIGHT' AND a = 'ACK' THEN 'DONE' WHEN state = 'INFLIGHT' AND a = 'NACK' THEN CASE WHEN r + 1 > 3 THEN 'DLQ' ELSE 'RETRY' END
              WHEN state = 'RETRY' AND a = 'DUE' THEN 'PENDING' ELSE state END, CASE WHEN state = 'INFLIGHT' AND a = 'NACK' THEN r + 1 ELSE r END
          FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT event_id, state FROM f""")
def queue_states(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"signup": "PUBLISH", "view": "CONSUME", "purchase": "ACK", "error": "NACK"}
    action = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("DUE"))
    rows = _events(spark, folder).select("user_id", "event_id", action.alias("action"))
    return S.queue_states(rows, "user_id", ["event_id"]).select("event_id", "state")


@query("total_delta", "SELECT CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS total, count(DISTINCT user_id) AS n_keys FROM events")
def total_delta(spark: SparkSession, folder: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return _events(spark, folder).agg(F.coalesce(F.sum(delta), F.lit(0)).alias("total"), F.count_distinct("user_id").alias("n_keys"))


@query("line_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE contains(props, '9') AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def line_filter(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, folder).where(F.col("props").contains("9") & (k > 50)).select("event_id", k.alias("k"))


@query("anomaly_reason", """
    SELECT event_id, CASE WHEN value > 50 THEN '[WARN] ' || event_type || ': Current value ' || printf('%.2f', value) || ' > threshold 50.00 ()' END AS reason FROM events""")
def anomaly_reason(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.functions.keys import threshold_reason

    none = F.lit(None).cast("string")
    text = threshold_reason(F.lit("WARN"), F.col("event_type"), F.col("value"), none, F.lit(50.0), none)
    return _events(spark, folder).select("event_id", F.when(F.col("value") > 50, text).alias("reason"))
