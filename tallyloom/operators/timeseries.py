"""Time series: rates of counters, quantiles of histograms, anomalies, alerts.

Rates aren't extrapolated to the edges of their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.session import cut


def latest_point(points: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """The last point of every series; of equal times the larger value."""
    rank = F.row_number().over(W.partitionBy(*series).orderBy(F.desc(ts), F.desc(value)))
    return points.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def latest_pivot(points: DataFrame, names: list[str], instance: str = "instance", metric: str = "metric") -> DataFrame:
    """Gauge snapshots: the latest value of each metric as a column."""
    return latest_point(points, [instance, metric]).groupBy(instance).pivot(metric, names).agg(F.first("value"))


def threshold_severity(value: Column, warn: Column, crit: Column) -> Column:
    """CRIT before WARN; null for neither."""
    return F.when(value > crit, "CRIT").when(value > warn, "WARN")


def mean_and_deviation(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation over finite values; fewer than two points deviate by 0."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return points.groupBy(*keys).agg(
        F.avg(finite).alias("mean"), F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias("deviation"), F.count(finite).alias("n")
    )


def zscore_anomalies(points: DataFrame, series: list[str], threshold: float = 3.0, least: int = 10, rolling: int | None = None, ts: str = "ts", value: str = "value", max_broadcast: int = 100_000) -> DataFrame:
    """Points with z-score and severity: |z| over the threshold, CRIT from 3 on.

    The baseline is the whole series with the point itself, or the last ``rolling``
    points; fewer than ``least`` points or no deviation give no anomaly.
    """
    kept = points.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    window = W.partitionBy(*series)
    if rolling:
        window = window.orderBy(ts).rowsBetween(-(rolling - 1), W.currentRow)
        mean, deviation, n = F.avg(value).over(window), F.stddev_samp(value).over(window), F.count(value).over(window)
        scored = kept.withColumns({"mean": mean, "deviation": deviation, "n": n})
    else:  # sums are combined before the shuffle, so no series is gathered
        sums = kept.groupBy(*(F.col(s).alias(f"__{s}") for s in series)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("n"))
        baselines = cut(sums.where((F.col("n") >= least) & (F.col("deviation") > 0)))
        on = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in series]
        few = baselines.count() <= max_broadcast
        scored = kept.join(F.broadcast(baselines) if few else baselines, on).drop(*(f"__{s}" for s in series))
    z = F.abs(F.col(value) - F.col("mean")) / F.col("deviation")
    scored = scored.where((F.col("n") >= least) & (F.col("deviation") > 0)).withColumn("z", z)
    return scored.where(F.col("z") >= threshold).withColumn("severity", F.when(F.col("z") >= 3.0, "CRIT").otherwise("WARN"))


def deviation_percent(value: Column, baseline: Column) -> Column:
    """Percent off the baseline; off a baseline of 0 anything else is 100."""
    return F.when(baseline == 0, F.when(value == 0, 0.0).otherwise(100.0)).otherwise((value - baseline) / F.abs(baseline) * 100)


def increase(points: DataFrame, series: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Points with ``increase`` over the last ``seconds``: a fall is a reset, which counts from 0.

    Steps count between points of the window; the step into its first point doesn't. With
    the steps summed up along a series that is the window's last sum less its first, and
    as the sums never fall, its largest less its least.
    """
    order = W.partitionBy(*series).orderBy("__s", value)
    stamped = points.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")))
    before = F.lag(value).over(order)
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    run = F.sum("__step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranged = W.partitionBy(*series).orderBy("__s").rangeBetween(-seconds * 1_000_000, 0)
    summed = stamped.withColumn("__step", step).withColumn("__run", run)
    return summed.withColumn("increase", F.max("__run").over(ranged) - F.min("__run").over(ranged)).drop("__s", "__step", "__run")


def rate(points: DataFrame, series: list[str], seconds: int, **names: str) -> DataFrame:
    return increase(points, series, seconds, **names).withColumn("rate", F.col("increase") / seconds).drop("increase")


def sum_of_rates(points: DataFrame, series: list[str], by: list[str], seconds: int) -> DataFrame:
    """by, value: latest rate of every series, summed by labels."""
    latest = latest_point(rate(points, series, seconds).withColumn("value", F.col("rate")), series)
    return latest.groupBy(*by).agg(F.sum("value").alias("value"))


def count_over_time(rows: DataFrame, series: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    ranged = W.partitionBy(*series).orderBy("__s").rangeBetween(-seconds * 1_000_000, 0)
    stamped = rows.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")))
    return stamped.withColumn("n_recent", F.count("*").over(ranged)).drop("__s")


def counts_by_window(rows: DataFrame, labels: list[str], length: str, ts: str = "ts") -> DataFrame:
    window = F.window(F.col(ts).cast("timestamp"), length)
    return rows.groupBy(*labels, window.alias("w")).agg(F.count("*").alias("n")).select(*labels, F.col("w.start").alias("start"), "n")


def alert_islands(rows: DataFrame, series: list[str], condition: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """series, started, ended, n: runs of points that meet the condition for ``seconds`` or longer."""
    order = W.partitionBy(*series).orderBy(ts)
    marked = rows.withColumn("__on", F.coalesce(condition, F.lit(False)))
    marked = marked.withColumn("__island", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(order))
    runs = marked.where("__on").groupBy(*series, "__island").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
    held = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))
    return runs.where(held >= seconds).drop("__island")


def age_over(started: Column, as_of: Column, seconds: int) -> Column:
    return F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp")) > seconds


def state_code(open_: Column, half_open: Column) -> Column:
    """0 closed, 1 open, 2 half open: the weighted sum of state series."""
    return F.coalesce(open_, F.lit(0)) * 1 + F.coalesce(half_open, F.lit(0)) * 2


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, le: str = "le", count: str = "count") -> DataFrame:
    """keys, quantile: linear interpolation in cumulative buckets.

    ``buckets`` has an upper bound (the last infinite) and a cumulative count. The rank
    in the last bucket gives the bound before it; without an infinite bucket or any
    counts the quantile is NaN.
    """
    order = W.partitionBy(*keys).orderBy(le)
    summed = buckets.groupBy(*keys, le).agg(F.sum(count).alias("__c"))
    ranked = summed.withColumns(
        {
            "__prev_le": F.coalesce(F.lag(le).over(order), F.lit(0.0)),
            "__prev_c": F.coalesce(F.lag("__c").over(order), F.lit(0.0)),
            "__total": F.max("__c").over(W.partitionBy(*keys)),
            "__top": F.max(le).over(W.partitionBy(*keys)),
            "__n": F.count("*").over(W.partitionBy(*keys)),
            "__rn": F.row_number().over(order),
        }
    )
    rank = F.col("__total") * q
    hit = (F.col("__c") >= rank) & ((F.col("__prev_c") < rank) | (F.col("__rn") == 1))
    inside = F.col("__prev_le") + (F.col(le) - F.col("__prev_le")) * F.try_divide(rank - F.col("__prev_c"), F.col("__c") - F.col("__prev_c"))
    value = F.when(F.col(le) == float("inf"), F.col("__prev_le")).otherwise(inside)
    good = (F.col("__top") == float("inf")) & (F.col("__total") > 0) & (F.col("__n") >= 2)
    first = ranked.withColumn("__v", F.when(good, value).otherwise(F.lit(float("nan")))).where(hit | ~good)
    return first.groupBy(*keys).agg(F.min("__v").alias("quantile"))


def golden_signals(requests: DataFrame, keys: list[str], latency: str, failed: Column, accuracy: int | None = 10_000) -> DataFrame:
    """Latency percentiles, mean, max, traffic and error rate of each group.

    Percentiles are approximate, of bounded memory; ``accuracy`` None takes exact,
    interpolated ones, which need memory for a group's different values.
    """

    def percentile(q: float) -> Column:
        return F.expr(f"percentile(`{latency}`, {q})") if accuracy is None else F.percentile_approx(latency, q, accuracy)

    return requests.groupBy(*keys).agg(
        F.count("*").alias("n"),
        percentile(0.5).alias("p50"),
        percentile(0.95).alias("p95"),
        percentile(0.99).alias("p99"),
        F.avg(latency).alias("mean"),
        F.max(latency).alias("most"),
        (F.sum(F.when(failed, 1).otherwise(0)) / F.count("*")).alias("error_rate"),
    )


def saturation(used: Column, limit: Column) -> Column:
    """Share of the limit that is used, in per cent; 0 without a limit."""
    return F.when(limit > 0, used / limit * 100).otherwise(0.0)
